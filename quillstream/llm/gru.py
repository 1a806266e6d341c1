"""A gated recurrent language model in numpy, with a class-factored softmax.

Symbols are the commonest words, the end of a text, and buckets of all other
words by their last bytes.  A symbol's probability is that of its class given
the state times its own within the class; a word of a bucket adds its share of
the bucket's counts (plus one, one unseen word included).  Texts are laid end to
end in lanes that run in step, window by window.  Training is truncated
back-propagation: within a text the state goes from window to window, the
gradient does not; after the end of a text the state is zero again.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Units, classes of the output, words that are symbols, and buckets of the others.
UNITS, CLASSES, WORDS, BUCKETS = 16, 48, 2048, 128
#: Steps of a window, and lanes that run in step: in training (one update for each window), and in scoring.
WINDOW, LANES, SCORE_LANES = 16, 256, 512
#: Texts too few for so many updates are trained on in fewer lanes, but no fewer than LEAST_LANES.
UPDATES, LEAST_LANES = 1000, 16
RATE = 0.1
NAMES = ("inp", "rec", "bias", "cls", "cls_bias", "out", "out_bias")


def bucket_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % BUCKETS


@dataclass
class Vocabulary:
    """Symbols 0 (end), 1 to BUCKETS (buckets), then words; ordered into classes by frequency."""

    words: dict[bytes, int]
    class_of: np.ndarray  # class of each symbol
    place: np.ndarray  # symbol's row in the output table, in which classes are contiguous
    starts: np.ndarray  # first row of each class, and the end
    log_unigram: np.ndarray

    @classmethod
    def build(cls, words: list[tuple[bytes, int]], bucket_counts: np.ndarray, ends: int) -> Vocabulary:
        counts = np.concatenate(([ends], bucket_counts, [n for _, n in words])).astype(float) + 1
        order = np.argsort(-counts, kind="stable")
        weight = np.sqrt(counts[order])
        classes = np.minimum((np.cumsum(weight) - weight / 2) / weight.sum() * CLASSES, CLASSES - 1).astype(int)
        classes = np.unique(classes, return_inverse=True)[1]
        class_of, place = np.empty(len(counts), int), np.empty(len(counts), int)
        class_of[order], place[order] = classes, np.arange(len(counts))
        starts = np.searchsorted(classes, np.arange(classes[-1] + 2))
        return cls({w: 1 + BUCKETS + k for k, (w, _) in enumerate(words)}, class_of, place, starts, np.log(counts / counts.sum()))


class Symbols(dict):
    """Words to symbols; words that aren't symbols themselves to their buckets."""

    def __missing__(self, word: bytes) -> int:
        return 1 + bucket_of(word)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)
    return x


def _log_softmax_at(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each column, the log of its softmax in one row; overwrites logits."""
    logits -= logits.max(0)
    picked = logits[at, np.arange(logits.shape[1])].astype(np.float64)
    np.exp(logits, out=logits)
    return picked - np.log(logits.sum(0))


def _softmax_error(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each column, its softmax less one in the row that was right; overwrites logits."""
    logits -= logits.max(0)
    np.exp(logits, out=logits)
    logits /= logits.sum(0)
    logits[at, np.arange(logits.shape[1])] -= 1
    return logits


class Lanes:
    """Texts, each with its end, laid end to end in lanes of about the same length, the longest lane first."""

    def __init__(self, texts: list[np.ndarray], lanes: int):
        heap = [(0, k) for k in range(max(1, min(lanes, len(texts))))]
        self.members: list[list[int]] = [[] for _ in heap]
        for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
            size, k = heap[0]
            self.members[k].append(i)
            heapq.heapreplace(heap, (size + len(texts[i]), k))
        sizes = dict((k, n) for n, k in heap)
        # in each lane texts stand in the order they came in, so long and short ones are mixed
        self.members = [sorted(self.members[k]) for k in sorted(sizes, key=lambda k: (-sizes[k], k))]
        self.sizes = np.array(sorted(sizes.values(), reverse=True))
        self.symbols = np.zeros((self.sizes[0] + 1, len(self.sizes)), np.int16)  # the first row is what comes before
        for k, own in enumerate(self.members):
            if own:
                self.symbols[1 : self.sizes[k] + 1, k] = np.concatenate([texts[i] for i in own])

    def windows(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(place, symbols before, symbols, whether they count), for the lanes that have any left."""
        for at in range(0, int(self.sizes[0]), WINDOW):
            alive = int(np.searchsorted(-self.sizes, -at, side="left"))
            block = self.symbols[at : at + WINDOW + 1, :alive].astype(np.intp)
            yield at, block[:-1], block[1:], at + np.arange(len(block) - 1)[:, None] < self.sizes[:alive]


class Model:
    def __init__(self, vocabulary: Vocabulary, seed: int = 9):
        v, n, k = vocabulary, len(vocabulary.class_of), len(vocabulary.starts) - 1
        rng = np.random.default_rng(seed)
        self.v = v
        f = np.float32
        self.p = {
            "inp": (rng.standard_normal((n, 3 * UNITS)) * 0.3).astype(f),
            "rec": (rng.standard_normal((UNITS, 3 * UNITS)) / np.sqrt(UNITS)).astype(f),
            "bias": np.concatenate((np.full(UNITS, -1.0), np.zeros(2 * UNITS))).astype(f),
            "cls": np.zeros((UNITS, k), f),
            "out": (rng.standard_normal((n, UNITS)) * 0.01).astype(f),
        }
        by_place = np.empty(n)
        by_place[v.place] = v.log_unigram
        mass = np.array([np.logaddexp.reduce(by_place[a:b]) for a, b in zip(v.starts, v.starts[1:])])
        self.p["cls_bias"] = mass.astype(f)
        self.p["out_bias"] = (by_place - np.repeat(mass, np.diff(v.starts))).astype(f)
        self.squares = {name: np.full(self.p[name].shape, 1e-2, f) for name in NAMES}

    def _forward(self, x: np.ndarray, h: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each of the symbols x (steps, lanes); h: the state before.  After an end the state is zero."""
        p, u = self.p, UNITS
        gates = (p["inp"] + p["bias"])[x]
        states = np.empty((*x.shape, u), gates.dtype)
        inside = (x != 0).astype(gates.dtype)[:, :, None]
        for t in range(len(x)):
            h = h * inside[t]
            r = h @ p["rec"]
            zr = _sigmoid(gates[t, :, : 2 * u] + r[:, : 2 * u])
            z, reset = zr[:, :u], zr[:, u:]
            inner = r[:, 2 * u :]
            cand = np.tanh(gates[t, :, 2 * u :] + reset * inner)
            if keep is not None:
                keep.append((h, zr, inner, cand, inside[t]))
            h = h + z * (cand - h)
            states[t] = h
        return states

    def _by_class(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int, int]]]:
        """Classes of the symbols, their order by class, and (from, to, first row, last row) of each class with a choice."""
        starts = self.v.starts
        c = self.v.class_of[y]
        order = np.argsort(c.astype(np.uint8), kind="stable")
        bounds = np.concatenate(([0], np.cumsum(np.bincount(c, minlength=len(starts) - 1)))).tolist()
        rows = starts.tolist()
        return c, order, [(a, b, lo, hi) for a, b, lo, hi in zip(bounds, bounds[1:], rows, rows[1:]) if a < b and hi - lo > 1]

    def _log_p(self, states: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log probability of each next symbol y given its state."""
        p = self.p
        c, order, parts = self._by_class(y)
        # symbols along the last axis: sums and maxima over classes run along whole rows
        out = _log_softmax_at(p["cls"].T @ states.T + p["cls_bias"][:, None], c)[order]
        sorted_states, place = states[order], self.v.place[y[order]]
        for a, b, lo, hi in parts:
            own = p["out"][lo:hi] @ sorted_states[a:b].T + p["out_bias"][lo:hi, None]
            out[a:b] += _log_softmax_at(own, place[a:b] - lo)
        back = np.empty_like(out)
        back[order] = out
        return back

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each text's symbols, the end last; states go on from window to window."""
        if not texts:
            return np.empty(0)
        lanes = Lanes(texts, SCORE_LANES)
        log_p = np.zeros(lanes.symbols.shape)
        h = np.zeros((len(lanes.sizes), UNITS), np.float32)
        for at, x, y, counted in lanes.windows():
            states = self._forward(x, h[: x.shape[1]])
            h = states[-1]
            found = self._log_p(states.reshape(-1, UNITS), y.ravel()).reshape(y.shape)
            log_p[at + 1 : at + 1 + len(x), : x.shape[1]] = np.where(counted, found, 0)
        out = np.empty(len(texts))
        for k, own in enumerate(lanes.members):
            if own:
                firsts = np.cumsum([0] + [len(texts[i]) for i in own[:-1]])
                out[own] = np.add.reduceat(log_p[1 : lanes.sizes[k] + 1, k], firsts)
        return out / np.log(10)

    def train(self, texts: list[np.ndarray], lanes: int | None = None) -> int:
        """One update for each window of the lanes, to the end of every text; the number of symbols trained on."""
        if not texts:
            return 0
        lanes = lanes or max(LEAST_LANES, min(LANES, sum(map(len, texts)) // (WINDOW * UPDATES)))
        laid, seen = Lanes(texts, lanes), 0
        h = np.zeros((len(laid.sizes), UNITS), np.float32)
        for _, x, y, counted in laid.windows():
            h = self._window(x, y, counted, h[: x.shape[1]], lanes * WINDOW)
            seen += int(counted.sum())
        return seen

    def _window(self, x: np.ndarray, y: np.ndarray, valid: np.ndarray, h: np.ndarray, full: int = 0) -> np.ndarray:
        """One update; symbols weigh as if there were full of them at least, so a few left over don't move it like many."""
        p, v, u = self.p, self.v, UNITS
        kept: list = []
        states = self._forward(x, h, kept)
        rows = np.flatnonzero(valid)
        if not len(rows):
            return states[-1]
        n = max(len(rows), full)
        t = y.ravel()[rows]
        c, order, parts = self._by_class(t)
        rows, t, c = rows[order], t[order], c[order]
        s = states.reshape(-1, u)[rows]
        grads: dict[str, np.ndarray] = {}
        d = _softmax_error(p["cls"].T @ s.T + p["cls_bias"][:, None], c)
        grads["cls"], grads["cls_bias"] = (d @ s).T / n, d.sum(1) / n
        d_s = d.T @ p["cls"].T
        grads["out"], grads["out_bias"] = np.zeros_like(p["out"]), np.zeros_like(p["out_bias"])
        place = v.place[t]
        for a, b, lo, hi in parts:
            own_s = s[a:b]
            d = _softmax_error(p["out"][lo:hi] @ own_s.T + p["out_bias"][lo:hi, None], place[a:b] - lo)
            grads["out"][lo:hi], grads["out_bias"][lo:hi] = d @ own_s / n, d.sum(1) / n
            d_s[a:b] += d.T @ p["out"][lo:hi]
        d_states = np.zeros_like(states)
        d_states.reshape(-1, u)[rows] = d_s / n
        d_gates = np.empty((*x.shape, 3 * u), states.dtype)
        d_rec = np.zeros_like(p["rec"])
        back = np.zeros_like(d_states[0])
        rec_t = np.ascontiguousarray(p["rec"].T)
        for k in range(len(x) - 1, -1, -1):
            before, zr, inner, cand, inside = kept[k]
            z, reset = zr[:, :u], zr[:, u:]
            back += d_states[k]
            own = d_gates[k]
            slope = zr * (1 - zr)
            d_cand = back * z
            d_cand *= 1 - cand * cand
            own[:, :u] = back * (cand - before)
            own[:, u : 2 * u] = d_cand * inner
            own[:, : 2 * u] *= slope
            own[:, 2 * u :] = d_cand
            through = own.copy()
            through[:, 2 * u :] *= reset
            d_rec += before.T @ through
            back = back * (1 - z)
            back += through @ rec_t
            back *= inside
        flat = d_gates.reshape(-1, 3 * u)
        grads["rec"], grads["bias"] = d_rec, flat.sum(0)
        symbols = x.ravel()
        by = np.argsort(symbols.astype(np.int16), kind="stable")
        some, first = np.unique(symbols[by], return_index=True)
        self._move("inp", np.add.reduceat(flat[by], first, 0), some)
        for name, g in grads.items():
            self._move(name, g, slice(None))
        return states[-1]

    def _move(self, name: str, g: np.ndarray, where) -> None:
        """Adagrad, with each entry of the gradient held to one."""
        g *= 32
        np.clip(g, -1, 1, out=g)
        sq = self.squares[name][where] + g * g
        self.squares[name][where] = sq
        self.p[name][where] -= RATE * g / np.sqrt(sq)

    def vector(self) -> np.ndarray:
        """All parameters, and the sums that set their step sizes."""
        return np.concatenate([table[name].ravel() for table in (self.p, self.squares) for name in NAMES])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for table in (self.p, self.squares):
            for name in NAMES:
                n = table[name].size
                table[name] = flat[at : at + n].reshape(table[name].shape).astype(np.float32)
                at += n
