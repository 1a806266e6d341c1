"""Byte-level BPE as a lazily determinised transducer, and a streaming decoder.

Two adjacent tokens are *compatible* if merging their joined bytes gives the
same two tokens back.  A token sequence is the BPE encoding of its bytes
exactly if all its neighbours are compatible (the first merge across a
boundary would also happen with the two tokens alone), and so every prefix of
an input has one last token.  The transducer reads bytes and guesses where the
next token starts.  What later bytes can still depend on makes a state: the
place in the vocabulary's automaton, for each live guess what of the token
before it matters, and how the guesses' paths join.  States and transitions are
made as inputs need them; tokens before the place where all paths join are
emitted at once.  No guess stays open longer than the longest token, which
bounds the lookahead.
"""

from __future__ import annotations

import base64
import math
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, id_and_text, own_tables, small_batches

#: States, pairs of tokens and words that one process keeps; each of these tables starts afresh when it is full.
MAX_STATES, MAX_PAIRS, MAX_WORDS = 150_000, 500_000, 350_000
#: Before a guess with at most so many tokens to come, left tokens that go with the same of them are the same to a state.
FEW = 12
#: The same for executors that have little memory beside the JVM.
SMALL = (40_000, 150_000, 80_000)
#: Tokens that the decoder joins at a time.
DECODE_BLOCK = 65_536


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank from a file of base64 and number per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_plain(ranks: dict[bytes, int], piece: bytes, stop: int = 1) -> list[bytes]:
    """The textbook merge loop: join the lowest-ranked, leftmost pair until none, or no more than stop parts, are left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > stop:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Transducer:
    """Encodes one pre-token at a time; states and transitions appear as inputs need them.

    The live guesses after some bytes are the places from where these bytes
    begin a longer token: the suffixes on the failure path of the place in the
    vocabulary's Aho-Corasick automaton, and the empty one.  Which last token a
    prefix has follows from the state and the next byte; the tokens before the
    place where the live guesses' paths join are certain.
    """

    def __init__(self, ranks: dict[bytes, int], bounds: tuple[int, int, int] | None = None):
        self.max_states, self.max_pairs, _ = bounds or (MAX_STATES, MAX_PAIRS, MAX_WORDS)
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.trie: dict[int, int] = {}
        at_node, depth, parents = [-1], [0], [(0, 0)]
        for piece, rank in ranks.items():
            node = 0
            for byte in piece:
                key = node << 8 | byte
                nxt = self.trie.get(key)
                if nxt is None:
                    nxt = self.trie[key] = len(at_node)
                    at_node.append(-1)
                    depth.append(depth[node] + 1)
                    parents.append((node, byte))
                node = nxt
            at_node[node] = rank
        self.depth, self.fail, self.at_node = depth, [0] * len(depth), at_node
        #: Tokens that end at a node, longest first, with their lengths.
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(depth)
        #: Suffixes of a node that begin longer tokens: nodes, longest first.
        self.open: list[tuple[int, ...]] = [()] * len(depth)
        #: Tokens that begin with a node and are longer.
        self.longer = [0] * len(depth)
        order = sorted(range(1, len(depth)), key=depth.__getitem__)
        #: Nodes that follow a node.
        self.after: dict[int, list[int]] = {}
        for node in reversed(order):
            self.after.setdefault(parents[node][0], []).append(node)
            self.longer[parents[node][0]] += self.longer[node] + (at_node[node] >= 0)
        for node in order:
            up, byte = parents[node]
            if up:
                self.fail[node] = self._goto(self.fail[up], byte)
            own = ((at_node[node], depth[node]),) if at_node[node] >= 0 else ()
            self.ends[node] = own + self.ends[self.fail[node]] if own else self.ends[self.fail[node]]
            self.open[node] = (node, *self.open[self.fail[node]]) if self.longer[node] else self.open[self.fail[node]]
        self.below: dict[int, list[int]] = {}
        self.pairs: dict[int, bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.kinds: dict[int, int] = {}
        #: Transitions that had to be made, and states that were dropped because there were too many.
        self.made = self.dropped = 0
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[tuple, int] = {}
        #: Of each state: node, last token, its length, and how far behind the live paths join.
        self.node, self.last, self.size, self.behind = [0], [-1], [0], [0]
        self.moves: dict[int, int] = {}

    def _goto(self, node: int, byte: int) -> int:
        while True:
            nxt = self.trie.get(node << 8 | byte)
            if nxt is not None:
                return nxt
            if not node:
                return 0
            node = self.fail[node]

    def _edge(self, token: int, last: bool) -> list[tuple[bytes, float]]:
        """Parts that stand at the end (or start) of a token while it is merged, each with the rank of the merge that uses it up.

        Empty if its own bytes don't merge to the token.
        """
        known = self.edges[last].get(token)
        if known is None:
            whole, until, known = self.token[token], math.inf, []
            while True:
                known.append((whole, until))
                if len(whole) == 1:
                    break
                parts = merge_plain(self.ranks, whole, 2)
                if len(parts) != 2:
                    known = []
                    break
                until = self.ranks[whole]
                whole = parts[last]
            known.reverse()
            self.edges[last][token] = known
        return known

    def _compatible(self, left: int, right: int) -> bool:
        """Whether no merge across the border of two tokens comes before those inside them; left -1: nothing."""
        key = left + 1 << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= self.max_pairs:
                self.pairs.clear()
            known = self.pairs[key] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        starts = self._edge(right, False)
        if left < 0 or not starts:
            return bool(starts)
        ends = self._edge(left, True)
        if not ends:
            return False
        i = j = 0
        while True:
            (a, a_until), (b, b_until) = ends[i], starts[j]
            across = self.ranks.get(a + b)
            if across is not None and across < a_until and across <= b_until:
                return False
            if a_until <= b_until:  # of equal merges the left one comes first
                if a_until == math.inf:
                    return True
                i += 1
            else:
                j += 1

    def _tokens_below(self, node: int) -> list[int]:
        """The tokens that begin with a node and are longer."""
        found = self.below.get(node)
        if found is None:
            found = []
            for nxt in self.after.get(node, ()):
                if self.at_node[nxt] >= 0:
                    found.append(self.at_node[nxt])
                found += self._tokens_below(nxt)
            self.below[node] = found
        return found

    def _kind(self, left: int, node: int) -> int:
        """What matters of the token before a guess that has come to node: which of the tokens to come may follow it."""
        if self.longer[node] > FEW:
            return left
        key = left + 1 << 32 | node
        known = self.kinds.get(key)
        if known is None:
            if len(self.kinds) >= self.max_pairs:
                self.kinds.clear()
            known = -2 - sum(1 << k for k, right in enumerate(self._tokens_below(node)) if self._compatible(left, right))
            self.kinds[key] = known
        return known

    def _step(self, state: int, byte: int, path: list[int]) -> int:
        """The state after one more byte; path holds the states after each prefix read so far."""
        self.made += 1
        ranks, sizes, depth = self.last, self.size, self.depth
        node = self._goto(self.node[state], byte)
        for rank, size in self.ends[node]:
            if self._compatible(ranks[path[-size]], rank):
                break
        else:
            raise ValueError(f"the vocabulary can't spell byte {byte}")
        at = len(path)  # prefixes are named by their lengths; this byte makes the one of length at
        guesses = tuple([(depth[f], self._kind(ranks[path[at - depth[f]]], f)) for f in self.open[node]])
        live, paths, here, back = {at - d for d, _ in guesses}, [], at, size
        while live:  # from the end back along the paths to where they join
            paths.append(back)
            live.add(here - back)
            here = max(live)
            live.discard(here)
            back = sizes[path[here]]
        key = (node, rank, guesses, tuple(paths))
        to = self.ids.get(key)
        if to is None:
            to = self.ids[key] = len(self.node)
            self.node.append(node)
            ranks.append(rank)
            sizes.append(size)
            self.behind.append(at - here)
        self.moves[state << 8 | byte] = to
        return to

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token; a pre-token that is itself a token stays whole."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.node) >= self.max_states:
            self.dropped += len(self.node)
            self._clear()
        find, behind, last, size = self.moves.get, self.behind, self.last, self.size
        path, out, state, done = [0], [], 0, 0
        for at, byte in enumerate(piece, 1):
            to = find(state << 8 | byte)
            if to is None:
                to = self._step(state, byte, path)
            path.append(to)
            state = to
            sure = at - behind[to]
            if sure > done:
                if sure - size[path[sure]] == done:
                    out.append(last[path[sure]])
                else:
                    self._emit(done, sure, path, out)
                done = sure
        if done < at:
            self._emit(done, at, path, out)
        return out

    def _emit(self, done: int, to: int, path: list[int], out: list[int]) -> None:
        """The tokens between two places that are certain; no more of them than the lookahead."""
        back = []
        while to > done:
            state = path[to]
            back.append(self.last[state])
            to -= self.size[state]
        out.extend(reversed(back))


class _Irregular(Exception):
    """Blanks that cutting at single spaces can't handle."""


class _Words(dict):
    """Words that follow one space, to their token ids as bytes; filled on demand.

    A full table becomes the old one, from which words that come again return.
    """

    def __init__(self, encoder: Encoder, lead: str):
        super().__init__()
        self.encoder, self.lead, self.old = encoder, lead, {}

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            if self.lead and (not word or word[0].isspace()):
                raise _Irregular
            found = self.encoder.spell(self.lead + word)
        if len(self) >= self.encoder.max_words:
            self.old = dict(self)
            self.clear()
        if len(word) < 64:
            self[word] = found
        return found


class Encoder:
    """Whole texts to token ids (little-endian unsigned 32-bit, as bytes) and back.

    The pattern never lets a match run across a space that stands between two
    visible characters, so texts are cut there and words are looked up; texts
    with other runs of blanks go through the pattern as a whole.
    """

    def __init__(self, path: str, pattern: str, bounds: tuple[int, int, int] | None = None):
        self.max_words = (bounds or (MAX_STATES, MAX_PAIRS, MAX_WORDS))[2]
        self.machine = Transducer(load_ranks(path), bounds)
        self.pattern = regex.compile(pattern)
        self.pieces: dict[str, bytes] = {}
        self.inner, self.head = _Words(self, " "), _Words(self, "")

    def spell(self, text: str) -> bytes:
        """Every match of the pattern by itself."""
        if text[text[:1] == " " :].isalpha():  # all letters, after one space at most: one match
            return self._piece(text)
        found = self.pattern.findall(text)
        if len(found) == 1:
            return self._piece(text)
        pieces = self.pieces
        if len(pieces) >= self.max_words // 2:
            pieces.clear()
        out = []
        for piece in found:
            ids = pieces.get(piece)
            if ids is None:
                ids = self._piece(piece)
                if len(piece) < 64:
                    pieces[piece] = ids
            out.append(ids)
        return b"".join(out)

    def _piece(self, piece: str) -> bytes:
        ids = self.machine.encode(piece.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        words = text.split(" ")
        try:
            return self.head[words[0]] + b"".join(map(self.inner.__getitem__, words[1:]))
        except _Irregular:
            return self.spell(text)

    def decode(self, ids: bytes) -> Iterator[str]:
        """Text in parts, as soon as whole characters are there."""
        stream = Utf8Stream()
        token = self.machine.token
        for part in blocks(np.frombuffer(ids, "<u4").tolist(), DECODE_BLOCK):
            yield stream.feed(b"".join(map(token.__getitem__, part)))
        yield stream.close()


class Utf8Stream:
    """Bytes in any portions to text; what is no UTF-8 becomes U+FFFD, once for each maximal part.

    The state is what an unfinished character at the end has so far.  Portions
    that are sound go through at once; others a byte at a time.
    """

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def _room(lead: int) -> tuple[int, int, int]:
        """Following bytes of a lead byte, and what the first of them may be."""
        if 0xC2 <= lead <= 0xDF:
            return 1, 0x80, 0xBF
        if 0xE0 <= lead <= 0xEF:
            return 2, 0xA0 if lead == 0xE0 else 0x80, 0x9F if lead == 0xED else 0xBF
        if 0xF0 <= lead <= 0xF4:
            return 3, 0x90 if lead == 0xF0 else 0x80, 0x8F if lead == 0xF4 else 0xBF
        return 0, 1, 0

    def _unfinished(self, data: bytes) -> int:
        """How many bytes at the end are the sound beginning of a character."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 != 0x80:
                more, low, high = self._room(lead)
                return back if more >= back and (back == 1 or low <= data[1 - back] <= high) else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        keep = self._unfinished(data)
        self.held = data[len(data) - keep :]
        data = data[: len(data) - keep]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return self._slowly(data)

    def _slowly(self, data: bytes) -> str:
        out, at = [], 0
        while at < len(data):
            lead = data[at]
            if lead < 0x80:
                out.append(chr(lead))
                at += 1
                continue
            more, low, high = self._room(lead)
            end = at + 1
            while more and end < len(data) and end - at <= more and low <= data[end] <= high:
                low, high = 0x80, 0xBF
                end += 1
            out.append(data[at:end].decode() if more and end - at == more + 1 else "�")
            at = end
        return "".join(out)

    def close(self) -> str:
        left, self.held = self.held, b""
        return "�" if left else ""


def _encoder(path: str, pattern: str, bounds: tuple[int, int, int] | None) -> Encoder:
    """The encoder that this process keeps until an operator with tables of its own, or another encoder, is asked for."""
    tables = own_tables("bpe")
    key = (path, pattern, bounds)
    if key not in tables:
        tables.clear()
        tables[key] = Encoder(path, pattern, bounds)
    return tables[key]


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", bounds: tuple[int, int, int] | None = None) -> DataFrame:
    """Token ids of every whole text and the text decoded from them.

    Returns ``id_col`` (long), ``ids`` (binary: little-endian unsigned 32-bit)
    and ``decoded`` (string), a row for each row.  A null text counts as empty
    and gives empty ids; a null key stays null; repeated rows stay repeated; an
    empty table gives an empty table; other columns of docs are not read.
    ``bounds`` are the states, pairs and words that a process may keep; they
    change its memory and time, never the result.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern, bounds)
        for batch in batches:
            ids = [encoder.encode(t) for t in batch.column(1).to_pylist()]
            text = ["".join(encoder.decode(x)) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(text, pa.string())], ["id", "ids", "decoded"])

    out = id_and_text(docs, id_col, text_col).mapInArrow(run, "id long, ids binary, decoded string")
    return out.withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of what encode_decode returns."""
    return encoded.select(
        id_col,
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
