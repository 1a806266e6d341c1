"""Token counts by a whole-token shortcut.

No piece of the vocabulary holds the blank mark after another character, so no
merge crosses the start of a run of blanks and a text's count is the sum over
its words.  A word whose marked form is proven, once for the vocabulary, to
encode alone as one token counts 1 without merging; only other words are merged.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import id_and_text, small_batches

MARK = "▁"
#: Words that one process remembers before it starts afresh.
MAX_WORDS = 600_000


class _Irregular(Exception):
    """Runs of blanks, or the mark itself, in a text."""


class Counter(dict):
    """Words that follow one blank, to their number of tokens; filled on demand."""

    def __init__(self, path: str):
        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.single = self._prove()
        self.update(dict.fromkeys(self.single, 1))
        self.runs = re.compile(f"{MARK}+[^{MARK}]*")

    def _prove(self) -> set[str]:
        """The words that alone are one token; raises if words can't be counted by themselves."""
        model, words = self.model, set()
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("a piece crosses a blank: words can't be counted by themselves")
        if model.encode(" x") != model.encode(f"{MARK}x") or model.encode("x", out_type=str)[0][:1] != MARK:
            raise ValueError("the model drops blanks or adds no blank before a text")
        plain = [i for i in range(len(self.pieces)) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        marked = [(i, self.pieces[i][1:]) for i in plain if self.pieces[i].startswith(MARK) and self.pieces[i].strip(MARK)]
        for (i, word), ids in zip(marked, model.encode([w for _, w in marked], num_threads=1)):
            if ids == [i]:
                words.add(word)
        return words

    def __missing__(self, word: str) -> int:
        if not word or MARK in word:
            raise _Irregular
        n = len(self.model.encode(word))
        if len(self) >= MAX_WORDS:
            self.clear()
            self.update(dict.fromkeys(self.single, 1))
        if len(word) < 64:
            self[word] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        try:
            return sum(map(self.__getitem__, text.split(" ")))
        except _Irregular:
            total = 0
            for run in self.runs.findall(MARK + text.replace(" ", MARK)):
                total += self[run[1:]] if run.count(MARK) == 1 and len(run) > 1 else len(self.model.encode(run[1:])) if len(run) > 1 else 1
            return total


@lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every whole text, and whether there are more than limit.

    Returns ``id_col``, ``n_bytes``, ``n_tokens`` and ``over_limit``, a row for
    each row.  A null text counts as empty (0 bytes, 0 tokens); a null key stays
    null; repeated rows stay repeated; an empty table gives an empty table;
    other columns are not read.  ``path`` is a sentencepiece model.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["id", "n_bytes", "n_tokens", "over_limit"],
            )

    out = id_and_text(docs, id_col, text_col).mapInArrow(run, "id long, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
