"""Lines of even width, for words whose widths are known."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A last line under this share of the mean width costs so much for each unit that it lacks.
SHORT_LAST, SHORT_COST = 0.58, 1.7

_BEST = "array<struct<score:double,cuts:array<int>>>"


def balanced_cuts(widths: Column, lines: int, max_width: float, gap: float = 1.0) -> Column:
    """Where to cut words into so many lines: the numbers of words before each cut, null if no line-up fits.

    A line is as wide as its words and the gaps between them.  The best line-up
    has the least sum of distances from the mean width, and a last line that
    isn't short; of equally good ones the one with the earliest cuts counts.
    Since widths add up, the mean is the same for all line-ups, so the best
    ends of k lines follow from those of k - 1: the work grows with the square
    of the number of words.  Null or too few words give null.
    """
    w = F.transform(widths, lambda x: x.cast("double"))
    n = F.size(w)
    ends = F.transform(F.sequence(F.lit(0), n), lambda j: F.aggregate(F.slice(w, F.lit(1), j), F.lit(0.0), lambda a, x: a + x))
    whole = F.named_struct(F.lit("ends"), ends, F.lit("mean"), (F.element_at(ends, -1) + (n - lines) * gap) / lines)

    def search(s: Column) -> Column:
        ends, mean = s["ends"], s["mean"]

        def longer(best: Column, k: Column) -> Column:
            def ending(end: Column, j: Column) -> Column:
                def after(b: Column, i: Column) -> Column:
                    width = end - F.get(ends, i) + (j - i - 1) * gap
                    short = F.when(k == lines, F.greatest(F.lit(0.0), mean * SHORT_LAST - width) * SHORT_COST).otherwise(0.0)
                    cuts = F.when(k == 1, b["cuts"]).otherwise(F.concat(b["cuts"], F.array(i.cast("int"))))
                    return F.when(b.isNotNull() & (i < j) & (width <= max_width), F.struct((b["score"] + F.abs(width - mean) + short).alias("score"), cuts.alias("cuts")))

                return F.array_min(F.transform(best, after))

            return F.transform(ends, ending).cast(_BEST)

        none = F.transform(ends, lambda _, j: F.when(j == 0, F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("cuts")))).cast(_BEST)
        return F.element_at(F.aggregate(F.sequence(F.lit(1), F.lit(lines)), none, longer), -1)["cuts"]

    return F.when(n >= lines, F.get(F.transform(F.array(whole), search), 0))


def balanced_lines(words: Column, widths: Column, lines: int, max_width: float, gap: float = 1.0) -> Column:
    """The lines of balanced_cuts, words joined by one space."""
    cuts = balanced_cuts(widths, lines, max_width, gap)
    bounds = F.concat(F.array(F.lit(0)), cuts, F.array(F.size(words)))
    return F.get(F.transform(F.array(bounds), lambda b: F.transform(F.slice(b, F.lit(2), F.lit(lines)), lambda end, k: F.array_join(F.slice(words, F.get(b, k) + 1, end - F.get(b, k)), " "))), 0)
