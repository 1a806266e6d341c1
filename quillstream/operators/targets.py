"""Rows chosen by content, each by a rule that must fit exactly one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import or_empty


def haystack(text: Column, links: Column) -> Column:
    """Lower-case text and links on one line each: what rules look into."""
    return F.struct(F.lower(or_empty(text)).alias("text"), F.lower(F.array_join(F.coalesce(links, F.array().cast("array<string>")), "\n")).alias("links"))


def exactly_one(rows: DataFrame, rules: dict[str, Column], id_col: str = "telegram_id") -> DataFrame:
    """The row of each rule, named in column ``rule``.

    One pass counts the rows of every rule; an error names the rules that fit no
    row or several, or rows that two rules fit.
    """
    named = F.array_compact(F.array(*[F.when(fits, F.lit(name)) for name, fits in rules.items()]))
    marked = rows.withColumn("__rules", named).where(F.size("__rules") > 0)
    facts = marked.agg(*[F.count_if(F.array_contains("__rules", name)).alias(f"n{k}") for k, name in enumerate(rules)], F.count_if(F.size("__rules") > 1).alias("shared")).first()
    wrong = {name: facts[f"n{k}"] for k, name in enumerate(rules) if facts[f"n{k}"] != 1}
    if wrong:
        raise ValueError(f"rules that don't fit exactly one row: {wrong}")
    if facts["shared"]:
        raise ValueError("two rules fit the same row")
    return marked.withColumn("rule", F.element_at("__rules", 1)).drop("__rules")
