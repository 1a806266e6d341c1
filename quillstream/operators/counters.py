"""Counters of a run, taken while its tables are written: no second job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def observed(table: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, Observation]:
    """The table, and what its rows add up to: ``rows``, ``last_id`` (largest telegram_id, where there is one) and further aggregates.

    The numbers are there (``Observation.get``) after the first action on the
    returned table, and count what that action read; a table without rows has 0
    rows and no last_id.
    """
    more = {"last_id": F.max("telegram_id")} if "telegram_id" in table.columns else {}
    seen = Observation(name)
    every = {"rows": F.count(F.lit(1)), **more, **counters}
    return table.observe(seen, *[c.alias(k) for k, c in every.items()]), seen


def observed_run(tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, Observation]]:
    """All tables of a run with their counters, by name."""
    both = {name: observed(df, name) for name, df in tables.items()}
    return {k: v[0] for k, v in both.items()}, {k: v[1] for k, v in both.items()}


def processed_so_far(log: DataFrame, batch_col: str, id_col: str = "telegram_id") -> DataFrame:
    """Per batch its rows and largest id, and the rows and largest id of it and all earlier ones.

    Each batch is one row before the running sums, which pass through one task.
    """
    from pyspark.sql import Window

    each = log.groupBy(batch_col).agg(F.count("*").alias("rows"), F.max(id_col).alias("last_id"))
    so_far = Window.orderBy(batch_col).rowsBetween(Window.unboundedPreceding, 0)
    return each.select(batch_col, "rows", "last_id", F.sum("rows").over(so_far).alias("total"), F.max("last_id").over(so_far).alias("largest_id"))
