"""The first valid answer in an order of providers, with one repair where the reason of a failure calls for it.

Calls are made outside: attempts and repairs come in as tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Reject reasons that earn a second look with a hint, by kind of repair.
REPAIRS = {
    "fidelity": ("entities_changed", "numbers_omitted", "cves_omitted", "too_short", "facts_omitted"),
    "reader": ("invented_transliteration", "title_jargon", "card_title_jargon", "attack_not_reported"),
}

_CHOSEN = "struct<place:bigint,repair:string,failures:bigint,errors:array<string>>"


def repair_kind(error: Column, repairs: dict[str, tuple[str, ...]] = REPAIRS) -> Column:
    """Which second look an error calls for, the first kind that it names; empty: none."""
    kind = F.lit("")
    for name, reasons in reversed(repairs.items()):
        kind = F.when(F.coalesce(error, F.lit("")).rlike("|".join(rf"\Q{r}\E" for r in reasons)), name).otherwise(kind)
    return kind


def repairs_wanted(attempts: DataFrame, id_col: str = "telegram_id", repairs: dict[str, tuple[str, ...]] = REPAIRS) -> DataFrame:
    """Attempts to repeat with their error as a hint: those whose error calls for it and that no valid answer stands before."""
    valid = F.coalesce("error", F.lit("")) == ""
    first = attempts.where(valid).groupBy(id_col).agg(F.min("place").alias("__first"))
    wanted = attempts.where(~valid).withColumn("repair", repair_kind(F.col("error"), repairs)).where("repair <> ''").join(first, id_col, "left")
    return wanted.where(F.col("__first").isNull() | (F.col("place") < F.col("__first"))).select(id_col, "place", "model", "repair", F.col("error").alias("hint"))


def choose_answers(attempts: DataFrame, repairs: DataFrame, id_col: str = "telegram_id", kinds: dict[str, tuple[str, ...]] = REPAIRS) -> DataFrame:
    """Per item the first answer that is valid, at once or after its repair.

    ``attempts`` has place (the provider's number), model, error (empty or null:
    valid) and data, one row for an item and a place; ``repairs`` place, error
    and data.  A repair counts only where the attempt's error calls for one.
    Returns model, data, repair (its kind, empty if none was needed), failures
    (attempts that failed before) and, where every attempt failed, errors in
    order and a null model.  Providers are few, so an item's attempts fit a row;
    the answers themselves are joined to the chosen place afterwards.
    """
    second = repairs.select(id_col, "place", F.coalesce("error", F.lit("")).alias("second"), F.lit(True).alias("tried"))
    tries = attempts.select(id_col, "place", "model", F.coalesce("error", F.lit("")).alias("error")).join(second, [id_col, "place"], "left")
    tries = tries.withColumn("kind", F.when(F.col("tried"), repair_kind(F.col("error"), kinds)).otherwise(""))
    listed = tries.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("place", "model", "error", "kind", "second"))).alias("tries"))

    def step(acc: Column, t: Column) -> Column:
        mended = (t["kind"] != "") & (t["second"] == "")
        said = F.concat(t["model"], F.lit(": "), t["error"], F.when(t["kind"] != "", F.concat(F.lit(" | repair: "), t["second"])).otherwise(""))
        won = F.struct(t["place"].cast("long").alias("place"), F.when(t["error"] == "", "").otherwise(t["kind"]).alias("repair"), acc["failures"].alias("failures"), acc["errors"].alias("errors"))
        lost = F.struct(F.lit(None).cast("long").alias("place"), F.lit("").alias("repair"), (acc["failures"] + 1).alias("failures"), F.concat(acc["errors"], F.array(said)).alias("errors"))
        return F.when(acc["place"].isNotNull(), acc).when((t["error"] == "") | mended, won).otherwise(lost)

    start = F.struct(F.lit(None).cast("long").alias("place"), F.lit("").alias("repair"), F.lit(0).cast("long").alias("failures"), F.array().cast("array<string>").alias("errors")).cast(_CHOSEN)
    chosen = listed.select(id_col, F.aggregate("tries", start, step).alias("c")).select(id_col, "c.place", "c.repair", "c.failures", F.when(F.col("c.place").isNull(), F.col("c.errors")).alias("errors"))
    answers = attempts.select(id_col, "place", "model", "data").join(repairs.select(id_col, "place", F.col("data").alias("__mended")), [id_col, "place"], "left")
    answers = answers.select(id_col, F.col("place").cast("long").alias("place"), "model", "data", "__mended")
    out = chosen.join(answers, [id_col, "place"], "left")
    return out.select(id_col, "model", F.when(F.col("repair") == "", F.col("data")).otherwise(F.col("__mended")).alias("data"), "repair", "failures", "errors")
