"""Policies from JSON files: timing and language, and re-use rights of videos.

A policy is one small object, read once and passed on as plain values.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..operators.rights import RULE


class PolicyError(ValueError):
    """A policy file that holds no JSON object."""


def read_object(spark: SparkSession, path: str) -> dict | None:
    """The JSON object in a file, by Spark's reader; None if there is no such file."""
    try:
        text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    except AnalysisException:
        return None
    try:
        found = json.loads(text)
    except json.JSONDecodeError as fault:
        raise PolicyError(path) from fault
    if not isinstance(found, dict):
        raise PolicyError(path)
    return found


@dataclass(frozen=True)
class Timing:
    """What the gates and the queue need of a timing policy."""

    english: bool = False
    minimum_gap_minutes: float = 30.0
    per_hour: int = 2
    per_day: int = 12
    source_age_hours: float = 24.0


def read_timing(spark: SparkSession, path: str, strict: bool = False) -> Timing:
    """The timing policy; what is missing or no number keeps its default, and so does all of a file that can't be read unless strict."""
    try:
        found = read_object(spark, path)
    except PolicyError:
        if strict:
            raise
        found = None
    if found is None:
        return Timing()
    part = lambda name: found.get(name) if isinstance(found.get(name), dict) else {}
    limits = part("publishing_policy")

    def number(name: str, default: float) -> float:
        value = limits.get(name)
        return value if isinstance(value, (int, float)) and not isinstance(value, bool) and value >= 0 else default

    return Timing(
        part("language").get("primary") == "en", float(number("minimum_gap_minutes", Timing.minimum_gap_minutes)), int(number("max_posts_rolling_hour", Timing.per_hour)),
        int(number("max_posts_rolling_24h", Timing.per_day)), float(number("max_source_age_hours", Timing.source_age_hours)),
    )


def read_rights(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, str]:
    """(overrides by item, rules by channel, default status) for rights.video_rights; no file gives no rules and status unknown."""
    found = read_object(spark, path) or {}
    text = lambda v: None if v is None else str(v)

    def table(rules: object, key: str) -> DataFrame:
        rows = [(str(name), *[(bool(rule.get(c)) if c == "reupload_allowed" else text(rule.get(c))) for c in RULE]) for name, rule in (rules if isinstance(rules, dict) else {}).items() if isinstance(rule, dict)]
        return spark.createDataFrame(rows, f"{key} string, " + ", ".join(f"{c} {'boolean' if c == 'reupload_allowed' else 'string'}" for c in RULE))

    return table(found.get("post_overrides"), "item"), table(found.get("channel_policies"), "channel"), str(found.get("default_status") or "unknown")


def distinct_names(several: str | None, one: str | None, defaults: list[str]) -> list[str]:
    """Names of a comma-separated setting, of a single one, and the defaults: each once, in that order."""
    every = [*(several or "").split(","), one or "", *defaults]
    return list(dict.fromkeys(name.strip() for name in every if name.strip()))
