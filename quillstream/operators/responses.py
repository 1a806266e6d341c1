"""What a site's answers to deliveries mean: sent, failed with its reason, or a cooldown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import iso, retry_at

#: The status that asks for a pause, and the first that is an error.
RATE_LIMITED, FIRST_ERROR = 429, 400


def judged(answers: DataFrame, now: Column, status: str = "status", retry_after: str = "retry_after", body: str = "body") -> DataFrame:
    """Adds ``outcome`` (sent, cooldown or failed), ``error`` (null if sent) and ``retry_at`` (cooldowns only).

    A rate limit is a cooldown whatever its body.  Other answers are failed if
    the body isn't JSON (null and empty included), if the status is an error (or
    null), or if the body is an object with a member ``error``, even a null one;
    the error then has the site's message, else the status, and both codes.
    """
    code, text = F.col(status), F.col(body)
    field = lambda name: F.get_json_object(text, f"$.error.{name}")
    known = F.try_parse_json(text).isNotNull()
    named = F.coalesce(F.array_contains(F.json_object_keys(text), "error"), F.lit(False))
    shown = F.coalesce(code.cast("string"), F.lit("None"))
    message = F.concat(
        F.coalesce(F.when(field("message") != "", field("message")), shown),
        F.lit(" (code="), F.coalesce(field("code"), F.lit("None")), F.lit(", subcode="), F.coalesce(field("error_subcode"), F.lit("None")), F.lit(")"),
    )
    limited = F.coalesce(code == RATE_LIMITED, F.lit(False))
    error = (
        F.when(limited, "rate limited").when(~known | text.isNull(), F.concat(F.lit("no JSON in answer "), shown))
        .when(code.isNull() | (code >= FIRST_ERROR) | named, message)
    )
    return answers.withColumns({
        "outcome": F.when(limited, "cooldown").when(error.isNotNull(), "failed").otherwise("sent"),
        "error": error,
        "retry_at": F.when(limited, retry_at(now, F.coalesce(F.col(retry_after), F.lit("")))),
    })


def cooldown_events(judged_answers: DataFrame, now: Column) -> DataFrame:
    """Log lines of the pauses asked for, as ``events.cooling_until`` reads them."""
    return judged_answers.where("outcome = 'cooldown'").select(F.lit("meta_cooldown").alias("event"), iso(F.col("retry_at")).alias("retry_at"), iso(now).alias("recorded_at"))
