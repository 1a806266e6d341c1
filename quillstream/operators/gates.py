"""Evidence and fidelity gates: reasons as columns, the first one deciding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..functions import tokens as K
from ..functions.times import hours


def has_public_source(source_url: Column, evidence_urls: Column) -> Column:
    """A link of its own, or one among the evidence."""
    filled = lambda u: X.strip(X.or_empty(u)) != ""
    return filled(source_url) | F.coalesce(F.exists(evidence_urls, filled), F.lit(False))


def evidence_reason(text: Column, sourced: Column) -> Column:
    """Why a text needs a public source that it lacks; empty if it doesn't."""
    return (
        F.when(sourced, "")
        .when(text.rlike(P.SENSITIVE_CLAIM), "sensitive_claim_without_source")
        .when(text.rlike(P.COMPETITION) & text.rlike(P.COMPETITION_RESULT), "competition_result_without_source")
        .when(text.rlike(P.INTRUSION) & text.rlike(P.DISPUTE), "disputed_intrusion_without_source")
        .when(text.rlike(P.LOW_INFORMATION), "unsupported_low_information_claim")
        .otherwise("")
    )


def date_reason(published: Column, now: Column, max_age_hours: float = P.MAX_AGE_HOURS) -> Column:
    """Why a source date keeps an item back; empty if it doesn't."""
    return (
        F.when(published.isNull() | (published > now + hours(P.CLOCK_SLACK_MINUTES / 60)), "unverified_source_date")
        .when(now > published + hours(max_age_hours), "stale_source")
        .otherwise("")
    )


def cap_reason(last_day: Column, last_hour: Column, daily: int = P.DAILY_CAP, hourly: int = P.HOURLY_CAP) -> Column:
    return F.when(last_day >= daily, "rolling_daily_cap").when(last_hour >= hourly, "rolling_hourly_cap").otherwise("")


def first_reason(*reasons: Column) -> Column:
    """The first that isn't empty."""
    return F.coalesce(*[F.when(r != "", r) for r in reasons], F.lit(""))


def eligibility(language: Column, text: Column, sourced: Column, published: Column, now: Column, last_day: Column, last_hour: Column, wanted: str | None = "en") -> Column:
    """Language, evidence, date and caps in that order; empty: eligible."""
    other = F.when(X.or_empty(language) != wanted, "pending_english_rewrite").otherwise("") if wanted else F.lit("")
    return first_reason(other, evidence_reason(text, sourced), date_reason(published, now), cap_reason(last_day, last_hour))


def english_reason(text: Column) -> Column:
    """Why a text can't go out in English; empty if it can."""
    return F.when(~text.rlike(P.LATIN_LETTER) | text.rlike(P.OTHER_SCRIPTS), "not_english").when(text.rlike(P.BAIT), "engagement_bait").otherwise("")


def fidelity_rejects(source: Column, output: Column) -> Column:
    """All reasons to reject an output against its source, in the order they are looked for."""
    have, said = K.all_numbers(source), K.all_numbers(output)
    have_cve, said_cve = K.cves(source), K.cves(output)
    n, m = F.length(X.clean_source(source)), F.length(X.clean_source(output))
    some = lambda a, b: F.size(F.array_except(a, b)) > 0
    return F.array_compact(
        F.array(
            F.when(some(said, have), "numbers_invented"),
            F.when(some(have, said), "numbers_omitted"),
            F.when(some(said_cve, have_cve), "cves_invented"),
            F.when(some(have_cve, said_cve), "cves_omitted"),
            F.when((n >= 220) & (m < F.greatest(F.lit(110), F.floor(n * 0.38))), "too_short"),
            F.when((n >= 100) & (m > F.greatest(F.lit(900), F.floor(n * 2.5))), "too_long"),
        )
    )


def evidence_rejects(source: Column, evidence: Column, output: Column) -> Column:
    """The shorter list for outputs that had evidence besides their source; no length rules."""
    both = F.concat(X.or_empty(source), F.lit("\n"), X.or_empty(evidence))
    some = lambda a, b: F.size(F.array_except(a, b)) > 0
    return F.array_compact(
        F.array(
            F.when(some(K.all_numbers(output), K.all_numbers(both)), "numbers_beyond_evidence"),
            F.when(some(K.cves(output), K.cves(both)), "cves_beyond_evidence"),
            F.when(some(K.numbers(source), K.numbers(output)) | some(K.cves(source), K.cves(output)), "facts_omitted"),
        )
    )


def reader_rejects(title: Column, body: Column) -> Column:
    """Invented spellings anywhere, more than one piece of jargon in the title."""
    seen = F.concat_ws("\n", X.strip_marks(title), X.strip_marks(body))
    return F.array_compact(F.array(F.when(seen.rlike(P.TRANSLITERATION), "invented_transliteration"), F.when(F.regexp_count(X.strip_marks(title), F.lit(P.TITLE_JARGON)) > 1, "title_jargon")))
