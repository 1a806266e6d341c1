"""From collected rows to ready rows, and from generated answers to their checked form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import media as M
from ..functions import patterns as P
from ..functions import text as X
from ..functions import tokens as K
from ..functions import urls as U
from . import gates


def normal_item(df: DataFrame) -> DataFrame:
    """Adds text (without source notes), source_note and has_explicit_title; nulls become empty or false."""
    raw = X.first_filled(*[F.col(c) for c in ("clean_text", "text", "raw_text") if c in df.columns])
    lists = {c: F.coalesce(c, F.array().cast(df.schema[c].dataType)) for c in ("source_links", "reply_context") if c in df.columns}
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("has_image", "has_video", "has_document") if c in df.columns}
    out = df.withColumns(lists | flags | {"source_note": X.source_note(raw), "text": X.without_source_note(raw)})
    return out.withColumn("has_explicit_title", F.col("text").rlike(P.TITLE_SIGNAL))


def status_without_answer(text: Column, has_image: Column, has_video: Column) -> Column:
    """An item without text waits for an editor if it has a picture or film, else it can't be used; null: it has text."""
    empty = X.strip(X.or_empty(text)) == ""
    return F.when(empty & (has_image | has_video), "needs_editorial_context").when(empty, "unsupported_media")


def media_struct(df: DataFrame) -> Column:
    """The media part of a ready row, single links taken where there is no list."""
    flag = lambda c: F.coalesce(c, F.lit(False))
    many = lambda several, one: F.when(F.size(F.coalesce(several, F.array().cast("array<string>"))) > 0, F.col(several)).when(F.col(one).isNotNull(), F.array(one)).otherwise(F.array().cast("array<string>"))
    kind = M.media_kind(F.lit(False), flag("has_video"), flag("has_document"))
    kind = F.when(~flag("has_video") & flag("has_image"), "image").otherwise(kind)
    return F.struct(
        flag("has_image").alias("has_image"), "image_url", many("image_urls", "image_url").alias("image_urls"),
        flag("has_video").alias("has_video"), "video_url", many("video_urls", "video_url").alias("video_urls"),
        F.coalesce("video_thumbnail_urls", F.array().cast("array<string>")).alias("video_thumbnail_urls"), flag("has_document").alias("has_document"),
        X.first_filled(F.col("media_type"), kind).alias("media_type"), X.or_empty(F.col("telegram_post_url")).alias("telegram_post_url"),
    )


def model_input(df: DataFrame) -> Column:
    """What a generator is shown, as JSON: links only as host and role."""
    return F.to_json(
        F.struct(
            "telegram_id", "published_at", X.strip(F.regexp_replace("text", P.URL, "")).alias("text"), U.link_hints(F.col("source_links")).alias("link_hints"),
            "source_note", "has_explicit_title",
            F.transform("reply_context", lambda r: F.struct(r["telegram_id"].alias("telegram_id"), X.strip(F.regexp_replace(r["text"], P.URL, "")).alias("text"))).alias("reply_context"),
            F.struct("has_image", "has_video", "has_document").alias("media"),
        )
    )


def answer_text(response: Column, schema: str = "candidates array<struct<content:struct<parts:array<struct<text:string>>>>>") -> Column:
    """The non-empty text parts of the first candidate in a provider's reply, joined by newlines."""
    first = F.get(F.from_json(response, schema)["candidates"], F.lit(0))
    return F.array_join(F.filter(F.transform(first["content"]["parts"], lambda p: X.or_empty(p["text"])), lambda t: t != ""), "\n")


def parse_answer(text: Column) -> Column:
    """A generated answer as struct ``data`` (null if a field is missing or it is no object) and ``problem``.

    The whole text is tried, else what lies between its outermost braces.
    Lists are stripped and lose empty elements; single values become lists.
    """
    whole = X.strip(X.or_empty(text))
    inner = F.regexp_extract(whole, r"(?s)\{.*\}", 0)
    parsed = F.coalesce(F.try_parse_json(whole), F.try_parse_json(inner))
    get = lambda name, kind: F.try_variant_get(parsed, f"$.{name}", kind)

    def array(name: str) -> Column:
        many, one = get(name, "array<string>"), get(name, "string")
        values = F.coalesce(many, F.when(X.or_empty(one) != "", F.array(one)).otherwise(F.array().cast("array<string>")))
        return F.filter(F.transform(values, lambda v: X.strip(X.or_empty(v))), lambda v: v != "")

    fields = [*[X.or_empty(get(n, "string")).alias(n) for n in schemas.ANSWER_TEXTS], *[array(n).alias(n) for n in schemas.ANSWER_ARRAYS]]
    keys = F.coalesce(F.try_variant_get(parsed, "$", "map<string,variant>"), F.lit(None).cast("map<string,variant>"))
    missing = F.array_except(F.array(*[F.lit(n) for n in sorted(schemas.ANSWER_TEXTS + schemas.ANSWER_ARRAYS)]), F.map_keys(keys))
    problem = F.when(parsed.isNull(), "not_json").when(keys.isNull(), "not_an_object").when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
    return F.struct(F.when(problem.isNull(), F.struct(*fields)).alias("data"), problem.alias("problem"))


def first_valid(completions: DataFrame, id_col: str = "telegram_id") -> DataFrame:
    """Per item the answer of the earliest attempt that parses; expects ``answer`` from parse_answer, attempt and model."""
    ok = completions.where(F.col("answer.data").isNotNull())
    return ok.groupBy(id_col).agg(F.min_by(F.struct("model", "answer"), "attempt").alias("first")).select(id_col, "first.model", F.col("first.answer.data").alias("data"))


def first_comment(role: Column, note: Column, url: Column) -> Column:
    """The comment that carries the source: label, note and link, whatever there is."""
    label = F.lit("Source")
    for name, value in P.LINK_LABELS.items():
        label = F.when(role == name, value).otherwise(label)
    note, url = X.or_empty(note), X.or_empty(url)
    return F.when((note != "") & (url != ""), F.concat(label, F.lit(": "), note, F.lit("\n"), url)).when(note != "", F.concat(label, F.lit(": "), note)).when(url != "", F.concat(label, F.lit(": "), url)).otherwise("")


def enforce_policy(df: DataFrame, forbidden: tuple[str, ...] = (), generic_ending: str = r"(?!)") -> DataFrame:
    """Checked form of generated answers, with all ``reject_reasons`` in the order they are looked for.

    Expects data (parse_answer), source_links, text (the source's) and
    primary_evidence; a row is publishable if the reasons are empty.
    """
    d = lambda n: F.col(f"data.{n}")
    url = U.first_link(F.col("source_links"))
    role = X.strip(d("link_role"))
    role = F.when(role.isin(*P.LINK_ROLES), role).when(url != "", "source").otherwise("none")
    signal = X.attention(F.col("text"), X.strip(d("attention_label")), d("attention_evidence"))
    body = d("facebook_post")
    for fragment in forbidden:
        body = F.regexp_replace(body, r"(?i)\Q" + fragment + r"\E", "")
    body = F.aggregate(F.coalesce("source_links", F.array().cast("array<string>")), body, lambda acc, u: F.when(X.or_empty(u) == "", acc).otherwise(F.replace(acc, X.or_empty(u), F.lit(""))))
    body = X.unwrap_latin_parentheses(X.clean_owned_tokens(body))
    out = df.withColumn("__body", X.strip_generic_ending(X.reading_layout(body), generic_ending))
    source = F.lower(X.clean_source(F.col("text")))
    entities = F.slice(F.filter(d("protected_entities"), lambda e: F.contains(source, F.lower(e))), 1, 30)
    evidence = F.array_join(F.transform(F.coalesce("primary_evidence", F.array().cast(df.schema["primary_evidence"].dataType)), lambda e: X.or_empty(e["text"])), "\n")
    has_evidence = F.size(F.coalesce("primary_evidence", F.array().cast(df.schema["primary_evidence"].dataType))) > 0
    sure = X.certainty(F.col("text"), X.strip(d("certainty")))
    title = X.collapse(X.unwrap_latin_parentheses(d("card_title")))
    out = out.withColumns({
        "source_url": F.when(has_evidence, F.get("primary_evidence", F.lit(0))["url"]).otherwise(url),
        "link_role": F.when(url == "", "none").otherwise(role),
        "first_comment": F.when(has_evidence, F.concat(F.lit("Sources: "), F.array_join(F.transform("primary_evidence", lambda e: e["url"]), "\n"))).otherwise(first_comment(role, F.lit(""), url)),
        "content_type": F.when(X.strip(d("content_type")).isin(*P.CONTENT_TYPES), X.strip(d("content_type"))).otherwise("general"),
        "attention": signal,
        "certainty": F.when(~has_evidence & (sure == "confirmed"), "reported").otherwise(sure),
        "main_fact": F.left(X.collapse(d("main_fact")), F.lit(600)),
        "supporting_facts": F.slice(F.transform(d("supporting_facts"), lambda f: F.left(X.collapse(f), F.lit(600))), 1, 12),
        "protected_entities": entities,
        "protected_numbers": F.array_sort(K.numbers(F.col("text"))),
        "card_title": title,
    })
    post = F.col("__body")
    english = gates.english_reason(post)
    reasons = F.concat(
        F.array_compact(F.array(F.when(d("language") != "en", "language_not_declared"), F.when(post == "", "no_visible_text"), F.when(english != "", english))),
        F.when(has_evidence, gates.evidence_rejects(F.col("text"), evidence, post)).otherwise(gates.fidelity_rejects(F.col("text"), post)),
        F.array_compact(F.array(
            F.when(F.size(K.missing_entities(F.col("protected_entities"), post)) > 0, "entities_changed"),
            F.when(F.size(F.filter(F.split(F.col("card_title"), " "), lambda w: w != "")) > 11, "card_title_too_long"),
            F.when(~has_evidence & (sure == "confirmed") & ~post.rlike(P.ATTRIBUTION_VERB), "no_attribution"),
        )),
    )
    return out.withColumn("facebook_post", post).withColumn("reject_reasons", reasons).drop("__body")
