"""Row stages: clean, normalise, enrich, validate, split, de-duplicate. All expressions but the shuffle of dedup."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import masking
from ..functions.scalars import LEVELS, agent_family, clean_text, endpoint_template, environment, fingerprint, fingerprint_fields, host_name, ip_class, present, repair_encoding, scrub, service_name, status_class, valid_ip
from ..schema import LIMITS, conform, is_error
from .parsers import fence, parse, settle

CLEANED = ("service", "hostname", "logger", "user_id", "request_id", "user_agent", "referrer")
INFERRED = "_inferred"  # beside the map, so that who only asks for validity doesn't wait for all its masked values
MASKED = ("message", "user_agent", "referrer", "endpoint", "user_id", "raw_message")


def events(parsed: DataFrame) -> DataFrame:
    """The event columns of lines that a parser understood."""
    return parsed.where("event IS NOT NULL").select("event.*", *[c for c in parsed.columns if c != "event"])


def clean(df: DataFrame, longest_message: int = 32768, repair: bool = True) -> DataFrame:
    fix = repair_encoding if repair else (lambda c: c)
    fixed = [c for c in (*CLEANED, "message") if c in df.columns]
    df = settle(df, **{c: fix(F.col(c)) for c in fixed}, endpoint=F.regexp_extract("endpoint", r"^[^?#]*", 0))
    df = settle(df, **{c: scrub(F.col(c), longest_message if c == "message" else LIMITS.get(c)) for c in (*fixed, "endpoint")})
    cols: dict[str, Column] = {c: present(F.col(c)) for c in (*fixed, "endpoint")}
    cols["message"] = F.coalesce(cols["message"], F.lit(""))
    cols["metadata"] = F.transform_values("metadata", lambda _, v: F.coalesce(clean_text(v, 4096), F.lit("")))
    cols[INFERRED] = F.coalesce(clean_text(F.col("metadata")["timestamp_inferred"], 4096) == "true", F.lit(False))
    return settle(df, **cols)


def _put(df: DataFrame, meta: Column, **items: Column) -> DataFrame:
    """df with metadata: meta with items that aren't null added (they win over equal keys).

    Both maps are columns first: inside a lambda the items would be evaluated again for every key.
    """
    new = F.map_filter(F.create_map(*[x for k, v in items.items() for x in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull())
    df = settle(df, _old=F.coalesce(meta, F.create_map().cast("map<string,string>")), _new=new)
    old = F.map_filter("_old", lambda k, _: ~F.array_contains(F.map_keys("_new"), k))
    return settle(df, metadata=F.map_concat(old, "_new")).drop("_old", "_new")


def normalise(df: DataFrame, default_service: str | None = None) -> DataFrame:
    df = settle(df, _template=endpoint_template(F.col("endpoint")), _family=agent_family(F.col("user_agent")), _class=ip_class(F.col("ip_address")))
    named = F.coalesce(service_name(F.col("service")), F.lit(default_service))
    template = F.col("_template")
    env = F.when(F.coalesce(F.col("environment"), F.lit("unknown")) != "unknown", F.col("environment")).otherwise(environment(F.col("hostname"), F.col("service"), F.col("source")))
    df = _put(df, F.col("metadata"), endpoint_raw=F.when(template != F.col("endpoint"), F.col("endpoint")), ua_family=F.col("_family"), ip_class=F.col("_class"))
    return settle(df, environment=env, service=named, hostname=host_name(F.col("hostname")), endpoint=template).drop("_template", "_family", "_class")


def enrich(df: DataFrame, rules: Sequence[str] = masking.DEFAULT_RULES, drop_raw: bool = False) -> DataFrame:
    df = settle(df, _secret=reduce(lambda a, b: a | b, [masking.contains_sensitive(F.col(c), rules) for c in ("message", "raw_message")]))
    hidden = masking.mask_map(F.coalesce("metadata", F.create_map().cast("map<string,string>")), rules)
    df = _put(df, hidden, status_class=status_class(F.col("status_code")), is_error=F.when(is_error(), F.lit("true")), masked=F.when(F.col("_secret"), F.lit("true"))).drop("_secret")
    cols = {c: masking.mask_text(F.col(c), rules) for c in MASKED}
    if drop_raw:
        cols["raw_message"] = F.lit(None).cast("string")
    return settle(df, **cols)


def transform(df: DataFrame, stages: Sequence[Callable[[DataFrame], DataFrame]] = (clean, normalise, enrich)) -> DataFrame:
    return reduce(lambda d, s: s(d), stages, df)


def validate(df: DataFrame, *, require_timestamp: bool = True, require_message: bool = True, longest: int = 32768, max_future_s: int = 300, max_age_days: int = 3650, levels: Sequence[str] = LEVELS, now: Column | None = None, extra: Sequence[tuple[str, Column]] = ()) -> DataFrame:
    """reject_reason (the first fatal one, or null) and warnings (array) for each row."""
    now = F.current_timestamp() if now is None else now
    ts, rt = F.col("timestamp"), F.col("response_time_ms")
    blank = F.length(F.trim(F.coalesce("message", F.lit("")))) == 0
    kept = F.col("metadata")["timestamp_inferred"] == "true" if dict(df.dtypes)["metadata"].startswith("map") else F.lit(False)
    inferred = F.col(INFERRED) if INFERRED in df.columns else F.coalesce(kept, F.lit(False))
    fatal = [
        ("missing_timestamp", F.lit(require_timestamp) & (ts.isNull() | inferred)),
        ("timestamp_out_of_range", (ts < F.lit("1990-01-01").cast("timestamp")) | (ts > F.lit("2100-01-01").cast("timestamp")) | (ts > now + F.make_interval(secs=F.lit(max_future_s)))),
        ("missing_message", F.lit(require_message) & blank),
        ("message_too_long", F.length("message") > longest),
        ("invalid_status_code", ~F.col("status_code").between(100, 599)),
        ("invalid_response_time", (rt < 0) | (rt > 86_400_000)),
        *extra,
    ]
    reason = reduce(lambda acc, x: acc.when(x[1], F.lit(x[0])), fatal[1:], F.when(fatal[0][1], F.lit(fatal[0][0])))
    soft = [
        ("timestamp_stale", ts < now - F.make_interval(days=F.lit(max_age_days))),
        ("missing_message", F.lit(not require_message) & blank),
        ("invalid_level", ~F.col("level").isin(*levels)),
        ("invalid_ip", F.col("ip_address").isNotNull() & valid_ip(F.col("ip_address")).isNull()),
        ("schema_violation", F.col("endpoint").isNotNull() & F.col("status_code").isNull() & F.col("http_method").isNull()),
    ]
    return fence(df.withColumns({"reject_reason": reason, "warnings": F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in soft]))}), "reject_reason")


def with_lost(parsed: DataFrame) -> DataFrame:
    """All lines with the columns of their event: null, but for ``_parsed`` and the line itself, where no parser took them."""
    return parsed.select(*[F.col("event")[n].alias(n) for n in parsed.schema["event"].dataType.names], F.col("event").isNotNull().alias("_parsed"), "value")


def rejected_lines(validated: DataFrame) -> DataFrame:
    """Dead letters of ``with_lost`` rows: lines no parser took and rows that validation rejected, masked; reason and stage."""
    lost = ~F.col("_parsed")
    blank = F.length(F.trim("value")) == 0
    bad = validated.where(lost | F.col("reject_reason").isNotNull())
    return bad.select(masking.mask_text(F.when(lost, F.col("value")).otherwise(F.col("raw_message"))).alias("raw"), F.when(lost, F.when(blank, "empty_line").otherwise("unparseable")).otherwise(F.col("reject_reason")).alias("reason"), F.when(lost, "parse").otherwise("validate").alias("stage"), F.current_timestamp().alias("rejected_at"))


KEYS: dict[str, Callable[[], Column]] = {
    "event_id": lambda: F.col("event_id"),
    "content_hash": lambda: F.when(F.length("message") > 0, fingerprint(F.col("message"))),
}


def with_duplicates(df: DataFrame, strategy: str = "event_id", fields: Sequence[str] = ("timestamp", "service", "level", "message"), order: Sequence[str] = ("timestamp", "event_id"), among: Column | None = None) -> DataFrame:
    """df with is_duplicate: every row of a key but the first by ``order``. Rows without a key, and those outside ``among``, are never duplicates.

    Keyless rows are dealt at random instead of into one task.
    """
    if strategy == "none":
        return df.withColumn("is_duplicate", F.lit(False))
    key = fingerprint_fields(list(fields)) if strategy == "fields" else KEYS[strategy]()
    known = df.withColumn("_key", key if among is None else F.when(among, key))
    salt = F.when(F.col("_key").isNull(), F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))).otherwise(F.col("_key"))
    ranked = known.withColumn("_salted", salt).withColumn("_r", F.row_number().over(Window.partitionBy("_salted").orderBy(*order)))
    return ranked.withColumn("is_duplicate", F.col("_key").isNotNull() & (F.col("_r") > 1)).drop("_key", "_salted", "_r")


def deduplicate(df: DataFrame, strategy: str = "event_id", **options) -> DataFrame:
    return with_duplicates(df, strategy, **options).where("NOT is_duplicate").drop("is_duplicate")


def stored(df: DataFrame, *more: str) -> DataFrame:
    """The stored columns; the metadata map as JSON text. ``more`` columns stay beside them."""
    out = df.withColumn("ingested_at", F.current_timestamp())
    if dict(df.dtypes)["metadata"].startswith("map"):
        out = out.withColumn("metadata", F.when(F.size("metadata") > 0, F.to_json("metadata")))
    return conform(out, *more)


class Rejections(RuntimeError):
    """Too many rejected rows; nothing was published."""


def ingest(lines: DataFrame, parser="plaintext", *, dedup: str = "event_id", source: str = "unknown", default_service: str | None = None, most_rejected: float = 0.5, limit: int | None = None, check: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good rows, dead letters) of text lines through every stage, as one lazy plan each; ``routing.ingest_to`` writes both in one pass."""
    if limit is not None:
        lines = lines.limit(limit)  # before lines are dealt: both plans take the same ones
    parsed = parse(lines, parser, source=source)
    steps = (clean, lambda d: normalise(d, default_service), enrich)
    good = stored(deduplicate(validate(transform(events(parsed), steps)).where("reject_reason IS NULL"), dedup))
    dead = rejected_lines(validate(transform(with_lost(parsed), steps)))  # one pass over the lines for both kinds
    if check:
        n = parsed.agg(F.count("*").alias("n")).first()["n"]
        bad = dead.agg(F.count("*").alias("n")).first()["n"]
        if n and bad / n > most_rejected:
            raise Rejections(f"{bad} of {n} lines rejected")
    return good, dead
