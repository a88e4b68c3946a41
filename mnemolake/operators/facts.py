"""Versioned facts derived from a log of remember and forget events.

Nothing is updated in place: the log is append-only, and versions, current
facts, history and rejects are views of it. Within a key, events are ordered by
(ts, id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SOURCE_IMPORTANCE, Settings
from ..functions.guards import REASONS, rejection
from ..functions.text import normalize_key, strip
from .ordered import HOT_ROWS, bucket_if_hot, with_neighbour, with_running_sum

_KEY = ["key"]
_ORDER = ["ts", "id"]


def _bucket(hot_rows: int = HOT_ROWS) -> list[Column]:
    """Spans of time, from days to single times with a range of ids: none decreases along (ts, id)."""
    return [*(F.date_trunc(unit, F.col("ts")) for unit in ("day", "hour", "minute")), F.struct("ts", F.floor(F.col("id") / max(1, hot_rows)).alias("ids"))]


def days_between(later: Column, earlier: Column) -> Column:
    """Days, not below 0; 0 where `earlier` is null."""
    gap = later.cast("timestamp_ntz") - earlier.cast("timestamp_ntz")
    day, hour, minute, second = (F.extract(F.lit(u), gap).cast("double") for u in ("DAY", "HOUR", "MINUTE", "SECOND"))
    return F.coalesce(F.greatest(F.lit(0.0), day + hour / 24 + minute / 1440 + second / 86400), F.lit(0.0))


def importance_of(source: Column) -> Column:
    out = F.lit(0.5)
    for name, weight in SOURCE_IMPORTANCE.items():
        out = F.when(source == name, weight).otherwise(out)
    return out


def checked_events(events: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Each event once, with its normalised key, stripped value and reason of rejection.

    An event that was delivered twice (same id) counts once; events without a
    time are left out. Forget events need only a key.
    """
    once = events.filter("ts is not null and id is not null").dropDuplicates(["id"])
    reason = rejection(F.col("key"), F.col("value"), F.col("source"), reserved=tuple(settings.reserved_keys), markers=tuple(settings.self_reference_markers))
    forget = F.col("op") == "forget"
    key = normalize_key(F.col("key"))
    reason = F.when(forget, F.when(F.coalesce(key, F.lit("")) == "", REASONS["empty"])).otherwise(reason)
    return once.select("id", F.col("key").alias("raw_key"), F.col("value").alias("raw_value"), key.alias("key"), strip(F.col("value")).alias("value"), "source", "ts", forget.alias("forget"), reason.alias("reason"))


def _resolved(events: DataFrame, settings: Settings, hot_rows: int) -> tuple[DataFrame, DataFrame, Column | None]:
    """(valid remember events with epoch, short, same and version; forget events with epoch; the bucket of hot keys).

    An epoch ends with each forget event. `short` events are kept out; `same`
    events repeat the value of the version before them, whose number they have.
    """
    valid = checked_events(events, settings).filter("reason is null")
    bucket = bucket_if_hot(valid, _KEY, _bucket(hot_rows), hot_rows)
    epochs = with_running_sum(valid, _KEY, _ORDER, bucket, F.col("forget").cast("int"), "epoch")
    forgets = epochs.filter("forget").select("key", "epoch", F.col("ts").alias("forgotten_at"))
    said = with_neighbour(epochs.filter("not forget"), _KEY, _ORDER, bucket, {"epoch": "prev_epoch"})
    first = F.coalesce(F.col("prev_epoch") != F.col("epoch"), F.lit(True))
    said = said.withColumn("short", ~first & (F.col("source") == "auto") & (F.char_length("value") < 2))
    kept = with_neighbour(said.filter("not short"), _KEY, _ORDER, bucket, {"epoch": "last_epoch", "value": "last_value"})
    same = F.coalesce((F.col("last_epoch") == F.col("epoch")) & (F.col("last_value") == F.col("value")), F.lit(False))
    kept = kept.withColumn("same", same).drop("last_epoch", "last_value")
    numbered = with_running_sum(kept, _KEY, _ORDER, bucket, (~F.col("same")).cast("int"), "before")
    numbered = numbered.withColumn("version", F.col("before") + (~F.col("same")).cast("int"))
    short = said.filter("short").withColumn("same", F.lit(False)).withColumn("version", F.lit(None).cast("bigint"))
    return numbered.drop("before").unionByName(short), forgets, bucket


def fact_versions(events: DataFrame, settings: Settings = Settings(), *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """All versions of all keys (type-2 history).

    Columns: id, key, value, category, source, importance, valid_from,
    invalidated_at, invalidated_by, last_accessed_at. A new value closes the
    version before; a forget event closes it without a successor; an equal
    value only refreshes last_accessed_at; a one-character automatic value
    never replaces a live one. Rejected events make no version. Null keys and
    values are rejected; an empty log has no versions.
    """
    resolved, forgets, bucket = _resolved(events, settings, hot_rows)
    touched = resolved.filter("same").groupBy("key", "version").agg(F.max("ts").alias("last_accessed_at"))
    versions = with_neighbour(resolved.filter("not same and not short"), _KEY, _ORDER, bucket, {"id": "next_id", "ts": "next_ts", "epoch": "next_epoch"}, following=True)
    superseded = F.col("next_epoch") == F.col("epoch")
    out = versions.join(forgets, ["key", "epoch"], "left").join(touched, ["key", "version"], "left")
    return out.select(
        "id",
        "key",
        "value",
        F.when(F.col("key").isin(*settings.profile_keys), "profile").otherwise("note").alias("category"),
        "source",
        importance_of(F.col("source")).alias("importance"),
        F.col("ts").alias("valid_from"),
        F.when(superseded, F.col("next_ts")).otherwise(F.col("forgotten_at")).alias("invalidated_at"),
        F.when(superseded, F.col("next_id")).alias("invalidated_by"),
        "last_accessed_at",
    )


def outcomes(events: DataFrame, settings: Settings = Settings(), *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, changed, reason) of every remember event: stored, already stored, kept existing value, or why it was rejected."""
    resolved, _, _ = _resolved(events, settings, hot_rows)
    done = resolved.select("id", ~(F.col("short") | F.col("same")), F.when(F.col("short"), "kept existing value").when(F.col("same"), "already stored").otherwise("stored")).toDF("id", "changed", "reason")
    bad = checked_events(events, settings).filter("not forget and reason is not null").select("id", F.lit(False).alias("changed"), "reason")
    return done.unionByName(bad)


def quarantined(events: DataFrame, settings: Settings = Settings(), *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The latest `quarantine_cap` rejects of automatic sources: (id, ts, key, value, reason, source)."""
    bad = checked_events(events, settings).filter("not forget and reason is not null and source in ('auto', 'rule')").select("id", "ts", F.left("raw_key", F.lit(200)).alias("key"), F.left("raw_value", F.lit(500)).alias("value"), "reason", "source")
    short = _resolved(events, settings, hot_rows)[0].filter("short").select("id", "ts", F.left("raw_key", F.lit(200)).alias("key"), F.left("raw_value", F.lit(500)).alias("value"), F.lit("too short to override the existing value").alias("reason"), "source")
    return bad.unionByName(short).orderBy(F.col("id").desc()).limit(settings.quarantine_cap)


def current_facts(versions: DataFrame) -> DataFrame:
    """Versions that nothing has closed."""
    return versions.filter("invalidated_at is null")


def facts_as_of(versions: DataFrame, at: Column) -> DataFrame:
    """Versions that were live at a time."""
    return versions.filter((F.col("valid_from") <= at) & (F.col("invalidated_at").isNull() | (F.col("invalidated_at") > at)))


def history(versions: DataFrame, keys: DataFrame, key_col: str = "key", *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every version of the keys (normalised first) with its number, oldest first."""
    wanted = keys.select(normalize_key(F.col(key_col)).alias("key")).filter("key is not null").distinct()
    chain = versions.join(wanted, "key", "left_semi").withColumnRenamed("valid_from", "ts")
    numbered = with_running_sum(chain, _KEY, _ORDER, bucket_if_hot(chain, _KEY, _bucket(hot_rows), hot_rows), F.lit(1), "before")
    return numbered.withColumnRenamed("ts", "valid_from").withColumn("version", F.col("before") + 1).drop("before")


def with_access(facts: DataFrame, accesses: DataFrame) -> DataFrame:
    """Facts with access_count and last_accessed_at from a log of (fact_id, ts)."""
    seen = accesses.groupBy(F.col("fact_id").alias("_fact")).agg(F.count("*").alias("access_count"), F.max("ts").alias("_ts"))
    joined = facts.join(seen, F.col("id") == F.col("_fact"), "left").withColumn("access_count", F.coalesce("access_count", F.lit(0)))
    return joined.withColumn("last_accessed_at", F.greatest("last_accessed_at", "_ts")).drop("_fact", "_ts")


def with_decay(facts: DataFrame, as_of: Column, settings: Settings = Settings()) -> DataFrame:
    """Live facts with `effective` importance and `archived`: automatic, never accessed, faded below the threshold."""
    anchor = F.coalesce("last_accessed_at", "valid_from")
    effective = F.col("importance") * F.exp(-days_between(as_of, anchor) / settings.fact_decay_days)
    count = F.col("access_count") if "access_count" in facts.columns else F.lit(0)
    return facts.withColumn("effective", effective).withColumn("archived", (F.col("source") == "auto") & (count == 0) & (F.col("effective") < settings.fact_archive_threshold))


def recent_contradictions(versions: DataFrame, as_of: Column, settings: Settings = Settings(), limit: int = 5) -> DataFrame:
    """(key, old_value, new_value, new_id) of live facts that lately replaced another value; the first few by old id."""
    old = versions.select("key", F.col("id").alias("old_id"), F.col("value").alias("old_value"), "invalidated_at", "invalidated_by")
    new = versions.filter("invalidated_at is null").select(F.col("id").alias("new_id"), F.col("value").alias("new_value"))
    since = F.date_trunc("day", as_of - F.make_dt_interval(F.lit(int(settings.fact_review_days))))
    pairs = old.filter(F.col("invalidated_at") >= since).join(new, F.col("invalidated_by") == F.col("new_id"))
    return pairs.orderBy("old_id").limit(limit).select("key", "old_value", "new_value", "new_id")


def latest_first(facts: DataFrame) -> list[Column]:
    """The order in which facts are listed: profile first, then importance, then recency."""
    return [(F.col("category") == "profile").desc(), F.col("importance").desc(), F.col("valid_from").desc(), F.col("id")]


def top_rows(df: DataFrame, order: list[Column], n: int, name: str = "position") -> DataFrame:
    """The first n rows in order, numbered. The n rows are numbered in one task; n is a small feature limit."""
    return df.orderBy(*order).limit(n).withColumn(name, F.row_number().over(Window.orderBy(*order)))
