"""The write path as Structured Streaming: transcripts in, sessions, chunks, facts and jobs out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..checkpoints import checkpointed
from ..config import Profile, Settings
from ..functions import rules
from ..functions.text import word_count
from ..functions.vector import HASH_MODEL, embed_texts, hash_embedding
from ..operators import sessions
from ..sources.tables import SCHEMAS, path_exists, write_batch
from ..workers import ship_package

JOB_SCHEMA = "session_id bigint, kind string, turns int, last_turn int"
STATE_SCHEMA = "held int, last_turn int"


def message_stream(spark: SparkSession, path: str, *, files_per_trigger: int = 1) -> DataFrame:
    """New message files of a folder, as they arrive."""
    return spark.readStream.schema(SCHEMAS["messages"]).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def activity_windows(events: DataFrame, user: str, ts: str, *, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user, started_at, ended_at, events) by session windows; events later than `late` are dropped by the watermark."""
    timed = events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    w = timed.groupBy(F.col(user), F.session_window("_t", gap).alias("w")).agg(F.count("*").alias("events"))
    return w.select(user, F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "events")


def rolling_counts(events: DataFrame, ts: str, *keys: str, window: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(window start and end, keys, rows) over tumbling or sliding windows."""
    timed = events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    w = F.window("_t", window, slide) if slide else F.window("_t", window)
    return timed.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("rows")).select(F.col("w.start").alias("from"), F.col("w.end").alias("to"), *keys, "rows")


def extraction_jobs(turns: DataFrame, profile: Profile, settings: Settings = Settings()) -> DataFrame:
    """(session_id, kind, turns, last_turn): when extraction runs over a stream of (session_id, turn, text, ended).

    per_turn: at every turn of enough words; batched: when `batch_turns` have
    gathered in the session's state; session_end: when an `ended` row comes;
    off: never. What is left when a session ends, or is idle for
    `idle_seconds`, is flushed. The state of a session is two numbers.
    """
    eligible = turns.filter((word_count(F.col("text")) >= settings.min_extraction_words) | F.col("ended"))
    if profile.cadence == "off":
        return eligible.filter("false").select("session_id", F.lit("extract").alias("kind"), F.lit(1).alias("turns"), F.col("turn").alias("last_turn"))
    if profile.cadence == "per_turn":
        return eligible.filter("not ended").select("session_id", F.lit("extract").alias("kind"), F.lit(1).alias("turns"), F.col("turn").alias("last_turn"))
    ship_package(turns.sparkSession)
    size = settings.batch_turns if profile.cadence == "batched" else 2**31 - 1
    idle = int(settings.idle_seconds * 1000)

    def flush(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, last = state.get if state.exists else (0, 0)
        out = []
        if state.hasTimedOut:
            if held:
                out.append((key[0], "extract", held, last))
            state.remove()
        else:
            for frame in frames:
                for turn, ended in frame.sort_values(["ended", "turn"])[["turn", "ended"]].itertuples(index=False):
                    if not ended:
                        held, last = held + 1, max(last, int(turn))
                    if held and (held >= size or ended):
                        out.append((key[0], "extract", held, last))
                        held = 0
            state.update((held, last))
            state.setTimeoutDuration(idle)
        yield pd.DataFrame(out, columns=["session_id", "kind", "turns", "last_turn"])

    return eligible.groupBy("session_id").applyInPandasWithState(flush, JOB_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.ProcessingTimeTimeout)


def ingest(messages: DataFrame, root: str, checkpoint: str, settings: Settings = Settings(), *, late: str = "30 days", embed: Callable[[str], list[float] | None] | None = hash_embedding, model: str = HASH_MODEL) -> StreamingQuery:
    """Adds each micro-batch of messages to the memory at `root`, with its chunks, their vectors, and rule-captured facts.

    A message delivered again under its id within `late` of its arrival counts
    once (the ids are stream state, so a batch never reads the history). A side
    of a turn whose partner has not come yet is carried from batch to batch and
    makes its chunk when the turn is complete; so a turn may be split over any
    batches. Every batch writes its own folder of each table, so a batch that is
    repeated after a failure replaces what it had written: exactly once.
    """
    once = messages.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", late).dropDuplicatesWithinWatermark(["id"]).drop("_arrived")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = checkpointed(batch)  # every output is of the same rows
        open_ = f"{root.rstrip('/')}/open_turns/batch="
        sides = sessions.clean_messages(fresh).filter("turn is not null and role != 'system'").select(*fresh.columns)
        if batch_id and path_exists(spark, f"{open_}{batch_id - 1}"):
            sides = sides.unionByName(spark.read.schema(fresh.schema).parquet(f"{open_}{batch_id - 1}"))
        sides = checkpointed(sides)
        pairs = sessions.exchanges(sides)
        sides.join(pairs.select("session_id", "turn"), ["session_id", "turn"], "left_anti").select(*fresh.columns).write.mode("overwrite").parquet(f"{open_}{batch_id}")
        pieces = sessions.chunked(pairs, settings.chunk_target_tokens)
        chunks = pieces.withColumn("id", F.abs(F.xxhash64("session_id", "turn", "piece", "first_msg_id") % (1 << 62))).withColumn("importance", F.lit(0.5))
        if embed is not None:
            chunks = checkpointed(chunks)
            chunks = chunks.join(embed_texts(chunks, "id", "text", embed), "id").withColumn("embedding_model", F.when(F.col("embedding").isNotNull(), model))
        user = sessions.clean_messages(fresh).filter("role = 'user'")
        facts = rules.capture_facts(user, "id", "content").join(user.select("id", F.col("created_at").alias("ts")), "id")
        # Ids of captured facts are negative, so they never meet those that the store gives.
        facts = facts.select((-1 - F.abs(F.xxhash64("id", "ord") % (1 << 62))).alias("id"), "key", "value", F.lit("rule").alias("source"), "ts", F.lit("remember").alias("op"))
        for name, rows in (("chunks", chunks), ("fact_events", facts), ("messages", fresh)):
            write_batch(rows, root, name, batch_id)

    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
