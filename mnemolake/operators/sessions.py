"""Transcripts: exchanges, session rollups, resume windows, chunking and extractive summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens, leading_clause, sentences, strip
from .ordered import bucket_if_hot, with_running_sum


def clean_messages(messages: DataFrame) -> DataFrame:
    """Rows with a session, text, and a role of user, assistant or system (read without case and outer blanks)."""
    role = F.lower(strip(F.col("role")))
    return messages.withColumn("role", role).filter((F.col("session_id").isNotNull()) & role.isin("user", "assistant", "system") & (strip(F.col("content")) != ""))


def exchanges(messages: DataFrame) -> DataFrame:
    """(session_id, turn, first_msg_id, last_msg_id, user_text, assistant_text, text, created_at) of turns with both sides.

    User and assistant rows of an exchange carry the same turn, so they are
    paired by aggregation; of resent rows the smallest id counts.
    """
    rows = clean_messages(messages).filter("turn is not null and role != 'system'")
    user, reply = F.col("role") == "user", F.col("role") == "assistant"
    pairs = rows.groupBy("session_id", "turn").agg(
        F.min(F.when(user, F.col("id"))).alias("first_msg_id"),
        F.min(F.when(reply, F.col("id"))).alias("last_msg_id"),
        F.min_by(F.when(user, F.col("content")), F.when(user, F.col("id"))).alias("user_text"),
        F.min_by(F.when(reply, F.col("content")), F.when(reply, F.col("id"))).alias("assistant_text"),
        F.min("created_at").alias("created_at"),
    )
    both = pairs.filter("first_msg_id is not null and last_msg_id is not null")
    return both.withColumn("text", F.concat(F.lit("User: "), "user_text", F.lit("\nAssistant: "), "assistant_text"))


def pack_sentences(text: Column, target_tokens: int, tokens: Callable[[Column], Column] = estimate_tokens) -> Column:
    """Pieces of a text: whole if it fits, else sentences packed up to the target; a longer sentence stays whole.

    `tokens` counts the tokens of a text column.
    """
    acc_type = "struct<buf: string, out: array<string>>"

    def step(acc, s):
        longer = strip(F.concat(acc["buf"], F.lit(" "), s))
        full = (acc["buf"] != "") & (tokens(longer) > target_tokens)
        return F.struct(F.when(full, s).otherwise(longer).alias("buf"), F.when(full, F.array_append(acc["out"], acc["buf"])).otherwise(acc["out"]).alias("out"))

    packed = F.aggregate(sentences(text), F.struct(F.lit("").alias("buf"), F.array().cast("array<string>").alias("out")).cast(acc_type), step)
    done = F.when(packed["buf"] != "", F.array_append(packed["out"], packed["buf"])).otherwise(packed["out"])
    return F.when(tokens(text) <= target_tokens, F.array(text)).otherwise(done)


def chunked(pairs: DataFrame, target_tokens: int = 400, tokens: Callable[[Column], Column] = estimate_tokens) -> DataFrame:
    """(session_id, turn, piece, text, first_msg_id, last_msg_id, created_at) of exchanges."""
    parts = pairs.select("session_id", "turn", "first_msg_id", "last_msg_id", "created_at", F.explode(F.array(pack_sentences(F.col("text"), target_tokens, tokens))).alias("parts"))
    return parts.select("session_id", "turn", "first_msg_id", "last_msg_id", "created_at", F.posexplode("parts").alias("piece", "text"))


def turn_batches(pairs: DataFrame, size: int) -> DataFrame:
    """(session_id, batch, turns, first_turn, last_msg_id): each session's exchanges in turn order, `size` at a time, whatever their numbers."""
    hot = bucket_if_hot(pairs, ["session_id"], [F.floor(F.col("turn") / n) for n in (1_000_000, 10_000)])
    counted = with_running_sum(pairs.select("session_id", "turn", "last_msg_id"), ["session_id"], ["turn"], hot, F.lit(1), "before")
    return counted.groupBy("session_id", F.floor(F.col("before") / size).cast("bigint").alias("batch")).agg(F.count("*").alias("turns"), F.min("turn").alias("first_turn"), F.max("last_msg_id").alias("last_msg_id"))


def session_rollup(sessions: DataFrame, messages: DataFrame, as_of: Column) -> DataFrame:
    """Sessions with counted messages, a title (first user text, 80 characters, where missing) and an end (as_of for open ones)."""
    rows = clean_messages(messages)
    stats = rows.groupBy("session_id").agg(
        F.count("*").alias("messages"),
        F.min_by(F.when(F.col("role") == "user", F.col("content")), F.when(F.col("role") == "user", F.col("id"))).alias("first_text"),
    )
    joined = sessions.join(stats, sessions["id"] == stats["session_id"], "left")
    return joined.select("id", "started_at", F.coalesce("ended_at", as_of).alias("ended_at"), F.coalesce("title", F.left("first_text", F.lit(80))).alias("title"), "summary", F.coalesce("messages", F.lit(0)).alias("message_count"), F.col("ended_at").isNull().alias("was_open"))


def session_tail(messages: DataFrame, budget: int, tokens: Callable[[Column], Column] | None = None) -> DataFrame:
    """The last messages of each session within a token budget, at least one, with their running cost: by `tokens`, else their stored estimates.

    Each message costs at least 1, so a session's last `budget` + 1 rows
    decide; only those are gathered.
    """
    rows = clean_messages(messages).filter("role != 'system'")
    cost = F.greatest(F.lit(1), tokens(F.col("content")) if tokens else F.coalesce(F.col("token_estimate"), estimate_tokens(F.col("content"))))
    newest = Window.partitionBy("session_id").orderBy(F.col("id").desc())
    rows = rows.select("session_id", "id", "role", "content", cost.alias("cost")).withColumn("back", F.row_number().over(newest)).filter(F.col("back") <= budget + 1)
    rows = rows.withColumn("used", F.sum("cost").over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter((F.col("used") <= budget) | (F.col("back") == 1)).select("session_id", "id", "role", "back", "used")


def extractive_summary(messages: DataFrame, budget: int) -> DataFrame:
    """(session_id, lines, summary): the leading clauses of the user's texts, newest kept within the budget, oldest first.

    Clauses that differ only in case count once, where they came first. Only
    the newest budget + 1 clauses of a session can count.
    """
    rows = clean_messages(messages).filter("role = 'user'").select("session_id", "id", leading_clause(F.col("content")).alias("clause")).filter("clause != ''")
    once = rows.groupBy("session_id", F.lower("clause").alias("_low")).agg(F.min_by("clause", "id").alias("clause"), F.min("id").alias("id"))
    line = F.concat(F.lit("- "), "clause")
    newest = Window.partitionBy("session_id").orderBy(F.col("id").desc())
    tail = once.withColumn("line", line).withColumn("back", F.row_number().over(newest)).filter(F.col("back") <= budget + 1)
    kept = tail.withColumn("used", F.sum(estimate_tokens(F.col("line"))).over(newest.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("used") <= budget)
    return kept.groupBy("session_id").agg(F.count("*").alias("lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda x: x["line"]), "\n").alias("summary"))
