"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .conversations import assess_sessions, rebuild_conversations
from .leakage import find_leaks
from .names import link_names
from .neighbours import nearest_vectors
from .pii import redact_texts
from .repetition import judge_repetition, repetitive
from .splitting import split_texts
from .tokens import encode_texts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, row_id, text) of messages and chunks."""
    m = _table(spark, sf_dir, "messages").select(F.lit("messages").alias("src"), F.col("id").alias("row_id"), F.col("content").alias("text"))
    c = _table(spark, sf_dir, "chunks").select(F.lit("chunks").alias("src"), F.col("id").alias("row_id"), "text")
    return m.unionByName(c)


def p1_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every person or organisation row with the entity it belongs to."""
    return link_names(_table(spark, sf_dir, "graph_nodes"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows that mean the same person or organisation."""
    rows = p1_entities(spark, sf_dir)
    a, b = rows.select(F.col("id").alias("id_a"), "entity"), rows.select(F.col("id").alias("id_b"), "entity")
    return a.join(b, "entity").filter("id_a < id_b").select("id_a", "id_b")


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of messages and chunks with placeholders, and the spans they replace."""
    return redact_texts(_texts(spark, sf_dir), ["src", "row_id"], "text")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of personal information of each text."""
    return p2_redacted(spark, sf_dir).select("src", "row_id", F.explode(F.array_distinct("spans.kind")).alias("kind"))


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of messages and chunks in pieces of at most 1,600 characters."""
    return split_texts(_texts(spark, sf_dir), ["src", "row_id"], "text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that had to be split: those with a second piece."""
    return p3_pieces(spark, sf_dir).filter("piece = 2").select("src", "row_id")


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 most similar chunks of every usable chunk under its model."""
    return nearest_vectors(_table(spark, sf_dir, "chunks"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks of which one is among the 5 most similar of the other."""
    return p4_neighbours(spark, sf_dir).select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p5_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered utterances of the kept sessions, those of the system included."""
    return rebuild_conversations(_table(spark, sf_dir, "sessions"), _table(spark, sf_dir, "messages"), with_system=True)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that are dropped."""
    return assess_sessions(_table(spark, sf_dir, "sessions"), _table(spark, sf_dir, "messages")).filter("reason is not null").select("session_id")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return encode_texts(_table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and evaluation items that share at least 25 consecutive words."""
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p8_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition measures, votes and posterior of every document."""
    return judge_repetition(_table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which at least 0.3 of the words are repeated.

    Candidates are the documents that weak supervision holds for repetitive, or
    cannot exclude; the exact share, which is no voter, then decides.
    """
    return repetitive(judge_repetition(_table(spark, sf_dir, "documents"))).select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_entities, p2_found, p2_redacted, p3_found, p3_pieces, p4_found, p4_neighbours, p5_found, p5_conversations, p6_ids, p7_found, p8_found, p8_repetition)}


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": """
            SELECT 'messages' AS src, id AS row_id FROM messages WHERE length(content) > 1600
            UNION ALL SELECT 'chunks' AS src, id AS row_id FROM chunks WHERE length(text) > 1600""",
        "p5_found": r"""
            WITH rows AS (
                SELECT session_id, turn, lower(trim(role, chr(32) || chr(9) || chr(13) || chr(10))) AS role, trim(content, chr(32) || chr(9) || chr(13) || chr(10)) AS t
                FROM messages WHERE session_id IS NOT NULL
            ), said AS (SELECT * FROM rows WHERE t <> '' AND role IS DISTINCT FROM 'system'),
            by_turn AS (
                SELECT session_id, turn, count(DISTINCT t) FILTER (WHERE role = 'user') AS users, count(DISTINCT t) FILTER (WHERE role = 'assistant') AS replies,
                       count(*) FILTER (WHERE role IS NULL OR role NOT IN ('user', 'assistant')) AS strange
                FROM said GROUP BY session_id, turn
            ), kept AS (
                SELECT session_id FROM by_turn GROUP BY session_id
                HAVING bool_and(turn IS NOT NULL AND users = 1 AND replies = 1 AND strange = 0) AND min(turn) = 1 AND max(turn) = count(*)
            )
            SELECT DISTINCT session_id FROM (SELECT id AS session_id FROM sessions UNION SELECT session_id FROM messages) WHERE session_id IS NOT NULL
            EXCEPT SELECT session_id FROM kept WHERE session_id IN (SELECT id FROM sessions)""",
        "p7_found": """
            WITH dw AS (SELECT doc_id, [lower(x) FOR x IN regexp_extract_all(text, '[A-Za-z0-9]+')] AS w FROM documents WHERE text IS NOT NULL),
            iw AS (SELECT item_id, [lower(x) FOR x IN regexp_extract_all(text, '[A-Za-z0-9]+')] AS w FROM eval_items WHERE text IS NOT NULL),
            ds AS (SELECT doc_id, w, unnest(range(1, len(w) - 23)) AS i FROM dw WHERE len(w) >= 25),
            its AS (SELECT item_id, w, unnest(range(1, len(w) - 23)) AS i FROM iw WHERE len(w) >= 25)
            SELECT DISTINCT doc_id, item_id
            FROM (SELECT doc_id, array_to_string(w[i:i+24], ' ') AS g FROM ds) d JOIN (SELECT item_id, array_to_string(w[i:i+24], ' ') AS g FROM its) t USING (g)""",
        "p8_found": """
            WITH dw AS (SELECT doc_id, [lower(x) FOR x IN regexp_extract_all(text, '[A-Za-z0-9]+')] AS w FROM documents WHERE text IS NOT NULL),
            g AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM dw WHERE len(w) >= 8)),
            again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, g ORDER BY i) AS n FROM g) WHERE n > 1),
            covered AS (SELECT DISTINCT doc_id, i + o AS p FROM again, range(8) r(o))
            SELECT doc_id FROM covered JOIN dw USING (doc_id) GROUP BY doc_id, len(w) HAVING count(*) / len(w) >= 0.3""",
    }
