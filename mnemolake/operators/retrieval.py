"""Hybrid retrieval for many queries at once.

Chunks: the stronger of a text rank and a cosine, plus small nudges for
importance, recency and graph proximity. Facts: relevance x importance x
recency, plus a graph nudge. Every ordering ends in a unique id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..config import Settings
from ..functions.text import normalize_key
from ..functions.vector import cosine_top
from . import graph
from .bm25 import CUT, bm25_top, like_top
from .facts import days_between, history

RRF = 60
GRAPH_SHARE = 0.15


@dataclass
class Memory:
    """The tables that retrieval reads. `versions` are fact versions; `chunks` may have a `usable` vector column set."""

    chunks: DataFrame
    versions: DataFrame
    nodes: DataFrame
    edges: DataFrame


def rank_score(rank: Column) -> Column:
    """Reciprocal rank, 1 for the first (rank counts from 1)."""
    return F.lit(float(RRF)) / (RRF - 1 + rank)


def text_leg(queries: DataFrame, docs: DataFrame, id_col: str, cols: list[str], settings: Settings, live: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, fts, rank)."""
    if settings.text_index == "like":
        source = docs if live is None else docs.join(live.select(F.col("doc_id").alias(id_col)), id_col, "left_semi")
        hits = like_top(queries, source, id_col, cols)
    else:
        hits = bm25_top(queries, docs.withColumn("_doc", F.concat_ws(" ", *cols)), id_col, "_doc", CUT, stem=settings.stem, live=live)
    return hits.select("query_id", "doc_id", rank_score(F.col("rank")).alias("fts"), "rank")


def vector_leg(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, doc_id, vector): the 20 most similar chunks, relative to the best; none where the best is not positive."""
    asked = queries.filter("vec is not null").select("query_id", "grp", "vec")
    top = cosine_top(asked, chunks.select("id", F.col("embedding_model").alias("grp"), F.col("embedding").alias("vec")), CUT)
    best = F.max("cosine").over(Window.partitionBy("query_id"))
    return top.withColumn("best", best).filter("best > 0").select("query_id", F.col("id").alias("doc_id"), (F.greatest(F.lit(0.0), "cosine") / F.col("best")).alias("vector"))


def walk(queries: DataFrame, memory: Memory, hops: int) -> tuple[DataFrame, tuple[DataFrame, DataFrame]]:
    """The nodes that the queries reach, and the graph leg made from them."""
    seeds = checkpointed(graph.seed_nodes(queries, memory.nodes))  # each hop reads them again
    reached = checkpointed(graph.expand(seeds, memory.edges, hops))
    # Read several times from here on: by the chunk scan, and by every leg that is nudged.
    weights = checkpointed(graph.name_weights(reached, memory.nodes))
    return reached, (weights, graph.chunk_weights(weights, memory.chunks))


def graph_leg(queries: DataFrame, memory: Memory, hops: int) -> tuple[DataFrame, DataFrame]:
    """(query_id, name, weight) of reached names, and (query_id, chunk_id, weight)."""
    return walk(queries, memory, hops)[1]


def explain_chunks(queries: DataFrame, memory: Memory, as_of: Column, *, k: int = 5, hops: int = 2, settings: Settings = Settings(), usable_chunks: DataFrame | None = None, reached: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The k best chunks of each query with all parts of their score.

    `queries` needs query_id, text; vec and grp (nullable) for the vector leg; exclude_session (nullable).
    Columns: query_id, rank, chunk_id, session_id, text, date, fts, vector, relevance,
    importance_nudge, recency_nudge, graph_nudge, graph_names, total. Hidden sessions are
    dropped after the candidates are cut. Queries without candidates give no
    rows. A null importance counts as 0.5 and a null time as now.
    """
    fts = text_leg(queries, memory.chunks, "id", ["text"], settings).select("query_id", "doc_id", "fts")
    if usable_chunks is not None:
        vec = vector_leg(queries, usable_chunks)
        fused = fts.join(vec, ["query_id", "doc_id"], "full")
    else:
        fused = fts.withColumn("vector", F.lit(None).cast("double"))
    fused = fused.select("query_id", F.col("doc_id").alias("chunk_id"), F.coalesce("fts", F.lit(0.0)).alias("fts"), F.coalesce("vector", F.lit(0.0)).alias("vector"))
    fused = fused.withColumn("relevance", F.greatest("fts", "vector")).withColumn("top", F.max("relevance").over(Window.partitionBy("query_id")))
    names, weighted = reached if reached is not None else graph_leg(queries, memory, hops)
    rows = memory.chunks.select(F.col("id").alias("chunk_id"), "session_id", "text", "created_at", "importance")
    scored = fused.join(weighted, ["query_id", "chunk_id"], "left").join(rows, "chunk_id")
    if "exclude_session" in queries.columns:
        scored = scored.join(queries.select("query_id", "exclude_session"), "query_id").filter("not (session_id <=> exclude_session) or exclude_session is null")
    scored = (
        scored.withColumn("importance_nudge", (F.coalesce("importance", F.lit(0.5)) - 0.5) * 0.15)
        .withColumn("recency_nudge", F.exp(-days_between(as_of, F.col("created_at")) / settings.episodic_recency_days) * 0.1)
        .withColumn("graph_nudge", F.coalesce("weight", F.lit(0.0)) * F.col("top") * GRAPH_SHARE)
        .withColumn("total", F.col("relevance") + F.col("importance_nudge") + F.col("recency_nudge") + F.col("graph_nudge"))
    )
    order = Window.partitionBy("query_id").orderBy(F.round("total", 12).desc(), "chunk_id")
    best = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    # Only the k chosen chunks are searched for the names that matched.
    lit = best.filter("weight > 0").select("query_id", "chunk_id", F.lower("text").alias("_low")).join(names, "query_id").filter(F.contains("_low", F.col("name")))
    listed = lit.groupBy("query_id", "chunk_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("graph_names"))
    return best.join(listed, ["query_id", "chunk_id"], "left").select("query_id", "rank", "chunk_id", "session_id", "text", F.date_format("created_at", "yyyy-MM-dd").alias("date"), "fts", "vector", "relevance", "importance_nudge", "recency_nudge", "graph_nudge", F.coalesce("graph_names", F.lit("")).alias("graph_names"), "total")


def fact_relevance(queries: DataFrame, versions: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(query_id, fact_id, relevance, rank): the 20 best live facts by rank, 1 for the first; statistics cover all versions."""
    live = versions.filter("invalidated_at is null").select(F.col("id").alias("doc_id"))
    hits = text_leg(queries, versions.select("id", "key", "value"), "id", ["key", "value"], settings, live)
    return hits.select("query_id", F.col("doc_id").alias("fact_id"), F.col("fts").alias("relevance"), "rank")


def explain_facts(queries: DataFrame, memory: Memory, as_of: Column, *, hops: int = 2, settings: Settings = Settings(), names: DataFrame | None = None) -> DataFrame:
    """(query_id, fact_id, rank, key, value, date, relevance, importance, recency, graph_nudge, total) of the matched live facts."""
    hits = fact_relevance(queries, memory.versions, settings)
    rows = memory.versions.select(F.col("id").alias("fact_id"), "key", "value", "importance", "valid_from")
    hits = hits.join(rows, "fact_id")
    names = names if names is not None else graph_leg(queries, memory, hops)[0]
    touched = hits.select("query_id", "fact_id", F.lower("value").alias("_low")).join(names, "query_id").filter(F.contains("_low", F.col("name"))).select("query_id", "fact_id").distinct().withColumn("near", F.lit(1.0))
    recency = F.exp(-days_between(as_of, F.col("valid_from")) / settings.fact_recency_days)
    scored = hits.join(touched, ["query_id", "fact_id"], "left").withColumn("recency", recency).withColumn("graph_nudge", F.coalesce("near", F.lit(0.0)) * GRAPH_SHARE)
    return scored.select("query_id", "fact_id", "rank", "key", "value", F.date_format("valid_from", "yyyy-MM-dd").alias("date"), "relevance", "importance", "recency", "graph_nudge", (F.col("relevance") * F.col("importance") * F.col("recency") + F.col("graph_nudge")).alias("total"))


def recall(queries: DataFrame, memory: Memory, as_of: Column, *, k: int = 5, hops: int = 2, settings: Settings = Settings(), usable_chunks: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, kind, id, text, date, score): the k best chunks and facts of each query. Of equal scores chunks come first.

    The queries and the nodes they reach are written once, since all legs read them.
    """
    queries = checkpointed(queries)
    reached = graph_leg(queries, memory, hops)
    c = explain_chunks(queries, memory, as_of, k=k, hops=hops, settings=settings, usable_chunks=usable_chunks, reached=reached)
    f = explain_facts(queries, memory, as_of, hops=hops, settings=settings, names=reached[0])
    hits = c.select("query_id", F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id"), "text", "date", F.col("total").alias("score"), "rank").unionByName(
        f.select("query_id", F.lit("fact").alias("kind"), F.col("fact_id").alias("id"), F.concat("key", F.lit(": "), "value").alias("text"), "date", F.col("total").alias("score"), "rank")
    )
    order = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "kind", F.col("rank"))
    return hits.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).select("query_id", F.col("_r").alias("rank"), "kind", "id", "text", "date", "score")


def timeline(queries: DataFrame, versions: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(query_id, key, resolved_by, version, id, value, valid_from, invalidated_at): the history of the key a query means.

    A query that normalises to a stored key means that key; else the key of
    the best fact hit; else one row with resolved_by `none` and nulls.
    """
    exact = queries.select("query_id", normalize_key(F.col("text")).alias("key")).join(versions.select("key").distinct(), "key", "left_semi")
    best = fact_relevance(queries, versions, settings).filter("rank = 1").join(versions.select(F.col("id").alias("fact_id"), F.col("key").alias("best_key")), "fact_id").select("query_id", "best_key")
    resolved = queries.select("query_id").join(exact, "query_id", "left").join(best, "query_id", "left")
    resolved = resolved.select("query_id", F.coalesce("key", "best_key").alias("key"), F.when(F.col("key").isNotNull(), "exact").when(F.col("best_key").isNotNull(), "search").otherwise("none").alias("resolved_by"))
    chain = history(versions, resolved.select("key"))
    return resolved.join(chain.select("key", "version", "id", "value", "valid_from", "invalidated_at"), "key", "left").select("query_id", "key", "resolved_by", "version", "id", "value", "valid_from", "invalidated_at")
