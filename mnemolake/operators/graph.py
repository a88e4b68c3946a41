"""The property graph as two tables: upserts, caps, decay, seeds, expansion, clusters, merging."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..config import Settings
from ..functions.text import canonical_name, squeeze, strip
from ..workers import map_batches
from .components import connected_components
from .facts import days_between

ENTITY_TYPES = ("person", "place", "org", "thing", "entity")
MAX_ALIASES = 8
NAMES_BROADCAST_BYTES = 64 << 20


# --- upserts -------------------------------------------------------------------


def upsert_nodes(mentions: DataFrame) -> DataFrame:
    """Nodes of a log of (mention_id, type, name, confidence, mentions, ts), one per type and canonical name.

    id is the first mention's; confidence is the mean weighted by `mentions`
    (null counts as 0.5), which equals the running average of any order, and null where the mentions sum to 0; aliases are the spellings that
    differ from the canonical name, latest first (of one mention by spelling), at most 8. Unknown types
    become `entity`; blank names are skipped.
    """
    raw = strip(F.col("name"))
    kind = F.when(F.col("type").isin(*ENTITY_TYPES), F.col("type")).otherwise("entity")
    rows = mentions.select("mention_id", kind.alias("type"), raw.alias("raw"), canonical_name(F.col("name")).alias("canonical_name"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"), F.coalesce("mentions", F.lit(1)).alias("mentions"), "ts").filter("canonical_name is not null and canonical_name != ''")
    spelled = rows.groupBy("type", "canonical_name", "raw").agg(
        F.min("mention_id").alias("first"), F.min("ts").alias("created"), F.max("ts").alias("updated"), F.sum("mentions").alias("n"), F.sum(F.col("confidence") * F.col("mentions")).alias("weighted"), F.min(F.struct("ts", "mention_id")).alias("seen")
    )
    # A spelling becomes an alias when it is first seen; aliases are listed latest first.
    newest = Window.partitionBy("type", "canonical_name").orderBy(F.col("alias").desc(), F.col("seen").desc(), "raw")
    spelled = spelled.withColumn("alias", F.col("raw") != F.col("canonical_name")).withColumn("r", F.row_number().over(newest))
    kept = F.when(F.col("alias") & (F.col("r") <= MAX_ALIASES), F.struct("r", "raw"))
    return spelled.groupBy("type", "canonical_name").agg(
        F.min("first").alias("id"), F.min("created").alias("created_at"), F.max("updated").alias("updated_at"), F.sum("n").alias("mention_count"), F.try_divide(F.sum("weighted"), F.sum("n")).alias("confidence"), F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["raw"]).alias("aliases")
    )


def upsert_edges(mentions: DataFrame) -> DataFrame:
    """Edges of a log of (mention_id, source_node, target_node, relationship, confidence, mentions, created_at, last_seen, source_chunk_id).

    One per endpoints and normalised relationship; blank relationships, null
    endpoints and self-loops are skipped; source_chunk_id and created_at are the first mention's, last_seen is
    the latest, confidence the weighted mean.
    """
    relation = squeeze(F.lower("relationship"))
    rows = mentions.withColumn("relationship", relation).filter("relationship != '' and source_node != target_node")
    n, c = F.coalesce("mentions", F.lit(1)), F.coalesce("confidence", F.lit(0.5))
    return rows.groupBy("source_node", "target_node", "relationship").agg(
        F.min("mention_id").alias("id"),
        F.sum(n).alias("seen_count"),
        (F.sum(c * n) / F.sum(n)).alias("confidence"),
        F.min_by("created_at", "mention_id").alias("created_at"),
        F.max("last_seen").alias("last_seen"),
        F.min_by("source_chunk_id", "mention_id").alias("source_chunk_id"),
    )


def merged_nodes(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored nodes (in the schema of the table) with the nodes of `upsert_nodes` merged in by type and canonical name.

    Counts add up, confidence is their mean by count, new spellings come first
    among the at most 8 aliases; id, importance and cluster stay. A new node
    has importance 0.5.
    """
    keys, columns = ["type", "canonical_name"], stored.columns
    new = fresh.select(*keys, *(F.col(c).alias(f"_{c}") for c in ("id", "aliases", "created_at", "updated_at", "confidence", "mention_count")))
    n, more = F.coalesce("mention_count", F.lit(0)), F.coalesce("_mention_count", F.lit(0))
    mean = F.when(F.col("_id").isNull(), F.col("confidence")).otherwise((F.coalesce("confidence", F.lit(0.5)) * n + F.coalesce("_confidence", F.lit(0.0)) * more) / F.greatest(n + more, F.lit(1)))
    none = F.array().cast("array<string>")
    values = {
        "id": F.coalesce("id", "_id"), "aliases": F.slice(F.array_distinct(F.concat(F.coalesce("_aliases", none), F.coalesce("aliases", none))), 1, MAX_ALIASES), "created_at": F.least("created_at", "_created_at"),
        "updated_at": F.greatest("updated_at", "_updated_at"), "confidence": mean, "mention_count": n + more, "importance": F.when(F.col("id").isNull(), 0.5).otherwise(F.col("importance")),
    }
    return stored.join(new, keys, "full").select(*(values.get(c, F.col(c)).alias(c) for c in columns))


def merged_edges(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored edges with the edges of `upsert_edges` merged in by ends and relationship; new ones have importance 0.5 and weight 1."""
    keys, columns = ["source_node", "target_node", "relationship"], stored.columns
    new = fresh.select(*keys, *(F.col(c).alias(f"_{c}") for c in ("id", "confidence", "created_at", "last_seen", "seen_count", "source_chunk_id")))
    n, more = F.coalesce("seen_count", F.lit(0)), F.coalesce("_seen_count", F.lit(0))
    mean = F.when(F.col("_id").isNull(), F.col("confidence")).otherwise((F.coalesce("confidence", F.lit(0.5)) * n + F.coalesce("_confidence", F.lit(0.0)) * more) / F.greatest(n + more, F.lit(1)))
    old = F.col("id").isNotNull()
    values = {
        "id": F.coalesce("id", "_id"), "confidence": mean, "created_at": F.least("created_at", "_created_at"), "last_seen": F.greatest("last_seen", "_last_seen"), "seen_count": n + more,
        "importance": F.when(old, F.col("importance")).otherwise(0.5), "weight": F.when(old, F.col("weight")).otherwise(1.0), "source_chunk_id": F.when(old, F.col("source_chunk_id")).otherwise(F.col("_source_chunk_id")),
    }
    return stored.join(new, keys, "full").select(*(values.get(c, F.col(c)).alias(c) for c in columns))


def with_surviving_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are among the nodes (cascade of deleted nodes)."""
    ids = nodes.select(F.col("id").alias("_id"))
    return edges.join(ids, edges["source_node"] == F.col("_id"), "left_semi").join(ids.withColumnRenamed("_id", "_id2"), edges["target_node"] == F.col("_id2"), "left_semi")


def capped(nodes: DataFrame, edges: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """The most important nodes and edges up to the caps; edges of cut nodes go first."""
    kept = nodes.orderBy(F.col("importance").desc(), F.col("mention_count").desc(), F.col("updated_at").desc(), "id").limit(settings.node_cap)
    left = with_surviving_ends(edges, kept).orderBy(F.col("importance").desc(), F.col("seen_count").desc(), F.col("last_seen").desc(), "id").limit(settings.edge_cap)
    return kept, left


def decayed(nodes: DataFrame, edges: DataFrame, as_of: Column, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges whose confidence has not faded below the threshold; edges of faded nodes go too. A null confidence counts as 0.5."""

    def alive(anchor: str) -> Column:
        return F.coalesce("confidence", F.lit(0.5)) * F.exp(-days_between(as_of, F.col(anchor)) / settings.graph_decay_days) >= settings.graph_archive_threshold

    kept = nodes.filter(alive("updated_at"))
    return kept, with_surviving_ends(edges.filter(alive("last_seen")), kept)


# --- names in texts ------------------------------------------------------------


def find_names(texts: DataFrame, names: DataFrame, *, broadcast_bytes: int = NAMES_BROADCAST_BYTES) -> DataFrame:
    """Distinct (id, name): each of the (lower-case) names that stands anywhere in the (lower-cased) text.

    All names are searched in one pass over each text by an Aho-Corasick
    automaton, which is built on the workers from the broadcast list; a list
    larger than `broadcast_bytes` is searched in parts of that size.
    """
    wanted = names.select("name").filter("name is not null and name != ''").distinct()
    size = wanted.agg(F.sum(F.octet_length("name") + 64)).head()[0] or 0
    parts = max(1, math.ceil(size / broadcast_bytes))
    lowered = texts.select(F.col("id"), F.lower("text").alias("text")).filter("text is not null")
    schema = f"id {texts.schema['id'].dataType.simpleString()}, name string"
    out = None
    for p in range(parts):
        held = [r[0] for r in wanted.filter(F.pmod(F.xxhash64("name"), F.lit(parts)) == p).collect()]  # about broadcast_bytes at most
        sent = texts.sparkSession.sparkContext.broadcast(sorted(held))
        one = map_batches(lowered, _name_scan(sent), schema)
        out = one if out is None else out.unionByName(one)
    return out


_automata: dict = {}


def _automaton(sent, token: str):
    """The automaton of a broadcast list of names, built once per worker process; only the last one is kept."""
    import ahocorasick

    if token not in _automata:
        built = ahocorasick.Automaton()
        for name in sent.value:
            built.add_word(name, name)
        built.make_automaton()
        _automata.clear()
        _automata[token] = built
    return _automata[token]


def _name_scan(sent):
    token = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(sent, token)
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                hits = {name for _, name in automaton.iter(text)} if len(automaton) else ()
                at.extend([i] * len(hits))
                found.extend(hits)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], ["id", "name"])

    return run


def seed_nodes(queries: DataFrame, nodes: DataFrame, limit: int = 5) -> DataFrame:
    """(query_id, id, length, rank): nodes whose name or alias stands in the query, longest match first, at most `limit`."""
    names = nodes.select("id", F.explode(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name")).select("id", F.lower("name").alias("name")).filter("name != ''").distinct()
    hits = find_names(queries.select(F.col("query_id").alias("id"), "text"), names).withColumnRenamed("id", "query_id")
    matched = hits.join(names, "name").groupBy("query_id", "id").agg(F.max(F.char_length("name")).alias("length"))
    order = Window.partitionBy("query_id").orderBy(F.col("length").desc(), "id")
    return matched.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def expand(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(query_id, id, depth): all nodes within `hops` undirected steps of a query's seeds, with the least depth; seeds have 0."""
    undirected = edges.select(F.col("source_node").alias("a"), F.col("target_node").alias("b")).unionByName(edges.select(F.col("target_node").alias("a"), F.col("source_node").alias("b"))).filter("a != b").distinct()
    reached = seeds.select("query_id", "id", F.lit(0).alias("depth")).distinct()
    frontier = reached
    for depth in range(1, hops + 1):
        step = frontier.join(undirected, F.col("id") == F.col("a")).select("query_id", F.col("b").alias("id")).distinct()
        frontier = step.join(reached, ["query_id", "id"], "left_anti").withColumn("depth", F.lit(depth))
        reached = reached.unionByName(frontier)
    return reached


def name_weights(reached: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, name, weight): confidence x specificity of reached names, the query's strongest being 1; of equal names the largest id counts."""
    named = reached.join(nodes.select("id", F.col("canonical_name").alias("name"), F.coalesce("confidence", F.lit(0.5)).alias("confidence")), "id")
    raw = named.groupBy("query_id", "name").agg((F.max_by("confidence", "id") * F.least(F.lit(1.0), F.char_length("name") / F.lit(12.0))).alias("raw"))
    # The maximum is aggregated and joined: a query may reach very many names.
    top = raw.groupBy("query_id").agg(F.max("raw").alias("top"))
    return raw.join(top, "query_id").select("query_id", "name", (F.col("raw") / F.when(F.col("top") == 0, 1.0).otherwise(F.col("top"))).alias("weight"))


def chunk_weights(weights: DataFrame, chunks: DataFrame, per_name: int = 50) -> DataFrame:
    """(query_id, chunk_id, weight): the strongest reached name in each chunk; a name counts in its first `per_name` chunks."""
    hits = find_names(chunks.select("id", "text"), weights.select("name"))
    order = Window.partitionBy("name").orderBy("id")
    first = hits.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= per_name)
    return first.join(weights, "name").groupBy("query_id", F.col("id").alias("chunk_id")).agg(F.max("weight").alias("weight"))


# --- clusters and merging --------------------------------------------------------


def clusters(nodes: DataFrame, edges: DataFrame, min_size: int = 2) -> DataFrame:
    """(id, cluster_id) of nodes in components of at least `min_size`; a cluster's id is its smallest node."""
    ends = with_surviving_ends(edges, nodes)
    members = connected_components(ends, "source_node", "target_node")
    sizes = members.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") >= min_size)
    return members.join(sizes, "component").select("id", F.col("component").alias("cluster_id"))


def stamped(nodes: DataFrame, members: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Nodes with the cluster they are in now; nodes in none lose theirs and its label.

    `labels` (cluster_id, label) names the clusters in which some node has no label yet.
    """
    now = members.select("id", F.col("cluster_id").alias("_cluster"))
    rows = nodes.join(now, "id", "left").withColumn("cluster_id", F.col("_cluster")).withColumn("cluster_label", F.when(F.col("_cluster").isNotNull(), F.nullif("cluster_label", F.lit(""))))
    if labels is not None:
        rows = rows.join(labels.select(F.col("cluster_id").alias("_cluster"), F.col("label").alias("_label")), "_cluster", "left").withColumn("cluster_label", F.coalesce("_label", "cluster_label"))
    return rows.select(*nodes.columns)


def cluster_listing(nodes: DataFrame, members: DataFrame, shown: int = 12) -> DataFrame:
    """(cluster_id, label, size, names): clusters with the first `shown` names by id; the label is the largest one stored."""
    rows = members.join(nodes.select("id", "canonical_name", "cluster_label"), "id")
    order = Window.partitionBy("cluster_id").orderBy("id")
    totals = rows.groupBy("cluster_id").agg(F.count("*").alias("size"), F.max("cluster_label").alias("label"))
    first = rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= shown)
    names = first.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "canonical_name"))), lambda x: x["canonical_name"]).alias("names"))
    return totals.join(names, "cluster_id").select("cluster_id", "label", "size", F.array_join("names", ", ").alias("names"))


def merge_candidates(nodes: DataFrame, as_of: Column, days: float, limit: int = 5) -> DataFrame:
    """(keep_id, drop_id, keep_name, drop_name): the first pairs of recent nodes of one type that share a word.

    Pairs are ordered by creation of the older, then of the newer node. Only
    the first limit + 1 nodes of each (type, word) can be in the first `limit`
    pairs, so nothing quadratic is built.
    """
    since = F.date_trunc("day", as_of - F.make_dt_interval(F.lit(int(days))))
    recent = nodes.filter(F.col("created_at") >= since).select("id", "type", "canonical_name", "created_at", F.explode(F.array_distinct(F.split("canonical_name", " "))).alias("word")).filter("word != ''")
    order = Window.partitionBy("type", "word").orderBy("created_at", "id")
    first = recent.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= limit + 1)
    a = first.select("type", "word", F.col("id").alias("keep_id"), F.col("canonical_name").alias("keep_name"), F.struct("created_at", "id").alias("ka"))
    b = first.select("type", "word", F.col("id").alias("drop_id"), F.col("canonical_name").alias("drop_name"), F.struct("created_at", "id").alias("kb"))
    pairs = a.join(b, ["type", "word"]).filter("ka < kb").groupBy("keep_id", "drop_id").agg(F.first("keep_name").alias("keep_name"), F.first("drop_name").alias("drop_name"), F.first("ka").alias("ka"), F.first("kb").alias("kb"))
    return pairs.orderBy("ka", "kb").limit(limit).select("keep_id", "drop_id", "keep_name", "drop_name")


def apply_merges(nodes: DataFrame, edges: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after merging each drop_id into its keep_id (pairs are few).

    Chains of merges end at the oldest node, however long they are. Of edges
    that become equal the smallest id stays; self-loops that arise are kept.
    """
    chosen = checkpointed(pairs.groupBy("drop_id").agg(F.min("keep_id").alias("keep_id")))
    for _ in range(chosen.count().bit_length()):  # each jump doubles the steps taken
        onward = chosen.select(F.col("drop_id").alias("keep_id"), F.col("keep_id").alias("root"))
        chosen = chosen.join(onward, "keep_id", "left").select("drop_id", F.coalesce("root", "keep_id").alias("keep_id"))
    s = chosen.select(F.col("drop_id").alias("_s"), F.col("keep_id").alias("_sk"))
    t = chosen.select(F.col("drop_id").alias("_t"), F.col("keep_id").alias("_tk"))
    moved = edges.join(s, edges["source_node"] == F.col("_s"), "left").join(t, edges["target_node"] == F.col("_t"), "left")
    moved = moved.withColumn("source_node", F.coalesce("_sk", "source_node")).withColumn("target_node", F.coalesce("_tk", "target_node")).select(*edges.columns)
    unique = moved.groupBy("source_node", "target_node", "relationship").agg(F.min_by(F.struct(*edges.columns), "id").alias("e")).select("e.*")
    return nodes.join(chosen.select(F.col("drop_id").alias("id")), "id", "left_anti"), unique
