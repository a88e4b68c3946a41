"""The maintenance sweep: decay, merging of contradictions and duplicates, clusters, caps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..config import Settings
from . import graph
from .extraction import complete
from .facts import recent_contradictions, with_decay


@dataclass
class Consolidated:
    """The tables after a sweep, and what changed: `archived` facts (id) and `merged` ones (fact_id, value)."""

    versions: DataFrame
    nodes: DataFrame
    edges: DataFrame
    clusters: DataFrame
    archived: DataFrame
    merged: DataFrame

    def stats(self) -> dict[str, int]:
        return {"archived": self.archived.count(), "nodes": self.nodes.count(), "edges": self.edges.count(), "clusters": self.clusters.select("cluster_id").distinct().count()}


def merged_values(versions: DataFrame, as_of: Column, call: Callable[[str], str | None], settings: Settings = Settings()) -> DataFrame:
    """(fact_id, value): a model's merged value for the new side of each recent contradiction.

    A merged value counts if it is not empty, differs and has under 200 characters.
    """
    pairs = recent_contradictions(versions, as_of, settings)
    prompt = F.concat(F.lit("Key: "), "key", F.lit("\nOLD: "), "old_value", F.lit("\nNEW: "), "new_value")
    answers = complete(pairs.withColumn("prompt", prompt), call).filter("completion != '' and completion != new_value and char_length(completion) < 200")
    return answers.groupBy(F.col("new_id").alias("fact_id")).agg(F.max("completion").alias("value"))


def with_merged_values(versions: DataFrame, merged: DataFrame) -> DataFrame:
    """Versions whose values are replaced in place by (fact_id, value)."""
    latest = merged.select("fact_id", F.col("value").alias("_merged"))
    return versions.join(latest, versions["id"] == F.col("fact_id"), "left").withColumn("value", F.coalesce("_merged", "value")).drop("fact_id", "_merged")


def label_clusters(nodes: DataFrame, members: DataFrame, call: Callable[[str], str | None]) -> DataFrame:
    """(cluster_id, label) by a model from up to 12 names of the clusters in which a node has no label; a label has 1 to 60 characters without quotes around it."""
    unnamed = members.join(nodes.filter("coalesce(cluster_label, '') = ''").select("id"), "id", "left_semi").select("cluster_id").distinct()
    listed = graph.cluster_listing(nodes, members.join(unnamed, "cluster_id", "left_semi"))
    answers = complete(listed.select("cluster_id", F.col("names").alias("prompt")), call)
    label = F.regexp_replace(F.trim("completion"), r"\A[\"']+|[\"'.]+\z", "")
    return answers.select("cluster_id", label.alias("label")).filter("char_length(label) between 1 and 60")


def consolidate(versions: DataFrame, nodes: DataFrame, edges: DataFrame, as_of: Column, settings: Settings = Settings(), call: Callable[[str], str | None] | None = None) -> Consolidated:
    """One sweep in order: facts fade, contradictions merge, the graph fades and is cut to its caps, duplicates merge, clusters form and are stamped and named.

    The merging and naming steps need `call` (prompt -> completion); without it, or when it fails, they do nothing.
    What a model has said is kept in checkpoints, so it is asked once.
    """
    archived = with_decay(versions.filter("invalidated_at is null"), as_of, settings).filter("archived").select("id")
    merged = versions.sparkSession.createDataFrame([], "fact_id bigint, value string")
    if call is not None:
        merged = checkpointed(merged_values(versions, as_of, call, settings))
        versions = with_merged_values(versions, merged)
    nodes, edges = graph.decayed(nodes, edges, as_of, settings)
    if call is not None:
        pairs = graph.merge_candidates(nodes, as_of, settings.graph_review_days)
        prompt = F.concat(F.lit("Do these two labels name the same thing? Answer yes or no.\nA: "), "keep_name", F.lit("\nB: "), "drop_name")
        agreed = checkpointed(complete(pairs.withColumn("prompt", prompt), call).filter("lower(completion) like 'y%'").select("keep_id", "drop_id"))
        nodes, edges = graph.apply_merges(nodes, edges, agreed)
    nodes, edges = (checkpointed(x) for x in graph.capped(nodes, edges, settings))
    members = checkpointed(graph.clusters(nodes, edges))
    labels = checkpointed(label_clusters(nodes, members, call)) if call is not None else None
    return Consolidated(versions, graph.stamped(nodes, members, labels), edges, members, archived, merged)
