"""What a language model returns: prompts out, defensive parsing back in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import canonical_name, json_object, strip
from ..workers import map_batches
from .graph import ENTITY_TYPES, upsert_edges, upsert_nodes


def complete(prompts: DataFrame, call: Callable[[str], str | None], prompt_col: str = "prompt") -> DataFrame:
    """`prompts` with `completion`; an exception or None is an empty completion. `call` runs on the workers."""
    schema = T.StructType([*prompts.schema.fields, T.StructField("completion", T.StringType())])
    at = prompts.columns.index(prompt_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for prompt in batch.column(at).to_pylist():
                try:
                    out.append((call(prompt) or "").strip())
                except Exception:
                    out.append("")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "completion"])

    return map_batches(prompts, run, schema)


def extraction_prompt(user: Column, assistant: Column) -> Column:
    """What the extraction sees of an exchange: the user's text and 400 characters of the reply."""
    return F.concat(F.lit("User said: "), user, F.lit("\nAssistant replied: "), F.left(assistant, F.lit(400)))


def payloads(outputs: DataFrame) -> DataFrame:
    """(id, source_chunk_id, payload) of completions that hold a JSON object; those that begin with NONE hold none."""
    text = strip(F.col("completion"))
    body = F.when(~F.upper(text).startswith("NONE"), json_object(text))
    chunk = F.col("source_chunk_id") if "source_chunk_id" in outputs.columns else F.lit(None).cast("bigint")
    rows = outputs.select("id", chunk.alias("source_chunk_id"), body.alias("payload"))
    return rows.filter(F.try_parse_json("payload").isNotNull() & F.col("payload").isNotNull())


def parsed_facts(outputs: DataFrame) -> DataFrame:
    """(id, key, value) of the scalar facts; a flat object without `facts` is the facts itself."""
    rows = payloads(outputs)
    facts = F.coalesce(F.get_json_object("payload", "$.facts"), F.col("payload"))
    pairs = rows.select("id", F.explode(F.from_json(facts, "MAP<STRING,VARIANT>")).alias("key", "value"))
    scalar = ~F.schema_of_variant("value").rlike("^(ARRAY|OBJECT|VOID)")
    return pairs.filter(F.col("value").isNotNull() & scalar).select("id", "key", F.col("value").cast("string").alias("value"))


def parsed_entities(outputs: DataFrame) -> DataFrame:
    """(id, pos, type, name) of the entities with a name; items of another shape are skipped one by one."""
    rows = payloads(outputs).select("id", F.posexplode(F.from_json(F.get_json_object("payload", "$.entities"), "ARRAY<STRING>")).alias("pos", "item"))
    name, kind = F.get_json_object("item", "$.name"), F.get_json_object("item", "$.type")
    return rows.select("id", "pos", F.coalesce(kind, F.lit("entity")).alias("type"), name.alias("name")).filter("name is not null and trim(name) != ''")


def parsed_relationships(outputs: DataFrame) -> DataFrame:
    """(id, pos, source, relation, target, source_chunk_id) of the complete relationships."""
    rows = payloads(outputs).select("id", "source_chunk_id", F.posexplode(F.from_json(F.get_json_object("payload", "$.relationships"), "ARRAY<STRING>")).alias("pos", "item"))
    parts = {c: F.get_json_object("item", f"$.{c}") for c in ("source", "relation", "target")}
    out = rows.select("id", "pos", *(v.alias(k) for k, v in parts.items()), "source_chunk_id")
    return out.filter(" and ".join(f"{c} is not null and trim({c}) != ''" for c in parts))


def graph_of(outputs: DataFrame, nodes: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """What completions say of the graph, as (nodes, edges) in the form of the upserts.

    An end of a relationship is the entity that the same completion names so,
    else it is mentioned as one of type `entity`. A node's id follows from type
    and name, or is the stored one, so the same completion twice adds counts but no nodes.
    """
    kind = F.when(F.col("type").isin(*ENTITY_TYPES), F.col("type")).otherwise("entity")
    said = parsed_entities(outputs).select("id", kind.alias("type"), "name", canonical_name(F.col("name")).alias("canonical_name")).filter("canonical_name != ''")
    links = parsed_relationships(outputs).withColumn("_s", canonical_name(F.col("source"))).withColumn("_t", canonical_name(F.col("target"))).filter("_s != '' and _t != ''")
    ends = links.select("id", F.explode(F.array(F.struct(F.col("source").alias("name"), F.col("_s").alias("canonical_name")), F.struct(F.col("target").alias("name"), F.col("_t").alias("canonical_name")))).alias("e")).select("id", "e.*")
    own = said.groupBy("id", "canonical_name").agg(F.min("type").alias("own"))
    typed = ends.join(own, ["id", "canonical_name"], "left").withColumn("type", F.coalesce("own", F.lit("entity")))
    new = typed.filter("own is null").select("id", "type", "name", "canonical_name")
    node_id = F.abs(F.xxhash64("type", "canonical_name") % (1 << 62))
    stored_id = nodes.groupBy("type", "canonical_name").agg(F.min("id").alias("stored_id"))
    mentions = said.unionByName(new).join(stored_id, ["type", "canonical_name"], "left")
    mentions = mentions.select(F.coalesce("stored_id", node_id).alias("mention_id"), "type", "name", F.lit(0.5).alias("confidence"), F.lit(1).cast("bigint").alias("mentions"), as_of.alias("ts"))
    placed = typed.join(stored_id, ["type", "canonical_name"], "left").groupBy("id", "canonical_name").agg(F.min(F.coalesce("stored_id", node_id)).alias("node"))
    s, t = (placed.select("id", F.col("canonical_name").alias(c), F.col("node").alias(n)) for c, n in (("_s", "source_node"), ("_t", "target_node")))
    edges = links.join(s, ["id", "_s"]).join(t, ["id", "_t"])
    edge_id = F.abs(F.xxhash64("source_node", "target_node", F.lower("relation")) % (1 << 62))
    edges = edges.select(edge_id.alias("mention_id"), "source_node", "target_node", F.col("relation").alias("relationship"), F.lit(0.5).alias("confidence"), F.lit(1).cast("bigint").alias("mentions"), as_of.alias("created_at"), as_of.alias("last_seen"), "source_chunk_id")
    return upsert_nodes(mentions), upsert_edges(edges)


def rolling_prompt(previous: Column, turns: Column) -> Column:
    """What the summary of evicted turns sees: the earlier summary, then 200 characters of either side of each turn."""
    lines = F.transform(turns, lambda t: F.concat(F.lit("User: "), F.left(t["user"], F.lit(200)), F.lit("\nAssistant: "), F.left(t["assistant"], F.lit(200))))
    head = F.when(F.coalesce(previous, F.lit("")) != "", F.array(F.concat(F.lit("Earlier summary: "), previous))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(head, lines), "\n\n")


def session_prompts(messages: DataFrame) -> DataFrame:
    """(session_id, prompt): the last 12 user texts, 160 characters each, of sessions with at least 2."""
    from pyspark.sql import Window

    from .sessions import clean_messages

    rows = clean_messages(messages).filter("role = 'user'").select("session_id", "id", "content")
    newest = Window.partitionBy("session_id").orderBy(F.col("id").desc())
    tail = rows.withColumn("back", F.row_number().over(newest)).filter("back <= 12")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("id", F.concat(F.lit("- "), F.left("content", F.lit(160))).alias("line")))), lambda x: x["line"])
    return tail.groupBy("session_id").agg(F.count("*").alias("n"), F.array_join(lines, "\n").alias("prompt")).filter("n >= 2").drop("n")
