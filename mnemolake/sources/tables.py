"""Tables of a memory: schemas, reading, creating, appending, and counts."""

from __future__ import annotations

import time
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Schemas of the memory tables, current version (fixed values).
SCHEMAS = {
    "sessions": "id bigint, started_at timestamp_ntz, ended_at timestamp_ntz, title string, summary string, rolling_summary string, message_count int, host_tag string",
    "messages": "id bigint, session_id bigint, turn int, role string, content string, created_at timestamp_ntz, token_estimate int",
    "chunks": "id bigint, session_id bigint, first_msg_id bigint, last_msg_id bigint, text string, created_at timestamp_ntz, embedding array<float>, embedding_model string, importance double",
    "fact_events": "id bigint, key string, value string, source string, ts timestamp_ntz, op string",
    "lesson_events": "seq bigint, text string, tag string, ts timestamp_ntz",
    "access_log": "fact_id bigint, ts timestamp_ntz",
    "fact_merges": "fact_id bigint, value string, ts timestamp_ntz",
    "chunk_vectors": "chunk_id bigint, embedding array<float>, embedding_model string",
    "graph_nodes": "id bigint, type string, canonical_name string, aliases array<string>, created_at timestamp_ntz, updated_at timestamp_ntz, importance double, confidence double, mention_count bigint, cluster_id bigint, cluster_label string",
    "graph_edges": "id bigint, source_node bigint, target_node bigint, relationship string, confidence double, importance double, weight double, created_at timestamp_ntz, last_seen timestamp_ntz, seen_count bigint, source_chunk_id bigint",
}


def table_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}.parquet"


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def stream_path(root: str, name: str) -> str:
    """Where a stream writes a table, one folder per batch."""
    return f"{root.rstrip('/')}/{name}.stream"


def _in_schema(df: DataFrame, name: str) -> DataFrame:
    wanted = StructType.fromDDL(SCHEMAS[name])
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted))


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table in its current schema: missing columns (older files) are null, a missing table is empty.

    What streams have written is part of it. Only the columns that a query needs are read.
    """
    parts = [p for p in (table_path(root, name), stream_path(root, name)) if path_exists(spark, p)]
    found = [_in_schema(spark.read.option("mergeSchema", "true").parquet(p), name) for p in parts]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], SCHEMAS[name])


def unreadable(error: Exception) -> bool:
    """Whether an error says that files of a table are no parquet files, and not that a service failed."""
    return any(sign in str(error) for sign in ("CANNOT_READ_FILE_FOOTER", "is not a Parquet file", "UNABLE_TO_INFER_SCHEMA", "CORRUPTED_FILE"))


def open_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """`read_table`, but a table of unreadable files is set aside as `<path>.corrupt-<time>` and starts empty; other errors are raised."""
    try:
        df = read_table(spark, root, name)
        df.limit(1).count()
        return df
    except (PySparkException, Py4JError) as error:
        if not unreadable(error):
            raise
        jvm, path = spark._jvm, table_path(root, name)
        old = jvm.org.apache.hadoop.fs.Path(path)
        old.getFileSystem(spark._jsc.hadoopConfiguration()).rename(old, jvm.org.apache.hadoop.fs.Path(f"{path}.corrupt-{int(time.time())}"))
        return spark.createDataFrame([], SCHEMAS[name])


def append_rows(df: DataFrame, root: str, name: str) -> None:
    """Appends rows in the table's schema."""
    _in_schema(df, name).write.mode("append").parquet(table_path(root, name))


def write_batch(df: DataFrame, root: str, name: str, batch_id: int) -> None:
    """Writes a stream batch's rows of a table into the batch's own folder: written again, they replace themselves."""
    _in_schema(df, name).write.mode("overwrite").parquet(f"{stream_path(root, name)}/batch={batch_id}")


def replace_table(df: DataFrame, root: str, name: str) -> None:
    """Replaces a small table, which `df` may be made from: written beside it, then renamed."""
    spark, path = df.sparkSession, table_path(root, name)
    _in_schema(df, name).write.mode("overwrite").parquet(f"{path}.new")
    place = spark._jvm.org.apache.hadoop.fs.Path
    files = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for old in (path, stream_path(root, name)):
        files.delete(place(old), True)
    files.rename(place(f"{path}.new"), place(path))


def table_bytes(spark: SparkSession, root: str, name: str) -> int:
    """Bytes of a table's files."""
    total = 0
    for path in (table_path(root, name), stream_path(root, name)):
        if path_exists(spark, path):
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            total += place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()
    return total


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows) of each table."""
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows") for n, df in tables.items()))


def pending_embeddings(chunks: DataFrame, limit: int = 200) -> DataFrame:
    """The first chunks without a vector, by id."""
    return chunks.filter("embedding is null").orderBy("id").limit(limit)
