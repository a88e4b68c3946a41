"""Neighbour and running values over one key's rows, without gathering a hot key in one task.

A plain window over a key puts all its rows in one task, which is right as long
as no key is large; `bucket_if_hot` measures that. For hot keys the rows are cut
into time buckets: windows run within (key, bucket), and what crosses a
bucket's border is taken from a summary of one row per key and bucket, so the
largest group is one bucket's rows, or one key's buckets. Either way gives the
same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed

#: Rows of one key from which its rows are spread over buckets.
HOT_ROWS = 1_000_000


def bucket_if_hot(df: DataFrame, keys: list[str], bucket: Column | list[Column], hot_rows: int = HOT_ROWS) -> Column | None:
    """None if no key has more than `hot_rows` rows; else the first bucket that cuts all keys below that, or the last one.

    Finer buckets are measured only where a coarser one leaves too many rows together.
    """
    buckets = bucket if isinstance(bucket, list) else [bucket]

    def most(*more: Column) -> int:
        return df.groupBy(*keys, *more).count().agg(F.max("count")).head()[0] or 0

    if most() <= hot_rows:
        return None
    return next((b for b in buckets[:-1] if most(b.alias("_b")) <= hot_rows), buckets[-1])


def with_neighbour(df: DataFrame, keys: list[str], order: list[str], bucket: Column | None, cols: dict[str, str], *, following: bool = False) -> DataFrame:
    """Adds, under the names that are the values of `cols`, the columns of the row before (or after) in order.

    `order` must be unique and not null within a key, and `bucket` must not
    decrease along it. The first (last) row of a key gets nulls.
    """
    if bucket is None:
        whole = Window.partitionBy(*keys).orderBy(*order)
        move = F.lead if following else F.lag
        return df.select("*", *(move(c).over(whole).alias(n) for c, n in cols.items()))
    df = checkpointed(df.withColumn("_bucket", bucket))
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    packed = F.struct(*(F.col(c).alias(n) for c, n in cols.items()))
    step = F.lead if following else F.lag
    edge = F.max_by if not following else F.min_by
    local = df.withColumn("_near", step(packed).over(within))
    summary = df.groupBy(*keys, "_bucket").agg(edge(packed, F.struct(*order)).alias("_edge"))
    across = Window.partitionBy(*keys).orderBy("_bucket")
    summary = summary.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_bucket").alias("_b"), step("_edge").over(across).alias("_far"))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_bucket") == F.col("_b")]
    joined = local.join(summary, on, "left")
    value = F.coalesce("_near", "_far")
    return joined.select(*(c for c in df.columns if c != "_bucket"), *(value[n].alias(n) for n in cols.values()))


def with_running_sum(df: DataFrame, keys: list[str], order: list[str], bucket: Column | None, value: Column, name: str) -> DataFrame:
    """Adds the sum of `value` over the rows before this one (without it) in order."""
    if bucket is None:
        whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.coalesce(F.sum(value).over(whole), F.lit(0)))
    df = checkpointed(df.withColumn("_bucket", bucket).withColumn("_value", value))
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("_here", F.coalesce(F.sum("_value").over(within), F.lit(0)))
    summary = df.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_part"))
    summary = summary.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_part").over(across), F.lit(0)).alias("_before"))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_bucket") == F.col("_b")]
    joined = local.join(summary, on, "left")
    return joined.select(*(c for c in df.columns if not c.startswith("_")), (F.col("_here") + F.col("_before")).alias(name))
