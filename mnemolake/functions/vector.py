"""Vectors: cosine by blocks, and a deterministic hashing embedder."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workers import map_batches

BROADCAST_BYTES = 128 << 20
#: The name of `hash_embedding`'s vectors.
HASH_MODEL = "hash-64"
#: What is taken off the ends of a word before it is hashed (fixed value).
PUNCTUATION = ".,!?')(\""


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the shorter length in double precision; 0 if a norm is 0. For few pairs; see `cosine_top`."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)

    def norm(c: Column) -> Column:
        return F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))

    length = norm(a) * norm(b)
    return F.when(length == 0, 0.0).otherwise(dot / length)


def usable_vector(c: Column, dim: int | None = None) -> Column:
    """Whether a vector is not null, of `dim` finite values, and not all zero."""
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= 3.4028235e38)) & F.exists(c, lambda x: x != 0)
    return F.coalesce(fine & ((F.size(c) == dim) if dim else (F.size(c) > 0)), F.lit(False))


def cosine_top(queries: DataFrame, rows: DataFrame, k: int = 20, *, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(query_id, id, cosine, rank): the k most similar rows of each query, exactly.

    `queries` needs query_id, grp, vec; `rows` needs id, grp, vec; only equal
    groups are compared. Vectors must be usable and of one length. Ties (at 12
    digits) go to the larger id. The query set is sent to every task in
    blocks of at most `broadcast_bytes` (its size is measured); each task
    keeps k per query, so the shuffle is k rows a query and task.
    """
    spark = rows.sparkSession
    size = queries.agg(F.count("*"), F.max(F.size("vec"))).head()
    blocks = max(1, -(-(size[0] * ((size[1] or 0) * 8 + 64)) // broadcast_bytes))
    found = None
    for b in range(blocks):
        part = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select(F.col("query_id").cast("bigint"), F.col("grp").cast("string"), F.col("vec").cast("array<double>"))
        held = part.toPandas()  # at most about broadcast_bytes by the count above
        groups = {g: (p["query_id"].to_numpy(np.int64), _unit(np.stack(p["vec"].to_numpy()))) for g, p in held.groupby("grp")}
        sent = spark.sparkContext.broadcast(groups)
        one = map_batches(rows.select(F.col("id").cast("bigint"), F.col("grp").cast("string"), F.col("vec").cast("array<double>")), _scan(sent, k), "query_id bigint, id bigint, cosine double")
        found = one if found is None else found.unionByName(one)
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.round("cosine", 12).desc(), F.col("id").desc())
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _scan(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            names = pd.Series(batch.column(1).to_pylist())
            ids = batch.column(0).to_numpy()
            x = _unit(np.stack(batch.column(2).to_numpy(zero_copy_only=False)).astype(np.float64))
            for g, at in names.groupby(names).groups.items():
                if g not in sent.value:
                    continue
                q, mine, own = sent.value[g][1], ids[at], x[at]
                for lo in range(0, len(q), 256):
                    s = np.round(q[lo : lo + 256] @ own.T, 12)
                    held = best.get((g, lo))
                    # Only what reaches the k-th best of this batch and of what is held is sorted.
                    bar = -np.partition(-s, k - 1, axis=1)[:, k - 1] if s.shape[1] > k else np.full(len(s), -2.0)
                    if held is not None:
                        bar = np.maximum(bar, held[3])
                    i, j = np.divmod(np.flatnonzero(s >= bar[:, None]), s.shape[1])
                    row, cand, score = i, mine[j], s[i, j]
                    if held is not None:
                        row, cand, score = np.r_[held[0], row], np.r_[held[1], cand], np.r_[held[2], score]
                    order = np.lexsort((-cand, -score, row))
                    row, cand, score = row[order], cand[order], score[order]
                    place = np.arange(len(row)) - np.searchsorted(row, row)
                    keep = place < k
                    bar = np.full(len(s), -2.0)
                    bar[row[place == k - 1]] = score[place == k - 1]
                    best[g, lo] = row[keep], cand[keep], score[keep], bar
        for (g, lo), (row, cand, score, _) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(sent.value[g][0][lo + row]), pa.array(cand), pa.array(score)], ["query_id", "id", "cosine"])

    return run


def hash_embedding(text: str | None, dim: int = 64) -> list[float] | None:
    """A bag of word beginnings (5 characters of words without outer punctuation, 3 or more), each in the bucket of its MD5, of length 1.

    Null for a null text; zeros for a text without such words.
    """
    if text is None:
        return None
    v = np.zeros(dim)
    begins = (word.strip(PUNCTUATION)[:5] for word in text.lower().split())
    for begin in begins:
        if len(begin) >= 3:
            v[int.from_bytes(hashlib.md5(begin.encode()).digest()) % dim] += 1
    length = math.sqrt(float((v * v).sum()))
    return (v / (length or 1.0)).tolist()


def embed_texts(df: DataFrame, id_col: str, text_col: str, embed=hash_embedding) -> DataFrame:
    """(id, embedding array<float>) by any text -> list function; a failing text has a null vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                try:
                    out.append(embed(text))
                except Exception:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float32()))], [id_col, "embedding"])

    return map_batches(df.select(id_col, F.col(text_col).cast("string")), run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, embedding array<float>")
