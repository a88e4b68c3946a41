"""Evaluation texts that leak into training texts, found by winnowing.

Both sides are cut into words, hashed as k-grams, and reduced to the minimum
hash of every window of `w` consecutive k-grams. Any span of
`k + w - 1` words that a document shares with an item has one whole window in
common, so at least one fingerprint of it is kept on both sides: the search
misses nothing of that length. Fingerprint hits are extended along their
diagonal to the whole run of equal words.

The items' fingerprints are broadcast to the scan only when their measured
size is under `broadcast_bytes`; beyond it the two fingerprint tables are
joined with a shuffle and the hits are extended in a second scan.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..workers import map_batches
from .tokens import _quoted
from .words import grams, text_segments, words

SPAN_WORDS = 25
GRAM_WORDS = 8
BROADCAST_BYTES = 64 << 20


def winnow(hashes: np.ndarray, doc: np.ndarray, k: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and k-gram hashes of the window minima of every row with at least `span` words.

    All positions that hold a window's minimum are kept, so ties cannot
    separate two copies of a span.
    """
    w = span - k + 1
    g = grams(hashes, k)
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = g
    size = 1
    while size < w:  # sliding minimum by doubling
        step = min(size, w - size)
        least = np.minimum(least[: len(least) - step], least[step:])
        size += step
    whole = doc[:n] == doc[span - 1 : span - 1 + n]
    keep = np.zeros(len(g), bool)
    for j in range(w):
        keep[j : j + n] |= whole & (g[j : j + n] == least)
    at = np.flatnonzero(keep)
    return at, g[at]


def longest_run(a: np.ndarray, b: np.ndarray, shift: int) -> int:
    """The longest run of equal entries a[i] == b[i - shift]."""
    lo, hi = max(0, shift), min(len(a), len(b) + shift)
    if hi <= lo:
        return 0
    same = a[lo:hi] == b[lo - shift : hi - shift]
    breaks = np.flatnonzero(~same)
    return int(np.diff(np.r_[-1, breaks, len(same)]).max() - 1)


class ItemIndex:
    """Word hashes and sorted fingerprints of the evaluation items."""

    def __init__(self, ids: list, texts: list[str | None], k: int, span: int):
        self.ids, self.k, self.span = ids, k, span
        hashes, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for first, _, data, offsets in text_segments(pa.array(texts, pa.string())):
            h, d, _, _ = words(data, offsets)
            hashes.append(h)
            docs.append(d + first)
        self.hashes, doc = np.concatenate(hashes), np.concatenate(docs)
        self.bounds = np.searchsorted(doc, np.arange(len(ids) + 1))
        at, g = winnow(self.hashes, doc, k, span)
        order = np.argsort(g, kind="stable")
        self.prints, self.at = g[order], at[order]
        self.item = doc[self.at]

    def hits(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (index into g, index into the fingerprints) with equal hashes."""
        lo, hi = np.searchsorted(self.prints, g, "left"), np.searchsorted(self.prints, g, "right")
        counts = hi - lo
        left = np.repeat(np.arange(len(g)), counts)
        if not len(left):
            return left, left
        right = np.repeat(lo - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(len(left))
        return left, right

    def search(self, h: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row index, item index, longest shared run) of rows and items that share a span."""
        at, g = winnow(h, doc, self.k, self.span)
        left, right = self.hits(g)
        if not len(left):
            return
        row, item = doc[at[left]], self.item[right]
        begin = np.searchsorted(doc, row)
        shift = (at[left] - begin) - (self.at[right] - self.bounds[item])
        todo = np.unique(np.stack([row, item, shift], 1), axis=0)
        best: dict[tuple[int, int], int] = {}
        for r, i, s in todo.tolist():
            lo, hi = np.searchsorted(doc, r), np.searchsorted(doc, r, "right")
            run = longest_run(h[lo:hi], self.hashes[self.bounds[i] : self.bounds[i + 1]], s)
            if run >= self.span and run > best.get((r, i), 0):
                best[r, i] = run
        for (r, i), run in best.items():
            yield r, i, run


_indexes: dict[str, ItemIndex] = {}


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", *, span_words: int = SPAN_WORDS, gram_words: int = GRAM_WORDS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, shared_words) of documents and items that share `span_words` consecutive words.

    `shared_words` is the longest shared run. Rows are distinct by both ids if
    the input ids are; repeated input rows repeat their result. Null and empty
    texts share nothing. Texts of fewer than `span_words` words never match.
    """
    doc_type = documents.schema[doc_id].dataType.simpleString()
    item_type = items.schema[item_id].dataType.simpleString()
    schema = f"{_quoted(doc_id)} {doc_type}, {_quoted(item_id)} {item_type}, shared_words int"
    docs = documents.select(F.col(_quoted(doc_id)), F.col(_quoted(text_col)).cast("string"))
    tests = items.select(F.col(_quoted(item_id)).alias("item"), F.col(_quoted(text_col)).cast("string").alias("text"))
    size = tests.agg(F.sum(F.octet_length("text") * 8 + 64)).head()[0] or 0
    if size > broadcast_bytes:
        return _by_shuffle(docs, tests, doc_id, item_id, schema, span_words, gram_words)
    rows = tests.collect()  # at most broadcast_bytes by the check above
    ids, texts = [r.item for r in rows], [r.text for r in rows]
    item_arrow = to_arrow_type(items.schema[item_id].dataType)
    shared = documents.sparkSession.sparkContext.broadcast((ids, texts))

    token = uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _indexes:  # built once per worker process; only the last one is kept
            _indexes.clear()
            _indexes[token] = ItemIndex(*shared.value, gram_words, span_words)
        index = _indexes[token]
        for batch in batches:
            doc_out, item_out, run_out = [], [], []
            for first, _, data, offsets in text_segments(batch.column(1)):
                h, doc, _, _ = words(data, offsets)
                for row, item, run in index.search(h, doc):
                    doc_out.append(first + row)
                    item_out.append(index.ids[item])
                    run_out.append(run)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc_out, pa.int64())), pa.array(item_out, item_arrow), pa.array(run_out, pa.int32())], [doc_id, item_id, "shared_words"])

    return map_batches(docs, scan, schema)


def _by_shuffle(docs: DataFrame, tests: DataFrame, doc_id: str, item_id: str, schema: str, span: int, k: int) -> DataFrame:
    """The same result for item sets of any size: fingerprints are joined, hits are extended afterwards."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_segments(batch.column(1)):
                h, doc, _, _ = words(data, offsets)
                at, g = winnow(h, doc, k, span)
                begin = np.searchsorted(doc, doc[at])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc[at] + first)), pa.array(g.view(np.int64)), pa.array((at - begin).astype(np.int32))], ["id", "print", "pos"])

    def word_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_segments(batch.column(1)):
                h, doc, _, _ = words(data, offsets)
                bounds = np.searchsorted(doc, np.arange(last - first + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), lists], ["id", "words"])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, i, shift, dw, iw = (batch.column(c) for c in range(5))
            runs = [longest_run(dw[r].values.to_numpy(), iw[r].values.to_numpy(), shift[r].as_py()) for r in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([d, i, pa.array(runs, pa.int32())], [doc_id, item_id, "shared_words"])

    d_type, i_type = docs.dtypes[0][1], tests.dtypes[0][1]
    left = map_batches(docs, prints, f"id {d_type}, print bigint, pos int").withColumnsRenamed({"id": "d", "pos": "dp"})
    right = map_batches(tests, prints, f"id {i_type}, print bigint, pos int").withColumnsRenamed({"id": "i", "pos": "ip"})
    pairs = left.join(right, "print").select("d", "i", (F.col("dp") - F.col("ip")).alias("shift")).distinct()
    dw = map_batches(docs, word_arrays, f"id {d_type}, words array<bigint>").withColumnsRenamed({"id": "d", "words": "dw"})
    iw = map_batches(tests, word_arrays, f"id {i_type}, words array<bigint>").withColumnsRenamed({"id": "i", "words": "iw"})
    hits = map_batches(pairs.join(dw, "d").join(iw, "i").select("d", "i", "shift", "dw", "iw"), extend, schema)
    a, b = (_quoted(c) for c in (doc_id, item_id))
    return hits.filter(F.col("shared_words") >= span).groupBy(F.col(a), F.col(b)).agg(F.max("shared_words").alias("shared_words"))
