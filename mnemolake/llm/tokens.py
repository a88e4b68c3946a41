"""Encoding of whole texts by a byte-level BPE vocabulary.

The vocabulary is read, never trained. Each Arrow batch is cut into the
pre-tokens of the vocabulary's pattern; the distinct ones that are new to the
worker are encoded together through a *pair occurrence index*: a map from each
mergeable pair to all its positions in the batch. Active merge ranks are taken
in ascending order from a heap, all occurrences of one rank are merged at
once, and only the lists of the neighbouring pairs change. Ids are gathered
into Arrow lists with NumPy; no text is ever encoded twice per worker while
its pre-tokens are known.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workers import map_batches

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Pre-tokens known to a worker; beyond it they are forgotten and encoded anew.
KNOWN_LIMIT = 400_000

# The pre-token pattern of the vocabulary, with Unicode's White_Space written out.
_WS = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Merges and ids of a byte-level BPE vocabulary file, and a worker's known pre-tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids, alphabet = model["vocab"], byte_alphabet()
        self.byte_id = [0] * 256
        for shown, b in alphabet.items():
            self.byte_id[b] = ids[shown]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[a] << 32 | ids[b]] = (rank, ids[a + b])
        self._ascii = re.compile(ASCII_PATTERN).findall
        self._any = regex.compile(PATTERN).findall
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.token_ids = np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)

    def pretokens(self, text: str) -> list[str]:
        return self._ascii(text) if text.isascii() else self._any(text)

    def merge_all(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each piece, all pieces together through one pair occurrence index."""
        merges, byte_id = self.merges, self.byte_id
        symbol: list[int] = []
        bounds = [0]
        for p in pieces:
            symbol.extend([byte_id[b] for b in p.encode("utf-8")])
            symbol.append(-1)  # ends the piece; no pair spans it
            bounds.append(len(symbol))
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        where: dict[int, list[int]] = {}
        ranks: dict[int, int] = {}  # active rank -> pair
        for i in range(n - 1):
            a, b = symbol[i], symbol[i + 1]
            if a >= 0 and b >= 0:
                pair = a << 32 | b
                if pair in merges:
                    if pair in where:
                        where[pair].append(i)
                    else:
                        where[pair] = [i]
        heap = []
        for pair in where:
            rank = merges[pair][0]
            ranks[rank] = pair
            heap.append(rank)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            pair = ranks.pop(rank)
            a, b, new = pair >> 32, pair & 0xFFFFFFFF, merges[pair][1]
            positions = where.pop(pair)
            positions.sort()  # overlapping occurrences merge from the left
            for i in positions:
                if symbol[i] != a:
                    continue
                j = after[i]
                if symbol[j] != b:
                    continue
                symbol[i], symbol[j] = new, -2
                k = after[j]
                after[i], before[k] = k, i
                right = symbol[k]
                if right >= 0:
                    other = new << 32 | right
                    if other in merges:
                        if other in where:
                            where[other].append(i)
                        else:
                            where[other] = [i]
                            r = merges[other][0]
                            ranks[r] = other
                            heapq.heappush(heap, r)
                h = before[i]
                left = symbol[h] if h >= 0 else -1
                if left >= 0:
                    other = left << 32 | new
                    if other in merges:
                        if other in where:
                            where[other].append(h)
                        else:
                            where[other] = [h]
                            r = merges[other][0]
                            ranks[r] = other
                            heapq.heappush(heap, r)
        return [[s for s in symbol[bounds[i] : bounds[i + 1] - 1] if s >= 0] for i in range(len(pieces))]

    def _learn(self, fresh: list[str]) -> None:
        encoded = self.merge_all(fresh)
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        flat = np.fromiter((x for e in encoded for x in e), np.int32, int(sizes.sum()))
        self.starts = np.concatenate([self.starts, len(self.token_ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.token_ids = np.concatenate([self.token_ids, flat])

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        """A list of ids for each text; empty for empty and null texts."""
        if len(self.known) > KNOWN_LIMIT:
            self.forget()
        known, fresh, cut = self.known, [], []
        counts = np.zeros(len(texts), np.int64)
        for row, text in enumerate(texts):
            if text:
                pieces = self.pretokens(text)
                counts[row] = len(pieces)
                for p in set(pieces).difference(known):
                    known[p] = len(known)
                    fresh.append(p)
                cut.append(np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces)))
        if fresh:
            self._learn(fresh)
        at = np.concatenate(cut) if cut else np.zeros(0, np.int64)
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        values = self.token_ids[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(total)] if total else np.zeros(0, np.int32)
        piece_ends = np.cumsum(counts)
        offsets = np.r_[0, np.r_[0, ends][piece_ends]].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, loaded once per worker process."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary_path: str = DEFAULT_VOCABULARY, chunk_rows: int = 1024) -> DataFrame:
    """(id, ids array<int>) of every row of `df`, without special tokens.

    Empty and null texts have the empty list. Null ids, repeated rows and extra
    columns are allowed; each input row gives one output row. The strings of
    special tokens are ordinary text. No shuffle takes place.
    """
    schema = f"{_quoted(id_col)} {df.schema[id_col].dataType.simpleString()}, ids array<int>"

    if os.path.exists(vocabulary_path):  # for executors that do not have it
        df.sparkSession.sparkContext.addFile(vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocabulary_path if os.path.exists(vocabulary_path) else SparkFiles.get(os.path.basename(vocabulary_path)))
        for batch in batches:
            for start in range(0, batch.num_rows, chunk_rows):
                part = batch.slice(start, chunk_rows)
                ids = vocab.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), ids], [id_col, "ids"])

    return map_batches(df.select(F.col(_quoted(id_col)), F.col(_quoted(text_col)).cast("string")), run, schema)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
