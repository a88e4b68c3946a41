"""The most similar vectors of every vector, by stable projections and a kd-tree.

Unit vectors are projected onto m random Gaussian directions (a 2-stable
projection: a pair at distance d is a projected distance of d * chi(m) apart).
The collection is spread over cells, those of the nearest of some centroids
that are fitted on a bounded sample; a vector near a border is also held by the
cells beyond it, the border's width being such that COPIES cells hold a vector
on average, however many cells there are. Each cell is a kd-tree over projected
space. In its own cell a query's projected neighbours are verified by their true
cosine, leaf by leaf in the order of their projected distance, until the
chi-square test says that no closer neighbour is left with the chosen
probability. The distance of the k-th best found bounds the true one: a query
for which a step of that length may lead past the width of a border, as in
sparse regions, visits the cells beyond, and goes on there from that distance
until the test holds again.

Verification is one product of a few hundred queries with a few leaves in single
precision, whose rounding error is far below MARGIN; what comes within it of the
k best is computed again in double precision.

Equal vectors are one class: only the k + 1 smallest ids of a class can be
among the answers, so copies cost nothing however many there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workers import map_batches, ship_package
from .tokens import _quoted

#: Rows of one cell, on average; a cell is searched by one task.
CELL_ROWS = 16_384
#: The sample on which the centroids of a group are fitted: rows for each wanted cell, at least and at most so many rows.
CELL_SAMPLE, LEAST_SAMPLE, MOST_SAMPLE = 32, 20_000, 250_000
#: Centroids up to which they are fitted at once; more are fitted in two levels.
FLAT_CENTROIDS = 256
#: Cells that hold a vector, on average, and sampled vectors by which the width of the borders is measured.
COPIES, BORDER_SAMPLE = 2.5, 2_000
#: Probability of the chi-square stopping test, and standard deviations of a step across a border within which cells are visited.
STOP_PROBABILITY, VISIT_DEVIATIONS = 0.985, 2.5
#: Least squared distance that is told from 0 in float32 projections, and by how much a float32 cosine may be off.
LEAST_SQUARE, MARGIN = 1e-6, 4e-6
_SEED = 20_240_601


def chi_square_quantile(p: float, m: int) -> float:
    """The p-quantile of the chi-square law with m degrees of freedom (Wilson-Hilferty)."""
    lo, hi = -10.0, 10.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (lo, mid)
    return m * (1 - 2 / (9 * m) + lo * math.sqrt(2 / (9 * m))) ** 3


def projections_needed(rows: int) -> int:
    """Directions that keep the unrelated vectors within the stopping radius about constant in number."""
    return max(8, min(24, math.ceil(math.log2(max(rows, 2)) - 4)))


def directions(dim: int, m: int) -> np.ndarray:
    return np.random.default_rng(_SEED).standard_normal((dim, m)).astype(np.float32)


def centroids(sample: np.ndarray, count: int, rounds: int = 10) -> np.ndarray:
    """`count` unit vectors, each in the middle of the sampled unit vectors that are nearest to it."""
    if count > FLAT_CENTROIDS:
        top = centroids(sample, math.ceil(math.sqrt(count)), rounds)
        own = _nearest(sample, top)
        parts = [sample[own == c] for c in range(len(top))]
        return np.concatenate([centroids(p, max(1, round(count * len(p) / len(sample))), rounds) for p in parts if len(p)])
    found = sample[np.random.default_rng(_SEED).permutation(len(sample))[:count]].copy()
    for _ in range(rounds if len(found) > 1 else 0):
        own = _nearest(sample, found)
        order = np.argsort(own, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(own[order]) > 0])
        middle = np.add.reduceat(sample[order], first, axis=0)
        length = np.linalg.norm(middle, axis=1, keepdims=True)
        found[own[order[first]]] = middle / np.maximum(length, 1e-9)
    return found


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The most similar centre of each row."""
    step = max(1, (4 << 20) // len(centres))
    return np.concatenate([(x[at : at + step] @ centres.T).argmax(1) for at in range(0, len(x), step)]) if len(x) else np.zeros(0, np.int64)


class Cells:
    """The cells of one group: centroids, and the blocks into which the rows of a crowded cell are spread; its visitors see all of them."""

    def __init__(self, sample: np.ndarray, rows: int, cell_rows: int):
        sample = np.unique(sample, axis=0)  # copies must not draw the centroids
        count = min(math.ceil(rows / cell_rows), max(1, len(sample) // CELL_SAMPLE))
        self.centres = centroids(sample, count) if count > 1 else sample[:1]
        own = _nearest(sample, self.centres)
        share = np.bincount(own, minlength=len(self.centres)) / max(1, len(sample))
        self.blocks = np.maximum(1, np.ceil(share * rows / (2 * cell_rows))).astype(np.int64)
        self.first = np.r_[0, np.cumsum(self.blocks)]
        #: Distances between centroids.
        self.apart = np.sqrt(np.maximum(2 - 2 * self.centres @ self.centres.T, 0)).astype(np.float32)
        some = sample[np.random.default_rng(_SEED).permutation(len(sample))[:BORDER_SAMPLE]]
        alike = some @ self.centres.T
        gaps = np.sort((alike.max(1, keepdims=True) - alike).ravel()) if len(some) else np.zeros(1, np.float32)
        #: The border's width: how much less similar a cell's centroid may be than the nearest one for the cell to hold a vector too.
        self.width = float(gaps[min(len(gaps) - 1, int(COPIES * len(some)))])

    def holders(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the cells that hold each row, its own among them."""
        rows, cells = [], []
        for at, alike in self._alike(unit):
            r, c = np.nonzero(alike.max(1, keepdims=True) - alike <= self.width)
            rows.append(r + at)
            cells.append(c)
        return np.concatenate(rows), np.concatenate(cells)

    def _alike(self, unit: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        step = max(1, (2 << 20) // len(self.centres))
        for at in range(0, max(1, len(unit)), step):
            yield at, unit[at : at + step] @ self.centres.T

    def own(self, unit: np.ndarray) -> np.ndarray:
        return _nearest(unit, self.centres)

    def visits(self, unit: np.ndarray, reach: np.ndarray, deviations: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the cells into which a step of length `reach` in a direction of chance may lead so far that the row's own cell does not hold its end.

        Such a step changes the difference of the similarities to two centroids
        by the normal law, with the deviation reach x their distance / sqrt(dim).
        """
        rows, cells = [], []
        for at, alike in self._alike(unit):
            own = alike.argmax(1)
            gap = alike[np.arange(len(own)), own][:, None] - alike
            r, c = np.nonzero(gap + self.width <= deviations / math.sqrt(unit.shape[1]) * reach[at : at + len(own), None] * self.apart[own])
            away = c != own[r]
            rows.append(r[away] + at)
            cells.append(c[away])
        return np.concatenate(rows), np.concatenate(cells)


def unit_rows(lists: pa.Array, dim: int) -> np.ndarray:
    """float64 unit vectors of a list array without nulls."""
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Block:
    """The rows of a cell in kd-tree leaves of projected space."""

    def __init__(self, x: np.ndarray, px: np.ndarray, leaf: int = 256):
        self.order = _leaf_order(px, leaf)
        self.x, px = x[self.order], px[self.order]
        self.single = self.x.astype(np.float32)
        self.starts = np.arange(0, len(x), leaf)
        self.ends = np.minimum(self.starts + leaf, len(x))
        self.low = np.stack([px[s:e].min(0) for s, e in zip(self.starts, self.ends)])
        self.high = np.stack([px[s:e].max(0) for s, e in zip(self.starts, self.ends)])

    def search(self, q: np.ndarray, pq: np.ndarray, k: int, stop: float, known: np.ndarray, chunk: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, cosine) of verified candidates that include each query's k best here above its `known` similarity.

        `known` is the k-th best similarity that a query has elsewhere, -1 if none.
        A query takes leaves, the nearest in projected space first, until the
        projected distance of the next one passes the test for its k-th best.
        """
        found: tuple[list, list, list] = ([], [], [])
        turn = _leaf_order(pq, chunk)
        for at in range(0, len(q), chunk):
            some = turn[at : at + chunk]
            for part, out in zip(self._search_some(q[some], pq[some], k, stop, known[some]), found):
                out.append(part if out is not found[0] else some[part])
        return tuple(np.concatenate(f) if f else np.zeros(0, kind) for f, kind in zip(found, (np.int64, np.int64, np.float64)))

    def _search_some(self, q: np.ndarray, p: np.ndarray, k: int, stop: float, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        single = q.astype(np.float32)
        gap = np.maximum(np.maximum(self.low[None] - p[:, None], p[:, None] - self.high[None]), 0)
        bound = np.einsum("ijk,ijk->ij", gap, gap)  # of each query's squared projected distance to a leaf's rows
        kth, todo, taken = known.copy(), np.ones(len(bound[0]), bool), 0
        i = j = np.zeros(0, np.int64)
        s = np.zeros(0, np.float32)
        active = np.arange(len(q))
        while True:
            radius = stop * np.maximum(2 - 2 * kth[active], LEAST_SQUARE)
            open_ = (bound[active] <= radius[:, None]) & todo
            keep = open_.any(1)
            active = active[keep]
            if not len(active):
                break
            wanted = np.flatnonzero(open_[keep].any(0))
            wanted = wanted[np.argsort(bound[np.ix_(active, wanted)].min(0), kind="stable")][: max(4, taken)]  # doubles what was taken
            todo[wanted] = False
            taken += len(wanted)
            cols = np.concatenate([np.arange(a, b) for a, b in zip(self.starts[wanted], self.ends[wanted])])
            cosines = single[active] @ self.single[cols].T
            floor = kth[active]
            if len(cols) >= k and (floor <= -1).any():
                floor = np.maximum(floor, np.partition(cosines, len(cols) - k, axis=1)[:, len(cols) - k])
            a, b = np.divmod(np.flatnonzero(cosines >= (floor - MARGIN).astype(np.float32)[:, None]), len(cols))
            i, j, s = np.r_[i, active[a]], np.r_[j, cols[b]], np.r_[s, cosines[a, b]]
            rank = np.lexsort((-s, i))
            i, j, s = i[rank], j[rank], s[rank]
            first = np.searchsorted(i, np.arange(len(q) + 1))
            full = np.flatnonzero(np.diff(first) >= k)
            kth[full] = np.maximum(kth[full], s[first[full] + k - 1])
            near = s >= kth[i] - MARGIN
            i, j, s = i[near], j[near], s[near]
        exact = np.round(np.einsum("ij,ij->i", q[i], self.x[j]), 12)
        rank = np.lexsort((-exact, i))
        i, j, exact = i[rank], j[rank], exact[rank]
        first = np.searchsorted(i, np.arange(len(q) + 1))
        full = np.flatnonzero(np.diff(first) >= k)
        least = known.copy()
        least[full] = np.maximum(least[full], exact[first[full] + k - 1])
        near = exact >= least[i]
        return i[near], self.order[j[near]], exact[near]


def _leaf_order(p: np.ndarray, leaf: int) -> np.ndarray:
    """An order of the rows in which every run of `leaf` rows is a kd-tree leaf."""
    parts, out = [np.arange(len(p))], []
    while parts:
        part = parts.pop()
        if len(part) <= leaf:
            out.append(part)
            continue
        d = int(np.argmax(p[part].var(0)))
        half = max(leaf, len(part) // 2 // leaf * leaf)
        split = part[np.argpartition(p[part, d], half)]
        parts += [split[half:], split[:half]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def usable(df: DataFrame, id_col: str, vector_col: str, group_col: str, dim: int) -> DataFrame:
    """(id, grp, vec, h1, h2) of the rows whose vector takes part."""
    vec = F.col("vec")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= 3.4028235e38)) & F.exists(vec, lambda x: x != 0)
    rows = df.select(F.col(_quoted(id_col)).cast("bigint").alias("id"), F.col(_quoted(group_col)).cast("string").alias("grp"), F.col(_quoted(vector_col)).cast("array<float>").alias("vec"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("grp").isNotNull() & (F.size("vec") == dim)).filter(F.coalesce(fine, F.lit(False)))
    return rows.withColumn("h1", F.xxhash64("grp", "vec")).withColumn("h2", F.xxhash64(F.lit("second"), "vec", "grp"))


def nearest_vectors(df: DataFrame, id_col: str = "id", vector_col: str = "embedding", group_col: str = "embedding_model", *, k: int = 5, dim: int = 64, cell_rows: int = CELL_ROWS, visit: float = VISIT_DEVIATIONS, stop: float = STOP_PROBABILITY) -> DataFrame:
    """(id, neighbour, rank, similarity) of the k most similar rows of every usable row of its group.

    Only vectors of `dim` finite values, not all zero, with a group take part,
    each against its own group. Similarity is the cosine rounded to 12 digits;
    of equals the smaller id comes first; a row is no neighbour of itself.
    Rows with fewer than k partners have fewer results, a lone row none; an
    empty table gives none. Ids must be unique. Approximate: see the
    module's text; groups of at most `cell_rows` rows are one cell.
    The number of groups must be small (their centroids are held by the driver).
    """
    spark = df.sparkSession
    ship_package(spark)
    rows = usable(df, id_col, vector_col, group_col, dim)
    schema = "h1 bigint, h2 bigint, found array<struct<s: double, id: bigint>>"
    sizes = {r["grp"]: r["count"] for r in rows.groupBy("grp").count().collect()}
    if not sizes:
        return spark.createDataFrame([], "id bigint, neighbour bigint, rank int, similarity double")
    pick = F.lit(False)
    for g, n in sizes.items():
        step = max(1, n // min(MOST_SAMPLE, max(LEAST_SAMPLE, CELL_SAMPLE * n // cell_rows)))
        pick = pick | ((F.col("grp") == g) & (F.pmod(F.xxhash64("id"), F.lit(step)) == 0))
    ms = {g: projections_needed(n) for g, n in sizes.items()}
    sampled: dict[str, list[bytes]] = {g: [] for g in sizes}
    for r in map_batches(rows.filter(pick).select("grp", "vec"), _sampler(dim), "grp string, x binary").collect():  # at most about 2 * MOST_SAMPLE vectors a group
        sampled[r["grp"]].append(r["x"])
    trees, blocks = {}, 0
    for g, n in sizes.items():
        cells = Cells(np.frombuffer(b"".join(sampled[g]), np.float32).reshape(-1, dim), n, cell_rows)
        trees[g] = (ms[g], cells, blocks)
        blocks += int(cells.first[-1])
    sent = spark.sparkContext.broadcast(trees)  # the sample bounds the cells
    # A set number of partitions: the work of a block is not its size, by which they would be merged.
    parts = min(2 * blocks, 16_384)
    routed = map_batches(rows, _router(dim, sent, k), "block bigint, own boolean, id bigint, h1 bigint, h2 bigint, grp string, x binary").repartition(parts, "block")
    answer = "found array<struct<s: double, id: bigint>>"
    classes = routed.groupBy("block").applyInArrow(_home_searcher(dim, sent, k, stop), f"block bigint, h1 bigint, h2 bigint, grp string, x binary, reach double, ids array<bigint>, {answer}")
    visiting = map_batches(classes, _visitors(dim, sent, visit), f"block bigint, own boolean, h1 bigint, h2 bigint, grp string, x binary, reach double, ids array<bigint>, {answer}")
    # The rows of a block come first, then its visitors pass by in batches, however many they are.
    streams = visiting.repartition(parts, "block").sortWithinPartitions("block", F.col("own").desc())
    found = map_batches(streams, _visit_searcher(dim, sent, k, stop), schema)
    # A visitor may meet again what its own cell held of the visited one.
    best = found.groupBy("h1", "h2").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))), 1, k + 1).alias("best"))
    # Adaptive execution splits the rows of a vector that very many of them share.
    each = rows.select("id", "h1", "h2").join(best, ["h1", "h2"])
    ranked = each.select("id", F.posexplode(F.slice(F.filter("best", lambda b: b["id"] != F.col("id")), 1, k)).alias("at", "b"))
    return ranked.select("id", F.col("b.id").alias("neighbour"), (F.col("at") + 1).alias("rank"), (-F.col("b.s")).alias("similarity"))


def _sampler(dim: int):
    """The sampled rows' unit vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit_rows(batch.column(1), dim).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in x], pa.binary())], ["grp", "x"])

    return run


def _router(dim: int, sent, k: int):
    """Rows for their own block and for the others that hold them; of equal vectors the k + 1 smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            ids, h1, h2 = (batch.column(c).to_numpy() for c in (0, 3, 4))
            names = np.array(batch.column(1).to_pylist(), object)
            keep = np.ones(len(ids), bool)
            for i in np.argsort(ids, kind="stable").tolist():
                known = held.setdefault((int(h1[i]), int(h2[i])), [])
                if len(known) <= k:
                    known.append(int(ids[i]))
                    known.sort()
                elif ids[i] < known[-1]:
                    known[-1] = int(ids[i])
                    known.sort()
                else:
                    keep[i] = False
            at = np.flatnonzero(keep)
            if not len(at):
                continue
            raw = batch.column(2).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
            unit = (raw / np.linalg.norm(raw.astype(np.float64), axis=1, keepdims=True)).astype(np.float32)
            for g, (_, cells, offset) in sent.value.items():
                mine = np.flatnonzero(names[at] == g)
                if not len(mine):
                    continue
                home = cells.own(unit[mine])
                home = cells.first[home] + (h1[at[mine]].view(np.uint64) % cells.blocks[home].astype(np.uint64)).astype(np.int64)
                r, block = _blocks(cells, *cells.holders(unit[mine]))
                pick = pa.array(at[mine[r]])
                yield pa.RecordBatch.from_arrays([pa.array(offset + block), pa.array(block == home[r]), *(batch.column(c).take(pick) for c in (0, 3, 4, 1)), pa.array([raw[i].tobytes() for i in mine[r]], pa.binary())], ["block", "own", "id", "h1", "h2", "grp", "x"])

    return run


def _blocks(cells: Cells, row: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, block) of all blocks of the cells."""
    n = cells.blocks[cell]
    return np.repeat(row, n), np.repeat(cells.first[cell] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _vectors(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """float64 unit vectors of packed float32 ones."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim).astype(np.float64)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def _best_ids(q: np.ndarray, x: np.ndarray, s: np.ndarray, begin: np.ndarray, count: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Queries, their k + 1 best ids with similarities, and the squared distance of the last, 4 if there are fewer; the ids of row r start at begin[r]."""
    n = count[x]
    rep = np.repeat(np.arange(len(q)), n)
    cand = ids[np.repeat(begin[x] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    qq, ss = q[rep], s[rep]
    rank = np.lexsort((cand, -ss, qq))
    qq, ss, cand = qq[rank], ss[rank], cand[rank]
    keep = np.arange(len(qq)) - np.searchsorted(qq, qq) <= k
    qq, ss, cand = qq[keep], ss[keep], cand[keep]
    queries, first = np.unique(qq, return_index=True)
    ends = np.r_[first, len(qq)]
    reach = np.full(len(queries), 4.0)
    full = np.diff(ends) > k
    reach[full] = 2 - 2 * ss[ends[1:][full] - 1]
    return queries, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays([pa.array(-ss), pa.array(cand)], names=["s", "id"])), reach


_FOUND = pa.list_(pa.struct([("s", pa.float64()), ("id", pa.int64())]))
_NOTHING = pa.schema([("block", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("grp", pa.string()), ("x", pa.binary()), ("reach", pa.float64()), ("ids", pa.list_(pa.int64())), ("found", _FOUND)]).empty_table()


def _home_searcher(dim: int, sent, k: int, stop_probability: float):
    """Classes of equal vectors of a block, with their best ids in it and the distance within which better ones may lie."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        m = sent.value[table.column("grp")[0].as_py()][0]
        ids, h1, h2, own = (table.column(c).to_numpy() for c in ("id", "h1", "h2", "own"))
        order = np.lexsort((ids, h2, h1))
        begin = np.flatnonzero(np.r_[True, (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])])
        count = np.minimum(np.diff(np.r_[begin, len(order)]), k + 1)
        lead = pa.array(order[begin])
        unit = _vectors(table.column("x").take(lead), dim)
        p = unit.astype(np.float32) @ directions(dim, m)
        asking = np.flatnonzero(own[order[begin]])  # all rows of a class are at home here, or none
        if not len(asking):
            return _NOTHING
        q, x, s = Block(unit, p).search(unit[asking], p[asking], k + 1, chi_square_quantile(stop_probability, m), np.full(len(asking), -1.0))
        queries, found, reach = _best_ids(asking[q], x, s, begin, count, ids[order], k)
        members = [ids[order[b : b + n]] for b, n in zip(begin[queries], count[queries])]
        pick = pa.array(order[begin[queries]])
        return pa.Table.from_arrays([*(table.column(c).take(pick) for c in ("block", "h1", "h2", "grp", "x")), pa.array(np.sqrt(np.maximum(reach, LEAST_SQUARE))), pa.array(members, pa.list_(pa.int64())), found], ["block", "h1", "h2", "grp", "x", "reach", "ids", "found"])

    return run


def _visitors(dim: int, sent, visit: float):
    """The classes of each block, and again as visitors of other blocks, each by its own reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            home, reach = batch.column(0).to_numpy(), batch.column(5).to_numpy()
            names = np.array(batch.column(3).to_pylist(), object)
            unit = _vectors(batch.column(4), dim).astype(np.float32)
            block, source = [], []
            for g, (_, cells, offset) in sent.value.items():
                mine = np.flatnonzero(names == g)
                if not len(mine):
                    continue
                r, to = _blocks(cells, *cells.visits(unit[mine], reach[mine], visit))
                block.append(offset + to)
                source.append(mine[r])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.ones(len(home), bool)), *(batch.column(c) for c in range(1, 8))], _VISIT)
            s = np.concatenate(source)
            for at in range(0, len(s), 10_000):
                pick = pa.array(s[at : at + 10_000])
                none = [pa.nulls(len(pick), batch.column(c).type) for c in (6, 7)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(block)[at : at + 10_000]), pa.array(np.zeros(len(pick), bool)), *(batch.column(c).take(pick) for c in range(1, 6)), *none], _VISIT)

    return run


_VISIT = ["block", "own", "h1", "h2", "grp", "x", "reach", "ids", "found"]


def _visit_searcher(dim: int, sent, k: int, stop_probability: float):
    """What the classes of each block found at home, and what its visitors find in it; rows come by block, its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own_rows, block, members = None, [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            where, own = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]) | (own[1:] != own[:-1])])
            for start, end in zip(cuts, np.r_[cuts[1:], len(where)]):
                part = batch.slice(start, end - start)
                if where[start] != at:
                    at, own_rows, block = where[start], [], None
                if own[start]:
                    own_rows.append(part)
                    yield part.select(["h1", "h2", "found"])
                elif own_rows:
                    m = sent.value[part.column(4)[0].as_py()][0]
                    if block is None:
                        home = pa.Table.from_batches(own_rows).combine_chunks()
                        unit = _vectors(home.column("x"), dim)
                        block = Block(unit, unit.astype(np.float32) @ directions(dim, m))
                        lists = home.column("ids").combine_chunks()
                        members = lists.flatten().to_numpy(), np.asarray(lists.value_lengths())
                    unit = _vectors(part.column(5), dim)
                    reach = part.column(6).to_numpy()
                    q, x, s = block.search(unit, unit.astype(np.float32) @ directions(dim, m), k + 1, chi_square_quantile(stop_probability, m), 1 - reach * reach / 2 - 1e-12)
                    if len(q):
                        ids, count = members
                        queries, found, _ = _best_ids(q, x, s, np.cumsum(count) - count, count, ids, k)
                        pick = pa.array(queries)
                        yield pa.RecordBatch.from_arrays([part.column(2).take(pick), part.column(3).take(pick), found], ["h1", "h2", "found"])

    return run
