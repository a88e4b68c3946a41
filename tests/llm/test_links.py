"""Name spellings and nearest vectors: quality on fixtures, brute force, and edge cases."""

import random

import numpy as np
import pytest
from compare import connection, duck_rows, spark_rows
from pyspark.sql import functions as F

from mnemolake.llm import names, neighbours
from mnemolake.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
NODES = "id bigint, type string, canonical_name string, aliases array<string>"


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, name):
    got = spark_rows(queries()[name](spark, SF))
    if name in oracle_sql():
        assert got == duck_rows(connection(SF), oracle_sql()[name])
    else:
        assert got[0]


def entities(spark, rows, **options):
    out = {}
    for r in names.link_names(spark.createDataFrame(rows, NODES), **options).collect():
        out.setdefault(r["entity"], set()).add(r["id"])
    return sorted(sorted(v) for v in out.values())


def test_linking(spark):
    groups = [
        [("person", "robert fobarius", ["Robert Fobarius"]), ("person", "bobby fobarius", None), ("entity", "fobarius, r.", []), ("person", "r0bert fobarius", []), ("person", "dr. robert q. fobarius", []), ("person", "robertfobarius", []), ("person", "robert_fobaruis", []), ("person", "rfob1234", ["ROBERT FOBARIUS", "unknown"])],
        [("person", "susanne fobarius", None)],
        [("person", "thomas grelvinor", []), ("person", "thornas grelvinor", ["?"]), ("person", "tommy grelvinór", []), ("person", "grelvinor t", [])],
        [("org", "zanthor marine supply incorporated", []), ("org", "zanthor marine sply inc.", []), ("org", "marine supply of zanthor", []), ("entity", "zanthór marine supply (inc)", [])],
        [("org", "zanthor engineering incorporated", []), ("org", "zanthor eng.", [])],
        [("org", "quilbrax department of transport gmbh", []), ("org", "quilbrax dot", []), ("org", "quilbrax department of transport gesellschaft mbh", [])],
        [("person", "ulrike mastorin", [])],
        [("person", "ursula-maria mastorin", [])],
    ]
    rows, want, i = [], [], 0
    for g in groups:
        want.append(list(range(i, i + len(g))))
        rows += [(i + j, *r) for j, r in enumerate(g)]
        i += len(g)
    rows.append((500, "place", "zanthor valley", []))
    assert entities(spark, rows) == want


def misspelt(rng, word, edits):
    for _ in range(edits):
        i = rng.randrange(len(word) - 1)
        word = word[:i] + rng.choice([word[i + 1] + word[i], word[i], word[i] + "x" + word[i + 1], "rn" + word[i + 1]]) + word[i + 2 :]
    return word


def test_similar_words_are_complete(spark):
    """The similar pairs are those of brute force, also where every bucket is cut into blocks of one word."""
    rng = random.Random(3)
    letters = "abcdeghilmnorstuv01"
    found = set()
    for n in (3, 4, 6, 7, 8, 11, 14, 22, 24, 27):
        for _ in range(5):
            word = "".join(rng.choices(letters, k=n))
            found |= {word} | {misspelt(rng, word, rng.randint(0, 2)) for _ in range(6)}
    every = sorted(found)
    want = {(a, b) for a in every for b in every if names.word_similarity(a, b) >= names.WORD_THRESHOLD}
    assert len(want) > 2 * len(every)
    words = spark.createDataFrame([("last", w) for w in every] + [("root", every[0])], "tag string, word string")
    for block in (1, 256):
        near = names.similar_words(words, block_words=block).collect()
        assert {(r["a"], r["b"]) for r in near if r["tag"] == "last"} == want and len([r for r in near if r["tag"] == "last"]) == len(want)


def test_hot_last_name(spark):
    """Namesakes of one last name are linked with their own variants only, and none of them is compared with another."""
    rng = random.Random(5)
    given = ["quent" + "".join(rng.choices("abcdefgiklmnoprstuvz", k=7)) for _ in range(400)]
    variants = [[f"{g} fobarius", f"FOBARIUS, {g}", f"{g} {misspelt(rng, 'fobarius', 1)}"] for g in given]
    rows = [(3 * i + j, "person", v, None) for i, own in enumerate(variants) for j, v in enumerate(own)]
    got = {g for g in map(tuple, entities(spark, rows)) if len(g) > 1}
    want = {(a, b) for i in range(400) for a, b in ((3 * i, 3 * i + 1), (3 * i, 3 * i + 2), (3 * i + 1, 3 * i + 2))}
    pairs = {(a, b) for g in got for a in g for b in g if a < b}
    assert len(pairs & want) >= 0.99 * len(want) and len(pairs - want) <= 0.02 * len(want)
    keys = names.spellings(spark.createDataFrame(rows, NODES)).select("kind", "part", "word").distinct()
    assert names.similar_words(keys.select(F.lit("last").alias("tag"), "word").distinct()).filter("a < b").count() < 6000


def test_derived_short_forms(spark):
    groups = [
        [("org", "acme aerospace ltd", None), ("org", "acme aero", None)],
        [("org", "northwind electric power", None), ("org", "northwind elec. pwr inc", None)],
        [("org", "lorvenia department of justice", None), ("org", "lorvenia doj", None), ("org", "lorvenia dept of justice", None)],
        [("person", "bartholomew quist", None), ("person", "bart quist", None)],
        [("place", "susanne grelvinor", None), ("thing", "mx susanne grelvinor", None)],
    ]
    rows, want = [], []
    for g in groups:
        want.append(list(range(len(rows), len(rows) + len(g))))
        rows += [(len(rows) + j, *r) for j, r in enumerate(g)]
    assert entities(spark, rows) == want
    # Two that an acronym could mean: it joins neither.
    both = [(1, "org", "lorvenia department of justice", None), (2, "org", "lorvenia domain of juniper", None), (3, "org", "lorvenia doj", None)]
    assert entities(spark, both) == [[1], [2], [3]]


def test_vague_names_need_one_meaning(spark):
    rows = [(1, "person", "margaret fobarius", None), (2, "person", "michael fobarius", None), (3, "person", "m. fobarius", None)]
    assert entities(spark, rows) == [[1], [2], [3]]
    assert entities(spark, rows[1:]) == [[2, 3]]


def test_linking_edges(spark):
    rows = [(1, None, "ann fobarius", None), (2, "person", None, None), (3, "person", " ", [None, "N/A"]), (None, "person", "ann fobarius", None), (4, "person", "ann fobarius " + "x" * 20_000, []), (5, "person", "ann fobarius", []), (5, "person", "ann fobarius", [])]
    assert [1, 5] in entities(spark, rows)
    assert entities(spark, [(i, "person", "ann fobarius", []) for i in range(3000)]) == [list(range(3000))]
    assert names.link_names(spark.createDataFrame([], NODES)).count() == 0


def test_collision_curve():
    assert names.bands_needed(0.5, 0.87, 4) == 32 and names.bands_needed() == 36
    rng = random.Random(1)
    hits = total = 0
    for _ in range(150):
        a = "".join(rng.choices("abdegiklmnorstuvz", k=11))
        i = rng.randrange(11)
        b = a[:i] + rng.choice("xyw") + a[i + 1 :]
        total += 1
        hits += bool(set(enumerate(names.minhash_bands(a, 32))) & set(enumerate(names.minhash_bands(b, 32))))
    assert hits / total > 0.95


def test_stars(spark):
    edges = spark.createDataFrame([(1, 2, 0.95), (1, 3, 0.9), (1, 4, 0.9), (4, 5, 0.99), (6, 7, 0.9)], "a bigint, b bigint, similarity double")
    got = {r["id"]: r["centre"] for r in names.star_clusters(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 6}


def exact(ids, x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -9)
    return {int(ids[r]): [int(ids[j]) for j in np.lexsort((ids, -s[r]))[:k]] for r in range(len(ids))}


@pytest.mark.parametrize("cell_rows", [16_384, 400])
def test_neighbour_recall(spark, cell_rows):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((150, 64))
    x = (np.repeat(centres, 12, 0) + 0.35 * rng.standard_normal((1800, 64))).astype(np.float32) * rng.uniform(0.1, 9, (1800, 1)).astype(np.float32)
    ids = rng.permutation(1800) + 1
    rows = spark.createDataFrame([(int(i), [float(v) for v in r], "m") for i, r in zip(ids, x)], "id bigint, embedding array<float>, embedding_model string")
    got = {}
    for r in neighbours.nearest_vectors(rows, cell_rows=cell_rows).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    want = exact(ids, x.astype(np.float64), 5)
    recall = np.mean([len(set(want[i]) & set(got.get(i, []))) / 5 for i in want])
    assert recall >= 0.95
    assert all(len(set(v)) == 5 for v in got.values())  # what two cells hold is met once


def test_cells_per_vector_stay_few():
    """Sixteen times as many cells do not make a vector be held or searched in many more."""
    rng = np.random.default_rng(2)
    x = np.repeat(rng.standard_normal((2000, 64)), 8, 0) + 0.3 * rng.standard_normal((16_000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    reach = np.full(len(x), 0.45, np.float32)
    for cells in (8, 128):
        c = neighbours.Cells(x, len(x), len(x) // cells)
        assert len(c.centres) == cells and c.blocks.sum() <= 2 * cells
        held, visited = c.holders(x), c.visits(x, reach, neighbours.VISIT_DEVIATIONS)
        assert set(zip(np.arange(len(x)).tolist(), c.own(x).tolist())) <= set(zip(held[0].tolist(), held[1].tolist()))
        assert len(held[0]) <= 4 * len(x) and len(visited[0]) <= 3 * len(x)
    one = neighbours.Cells(x[:10], 10, 100)
    assert len(one.centres) == 1 and not len(one.visits(x[:10], reach[:10] * 9, 9.0)[0]) and len(one.holders(x[:10])[0]) == 10


def test_neighbours_of_mixed_density(spark):
    """Distinct vectors keep their neighbours among many copies, and the sparsest ones too."""
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((60, 64))
    spread = np.repeat(rng.uniform(0.2, 0.9, 60), 12)[:, None]
    loose = np.repeat(centres, 12, 0) + spread * rng.standard_normal((720, 64))
    x = np.concatenate([loose, np.repeat(rng.standard_normal((2, 64)), 700, 0)]).astype(np.float32)
    ids = rng.permutation(len(x)) + 1
    rows = spark.createDataFrame([(int(i), [float(v) for v in r], "m") for i, r in zip(ids, x)], "id bigint, embedding array<float>, embedding_model string")
    got = {}
    for r in neighbours.nearest_vectors(rows, cell_rows=200).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    want = exact(ids, x.astype(np.float64), 5)
    recall = np.array([len(set(want[i]) & set(got[i])) / 5 for i in map(int, ids[:720])])
    assert recall.mean() >= 0.95 and recall[spread[:, 0] > 0.7].mean() >= 0.93
    assert all(got[i] == want[i] for i in map(int, ids[720:]))


def test_neighbour_edges(spark):
    v = [1.0] + [0.0] * 63
    w = [1.0, 0.1] + [0.0] * 62
    bad = [(50, None, "m"), (51, [1.0], "m"), (52, [0.0] * 64, "m"), (53, [float("nan")] + v[1:], "m"), (54, [float("inf")] + v[1:], "m"), (55, v, None), (56, [None] + v[1:], "m"), (57, v, "lonely"), (None, v, "m")]
    rows = [(i, v, "m") for i in range(1, 40)] + [(40, w, "m"), (41, [2 * a for a in v], "m")] + bad
    df = spark.createDataFrame(rows, "id bigint, embedding array<float>, embedding_model string").withColumn("h1", F.lit("clash"))
    got = {}
    for r in neighbours.nearest_vectors(df).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    assert set(got) == set(range(1, 42))
    assert got[1] == [2, 3, 4, 5, 6] and got[3] == [1, 2, 4, 5, 6] and got[39] == [1, 2, 3, 4, 5] and got[41] == [1, 2, 3, 4, 5] and got[40] == [1, 2, 3, 4, 5]
    assert neighbours.nearest_vectors(df.limit(0)).count() == 0


def test_chi_square():
    for p, m, want in ((0.95, 8, 15.507), (0.97, 13, 24.125), (0.5, 10, 9.342)):
        assert abs(neighbours.chi_square_quantile(p, m) - want) < 0.05
