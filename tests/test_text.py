"""Text functions, guards, rules, and the text index against SQLite's own."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from mnemolake.functions import guards, rules, text
from mnemolake.functions.vector import cosine, cosine_top, hash_embedding
from mnemolake.operators import bm25


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).head()["x"]


def test_terms_and_keys(spark):
    assert one(spark, text.query_terms(F.col("t")), t="What about the Brakes, brakes and ROTORS?") == ["brakes", "rotors"]
    assert one(spark, text.query_terms(F.col("t")), t="what is it") == ["what", "is", "it"]
    assert one(spark, text.normalize_key(F.col("t")), t=" Favorite  Tool! ") == "favorite__tool"
    assert one(spark, text.canonical_name(F.col("t")), t="  The  Big   Apple ") == "big apple"
    assert one(spark, text.canonical_name(F.col("t")), t="an the x") == "the x"
    assert one(spark, text.leading_clause(F.col("t")), t="Is it?  Yes. No! More") == "Is it? Yes."
    assert one(spark, text.condense(F.col("t"), 5), t="a  b\nc d e") == "a b c…"
    assert one(spark, text.json_object(F.col("t")), t='so: {"a": {"b": 1}} ok') == '{"a": {"b": 1}}'
    assert one(spark, text.json_object(F.col("t")), t="none") is None
    assert one(spark, text.estimate_tokens(F.col("t")), t="") == 1
    assert one(spark, text.word_count(F.col("t")), t="  ") == 0


@pytest.mark.parametrize(
    ("key", "value", "source", "part"),
    [
        ("", "x", "explicit", "empty"), ("k", "  ", "explicit", "empty"), ("k", None, "auto", "empty"), (None, "v", "auto", "empty"), ("my_email", "a", "explicit", "reserved"),
        ("user_message", "hi", "auto", "transcript"), ("user_message", "hi", "explicit", None), ("xkcdq_x", "v", "auto", "gibberish"), ("xkcdq_x", "v", "rule", None), ("dob", "v", "auto", None),
        ("role", "I am an AI agent", "explicit", "self-referential"), ("k", "N/A", "import", "placeholder"), ("k", "tea", "auto", None),
    ],
)
def test_guards(spark, key, value, source, part):
    row = spark.createDataFrame([(key, value, source)], "k string, v string, s string")
    got = row.select(guards.rejection(F.col("k"), F.col("v"), F.col("s"), reserved=("email",))).head()[0]
    assert (got is None) if part is None else part in got


@pytest.mark.parametrize(
    ("said", "expected"),
    [
        ("My name is Priya and I like tea.", [("name", "Priya")]), ("my full name is kumar", [("name", "kumar")]), ("My name is not important", []), ("you can call me Bo", [("name", "Bo")]),
        ("I live in New York, right", [("location", "New York")]), ("i live in the moment", []), ("I'm allergic to nuts by the way", [("allergies", "nuts")]), ("I am vegan", [("diet", "vegan")]),
        ("My favourite fruit is mango though. my preferred drink is tea", [("favorite_fruit", "mango"), ("favorite_drink", "tea")]), ("I work as a nurse", [("occupation", "nurse")]), (None, []), ("", []),
    ],
)
def test_rules(spark, said, expected):
    rows = spark.createDataFrame([(1, said)], "id bigint, t string")
    assert [(r["key"], r["value"]) for r in rules.capture_facts(rows, "id", "t").orderBy("ord").collect()] == expected


def corpus(n=120, seed=7):
    words = "brake brakes braking engine engines running runner café naïve relational conditional happy happiness tuning oil filter gardens garden painted painting paint room rooms bread baking bakery flour yeast".split()
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(words, k=rng.randint(3, 25)))) for i in range(n)]


@pytest.mark.parametrize("stem", [False, True])
def test_bm25_equals_sqlite(spark, stem):
    docs = corpus()
    db = sqlite3.connect(":memory:")
    db.execute(f"create virtual table t using fts5(x, tokenize='{'porter ' if stem else ''}unicode61')")
    db.executemany("insert into t(rowid, x) values (?, ?)", docs)
    asked = [(1, "brake engine filter"), (2, "happiness painting"), (3, "brake brakes"), (4, ""), (5, "?!")]
    want = {}
    for q, words in asked:
        if words and words != "?!":
            rows = db.execute("select rowid, bm25(t) from t where t match ?", (" OR ".join(words.split()),)).fetchall()
            want[q] = [(d, round(-s, 9)) for d, s in sorted(rows, key=lambda r: (-round(-r[1], 12), r[0]))[:20]]
    hits = bm25.bm25_top(spark.createDataFrame(asked, "query_id bigint, text string"), spark.createDataFrame(docs, "id bigint, x string"), "id", "x", stem=stem).orderBy("query_id", "rank").collect()
    got = {}
    for h in hits:
        got.setdefault(h["query_id"], []).append((h["doc_id"], round(h["bm25"], 9)))
    assert got == want


def shuffled_bytes(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_like_top_shuffles_best_documents_only(spark):
    words = [f"w{i:03}" for i in range(60)]
    rng = random.Random(3)
    asked = [(q, " ".join(rng.sample(words, 8))) for q in range(300)]
    docs = [(i, " ".join(words)) for i in range(3000)]
    before = shuffled_bytes(spark)
    hits = bm25.like_top(spark.createDataFrame(asked, "query_id bigint, text string"), spark.createDataFrame(docs, "id bigint, x string").repartition(2), "id", ["x"], 5).collect()
    assert shuffled_bytes(spark) - before < 500_000  # 900,000 pairs of a query and a document
    assert {(h["query_id"], h["doc_id"], h["hits"], h["rank"]) for h in hits} == {(q, i, 8, i + 1) for q in range(300) for i in range(5)}


@pytest.mark.parametrize("at_once", [1 << 16, 7])
def test_like_top_equals_brute_force(spark, monkeypatch, at_once):
    monkeypatch.setattr(bm25, "LIKE_QUERIES", at_once)
    rng = random.Random(5)
    docs = [(i, x.upper() if i % 2 else x, None if i % 3 else x[::-1]) for i, x in corpus(2500)]
    docs += [(2500, None, None), (2501, "", "brake")]
    rng.shuffle(docs)
    asked = [(q, " ".join(rng.choices("brake ING eng ra the café ekarb filter oil painted zz be naive 12 garden rooms".split(), k=rng.randint(0, 14)))) for q in range(40)] + [(40, None), (41, "the is"), (3, "yeast brake")]
    want = []
    terms = {}
    for q, t in spark.createDataFrame(asked, "q bigint, t string").select("q", text.query_terms(F.col("t"))).collect():
        terms.setdefault(q, []).extend((t or [])[:8])
    for q, ts in terms.items():
        scored = [(-sum(t in (c or "").lower() for t in ts for c in cs), i) for i, *cs in docs]
        want += [(q, i, -n, r + 1) for r, (n, i) in enumerate(sorted(x for x in scored if x[0])[:20])]
    frame = spark.createDataFrame(docs, "id bigint, x string, y string").repartition(3)
    got = bm25.like_top(spark.createDataFrame(asked, "query_id bigint, text string"), frame, "id", ["x", "y"])
    assert sorted(map(tuple, got.select("query_id", "doc_id", "hits", "rank").collect())) == sorted(want)
    assert bm25.like_top(spark.createDataFrame([(1, "?")], "query_id bigint, text string"), frame, "id", ["x"]).count() == 0


def test_porter_examples():
    pairs = "caresses:caress ponies:poni cats:cat feed:feed agreed:agre plastered:plaster motoring:motor hopping:hop falling:fall filing:file happy:happi relational:relat digitizer:digit hopefulness:hope formalize:formal adoption:adopt probate:probat rate:rate controlling:control sky:sky"
    for pair in pairs.split():
        word, stem = pair.split(":")
        assert text.porter_stem(word) == stem


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [0.0, 0.0]), ([1.0, 1.0], [1.0, 0.0, 5.0])], "a array<double>, b array<double>")
    assert [round(r[0], 3) for r in rows.select(cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.139]
    docs = spark.createDataFrame([(1, "g", [1.0, 0.0]), (2, "g", [1.0, 0.0]), (3, "g", [0.0, 1.0]), (4, "h", [1.0, 0.0])], "id bigint, grp string, vec array<float>")
    top = cosine_top(docs.filter("id in (1, 4)").withColumnRenamed("id", "query_id"), docs, 2, broadcast_bytes=64)
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in top.collect()) == [(1, 1, 2), (1, 2, 1), (4, 1, 4)]
    assert hash_embedding("  ") == [0.0] * 64 and abs(sum(x * x for x in hash_embedding("kitchen kitchen table")) - 1) < 1e-9


def test_lazy_embedder(spark):
    from mnemolake.functions.embedder import LazyEmbedder, default_embedder
    from mnemolake.functions.vector import embed_texts, hash_embedding

    loads = []

    def load():
        loads.append(1)
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    e = LazyEmbedder("lengths", load)
    q = e.for_queries("ask: ")
    assert not e.resident() and e("abc") == [3.0, 1.0] and q("abc") == [8.0, 1.0] and e(None) is None
    assert e.resident() and q.resident() and loads == [1]
    bad = LazyEmbedder("broken", lambda: 1 / 0)
    assert bad("x") is None and bad("y") is None and not bad.resident()
    rows = spark.createDataFrame([(1, "abc"), (2, None)], "id bigint, t string")
    assert {r["id"]: r["embedding"] for r in embed_texts(rows, "id", "t", default_embedder()).collect()} == {1: None, 2: None}  # its package is not here
    assert hash_embedding(None) is None and hash_embedding("a b") == [0.0] * 64 and sum(x * x for x in hash_embedding("some (words), here!")) > 0.99
