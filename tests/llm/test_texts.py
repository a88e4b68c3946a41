"""Redaction, splitting, conversations, encoding, leakage and repetition against brute force and edge cases."""

import base64
import collections
import datetime as dt
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnemolake.llm import conversations, leakage, pii, repetition, splitting, tokens
from mnemolake.llm.conversations import assess_sessions, rebuild_conversations
from mnemolake.operators import ordered

SF = "/root/testdata/sf0.001"


# --- personal information ------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("write to ann.lee+x@mail.example.org now", {"email"}), ("ann (at) mail (dot) example (dot) com", {"email"}), ("ann @ mail.example", {"email"}), ("ann at mail dot example dot com", {"email"}),
        ("ａｎｎ＠mail.example", {"email"}), ("tiny-router@1.2.3 and @handle and x@y", set()), ("call +44 (0)20 7946 0813", {"phone"}), ("0049-30-23125-804", {"phone"}), ("(674) 555-0101 or 641.555.0169 ext. 7", {"phone"}),
        ("five five five, oh", set()), ("call zero seven seven zero zero nine zero zero eight six zero", {"phone"}), ("ticket 560683685640, QA-334-59, 10.4.5.6, v1.2.3, 12.50 EUR", set()), ("2024-05-06T07:08:09", set()),
        ("SSN 000-12-3456", {"idnumber"}), ("QQ 12 34 56 C", {"idnumber"}), ("tax 12/345/67890", {"idnumber"}), ("Passport no. K4643 8276", {"idnumber"}), ("live at 12 Upper Fobar Street", {"address"}), ("Fobarstraße 12", {"address"}),
        ("12 rue de Fobar, 21000 Barfoo", {"address"}), ("calle Fobar 12", {"address"}), ("it took 12 minutes on the street", set()), ("ask Robert Fobarius about it", {"name"}), ("regards, fobarius, robert", {"name"}),
        ("R. Fobarius called", {"name"}), ("Dr. Fobarius called", {"name"}), ("did ROBERT FOBARIUS call", {"name"}), ("did robert call back", set()), ("robert.fobarius@mail.example", {"email"}), ("Victoria Engineering Ltd", set()), ("", set()), ("   ", set()),
    ],
)
def test_kinds(text, kinds):
    assert {k for k, _, _ in pii.redact(text)[1]} == kinds


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("please ask Oluwaseun Adeyemi about it", ["Oluwaseun Adeyemi"]), ("meet Bartholomew Quist at noon", ["Bartholomew Quist"]), ("call Guillermo Ferreira today", ["Guillermo Ferreira"]), ("Ingeborg Halvorsen called", ["Ingeborg Halvorsen"]),
        ("contact Dr. Thandiwe Nkosi", ["Dr. Thandiwe Nkosi"]), ("my friend Aoife O'Sullivan-Byrne moved", ["Aoife O'Sullivan-Byrne"]), ("ask Zanthor Marine Supply about it", []), ("call the Open Source office", []), ("visit Baker Street", []), ("ask about Visual things", []),
        ("the MX record of it", []), ("did X" + "x" * 90 + ", Robert call", ["X" + "x" * 90 + ", Robert"]), ("SSN one two three, four five, six seven eight nine", ["one two three, four five, six seven eight nine"]), ("call plus four four double seven zero zero nine zero zero eight six", ["plus four four double seven zero zero nine zero zero eight six"]),
        ("one, two, three, four, five, six", []), ("double one two", []), ("write to ann@bücher.example today", ["ann@bücher.example"]), ("write to ann@почта.пример, now", ["ann@почта.пример"]), ("写信给 ann@mail.example请", ["ann@mail.example"]),
    ],
)
def test_general_forms(text, spans):
    assert [text[s:e] for _, s, e in pii.redact(text)[1]] == spans


def test_many_spans_take_linear_time():
    began = time.perf_counter()
    assert len(pii.redact("a@b.example Robert Fobarius, " * 20_000)[1]) == 40_000
    assert time.perf_counter() - began < 30


def test_spans_are_of_the_source():
    text = "naïve ann​.lee [at] mail (dot) example (dot) com — é Dr. Fobarius +1 799-555-0158!"
    out, spans = pii.redact(text)
    assert [text[s:e] for _, s, e in spans] == ["ann​.lee [at] mail (dot) example (dot) com", "Dr. Fobarius", "+1 799-555-0158"]
    assert out == "naïve [EMAIL] — é [NAME] [PHONE]!"


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_rest_of_the_text_stays(text):
    out, spans = pii.redact(text)
    at, rest = 0, []
    for _, s, e in spans:
        assert at <= s < e <= len(text)
        rest.append(text[at:s])
        at = e
    rest.append(text[at:])
    assert re.sub(r"\[(?:EMAIL|PHONE|IDNUMBER|ADDRESS|NAME)\]", "", out) == re.sub(r"\[(?:EMAIL|PHONE|IDNUMBER|ADDRESS|NAME)\]", "", "".join(rest))


def test_redact_rows(spark):
    rows = spark.createDataFrame([(1, None, "x"), (None, "", "y"), (1, "a@b.example " * 5000, "z"), (1, "a@b.example", "z")], "spans bigint, text string, redacted string")
    got = pii.redact_texts(rows.withColumnRenamed("spans", "id"), ["id"], "text").collect()
    assert len(got) == 4 and sorted(len(r["spans"]) for r in got) == [0, 0, 1, 5000]
    assert pii.redact_texts(spark.createDataFrame([], "id bigint, text string"), ["id"], "text").count() == 0


# --- splitting -------------------------------------------------------------------


def check_pieces(text, pieces, limit, overlap):
    at = 0
    for n, (start, piece) in enumerate(pieces):
        assert len(piece) <= limit and text[start - 1 : start - 1 + len(piece)] == piece
        lead = at - (start - 1)
        assert lead == 0 if n == 0 else 0 <= lead <= overlap
        at = start - 1 + len(piece)
    assert at == len(text)


def test_pieces(spark):
    rng = random.Random(2)
    texts = ["", None, "a", "x" * 1600, "x" * 1601, "word " * 2000, "\n\n".join("Sentence one. Sentence two! " * rng.randint(3, 60) for _ in range(40)), "é👩‍🔧🇳🇴" * 900, "列，" * 1500, "a\r\n" * 3000, "y" * 200_000, " " * 2000]
    rows = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").withColumn("piece", F.lit("clash")).drop("piece")
    got = collections.defaultdict(list)
    for r in splitting.split_texts(rows, ["id"], "text").orderBy("id", "piece").collect():
        got[r["id"]].append((r["start_at"], r["piece_text"]))
    for i, text in enumerate(texts):
        if text:
            check_pieces(text, got[i], 1600, 160)
            assert (len(got[i]) > 1) == (len(text) > 1600)
        else:
            assert i not in got
    # A weaker boundary is cut only where the second half of the window has no paragraph's end.
    text, at, cuts = texts[6], 0, []
    for n, (start, piece) in enumerate(got[6][:-1]):
        most = 1600 if n == 0 else 1440
        end = start - 1 + len(piece)
        cuts.append(text[:end].endswith("\n\n"))
        assert cuts[-1] or text[end - 1] == " " and not any(text[at:c].endswith("\n\n") for c in range(at + most // 2, at + most + 1))
        at = end
    assert any(cuts) and not all(cuts)
    assert all(not p.startswith(("́", "‍", "🔧")) for _, p in got[7])
    with pytest.raises(ValueError):
        splitting.split_texts(rows, ["id"], "text", limit=10, overlap=9)


# --- conversations ------------------------------------------------------------------


def test_conversations(spark):
    t = dt.datetime(2024, 1, 1)
    s = dt.timedelta(seconds=1)
    rows = [
        (1, 1, 1, "user", "hi", t), (2, 1, 1, "assistant", "yes", t - 60 * s), (3, 1, 2, " User ", "more", t + 20 * s), (4, 1, 2, "ASSISTANT", "ok", t - 45 * s), (5, 1, 1, "user", " hi\n", t + 99 * s),  # the reply's clock is late
        (6, 2, 1, "user", "a", t), (7, 2, 3, "user", "b", t), (8, 2, 1, "assistant", "c", t), (9, 2, 3, "assistant", "d", t), (10, 3, 1, "user", "alone", t), (11, 4, 1, "user", "x", t), (12, 4, 1, "assistant", "y", t), (13, 4, 1, "assistant", "z", t),
        (14, 5, None, "user", "x", t), (15, 6, 1, "tool", "x", t), (16, 7, 1, "system", "only", t), (17, None, 1, "user", "x", t), (18, 8, 1, "user", "q", None), (19, 8, 1, "assistant", "r", None), (20, 8, 5, "user", "  \n", t), (21, 8, 9, "SYSTEM ", "s", t), (22, 10, 1, "user", "q", t), (23, 10, 1, "assistant", "r", t), (24, 11, 1, None, "q", t),
    ]
    m = spark.createDataFrame(rows, "id bigint, session_id bigint, turn int, role string, content string, created_at timestamp_ntz").withColumn("offset_micros", F.lit(1))
    ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 11, None, 1)], "id bigint")
    reasons = {r["session_id"]: r["reason"] for r in assess_sessions(ids, m).collect()}
    assert reasons == {1: None, 2: "gap in turns", 3: "reply missing or doubled", 4: "reply missing or doubled", 5: "turn missing", 6: "unknown role", 7: "empty", 8: None, 9: "empty", 10: "no session row", 11: "unknown role"}
    talk = [(r["session_id"], r["position"], r["role"], r["content"], r["corrected_at"]) for r in rebuild_conversations(ids, m).orderBy("session_id", "position").collect()]
    assert [x[1:4] for x in talk if x[0] == 1] == [(1, "user", "hi"), (2, "assistant", "yes"), (3, "user", "more"), (4, "assistant", "ok")]
    times = [x[4] for x in talk if x[0] == 1]
    assert times == sorted(times) and talk[-1][4] is None
    none = m.limit(0)
    assert assess_sessions(ids.limit(0), none).count() == 0 and rebuild_conversations(ids, none).count() == 0


def test_system_rows_of_conversations(spark, monkeypatch):
    t = dt.datetime(2024, 1, 1)
    s = dt.timedelta(seconds=1)
    rows = [
        (1, 1, 1, "user", "q1", t), (2, 1, 1, "assistant", "r1", t + 9 * s), (3, 1, 2, "user", "q2", t + 20 * s), (4, 1, 2, "assistant", "r2", t + 29 * s), (5, 1, 0, "system", "opening", t + 99 * s), (6, 1, 0, "SYSTEM\n", " opening", t),
        (7, 1, 1, "system", "between", t + 4 * s), (8, 1, 2, "system", "before", t + 15 * s), (9, 1, 2, "System", "behind", t + 40 * s), (10, 1, 7, "system", "closing", None), (11, 1, None, "system", "no turn", t + 21 * s), (12, 1, 1, "system", " ", t),
        (13, 1, None, "system", "no turn, no time", None), (14, 2, 1, "system", "dropped", t), (20, 3, 1, "user", "q", None), (21, 3, 1, "system", "by arrival", t), (22, 3, 1, "assistant", "r", t),
    ]
    m = spark.createDataFrame(rows, "id bigint, session_id bigint, turn int, role string, content string, created_at timestamp_ntz")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id bigint")
    want = [(1, 1, "opening"), (1, 2, "q1"), (1, 3, "between"), (1, 4, "r1"), (1, 5, "before"), (1, 6, "q2"), (1, 7, "no turn"), (1, 8, "r2"), (1, 9, "no turn, no time"), (1, 10, "behind"), (1, 11, "closing"), (3, 1, "q"), (3, 2, "by arrival"), (3, 3, "r")]
    for hot in (1_000_000, 1):
        monkeypatch.setattr(conversations, "bucket_if_hot", lambda df, keys, bucket, hot=hot: ordered.bucket_if_hot(df, keys, bucket, hot))
        got = rebuild_conversations(ids, m, with_system=True).orderBy("session_id", "position").collect()
        assert [(r["session_id"], r["position"], r["content"]) for r in got] == want
        assert [r["turn"] for r in got if r["role"] == "system"] == [0, 1, 2, None, None, 2, 7, 1]


def test_clock_offset_places_system_rows(spark, monkeypatch):
    """The assistant's clock is 80 seconds late: only with the estimated offset does the system row stand behind the reply."""
    t = dt.datetime(2024, 1, 1)
    s = dt.timedelta(seconds=1)
    rows = []
    for turn in (1, 2, 3):
        rows += [(10 * turn, 1, turn, "user", f"q{turn}", t + 100 * turn * s), (10 * turn + 1, 1, turn, "assistant", f"r{turn}", t + (100 * turn + 40 + 80) * s)]
    rows.append((5, 1, 2, "system", "note", t + 270 * s))
    m = spark.createDataFrame(rows, "id bigint, session_id bigint, turn int, role string, content string, created_at timestamp_ntz")
    ids = spark.createDataFrame([(1,)], "id bigint")

    def order():
        return [r["content"] for r in rebuild_conversations(ids, m, with_system=True).orderBy("position").collect()]

    monkeypatch.setattr(conversations, "TURN_BLOCK", 2)
    assert order() == ["q1", "r1", "q2", "r2", "note", "q3", "r3"]
    plain = conversations.assess_sessions
    monkeypatch.setattr(conversations, "assess_sessions", lambda *a: plain(*a).withColumn("offset_micros", F.lit(0)))
    assert order() == ["q1", "r1", "q2", "note", "r2", "q3", "r3"]


# --- encoding ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_of_documents(spark, reference):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r["doc_id"]: reference.encode_ordinary(r["text"] or "") for r in docs.select("doc_id", "text").collect()}
    rows = tokens.encode_texts(docs).collect()
    assert len(rows) == len(want) and {r["doc_id"]: list(r["ids"]) for r in rows} == want


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_encoding_of_any_text(reference, text):
    text = text.encode("utf-8", "ignore").decode()
    assert tokens.vocabulary(tokens.DEFAULT_VOCABULARY).encode([text]).to_pylist() == [reference.encode_ordinary(text)]


def test_encoding_edges(spark, reference):
    long = "naïve Δ x1b " * 60_000 + "a" * 5000
    rows = spark.createDataFrame([(1, None), (None, ""), (3, long), (3, long), (4, "<|endoftext|>\x1c​  ")], "ids bigint, text string")
    got = tokens.encode_texts(rows.withColumnRenamed("ids", "doc_id")).collect()
    assert sorted((len(r["ids"]) for r in got)) == sorted([0, 0, *(len(reference.encode_ordinary(t)) for t in (long, long, "<|endoftext|>\x1c​  "))])
    assert tokens.encode_texts(rows.limit(0).withColumnRenamed("ids", "doc_id")).count() == 0


def test_forgetting_known_pretokens(reference, monkeypatch):
    v = tokens.Vocabulary(tokens.DEFAULT_VOCABULARY)
    monkeypatch.setattr(tokens, "KNOWN_LIMIT", 3)
    for text in ("one two three four", "five six one", "two"):
        assert v.encode([text]).to_pylist() == [reference.encode_ordinary(text)]


# --- leakage ---------------------------------------------------------------------------------


def brute_leaks(docs, items, n):
    cut = lambda t: re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    of = collections.defaultdict(set)
    for i, t in items:
        w = cut(t)
        for j in range(len(w) - n + 1):
            of[tuple(w[j : j + n])].add(i)
    out = set()
    for d, t in docs:
        w = cut(t)
        for j in range(len(w) - n + 1):
            out |= {(d, i) for i in of.get(tuple(w[j : j + n]), ())}
    return out


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_leaks_equal_brute_force(spark, broadcast_bytes):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(10, 80)))) for i in range(12)] + [(90, None), (91, ""), (92, "same " * 60)]
    docs = []
    for d in range(200):
        text = rng.choices(words, k=rng.randint(0, 60))
        if d % 2:
            source = items[rng.randrange(12)][1].split()
            n = rng.randint(20, 30)
            at = rng.randint(0, max(0, len(source) - n))
            text += [w.upper() for w in source[at : at + n]] + rng.choices(words, k=10)
        docs.append((d, rng.choice([" ", "-", ", "]).join(text)))
    docs += [(1000, None), (1001, ""), (1002, "same " * 40), (1003, docs[1][1]), (104, "K " + items[0][1] + " é")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    i = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1.5))
    got = {(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(d, i, broadcast_bytes=broadcast_bytes).collect()}
    assert got == brute_leaks(docs, items, 25) and len(got) > 10
    named = i.withColumn("item_id", F.concat(F.lit("item "), F.col("item_id").cast("string")))
    assert {(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(d, named, broadcast_bytes=broadcast_bytes).collect()} == {(a, f"item {b}") for a, b in got}
    assert leakage.find_leaks(d.filter("doc_id = 1000"), named).count() == 0
    assert leakage.find_leaks(d.limit(0), i).count() == 0 and leakage.find_leaks(d, i.limit(0)).count() == 0


def test_leaks_of_the_corpus(spark):
    d, i = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "eval_items"))
    want = brute_leaks([tuple(r) for r in d.select("doc_id", "text").collect()], [tuple(r) for r in i.select("item_id", "text").collect()], 25)
    assert {(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(d, i).collect()} == want


# --- repetition ------------------------------------------------------------------------------------


def brute_share(text, k=8):
    w = re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    seen, covered = set(), set()
    for i in range(len(w) - k + 1):
        g = tuple(w[i : i + k])
        if g in seen:
            covered.update(range(i, i + k))
        seen.add(g)
    return len(covered) / len(w) if w else 0.0


def test_repetition_equals_brute_force(spark):
    rng = random.Random(9)
    texts = [None, "", " \n", "a", "go " * 7, "go " * 8, "go " * 9, "Spam spam! " * 400, "x\ny\n" * 50, "z" * 100_000]
    for _ in range(40):
        base = [f"w{rng.randint(0, 30)}" for _ in range(rng.randint(5, 80))]
        texts.append("\n".join(" ".join(base[rng.randint(0, 5) :]) for _ in range(rng.randint(1, 4))))
    texts += texts[-3:]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("votes", F.lit(0))
    rows = {r["doc_id"]: r for r in repetition.judge_repetition(df).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        assert abs(rows[i]["repeated_share"] - brute_share(t)) < 1e-12
    assert rows[7]["posterior"] > 0.5 and repetition.judge_repetition(df.limit(0)).count() == 0


def test_posterior_chooses_candidates(spark):
    """Without the estimate other documents are checked; with it no repetitive one of the table is lost."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = repetition.judge_repetition(docs).collect()
    repeated = {r["doc_id"] for r in rows if r["repeated_share"] >= 0.3}
    candidates = {r["doc_id"] for r in rows if r["candidate"]}
    assert repeated and repeated <= candidates
    assert len(candidates) < 0.2 * len(rows)
    split = {r["doc_id"] for r in rows if "R" in r["votes"]}  # one vote would choose others
    assert candidates != split
    # A voter's word alone counts for little where the estimate gives it little weight.
    counts = {"CCCC": 900, "RRRR": 60, "RRRC": 20, "CCCR": 20}
    _, _, post = repetition.estimate(counts)
    assert repetition.chosen(counts, post) >= {"RRRR", "RRRC"} and "CCCC" not in repetition.chosen(counts, post)
    assert "CCCR" not in repetition.chosen(counts, post, 0.05)
    assert repetition.chosen({}, {}) == set()


def test_estimated_accuracies():
    rng = random.Random(1)
    counts = collections.Counter()
    truth = {}
    for _ in range(4000):
        y = rng.random() < 0.2
        v = "".join("-" if rng.random() < 0.2 else ("R" if y == (rng.random() < acc) else "C") for acc in (0.95, 0.9, 0.8, 0.85, 0.7))
        counts[v] += 1
        truth[v] = truth.get(v, 0) + (1 if y else 0)
    prior, rates, post = repetition.estimate(dict(counts))
    assert abs(prior - 0.2) < 0.05
    hit = rates[:, 1, 0] / (rates[:, 1, 0] + rates[:, 1, 1])
    assert all(abs(h - a) < 0.08 for h, a in zip(hit, (0.95, 0.9, 0.8, 0.85, 0.7)))
    assert sum(abs(post[v] - truth[v] / n) * n for v, n in counts.items()) / 4000 < 0.08
