"""Facts, graph, governor, sessions, assembly and extraction on small fixtures, with nulls, ties and empty tables."""

import datetime as dt
import random

import pytest
from compare import connection, duck_rows, spark_rows
from pyspark.sql import functions as F

from mnemolake.config import Settings, Tier, budgets_for, profile_for
from mnemolake.operators import assembly, extraction, facts, governor, graph, lessons, ordered, sessions
from mnemolake.operators.components import connected_components
from mnemolake.operators.consolidate import consolidate, label_clusters
from mnemolake.plans.queries import oracle_sql, queries

T0 = dt.datetime(2024, 1, 1)
FACTS = "id bigint, key string, value string, source string, ts timestamp_ntz, op string"


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def sequential(events):
    """The rule applied one event at a time."""
    out, live = [], {}
    for i, key, value, source, ts, op in sorted(events, key=lambda e: (e[4], e[0])):
        now = live.get(key)
        if op == "forget":
            if now:
                now["until"] = ts
                live.pop(key)
            continue
        if now and now["value"] == value:
            continue
        if now and source == "auto" and len(value) < 2:
            continue
        row = {"id": i, "value": value, "until": None, "by": None}
        if now:
            now["until"], now["by"] = ts, i
        live[key] = row
        out.append(row)
    return sorted((r["id"], r["value"], r["until"], r["by"]) for r in out)


@pytest.mark.parametrize("hot_rows", [10**6, 1])
def test_versions_equal_sequential_rule(spark, hot_rows):
    rng = random.Random(3)
    events = [(i, rng.choice(["tea", "city", "hot", "hot", "hot"]), rng.choice(["x", "yy", "zz", "long value"]), rng.choice(["auto", "explicit"]), at(rng.randint(0, 200)), rng.choice(["remember"] * 6 + ["forget"])) for i in range(160)]
    log = spark.createDataFrame(events + events[:20], FACTS)  # delivered twice
    v = facts.fact_versions(log, hot_rows=hot_rows)
    assert sorted((r["id"], r["value"], r["invalidated_at"], r["invalidated_by"]) for r in v.collect()) == sequential(events)
    assert v.filter("invalidated_at is null").groupBy("key").count().filter("count > 1").count() == 0
    changed = {r["id"] for r in facts.outcomes(log, hot_rows=hot_rows).filter("changed").collect()}
    assert changed == {r[0] for r in sequential(events)}


def test_fact_edges(spark):
    log = spark.createDataFrame([(1, None, "v", "auto", at(0), "remember"), (2, "k", None, "rule", at(1), "remember"), (3, "k", "v", "explicit", None, "remember"), (4, "k", "v" * 100_000, "explicit", at(2), "remember"), (5, "missing", None, "explicit", at(3), "forget")], FACTS)
    assert [r["id"] for r in facts.fact_versions(log).collect()] == [4]
    assert [r["reason"] for r in facts.quarantined(log).collect()] == ["key or value is empty"] * 2
    empty = spark.createDataFrame([], FACTS)
    assert facts.fact_versions(empty).count() == 0 and facts.outcomes(empty).count() == 0


def test_decay_and_as_of(spark):
    log = spark.createDataFrame([(1, "a", "old guess", "auto", at(0), "remember"), (2, "b", "kept", "explicit", at(0), "remember"), (3, "b", "new", "explicit", at(48), "remember")], FACTS)
    v = facts.fact_versions(log)
    late = F.lit(at(24 * 365)).cast("timestamp_ntz")
    assert {r["key"]: r["archived"] for r in facts.with_decay(facts.current_facts(v), late).collect()} == {"a": True, "b": False}
    touched = facts.with_access(facts.current_facts(v), spark.createDataFrame([(1, at(9))], "fact_id bigint, ts timestamp_ntz"))
    assert {r["key"]: r["archived"] for r in facts.with_decay(touched, late).collect()} == {"a": False, "b": False}
    assert {r["value"] for r in facts.facts_as_of(v, F.lit(at(24)).cast("timestamp_ntz")).collect()} == {"old guess", "kept"}


def test_neighbours_by_bucket(spark):
    rows = spark.createDataFrame([("a", i, i // 3) for i in range(10)] + [("b", 5, 1)], "key string, n int, day int")
    for bucket in (None, F.col("day")):
        got = ordered.with_neighbour(rows, ["key"], ["n"], bucket, {"n": "p"})
        assert {(r["key"], r["n"]): r["p"] for r in got.collect()} == {("a", i): (i - 1 if i else None) for i in range(10)} | {("b", 5): None}
        got = ordered.with_neighbour(rows, ["key"], ["n"], bucket, {"n": "p"}, following=True)
        assert {(r["key"], r["n"]): r["p"] for r in got.collect()}[("a", 2)] == 3
        got = ordered.with_running_sum(rows, ["key"], ["n"], bucket, F.col("n"), "s")
        assert {(r["key"], r["n"]): r["s"] for r in got.collect()}[("a", 9)] == 36


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000, i) for i in range(1001, 1400)] + [(5, 5), (None, 3)] + [(2000 + i, 2001 + i) for i in range(60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    want = {x: find(x) for x in list(parent)}
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "source bigint, target bigint")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "source bigint, target bigint")).count() == 0


NODE = "id bigint, type string, canonical_name string, aliases array<string>, created_at timestamp_ntz, updated_at timestamp_ntz, importance double, confidence double, mention_count bigint, cluster_id bigint, cluster_label string"
EDGE = "id bigint, source_node bigint, target_node bigint, relationship string, confidence double, importance double, weight double, created_at timestamp_ntz, last_seen timestamp_ntz, seen_count bigint, source_chunk_id bigint"


def graph_tables(spark):
    nodes = spark.createDataFrame([(i, "person", n, [n.title(), ""] if i != 3 else None, at(i), at(i), 0.5, 0.9, 1, None, None) for i, n in enumerate(["ann lee", "ann li", "bob", "cy", "dee"], 1)], NODE)
    edges = spark.createDataFrame([(1, 1, 3, "knows", 0.9, 0.5, 1.0, at(0), at(0), 1, None), (2, 2, 3, "knows", 0.9, 0.5, 1.0, at(0), at(0), 1, 7), (3, 3, 4, "uses", 0.9, 0.5, 1.0, at(0), at(0), 1, None), (4, 4, 4, "self", 0.9, 0.5, 1.0, at(0), at(0), 1, None)], EDGE)
    return nodes, edges


def test_graph(spark):
    nodes, edges = graph_tables(spark)
    asked = spark.createDataFrame([(1, "where is Ann Lee and BOB"), (2, "nobody"), (3, None)], "query_id bigint, text string")
    seeds = graph.seed_nodes(asked, nodes)
    assert [(r["query_id"], r["id"], r["rank"]) for r in seeds.orderBy("rank").collect()] == [(1, 1, 1), (1, 3, 2)]
    start = spark.createDataFrame([(9, 1), (8, 99)], "query_id bigint, id bigint")
    assert {(r["query_id"], r["id"], r["depth"]) for r in graph.expand(start, edges, 2).collect()} == {(9, 1, 0), (9, 3, 1), (9, 2, 2), (9, 4, 2), (8, 99, 0)}
    assert graph.expand(start, edges, 0).count() == 2
    pairs = graph.merge_candidates(nodes, F.lit(at(24)).cast("timestamp_ntz"), 7)
    assert [(r["keep_id"], r["drop_id"]) for r in pairs.collect()] == [(1, 2)]
    left, merged = graph.apply_merges(nodes, edges, pairs.select("keep_id", "drop_id"))
    assert sorted(r["id"] for r in left.collect()) == [1, 3, 4, 5] and sorted(r["id"] for r in merged.collect()) == [1, 3, 4]
    kept, cut = graph.capped(nodes, edges, Settings(node_cap=3, edge_cap=1))
    assert kept.count() == 3 and cut.count() <= 1
    members = graph.clusters(nodes, edges)
    assert {r["id"]: r["cluster_id"] for r in members.collect()} == {1: 1, 2: 1, 3: 1, 4: 1}
    assert label_clusters(nodes, members, lambda p: '"Friends"').head()["label"] == "Friends"
    assert label_clusters(nodes, members, lambda p: 1 / 0).count() == 0
    gone, faded = graph.decayed(nodes, edges, F.lit(at(24 * 400)).cast("timestamp_ntz"))
    assert gone.count() == 0 and faded.count() == 0
    swept = consolidate(spark.createDataFrame([], FACTS).transform(facts.fact_versions), nodes, edges, F.lit(at(24)).cast("timestamp_ntz"), call=lambda p: "yes")
    assert swept.stats() == {"archived": 0, "nodes": 4, "edges": 3, "clusters": 1}


def test_upserts(spark):
    log = spark.createDataFrame([(1, "person", " The Boss ", 0.5, 1, at(0)), (2, "person", "boss", 1.0, 1, at(1)), (3, "alien", "boss", None, None, at(2)), (4, "person", "  ", 0.5, 1, at(3)), (5, None, None, 0.5, 1, at(3))], "mention_id bigint, type string, name string, confidence double, mentions bigint, ts timestamp_ntz")
    got = {r["type"]: r for r in graph.upsert_nodes(log).collect()}
    assert got["person"]["mention_count"] == 2 and got["person"]["confidence"] == 0.75 and got["person"]["aliases"] == ["The Boss"] and got["entity"]["id"] == 3
    edges = spark.createDataFrame([(1, 1, 2, "Works  With", 0.4, 1, at(0), at(5), None), (2, 1, 2, "works with", 0.8, 1, at(1), at(3), 9), (3, 1, 1, "self", 0.5, 1, at(0), at(0), None), (4, 1, 2, " ", 0.5, 1, at(0), at(0), None), (5, None, 2, "x", 0.5, 1, at(0), at(0), None)], "mention_id bigint, source_node bigint, target_node bigint, relationship string, confidence double, mentions bigint, created_at timestamp_ntz, last_seen timestamp_ntz, source_chunk_id bigint")
    rows = graph.upsert_edges(edges).collect()
    assert len(rows) == 1 and rows[0]["seen_count"] == 2 and round(rows[0]["confidence"], 9) == 0.6 and rows[0]["last_seen"] == at(5) and rows[0]["source_chunk_id"] is None


def test_upsert_of_nodes_without_mentions(spark, tmp_path):
    log = spark.createDataFrame([(1, "person", "ann", 0.9, 0, at(0)), (2, "person", "bob", 0.9, 0, at(1)), (3, "person", "bob", 0.4, 2, at(2))], "mention_id bigint, type string, name string, confidence double, mentions bigint, ts timestamp_ntz")
    got = {r["canonical_name"]: (r["mention_count"], r["confidence"]) for r in graph.upsert_nodes(log).collect()}
    assert got == {"ann": (0, None), "bob": (2, 0.4)}
    # The query shows the mean of no mentions as its SQL does.
    rows = [(1, "person", "ann", None, at(0), at(1), 0.9, 0), (2, "person", "bob", ["Bob"], at(0), at(1), 0.9, 0)]
    spark.createDataFrame(rows, "id bigint, type string, canonical_name string, aliases array<string>, created_at timestamp_ntz, updated_at timestamp_ntz, confidence double, mention_count bigint").write.parquet(str(tmp_path / "graph_nodes.parquet"))
    mine = spark_rows(queries()["graph_nodes_upsert"](spark, str(tmp_path)))
    assert mine == duck_rows(connection(str(tmp_path)), oracle_sql()["graph_nodes_upsert"]) and "'nan'" in mine[1][0]


def test_governor(spark):
    for total, free, tier in ((32, 20, 2), (16, 8, 2), (8, 4, 1), (16, 3, 1), (4, 2, 0), (8, 1, 0)):
        assert governor.classify_value(total, free) == tier
    b = budgets_for(Settings(static_prompt_tokens=1200), Tier.FULL)
    assert b.working == int((4096 - 512 - 600 - 1200) * 0.55) and b.facts == int((1784 - b.working) * 0.4)
    assert profile_for(Settings(lite_llm=True), Tier.LITE).cadence == "session_end"
    now, changes = [16.0, 8.0], []
    g = governor.Governor(Settings(upgrade_healthy_ticks=2), probe=lambda: tuple(now), on_change=lambda a, b: changes.append((a, b)))
    now[1] = 1.0
    g.tick()
    now[1] = 8.0
    tiers = [int((g.tick(), g.tier)[1]) for _ in range(4)]
    assert changes[0] == (Tier.FULL, Tier.LITE) and tiers == [0, 1, 1, 2]
    g.report_pressure(100.0), g.report_pressure(110.0), g.report_pressure(139.0)
    assert g.tier == Tier.STANDARD
    g.report_pressure(170.0)
    assert g.tier == Tier.LITE
    with pytest.raises(TypeError, match="context_tokens"):
        g.reconfigure(nonsense=1)
    with pytest.raises(ValueError):
        Settings(context_tokens=10)


def test_governor_fold_by_bucket(spark):
    rng = random.Random(1)
    rows = [(h, T0 + dt.timedelta(minutes=37 * i), i, 32.0, rng.choice([0.5, 2.0, 4.0, 9.0, 9.0, 9.0])) for h in ("a", "b") for i in range(150)]
    t = spark.createDataFrame(rows, "host string, ts timestamp_ntz, id bigint, total double, available double")
    s = Settings(upgrade_healthy_ticks=3)
    plain = {(r["host"], r["id"]): r["tier"] for r in governor.fold_tiers(t, s).collect()}
    spread = {(r["host"], r["id"]): r["tier"] for r in governor.fold_tiers(t, s, hot_rows=5).collect()}
    assert plain == spread and set(plain.values()) == {0, 1, 2}


MSG = "id bigint, session_id bigint, turn int, role string, content string, created_at timestamp_ntz, token_estimate int"


def test_sessions(spark):
    m = spark.createDataFrame(
        [(1, 1, 1, " User", "Fix the brakes. Soon!", at(0), None), (2, 1, 1, "ASSISTANT\n", "Done.", at(0), 3), (3, 1, 2, "user", "again", at(1), 2), (4, 1, None, "user", "lost", at(1), 1), (5, None, 1, "user", "x", at(1), 1), (6, 2, 1, "user", " \n", None, 1), (7, 1, 1, "user", "Fix the brakes. Soon!", at(2), 4)], MSG
    )
    e = sessions.exchanges(m).collect()
    assert [(r["first_msg_id"], r["last_msg_id"], r["text"]) for r in e] == [(1, 2, "User: Fix the brakes. Soon!\nAssistant: Done.")]
    assert [r["id"] for r in sessions.session_tail(m, 4).orderBy("id").collect()] == [7]
    assert [r["id"] for r in sessions.session_tail(m, 7).orderBy("id").collect()] == [3, 4, 7]
    s = spark.createDataFrame([(1, at(0), None, None, None, None, 9, None), (3, at(0), at(1), "t", None, None, 0, None)], "id bigint, started_at timestamp_ntz, ended_at timestamp_ntz, title string, summary string, rolling_summary string, message_count int, host_tag string")
    got = {r["id"]: (r["title"], r["message_count"], r["was_open"]) for r in sessions.session_rollup(s, m, F.lit(at(9)).cast("timestamp_ntz")).collect()}
    assert got == {1: ("Fix the brakes. Soon!", 5, True), 3: ("t", 0, False)}
    assert sessions.extractive_summary(m, 100).head()["summary"] == "- Fix the brakes.\n- again\n- lost"
    empty = spark.createDataFrame([], MSG)
    assert sessions.exchanges(empty).count() == 0 and sessions.extractive_summary(empty, 9).count() == 0


def test_chunk_packing(spark):
    long = " ".join(f"Sentence number {i} is here." for i in range(40))
    rows = spark.createDataFrame([(1, long), (2, "short\nline"), (3, "x" * 900)], "id bigint, t string")
    got = {r["id"]: r["p"] for r in rows.select("id", sessions.pack_sentences(F.col("t"), 50).alias("p")).collect()}
    assert len(got[1]) > 1 and " ".join(got[1]) == long and all(len(p) <= 203 for p in got[1])
    assert got[2] == ["short\nline"] and got[3] == ["x" * 900]
    words = rows.filter("id = 1").select(sessions.pack_sentences(F.col("t"), 12, lambda c: F.size(F.split(c, " "))).alias("p")).head()["p"]
    assert all(len(p.split()) <= 12 for p in words) and " ".join(words) == long


def test_lessons(spark):
    log = spark.createDataFrame([(i, t, None, at(i)) for i, t in enumerate(["a", "b", "c", "a", "d", " ", None, "e"], 1)], "seq bigint, text string, tag string, ts timestamp_ntz")
    kept = lessons.lessons(log, 3)
    assert [r["text"] for r in lessons.newest_lessons(kept, 5).collect()] == ["c", "d", "e"]
    assert kept.filter("text = 'a'").head()["use_count"] == 1


def test_fit_is_a_prefix(spark):
    lines = spark.createDataFrame([(1, i, "x" * (4 * n)) for i, n in enumerate([3, 3, 9, 1])], "q int, i int, line string")
    assert [r["i"] for r in assembly.fit_lines(lines, ["q"], [F.col("i")], 8).collect()] == [0, 1]
    assert assembly.fit_lines(lines, ["q"], [F.col("i")], 3, tokens=lambda c: F.lit(1)).count() == 3


def test_extraction(spark):
    full = 'Sure! {"facts": {"city": "Oslo", "n": 3, "bad": ["x"], "nil": null}, "entities": [{"name": "Oslo", "type": "place"}, {"type": "x"}, 7, {"name": "Ann"}], "relationships": [{"source": "Ann", "relation": "lives in", "target": "Oslo"}, {"source": "Ann"}]} bye'
    out = spark.createDataFrame([(1, full), (2, '{"city": "Rome"}'), (3, "NONE {}"), (4, "{broken"), (5, ""), (6, None), (7, '{"entities": "none"}')], "id bigint, completion string")
    assert {(r["id"], r["key"], r["value"]) for r in extraction.parsed_facts(out).collect()} >= {(1, "city", "Oslo"), (1, "n", "3"), (2, "city", "Rome")}
    assert not [r for r in extraction.parsed_facts(out).collect() if r["key"] in ("bad", "nil")]
    assert [(r["type"], r["name"]) for r in extraction.parsed_entities(out).orderBy("pos").collect()] == [("place", "Oslo"), ("entity", "Ann")]
    assert [(r["source"], r["target"]) for r in extraction.parsed_relationships(out).collect()] == [("Ann", "Oslo")]

    def call(prompt):
        if prompt == "boom":
            raise RuntimeError
        return None if prompt == "none" else " ok "

    asked = spark.createDataFrame([("boom",), ("none",), ("x",)], "prompt string")
    assert [r["completion"] for r in extraction.complete(asked, call).collect()] == ["", "", "ok"]
