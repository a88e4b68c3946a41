"""The facade and the streams end to end."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from mnemolake.api import open_memory
from mnemolake.config import Settings, Tier, profile_for
from mnemolake.operators import assembly
from mnemolake.sources import tables
from mnemolake.streaming import pipeline

T0 = dt.datetime(2024, 1, 1)


def test_memory_store(spark, tmp_path):
    m = open_memory(spark, str(tmp_path / "mem"), probe=lambda: (32.0, 20.0), as_of="2024-06-01")
    assert m.profile.tier == Tier.FULL
    assert m.record_turn("My name is Priya and I repair car brakes", "Nice to meet you. Worn pads squeal.") == 1
    assert m.record_turn("We painted the kitchen green", "Green suits kitchens.") == 2
    assert m.remember("city", "Oslo") == (True, "stored")
    assert m.remember("city", "Oslo") == (False, "already stored")
    assert m.remember("city", "Rome") == (True, "stored")
    assert m.remember("mood", "unknown", "auto")[0] is False
    assert {r["key"]: r["value"] for r in m.facts().collect()} == {"name": "Priya", "city": "Rome"}
    assert [r["value"] for r in m.fact_history("City").collect()] == ["Oslo", "Rome"]
    assert m.timeline("city").head()["resolved_by"] == "exact"
    assert [r["key"] for r in m.quarantine().collect()] == ["mood"]
    best = m.recall("squealing brake pads", 2).collect()
    assert best[0]["kind"] == "chunk" and "brakes" in best[0]["text"]
    assert m.add_lesson("be brief") and not m.add_lesson(" ")
    prompt = m.build_context("brakes")
    assert "- name: Priya" in prompt and "- be brief" in prompt and prompt.startswith("WHAT YOU KNOW")
    assert m.table("access_log").count() == 2
    assert m.forget("city") is True and m.forget("city") is False
    assert m.sessions().head()["message_count"] == 4
    session = m.session_id
    m.report_evictions([("a b", "c")])
    m.end_session()
    assert [r["role"] for r in m.resume_session(session).collect()] == ["user", "assistant"] * 2
    assert m.resume_session().count() == 4 and m.session_id is None and m.rolling_summary.startswith("(1 turns omitted")
    assert {r["name"]: r["rows"] for r in m.stats().collect()}["messages"] == 4
    assert m.report_evictions([("a b", "c")]).endswith("(1 more omitted)")
    parts = m.explain("brakes kitchen")
    row = parts["chunks"].head()
    assert abs(row["total"] - row["relevance"] - row["importance_nudge"] - row["recency_nudge"] - row["graph_nudge"]) < 1e-9
    with pytest.raises(AttributeError):
        m.path = "elsewhere"
    with pytest.raises(TypeError):
        open_memory(spark, str(tmp_path / "x"), colour="red")
    m.close()


def test_model_extraction_and_like_fallback(spark, tmp_path):
    answer = '{"facts": {"pet": "a cat called Tom"}, "entities": [{"name": "Tom", "type": "thing"}], "relationships": [{"source": "Tom", "relation": "lives with", "target": "user"}]}'
    m = open_memory(spark, str(tmp_path / "mem"), llm=lambda p: answer, embed=None, text_index="like", probe=lambda: (32.0, 20.0), as_of="2024-06-01")
    m.record_turn("I have a very lazy cat", "Lovely.")
    assert m.pending() == 0  # the profile extracts after each turn
    assert m.facts().head()["value"] == "a cat called Tom"
    assert m.clusters().head()["size"] == 2
    assert "lazy cat" in m.recall("lazy", 1).head()["text"]
    assert m.table("graph_edges").count() == 1 and m.table("graph_nodes").count() == 2
    # The same said again adds counts, but no nodes and no edges; the edge knows its chunk.
    m.extract()
    assert {r["canonical_name"]: (r["type"], r["mention_count"]) for r in m.table("graph_nodes").collect()} == {"tom": ("thing", 2), "user": ("entity", 2)}
    edge = m.table("graph_edges").head()
    assert edge["seen_count"] == 2 and edge["source_chunk_id"] == m.table("chunks").head()["id"]
    assert m.clusters().head()["names"] == "tom, user" and m.facts().count() == 1


def test_corrupt_table_is_set_aside(spark, tmp_path):
    bad = tmp_path / "mem" / "messages.parquet"
    bad.mkdir(parents=True)
    (bad / "part-0.parquet").write_bytes(b"not parquet at all")
    m = open_memory(spark, str(tmp_path / "mem"), probe=lambda: (4.0, 2.0))
    assert m.profile.tier == Tier.LITE and m.table("messages").count() == 0
    assert [p.name for p in (tmp_path / "mem").iterdir() if "corrupt" in p.name]


def test_other_errors_do_not_set_a_table_aside(spark, tmp_path, monkeypatch):
    m = open_memory(spark, str(tmp_path / "mem"), probe=lambda: (4.0, 2.0))
    m.add_lesson("kept")

    def fails(*_):
        from pyspark.errors import PySparkException

        raise PySparkException("connection reset")

    monkeypatch.setattr(tables, "read_table", fails)
    with pytest.raises(Exception, match="connection reset"):
        tables.open_table(spark, m.path, "lesson_events")
    monkeypatch.undo()
    assert m.table("lesson_events").count() == 1


def test_sessions_left_open_and_deferred_work(spark, tmp_path):
    said = []

    def llm(prompt):
        return '{"facts": {"pet": "a cat"}}'

    options = dict(llm=llm, embed=None, probe=lambda: (8.0, 4.0), as_of="2024-06-01")  # a standard machine extracts every two turns
    m = open_memory(spark, str(tmp_path / "mem"), **options)
    m.record_turn("I have one lazy cat", "Lovely.")
    assert m.pending() == 1 and m.facts().count() == 0
    m.foreground_begin()
    m.record_turn("I have one more cat", "Oh.")
    assert m.pending() == 2
    m.foreground_end()
    assert m.pending() == 0 and m.facts().head()["value"] == "a cat"
    first = m.session_id
    again = open_memory(spark, str(tmp_path / "mem"), **options)  # as after a crash
    assert again.session_table().filter(F.col("id") == first).head()["ended_at"] is not None
    second = again.begin_session()
    assert again.begin_session() == second + 1 and again.session_table().filter("ended_at is null").count() == 1
    assert again.embed_pending() == 0 and said == []
    again.close()
    assert again.session_table().filter("ended_at is null").count() == 0


def test_vectors_filled_in_later(spark, tmp_path):
    m = open_memory(spark, str(tmp_path / "mem"), embed=None, probe=lambda: (32.0, 20.0), as_of="2024-06-01")
    m.record_turn("My bicycle needs a new chain", "Which one?")
    m.record_turn("The garden needs water", "Yes.")
    late = open_memory(spark, str(tmp_path / "mem"), probe=lambda: (32.0, 20.0), as_of="2024-06-01")
    assert [late.embed_pending(1), late.embed_pending(5), late.embed_pending(5)] == [1, 1, 0]
    assert late.chunks().filter("embedding is not null and embedding_model = 'hash-64'").count() == 2
    assert late.explain("bicycle chain")["chunks"].head()["vector"] == 1.0


def test_consolidation_has_effect(spark, tmp_path):
    def llm(prompt):
        return "Oslo, then Rome" if prompt.startswith("Key: city") else "yes" if "same thing" in prompt else "'Kept ones'"

    m = open_memory(spark, str(tmp_path / "mem"), llm=llm, embed=None, probe=lambda: (32.0, 20.0), as_of="2024-06-01", node_cap=3)
    m.remember("city", "Oslo")
    m.remember("city", "Rome")
    stamp = dt.datetime(2024, 5, 30)
    nodes = [(i, "person", n, None, stamp + dt.timedelta(hours=i), stamp, 0.5, c, 1, 77, "old" if i == 4 else None) for i, (n, c) in enumerate([("ann lee", 0.9), ("ann li", 0.9), ("bob", 0.9), ("cy", 0.9), ("faded", 0.01)], 1)]
    tables.replace_table(spark.createDataFrame(nodes, tables.SCHEMAS["graph_nodes"]), m.path, "graph_nodes")
    edges = [(i, a, b, "knows", 0.9, 0.5, 1.0, stamp, stamp, 1, None) for i, (a, b) in enumerate([(1, 3), (2, 3), (5, 3)], 1)]
    tables.replace_table(spark.createDataFrame(edges, tables.SCHEMAS["graph_edges"]), m.path, "graph_edges")
    assert m.consolidate().stats() == {"archived": 0, "nodes": 3, "edges": 1, "clusters": 1}
    got = {r["id"]: (r["cluster_id"], r["cluster_label"]) for r in m.table("graph_nodes").collect()}
    assert got == {1: (1, "Kept ones"), 3: (1, "Kept ones"), 4: (None, None)}  # merged, faded, stamped, and cleared
    assert {r["key"]: r["value"] for r in m.facts().collect()} == {"city": "Oslo, then Rome"}
    assert m.clusters().head()["label"] == "Kept ones"


def test_rolling_fold(spark):
    before = spark.createDataFrame([(1, "earlier"), (2, "earlier"), (3, None), (4, "alone")], "session_id bigint, summary string")
    turns = [(1, 0, "Fix it. Now"), (1, 1, "  "), (1, 2, "fix it. now"), (1, 3, "Paint"), (2, 0, "Earlier"), (3, 0, None), (5, 0, "New " + "x" * 200), (6, 0, "y" * 400)]
    turns = spark.createDataFrame(turns, "session_id bigint, pos bigint, user_text string")
    assert {r["session_id"]: r["summary"] for r in assembly.rolling_fold(before, turns, 100).collect()} == {1: "earlier\n- Fix it.\n- Paint", 2: "earlier", 4: "alone", 5: "- New " + "x" * 116, 6: "- " + "y" * 120}
    short = {r["session_id"]: r["summary"] for r in assembly.rolling_fold(before, turns, 1).collect()}
    assert short == {1: "- Paint", 2: "earlier", 4: "alone"}
    assert assembly.rolling_fold(before.limit(0), turns.limit(0), 9).count() == 0


def write_stream_input(spark, path):
    rows = [(i, 1 if i < 12 else 2, i // 2 + 1, "user" if i % 2 == 0 else "assistant", f"My favorite tool is saw{i} though, message {i}", T0 + dt.timedelta(minutes=i), 5) for i in range(16)]
    df = spark.createDataFrame(rows, "id bigint, session_id bigint, turn int, role string, content string, created_at timestamp_ntz, token_estimate int")
    df.repartition(1).write.mode("append").parquet(path)
    return df


def test_ingest_stream(spark, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "mem")
    write_stream_input(spark, src)
    for _ in range(2):
        q = pipeline.ingest(pipeline.message_stream(spark, src), root, str(tmp_path / "ck"))
        q.awaitTermination()
    assert tables.read_table(spark, root, "messages").count() == 16
    chunks = tables.read_table(spark, root, "chunks")
    assert chunks.count() == 8 and chunks.filter("embedding is not null").count() == 8
    assert tables.read_table(spark, root, "fact_events").filter("key = 'favorite_tool'").count() == 8


def test_ingest_is_exactly_once_over_failures_and_split_turns(spark, tmp_path, monkeypatch):
    src, root, ck = (str(tmp_path / n) for n in ("in", "mem", "ck"))
    rows = [(i, 1, i // 2 + 1, "user" if i % 2 == 0 else "assistant", f"My favorite tool is saw{i} though", T0 + dt.timedelta(minutes=i), 5) for i in range(8)]
    columns = "id bigint, session_id bigint, turn int, role string, content string, created_at timestamp_ntz, token_estimate int"
    for part in ([0, 2, 4], [1, 3, 0, 6], [5]):  # replies come later than their questions, one row comes twice
        spark.createDataFrame([rows[i] for i in part], columns).repartition(1).write.mode("append").parquet(src)
        write = tables.write_batch
        fail = [True]

        def breaks(df, root, name, batch_id):
            write(df, root, name, batch_id)
            if fail.pop() if fail else False:
                raise RuntimeError("lost in between")

        monkeypatch.setattr(pipeline, "write_batch", breaks)
        with pytest.raises(Exception, match="lost in between"):
            pipeline.ingest(pipeline.message_stream(spark, src), root, ck).awaitTermination()
        pipeline.ingest(pipeline.message_stream(spark, src), root, ck).awaitTermination()
        monkeypatch.setattr(pipeline, "write_batch", write)
    assert sorted(r["id"] for r in tables.read_table(spark, root, "messages").collect()) == [0, 1, 2, 3, 4, 5, 6]
    assert sorted((r["first_msg_id"], r["last_msg_id"]) for r in tables.read_table(spark, root, "chunks").collect()) == [(0, 1), (2, 3), (4, 5)]
    found = tables.read_table(spark, root, "fact_events")
    assert found.count() == 4 and found.filter("id < 0").select("id").distinct().count() == 4
    m = open_memory(spark, root, probe=lambda: (32.0, 20.0), as_of="2024-06-01")
    assert m.facts().head()["value"] == "saw6" and m.recall("saw4", 1).count() == 1


def test_batched_cadence_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    write_stream_input(spark, src)
    turns = pipeline.message_stream(spark, src).filter("role = 'user'").select("session_id", "turn", F.col("content").alias("text"), F.lit(False).alias("ended"))
    jobs = pipeline.extraction_jobs(turns, profile_for(Settings(), Tier.STANDARD))
    q = jobs.writeStream.format("memory").queryName("jobs").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    # Processing-time timeouts keep micro-batches coming, so the query never drains: the rows are awaited instead.
    for _ in range(80):
        if spark.table("jobs").count() >= 4 or not q.isActive:
            break
        time.sleep(0.5)
    q.stop()
    assert sorted((r["session_id"], r["turns"], r["last_turn"]) for r in spark.sql("select * from jobs").collect()) == [(1, 2, 2), (1, 2, 4), (1, 2, 6), (2, 2, 8)]


def test_windows_stream_equals_batch(spark, tmp_path):
    rows = [(u, T0 + dt.timedelta(minutes=m)) for u, ms in ((1, (0, 10, 50, 51)), (2, (5, 34, 65))) for m in ms]
    events = spark.createDataFrame(rows, "user_id bigint, ts timestamp_ntz")
    events.write.parquet(str(tmp_path / "e"))
    batch = {tuple(r) for r in pipeline.activity_windows(events, "user_id", "ts").select("user_id", "events").collect()}
    stream = spark.readStream.schema("user_id bigint, ts timestamp_ntz").parquet(str(tmp_path / "e"))
    q = pipeline.activity_windows(stream, "user_id", "ts").writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r["user_id"], r["events"]) for r in spark.sql("select * from w").collect()} == batch == {(1, 2), (2, 2), (2, 1)}
    assert pipeline.rolling_counts(events, "ts", "user_id").filter("user_id = 1").head()["rows"] == 4
