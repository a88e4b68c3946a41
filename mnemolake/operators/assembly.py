"""Prompt sections under token budgets, for many queries at once.

A section keeps the longest prefix of its ordered lines that fits. Every line
costs at least one token, so a budget of B needs at most B + 1 candidate lines;
that bound, and not the number of facts, sizes every window here.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..config import GRAPH_SHARE, Profile, Settings
from ..functions.text import condense, estimate_tokens, leading_clause
from . import graph
from .facts import days_between, latest_first
from .lessons import newest_lessons
from .retrieval import Memory, explain_chunks, fact_relevance, walk

#: Sections in the order in which they are rendered, with their titles (fixed values).
SECTIONS = (
    ("user_facts", "WHAT YOU KNOW ABOUT THE USER"),
    ("graph_context", "RELATED TOPICS"),
    ("relevant_past_moments", "RELEVANT PAST MOMENTS (from earlier conversations)"),
    ("previous_sessions", "PREVIOUS SESSIONS"),
    ("lessons", "LESSONS FROM PAST MISTAKES"),
)
FACT_FLOOR = 0.3

Tokens = Callable[[Column], Column]


def fit_lines(lines: DataFrame, keys: list[str], order: list[Column], budget: int, line: str = "line", *, tokens: Tokens = estimate_tokens) -> DataFrame:
    """The prefix of each key's lines whose tokens fit the budget, with `position` and running `used`.

    `tokens` counts the tokens of a text column, at least 1 for any text.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    numbered = lines.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= budget + 1)
    return numbered.withColumn("used", F.sum(tokens(F.col(line))).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("used") <= budget)


def joined(lines: DataFrame, keys: list[str], section: str) -> DataFrame:
    """(keys, section, body) of fitted lines."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy(*keys).agg(body.alias("body")).withColumn("section", F.lit(section))


def facts_lines(queries: DataFrame, live: DataFrame, versions: DataFrame, as_of: Column, budget: int, settings: Settings = Settings(), *, tokens: Tokens = estimate_tokens) -> DataFrame:
    """(query_id, fact_id, line, position, used): profile facts first, then notes by relevance x importance x recency.

    Facts that a query does not match have the floor 0.3 and so one order for
    all queries: the first budget + 1 of it and the matched ones suffice.
    """
    line = F.concat(F.lit("- "), "key", F.lit(": "), "value")
    base = F.col("importance") * F.exp(-days_between(as_of, F.col("valid_from")) / settings.fact_recency_days)
    rows = live.select("id", "category", "importance", "valid_from", line.alias("line"), F.when(F.col("category") == "profile", 1).otherwise(0).alias("lead"), base.alias("base"))
    order = [F.col("lead").desc(), F.when(F.col("lead") == 1, 0.0).otherwise(F.round("base", 12)).desc(), *latest_first(rows)]
    head = rows.orderBy(*order).limit(budget + 1)
    hits = fact_relevance(queries, versions, settings).select("query_id", F.col("fact_id").alias("id"), "relevance")
    usual = queries.select("query_id").crossJoin(F.broadcast(head))
    matched = hits.select("query_id", "id").join(rows, "id")
    every = usual.unionByName(matched.select(*usual.columns)).dropDuplicates(["query_id", "id"]).join(hits, ["query_id", "id"], "left")
    score = F.when(F.col("lead") == 1, 0.0).otherwise(F.round(F.coalesce("relevance", F.lit(FACT_FLOOR)) * F.col("base"), 12))
    fitted = fit_lines(every.withColumn("_score", score), ["query_id"], [F.col("lead").desc(), F.col("_score").desc(), *latest_first(every)], budget, tokens=tokens)
    return fitted.select("query_id", F.col("id").alias("fact_id"), "line", "position", "used")


def episodic_lines(queries: DataFrame, memory: Memory, as_of: Column, profile: Profile, settings: Settings = Settings(), usable_chunks: DataFrame | None = None, *, reached: tuple[DataFrame, DataFrame] | None = None, tokens: Tokens = estimate_tokens) -> DataFrame:
    """(query_id, line, position, used): the best chunks outside the query's own session, condensed."""
    hits = explain_chunks(queries, memory, as_of, k=profile.episodic_top_k, hops=profile.graph_hops, settings=settings, usable_chunks=usable_chunks, reached=reached)
    lines = hits.select("query_id", "rank", F.concat(F.lit("- ["), "date", F.lit("] "), condense(F.col("text"))).alias("line"))
    return fit_lines(lines, ["query_id"], [F.col("rank")], profile.budgets.episodic, tokens=tokens).select("query_id", "line", "position", "used")


def graph_lines(queries: DataFrame, memory: Memory, profile: Profile, *, reached: DataFrame | None = None, tokens: Tokens = estimate_tokens) -> DataFrame:
    """(query_id, line, position, used): reached names by cluster label, labelled clusters first; `reached` is (query_id, id) where it is known."""
    if reached is None:
        reached = graph.expand(graph.seed_nodes(queries, memory.nodes), memory.edges, profile.graph_hops)
    named = reached.join(memory.nodes.select("id", "canonical_name", F.nullif("cluster_label", F.lit("")).alias("label")), "id")
    lists = named.groupBy("query_id", "label").agg(F.array_join(F.array_sort(F.collect_set("canonical_name")), ", ").alias("names"))
    lines = lists.select("query_id", "label", F.concat(F.lit("- "), F.coalesce(F.concat("label", F.lit(": ")), F.lit("")), "names").alias("line"))
    budget = int(profile.budgets.episodic * GRAPH_SHARE)
    return fit_lines(lines, ["query_id"], [F.col("label").isNull(), F.col("label")], budget, tokens=tokens).select("query_id", "line", "position", "used")


def sessions_lines(sessions: DataFrame, budget: int, n: int = 5, *, tokens: Tokens = estimate_tokens) -> DataFrame:
    """(id, line, position, used): the n latest non-empty summaries, oldest first."""
    latest = sessions.filter("summary is not null and summary != ''").orderBy(F.col("id").desc()).limit(n)
    return fit_lines(latest.select(F.lit(0).alias("_all"), "id", F.concat(F.lit("- "), "summary").alias("line")), ["_all"], [F.col("id")], budget, tokens=tokens).select("id", "line", "position", "used")


def lessons_lines(kept: DataFrame, budget: int, n: int = 5, *, tokens: Tokens = estimate_tokens) -> DataFrame:
    """(id, line, position, used): the n newest lessons, oldest first."""
    rows = newest_lessons(kept, n).select(F.lit(0).alias("_all"), "id", F.concat(F.lit("- "), "text").alias("line"))
    return fit_lines(rows, ["_all"], [F.col("id")], budget, tokens=tokens).select("id", "line", "position", "used")


def rolling_fold(previous: DataFrame, turns: DataFrame, budget: int, *, tokens: Tokens = estimate_tokens) -> DataFrame:
    """(session_id, summary): earlier summaries with the leading clauses of evicted turns folded in, for any number of sessions.

    `previous` has (session_id, summary), at most one a session; `turns` has
    (session_id, pos, user_text). The summary is the first line, then one line
    a clause in the order of `pos`; lines that repeat an earlier one in any case
    are left out. The newest lines that fit the budget are kept, so the earlier
    summary goes first. A session of which nothing fits gives no row.
    """
    old = previous.filter("summary is not null and summary != ''").select("session_id", F.lit(None).cast("bigint").alias("pos"), F.col("summary").alias("said"), F.col("summary").alias("line"))
    clause = leading_clause(F.col("user_text"))
    new = turns.select("session_id", F.col("pos").cast("bigint"), clause.alias("said")).filter("said != ''").withColumn("line", F.concat(F.lit("- "), "said"))
    once = old.unionByName(new).groupBy("session_id", F.lower("said").alias("_low")).agg(F.min(F.struct(F.coalesce("pos", F.lit(-(1 << 62))).alias("at"), "line")).alias("first")).select("session_id", "first.at", "first.line")
    kept = fit_lines(once, ["session_id"], [F.col("at").desc()], budget, tokens=tokens)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"])
    return kept.groupBy("session_id").agg(F.array_join(lines, "\n").alias("summary"))


def build_context(queries: DataFrame, memory: Memory, sessions: DataFrame, lessons: DataFrame, as_of: Column, profile: Profile, settings: Settings = Settings(), usable_chunks: DataFrame | None = None, *, facts: DataFrame | None = None, tokens: Tokens = estimate_tokens) -> DataFrame:
    """(query_id, section, body): the non-empty sections of every query.

    The graph is walked once for the sections that need it; `facts` are the
    lines of `facts_lines` where the caller has them already.
    """
    queries = checkpointed(queries)  # every section reads them
    if facts is None:
        live = memory.versions.filter("invalidated_at is null")
        facts = facts_lines(queries, live, memory.versions, as_of, profile.budgets.facts, settings, tokens=tokens)
    reached, leg = walk(queries, memory, profile.graph_hops)
    own = [
        joined(facts, ["query_id"], "user_facts"),
        joined(graph_lines(queries, memory, profile, reached=reached, tokens=tokens), ["query_id"], "graph_context"),
        joined(episodic_lines(queries, memory, as_of, profile, settings, usable_chunks, reached=leg, tokens=tokens), ["query_id"], "relevant_past_moments"),
    ]
    shared = [
        joined(sessions_lines(sessions, profile.budgets.sessions, tokens=tokens).withColumn("_all", F.lit(0)), ["_all"], "previous_sessions"),
        joined(lessons_lines(lessons, profile.budgets.lessons, settings.lessons_in_prompt, tokens=tokens).withColumn("_all", F.lit(0)), ["_all"], "lessons"),
    ]
    parts = [p.select("query_id", "section", "body") for p in own] + [queries.select("query_id").crossJoin(F.broadcast(p.select("section", "body"))) for p in shared]
    return reduce(DataFrame.unionByName, parts).filter("body != ''")


def render(context: DataFrame) -> DataFrame:
    """(query_id, prompt): titled sections in their fixed order, with an empty line between."""
    place, title = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, (name, text) in enumerate(SECTIONS):
        place, title = F.when(F.col("section") == name, i).otherwise(place), F.when(F.col("section") == name, text).otherwise(title)
    blocks = context.select("query_id", F.struct(place.alias("i"), F.concat(title, F.lit("\n"), "body").alias("block")).alias("b"))
    return blocks.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["block"]), "\n\n").alias("prompt"))
