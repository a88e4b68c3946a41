"""Conversations rebuilt from message rows.

A session is a system of reply-before constraints over places: turn t has a
question and a reply, the question stands before its reply and the reply before
the next question. The system can be solved if the places 1, 2, 3 ... are all
held by one text each and joined by all constraints between neighbours; else
the session is rejected. Two senders' clocks may disagree; the offset that fits
the constraints best is estimated by least squares per session, kept within
what they allow, and taken off the assistant's timestamps, by which the system
rows are merged into the turns. All decisions come from fixed-width aggregates
in two steps (by turn, then by session), so a session of any size is never
gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..operators.ordered import bucket_if_hot, with_running_sum

BLANKS = " \t\r\n"
#: Turns of a session that one task joins; a longer session is spread.
TURN_BLOCK = 10_000


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"\A[ \t\r\n]+|[ \t\r\n]+\z", "")


def stated_rows(messages: DataFrame) -> DataFrame:
    """(session_id, turn, role, text, id, micros) of the rows with a session and content.

    `role` is lower case without outer blanks, `text` the content without
    outer blanks.
    """
    text, role = _trim(F.col("content").cast("string")), F.lower(_trim(F.col("role")))
    rows = messages.select(F.col("session_id").cast("bigint"), F.col("turn").cast("int"), role.alias("role"), text.alias("text"), "id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("micros"))
    return rows.filter("session_id is not null and text is not null and text != ''")


def clean_rows(messages: DataFrame) -> DataFrame:
    """The stated rows by which a session is judged: system rows are set aside."""
    return stated_rows(messages).filter("not role <=> 'system'")


def assess_sessions(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """One row per session id of either table, with the reason it is dropped or null.

    Columns: session_id, turns, offset_micros (assistant's clock minus the
    user's), clock_feasible, reason. A session is kept only if it has a row in
    `sessions`, a turn is left, all roles are user or assistant (system rows
    aside), no turn number is null, and its constraints can be solved: the turns
    are 1, 2, 3 ... without a gap, and each has one user text and one assistant
    text (texts that differ only in outer blanks are one), so that of T turns 2 T
    places are held and 2 T - 1 constraints join them. Infeasible constraints reject a session;
    times alone cannot, since rows arrive late: an empty interval of clock offsets
    only sets `clock_feasible` to false, and the offset to 0. Null session ids
    are no session. Empty tables give an empty result.
    """
    rows = clean_rows(messages)
    one, two = F.xxhash64("text"), F.xxhash64(F.lit("second"), "text")
    user, reply = F.col("role") == "user", F.col("role") == "assistant"
    known = F.coalesce(user | reply, F.lit(False))
    # A user row also counts, at the turn before, as the question that follows the reply.
    slots = F.array(F.struct(F.col("turn").alias("slot"), F.lit(False).alias("next")), F.struct((F.col("turn") - 1).alias("slot"), F.lit(True).alias("next")))
    spread = rows.select("session_id", "turn", "role", "micros", one.alias("one"), two.alias("two"), known.alias("known"), F.explode(F.when(user & F.col("turn").isNotNull() & (F.col("turn") > -2147483648), slots).otherwise(F.slice(slots, 1, 1))).alias("s"))
    own = ~F.col("s.next")
    by_turn = spread.groupBy("session_id", F.col("s.slot").alias("turn")).agg(
        F.count(F.when(own, 1)).alias("rows"),
        F.count(F.when(own & ~F.col("known"), 1)).alias("strange"),
        F.count(F.when(~own, 1)).alias("following"),
        *(f(F.when(own & w, F.col(h))).alias(f"{n}_{h}_{k}") for n, w in (("user", user), ("reply", reply)) for h in ("one", "two") for k, f in (("min", F.min), ("max", F.max))),
        F.min(F.when(own & user, F.col("micros"))).alias("u"),
        F.min(F.when(own & reply, F.col("micros"))).alias("a"),
        F.min(F.when(~own, F.col("micros"))).alias("v"),
    )
    def held(side: str) -> Column:
        """Whether a side of a turn has one text."""
        return F.coalesce((F.col(f"{side}_one_min") == F.col(f"{side}_one_max")) & (F.col(f"{side}_two_min") == F.col(f"{side}_two_max")), F.lit(False))

    def total(*conditions: Column) -> Column:
        return sum((F.sum(c.cast("bigint")) for c in conditions[1:]), F.sum(conditions[0].cast("bigint")))

    wait, gap = F.col("a") - F.col("u"), F.col("v") - F.col("a")
    real, asked, said = F.col("rows") > 0, held("user"), held("reply")
    by_session = by_turn.groupBy("session_id").agg(
        F.count(F.when(real, 1)).alias("turns"),
        F.sum(F.when(real & F.col("turn").isNull(), 1).otherwise(0)).alias("unnumbered"),
        F.min(F.when(real, F.col("turn"))).alias("first"),
        F.max(F.when(real, F.col("turn"))).alias("last"),
        F.sum("strange").alias("strange"),
        total(asked, said).alias("places"),
        # The constraints whose two ends are held: question before reply, reply before the next question.
        total(asked & said, said & (F.col("following") > 0)).alias("constraints"),
        F.min(wait).alias("least_wait"),
        F.min(gap).alias("least_gap"),
        ((F.avg(wait) - F.coalesce(F.avg(gap), F.avg(wait))) / 2).cast("bigint").alias("fit"),
    )
    ids = sessions.select(F.col("id").cast("bigint").alias("session_id")).filter("session_id is not null").distinct().withColumn("listed", F.lit(True))
    seen = messages.select(F.col("session_id").cast("bigint")).filter("session_id is not null").distinct()
    every = ids.join(seen, "session_id", "full").join(by_session, "session_id", "left")
    feasible = F.coalesce(-F.col("least_gap") <= F.col("least_wait"), F.lit(True))
    disordered = (F.coalesce("least_wait", F.lit(0)) < 0) | (F.coalesce("least_gap", F.lit(0)) < 0)
    bounded = F.least(F.greatest(F.col("fit"), -F.coalesce("least_gap", F.col("fit"))), F.coalesce("least_wait", F.col("fit")))
    reason = (
        F.when(F.col("listed").isNull(), "no session row")
        .when(F.coalesce("turns", F.lit(0)) == 0, "empty")
        .when(F.col("strange") > 0, "unknown role")
        .when(F.col("unnumbered") > 0, "turn missing")
        .when((F.col("first") == 1) & (F.col("places") == 2 * F.col("last")) & (F.col("constraints") == 2 * F.col("last") - 1), None)
        .when((F.col("first") != 1) | (F.col("last") != F.col("turns")), "gap in turns")
        .otherwise("reply missing or doubled")
    )
    return every.select(
        "session_id",
        F.coalesce("turns", F.lit(0)).alias("turns"),
        F.when(feasible & disordered, F.coalesce(bounded, F.lit(0))).otherwise(0).alias("offset_micros"),
        feasible.alias("clock_feasible"),
        reason.alias("reason"),
    )


def rebuild_conversations(sessions: DataFrame, messages: DataFrame, *, with_system: bool = False) -> DataFrame:
    """(session_id, position, turn, role, content, corrected_at) of the kept sessions.

    One row per utterance, positions 1, 2, 3 ... in conversation order: within
    a kept session turns are gapless, so the position follows from turn and
    role and nothing is sorted. Resent rows are one utterance, with the text of
    the smallest id and the earliest time; times are corrected for the clock
    offset and null where no copy has one.
    `with_system` adds the system rows (else they are left out), of those of
    one turn and text the first; they keep their turn, which may be 0 or null.
    One stands in its turn before the question, between, or behind the reply,
    as its time says, or its id where a time is missing; one without a turn
    stands in the last turn that was asked by then; turns below 1 open and
    turns beyond the last one close the conversation. Positions count them.
    """
    kept = assess_sessions(sessions, messages).filter("reason is null").select("session_id", "turns", "offset_micros")
    if with_system:
        kept = checkpointed(kept)
    said = clean_rows(messages).groupBy("session_id", "turn", "role").agg(F.min_by("text", "id").alias("content"), F.min("micros").alias("micros"), F.min("id").alias("id"))
    reply = F.col("role") == "assistant"
    # A kept session has turns 1 to `turns`; each run of TURN_BLOCK of them meets its own copy of the session's row.
    runs = kept.select("session_id", "offset_micros", F.explode(F.sequence(F.lit(0), F.floor(F.col("turns") / TURN_BLOCK).cast("int"))).alias("run"))
    said = said.withColumn("run", F.floor(F.col("turn") / TURN_BLOCK).cast("int")).join(runs, ["session_id", "run"]).drop("run")
    said = said.withColumn("micros", F.col("micros") - F.when(reply, F.col("offset_micros")).otherwise(0))
    columns = ("session_id", "position", "turn", "role", "content", F.timestamp_micros("micros").alias("corrected_at"))
    if not with_system:
        return said.withColumn("position", F.col("turn") * 2 - F.when(reply, 0).otherwise(1)).select(*columns)
    placed = _placed_system(stated_rows(messages).filter("role = 'system'").join(kept, "session_id", "left_semi"), said)
    every = said.select("session_id", "turn", "role", "content", "micros", "id", F.col("turn").alias("slot"), F.when(reply, 3).otherwise(1).alias("place")).unionByName(placed)
    bucket = bucket_if_hot(messages.filter("session_id is not null"), ["session_id"], F.floor(F.col("slot") / 100_000))
    counted = with_running_sum(every, ["session_id"], ["slot", "place", "micros", "id"], bucket, F.lit(1), "before")
    return counted.withColumn("position", (F.col("before") + 1).cast("int")).select(*columns)


def _placed_system(system: DataFrame, said: DataFrame) -> DataFrame:
    """System rows with `slot` and `place`, their turn and their place in it: 0 before the question (1), 2, or 4 behind the reply (3)."""
    once = system.groupBy("session_id", "turn", F.col("text").alias("content")).agg(F.min("micros").alias("micros"), F.min("id").alias("id"))
    spoken = said.select("session_id", "turn", "role", "micros", "id")
    found = _asked_turn(once.filter("turn is null"), spoken.filter("role = 'user'"))
    slotted = once.join(found, ["session_id", "id"], "left").withColumn("slot", F.coalesce("turn", "asked", F.lit(0)))
    sides = spoken.groupBy("session_id", F.col("turn").alias("slot")).agg(*(F.max(F.when(F.col("role") == r, F.struct("micros", "id"))).alias(n) for r, n in (("user", "u"), ("assistant", "a"))))

    def since(side: str) -> Column:
        timed = F.col("micros").isNotNull() & F.col(f"{side}.micros").isNotNull() & (F.col("micros") != F.col(f"{side}.micros"))
        return F.coalesce(F.when(timed, F.col("micros") > F.col(f"{side}.micros")).otherwise(F.col("id") > F.col(f"{side}.id")), F.lit(False))

    place = F.when(~since("u"), 0).when(since("a"), 4).otherwise(2)
    return slotted.join(sides, ["session_id", "slot"], "left").select("session_id", "turn", F.lit("system").alias("role"), "content", "micros", "id", "slot", place.alias("place"))


def _asked_turn(lost: DataFrame, asked: DataFrame) -> DataFrame:
    """(session_id, id, asked) of system rows without a turn: the last turn asked before, by time, or by id where they have no time.

    The running maximum is taken within a day (or 100,000 ids) of a session and
    carried across from one row for each of them.
    """
    spans = {"time": ("micros", 86_400_000_000), "arrival": ("id", 100_000)}
    asked = asked.join(lost.select("session_id").distinct(), "session_id", "left_semi")
    rows = None
    for clock, (at, width) in spans.items():
        of = lost.filter("micros is not null" if clock == "time" else "micros is null")
        both = of.select("session_id", "id", F.col(at).alias("at"), F.lit(None).cast("int").alias("asked")).unionByName(asked.select("session_id", "id", F.col(at).alias("at"), F.col("turn").alias("asked")).filter("at is not null"))
        both = both.select("*", F.lit(clock).alias("clock"), F.floor(F.col("at") / width).alias("span"))
        rows = both if rows is None else rows.unionByName(both)
    within = Window.partitionBy("session_id", "clock", "span").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy("session_id", "clock").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    earlier = rows.groupBy("session_id", "clock", "span").agg(F.max("asked").alias("most")).withColumn("most", F.max("most").over(across))
    local = rows.withColumn("here", F.max("asked").over(within)).filter("asked is null")
    return local.join(earlier, ["session_id", "clock", "span"]).select("session_id", "id", F.coalesce(F.greatest("here", "most"), F.lit(0)).alias("asked"))
