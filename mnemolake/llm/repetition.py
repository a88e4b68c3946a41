"""Repetition inside single documents, judged by weak supervision.

One scan measures several kinds of repetition per document. Each rule then
votes *repetitive*, votes *clean*, or abstains. Expectation-maximisation over
the counts of the vote patterns (at most 3**rules rows, whatever the corpus)
estimates every rule's accuracy without labels, and a document gets the
posterior probability of being repetitive instead of having to pass each rule.
The exact share of repeated words is no voter: it is the check of what the
posterior has chosen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..workers import map_batches
from .tokens import _quoted
from .words import grams, lines, mix, text_segments, words

PASSAGE_WORDS = 8
MEASURES = ("repeated_share", "short_gram_share", "line_share", "block_share", "top_gram_share", "long_gram_share", "same_word_share")
#: Share of the expected repetitive documents that the candidates may miss, by the estimate.
MISS = 1e-4

#: Rules: (measure, repetitive at or above, clean at or below, least words to vote).
RULES = (
    ("short_gram_share", 0.45, 0.25, 8),
    ("line_share", 0.30, 0.10, 8),
    ("block_share", 0.20, 0.02, 8),
    ("top_gram_share", 0.15, 0.05, 12),
    ("long_gram_share", 0.15, 0.01, 16),
    ("same_word_share", 0.70, 0.50, 20),
)


def repeats(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """True where the same key stands earlier in the same row (rows are ascending)."""
    if not len(keys):
        return np.zeros(0, bool)
    mixed = mix(keys ^ mix(doc.astype(np.uint64)))
    order = np.argsort(mixed, kind="stable")
    s = mixed[order]
    out = np.zeros(len(keys), bool)
    out[order[1:]] = s[1:] == s[:-1]
    return out


def passage_share(h: np.ndarray, doc: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Per row, the share of words inside a passage of k words that also starts earlier."""
    g = grams(h, k)
    covered = np.zeros(len(h) + 1, np.int64)
    if len(g):
        whole = np.flatnonzero(doc[: len(g)] == doc[k - 1 :])
        again = whole[repeats(g[whole], doc[whole])]
        np.add.at(covered, again, 1)
        np.add.at(covered, again + k, -1)
    inside = np.cumsum(covered[:-1]) > 0
    return np.bincount(doc[inside], minlength=len(counts)) / np.maximum(counts, 1)


def top_share(h: np.ndarray, doc: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Per row, the words held by its most frequent k-gram (if it occurs at least twice) over all words."""
    g = grams(h, k)
    out = np.zeros(len(counts))
    if len(g):
        whole = np.flatnonzero(doc[: len(g)] == doc[k - 1 :])
        if len(whole):
            mixed = np.sort(mix(g[whole] ^ mix(doc[whole].astype(np.uint64))))
            order = np.argsort(mix(g[whole] ^ mix(doc[whole].astype(np.uint64))), kind="stable")
            first = np.flatnonzero(np.r_[True, mixed[1:] != mixed[:-1]])
            times = np.diff(np.r_[first, len(mixed)])
            np.maximum.at(out, doc[whole][order[first]], np.where(times > 1, times, 0))
    return np.minimum(1.0, out * k / np.maximum(counts, 1))


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of each row of a segment."""
    rows = len(offsets) - 1
    h, doc, _, _ = words(data, offsets)
    counts = np.bincount(doc, minlength=rows)
    lh, ldoc, size = lines(data, offsets)
    total = np.maximum(np.bincount(ldoc, size, minlength=rows), 1)
    dup = repeats(lh, ldoc)
    b = grams(lh, 3)
    whole = np.flatnonzero(ldoc[: len(b)] == ldoc[2 : 2 + len(b)]) if len(b) else np.zeros(0, np.int64)
    again = np.zeros(len(lh) + 1, np.int64)
    if len(whole):
        at = whole[repeats(b[whole], ldoc[whole])]
        np.add.at(again, at, 1)
        np.add.at(again, at + 3, -1)
    in_block = np.cumsum(again[:-1]) > 0
    return {
        "words": counts,
        "repeated_share": passage_share(h, doc, counts, PASSAGE_WORDS),
        "short_gram_share": passage_share(h, doc, counts, PASSAGE_WORDS // 2),
        "line_share": np.bincount(ldoc[dup], size[dup], minlength=rows) / total,
        "block_share": np.bincount(ldoc[in_block], size[in_block], minlength=rows) / total,
        "top_gram_share": top_share(h, doc, counts, 3),
        "long_gram_share": passage_share(h, doc, counts, 2 * PASSAGE_WORDS),
        "same_word_share": np.bincount(doc[repeats(h, doc)], minlength=rows) / np.maximum(counts, 1),
    }


def measure_repetition(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, words, measures...) of every row in one scan without a shuffle.

    `repeated_share` is exact: the share of the words that lie in a passage of
    8 consecutive words that also starts at an earlier word of the same
    document. Null and empty texts have 0 words and shares of 0.
    """
    names = ["words", *MEASURES]
    schema = f"{_quoted(id_col)} {df.schema[id_col].dataType.simpleString()}, words bigint, " + ", ".join(f"{m} double" for m in MEASURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_segments(batch.column(1)):
                m = measure(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *(pa.array(m[n]) for n in names)], [id_col, *names])

    return map_batches(df.select(F.col(_quoted(id_col)), F.col(_quoted(text_col)).cast("string")), run, schema)


def with_votes(measured: DataFrame) -> DataFrame:
    """Adds `votes`: one character per rule, R (repetitive), C (clean) or - (abstains)."""
    votes = [F.when((F.col("words") >= least) & (F.col(m) >= high), "R").when((F.col("words") >= least) & (F.col(m) <= low), "C").otherwise("-") for m, high, low, least in RULES]
    return measured.withColumn("votes", F.concat(*votes))


def estimate(patterns: dict[str, int], rounds: int = 200, tolerance: float = 1e-9) -> tuple[float, np.ndarray, dict[str, float]]:
    """EM over vote patterns: prior, accuracies (rules x class x vote), posterior by pattern.

    Votes are taken as independent given the class, each rule with its own
    rates of R, C and abstention in either class. Class 1 is anchored by the
    start: it is where most non-abstaining votes are R. Counts are smoothed by
    one vote, so empty input gives the start values.
    """
    if not patterns:
        return 0.5, np.full((0, 2, 3), 1 / 3), {}
    keys = sorted(patterns)
    n = np.array([patterns[k] for k in keys], float)
    v = np.array([["RC-".index(c) for c in k] for k in keys])
    share_r = (v == 0).sum(1) / np.maximum((v < 2).sum(1), 1)
    post = np.where((v < 2).any(1), 0.1 + 0.8 * share_r, 0.1)
    rules = v.shape[1]
    for _ in range(rounds):
        prior = (n @ post + 1) / (n.sum() + 2)
        rate = np.zeros((rules, 2, 3))
        for c, p in enumerate((1 - post, post)):
            for vote in range(3):
                rate[:, c, vote] = (n * p) @ (v == vote) + 1
            rate[:, c] /= rate[:, c].sum(1, keepdims=True)
        log = np.log([1 - prior, prior])[None, :] + sum(np.log(rate[j][:, v[:, j]]).T for j in range(rules))
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -700, 700)))
        if np.abs(new - post).max() < tolerance:
            post = new
            break
        post = new
    return float(prior), rate, dict(zip(keys, post.tolist()))


def chosen(patterns: dict[str, int], posterior: dict[str, float], miss: float = MISS) -> set[str]:
    """The vote patterns of candidates: those of a posterior of a half or more, and of the rest the likeliest until
    the expected repetitive documents among those left out are at most `miss` of all."""
    expected = {p: n * posterior[p] for p, n in patterns.items()}
    allowed, out = miss * sum(expected.values()), set()
    for p in sorted(patterns, key=lambda p: (posterior[p], p)):
        if posterior[p] < 0.5 and expected[p] <= allowed:
            allowed -= expected[p]
            out.add(p)
        else:
            allowed = -1.0  # all patterns from here on are candidates
    return set(patterns) - out


def judge_repetition(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, miss: float = MISS) -> DataFrame:
    """(id, words, measures..., votes, posterior, candidate) of every row.

    `posterior` is the estimated probability that the document is repetitive,
    `candidate` whether it is to be checked (see `chosen`). The measures (a few
    numbers a document) are written once to the checkpoint folder, so the texts
    are scanned once. One output row per input row.
    """
    measured = checkpointed(with_votes(measure_repetition(df, id_col, text_col)))
    counts = {r["votes"]: r["count"] for r in measured.groupBy("votes").count().collect()}  # at most 3**len(RULES) rows
    _, _, posterior = estimate(counts)
    picked = chosen(counts, posterior, miss)
    table = df.sparkSession.createDataFrame([(p, x, p in picked) for p, x in sorted(posterior.items())], "votes string, posterior double, candidate boolean")
    return measured.join(F.broadcast(table), "votes").select(F.col(_quoted(id_col)), "words", *MEASURES, "votes", "posterior", "candidate")


def repetitive(judged: DataFrame, share: float = 0.3) -> DataFrame:
    """The candidates whose exact share of repeated words reaches `share`."""
    return judged.filter("candidate").filter(F.col("repeated_share") >= share)
