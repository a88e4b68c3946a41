"""Linking the spellings of people and organisations.

Each spelling is parsed into a *key*: a person's formal given name and last
name, a vague one with only an initial, or an organisation's distinctive words
and its sectors. All pairwise work is on the distinct *words* of these keys
(last names, unknown given names, roots of organisations): a word's padded
q-grams are MinHashed, words that agree in one band are compared, as are all
that share an edit signature, which every pair of similar words does. Keys are
then linked by equality joins through the similar words and weighed by the
Monge-Elkan mean of their parts; the links are clustered by star clustering:
the key with most links becomes a centre and takes its neighbours.

However many spellings share a last name and an initial, none of them is
compared with another: keys of one formal given and last name are the same key,
keys of one last name and different given names never meet, and what an initial
or an abbreviation could mean is read from one aggregate per form.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..operators.components import connected_components
from ..workers import map_batches
from .lexicon import GIVEN_NAMES, LEGAL_FORMS, NICKNAMES, TITLES

Q = 2
ROWS_PER_BAND = 4
#: Similarity of q-gram sets from which a pair should become a candidate by the bands alone, and with what probability;
#: typing errors in short words go below it, and are found by the edit signatures.
TARGET_SIMILARITY, TARGET_RECALL = 0.5, 0.9
THRESHOLD, WORD_THRESHOLD = 0.90, 0.80
#: Words of a bucket that one task compares; a larger bucket is cut into blocks, of which all pairs are compared.
BLOCK_WORDS = 256
#: Longest word whose signatures are its deletions; longer ones have segments.
DELETION_LENGTH = 24
#: Longest initial part of a given name that is looked up as its short form.
LONGEST_PREFIX = 6

#: Aliases that say nothing (fixed values).
USELESS = frozenset(("", "?", "-", "--", "n/a", "na", "none", "null", "unknown", "tbd", "other", "user", "me", "anonymous"))

#: Words for what organisations do, and irregular ways to write them (fixed values); regular short forms are derived.
SECTORS = {
    "bakery": ("bkry",), "bank": (), "brothers": ("bros", "bro"), "consulting": ("cnslt",), "department": ("dpt",),
    "engineering": ("engrg", "engr"), "food": ("foods",), "group": (), "institute": (), "insurance": (), "international": ("intl",),
    "laboratories": ("labs", "laboratory"), "logistics": ("logistic",), "manufacturing": ("mfg",), "marine": (),
    "pharmaceuticals": ("pharmaceutical",), "savings": ("svgs", "saving"), "services": ("svcs", "svc", "service"), "supply": ("sply", "supplies"),
    "systems": ("system",), "technologies": ("technology", "techn"), "transport": ("transp", "trnsp"), "university": (), "holdings": ("hldgs", "holding"),
}
_SECTOR_OF = {form: word for word, forms in SECTORS.items() for form in (word, *forms)}
_PEOPLE = GIVEN_NAMES | NICKNAMES.keys()
_SINGLE = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ß": "ss", "ı": "i", "’": "'"})
_LINKING = ("of", "the", "and")


# --- similarity of two words ------------------------------------------------


_LOOK = str.maketrans("013457l|", "oieastii")


def look(word: str) -> str:
    """A word with characters that look alike made equal, one for one."""
    return word.translate(_LOOK)


def skeleton(word: str) -> str:
    """The same, and "rn" read as "m"."""
    return look(word).replace("rn", "m")


def allowed_edits(length: int) -> int:
    """Edits that a pair of words may differ by, from the shorter one's length."""
    return 2 if length >= 7 else 1 if length >= 4 else 0


def edits(a: str, b: str, most: int) -> int:
    """Edits with transposition between two words, or more than `most`."""
    start, end_a, end_b = 0, len(a), len(b)
    if abs(end_a - end_b) > most:
        return most + 1
    while start < end_a and start < end_b and a[start] == b[start]:
        start += 1
    while end_a > start and end_b > start and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
    a, b = a[start:end_a], b[start:end_b]
    if not a or not b or most == 0:
        return len(a) + len(b)
    before2, before = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before2[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before2, before = before, row
    return before[-1]


@lru_cache(1 << 18)
def word_similarity(a: str, b: str) -> float:
    """1 for equal words; high for few typing errors in proportion to length; else 0."""
    x, y = skeleton(a), skeleton(b)
    if x == y:
        return 1.0
    allowed = allowed_edits(min(len(a), len(b)))
    n = min(edits(x, y, allowed), edits(look(a), look(b), allowed)) if allowed else 9
    return max(0.9 if n == 1 else 0.86, 1 - n / max(len(a), len(b))) if n <= allowed else 0.0


def abbreviates(short: str, long: str) -> bool:
    """Whether a word is written in short: its beginning, and behind it some of its later consonants in order."""
    if not 2 <= len(short) < len(long) or short[0] != long[0]:
        return False
    same = 1
    while same < len(short) and short[same] == long[same]:
        same += 1
    if same == len(short):
        return same >= 3
    rest = iter(long[same:])
    return not re.search("[aeiou]", short[same:]) and all(c in rest for c in short[same:])


# --- parsing ----------------------------------------------------------------


def fold(name: str) -> str:
    """Lower case, without accents, of one spacing."""
    if name.isascii():
        return " ".join(name.lower().split())
    name = unicodedata.normalize("NFKD", name.casefold().translate(_SINGLE))
    return " ".join("".join(c for c in name if not unicodedata.combining(c)).split())


_FOLDED_TITLES = frozenset(fold(t) for t in TITLES)
_SQUEEZE = re.compile(r"(.)\1+")


def _deletions(word: str, n: int) -> set[str]:
    """A word, and what is left of it after up to n deletions."""
    out = level = {word}
    for _ in range(n):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out = out | level
    return out


@lru_cache(1)
def _known_names() -> tuple[dict[str, str], dict[str, list[str]]]:
    """Known given names by their skeletons and squeezed forms, and by what deletions leave of them."""
    alike: dict[str, str] = {}
    near: dict[str, list[str]] = {}
    for known in sorted(_PEOPLE):
        for form in (known, _SQUEEZE.sub(r"\1", known), skeleton(known)):
            alike.setdefault(form, known)
        if len(known) >= 4:
            for form in {s for w in (known, skeleton(known)) for s in _deletions(w, 2 if len(known) >= 7 else 1)}:
                near.setdefault(form, []).append(known)
    return alike, near


@lru_cache(1 << 16)
def formal(given: str) -> str:
    """The given name that a nickname, or a mistyped name or nickname, stands for; else the word itself."""
    if given in GIVEN_NAMES:
        return given
    if given in NICKNAMES:
        return NICKNAMES[given]
    alike, near = _known_names()
    seen = skeleton(given)
    known = alike.get(_SQUEEZE.sub(r"\1", given)) or alike.get(seen)
    if known:
        return NICKNAMES.get(known, known)
    if len(given) < 3:
        return given
    best, found = 0.0, given
    forms = {s for w in (given, seen) for s in _deletions(w, 2 if len(given) >= 7 else 1)} if len(given) <= DELETION_LENGTH else ()
    for known in sorted({k for s in forms for k in near.get(s, ())}):
        allowed = 2 if min(len(known), len(given)) >= 7 else 1
        n = min(edits(seen, skeleton(known), allowed), edits(given, known, allowed))
        score = 1 - n / max(len(known), len(given))
        if n <= allowed and score > best:
            best, found = score, NICKNAMES.get(known, known)
    return found


@lru_cache(1 << 16)
def _sector(token: str) -> tuple[str, ...]:
    """The sector words that a token stands for, also in short or mistyped; none if it is no such word."""
    if token in _SECTOR_OF:
        return (_SECTOR_OF[token],)
    meant = [w for w in SECTORS if w.startswith(token)] if len(token) >= 3 else []
    meant = meant or [w for w in SECTORS if abbreviates(token, w)]
    if meant:
        return (meant[0],) if len(meant) == 1 else ()
    for word in SECTORS:
        if len(token) >= 4 and word_similarity(token, word) >= WORD_THRESHOLD:
            return (word,)
        if token.startswith(word) and (rest := _sector(token[len(word) :])):
            return (word, *rest)
    return ()


@lru_cache(1 << 16)
def _legal(token: str) -> bool:
    return token in LEGAL_FORMS or len(token) >= 7 and any(len(w) >= 7 and word_similarity(token, w) >= WORD_THRESHOLD for w in LEGAL_FORMS)


def organisation_tokens(name: str) -> list[str]:
    """The words of an organisation's folded name, without legal forms."""
    dotted = re.sub(r"\b((?:[a-z]\.){2,})", lambda m: m[1].replace(".", ""), name + " ")
    return [t for t in re.sub(r"[^\w ]", " ", dotted.replace("'", "")).replace("_", " ").split() if not _legal(t)]


@lru_cache(1 << 18)
def parse(name: str, org: bool) -> tuple:
    """("P", given, last, initials), ("O", root words, sectors) or ("C", code) of a folded spelling."""
    if re.search(r"[a-z]\d{3,}$", name):
        return "C", name
    if org:
        tokens = [t for t in organisation_tokens(name) if t not in _LINKING]
        root, sectors = [], []
        for t in tokens:
            if s := _sector(t):
                sectors.extend(s)
            else:
                root.append(t)
        return ("O", tuple(root), tuple(sorted(set(sectors)))) if root else ("O", tuple(sectors) or tuple(tokens), ())
    last_first = "," in name
    parts = [re.sub(r"[^\w .]", " ", p).replace("_", " ") for p in name.split(",", 1)]
    if last_first:
        parts.reverse()
    tokens, short = [], set()
    for i, raw in enumerate(" ".join(parts).replace(".", ". ").split()):
        t = raw.rstrip(".")
        if t and (t not in _FOLDED_TITLES or i and not raw.endswith(".")):
            if raw.endswith(".") and len(t) <= 4:
                short.add(t)
            tokens.append(t)
    if len(tokens) == 1:
        t = tokens[0]
        for n in range(len(t) - 4, 3, -1):
            if t[:n] in _PEOPLE or skeleton(t[:n]) in _known_names()[0]:
                return "P", t[:n], t[n:], ""
        return ("P", "", t, "") if t else ("C", name)
    if not tokens:
        return "C", name
    if not last_first and len(tokens) == 2:
        a, b = tokens
        if len(b) <= 2 < len(a):  # last name, then initials
            return "P", b[0], a, b
        if b in _PEOPLE and a not in _PEOPLE and len(a) > 1 and a not in short:
            return "P", b, a, ""
    given, last = tokens[0], tokens[-1]
    if len(last) <= 2 and len(tokens) > 2:
        last = tokens[-2]
    return "P", given + ("." if given in short and len(given) > 1 else ""), last, "".join(t[0] for t in tokens[1:-1])


def is_organisation(name: str, kind: str | None) -> bool:
    if kind in ("org", "person"):
        return kind == "org"
    tokens = re.sub(r"[^\w ]", " ", name).split()
    return len(tokens) > 1 and tokens[0] not in _PEOPLE and any(t in LEGAL_FORMS or len(t) >= 4 and _sector(t) for t in tokens)


def names_someone(name: str) -> bool:
    """Whether a spelling alone says that it is a person's or an organisation's: a known given name, a title or a legal form."""
    tokens = re.sub(r"[^\w ]", " ", name).split()
    return len(tokens) > 1 and (tokens[0] in _PEOPLE or tokens[0] in _FOLDED_TITLES or tokens[-1] in LEGAL_FORMS or "," in name and tokens[-1] in _PEOPLE)


def is_vague(p: tuple) -> bool:
    """Whether a person's given name is only an initial or a shortened form."""
    return p[0] == "P" and (len(p[1].rstrip(".")) <= 2 or p[1].endswith("."))


def key_of(p: tuple) -> tuple[str, str, str]:
    """(kind, part, word) of a parsed spelling; spellings of one key mean the same.

    P: formal given name, last name; V: initial or short form, last name;
    L: nothing, last name; O: sectors, root; C: nothing, code.
    """
    if p[0] == "C":
        return "C", "", p[1]
    if p[0] == "O":
        return "O", " ".join(p[2]), "".join(look(t) for t in p[1])
    last = look(p[2])
    if not p[1]:
        return "L", "", last
    if is_vague(p):
        given = p[1].rstrip(".")
        return "V", look(given) if len(given) > 2 else given[:1], last
    return "P", look(formal(p[1])), last


# --- MinHash bands ----------------------------------------------------------


def bands_needed(similarity_: float = TARGET_SIMILARITY, recall: float = TARGET_RECALL, rows: int = ROWS_PER_BAND) -> int:
    """The least number of bands for which 1 - (1 - s^rows)^bands reaches the recall at similarity s."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity_**rows))


@lru_cache(1 << 14)
def _gram_hashes(gram: str, count: int) -> tuple[int, ...]:
    """`count` hashes of a q-gram; the few distinct ones are hashed once a worker."""
    x, mask = xxhash.xxh64_intdigest(gram), (1 << 64) - 1
    return tuple((x ^ (seed := (i + 1) * 0x9E3779B97F4A7C15 & mask)) * (seed | 1) & mask for i in range(count))


def minhash_bands(word: str, bands: int, rows: int = ROWS_PER_BAND) -> list[int]:
    """One signed 64-bit hash per band of the word's padded q-grams."""
    padded = "^" * (Q - 1) + word + "$" * (Q - 1)
    minima = list(map(min, *(_gram_hashes(g, bands * rows) for g in {padded[i : i + Q] for i in range(len(padded) - Q + 1)}), (1 << 64,) * (bands * rows)))
    return [_signed(hash((b, *minima[b * rows : (b + 1) * rows]))) for b in range(bands)]  # hashes of integers are the same in every process


def _signed(h: int) -> int:
    h &= (1 << 64) - 1
    return h - (1 << 64) if h >= 1 << 63 else h


# --- edit signatures --------------------------------------------------------


def edit_signatures(word: str) -> set[str]:
    """Strings of which any two words with `word_similarity` above 0 have one in common.

    Words within n edits or transpositions become equal by at most n deletions
    in each. Of a long word, 5 segments are taken instead, of which 2 edits
    leave one whole, and what may equal them in a word of nearly the same length.
    """
    out, n = set(), allowed_edits(len(word))
    for form in {skeleton(word), look(word)}:  # look-alikes never add edits, except by "rn"
        if len(form) <= DELETION_LENGTH:
            out |= _deletions(form, n)
        if len(form) > DELETION_LENGTH - 2:
            for length in range(len(form) - 2, len(form) + 3):
                cuts = [length * i // 5 for i in range(6)]
                for i, (start, end) in enumerate(zip(cuts, cuts[1:])):
                    out |= {f"{length}/{i}/{form[at : at + end - start]}" for at in range(max(0, start - 2), start + 3) if at + end - start <= len(form)}
    return out


# --- the operator -----------------------------------------------------------

SPELLING = "id bigint, kind string, part string, word string, raw string"


def spellings(nodes: DataFrame) -> DataFrame:
    """(id, kind, part, word, raw) of each useful spelling of the rows that may be a person or an organisation.

    Rows of type person, org, entity, or none take part with all spellings; rows
    of other types if one of their spellings says by itself that it names someone.
    `raw` is a person's given name or an organisation's words as written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for id_, kind, name, aliases in zip(*(batch.column(i).to_pylist() for i in range(4))):
                kind = kind.strip().lower() if kind else ""
                norms = {fold(raw) for raw in [name, *(aliases or [])] if raw} - USELESS
                if kind not in ("person", "org", "entity", "") and not any(map(names_someone, norms)):
                    continue
                found = set()
                for norm in norms:
                    p = parse(norm, is_organisation(norm, kind))
                    raw = p[1].rstrip(".") if p[0] == "P" else " ".join(organisation_tokens(norm)) if p[0] == "O" else ""
                    found.add((*key_of(p), raw))
                out += [(id_, *f) for f in sorted(found)]
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:])], ["id", "kind", "part", "word", "raw"])

    rows = nodes.filter(F.col("id").isNotNull())
    return map_batches(rows.select(F.col("id").cast("bigint"), F.col("type").cast("string"), F.col("canonical_name").cast("string"), F.col("aliases").cast("array<string>")), run, SPELLING)


def word_buckets(words: DataFrame, bands: int) -> DataFrame:
    """(tag, word, bucket) of distinct words: their bands and their edit signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, buckets = [], []
            for i, word in enumerate(batch.column(1).to_pylist()):
                own = {_signed(xxhash.xxh64_intdigest(s)) for s in edit_signatures(word)}.union(minhash_bands(word, bands))
                at += [i] * len(own)
                buckets += own
            pick = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), pa.array(buckets, pa.int64())], ["tag", "word", "bucket"])

    return map_batches(words.select("tag", "word"), run, "tag string, word string, bucket bigint")


def similar_words(words: DataFrame, bands: int | None = None, *, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(tag, a, b, similarity) of all similar words of one tag, in both directions, each word with itself.

    `words` has distinct (tag, word). A bucket's pairs are made in blocks of
    it, so that no task has all pairs of a crowded one, and those whose plain
    edit distance is too large leave before they are shuffled.
    """
    buckets = word_buckets(words, bands or bands_needed())
    blocks = F.ceil(F.col("n") / block_words).cast("int")
    crowded = buckets.groupBy("tag", "bucket").agg(F.count("*").alias("n")).filter("n > 1")
    # Row i of the blocks' square has the pairs of a word in block i with one in any block.
    held = buckets.join(crowded, ["tag", "bucket"]).select("tag", "word", "bucket", blocks.alias("blocks"), F.pmod(F.xxhash64("word"), blocks).cast("int").alias("block"))
    a = held.select("tag", F.col("word").alias("a"), "bucket", "block")
    b = held.select("tag", F.col("word").alias("b"), "bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    shorter = F.least(F.char_length("a"), F.char_length("b"))
    most = F.when(shorter >= 7, 4).when(shorter >= 4, 2).otherwise(0)  # a transposition counts as two plain edits
    read = [F.replace(c, F.lit("rn"), F.lit("m")) for c in ("a", "b")]
    plain = F.levenshtein("a", "b", 4).between(0, most) | F.levenshtein(*read, 4).between(0, most)
    pairs = a.join(b, ["tag", "bucket", "block"]).filter("a < b").filter(plain).select("tag", "a", "b").distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [word_similarity(x, y) for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(s, pa.float64())], ["tag", "a", "b", "similarity"])

    near = map_batches(pairs, verify, "tag string, a string, b string, similarity double").filter(F.col("similarity") >= WORD_THRESHOLD)
    near = checkpointed(near)
    return near.unionByName(near.select("tag", F.col("b").alias("a"), F.col("a").alias("b"), "similarity")).unionByName(words.select("tag", F.col("word").alias("a"), F.col("word").alias("b"), F.lit(1.0).alias("similarity")))


def _known(part: Column) -> Column:
    return part.isin(sorted({look(g) for g in GIVEN_NAMES} | {look(g) for g in NICKNAMES.values()}))


def key_links(keys: DataFrame, near: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, similarity), a < b, of keys (name, kind, part, word) that mean the same by their parts.

    People: similar last names, and the same formal given name or similar
    unknown ones. Vague ones: similar last names, and one initial part begins
    with the other. Organisations: similar roots, and the same sectors or some
    of them. The similarity is the mean over the parts.
    """
    tag = F.when(F.col("kind") == "O", "root").otherwise("last")
    by_word = near.select(F.col("tag").alias("_tag"), F.col("a").alias("word"), F.col("b").alias("other"), F.col("similarity").alias("s"))
    wide = keys.filter("kind in ('P', 'V', 'O')").withColumn("_tag", tag).join(by_word, ["_tag", "word"])
    right = keys.select(F.col("name").alias("b"), F.col("kind").alias("kind"), F.col("part").alias("other_part"), F.col("word").alias("other"))
    # People: the given name is part of the join, so namesakes of one last name never meet.
    people = wide.filter("kind = 'P'").select("name", "kind", "part", "other", "s")
    alike = near.filter("tag = 'given' and a != b").select(F.col("a").alias("part"), F.col("b").alias("other_part"), F.col("similarity").alias("t"))
    same = people.select("name", "kind", F.col("part").alias("other_part"), "other", ((F.col("s") + 1) / 2).alias("similarity"))
    typed = people.join(alike, "part").select("name", "kind", "other_part", "other", ((F.col("s") + F.col("t")) / 2).alias("similarity"))
    linked = same.unionByName(typed).join(right, ["kind", "other_part", "other"]).select(F.col("name").alias("a"), "b", "similarity")
    # Initials: of one letter, one begins with the other.
    vague = wide.filter("kind = 'V'").select("name", "kind", "part", "other", "s", F.left("part", F.lit(1)).alias("letter"))
    vague = vague.join(right.withColumn("letter", F.left("other_part", F.lit(1))), ["kind", "letter", "other"]).filter(F.startswith("part", F.col("other_part")) | F.startswith("other_part", F.col("part")))
    vague = vague.select(F.col("name").alias("a"), "b", ((F.col("s") + F.when(F.col("part") == F.col("other_part"), 1.0).otherwise(0.9)) / 2).alias("similarity"))
    # Organisations: keys of one root differ in their sectors only, of which there are few.
    mine, theirs = F.split("part", " "), F.split("other_part", " ")
    n = F.when(F.col("part") == "", 0).otherwise(F.size(mine))
    fit = (F.col("part") == F.col("other_part")) | ((F.col("part") != "") & (F.col("other_part") != "") & ((F.size(F.array_except(mine, theirs)) == 0) | (F.size(F.array_except(theirs, mine)) == 0)))
    firms = wide.filter("kind = 'O'").select("name", "kind", "part", "other", "s").join(right, ["kind", "other"]).filter(fit)
    firms = firms.select(F.col("name").alias("a"), "b", ((F.col("s") + n) / (n + 1)).alias("similarity"))
    both = linked.unionByName(vague).unionByName(firms).filter(F.col("a") != F.col("b")).filter(F.col("similarity") >= threshold)
    return both.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("similarity").alias("similarity"))


def short_forms(written: DataFrame, near: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, form) that keys ask for, and (name, form) that keys offer: what a short spelling could mean.

    `written` has distinct (name, kind, part, word, raw). People: the beginnings
    of their given names (an initial for any, else as long as the short form)
    before the last name; organisations: their words with any run of them
    replaced by its acronym. A short form may mean every key that offers it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, asks, forms = [], [], []
            for i, (kind, part, word, raw) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(1, 5)))):
                own: set[tuple[bool, str]] = set()
                if kind == "P":
                    for given in {raw, part}:
                        own |= {(False, f"{given[:n]} ") for n in range(1, min(len(given), LONGEST_PREFIX + 1))}
                    if 3 <= len(raw) <= LONGEST_PREFIX and raw not in _PEOPLE:
                        own.add((True, f"{raw} "))
                elif kind == "V":
                    own.add((True, f"{part} "))
                elif kind == "O":
                    tokens = raw.split()
                    plain = [t for t in tokens if t not in _LINKING]
                    if any(2 <= len(t) <= 6 for t in plain):
                        own.add((True, " ".join(plain)))
                    own |= {(False, f) for f in acronym_forms(tokens)}
                for ask, form in own:
                    at.append(i)
                    asks.append(ask)
                    forms.append(form)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at, pa.int64())) for c in (0, 1, 3)), pa.array(asks, pa.bool_()), pa.array(forms, pa.string())], ["name", "kind", "word", "asks", "form"])

    every = map_batches(written.select("name", "kind", "part", "word", "raw"), run, "name bigint, kind string, word string, asks boolean, form string")
    by_word = near.filter("tag = 'last'").select(F.col("a").alias("word"), F.col("b").alias("other"))
    person = F.col("kind") != "O"
    asked = every.filter("asks")
    asked = asked.filter(person).join(by_word, "word").select("name", F.concat("form", "other").alias("form")).unionByName(asked.filter(~person).select("name", "form"))
    offered = every.filter("not asks").select("name", F.when(person, F.concat("form", "word")).otherwise(F.col("form")).alias("form"))
    return asked, offered


def acronym_forms(tokens: list[str]) -> set[str]:
    """The words (without linking ones) with each run of two or more of them replaced by its initials, with or without linking words."""
    out = set()
    for start in range(len(tokens)):
        for end in range(start + 2, min(len(tokens), start + 6) + 1):
            run = tokens[start:end]
            if run[0] in _LINKING or run[-1] in _LINKING:
                continue
            for letters in {"".join(t[0] for t in run), "".join(t[0] for t in run if t not in _LINKING)}:
                if len(letters) >= 2:
                    out.add(" ".join([*(t for t in tokens[:start] if t not in _LINKING), letters, *(t for t in tokens[end:] if t not in _LINKING)]))
    return out


def abbreviated(written: DataFrame, *, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(name, full): keys of organisations, and keys of which they may be short forms word by word.

    Both have the same first word and the same initials of all words; every
    word of the one equals, resembles or abbreviates the one at its place.
    """
    words = F.filter(F.split("raw", " "), lambda t: ~t.isin(*_LINKING))
    rows = written.filter("kind = 'O'").select("name", words.alias("words")).filter(F.size("words") > 1)
    rows = rows.select("name", "words", F.concat(F.col("words")[0], F.lit(" "), F.array_join(F.transform("words", lambda t: F.left(t, F.lit(1))), "")).alias("form"), F.char_length(F.array_join("words", "")).alias("length")).distinct()
    sizes = rows.groupBy("form").agg(F.count("*").alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / block_words).cast("int")
    held = rows.join(sizes, "form").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("words"), blocks).cast("int"))
    a = held.select("name", "form", "block", "words", "length")
    b = held.select(F.col("name").alias("full"), "form", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("words").alias("others"), F.col("length").alias("longer"))
    pairs = a.join(b, ["form", "block"]).filter("length < longer and name != full").select("name", "full", "words", "others")

    def fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [any(abbreviates(x, y) for x, y in zip(s, t)) and all(x == y or abbreviates(x, y) or word_similarity(x, y) >= WORD_THRESHOLD for x, y in zip(s, t)) for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select(["name", "full"]).filter(pa.array(keep, pa.bool_()))

    return map_batches(pairs, fits, "name bigint, full bigint").distinct()


def star_clusters(edges: DataFrame) -> DataFrame:
    """(id, centre) of every vertex of (a, b, similarity): greedy stars by degree.

    In each round a vertex with more links (ties: by a hash, then the smaller id) than all its
    still free neighbours becomes a centre, which is what taking vertices one
    by one in that order gives; free neighbours join the most similar of
    their new centres (ties: more links, then as above). Every round settles the
    highest free vertex of each component, so it ends; the hash keeps rounds few.
    """
    both = edges.select("a", "b", "similarity").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    degree = both.groupBy("a").agg(F.count("*").alias("n"))
    ranked = both.join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("n").alias("m")), "b")
    free = checkpointed(ranked.select("a", "b", "similarity", F.struct(F.col("n"), F.xxhash64("a").alias("h"), -F.col("a")).alias("ra"), F.struct(F.col("m"), F.xxhash64("b").alias("h"), -F.col("b")).alias("rb")))
    done = None
    while True:
        centres = free.groupBy("a").agg(F.max("rb").alias("top"), F.first("ra").alias("ra")).filter("ra > top").select(F.col("a").alias("c"))
        taken = free.join(centres, free["b"] == centres["c"], "left_semi").groupBy("a").agg(F.max_by("b", F.struct("similarity", "rb")).alias("centre"))
        # A vertex that is itself a new centre has no centre among its neighbours.
        step = checkpointed(centres.select(F.col("c").alias("id"), F.col("c").alias("centre")).unionByName(taken.select(F.col("a").alias("id"), "centre")))
        done = step if done is None else done.unionByName(step)
        gone = step.select("id")
        free = checkpointed(free.join(gone, free["a"] == gone["id"], "left_anti").join(gone, free["b"] == gone["id"], "left_anti"))
        if free.isEmpty():
            break
    # A vertex whose neighbours have all joined other stars is a star of its own.
    return degree.select(F.col("a").alias("id")).join(done, "id", "left").select("id", F.coalesce("centre", "id").alias("centre"))


def link_names(nodes: DataFrame, *, threshold: float = THRESHOLD, bands: int | None = None) -> DataFrame:
    """(id, entity) of every row that is a person or an organisation, or may be (see `spellings`).

    `nodes` needs id, type, canonical_name and aliases. Rows of one entity have
    the same `entity`, a representative row's id (the smallest). Rows without a
    useful spelling and rows with a null id are left out; repeated rows are
    their entity's; an empty table gives an empty result.
    A spelling in short (an initial, a shortened given name, an acronym or
    abbreviations) joins the full names only if all that it could mean are one entity.
    """
    every = checkpointed(spellings(nodes).withColumn("name", F.xxhash64("kind", "part", "word")).distinct())
    cores = nodes.sparkSession.sparkContext.defaultParallelism
    keys = every.select("name", "kind", "part", "word").distinct()
    dictionary = keys.filter("kind in ('P', 'V')").select(F.lit("last").alias("tag"), "word").unionByName(keys.filter("kind = 'O'").select(F.lit("root").alias("tag"), "word"))
    dictionary = dictionary.unionByName(keys.filter((F.col("kind") == "P") & ~_known(F.col("part"))).select(F.lit("given").alias("tag"), F.col("part").alias("word"))).filter("word != ''")
    # A set number of partitions, so that hashing in Python is spread although the words are small.
    words = checkpointed(dictionary.distinct().repartition(cores, "tag", "word"))
    near = similar_words(words, bands)
    links = key_links(keys, near, threshold)
    # Spellings of one row belong together.
    first = every.groupBy("id").agg(F.min("name").alias("first"))
    tied = every.join(first, "id").filter("name != first").select(F.col("name").alias("source"), F.col("first").alias("target"))
    groups = connected_components(tied)
    group = checkpointed(keys.select("name").join(groups.withColumnRenamed("id", "name"), "name", "left").select("name", F.coalesce("component", "name").alias("grp")))
    ga, gb = group.select(F.col("name").alias("a"), F.col("grp").alias("ga")), group.select(F.col("name").alias("b"), F.col("grp").alias("gb"))
    firm = links.join(ga, "a").join(gb, "b").filter("ga != gb").groupBy(F.least("ga", "gb").alias("a"), F.greatest("ga", "gb").alias("b")).agg(F.max("similarity").alias("similarity"))
    stars = star_clusters(checkpointed(firm))
    settled = checkpointed(group.join(stars.withColumnRenamed("id", "grp"), "grp", "left").select("name", F.coalesce("centre", "grp").alias("centre")))
    # Short spellings, with the range of the entities that they could mean: one aggregate per form, then per entity.
    written = every.select("name", "kind", "part", "word", "raw").distinct()
    asked, offered = short_forms(written, near)
    ranges = offered.join(settled, "name").groupBy("form").agg(F.min("centre").alias("lo"), F.max("centre").alias("hi"))
    by_word = abbreviated(written).join(settled.withColumnRenamed("name", "full"), "full").select("name", F.col("centre").alias("lo"), F.col("centre").alias("hi"))
    meant = asked.join(ranges, "form").select("name", "lo", "hi").unionByName(by_word).join(settled.withColumnRenamed("centre", "own"), "name")
    only = meant.groupBy("own").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo = hi and lo != own")
    merged = connected_components(only.select(F.col("own").alias("source"), F.col("lo").alias("target")))
    final = settled.join(merged.withColumnRenamed("id", "centre"), "centre", "left").select("name", F.coalesce("component", "centre").alias("cluster"))
    rows = checkpointed(every.select("id", "name").distinct().join(final, "name").select("id", "cluster").distinct())
    return rows.join(rows.groupBy("cluster").agg(F.min("id").alias("entity")), "cluster").groupBy("id").agg(F.min("entity").alias("entity"))
