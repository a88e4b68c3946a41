"""Text expressions: terms, tokens, keys, condensing. All run in the JVM but for stemming."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no content in a query.
STOPWORDS = (
    "a an and are as at be but by did do does for from had has have he her him his how i if in is it its me my of on or "
    "our she so that the their them they this to unclear us was we were what when where which who will with you your "
    "about again also can could should would tell remind know talk talked discuss discussed say said user assistant"
).split()

#: Java's form of the accents that lower-case folding removes (fixed values).
_ACCENTED = "áàâäãåāăąçćčďđéèêëēėęěíìîïīįłľñńňóòôöõøōőřŕśšşťţúùûüūůűųýÿžźż"
_PLAIN = "aaaaaaaaacccddeeeeeeeeiiiiiillnnnooooooooorrsssttuuuuuuuuyyzzz"

SPACE = r"[ \t\n\x0B\f\r]+"


def squeeze(c: Column) -> Column:
    """One line: runs of white space become one space, none outside."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def strip(c: Column) -> Column:
    """Without outer white space."""
    return F.regexp_replace(c, rf"\A{SPACE}|{SPACE}\z", "")


def word_count(c: Column) -> Column:
    """Words between white space; 0 for null and blank."""
    one = squeeze(F.coalesce(c, F.lit("")))
    return F.when(one == "", 0).otherwise(F.size(F.split(one, " ")))


def estimate_tokens(c: Column) -> Column:
    """A quarter of the characters, at least 1; null for null."""
    return F.greatest(F.lit(1), (F.char_length(c) / 4).cast("int"))


def query_terms(c: Column) -> Column:
    """Distinct lower-case runs of 2 or more ASCII letters and digits without stopwords, or all of them if none is left."""
    raw = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]{2,})"), F.lit(1)))
    kept = F.filter(raw, lambda t: ~t.isin(STOPWORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(raw)


def index_tokens(c: Column) -> Column:
    """Every token of a text, in order: lower case, common accents folded, split at other characters."""
    folded = F.translate(F.lower(F.coalesce(c, F.lit(""))), _ACCENTED, _PLAIN)
    return F.regexp_extract_all(folded, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def normalize_key(c: Column) -> Column:
    """A fact key: lower case, spaces to underscores, only a-z, 0-9 and underscore."""
    return F.regexp_replace(F.replace(F.lower(strip(c)), F.lit(" "), F.lit("_")), "[^a-z0-9_]", "")


def canonical_name(c: Column) -> Column:
    """An entity's name: lower case, one spacing, without one leading article."""
    return F.regexp_replace(squeeze(F.lower(c)), r"\A(?:the|a|an) ", "")


def condense(c: Column, limit: int = 240) -> Column:
    """One line of at most `limit` characters, with an ellipsis if cut."""
    one = squeeze(c)
    return F.when(F.char_length(one) > limit, F.concat(F.left(one, F.lit(limit)), F.lit("…"))).otherwise(one)


def leading_clause(c: Column, most: int = 120) -> Column:
    """Up to the first full stop, else question mark, else exclamation mark within `most` characters."""
    one = squeeze(c)
    out = F.trim(F.left(one, F.lit(most)))
    for stop in ("! ", "? ", ". "):
        at = F.instr(one, stop)
        out = F.when((at > 1) & (at <= most + 1), F.left(one, at)).otherwise(out)
    return out


def sentences(c: Column) -> Column:
    """The text cut at white space after . ! or ?"""
    return F.split(c, rf"(?<=[.!?]){SPACE}", -1)


def json_object(c: Column) -> Column:
    """From the first { to the last }, or null."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


# --- stemming ----------------------------------------------------------------
# The published Porter algorithm; its suffix tables are fixed values.

_STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """c and v for consonants and vowels."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or ch == "y" and i and out[i - 1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


@lru_cache(1 << 17)
def porter_stem(word: str) -> str:
    """The Porter stem of a lower-case word of ASCII letters; other words are returned as they are."""
    if len(word) <= 2 or not (word.isascii() and word.isalpha()):
        return word
    w = word
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]):
            w = w[:-1]
    else:
        cut = next((w[: -len(s)] for s in ("ed", "ing") if w.endswith(s) and "v" in _shape(w[: -len(s)])), None)
        if cut is not None:
            w = cut
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short_end(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for old, new in sorted(table, key=lambda p: -len(p[0])):
            if w.endswith(old):
                if _measure(w[: -len(old)]):
                    w = w[: -len(old)] + new
                break
    for old in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(old):
            stem = w[: -len(old)]
            if _measure(stem) > 1 and (old != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _short_end(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def fold_token(token: str) -> str:
    """A token without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", token) if not unicodedata.combining(c))


def _stem_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda a: None if a is None else [porter_stem(fold_token(t)) for t in a])


def stem_tokens(c: Column) -> Column:
    """Stems of an array of tokens. The session must have shipped this package."""
    return F.pandas_udf(_stem_batches, "array<string>")(c)
