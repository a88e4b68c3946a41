"""Splitting of oversized texts at natural boundaries, with overlap.

Everything is SQL array functions over one bounded-quantifier regular
expression: its alternatives, strongest boundary first, each consume as much as
the limit allows and at least half of it, so a cut falls on the last strong
boundary in the second half of the window; single characters are the fallback.
Lookback offsets then prepend the end of the text before each cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import _quoted

LIMIT = 1600
OVERLAP = 160

#: What must stand before a cut, strongest first (fixed values).
BOUNDARIES = (
    r"\n[ \t]{0,8}\r?\n",  # paragraph
    r"\n",  # line
    r"[.!?][\"')\]]?\s|[。！？]",  # sentence
    r"[;:,]\s|[，；、]",  # clause
    r"\s",  # word
    r"[;,|/&]",  # separators of unspaced data
)
#: Characters that belong to the one before them.
JOINING = r"\p{M}\x{200D}\x{FE0F}\x{1F3FB}-\x{1F3FF}"


def piece_pattern(limit: int, overlap: int) -> str:
    """The expression whose successive matches are the fresh parts of the pieces.

    The first may have `limit` characters, later ones `limit - overlap`.
    """

    def upto(most: int, anchor: str) -> list[str]:
        least = max(1, most // 2)
        cuts = [rf"{anchor}.{{{least},{most}}}(?<={b})" for b in BOUNDARIES]
        return [rf"{anchor}.{{1,{most}}}\z", *cuts, rf"{anchor}.{{{least},{most}}}(?<!\x{{200D}})(?![{JOINING}])", rf"{anchor}.{{1,{most}}}"]

    return "(?s)(?:" + "|".join([*upto(limit, r"\A"), *upto(limit - overlap, "")]) + ")"


def lead_in(before: Column, overlap: int) -> Column:
    """The last `overlap` characters, from a word's start if one is near."""
    tail = F.right(before, F.lit(overlap))
    return F.regexp_replace(tail, rf"(?s)\A(?:\S{{0,{overlap // 5}}}\s+(?=\S)|[{JOINING}]+)", "")


def split_texts(df: DataFrame, id_cols: list[str], text_col: str, *, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id columns, piece int, pieces int, start_at int, piece_text) of every text.

    Pieces are numbered from 1, have at most `limit` Unicode code points, and
    each after the first begins with the last `overlap` characters or so of the
    one before; without that lead-in (whose first character is `start_at`,
    counted from 1) they add up to the text. A text within the limit is its own
    single piece; null and empty texts give no rows. Repeated rows are split
    alike. Requires 0 <= overlap <= limit / 4.
    """
    if not 0 <= overlap <= limit // 4:
        raise ValueError("overlap must lie between 0 and a quarter of limit")
    text = F.col(_quoted(text_col)).cast("string")
    fresh = F.when(F.char_length(text) > limit, F.regexp_extract_all(text, F.lit(piece_pattern(limit, overlap)), F.lit(0))).otherwise(F.array(text))
    ids = [F.col(_quoted(c)) for c in id_cols]
    # A one-element explode keeps the array as a column, so that it is computed once.
    parts = df.filter(F.char_length(text) > 0).select(*ids, F.explode(F.array(fresh)).alias("parts"))
    starts = F.aggregate(
        F.col("parts"),
        F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("all")),
        lambda acc, x: F.struct((acc["next"] + F.char_length(x)).alias("next"), F.array_append(acc["all"], acc["next"]).alias("all")),
    )["all"]
    zipped = F.arrays_zip(F.col("parts").alias("part"), starts.alias("at"), F.concat(F.array(F.lit("")), F.col("parts")).alias("before"))
    rows = parts.select(*ids, F.size("parts").alias("pieces"), F.posexplode(zipped).alias("pos", "z")).filter("pos < pieces")
    lead = F.when(F.col("pos") > 0, lead_in(F.col("z.before"), overlap)).otherwise("") if overlap else F.lit("")
    rows = rows.select(*ids, (F.col("pos") + 1).alias("piece"), "pieces", F.col("z.at").alias("at"), F.col("z.part").alias("part"), lead.alias("lead"))
    return rows.select(*ids, "piece", "pieces", (F.col("at") - F.char_length("lead")).alias("start_at"), F.concat("lead", "part").alias("piece_text"))
