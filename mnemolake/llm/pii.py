"""Personal information in free text: typed spans and placeholders.

A text is first normalised by small transducers (look-alike letters, full-width
characters, zero-width characters, spelled digits, at/dot disguises), each of
which records what it replaced. Identifiers are detected in the normalised
text, and their spans are mapped back to the characters of the source, so the
rest of the text stays exactly as it is.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workers import map_batches
from .lexicon import COMMON_WORDS, GIVEN_NAMES, NICKNAMES, ORGANISATION_WORDS, TITLES
from .tokens import _quoted

KINDS = ("email", "idnumber", "phone", "address", "name")

# --- transducers -----------------------------------------------------------

# Look-alikes of Latin letters, dashes and spaces.
_LOOKALIKES = dict(zip("АВЕКМНОРСТХаеорсухіјѕԁҺΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEKMHOPCTXaeopcyxijsdhABEZHIKMNOPTYXo"))
_LOOKALIKES |= {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}
_LOOKALIKES |= {chr(c): "-" for c in (0x2010, 0x2011, 0x2012, 0x2013, 0x2212)} | {chr(c): " " for c in (0xA0, 0x2007, 0x2009, 0x202F)}
_TABLE = str.maketrans(_LOOKALIKES)
_DIGITS = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}

_HIDDEN = re.compile("[​‌⁠﻿­]")
_AT = re.compile(r"\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?", re.I)
_DOT = re.compile(r"\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?", re.I)
_SPOKEN = re.compile(r"(?<=[A-Za-z0-9]) at (?=[A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)+\b)", re.I)
_SPOKEN_DOT = re.compile(r"(?<=[A-Za-z0-9]) dot (?=[A-Za-z0-9])", re.I)
_TIMES = {"double": 2, "triple": 3}
_SPOKEN_DIGIT = rf"(?:(?:{'|'.join(_TIMES)})[ -])?(?:{'|'.join(_DIGITS)})"
_SPELLED = re.compile(rf"(?<!\w)(?:plus[ -])?{_SPOKEN_DIGIT}(?:(?:[ -]|, ?){_SPOKEN_DIGIT}){{3,}}(?!\w)", re.I)
_HINT = re.compile(rf"[\[({{<]\s?(?:at|dot|@)\s?[\])}}>]| dot |[\u200b\u200c\u2060\ufeff\u00ad]|(?:{'|'.join(_DIGITS)})(?:[ -]|, ?){_SPOKEN_DIGIT}", re.I)


def _spoken_digits(m: re.Match) -> str:
    """The digits of a spelled number, with a dash for each comma; unchanged if they are fewer than six."""
    out = []
    times = 1
    for word in re.findall(r"[a-z]+|,", m[0].lower()):
        if word in _TIMES:
            times = _TIMES[word]
        else:
            out.append("-" if word == "," else "+" if word == "plus" else _DIGITS[word] * times)
            times = 1
    digits = "".join(out)
    return digits if sum(c.isdigit() for c in digits) >= 6 else m[0]


class Normalised:
    """A normalised text that can map its offsets back to the source."""

    def __init__(self, source: str):
        self.text = source if source.isascii() else source.translate(_TABLE)  # one character for one
        self.steps: list[tuple[list[int], list[int], list[int]]] = []
        if not _HINT.search(self.text):
            return
        self._rewrite(_HIDDEN, lambda m: "")
        before = self.text
        self._rewrite(_AT, lambda m: "@")
        self._rewrite(_SPOKEN, lambda m: "@")
        if self.text != before:
            self._rewrite(_DOT, lambda m: ".")
            self._rewrite(_SPOKEN_DOT, lambda m: ".")
        self._rewrite(_SPELLED, _spoken_digits)

    def _rewrite(self, pattern: re.Pattern, out) -> None:
        pieces, starts, shifts, widths, at, length = [], [], [], [], 0, 0
        for m in pattern.finditer(self.text):
            new = out(m)
            pieces += [self.text[at : m.start()], new]
            length += m.start() - at
            starts.append(length)
            widths.append(len(new))
            length += len(new)
            shifts.append(m.end() - length)
            at = m.end()
        if starts:
            self.text = "".join([*pieces, self.text[at:]])
            self.steps.append((starts, widths, shifts))

    def source_span(self, start: int, end: int) -> tuple[int, int]:
        """The source's span of a span of the normalised text."""
        for starts, widths, shifts in reversed(self.steps):
            start, end = self._back(start, starts, widths, shifts, False), self._back(end, starts, widths, shifts, True)
        return start, end

    @staticmethod
    def _back(x: int, starts: list[int], widths: list[int], shifts: list[int], is_end: bool) -> int:
        i = bisect.bisect_left(starts, x) - 1 if is_end else bisect.bisect_right(starts, x) - 1
        if i < 0:
            return x
        if x < starts[i] + widths[i] and not is_end or is_end and x <= starts[i] + widths[i]:
            inside_end = starts[i] + widths[i] + shifts[i]
            inside_start = starts[i] + (shifts[i - 1] if i else 0)
            return inside_end if is_end else inside_start
        return x + shifts[i]


# --- detectors -------------------------------------------------------------

_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]*(?: @ |@)[A-Za-z0-9][A-Za-z0-9\-]*(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}(?![A-Za-z0-9])")
#: The same with a domain in other scripts, whose labels may hold any letters.
_EMAIL_ABROAD = re.compile(r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]*@(?=[A-Za-z0-9.\-]*[^\W\d_a-zA-Z])[^\W_](?:[\w\-]*[^\W_])?(?:\.[^\W_](?:[\w\-]*[^\W_])?)*\.[^\W\d_]{2,}(?!\w)")
_BEFORE, _AFTER = r"(?<![\w#@/+\-])(?<!\d\.)", r"(?![\w@/\-]|\.\d)"
_ID = re.compile(
    _BEFORE
    + r"(?:\d{3}([- ])\d{2}\1\d{4}"  # 3-2-4
    + r"|[A-Za-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Da-d]"  # two letters, six digits, suffix
    + r"|[A-Za-z]\d{4} ?\d{4}[A-Za-z]?"  # letter and eight digits
    + r"|[XYZ]-?\d{7}-?[A-Z]|\d{8}-?[A-Z]"
    + r"|[A-Za-z9]{5}-\d{6}-[A-Za-z]{1,2}\d{1,2}[A-Za-z]{0,2}"  # coded surname
    + r"|\d{6}-\d{4}-\d|\d{2,3}/\d{3}/\d{4,5})"
    + _AFTER
)
_ID_CUE = re.compile(r"(?:social security|ssn|national (?:id|identity|insurance)|passport|tax|insurance|driver'?s? licen[cs]e|identity|\bid)(?: card)?(?: (?:number|no\.?|id))?(?: (?:on the form|you gave me))?(?: (?:is|was)|:)? ((?=[A-Za-z0-9]*[ /\-]?[A-Za-z0-9]*\d)[A-Za-z0-9](?:[A-Za-z0-9]|[ /\-](?=[A-Za-z]?\d)){6,18})(?![\w@/\-])", re.I)
_PHONE = re.compile(
    r"(?<![\w#@/.\-+(])(?:"
    r"(?:\+|00)[1-9]\d{0,2}[ .\-]?(?:\(0\) ?)?(?:\(?\d{1,5}\)?[ .\-]?)(?:\d{2,8}[ .\-]?){0,5}\d{2,8}"
    r"|(?:1[ .\-])?(?:\([2-9]\d\d\) ?|[2-9]\d\d[ .\-])[2-9]\d\d[ .\-]\d{4}"
    r"|(?:1?[2-9]\d\d)[2-9]\d{6}"
    r"|\(?0\d{1,4}\)?(?:[ .\-/]\d{2,8}){1,4}"
    r"|0\d{9,10}"
    r")(?: ?(?:ext|x|ext\.|extension) ?\.? ?\d{1,5})?(?![\w@/\-]|\.\d)",
    re.I,
)
_HOUSE = r"\d{1,5}[A-Za-z]?"
_LETTER = r"[^\W\d_]"
_STREET_TYPES = r"(?:street|st|avenue|ave|road|rd|lane|ln|close|boulevard|blvd|square|sq|drive|court|ct|place|terrace|crescent|highway|hwy|parkway|quay)"
_PLACE_TAIL = rf"(?:, (?:(?:apt|flat|unit|suite)\.? \w{{1,5}}|\d{{4,6}} {_LETTER}{{3,}}|{_LETTER}{{3,}}(?: \d{{4,6}})?)|\n{_LETTER}{{3,}} \d{{4,6}}(?!\w))?"
_STREET = re.compile(
    rf"(?<![\w.\-/])(?:(?:flat|apt|unit) \w{{1,5}}, )?{_HOUSE},? (?:(?:upper|lower|old|new|north|south|east|west|great|little|saint|st\.?) )?({_LETTER}[\w'’\-]{{2,}}) {_STREET_TYPES}\b\.?{_PLACE_TAIL}"
    rf"|(?<![\w.\-/])({_LETTER}[\w'’\-]{{2,}}) {_STREET_TYPES}\b\.? {_HOUSE}(?![\w\-.]\d){_PLACE_TAIL}",
    re.I,
)
_RUE = re.compile(rf"(?<![\w.\-/]){_HOUSE},? (?:bis |ter )?(?:rue|avenue|boulevard|place|allée|chemin|quai|impasse) (?:de la |de |du |des |d['’])?{_LETTER}[\w'’\-]+(?:, \d{{5}} {_LETTER}{{3,}})?", re.I)
_CALLE = re.compile(rf"(?<!\w)(?:calle|avenida|plaza|paseo|via|viale|piazza|rua) (?:de la |de |del |di |da |do )?{_LETTER}[\w'’\-]+,? (?:n[.º°o]* ?)?{_HOUSE}(?![\w\-.]\d)(?:, \d{{4,6}} {_LETTER}{{3,}})?", re.I)
_STRASSE = re.compile(rf"(?<!\w){_LETTER}[\w\-]*(?:straße|strasse|str\.|weg|gasse|platz|allee) {_HOUSE}(?![\w\-.]\d)(?:, \d{{4,5}} {_LETTER}{{3,}})?", re.I)

_WORD = re.compile(rf"{_LETTER}(?:[̀-ͯ]|{_LETTER})*(?:['’\-]{_LETTER}(?:[̀-ͯ]|{_LETTER})*)*")
_LAST = rf"{_LETTER}(?:[̀-ͯ'’]|{_LETTER}){{2,}}(?:-{_LETTER}+)?"
_NEXT = re.compile(rf"[ \t]((?:{_LETTER}\.?[ \t])?)({_LAST})(?![\w@])")
_LAST_ONLY = re.compile(_LAST)
_TITLED = re.compile(rf"(?<![\w@])({'|'.join(TITLES)})(?:\.[ \t]?|[ \t])((?:{_LETTER}\.?[ \t])?)({_LAST})((?:[ \t]{_LAST})?)(?![\w@])", re.I)
_INITIAL = re.compile(rf"(?<![\w@.&'’\-])([^\W\d_a-z])\.[ \t]?((?:[^\W\d_a-z]\.[ \t]?)?)({_LAST})(?![\w@])")
_INITIAL_AFTER = re.compile(rf"(?<![\w@.\-+/#])({_LAST}),[ \t]([^\W\d_a-z])\.(?!\w)")
# Words beside which a person's name stands: it is then recognised by its shape, whatever its words (fixed values).
_ADDRESSED = "ask|asked|call|called|meet|met|contact|contacted|email|emailed|phone|phoned|tell|told|thank|thanked|visit|visited|invite|invited|name is|i am|i'm|regards|sincerely|colleague|friend|boss|manager|neighbour|neighbor|doctor|sister|brother|mother|father|wife|husband|daughter|son"
_ACTING = "called|said|says|wrote|writes|asked|asks|replied|told|emailed|phoned|lives|joined|moved|thinks|wants|agreed"
_SHAPED = rf"({_LETTER}(?:['’]|{_LETTER})+(?:-{_LETTER}+)?)"
_NAMED_AFTER = re.compile(rf"(?<!\w)(?:{_ADDRESSED}),?[ \t\n]{{1,2}}{_SHAPED}(?:[ \t]{_LETTER}\.?)?[ \t]{_SHAPED}(?![\w@/]|\.\w|-\d)", re.I)
_NAMED_BEFORE = re.compile(rf"(?<![\w@.\-+/#]){_SHAPED}(?:[ \t]{_LETTER}\.?)?[ \t]{_SHAPED}[ \t](?:{_ACTING})(?!\w)")
_THEN = re.compile(rf"[ \t]{_SHAPED}")

_STREET_WORDS = frozenset("street st avenue ave road rd lane ln close boulevard blvd square sq drive court ct place terrace crescent highway hwy parkway quay".split())
_FOREIGN_STREETS = frozenset("rue avenue boulevard place allée chemin quai impasse calle avenida plaza paseo via viale piazza rua".split())
_PEOPLE = GIVEN_NAMES | NICKNAMES.keys()
_ID_CUES = frozenset("security ssn national passport tax insurance driver drivers licence license identity id".split())
_TITLE_SET = frozenset(TITLES)
_CUE_SET = frozenset(re.findall("[a-z]+", f"{_ADDRESSED}|{_ACTING}")) - {"i", "is", "m"}
_TRIGGERS = _CUE_SET | _STREET_WORDS | _FOREIGN_STREETS | _PEOPLE | _ID_CUES | _TITLE_SET
_SIMPLE_WORDS = re.compile(r"[^\W\d_]+").findall
_DIGIT = re.compile(r"\d")
_INITIAL_HINT = re.compile(r"(?<![\w@])[^\W\d_a-z]\.[ \t]?[^\W\d_]|,[ \t][^\W\d_a-z]\.")
_STRASSE_HINT = re.compile(r"(?:straße|strasse|str\.|weg|gasse|platz|allee) \d", re.I)


def _capital(word: str) -> bool:
    return word[0] != word[0].lower()


def _surname(word: str, capital: bool) -> bool:
    """Whether a word may be a last name beside a given name written with or without a capital."""
    low = word.lower()
    return low not in COMMON_WORDS and low not in ORGANISATION_WORDS and low not in _PEOPLE and low not in _STREET_WORDS and (not capital or _capital(word))


def _shaped(word: str) -> bool:
    """Whether a word is written like a part of a name (a capital, then small letters) and is no common word."""
    low = word.lower()
    return word[0].isupper() and word[-1].islower() and low not in COMMON_WORDS and low not in ORGANISATION_WORDS and low not in _STREET_WORDS and low not in _TITLE_SET


def _previous(text: str, at: int) -> tuple[int, str, bool] | None:
    """(start, word, whether a comma follows it) of the last name right before a position."""
    end = at - 1
    if end < 1 or text[end] not in " \t":
        return None
    comma = text[end - 1] == ","
    end -= comma
    start = end
    while start and (text[start - 1].isalpha() or text[start - 1] in "'’-" or "\u0300" <= text[start - 1] <= "\u036f"):
        start -= 1
    if start and (text[start - 1] in "@.+/#_" or text[start - 1].isalnum()) or not _LAST_ONLY.fullmatch(text, start, end):
        return None
    return start, text[start:end], comma


def detect(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the identifiers of a normalised text, in order and without overlap."""
    spans: list[tuple[str, int, int]] = []  # by start
    starts: list[int] = []

    def free(start: int, end: int) -> bool:
        i = bisect.bisect_right(starts, start)
        return (not i or spans[i - 1][2] <= start) and (i == len(starts) or starts[i] >= end)

    def add(kind: str, start: int, end: int) -> None:
        if free(start, end):
            i = bisect.bisect_right(starts, start)
            starts.insert(i, start)
            spans.insert(i, (kind, start, end))

    triggers = _TRIGGERS.intersection(_SIMPLE_WORDS(text.lower()))
    if "@" in text:
        for m in _EMAIL.finditer(text):
            add("email", m.start(), m.end())
        if not text.isascii():
            for m in _EMAIL_ABROAD.finditer(text):
                add("email", m.start(), m.end())
    if _DIGIT.search(text):
        for m in _ID.finditer(text):
            add("idnumber", m.start(), m.end())
        if triggers & _ID_CUES:
            for m in _ID_CUE.finditer(text):
                if sum(c.isdigit() for c in m[1]) >= 5 and not re.fullmatch(r"\d{4}-\d\d-\d\d", m[1]):
                    add("idnumber", m.start(1), m.end(1))
        for m in _PHONE.finditer(text):
            digits = sum(c.isdigit() for c in m[0])
            if 9 <= digits <= 20 and (m[0][0] != "0" or digits >= 10):
                add("phone", m.start(), m.end())
        if triggers & _STREET_WORDS:
            for m in _STREET.finditer(text):
                if (m[1] or m[2]).lower() not in COMMON_WORDS:
                    add("address", m.start(), m.end())
        if triggers & _FOREIGN_STREETS:
            for pattern in (_RUE, _CALLE):
                for m in pattern.finditer(text):
                    add("address", m.start(), m.end())
        if _STRASSE_HINT.search(text):
            for m in _STRASSE.finditer(text):
                add("address", m.start(), m.end())
    if triggers & _TITLE_SET:
        for m in _TITLED.finditer(text):
            if m[1] in ("mx", "MX"):  # more likely the record
                continue
            capital, second = _capital(m[1]), m[4].strip()
            if second and _shaped(second) and (m[3].lower() in _PEOPLE or _shaped(m[3])):
                add("name", m.start(), m.end(4))
            elif _surname(m[3], capital):
                add("name", m.start(), m.end(3))
            elif m[3].lower() in _PEOPLE and second and _surname(second, capital):
                add("name", m.start(), m.end(4))
    if triggers & _PEOPLE:
        for w in _WORD.finditer(text):
            if w[0].lower() not in _PEOPLE or not free(w.start(), w.end()):
                continue
            s, e = w.span()
            if s and text[s - 1] in "@._+-/#" or e < len(text) and text[e] in "@_/":
                continue
            capital = _capital(w[0])
            m = _NEXT.match(text, e)
            if m and _surname(m[2], capital) and not (follow := _NEXT.match(text, m.end())) or m and _surname(m[2], capital) and follow[2].lower() not in ORGANISATION_WORDS:
                add("name", s, m.end())
                continue
            before = _previous(text, s)
            if before and _surname(before[1], capital) and (before[2] or capital):
                add("name", before[0], e)
    if _INITIAL_HINT.search(text):
        for pattern, last in ((_INITIAL, 3), (_INITIAL_AFTER, 1)):
            for m in pattern.finditer(text):
                if _surname(m[last], True):
                    add("name", m.start(), m.end())
    if triggers & _CUE_SET:
        for pattern in (_NAMED_AFTER, _NAMED_BEFORE):
            for m in pattern.finditer(text):
                if _shaped(m[1]) and _shaped(m[2]):
                    follow = _THEN.match(text, m.end(2))
                    if not follow or follow[1].lower() not in ORGANISATION_WORDS and not (follow[1][0].isupper() and follow[1].lower() in _STREET_WORDS):
                        add("name", m.start(1), m.end(2))
    return spans


def redact(text: str | None) -> tuple[str | None, list[tuple[str, int, int]]]:
    """The text with placeholders such as [EMAIL], and (kind, start, end) in the source's characters."""
    if not text:
        return text, []
    n = Normalised(text)
    found = detect(n.text)
    if not found:
        return text, []
    found = [(kind, *n.source_span(s, e)) for kind, s, e in found]
    out, at = [], 0
    for kind, s, e in found:
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]]), found


def redact_texts(df: DataFrame, id_cols: list[str], text_col: str) -> DataFrame:
    """(id columns, redacted string, spans array<struct<kind, start, end>>) of every row.

    Spans are half-open, in Unicode code points of the source text, counted
    from 0. Null text stays null and empty text empty, both with no spans; one
    output row per input row, in any order; no shuffle.
    """
    ids = [df.schema[c] for c in id_cols]
    schema = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in ids) + ", redacted string, spans array<struct<kind: string, start: int, end: int>>"
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, kinds, starts, ends, offsets = [], [], [], [], [0]
            for text in batch.column(len(ids)).to_pylist():
                out, spans = redact(text)
                texts.append(out)
                for kind, s, e in spans:
                    kinds.append(kind)
                    starts.append(s)
                    ends.append(e)
                offsets.append(len(kinds))
            values = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], fields=list(span))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(ids))), pa.array(texts, pa.string()), lists], [*id_cols, "redacted", "spans"])

    return map_batches(df.select(*(F.col(_quoted(c)) for c in id_cols), F.col(_quoted(text_col)).cast("string")), run, schema)
