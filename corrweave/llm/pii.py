"""Personal data by offset-preserving deobfuscation.

Transducers rewrite a text step by step (look-alike characters, spelled digits, at and dot disguises) while each
character of the result keeps the source span that it came from. The detectors run on the source and on the result, and what
is found in the result is mapped back to the source.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import small_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

# --- detectors ------------------------------------------------------------------------------------------------------

_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin where its digits begin, so the look-behind changes nothing but the time on long runs of digits.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """From each @ outwards: the leftmost match of the pattern takes the whole run before its @."""
    end = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            end = m.end()


def ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:] if p.strip("0") else "0") <= 255 for p in m.group().split(".")):
            yield m.span()


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := _NOT_DIGIT.sub("", m.group())) <= 19 and _luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            yield m.span()


DETECTORS: dict[str, Callable[[str], Iterator[Span]]] = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end), sorted."""
    found = []
    if "@" in text:
        found += [(s, 0, e) for s, e in emails(text)]
    found += [(s, 1, e) for s, e in ips(text)]
    found += [(s, 2, e) for s, e in cards(text)]
    if "+" in text:
        found += [(s, 3, e) for s, e in phones(text)]
    return sorted(found)


# --- transducers ----------------------------------------------------------------------------------------------------

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ո": "n", "һ": "h", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ɑ": "a", "ɡ": "g", "ı": "i", "ⅼ": "l", "․": ".", "。": ".", "．": ".", "·": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "＠": "@", "﹫": "@", "＋": "+", " ": " ", " ": " ", " ": " ",
}
# Characters without width.
INVISIBLE = "​‌‍⁠﻿­"
# Digits as words.
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_TIMES = {"double": 2, "triple": 3}

_WORD = "|".join([*DIGIT_WORDS, "double", "triple"])
#: At least three digits in a row, one of them at least a word; with words that stand for other signs of a number.
_SPELLED = re.compile(rf"(?<![A-Za-z0-9])(?:plus[\s]+)?(?:(?:(?:{_WORD})(?![A-Za-z])|[0-9]+)(?:[\s,.-]{{1,3}}(?:(?:dot|point|dash|hyphen)[\s]+)?|(?=[^A-Za-z0-9]|\Z)))" + "{3,}", re.I)
# Patterns that take white space first begin where a run of it begins, and give none of it back: else each of its places
# would look through the rest of it. A run that an earlier match has begun to take needs no look-behind.
_SPELLED_PART = re.compile(rf"\b(?:(double|triple)[\s-]++)?({'|'.join(DIGIT_WORDS)})\b|\bplus\s++|(?:(?<!\s)|(?<=,\s))\s++(?:(?:dot|point)|(?:dash|hyphen))\s++|,\s?", re.I)
_BRACKET_AT = re.compile(r"(?:(?<!\s)\s++)?+[\[({<]\s*+(?:at|@)\s*+[\])}>]\s*+", re.I)
_BRACKET_DOT = re.compile(r"(?:(?<!\s)\s++)?+[\[({<]\s*+(?:dot|\.)\s*+[\])}>]\s*+", re.I)
_DIGIT_DOT = re.compile(r"(?<=[0-9])\s++dot\s++(?=[0-9])", re.I)
_LABEL = r"[A-Za-z0-9][A-Za-z0-9-]{0,62}"
_DOT = r"(?:\s+dot\s+|\.)"
#: A mailbox with a bare `at` needs a spelled dot in its domain; prose such as "at example.com" stays prose.
_BARE_AT = re.compile(rf"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{{1,64}}(?:\s+dot\s+[A-Za-z0-9_%+-]{{1,64}}){{0,3}})(\s+at\s+)({_LABEL}(?:{_DOT}{_LABEL}){{0,4}}\s+dot\s+{_LABEL}(?:\s+dot\s+{_LABEL}){{0,2}})(?![A-Za-z0-9-])", re.I)
#: What follows the local part of a mailbox with a sign; `sign_at` looks for the local part from the sign backwards.
_AT_DOMAIN = re.compile(rf"@\s*+({_LABEL}(?:(?:{_DOT}|\s+\.\s+){_LABEL}){{1,4}})(?![A-Za-z0-9-])", re.I)
_SPACED_DOT = re.compile(r"(?<!\s)\s++(?:dot|\.)\s++", re.I)
_LOOKS_DIGIT = re.compile(r"(?<=[0-9])[OoIl](?=[\x20-]?[0-9])")
_BRACKETED = re.compile(r"[\[({<]\s*+(?:at|dot|@|\.)\s*+[\])}>]", re.I)
_SPACED_WORD_DOT = re.compile(r"\sdot\s", re.I)


def sign_at(text: str) -> Iterator[tuple[Span, Span, Span]]:
    """Local part, sign with the white space around it, domain: of each mailbox with a sign and, in its domain, dots or their disguises.

    As of one pattern, leftmost and without overlap: from each @ the white space and then the local part before it are
    taken, but nothing of the match before, so that every character is looked at once from either side.
    """
    end = 0
    for m in _AT_DOMAIN.finditer(text):
        sign = m.start()
        while sign > end and text[sign - 1].isspace():
            sign -= 1
        start = sign
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < sign:
            yield (start, sign), (sign, m.start(1)), m.span(1)
            end = m.end()


def bare_at(text: str) -> Iterator[tuple[Span, Span, Span]]:
    for m in _BARE_AT.finditer(text):
        yield m.span(1), m.span(2), m.span(3)


class Traced:
    """A text whose every character knows the source span it came from. Until the first change, that is its own place."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, None, None

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Puts each string in place of its [start, end), in order and without overlap; its characters share that source span."""
        edits = [x for x in edits if self.text[x[0] : x[1]] != x[2]]
        if not edits:
            return
        if self.starts is None:
            self.starts, self.ends = list(range(len(self.text))), list(range(1, len(self.text) + 1))
        text, starts, ends, at = [], [], [], 0
        for s, e, new in edits:
            text += [self.text[at:s], new]
            starts += self.starts[at:s] + [self.starts[s]] * len(new)
            ends += self.ends[at:s] + [self.ends[e - 1]] * len(new)
            at = e
        self.text = "".join([*text, self.text[at:]])
        self.starts, self.ends = starts + self.starts[at:], ends + self.ends[at:]

    def source(self, start: int, end: int) -> Span:
        return (start, end) if self.starts is None else (self.starts[start], self.ends[end - 1])


@functools.cache
def _plain(c: str) -> str:
    if c in INVISIBLE:
        return ""
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    folded = unicodedata.normalize("NFKC", c)
    return folded if len(folded) == 1 and folded.isascii() else c


def fold_characters(t: Traced) -> None:
    if not t.text.isascii():
        odd = {c: p for c in set(t.text) if c > "\x7f" and (p := _plain(c)) != c}
        if odd:
            t.rewrite([(i, i + 1, odd[c]) for i, c in enumerate(t.text) if c in odd])
    t.rewrite([(m.start(), m.end(), "0" if m.group() in "Oo" else "1") for m in _LOOKS_DIGIT.finditer(t.text)])


def fold_digits(t: Traced) -> None:
    edits = []
    for run in _SPELLED.finditer(t.text):
        for m in _SPELLED_PART.finditer(t.text, run.start(), run.end()):
            times, word, said = m.group(1), m.group(2), m.group().strip().lower()
            if word:
                edits.append((m.start(), m.end(), DIGIT_WORDS[word.lower()] * _TIMES.get((times or "").lower(), 1)))
            elif m.end() < run.end() or said == "plus":
                edits.append((m.start(), m.end(), {"plus": "+", "dot": ".", "point": ".", ",": " "}.get(said, "-")))
    t.rewrite(edits)


def fold_disguises(t: Traced) -> None:
    """Each pattern runs where what it cannot match without is in the text as folded so far."""
    if _BRACKETED.search(t.text):
        t.rewrite([(m.start(), m.end(), "@") for m in _BRACKET_AT.finditer(t.text)])
        t.rewrite([(m.start(), m.end(), ".") for m in _BRACKET_DOT.finditer(t.text)])
    spelled = _SPACED_WORD_DOT.search(t.text)
    if spelled:
        t.rewrite([(m.start(), m.end(), ".") for m in _DIGIT_DOT.finditer(t.text)])
    for of_text, needed in ((sign_at, "@" in t.text), (bare_at, spelled)):
        if not needed:
            continue
        edits = []
        for local, sign, domain in of_text(t.text):
            dots = [[(*d.span(), ".") for d in _SPACED_DOT.finditer(t.text, *span)] for span in (local, domain)]
            edits += [*dots[0], (*sign, "@"), *dots[1]]
        t.rewrite(edits)


def all_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The base spans, and those of the deobfuscated text that no base span of their kind holds already."""
    t = Traced(text)
    for step in (fold_characters, fold_digits, fold_disguises):
        step(t)
    if t.text == text:
        return base
    found = {(s, k, e) for a, k, b in base_spans(t.text) for s, e in [t.source(a, b)]}
    # Base spans of a kind don't overlap, so only the last to begin at or before a span can hold it.
    ends: list[dict[int, int]] = [{} for _ in KINDS]
    for s, k, e in base:
        ends[k][s] = e
    starts = [list(x) for x in ends]

    def new(s: int, k: int, e: int) -> bool:
        at = bisect.bisect_right(starts[k], s)
        return not at or ends[k][starts[k][at - 1]] < e

    return sorted({*base, *(x for x in found if new(*x))})


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(text: Column) -> Column:
    """A struct of n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, n_added, and all spans."""
    counts = [f"n_{k}" for k in KINDS]

    @arrow_udf(f"struct<{', '.join(f'{c}: bigint' for c in counts)}, base_sha256: string, spans: string, n_added: bigint>")
    def detect(texts: pa.Array) -> pa.Array:
        rows: list[dict] = []
        for x in texts:
            t = x.as_py() or ""
            base = base_spans(t)
            every = all_spans(t, base)
            row = dict(zip(counts, (sum(k == i for _, k, _ in base) for i in range(len(KINDS)))))
            rows.append(row | {"base_sha256": hashlib.sha256(_joined(base).encode()).hexdigest(), "spans": _joined(every), "n_added": len(every) - len(base)})
        return pa.array(rows, pa.struct([*((c, pa.int64()) for c in counts), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())]))

    return detect(text)


def redact(text: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans, the first to begin covers all. Null stays null."""

    @arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        out: list[str | None] = []
        for x in texts:
            t = x.as_py()
            spans = all_spans(t, base_spans(t)) if t else []
            parts, at, till = [], 0, 0
            for s, k, e in spans:
                if s >= till:
                    parts += [t[at:s], f"[{KINDS[k]}]"]
                at = till = max(till, e)
            out.append("".join([*parts, t[at:]]) if spans else t)
        return pa.array(out, pa.string())

    return masked(text)


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for each row of `docs` (doc_id, text).

    Time grows in proportion to a text's length, whatever it holds. Counts and digest are of the base spans; `spans` holds all, in code points of the source text. A null text counts
    as empty. Repeated rows stay, other columns are ignored, an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    return docs.select("doc_id", find(F.col("text")).alias("found")).select("doc_id", "found.*")
