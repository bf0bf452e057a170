"""Disguises that stand alone in a text, with nothing else that calls for the transducers."""

import random
import re
import time

import pytest

from corrweave.llm import pii

PLANTED = [
    ("phone", "plus 44 20 7946 0958"), ("ip", "192 point 168 point 1 point 1"), ("phone", "+1 dash 415 dash 555 dash 0123"), ("phone", "+1 hyphen 415 hyphen 555 hyphen 0123"), ("phone", "+44 20 7946 0 nine"),
    ("email", "ann@site . org"), ("email", "ann\t@\tsite.org"), ("email", "ann@\nsite.org"), ("phone", "+④④ ②⓪ ⑦⑨④⑥ ⓪⑨⑤⑧"), ("ip", "¹⁹².¹⁶⁸.¹.¹"), ("email", "ann [AT] site [DOT] org"), ("email", "ann at site dot org"),
    ("card", "4111,1111,1111,1111"),
]


@pytest.mark.parametrize("kind, said", PLANTED)
def test_lone_disguises(kind, said):
    text = f"Write: {said}; thanks"
    assert [(pii.KINDS[k], text[s:e]) for s, k, e in pii.all_spans(text, pii.base_spans(text))] == [(kind, said)]


# The rules as plain patterns, without care for time.
LABEL, DOT = r"[A-Za-z0-9][A-Za-z0-9-]{0,62}", r"(?:\s+dot\s+|\.)"
PLAIN = {
    "bracket at": r"\s*[\[({<]\s*(?:at|@)\s*[\])}>]\s*", "bracket dot": r"\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*", "digit dot": r"(?<=[0-9])\s+dot\s+(?=[0-9])",
    "sign at": rf"([A-Za-z0-9._%+-]+)(\s*@\s*)({LABEL}(?:(?:{DOT}|\s+\.\s+){LABEL}){{1,4}})(?![A-Za-z0-9-])", "spaced dot": r"\s+(?:dot|\.)\s+",
    "part": rf"\b(?:(double|triple)[\s-]+)?({'|'.join(pii.DIGIT_WORDS)})\b|\bplus\s+|\s+(?:dot|point)\s+|\s+(?:dash|hyphen)\s+|,\s?",
}
PLAIN = {k: re.compile(v, re.I) for k, v in PLAIN.items()}


def plain_digits(t):
    edits = []
    for run in pii._SPELLED.finditer(t.text):
        for m in PLAIN["part"].finditer(t.text, run.start(), run.end()):
            times, word, said = m.group(1), m.group(2), m.group().strip().lower()
            if word:
                edits.append((m.start(), m.end(), pii.DIGIT_WORDS[word.lower()] * {"double": 2, "triple": 3}.get((times or "").lower(), 1)))
            elif m.end() < run.end() or said == "plus":
                edits.append((m.start(), m.end(), {"plus": "+", "dot": ".", "point": ".", ",": " "}.get(said, "-")))
    t.rewrite(edits)


def all_steps(text):
    """The transducers one by one by the plain patterns, without any condition on the text."""
    t = pii.Traced(text)
    t.rewrite([(i, i + 1, p) for i, c in enumerate(t.text) if c > "\x7f" and (p := pii._plain(c)) != c])
    t.rewrite([(m.start(), m.end(), "0" if m.group() in "Oo" else "1") for m in pii._LOOKS_DIGIT.finditer(t.text)])
    plain_digits(t)
    for pattern, sign in ((PLAIN["bracket at"], "@"), (PLAIN["bracket dot"], "."), (PLAIN["digit dot"], ".")):
        t.rewrite([(m.start(), m.end(), sign) for m in pattern.finditer(t.text)])
    for pattern in (PLAIN["sign at"], pii._BARE_AT):
        edits = []
        for m in pattern.finditer(t.text):
            dots = [[(*d.span(), ".") for d in PLAIN["spaced dot"].finditer(t.text, *m.span(part))] for part in (1, 3)]
            edits += [*dots[0], (*m.span(2), "@"), *dots[1]]
        t.rewrite(edits)
    base = pii.base_spans(text)
    found = {(s, k, e) for a, k, b in pii.base_spans(t.text) for s, e in [t.source(a, b)]}
    return sorted({*base, *((s, k, e) for s, k, e in found if not any(k == j and s >= x and e <= y for x, j, y in base))})


def test_conditions_lose_nothing(documents):
    texts = [r.text or "" for r in documents.collect()]
    for i, t in enumerate([*texts, *(f"{a} {said} {a}" for a in (t[:60] for t in texts[:20]) for _, said in PLANTED)]):
        assert pii.all_spans(t, pii.base_spans(t)) == all_steps(t), i


def test_random_disguises_as_by_the_plain_patterns():
    r = random.Random(7)
    parts = ["ann", "b.c", "site", "org", "at", "dot", "@", ".", "[at]", "( dot )", "<@>", " ", "  ", "\t", "\n", ",", "-", "one", "two", "double", "plus", "point", "dash", "1", "22", "+1", "555", "_", "%", "а", "④", "[", "]"]
    for i in range(30_000):
        t = "".join(r.choice(parts) + r.choice(["", "", " "]) for _ in range(r.randint(1, 24)))
        assert pii.all_spans(t, pii.base_spans(t)) == all_steps(t), t


@pytest.mark.parametrize("piece", [" ", "a", "\n\t", "1", "1 ", "@", "a@", " @ ", "[ ", "a.", "a. ", "one ", "1 dot ", "dot ", " at ", "a at b dot ", "+", "+1(", "a@b.c ", "plus ", "double ", "1,", "é", "a at     "])
def test_a_megabyte_of_anything_takes_seconds(piece):
    """Also with a disguise at its end, so that every transducer runs."""
    text = piece * (1_000_000 // len(piece)) + " ann [at] site [dot] org; x @ y . z at q dot org 1 dot 2 dot 3 dot 4"
    began = time.perf_counter()
    pii.all_spans(text, pii.base_spans(text))
    assert time.perf_counter() - began < 20
