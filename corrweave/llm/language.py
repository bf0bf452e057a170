"""Language ID by cross-parsing entropy.

For each language, a suffix automaton of its labelled text tells the longest matches of a new text: the text is parsed
greedily into the longest phrases that occur in the language's text. The language that needs the fewest phrases,
normalised by the bits of one phrase and the length of the text, wins.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import chunks, small_batches
from .sampling import held_out, per_class

#: Symbols parsed as one lane, side by side with others; phrases go on from lane to lane.
LANE = 512
#: Languages parsed at once; what is held beside a text's bytes is about 40 times as much, for each of these a quarter of that.
LANGUAGES = 4
#: Bytes of text parsed at once.
PARSE_BYTES = 1 << 20
UNKNOWN, GAP = 0, 1
#: The language of texts in which none can be told.
UNDETERMINED = "und"


@functools.cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower-case one, or 0 where it is no letter."""
    lower = np.zeros(0x110000, np.int32)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            y = x.lower()
            lower[c] = ord(y) if len(y) == 1 else c
    return lower, lower > 0


class SuffixAutomaton:
    """Of a symbol sequence; online construction, states as dicts while it grows."""

    def __init__(self, symbols: list[int]):
        self.next: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        last = 0
        for c in symbols:
            if c == UNKNOWN:  # a border between texts: matches never cross it
                last = 0
                continue
            if c in self.next[last] and length[self.next[last][c]] == length[last] + 1:
                last = self.next[last][c]
                continue
            new = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = link[p]
                    link[q] = link[new] = clone
            last = new


class Edges:
    """Transitions of many automata, laid over each other: a state's edges lie at its base plus their symbols.

    Rows of states that branch are put, widest first, where all their places are free; states with one edge fill what is
    left. Each place names its owner, so that what one state lacks is never taken from another. Memory grows with the
    edges, at most three a symbol of sample text, whatever the number of letters.
    """

    #: Bases tried at once.
    TRIED = 256

    def __init__(self, width: int):
        self.width, self.states, self.size = width, 0, width
        self.bases: list[np.ndarray] = []
        self.places: list[np.ndarray] = []

    def add(self, automaton: SuffixAutomaton) -> int:
        """The automaton's root; its other states follow in their order."""
        rows = automaton.next
        degree = np.array([len(e) for e in rows])
        symbols = np.fromiter((c for e in rows for c in e), np.int64, degree.sum())
        to = np.fromiter((t for e in rows for t in e.values()), np.int64, degree.sum())
        start = np.cumsum(degree) - degree
        base = np.zeros(len(rows), np.int64)
        free = np.ones(len(to) + len(to) // 4 + 2 * self.width + self.TRIED, bool)
        tried, at = 0, 0
        for s in np.argsort(-degree, kind="stable").tolist():
            if degree[s] < 2:
                break
            if degree[s] != tried:
                tried, at = degree[s], 0
            own = symbols[start[s] : start[s] + degree[s]]
            apart = (own - own.min()).tolist()
            while True:
                if at + self.TRIED + self.width > len(free):
                    free = np.concatenate((free, np.ones(len(free), bool)))
                fits = np.ones(self.TRIED, bool)
                for d in apart:
                    fits &= free[at + d : at + d + self.TRIED]
                k = int(fits.argmax())
                if fits[k]:
                    at += k
                    break
                at += self.TRIED
            free[at + np.array(apart)] = False
            base[s] = at - own.min()
        single = np.flatnonzero(degree == 1)
        room = np.flatnonzero(free)
        if len(room) < len(single):
            room = np.concatenate((room, len(free) + np.arange(len(single))))
        base[single] = room[: len(single)] - symbols[start[single]]
        owner = np.repeat(np.arange(len(rows)), degree)
        place = base[owner] + symbols
        laid = np.full(place.max(initial=-1) + 1, -1 << 32)
        laid[place] = ((owner + self.states) << 32) | (to + self.states)
        root, self.states = self.states, self.states + len(rows)
        self.bases.append((base + self.size).astype(np.int64))
        self.places.append(laid)
        self.size += len(laid)
        return root

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        """(base of each state, at each place the owner's number in the upper 32 bits and the next state's in the lower)."""
        edge = np.full(self.width, -1 << 32)
        return np.concatenate([*self.bases, np.zeros(0, np.int64)]), np.concatenate([edge, *self.places, edge])


class Parser:
    """All languages' automata side by side: from a state and a symbol to the next state and the phrases ended.

    texts: (language, its sample texts) in order of language.
    """

    def __init__(self, texts: tuple[tuple[str, tuple[str, ...]], ...]):
        lower, _ = _letters()
        self.languages = [k for k, _ in texts]
        found = sorted({c for _, many in texts for t in many for c in np.unique(lower[np.frombuffer(t.encode("utf-32-le"), np.uint32)]).tolist()} - {0})
        self.symbol = np.where(lower > 0, UNKNOWN, GAP).astype(np.int32)
        place = np.zeros(0x110000, np.int32)
        place[found] = np.arange(len(found)) + 2
        letters = np.flatnonzero(lower)
        self.symbol[letters] = place[lower[letters]]
        width = len(found) + 2
        edges, roots, self.bits = Edges(width), [], []
        self.start = np.full((len(texts), width), -1, np.int32)
        for k, (_, many) in enumerate(texts):
            sequence: list[int] = []
            for t in many:
                sequence += [*self.symbols(t).tolist(), UNKNOWN]
            automaton = SuffixAutomaton(sequence)
            roots.append(edges.add(automaton))
            for c, s in automaton.next[0].items():
                self.start[k, c] = roots[k] + s
            self.bits.append(np.log2(max(2, len(sequence))))
        self.root = np.array(roots, np.int64)
        self.base, self.edge = edges.done()

    def step(self, lang: np.ndarray, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and the phrases ended: a phrase ends before a symbol that cannot follow it; one that the language lacks is a phrase of its own."""
        edge = self.edge[self.base[state] + symbol]
        follows = (edge >> 32) == state
        root, start = self.root[lang], self.start[lang, symbol]
        lacks = start < 0
        said = np.where(follows, 0, lacks.astype(np.int64) + (state != root))
        return np.where(follows, edge & 0xFFFFFFFF, np.where(lacks, root, start)), said

    def symbols(self, text: str) -> np.ndarray:
        """Lower-case letters, with one gap for each run of anything else."""
        s = self.symbol[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        gap = s == GAP
        return s[~(gap & np.concatenate(([False], gap[:-1])))] if len(s) else s

    def _mended(self, langs: np.ndarray, sizes: np.ndarray, root: np.ndarray, inner: np.ndarray, before: np.ndarray, grid: np.ndarray, states: list[np.ndarray], counts: list[np.ndarray], exits: np.ndarray, phrases: np.ndarray) -> None:
        """Puts exits and phrases right where a lane is entered within a phrase.

        All lanes were parsed from the root. From its true entry a lane soon comes to a state that it had at the same place
        from the root, and is the same from there on; until then it is parsed again. A lane whose exit changes by that is
        an entry that changes, so this is repeated while any does. inner: the lanes that go on from those in `before`.
        """
        rooted_exits, rooted = exits.copy(), phrases.copy()
        entered = np.repeat(root, len(inner), axis=1)
        while True:
            lang, i = np.nonzero(exits[:, before] != entered)
            if not len(i):
                return
            entered[lang, i] = state = exits[lang, before[i]]
            lane, said = inner[i], np.zeros(len(i), np.int64)
            exits[lang, lane], phrases[lang, lane] = rooted_exits[lang, lane], rooted[lang, lane]
            for t in range(LANE):
                over = sizes[lane] <= t
                if over.any():  # never met the other parse: its own exit and count stand
                    exits[lang[over], lane[over]], phrases[lang[over], lane[over]] = state[over], said[over]
                    lang, lane, state, said = lang[~over], lane[~over], state[~over], said[~over]
                if not len(lane):
                    break
                state, more = self.step(langs[lang], state, grid[t][lane])
                said = said + more
                met = states[t][lang, lane] == state
                phrases[lang[met], lane[met]] += said[met] - counts[t][lang[met], lane[met]]
                lang, lane, state, said = lang[~met], lane[~met], state[~met], said[~met]
            exits[lang, lane], phrases[lang, lane] = state, said

    def rates(self, texts: list[str]) -> np.ndarray:
        """(texts, languages): bits that the phrases take for each symbol; empty texts get zeros."""
        sequences = [self.symbols(t) for t in texts]
        total = np.zeros((len(texts), len(self.languages)))
        for k in range(0, len(self.languages), LANGUAGES):
            langs = np.arange(k, min(k + LANGUAGES, len(self.languages)))
            total[:, langs] = self._phrases(langs, sequences).T * np.array(self.bits)[langs]
        return total / np.maximum([len(s) for s in sequences], 1)[:, None]

    def _phrases(self, langs: np.ndarray, sequences: list[np.ndarray]) -> np.ndarray:
        """(langs, sequences): the phrases of each."""
        sizes = np.array([len(s) for s in sequences], np.int64)
        lanes = (sizes + LANE - 1) // LANE
        owner = np.repeat(np.arange(len(sequences)), lanes)
        phrases = np.zeros((len(langs), len(owner)), np.int64)
        if not len(owner):
            return np.zeros((len(langs), len(sequences)), np.int64)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        length = np.minimum(LANE, sizes[owner] - within * LANE)
        order = np.argsort(-length, kind="stable")  # long lanes first, so that those still parsed are the first ones
        place = np.argsort(order, kind="stable")
        flat = np.concatenate([*sequences, np.zeros(LANE, np.int32)])
        starts = ((np.cumsum(sizes) - sizes)[owner] + within * LANE)[order]
        root = self.root[langs][:, None]
        exits = np.repeat(root, len(owner), axis=1)
        grid, states, counts = [], [], []
        active = np.searchsorted(-length[order], -np.arange(LANE), side="left")
        inner = np.flatnonzero(within)
        for n in active[active > 0]:
            grid.append(flat[starts[:n] + len(grid)])
            exits[:, :n], more = self.step(langs[:, None], exits[:, :n], grid[-1])
            phrases[:, :n] += more
            if len(inner):
                states.append(exits[:, :n].astype(np.int32))
                counts.append(phrases[:, :n].astype(np.int16))
        if len(inner):
            self._mended(langs, length[order], root, place[inner], place[inner - 1], grid, states, counts, exits, phrases)
        last = np.concatenate((within[1:] == 0, [True]))[order]
        phrases += last & (exits != root)  # the phrase that the text's end cuts
        return np.array([np.bincount(owner[order], weights=p, minlength=len(sequences)) for p in phrases])


@functools.lru_cache(maxsize=2)
def _parser(texts: tuple[tuple[str, tuple[str, ...]], ...]) -> Parser:
    return Parser(texts)


def _usable(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))


def common(docs: DataFrame, share: float) -> tuple[str, ...]:
    """The languages of at least `share` of the rows with text and lang that are not held out, in order: 1 / share at most."""
    counts = _usable(docs).where("lang is not null").groupBy("lang").count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    return tuple(sorted(r["lang"] for r in counts.where(F.col("count") >= share * total).collect()))


def learn(docs: DataFrame, chars: int = 20_000, most: int = 200, most_labels: int = 2000) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """For each lang value, sample texts of about `chars` characters in all, from a sample of about `most` documents.

    Only rows with text and lang that are not held out count; whole texts are taken, in order of hash, while they fit
    (the shortest, if none does). The driver gets at most that: (lang, texts) in order of lang. A worker holds about
    25 bytes for each character. Of the labels, the `most_labels` with the most such rows are learned; no other is predicted.
    """
    small_batches(docs.sparkSession)
    sample = per_class(_usable(docs), "lang", most, most_labels).select("doc_id", "lang", F.char_length("text").alias("n"), F.xxhash64("doc_id", "text").alias("h")).distinct()
    rows = sorted(sample.collect(), key=lambda r: (r["lang"], r["h"]))
    picked: list[tuple] = []
    room: dict[str, int] = {}
    for r in rows:
        if r["n"] <= room.setdefault(r["lang"], chars):
            room[r["lang"]] -= r["n"]
            picked.append((r["lang"], r["h"]))
    for lang in room.keys() - {k for k, _ in picked}:
        picked.append((lang, min((r["n"], r["h"]) for r in rows if r["lang"] == lang)[1]))
    if not picked:
        return ()
    ids = docs.sparkSession.createDataFrame(picked, "l string, h bigint")
    texts = docs.select("doc_id", "text", "lang").join(F.broadcast(ids), F.expr("lang = l and xxhash64(doc_id, text) = h"), "left_semi")
    found = sorted((r["lang"], r["text"]) for r in texts.select("lang", "text").distinct().collect())
    return tuple((k, tuple(t for lang, t in found if lang == k)) for k in sorted(room))


def predict(text: Column, model: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    """A struct of lang_pred, score and rate (bits for each symbol under the winner).

    score is the winner's share of two to the power of minus four times the rates, so 1 / languages to 1. A text that is
    null or has no letter, or any text without a learned language, is UNDETERMINED with score and rate 0. Ties go to the first language.
    """

    @arrow_udf("struct<lang_pred: string, score: double, rate: double>")
    def language(texts: pa.Array) -> pa.Array:
        parser = _parser(model)
        _, letter = _letters()
        langs: list[str] = []
        scores, best = [np.zeros(0)], [np.zeros(0)]
        for part in chunks(texts, PARSE_BYTES):
            strings = [t or "" for t in part.to_pylist()]
            known = np.array([bool(model) and bool(letter[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)].any()) for t in strings])
            rates = parser.rates(strings) if model else np.zeros((len(strings), 1))
            winner, least = rates.argmin(axis=1), rates.min(axis=1)
            langs += [parser.languages[w] if k else UNDETERMINED for w, k in zip(winner, known)]
            scores.append(np.where(known, 1 / np.exp2(-4 * (rates - least[:, None])).sum(axis=1), 0.0))
            best.append(np.where(known, least, 0.0))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(scores)), pa.array(np.concatenate(best))], ["lang_pred", "score", "rate"])

    return language(text)


def identify(docs: DataFrame, chars: int = 20_000, most: int = 200) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rate) for each row of `docs` (doc_id, text, lang), learning from the rows not held out.

    A null doc_id is not held out, texts of any length are parsed whole. Repeated rows stay, other columns are ignored, an
    empty table gives an empty one.
    """
    model = learn(docs, chars, most)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(F.col("text"), model).alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rate")
