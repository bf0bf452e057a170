"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages and only the bag is labelled. Every passage is encoded, gated attention weighs the
encodings, and the weighted sum is scored; all is fitted at once from document labels.
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

PASSAGE_WORDS = 64
#: Of a word: letters' share, capitals', digits', other signs', length, ends in a sign, all capitals, no letter.
WORD_TRAITS = 8
TRAITS = 2 * WORD_TRAITS + 4


class _WordTraits(dict):
    """Word to its row in a table of traits; forgets all at a bound, so that memory stays flat over any corpus."""

    MOST = 50_000

    def __init__(self):
        self.rows = np.zeros((self.MOST, WORD_TRAITS), np.float32)

    def __missing__(self, word: str) -> int:
        i = len(self)
        letters = sum(map(str.isalpha, word))
        capitals = sum(map(str.isupper, word))
        digits = sum(map(str.isdigit, word))
        n = len(word)
        self.rows[i] = (letters / n, capitals / n, digits / n, (n - letters - digits) / n, min(n, 64) / 8, not word[-1].isalnum(), capitals == letters > 1, letters == 0)
        self[word] = i
        return i


@functools.cache
def _word_traits() -> _WordTraits:
    return _WordTraits()


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Traits of every passage, and how many passages each text has (one, of zeros, if it has no word).

    A passage's traits: means and deviations of its words' traits, how far it is filled, its share of distinct words,
    its share of words equal to the one before, and 1 if it has words.
    """
    known = _word_traits()
    words = [t.split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    if len(known) + int(sizes.sum()) > known.MOST:
        distinct = {x for w in words for x in w}
        if len(known) + len(distinct) > known.MOST:
            known.clear()
        if len(distinct) > known.MOST:
            known.rows = np.zeros((len(distinct), WORD_TRAITS), np.float32)
    ids = np.fromiter((known[x] for w in words for x in w), np.int64, int(sizes.sum()))
    n = np.maximum(1, (sizes + PASSAGE_WORDS - 1) // PASSAGE_WORDS)
    owner = np.repeat(np.arange(len(texts)), n)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    length = np.clip(sizes[owner] - within * PASSAGE_WORDS, 0, PASSAGE_WORDS)
    out = np.zeros((len(owner), TRAITS), np.float32)
    full = np.flatnonzero(length)
    if len(full):
        starts = np.cumsum(length[full]) - length[full]
        traits, size = known.rows[ids], length[full][:, None].astype(np.float32)
        mean = np.add.reduceat(traits, starts, axis=0) / size
        out[full, :WORD_TRAITS] = mean
        out[full, WORD_TRAITS : 2 * WORD_TRAITS] = np.sqrt(np.maximum(np.add.reduceat(traits * traits, starts, axis=0) / size - mean * mean, 0))
        passage = np.repeat(np.arange(len(full)), length[full])
        distinct = np.unique(passage * len(known.rows) + ids) // len(known.rows)
        same = np.concatenate(([False], ids[1:] == ids[:-1]))
        same[starts] = False
        out[full, -4] = length[full] / PASSAGE_WORDS
        out[full, -3] = np.bincount(distinct, minlength=len(full)) / length[full]
        out[full, -2] = np.bincount(passage, weights=same, minlength=len(full)) / length[full]
        out[full, -1] = 1
    return out, n


class AttentionMil:
    """Encoder tanh(Wx+b); gated attention w.(tanh(Vh) * sigmoid(Uh)), softmax within the bag; logistic score of the sum."""

    def __init__(self, width: int = 16, gates: int = 8, seed: int = 1):
        r = np.random.default_rng(seed)
        self.shift, self.scale = np.zeros(TRAITS), np.ones(TRAITS)
        self.p = {
            "W": r.normal(0, TRAITS**-0.5, (TRAITS, width)), "b": np.zeros(width), "V": r.normal(0, width**-0.5, (width, gates)),
            "U": r.normal(0, width**-0.5, (width, gates)), "w": r.normal(0, gates**-0.5, gates), "c": r.normal(0, width**-0.5, width), "d": np.zeros(1),
        }

    def _forward(self, x: np.ndarray, n: np.ndarray) -> tuple:
        p, starts = self.p, np.cumsum(n) - n
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = (t * g) @ p["w"]
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, starts), n))
        a /= np.repeat(np.add.reduceat(a, starts), n)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return h, t, g, a, z, 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))

    def score(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self._forward((x - self.shift) / self.scale, n)[-1]

    def _gradient(self, x: np.ndarray, n: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted sum of the bags' logistic losses."""
        p, starts = self.p, np.cumsum(n) - n
        h, t, g, a, z, s = self._forward(x, n)
        e = weight * (s - y)
        ez = np.repeat(e[:, None] * p["c"], n, axis=0)
        ea = (ez * h).sum(axis=1)
        ea = a * (ea - np.repeat(np.add.reduceat(a * ea, starts), n))
        et, eg = ea[:, None] * p["w"] * g * (1 - t * t), ea[:, None] * p["w"] * t * g * (1 - g)
        eh = (a[:, None] * ez + et @ p["V"].T + eg @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ eh, "b": eh.sum(axis=0), "V": h.T @ et, "U": h.T @ eg, "w": (t * g).T @ ea, "c": z.T @ e, "d": e.sum(keepdims=True)}

    def fit(self, x: np.ndarray, n: np.ndarray, y: np.ndarray, steps: int = 250, rate: float = 0.03, decay: float = 1e-4) -> AttentionMil:
        """Adam over all bags; the two labels weigh alike."""
        self.shift, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x, p = (x - self.shift) / self.scale, self.p
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
        m, v = ({k: np.zeros_like(q) for k, q in p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            grad = self._gradient(x, n, y, weight)
            for k, q in p.items():
                d = grad[k] + decay * q
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                q -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-9)
        return self


def _encoded(most_passages: int, texts: pa.Array) -> pa.Array:
    """Each text's passages as one list of traits; null for a text of more than `most_passages`."""
    out = []
    for part in chunks(texts):
        x, n = passages([t or "" for t in part.to_pylist()])
        out += [x[e - k : e].ravel() if k <= most_passages else None for e, k in zip(np.cumsum(n), n)]
    return pa.array(out, pa.list_(pa.float32()))


def learn(docs: DataFrame, labels: DataFrame, most: int = 1500, most_passages: int = 400) -> AttentionMil | float:
    """Fits on about `most` documents of each label; the driver gets their passages' traits alone.

    Only labels of documents that are not held out count. A label given twice counts once, one that contradicts
    itself or is neither 0 nor 1 not at all; documents of over `most_passages` passages are scored but not learned from.
    With fewer than two labels the model is the mean label (0.5 without any).
    """
    small_batches(docs.sparkSession)
    usable = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1)).select("doc_id", "quality")
    sample = per_class(usable, "quality", most).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("q")).where("quality = q").select(F.col("doc_id").alias("labelled"), "quality")

    @arrow_udf("array<float>")
    def encode(texts: pa.Array) -> pa.Array:
        return _encoded(most_passages, texts)

    # At most about twice `most` ids. No condition on the traits stands in the plan: it would move below the join, and encode every document.
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.expr("doc_id = labelled")).select("doc_id", "quality", encode("text").alias("x"))
    rows = [r for r in rows.collect() if r["x"] is not None]
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    y = np.array([r["quality"] for r in rows], np.float64)
    if len(set(y)) < 2:
        return float(y.mean()) if len(y) else 0.5
    x = np.concatenate([np.array(r["x"], np.float64).reshape(-1, TRAITS) for r in rows])
    return AttentionMil().fit(x, np.array([len(r["x"]) // TRAITS for r in rows]), y)


def score(text: Column, model: AttentionMil | float) -> Column:
    """0 to 1, higher for better texts. Null and empty texts are one passage without words, and get its score."""

    @arrow_udf("double")
    def quality(texts: pa.Array) -> pa.Array:
        if isinstance(model, float):
            return pa.array([model] * len(texts), pa.float64())
        out = [np.zeros(0)]
        for part in chunks(texts):
            out.append(model.score(*passages([t or "" for t in part.to_pylist()])))
        return pa.array(np.concatenate(out))

    return quality(text)


def classify(docs: DataFrame, labels: DataFrame, most: int = 1500) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of `docs` (doc_id, text).

    predicted is 1 if score >= 0.5. A null doc_id is not held out; all passages of texts of any length are weighed. Repeated rows stay, other columns are ignored, an
    empty table gives an empty one.
    """
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), learn(docs, labels, most)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
