"""A text of a megabyte beside short ones: each operator reads it whole, as its values say."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from corrweave.llm import bpe, fingerprints, language, near_dedup, packing, pieces, quality, token_counts

LONG = " ".join(f"word{i % 977} and number {i}" for i in range(50_000))
SHORT = "A short text of few words."


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, LONG, "en"), (2, LONG + " end", "en"), (3, SHORT, "en"), (4, "Ein kurzer deutscher Satz mit Wörtern.", "de")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string").cache()


def test_lengths(docs):
    assert len(LONG) > 1_000_000


def test_tokens_and_pieces(docs):
    n = {i: bpe.load(bpe.default_path()).count(t) for i, t in ((1, LONG), (3, SHORT))}
    got = {r.doc_id: r for r in token_counts.count_tokens(docs).collect()}
    assert (got[1].n_tokens, got[1].n_bytes, got[1].over_limit, got[3].n_tokens, got[3].over_limit) == (n[1], len(LONG), True, n[3], False)
    pieces_of = packing.pack(docs).where("doc_id = 1").orderBy("piece").collect()
    assert sum(p.length for p in pieces_of) == n[1] + 1 and all(p.length == 1024 for p in pieces_of[1:])
    assert [p.start for p in pieces_of] == np.concatenate(([0], np.cumsum([p.length for p in pieces_of])[:-1])).tolist()


def test_sentence_pieces(docs):
    got = {r.doc_id: r for r in pieces.encoded_digests(docs).collect()}
    ids = pieces.load(pieces.default_path()).encode(LONG)
    assert got[1].n_tokens == len(ids) and got[1].round_trip and got[1].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_fingerprints(docs):
    got = {r.doc_id: r for r in fingerprints.edited_likeness(docs).collect()}
    assert got[1].n_chars == len(LONG) and got[1].near_next == 1 - bin(int(got[1].fingerprint, 16) ^ int(got[4].fingerprint, 16)).count("1") / 128
    assert got[1].fingerprint == fingerprints.fingerprint_array(pa.array([LONG]), fingerprints.WEIGHTS)[0]
    words = LONG.lower().split(" ")
    votes = sum((np.array([(x >> b) & 1 for b in range(64)]) for x in (xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2))), np.zeros(64, int))
    want = sum(1 << b for b in range(64) if 2 * votes[b] > len(words) - 2)
    near = {r.doc_id: r for r in near_dedup.near_duplicates(docs).collect()}
    assert near[1].fingerprint == f"{want:016x}" and near[2].component_id == near[1].component_id == 1 and near[3].component_id == 3


def test_models(spark, docs):
    more = spark.range(10, 40).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit(SHORT * 5)).otherwise(F.lit("Noch ein deutscher Satz, und ein zweiter über die Wälder.")).alias("text"), F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"))
    every = docs.unionByName(more)
    said = {r.doc_id: r for r in language.identify(every).collect()}
    assert said[1].lang_pred in ("en", "de") and 0 <= said[1].score <= 1 and said[4].lang_pred == "de"
    labels = every.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    found = {r.doc_id: r.score for r in quality.classify(every, labels).collect()}
    assert len(found) == 34 and all(0 <= s <= 1 for s in found.values())
