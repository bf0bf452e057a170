"""What the cache of token counts saves, and what moves for it."""

import hashlib

import pytest

from corrweave.llm import bpe, token_counts
from corrweave.llm.common import fresh_path

SCHEMA = "doc_id bigint, text string"


def rows_of(cache, spark):
    return [(bytes(r.digest), r.n_tokens) for r in spark.read.schema(token_counts.CACHE_SCHEMA).parquet(cache).collect()]


@pytest.mark.parametrize("most", [0, 500_000])
def test_only_distinct_misses_are_encoded(spark, most):
    """A first part fills the cache; of all texts only those new and distinct are appended, each once, with copies in many tasks or none."""
    texts = [None if i == 7 else "" if i in (8, 9) else "hot text" if i % 3 == 0 else f"text number {i // 2} <|endoftext|>" for i in range(200)] + ["word " * 200_000]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(7)
    count = bpe.load(bpe.default_path()).count
    want = {hashlib.sha256((t or "").encode()).digest(): count(t or "") for t in texts}
    cache = fresh_path(spark, "cache")
    first = docs.where("doc_id < 90")
    token_counts.append_misses(first, cache, most=most)
    held = rows_of(cache, spark)
    assert len(held) == len(dict(held)) == len({t or "" for t in texts[:90]})
    token_counts.append_misses(docs, cache, most=most)
    both = rows_of(cache, spark)
    assert len(both) == len(want) and dict(both) == want  # none twice: what was stored is not encoded again
    token_counts.append_misses(docs, cache, most=most)
    assert len(rows_of(cache, spark)) == len(want)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, cache).collect()}
    assert got == {i: (len((t or "").encode()), n := count(t or ""), n > 1024) for i, t in enumerate(texts)}


def test_counts_in_parts_are_the_counts(spark, nasty):
    assert sorted(map(repr, token_counts.counted_in_parts(nasty).collect())) == sorted(map(repr, token_counts.count_tokens(nasty).collect()))
    assert token_counts.counted_in_parts(nasty.limit(0)).count() == 0
