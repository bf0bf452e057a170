"""Token counts through a digest cache.

Counts are stored by (content digest, tokenizer-version digest). Documents join the stored counts; only distinct
contents without one are encoded, and their counts are appended to the cache.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import copied, cut, dealt, fresh_path, hot_keys, path_exists, small_batches, stored

CACHE_SCHEMA = "digest binary, version string, n_tokens bigint"
#: Digests that are stored or have copies, up to which each executor gets them all.
BROADCAST_DIGESTS = 500_000


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops what this task has already sent: a hot content leaves each task once."""
    seen: set[bytes] = set()
    for batch in batches:
        new = []
        for digest in batch.column("digest").to_pylist():
            new.append(digest not in seen)
            seen.add(digest)
        yield batch.filter(pa.array(new, pa.bool_()))


def _encode(path: str, version: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()
    count = bpe.load(path).count
    for batch in batches:
        digests, counts = [], []
        for digest, text in zip(batch.column("digest").to_pylist(), batch.column("text")):
            if digest not in seen:
                seen.add(digest)
                digests.append(digest)
                counts.append(count(text.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([version] * len(digests), pa.string()), pa.array(counts, pa.int64())], ["digest", "version", "n_tokens"])


def stored_counts(spark, cache_path: str, version: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer version; a count that two runs both appended is there once."""
    if not path_exists(spark, cache_path):
        return spark.createDataFrame([], "digest binary, n_tokens bigint")
    every = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    return every.where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _digested(docs: DataFrame, *columns: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(*columns, F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))


def append_misses(docs: DataFrame, cache_path: str, tokenizer_path: str | None = None, most: int = BROADCAST_DIGESTS) -> None:
    """Encodes each distinct text without a stored count once, and appends the counts.

    Texts stay where they lie: a digest that is there once and not stored is encoded in place. Only texts with copies are
    sent on by digest, each once a task however often it holds it, so that no digest is hot in the shuffle. Tasks know
    which digests are stored or have copies from a broadcast of at most `most` digests; where there are more, texts that
    miss are all sent on by digest.
    """
    spark, path = docs.sparkSession, tokenizer_path or bpe.default_path()
    version = bpe.version_digest(path)
    small_batches(spark)
    texts, counts = _digested(docs), stored_counts(spark, cache_path, version).select("digest")
    found = stored(_digested(docs).groupBy("digest").count(), "digests")
    known = found.join(counts, "digest", "left_semi").select("digest", F.lit(False).alias("copies"))
    copies = found.where("count > 1").join(counts, "digest", "left_anti").select("digest", F.lit(True).alias("copies"))
    apart = stored(known.unionByName(copies), "apart")
    if apart.count() <= most:
        marked = texts.join(F.broadcast(apart), "digest", "left")
        alone, shared = marked.where("copies is null"), marked.where("copies")
        alone, shared = alone.select("digest", "text"), shared.select("digest", "text")
    else:
        alone, shared = None, texts.join(counts, "digest", "left_anti")
    encode = functools.partial(_encode, path, version)
    misses = shared.mapInArrow(_first_of_each, "digest binary, text string").repartition("digest").mapInArrow(encode, CACHE_SCHEMA)
    misses = misses if alone is None else misses.unionByName(alone.mapInArrow(encode, CACHE_SCHEMA))
    misses.write.mode("append").parquet(cache_path)


def count_tokens(docs: DataFrame, cache_path: str | None = None, tokenizer_path: str | None = None, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), a row for each row of `docs` (doc_id, text).

    A null text counts as empty (0 bytes, 0 tokens), texts of any length are counted whole. Special strings inside a text
    count as the library's default has them. Rows of a hot content are dealt over several tasks of the join. Repeated rows
    stay repeated, other columns are ignored, an empty table gives an empty one. Without `cache_path` the cache starts
    empty in a fresh folder of the shared one.
    """
    tokenizer_path = tokenizer_path or bpe.default_path()
    cache_path = cache_path or fresh_path(docs.sparkSession, "token-counts")
    append_misses(docs, cache_path, tokenizer_path)
    keyed = cut(_digested(docs, "doc_id").select("doc_id", "digest", F.octet_length("text").cast("bigint").alias("n_bytes")))
    hot = hot_keys(keyed.groupBy("digest").count(), "digest", keyed.count())
    counts = stored_counts(docs.sparkSession, cache_path, bpe.version_digest(tokenizer_path))
    return dealt(keyed, "digest", hot).join(copied(counts, "digest", hot), ["digest", "salt"]).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def counted_in_parts(docs: DataFrame) -> DataFrame:
    """As `count_tokens`, with a cache that one half of the documents, by hash of the id, has filled before all are counted."""
    cache_path = fresh_path(docs.sparkSession, "token-counts")
    append_misses(docs.where(F.crc32(F.col("doc_id").cast("string")) % 2 == 0), cache_path)
    return count_tokens(docs, cache_path)
