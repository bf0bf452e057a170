"""Helpers shared by the training-data operators: reading tables, the shared folder, bounded Arrow chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import cut, stored  # noqa: F401
from ..sources.storage import shared_path as fresh_path  # noqa: F401

#: Text bytes that one numpy pass over an Arrow batch may hold; longer single texts pass alone.
CHUNK_BYTES = 1 << 18
#: Rows of an Arrow batch: Spark's own 10,000 whole texts take tens of MB in each worker and in the JVM beside it.
BATCH_ROWS = 2000
#: A join key with over 1 / HOT_SHARE of all rows is dealt over several tasks; fewer than HOT_SHARE keys can be so.
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Through Hadoop, so any store that Spark reads will do."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_ROWS rows, where they are still Spark's default."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(counts: DataFrame, key: str, total: int) -> DataFrame:
    """(hot_key, salts) of the keys whose `count` is over 1 / HOT_SHARE of `total`: fewer than HOT_SHARE rows at any size.

    A key gets as many salts as its share of the rows has of the shuffle's partitions.
    """
    hot = counts.where(F.col("count") * HOT_SHARE > total)
    salts = F.ceil(F.col("count") * shuffle_width(counts.sparkSession) / F.lit(max(total, 1)))
    return cut(hot.select(F.col(key).alias("hot_key"), salts.alias("salts")))


def dealt(rows: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """`rows` with a `salt`: rows of a hot key in turn over its salts, all others 0. `rows` must be stable (a cut or a table)."""
    numbered = rows.withColumn("salt", F.monotonically_increasing_id())
    marked = numbered.join(F.broadcast(hot), F.col(key) == F.col("hot_key"), "left")
    return marked.withColumn("salt", F.coalesce(F.pmod("salt", "salts"), F.lit(0))).drop("hot_key", "salts")


def copied(lookup: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """`lookup`, unique by `key`, with a `salt`: a hot key's row once for each of its salts, all others once."""
    marked = lookup.join(F.broadcast(hot), F.col(key) == F.col("hot_key"), "left")
    return marked.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("salts", F.lit(1)) - 1))).drop("hot_key", "salts")


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[pa.Array]:
    """Consecutive slices of a string array with at most `most` bytes each, or one single text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    begin = held = 0
    for i, n in enumerate(sizes):
        if i > begin and held + n > most:
            yield texts.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield texts.slice(begin)
