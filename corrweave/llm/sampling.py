"""Bounded, repeatable samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """True for the third of the documents from which nothing is learned."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def label_counts(rows: DataFrame, label: str, most_labels: int = 2000) -> dict:
    """Rows of each label, of the `most_labels` with the most rows: a dirty column bounds neither the driver nor the model."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).count().orderBy(F.desc("count"), label).limit(most_labels)
    return {r[label]: r["count"] for r in counts.collect()}


def per_class(rows: DataFrame, label: str, most: int, most_labels: int = 2000) -> DataFrame:
    """About `most` rows of each label with the smallest hashes of doc_id (all, if fewer): no shuffle but for counts.

    Expected sizes are held, not exact ones: a label's rows pass if their hash falls under its share, which a broadcast of
    a row for each label says. Labels beyond the `most_labels` with the most rows are not learned.
    """
    counts = label_counts(rows, label, most_labels)
    kind = dict(rows.dtypes)[label]
    shares = rows.sparkSession.createDataFrame([(k, min(1.0, most / n)) for k, n in sorted(counts.items())], f"sample_label {kind}, sample_share double")
    unit = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(1 << 32)) / float(1 << 32)
    return rows.join(F.broadcast(shares), F.col(label) == F.col("sample_label")).where(unit <= F.col("sample_share")).drop("sample_label", "sample_share")
