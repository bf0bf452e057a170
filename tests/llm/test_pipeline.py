"""The pipeline against the same decisions made one document at a time."""

import zlib

import numpy as np

from pyspark.sql import functions as F

import corpus_pipeline
from corrweave.llm import language, pii, quality
from tests.llm.test_operators import brute_components


def test_pipeline(spark, documents, tiny):
    from tokenizers import Tokenizer

    from corrweave.llm import bpe

    lib = Tokenizer.from_file(bpe.default_path())
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    model = quality.learn(documents, spark.read.parquet(f"{tiny}/labels.parquet"))
    docs = [(i, t) for i, t in docs if (model if isinstance(model, float) else model.score(*quality.passages([t or ""]))[0]) >= corpus_pipeline.QUALITY_AT_LEAST]
    tables = {f"{i}": t for i, t in docs}
    told = spark.createDataFrame([(int(i), t) for i, t in tables.items()], "doc_id bigint, text string").join(documents.select("doc_id", "lang"), "doc_id")
    parser = language.Parser(language.learn(told))
    docs = [(i, t) for i, t in docs if any(c.isalpha() for c in t or "") and 1 / np.exp2(-4 * (x := parser.rates([t])[0]) + 4 * x.min()).sum() >= corpus_pipeline.LANGUAGE_AT_LEAST]
    groups = brute_components(docs)
    docs = [(i, t) for i, t in docs if groups[i][1] == i]
    want = {}
    for i, t in docs:
        spans, out, at, till = pii.all_spans(t, pii.base_spans(t)), [], 0, 0
        for s, k, e in spans:
            if s >= till:
                out.append(t[at:s] + f"[{pii.KINDS[k]}]")
            at = till = max(till, e)
        ids = lib.encode("".join(out) + t[at:], add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        bounds = [0, *range(first, len(ids) + 1, 1024)]
        want |= {(i, p): (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for p, (a, b) in enumerate(zip(bounds, bounds[1:]))}
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, tiny).collect()}
    assert got == want


def test_stages_over_awkward_rows(spark, nasty, tiny):
    rows = nasty.drop("fp", "component", "score")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, rows, tiny).columns == rows.columns
        assert stage(spark, rows.limit(0), tiny).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_dedup", "pii", "packing"]
    assert isinstance(language.learn(rows), tuple)
    packed = corpus_pipeline.packing_stage(spark, rows, tiny)
    assert packed.where("piece = 0").count() == rows.count()
    assert corpus_pipeline.packing_stage(spark, rows.limit(0), tiny).count() == 0


def test_languages_part_ways(spark, tiny, documents):
    german = corpus_pipeline.in_languages(documents, ("de",), 0.5)
    english = corpus_pipeline.in_languages(documents, ("en",), 0.5)
    every = corpus_pipeline.language_stage(spark, documents, tiny)
    assert german.columns == documents.columns and 0 < german.count() < every.count()
    assert german.join(english, "doc_id").count() == 0
    assert german.where("lang <> 'de'").count() <= 0.02 * german.count()
    long = documents.where("length(text) > 40 and text rlike '[a-z]'")
    assert corpus_pipeline.language_stage(spark, long, tiny).count() == long.count()


def test_dedup_loses_no_text(spark, tiny):
    """One doc_id with two texts, copies of either, rows without an id, rows that are equal throughout, clashing names."""
    a, b = "first text of all that is told here " * 9, "another one, with nothing of what the others say " * 9
    rows = [(1, a, "x"), (3, a, "x"), (3, b, "x"), (4, b, "y"), (4, b, "y"), (None, a, "x"), (None, "alone " * 30 + "without id", "x"), (7, None, None), (8, "", "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kept_id string").withColumn("hash", F.col("kept_id")).withColumn("component", F.lit(1))
    got = corpus_pipeline.near_dedup_stage(spark, df, tiny)
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, a), (3, b), (None, rows[6][1]), (7, None)], key=str)
    repeated = spark.createDataFrame([(4, b, "y")] * 3, "doc_id bigint, text string, kept_id string")
    assert corpus_pipeline.near_dedup_stage(spark, repeated, tiny).count() == 1
