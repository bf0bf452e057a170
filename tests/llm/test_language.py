"""Many labels and wide alphabets: memory, and phrases as by plain search. Languages too rare to keep."""

import random
import resource
import subprocess
import sys

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from corrweave.llm import language
from corrweave.llm.language import Parser

#: First letters of four stretches of 3,000 letters each.
WIDE = (0x3400, 0x4E00, 0x6000, 0xAC00)


def many_languages():
    rng = random.Random(5)
    found = []
    for n in range(296):
        words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(1, 8))) for _ in range(300)]
        found.append((f"narrow{n:03}", (" ".join(rng.choices(words, k=700)),)))
    for n, first in enumerate(WIDE):
        found.append((f"wide{n}", ("".join(chr(first + int(min(2999, rng.expovariate(1 / 600)))) for _ in range(20_000)),)))
    return tuple(found)


def plain_phrases(parser, source, text):
    """Greedy longest matches by search in the sample text."""
    said, own, i = 0, parser.symbols(source).tobytes(), 0
    symbols = parser.symbols(text)
    places = lambda a: next((k for k in range(0, len(own), 4) if own.startswith(a, k)), -1)
    while i < len(symbols):
        j = i + 1
        while j <= len(symbols) and 0 not in symbols[i:j] and places(symbols[i:j].tobytes()) >= 0:
            j += 1
        said, i = said + 1, max(i + 1, j - 1)
    return said


def hold_many():
    model = many_languages()
    parser = Parser(model)
    texts = [t[0][n : n + 400] for n, (_, t) in enumerate(model)] + ["", "Ω nothing of it 一 가"]
    rates = parser.rates(texts)
    assert [int(r.argmin()) for r in rates[:-2]] == list(range(len(model)))
    for k in (0, 150, 296, 299):
        for i in (0, 150, 296, 299, 301):
            short = texts[i][:60]
            want = plain_phrases(parser, model[k][1][0], short) * parser.bits[k] / len(parser.symbols(short))
            assert np.isclose(parser.rates([short])[0, k], want, rtol=1e-12), (k, i)
    print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)


def test_many_labels_and_letters_in_little_memory():
    out = subprocess.run([sys.executable, "-c", "from tests.llm.test_language import hold_many; hold_many()"], capture_output=True, text=True, check=False)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout.split()[-1]) < 500


def test_all_labels_are_learned(spark):
    rows = [(i, f"{chr(0x4E00 + i % 300) * 3} {chr(0x5F00 + i % 300)}", f"l{i % 300:03}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.learn(docs)
    assert [k for k, _ in model] == [f"l{i:03}" for i in range(300)]
    few = language.learn(docs.where("doc_id < 2990"), most_labels=7)
    assert len(few) == 7


def test_rare_language_is_dropped(spark, tiny):
    common = {"xx": "the one and only text of letters that many write", "yy": "ganz andere worte schreibt hier jemand nieder"}
    rows = [(i, f"{common[k]} {chr(97 + i % 26)}", k) for i in range(1000) for k in [("xx", "yy")[i % 2]]]
    rows += [(5000 + i, "перо и бумага лежат на столе", "zz") for i in range(6)]
    rows += [(6000, "бумага лежат", None), (6001, "the one and only", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("source", F.lit("s"))
    assert language.common(docs, corpus_pipeline.LANGUAGE_SHARE) == ("xx", "yy")
    kept = {r.doc_id for r in corpus_pipeline.language_stage(spark, docs, tiny).collect()}
    assert kept == set(range(1000)) | {6001}
