"""Filters judge rows, not ids: null and repeated ids lose no text."""

from cases import frame
from quillspark.llm import decontaminate, exact_dedup, quality, simhash

SF = "/root/testdata/sf0.001"


def rows(*pairs):
    return [(i, t, None, None, None) for i, t in pairs]


def left(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_exact(spark):
    own = rows((None, "same"), (3, "same"), (None, "alone"), (None, "a"), (None, "b"), (5, "one"), (5, "two"), (5, "two"), (6, "o n e"))
    assert left(exact_dedup.exact_dedup(frame(spark, own))) == sorted([(None, "a"), (None, "alone"), (None, "b"), (3, "same"), (5, "two"), (6, "o n e")], key=repr)


def test_simhash(spark):
    own = rows((None, "this text here is one of a kind"), (None, "nothing like it was ever seen"), (4, "first words of a document"), (4, "quite another document with that id"), (None, "first words of a document"))
    assert left(simhash.near_dedup(frame(spark, own))) == sorted([r[:2] for r in own[:4]], key=repr)


def test_leaks(spark):
    leak = " ".join(f"w{k}" for k in range(12))
    items = spark.createDataFrame([(1, leak)], "item_id long, text string")
    own = rows((None, leak), (None, "clean"), (2, f"so {leak}"), (2, "clean too"), (None, None))
    assert left(decontaminate.decontaminate(frame(spark, own), items)) == sorted([(None, "clean"), (2, "clean too"), (None, None)], key=repr)


def test_quality(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    told = {r.predicted: r.doc_id for r in quality.score(docs, model).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    good, bad = text[told[1]], text[told[0]]
    own = rows((None, good), (None, bad), (1, bad), (1, good))
    assert left(quality.keep_good(frame(spark, own), model)) == sorted([(None, good), (1, good)], key=repr)
