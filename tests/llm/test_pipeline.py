"""Every stage on what its predecessor kept, against a plain version."""

import hashlib
import re

import pytest
from test_similar import roots

import corpus_pipeline
from quillspark.llm import decontaminate, quality, vocab

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        out.append(docs.collect())
    return out, corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_quality(spark, stages):
    (docs, good, *_), _ = stages
    table = spark.createDataFrame(docs)
    model = quality.train(table, spark.read.parquet(f"{SF}/labels.parquet"))
    scored = {r.doc_id: r.predicted for r in quality.score(table, model).collect()}
    assert ids(good) == sorted(i for i, p in scored.items() if p) and len(good) < len(docs)


def test_exact(stages):
    (_, good, exact, *_), _ = stages
    groups = {}
    for r in good:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text), []).append(r)
    assert ids(exact) == sorted(min(g, key=lambda r: (-len(r.text), r.doc_id)).doc_id for g in groups.values())


def test_near(stages):
    (_, _, exact, near, _), _ = stages
    assert ids(near) == sorted(set(roots([(r.doc_id, r.text) for r in sorted(exact, key=lambda r: r.doc_id)]).values()))


def test_benchmark(spark, stages):
    (*_, near, clean), _ = stages
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert ids(clean) == sorted(r.doc_id for r in near if not decontaminate.brute_force(r.text, items)[1])


def test_encode(stages):
    from tokenizers import Tokenizer

    (*_, clean), coded = stages
    t = Tokenizer.from_file(vocab.path_of(vocab.BYTE_BPE_JSON))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for r in clean:
        own = t.encode(r.text, add_special_tokens=False).ids
        want.add((r.doc_id, len(own), sha(",".join(map(str, own))), sha(t.decode(own, skip_special_tokens=False))))
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in coded} == want


def test_odd_rows(spark):
    """Nulls in any column, null and repeated ids, repeated rows, a long text, other columns with clashing names, and no rows."""
    good = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1"), "doc_id").orderBy("doc_id").limit(4).collect()]
    rows = [(None, good[0], None, "en"), (None, good[1], "x", None), (7, good[2], "x", "en"), (7, good[3], "x", "en"), (7, good[2], "x", "en"), (9, " ".join(good) * 40, None, None), (3, None, None, None), (4, "", "x", "en")]
    docs = spark.createDataFrame([(i, t, k, lang, 0, k) for i, t, k, lang in rows], "doc_id long, text string, key string, lang string, n long, spans string")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    kept = quality.keep_good(docs, model)
    stages = dict(corpus_pipeline.STAGES)
    for name in ("exact", "near", "benchmark"):
        before = kept
        kept = spark.createDataFrame(stages[name](spark, kept, SF).collect(), docs.schema)
        assert kept.columns == docs.columns and set(map(tuple, kept.collect())) <= set(map(tuple, before.collect())), name
    texts = [r.text for r in kept.collect()]
    assert len(texts) == len(set(texts)) and set(good) <= set(texts)
    out = stages["encode"](spark, kept, SF).collect()
    assert len(out) == len(texts) and sum(r.doc_id is None for r in out) == 2
    for stage in stages.values():
        assert stage(spark, spark.createDataFrame([], spark.read.parquet(f"{SF}/documents.parquet").schema), SF).collect() == []
