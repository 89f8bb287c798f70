import re
import zlib

import numpy as np
from cases import documents, frame, prose
from quillspark.llm import quality
from quillspark.llm.textbuf import word_hashes


def labelled(n=400):
    docs, labels = [], []
    for k in range(n):
        good = k % 3 > 0
        text = prose(k, 40 + k % 50)
        docs.append((1000 + k, text if good else text.upper().replace(" ", "!! "), None, None, None))
        labels.append((1000 + k, int(good), "x"))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = labelled()
    table = spark.createDataFrame(labels, "doc_id long, quality int, text string")
    model = quality.train(frame(spark, docs), table)
    rows = docs + documents()
    got = quality.score(frame(spark, rows), model).collect()
    assert len(got) == len(rows)
    y = {d: q for d, q, _ in labels}
    held = [r for r in got if r.held_out and r.doc_id in y]
    assert len(held) > 50 and np.mean([r.predicted == y[r.doc_id] for r in held]) > 0.97
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    empty = {r.score for r in got if r.doc_id in (0, 1, 2)}
    assert len(empty) == 1
    # Labels that are held out are not learnt from.
    wrong = [(d, 1 - q if zlib.crc32(str(d).encode()) % 5 == 0 else q, x) for d, q, x in labels]
    again = quality.train(frame(spark, docs), spark.createDataFrame(wrong, "doc_id long, quality int, text string"))
    assert np.array_equal(again.vectors, model.vectors)
    good = quality.keep_good(frame(spark, docs), model)
    assert good.columns == frame(spark).columns
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in got if r.predicted and r.doc_id >= 1000}


def test_one_class_and_empty(spark):
    docs, labels = labelled(20)
    for rows in ([x for x in labels if x[1]], [], [(None, 1, None), (1001, None, None)]):
        model = quality.train(frame(spark, docs), spark.createDataFrame(rows, "doc_id long, quality int, text string"))
        assert len({r.score for r in quality.score(frame(spark, docs), model).collect()}) == 1
    assert quality.score(frame(spark, []), model).collect() == []


def test_odd_labels_and_rows(spark):
    """Conflicting, odd and null labels and repeated ids change nothing; names of columns are the caller's."""
    docs, labels = labelled(60)
    kinds = "doc_id long, quality int, text string"
    model = quality.train(frame(spark, docs), spark.createDataFrame(labels, kinds))
    more = [(1, 1, "x"), (1, 0, "x"), (2, 5, "x"), (None, 1, "x"), (3, None, "x"), (99_999, 1, "x"), labels[1]]
    again = quality.train(frame(spark, docs + [docs[1], (1, "some text", None, None, None)]), spark.createDataFrame(labels + more, kinds))
    assert np.array_equal(again.vectors, model.vectors)
    named = frame(spark, docs).selectExpr("doc_id AS key2", "text AS body", "lang AS text", "lang AS doc_id")
    assert np.array_equal(quality.train(named, spark.createDataFrame(labels, kinds), id_col="key2", text="body").vectors, model.vectors)
    # A long text is learnt from whole where it fits, and the sample ends before the limit where it does not.
    used = next(k for k, d in enumerate(docs) if zlib.crc32(str(d[0]).encode()) % 5)
    long = [(d[0], prose(1, 60_000), None, None, None) if k == used else d for k, d in enumerate(docs)]
    assert not np.array_equal(quality.train(frame(spark, long), spark.createDataFrame(labels, kinds)).vectors, model.vectors)
    few = quality._sample(frame(spark, docs), spark.createDataFrame(labels, kinds), "quality", 4000, 3000, "doc_id", "text")
    assert 0 < few.num_rows < 60 and sum(len(t.encode()) for t in few.column("text").to_pylist()) <= 3000
    scores = quality.score(frame(spark, [(1, None, None, None, None), (1, "", None, None, None), (None, prose(1, 90_000), None, None, None)]), model).collect()
    assert len(scores) == 3 and len({r.score for r in scores if r.doc_id == 1}) == 1


def test_real_labels(spark):
    """The tables of the smallest scale: rows that are held out are told apart, and a plain computation gives the same scores."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    model = quality.train(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.score, truth[i]) for i, r in got.items() if r.held_out and i in truth]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert len(held) > 50 and np.mean([(a > b) + (a == b) / 2 for a in good for b in bad]) > 0.95
    for r in docs.filter("doc_id < 40").collect():
        kind = "".join("0" if c in " \t\n\x0b\x0c\r" else "C" if "A" <= c <= "Z" else "a" if "a" <= c <= "z" or c >= "\x80" else "9" if c.isdigit() else "!" for c in r.text)
        words = [r.text[m.start() : m.end()].encode() for m in re.finditer(r"C+|a+|9+|!+", kind)]
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        slot = (word_hashes(data, ends - [len(w) for w in words], ends) % np.uint64(quality.SLOTS)).astype(int).tolist() if words else []
        filed = [quality.SLOTS - 1 if k > 0 and s == slot[k - 1] else quality.SLOTS - 2 if k > 1 and s == slot[k - 2] else s for k, s in enumerate(slot)]
        mean = np.mean([model.vectors[s].astype(float) for s in filed], axis=0) if filed else np.zeros(model.vectors.shape[1])
        net = model.network
        logit = float(np.tanh(mean + net.b1) @ net.w2 + net.b2) / net.temperature
        assert abs(got[r.doc_id].score - 1 / (1 + np.exp(-logit))) < 1e-6


def test_pooled_in_steps():
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(20, 3))
    size = [0, 5, 0, 17, 1, 0]
    first = np.concatenate(([0], np.cumsum(size)))
    slots = rng.integers(0, 20, first[-1])
    want = [vectors[slots[a:b]].mean(0) if b > a else np.zeros(3) for a, b in zip(first[:-1], first[1:], strict=True)]
    for step in (1, 4, 100):
        assert np.allclose(quality.pooled(vectors, slots, first, step), want)
