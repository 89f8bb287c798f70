import random

from cases import documents, frame, prose
from quillspark.llm import decontaminate

ITEMS = [(1, prose(7, 12)), (2, "one"), (3, None), (4, ""), (5, " ".join(prose(2, 5000).split()[900:930]).upper()), (10, "One two three"), (5, "zeta zeta never here at all"), (None, prose(1, 11))]


def test_against_brute_force(spark, monkeypatch):
    items = spark.createDataFrame([(i, t, "x", "y") for i, t in ITEMS], "item_id long, text string, doc_id string, items string")
    want = {r[0]: decontaminate.brute_force(r[1], ITEMS) for r in documents()}
    for bits in (decontaminate.MOST_BITS, 7):  # with 128 bits nearly every shingle may be one of the benchmark
        monkeypatch.setattr(decontaminate, "MOST_BITS", bits)
        found = decontaminate.contamination(frame(spark), items)
        rows = found.collect()
        assert len(rows) == len(documents())
        assert {r.doc_id: (r.n_words, r.n_hit, r.items) for r in rows} == want
        assert all(sum(h.end - h.start for h in r.hits) == r.n_hit and all(x.end < y.start for x, y in zip(r.hits, r.hits[1:], strict=False)) for r in rows)
    assert any(n for _, n, _ in want.values())
    d = decontaminate.digest(found).collect()
    assert len(d) == len(documents())
    assert all(r.items_sha256 == decontaminate.items_digest(want[r.doc_id][2]) and r.contaminated == (want[r.doc_id][1] > 0) for r in d)
    kept = decontaminate.decontaminate(frame(spark), items)
    assert {r.doc_id for r in kept.collect()} == {i for i, w in want.items() if not w[1]} and kept.columns == frame(spark).columns


def test_empty(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 for r in decontaminate.contamination(frame(spark), items).collect())
    assert decontaminate.contamination(frame(spark, []), spark.createDataFrame([(1, "a b")], "item_id long, text string")).collect() == []


def test_random_windows(spark):
    """Items of every length over few words, so that windows begin anywhere and overlap."""
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice("a b c d e f".split()) for _ in range(n))
    rows = [(k, text(rng.randrange(40)), None, None, None) for k in range(60)] + [(None, text(30), None, None, None), (7, text(30), None, None, None)]
    items = [(k, text(rng.randrange(1, 7))) for k in range(20)] + [(90, rows[3][1]), (91, f"{rows[5][1]} {rows[6][1]}")]
    found = decontaminate.contamination(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), window=4, shingle=2).collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.items) for r in found)
    assert got == sorted((str(r[0]), *decontaminate.brute_force(r[1], items, 4)) for r in rows)
