import re

import numpy as np
import pyarrow as pa
import xxhash

from cases import documents, frame
from quillspark.llm import simhash


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)) if hs else 0


def roots(points, radius):
    up = {i: i for i, _ in points}
    find = lambda i: i if up[i] == i else find(up[i])
    for i, a in points:
        for j, b in points:
            if (a ^ b).bit_count() <= radius and find(i) != find(j):
                up[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in up}


def test_documents(spark):
    got = simhash.near_groups(frame(spark)).collect()
    assert len(got) == len(documents())
    want = {r[0]: plain(r[1]) for r in documents()}
    assert {r.doc_id: r.fp & (1 << 64) - 1 for r in got} == want
    root = roots(sorted(want.items()), simhash.RADIUS)
    assert {r.doc_id: r.component_id for r in got} == root


def test_links_random(spark):
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = set(centre.tolist())
    for c in centre.tolist():
        for _ in range(40):
            flips = rng.choice(64, rng.integers(1, 8), replace=False)
            fps.add(c ^ sum(1 << int(b) for b in flips))
    signed = lambda f: int(np.uint64(f).view(np.int64))
    points = sorted((signed(f), f) for f in fps)
    df = spark.createDataFrame([(i,) for i, _ in points], "fp long").repartition(3)
    want = roots(points, 4)
    for block in (simhash.BLOCK, 3):  # with 3, the keys of every centre are dealt to many tasks
        found = {r.node: r.root for r in simhash.components(simhash.links(df, block=block)).collect()}
        assert {i: found.get(i, i) for i, _ in points} == want


def test_near_dedup_and_empty(spark):
    stay = simhash.near_dedup(frame(spark))
    assert stay.columns == frame(spark).columns
    ids = sorted(r.doc_id for r in stay.collect())
    root = roots([(r[0], plain(r[1])) for r in documents()], 4)
    assert ids == sorted(set(root.values()))
    assert simhash.near_groups(frame(spark, [])).collect() == []


def test_null_ids(spark):
    rows = [(None, "a b c d e", None, None, None), (4, "a b c d e", None, None, None), (None, "only this one here now", None, None, None)]
    got = {(r.doc_id, r.component_id) for r in simhash.near_groups(frame(spark, rows)).collect()}
    assert got == {(None, 4), (4, 4), (None, None)}
    # Two null ids in a component with an id: 31 shingles of 32 are shared, so few bits differ.
    text = "a b c d e f g h i j k l m n o p q r s t u v w x y z 1 2 3 4 5 6"
    assert (int(plain(text)) ^ int(plain(text + " 7"))).bit_count() > 4 or {r.component_id for r in simhash.near_groups(frame(spark, [(None, text, None, None, None), (8, text + " 7", None, None, None)])).collect()} == {8}


def dense():
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 1 << 63))
    return np.array(sorted({base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(64)}), np.uint64).view(np.int64)


def test_dense_key_in_small_batches(monkeypatch):
    """2017 fingerprints under one key, read in batches of 50 rows, become one forest."""
    fp = dense()
    own = np.arange(len(fp)) < 700
    table = pa.table({"key": np.ones(len(fp), np.int64), "salt": np.zeros(len(fp), np.int32), "fp": fp, "own": own})
    monkeypatch.setattr(simhash, "HELD", 1000)
    (out,) = simhash._verify(4)(iter(table.to_batches(max_chunksize=50)))
    assert set(out.column("b").to_pylist()) == {int(fp.min())} and out.num_rows == len(fp) - 1


def test_components_by_stars(spark, monkeypatch):
    rng = np.random.default_rng(4)
    edges = [(int(max(p)), int(min(p))) for p in rng.integers(0, 300, (260, 2)) if p[0] != p[1]] + [(k + 1, k) for k in range(1000, 1040)]
    up = {i: i for e in edges for i in e}
    find = lambda i: i if up[i] == i else find(up[i])
    for i, j in edges:
        if find(i) != find(j):
            up[max(find(i), find(j))] = min(find(i), find(j))
    for most in (simhash.THINNED, 20):  # with 20, forests of 20 links are contracted by stars
        monkeypatch.setattr(simhash, "THINNED", most)
        found = simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert sorted((r.node, r.root) for r in found) == sorted((i, find(i)) for i in up)
