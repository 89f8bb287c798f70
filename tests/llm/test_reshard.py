import zlib
from itertools import combinations

from cases import documents, frame
from quillspark.llm import reshard


def least_bytes(old, n_new):
    """Fewest bytes moved, over every choice of the shards that get one row more."""
    total = sum(map(len, old.values()))
    share, extra = divmod(total, n_new)
    best = None
    for more in combinations(range(n_new), extra):
        cost = 0
        for i, sizes in old.items():
            keep = share + (i in more) if i < n_new else 0
            cost += sum(sorted(sizes)[: max(0, len(sizes) - keep)])
        best = cost if best is None else min(best, cost)
    return best


def test_documents(spark):
    for n_old, n_new in ((3, 5), (6, 4), (1, 7), (4, 4)):
        rows, _ = reshard.stored(reshard.sized(frame(spark), reshard.hashed_shard("doc_id", n_old)), "t")
        placed, plan = reshard.reshard(rows, n_new)
        got = placed.collect()
        assert len(got) == len(documents())
        by = {j: sorted(r.slot for r in got if r.shard == j) for j in range(n_new)}
        assert all(s == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
        old = {}
        for r in got:
            old.setdefault(r.old_shard, []).append(r.size)
        assert sum(r.size for r in got if r.shard != r.old_shard) == least_bytes(old, n_new)
        assert sum(t.last - t.first for t in plan) == sum(r.shard != r.old_shard for r in got)
        text = {r[0]: r[1] or "" for r in documents()}
        assert all(r.size == 16 + len(text[r.doc_id].encode()) and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in got)


def test_rewrite(spark, tmp_path):
    docs = frame(spark).dropDuplicates(["doc_id"])
    rows, _ = reshard.stored(reshard.sized(docs, reshard.hashed_shard("doc_id", 4)), "t")
    placed, plan = reshard.reshard(rows, 5)
    out = reshard.rewrite_affected(docs, placed, plan, str(tmp_path / "out")).collect()
    touched = {t.source for t in plan} | {t.target for t in plan}
    assert {(r.doc_id, r.shard, r.slot) for r in out} == {(r.doc_id, r.shard, r.slot) for r in placed.collect() if r.shard in touched}


def test_empty_and_null_ids(spark):
    assert reshard.shard_documents(frame(spark, []), 3, 4).collect() == []
    got = reshard.shard_documents(frame(spark, [(None, None, None, None, None), (None, "a", None, None, None)]), 3, 2).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(0, 0), (1, 0)]
