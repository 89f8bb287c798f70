import zlib

from cases import frame
from quillspark.llm import reshard


def test_files_hold_every_row(spark, monkeypatch):
    rows = [(None, f"none {k}", None, None, None) for k in range(9)] + [(7, "twice", None, None, None)] * 3 + [(7, "other", None, None, None), (None, None, None, None, None)]
    rows += [(k, f"text {k}", "en", True, "k") for k in range(20, 60)]
    written = []
    rewrite = reshard.rewrite_affected
    monkeypatch.setattr(reshard, "rewrite_affected", lambda *a: written.append((rewrite(*a), a[2])) or written[-1][0])
    got = reshard.shard_documents(frame(spark, rows), 4, 6).collect()
    size = lambda t: (16 + len(t or ""), zlib.crc32((t or "").encode()))
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sorted(((i, *size(t)) for i, t, *_ in rows), key=repr)
    for j in range(6):
        own = sorted(r.slot for r in got if r.shard == j)
        assert own == list(range(len(own))) and 9 - len(own) in (0, 1)
    (files, plan), = written
    touched = {t.source for t in plan} | {t.target for t in plan}
    want = [(r.doc_id, r.text_crc32, r.shard, r.slot) for r in got if r.shard in touched]
    held = [(r.doc_id, size(r.text)[1], r.shard, r.slot) for r in files.collect()]
    assert sorted(held, key=repr) == sorted(want, key=repr) and want
