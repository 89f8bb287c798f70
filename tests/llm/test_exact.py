import hashlib
import re

from cases import documents, frame
from quillspark.llm import exact_dedup


def test_groups(spark):
    rows = documents() + [(200, "x" * 9000 + "end", None, None, None), (201, "x" * 4500 + " " + "x" * 4500 + "end", None, None, None), (202, "x" * 9000 + "enD", None, None, None)]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(frame(spark, rows)).collect()}
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), []).append(r)
    want = set()
    for t, own in groups.items():
        best = min(own, key=lambda r: (-len(r[1] or ""), r[0]))
        want |= {(r[0], best[0], len(own), r[0] == best[0], hashlib.sha256(t.encode()).hexdigest()) for r in own}
    assert got == want
    assert {r.doc_id for r in exact_dedup.exact_dedup(frame(spark, rows)).collect()} == {x[0] for x in want if x[3]}
    assert exact_dedup.exact_groups(frame(spark, [])).collect() == []


def test_chunks_cover_text(spark):
    text = "".join(documents()[9][1].split())
    parts = frame(spark).filter("doc_id = 9").select(exact_dedup.chunks(exact_dedup.normalised(__import__("pyspark.sql.functions").sql.functions.col("text")))).first()[0]
    assert "".join(parts) == text and len(parts) > 2
    assert all(len(p) <= exact_dedup.CHUNK_MAX for p in parts) and all(len(p) >= exact_dedup.CHUNK_MIN for p in parts[:-1])


def test_null_ids(spark):
    rows = [(None, "same", None, None, None), (3, "same", None, None, None), (None, "alone", None, None, None)]
    got = {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.exact_groups(frame(spark, rows)).collect()}
    assert got == {(None, 3, False), (3, 3, True), (None, None, True)}
