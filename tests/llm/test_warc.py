import hashlib

from quillspark.llm import warc

PAGES = [(1, "http://a/1", "x" * 200, "k"), (2, "http://a/2", "x" * 200, "k"), (3, None, None, None), (4, "http://b\r\n/", "short", None), (5, "u", "short", None),
         (6, "http://c", "é\r\n\r\nWARC/1.1\r\n" * 30, None), (9, "http://d", "é\r\n\r\nWARC/1.1\r\n" * 30, None), (7, "v", "y" * 50_000, None), (2, "http://a/2", "x" * 200, "k")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, kind string").repartition(3)


def test_round_trip(spark):
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in warc.page_rows(warc.round_trip(frame(spark, PAGES))).collect())
    want = []
    for i, _, html, _ in PAGES:
        raw = (html or "").encode()
        first = min(p[0] for p in PAGES if p[2] == html)
        again = len(raw) >= 100 and i > first
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else 0))
    assert got == sorted(want)


def test_nested_capture(spark, tmp_path):
    warc.write_warc(frame(spark, PAGES), str(tmp_path / "w"))
    found = warc.captures(warc.read_records(spark, str(tmp_path / "w"))).collect()
    assert len(found) == len(PAGES)
    html = {str(i): h or "" for i, _, h, _ in PAGES}
    for r in found:
        assert r.response.payload == html[r.page] and r.request.record_id and r.response.head.startswith("HTTP/1.1 200")
        assert r.claimed_digest == f"sha256:{r.payload_digest}"
    assert {r.page for r in found if r.kind == "revisit"} == {"2", "9"}


def test_empty(spark):
    assert warc.page_rows(warc.round_trip(frame(spark, []))).collect() == []


def test_reader_members_and_plain():
    import gzip

    one = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    for raw in (one * 3, gzip.compress(one) * 3, gzip.compress(one * 3)):
        assert [b for _, b in warc.RecordReader(raw)] == [b"abc"] * 3


def test_null_page_and_long_payload(spark, monkeypatch):
    """A null page is a response of its own and nobody's original; a payload may be longer than a file is meant to be."""
    monkeypatch.setattr(warc, "FILE_BYTES", 5000)
    long = "é" * 300_000
    rows = [(None, "u", "z" * 300, None), (8, "u", "z" * 300, None), (None, "u", "z" * 300, None), (9, "u", "z" * 300, None), (1, "v", long, None), (2, "v", long, None), (3, "w", "", None)]
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.page_rows(warc.round_trip(frame(spark, rows))).collect()), key=repr)
    assert got == sorted([(None, 300, "response", None), (None, 300, "response", None), (8, 300, "response", None), (9, 300, "revisit", 8), (1, 600_000, "response", None), (2, 600_000, "revisit", 1), (3, 0, "response", None)], key=repr)
