import re

import numpy as np
import pyarrow as pa
import pytest
from cases import documents, frame, prose
from quillspark.llm import removal, substring_dedup, suffix_dedup
from quillspark.llm.textbuf import intervals


def rows():
    more = [(300 + k, prose(9, 30 * k) + prose(20 + k, 40) + prose(9, 300), None, None, None) for k in range(6)]
    return documents() + more + [(400, prose(31, 70_000) + prose(9, 200), None, None, None)]


def of_rows(all_rows, split):
    return [(r[0], split(r[1] or "")) for r in all_rows]


def split_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def check_words(spark, all_rows, window=50):
    """Every row, repeated ones too, against every window of every row."""
    plain = of_rows(all_rows, split_words)
    want = sorted((str(d), len(w), int(g.sum()), " ".join(x for x, out in zip(w, g, strict=True) if not out)) for (d, w), g in zip(plain, removal.brute_force(plain, window), strict=True))
    got = substring_dedup.substring_dedup(frame(spark, all_rows), window=window).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == want
    return got


def check_bytes(spark, all_rows, length=50):
    plain = of_rows(all_rows, lambda t: list(t.encode()))
    want = sorted(
        (str(d), len(b), int(g.sum()), len(intervals(g)), bytes(x for x, out in zip(b, g, strict=True) if not out)) for (d, b), g in zip(plain, removal.brute_force(plain, length), strict=True)
    )
    got = suffix_dedup.suffix_dedup(frame(spark, all_rows), length=length).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == want
    return got


@pytest.mark.parametrize("window", [50, 7])
def test_words(spark, window):
    got = check_words(spark, rows(), window)
    assert sum(r.n_removed > 0 for r in got) > 5
    for r in got:
        cut = np.frombuffer(r.spans or b"", np.int32).reshape(-1, 2)
        assert (cut[:, 1] - cut[:, 0]).sum() == r.n_removed and (cut[1:, 0] > cut[:-1, 1]).all()


@pytest.mark.parametrize("length", [50, 20])
def test_bytes(spark, length):
    assert sum(r.n_removed > 0 for r in check_bytes(spark, [r for r in rows() if r[0] != 400], length)) > 5


def test_rows_that_share_an_id(spark):
    """Each text of an id is judged for itself; texts of one id take nothing from each other."""
    own, other, third = prose(3, 80), prose(4, 70), prose(5, 60)
    pairs = [(1, own), (2, own), (2, other), (2, own + " " + third), (3, third + " " + other), (3, None), (1, other), (2, other), (None, own), (5, own)]
    all_rows = [(i, t, None, None, None) for i, t in pairs]
    assert {r.n_removed > 0 for r in check_words(spark, all_rows)} == {True, False}
    assert {r.n_removed > 0 for r in check_bytes(spark, all_rows)} == {True, False}


def test_words_that_meet_under_powers(spark):
    """A word of the Thue-Morse sequence and its complement have one polynomial hash modulo 2**64, whatever the base."""
    bits = np.array([k.bit_count() & 1 for k in range(2048)])
    one, two = ("".join("ab"[b] for b in x) for x in (bits, 1 - bits))
    head = " ".join(f"w{k}" for k in range(49))
    check_words(spark, [(1, f"{head} {one}", None, None, None), (2, f"{head} {two}", None, None, None), (3, f"x {head} {one}", None, None, None)])


def test_wrong_matches_are_found(spark, monkeypatch):
    """With one hash for all windows everything meets; the comparison of words tells."""
    all_rows = [(k, prose(70 + k % 5, 55 + k), None, None, None) for k in range(12)]
    docs = removal.numbered(frame(spark, all_rows), "doc_id", "text")[0]
    with monkeypatch.context() as m:
        m.setattr(substring_dedup, "run_hashes", lambda values, starts, ends, base=0: np.full(len(starts), 5, np.uint64))
        sent = pa.Table.from_batches(list(substring_dedup._send(50, 4, 0, np.uint16)(iter(docs.coalesce(1).toArrow().to_batches()))))
    runs = pa.concat_tables([substring_dedup._settle(4, np.uint16)(sent.filter(pa.compute.equal(sent.column("part"), p))) for p in range(4)])
    found = spark.createDataFrame(removal._merge(removal.SOURCED, 50)(runs))
    assert found.count() == 11 and not substring_dedup._wrong(docs, found, 50).isEmpty()


def test_wrong_matches_are_hashed_anew(spark, monkeypatch):
    seeds, send, wrong = [], substring_dedup._send, substring_dedup._wrong
    monkeypatch.setattr(substring_dedup, "_send", lambda window, parts, seed, wide: seeds.append(seed) or send(window, parts, seed, wide))
    monkeypatch.setattr(substring_dedup, "_wrong", lambda *a: spark.range(1) if len(seeds) < 3 else wrong(*a))
    check_words(spark, [(k, prose(3, 60 + k), None, None, None) for k in range(4)])
    assert seeds == [0, 1, 2]


def test_small_pieces(spark, monkeypatch):
    """Batches, slices and chunks of a few bytes give the same rows."""
    small = [r for r in rows() if r[0] != 400]
    table = frame(spark, small).selectExpr("doc_id", "0L copy", "text").coalesce(1).toArrow().to_batches()
    plain = of_rows(small, lambda t: list(t.encode()))
    want = {d: g for (d, _), g in zip(plain, removal.brute_force(plain, 50), strict=True)}
    for module, name, value in ((suffix_dedup, "BATCH_BYTES", 3000), (suffix_dedup, "CHUNK_BYTES", 500)):
        monkeypatch.setattr(module, name, value)
    keep = [b.filter(b.column("text").is_valid()) for b in table]
    packed = pa.Table.from_batches(list(suffix_dedup._send(50, 12, 3)(iter(keep))))
    marks = {d: np.zeros(len(g), bool) for d, g in want.items()}
    for part in range(3):
        out = suffix_dedup._settle(50, 12, 3)(packed.filter(pa.compute.equal(packed.column("part"), part)))
        for d, s, n in zip(removal.joined(out, "docs", np.int64), removal.joined(out, "starts", np.int32), removal.joined(out, "counts", np.int32), strict=True):
            marks[d][s : s + n + 49] = True
    assert all(np.array_equal(marks[d], want[d]) for d in want)


def test_empty_and_null_ids(spark):
    assert substring_dedup.substring_dedup(frame(spark, [])).collect() == []
    assert suffix_dedup.suffix_dedup(frame(spark, [])).collect() == []
    text = prose(3, 80)
    null = [(None, text, None, None, None), (None, text, None, None, None), (5, text, None, None, None)]
    assert {r.n_removed for r in substring_dedup.substring_dedup(frame(spark, null)).collect()} == {0}
    assert {r.n_removed for r in suffix_dedup.suffix_dedup(frame(spark, null)).collect()} == {0}


@pytest.mark.parametrize("length", [9, 16, 17, 50])
def test_buckets(length):
    """Suffixes in buckets as sorting whole strings gives them; strings of two letters share many prefixes."""
    rng = np.random.default_rng(length)
    for data in (rng.integers(0, 2, 3000), np.tile(rng.integers(0, 250, 130), 9), np.zeros(200)):
        data = data.astype(np.uint8)
        at = rng.choice(len(data) - length + 1, min(900, len(data) - length), replace=False)
        order, heads = suffix_dedup.buckets(data, at, length)
        got = {frozenset(g.tolist()) for g in np.split(order, heads[1:])}
        want = {}
        for k, a in enumerate(at.tolist()):
            want.setdefault(data[a : a + length].tobytes(), set()).add(k)
        assert got == set(map(frozenset, want.values()))
