import random
import re

import numpy as np

import corpus_pipeline
from cases import frame
from quillspark.llm import simhash, similar


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def roots(rows):
    """Smallest id of each row's component, every pair compared."""
    own = {i: shingles(t) for i, t in rows}
    up = {i: i for i in own}
    find = lambda i: i if up[i] == i else find(up[i])
    for i in own:
        for j in own:
            if i < j and len(own[i] & own[j]) * 5 >= 4 * len(own[i] | own[j]) and find(i) != find(j):
                up[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in up}


def edited(seed, n, edits):
    rng = random.Random(seed)
    words = [f"w{rng.randrange(9999)}" for _ in range(n)]
    for k in rng.sample(range(n), edits):
        words[k] = f"x{rng.randrange(9999)}"
    return " ".join(words)


def test_pipeline_stage(spark):
    # Edits that leave similarities on both sides of 0.8.
    texts = [edited(k, n, e) for k in range(40) for n in (60, 300) for e in (0, n // 100 + 1, n // 40 + 1, n // 20)] + [None, "", " ", "One two", "one  TWO", "one three"]
    rows = [(k, t, None, None, None) for k, t in enumerate(texts)]
    want = roots([r[:2] for r in rows])
    assert 46 < len(set(want.values())) < len(rows) - 46
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, frame(spark, rows), "").collect()}
    assert got == set(want.values())
    assert corpus_pipeline.drop_near_copies(spark, frame(spark, []), "").collect() == []


def test_null_and_repeated_ids(spark):
    a, b, c = (edited(k, 50, 0) for k in range(3))
    rows = [(None, a, None, None, None), (None, b, None, None, None), (7, c, None, None, None), (7, edited(9, 50, 0), None, None, None), (3, b + " more", None, None, None), (7, c, None, None, None)]
    got = sorted(((r.doc_id, r.text) for r in simhash.near_dedup(frame(spark, rows), shingle=5, similarity=(4, 5)).collect()), key=repr)
    assert got == sorted(((r[0], r[1]) for r in rows[:1] + rows[2:5]), key=repr)


def test_linked_chains():
    base = np.arange(100, dtype=np.uint64)
    sets = [base, base + np.uint64(8), base + np.uint64(16), base + np.uint64(1000), np.zeros(0, np.uint64)]
    assert sorted(similar.linked([5, 9, 7, 1, 2], sets)) == [(7, 5), (9, 5)]


def test_blocks(spark):
    """Components cut into blocks of a few sets have the same members."""
    texts = [edited(k, n, e) for k in range(6) for n in (60, 300) for e in (0, n // 100 + 1, n // 40 + 1, n // 20)] * 2
    # One group that meets as a whole: a chain of texts that each differ a little from the last.
    words = [f"w{k}" for k in range(400)]
    texts += [" ".join(words[k : k + 250]) for k in range(0, 150, 5)]
    rows = [(k, t, None, None, None) for k, t in enumerate(texts)]
    want = roots([r[:2] for r in rows])
    for block in (similar.BLOCK_BYTES, 9000):
        got = similar.near_components(frame(spark, rows), block_bytes=block).collect()
        by = {}
        for r in got:
            by.setdefault(r.component, set()).add(r["__row"].id)
        assert {min(g): g for g in by.values()} == {i: {k for k, r in want.items() if r == i} for i in set(want.values())}


def test_fingerprints():
    texts = ["a b c d e f g", "", "one", "A b  c d e f g", "x y z " * 50]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    hashes, at = similar.shingle_hashes(data, offs)
    assert similar.fingerprints_of(hashes, at).tolist() == [simhash.fingerprint_of(hashes[i:j].tolist()) for i, j in zip(at[:-1], at[1:], strict=True)]
    assert len(set(similar.fingerprints_of(hashes, at).tolist())) == 4
