import json
import random
import re

import pytest
from cases import documents, frame
from quillspark.llm import bpe, token_counts, vocab


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocab.path_of(vocab.BYTE_BPE_JSON))


def texts():
    rng = random.Random(3)
    points = [*range(0x20), *range(0x20, 0x250), 0x85, 0xA0, 0x1680, *range(0x2000, 0x2030), 0x205F, 0x3000, 0xFEFF, 0x1C, 0x1F, 0x200B, 0x180E, *range(0x3040, 0x3060), *range(0x1F600, 0x1F610), 0x0661, 0x2160, 0x00B2]
    mixed = ["".join(chr(rng.choice(points)) for _ in range(200)) for _ in range(60)]
    spaced = ["".join(rng.choice(["a", " ", "  ", "\n", "'s", "'ll", "'S", "9", "!", " ", "\x1d", "é"]) for _ in range(120)) for _ in range(60)]
    special = ["<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>x  ", "!!<|endoftext|>", "<|endoftext|", "  <|endoftext|>  \n"]
    return mixed + spaced + special


def test_round_trip(spark, tokenizer):
    rows = documents() + [(1000 + k, t, None, None, None) for k, t in enumerate(texts())]
    for limit in (bpe.TABLE_BYTES, 2000, 0):  # the whole table, a share of it, and positions alone
        got = bpe.encode(frame(spark, rows), table_bytes=limit, decoded=True).collect()
        if limit == 2000:
            coded = bpe.encode(frame(spark, rows), table_bytes=limit)
            assert sorted(map(tuple, bpe.decode(coded).collect())) == sorted(map(tuple, got))
        assert len(got) == len(rows)
        want = {r[0]: r[1] or "" for r in rows}
        for r in got:
            ids = tokenizer.encode(want[r.doc_id], add_special_tokens=False).ids
            assert r.ids == ids, repr(want[r.doc_id])
            assert r.text == tokenizer.decode(ids, skip_special_tokens=False)
    assert bpe.decode(bpe.encode(frame(spark, []))).collect() == []


def test_added_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    whole = json.loads(vocab.read(vocab.path_of(vocab.BYTE_BPE_JSON)))
    plain = whole["added_tokens"][0]
    whole["added_tokens"] += [plain | {"id": 50257, "content": "<A>"}, plain | {"id": 50258, "content": "<A>>"}, plain | {"id": 50259, "content": "b c"}]
    path = tmp_path / "more.json"
    path.write_text(json.dumps(whole))
    t = Tokenizer.from_file(str(path))
    rng = random.Random(8)
    own = ["a <A> b <B> c", "<A>>", "<A><|endoftext|>b c", "<<A>>> b  c\n", ""] + ["".join(rng.choice(["<A>", ">", "b c", " ", "x", "<|endoftext|>", "\n"]) for _ in range(30)) for _ in range(30)]
    rows = [(k, x, None, None, None) for k, x in enumerate(own)]
    for limit in (bpe.TABLE_BYTES, 0):
        got = {r.doc_id: (r.ids, r.text) for r in bpe.encode(frame(spark, rows), tokenizer=str(path), table_bytes=limit, decoded=True).collect()}
        assert got == {k: (x := t.encode(s, add_special_tokens=False).ids, t.decode(x, skip_special_tokens=False)) for k, s in enumerate(own)}
    whole["added_tokens"][0]["lstrip"] = True
    path.write_text(json.dumps(whole))
    with pytest.raises(ValueError, match="endoftext"):
        bpe.encode(frame(spark, rows), tokenizer=str(path))


def test_repeated_and_null_ids(spark, tokenizer):
    """Equal rows, one id with two texts and null ids keep their own positions, whatever the table's share."""
    own = [(None, "alpha beta gamma"), (None, "beta beta"), (4, "gamma alpha"), (4, "alpha"), (4, "alpha")]
    rows = [(i, t, None, None, None) for i, t in own]
    for limit in (bpe.TABLE_BYTES, 60, 0):
        got = sorted(((r.doc_id, r.ids) for r in bpe.encode(frame(spark, rows), table_bytes=limit).collect()), key=repr)
        assert got == sorted(((i, tokenizer.encode(t).ids) for i, t in own), key=repr)


def test_decode_of_broken_bytes(spark, tokenizer):
    ids = [[100, 180, 200, 50256, 15496], [], [127, 128, 129, 130]]
    df = spark.createDataFrame(list(enumerate(ids)), "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(df).collect()} == {k: tokenizer.decode(x, skip_special_tokens=False) for k, x in enumerate(ids)}


def test_counts(spark):
    pieces = set(vocab.pieces_of_ranks(vocab.read(vocab.path_of(vocab.BYTE_BPE_RANKS))))
    got = token_counts.token_counts(frame(spark)).collect()
    want = {}
    for d, t, *_ in documents():
        own = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
        want[d] = (len(own), sum(token_counts.greedy(b" " + w, pieces) for w in own))
    assert len(got) == len(documents()) and {r.doc_id: (r.n_words, r.n_tokens) for r in got} == want
    assert token_counts.token_counts(frame(spark, [])).collect() == []


def test_automaton_random():
    rng = random.Random(1)
    for _ in range(300):
        pieces = {bytes(rng.choice(b"ab c") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 8))}
        machine = token_counts.Automaton(sorted(pieces))
        for _ in range(30):
            word = bytes(rng.choice(b"ab c") for _ in range(rng.randint(0, 12)))
            assert machine.count(word) == token_counts.greedy(word, pieces), (pieces, word)
