"""Repeated byte strings by suffix sorting with bucket-pointer refinement.

Every string of ``LENGTH`` bytes is filed under its least q-gram, in a hashed order.  Successive
strings filed under one q-gram travel together, as one stretch of text, to the range of that
q-gram, where stretches are sorted by q-gram and those of one document alone are dropped.  The
suffixes of the others are sorted by bucket-pointer refinement: the initial buckets are those
of their first 8 bytes; the members of a bucket are sorted on the buckets of the suffixes a
depth further on, which gives buckets of twice the depth, and each round uses what the last one
updated.  Pointers are places in the sorted order and not hashes, so buckets are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .removal import BATCH_BYTES, DOCUMENT, RUNS, as_runs, group_starts, merged, numbered, pack_runs, part_of, runs_schema, runs_table, with_spans
from .tables import rested, stored
from .textbuf import buffers, mix, run_hashes, slices

#: Bytes of a compared string, of the q-gram it is filed under, and of an initial bucket's q-gram.
LENGTH, GRAM, FIRST = 50, 12, 8

#: Bytes of stretches whose suffixes are sorted at once.
CHUNK_BYTES = 256 << 10

#: Stretches compared at once.
STEP = 4096

_U = np.uint64
_PACKED = {"packed": np.uint8} | RUNS
_SENT = "part int, local boolean, size long, " + ", ".join(f"{c} binary" for c in _PACKED)
_NAMES = [x.split()[0] for x in _SENT.split(", ")]


def _eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes at each offset as a number."""
    n = len(data) - 7
    if n <= 0:
        return np.zeros(0, _U)
    return np.ndarray((n,), "<u8", np.ascontiguousarray(data), 0, (1,)).copy()


def _name(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """A hash of two 8-byte strings."""
    return mix(one * _U(0x9E3779B97F4A7C15) + mix(two + _U(1)))


def least_in(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` successive values, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values, have = np.minimum(values[: len(values) - step], values[step:]), have + step
    return values


def _grams(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes, 9 to 16, at each offset."""
    eights = _eights(data)
    return _name(eights[: len(eights) - gram + 8], eights[gram - 8 :])


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all bytes of the given stretches, in order."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def stretches(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Row, first byte, number of strings, least q-gram and its place of each stretch."""
    count = np.maximum(np.diff(offsets) - length + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    if not len(row):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(_U), none
    base = np.concatenate(([0], np.cumsum(count)))[:-1]
    at = np.arange(len(row)) - base[row] + offsets[row]
    grams, width = _grams(data, gram), length - gram + 1
    low = least_in(grams, width)[at]
    heads = group_starts(row, low)
    first = at[heads]
    place = np.concatenate([np.argmax(grams[first[k : k + STEP, None] + np.arange(width)] == low[heads[k : k + STEP], None], 1) for k in range(0, len(first), STEP)])
    return row[heads], first, np.diff(np.concatenate((heads, [len(row)]))), low[heads], place


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the stretches at ``a`` and ``b`` have the same bytes."""
    if not len(a):
        return np.zeros(0, bool)
    same = data[gather(a, lengths)] == data[gather(b, lengths)]
    return np.logical_and.reduceat(same, np.concatenate(([0], np.cumsum(lengths)))[:-1])


def _send(length: int, gram: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, all_offs = buffers(batch.column("text"))
            for a, b in slices(all_offs, BATCH_BYTES):
                ids, copies = (batch.column(c)[a:b].to_numpy(zero_copy_only=False).astype(np.int64) for c in DOCUMENT)
                order = np.lexsort((copies, ids))
                ids, copies = ids[order], copies[order]
                data, offs = buffers(batch.column("text")[a:b].take(pa.array(order)))
                found = []
                for i, j in slices(offs):
                    own = data[offs[i] : offs[j]]
                    row, at, n, low, place = stretches(own, offs[i : j + 1] - offs[i], length, gram)
                    name = run_hashes(own.astype(_U) + _U(1), at, at + n + length - 1) if len(at) else low
                    found.append((row + i, at + offs[i], n, low, place, name))
                row, at, n, low, place, name = (np.concatenate(x) for x in zip(*found, strict=True))
                if not len(at):
                    continue
                doc, copy, pos, size = ids[row], copies[row], at - offs[row], n + length - 1
                # What a smaller document of this batch has whole is settled here.
                by = np.argsort(name, kind="stable")
                heads = group_starts(name[by])
                head = np.repeat(by[heads], np.diff(np.concatenate((heads, [len(by)]))))
                maybe = (doc[by] != doc[head]) & (size[by] == size[head])
                by, head = by[maybe], head[maybe]
                same = np.concatenate([_equal(data, at[by[k : k + STEP]], at[head[k : k + STEP]], size[by[k : k + STEP]]) for k in range(0, len(by), STEP)] or [np.zeros(0, bool)])
                later = np.zeros(len(at), bool)
                later[by[same]] = True
                keep = np.flatnonzero(~later)
                yield from _pack(data, at[keep], (doc[keep], copy[keep], pos[keep], n[keep], place[keep]), low[keep], length, parts)
                gone = np.flatnonzero(later)
                if len(gone):
                    bucket, *arrays = pack_runs(RUNS, (doc[gone], copy[gone], pos[gone], n[gone]), parts)
                    none = pa.array([b""] * len(bucket), pa.binary())
                    yield pa.RecordBatch.from_arrays([bucket, pa.array(np.ones(len(bucket), bool)), pa.array(np.zeros(len(bucket), np.int64)), none, *arrays], _NAMES)

    return run


#: What is told of each stretch: document, first byte, number of strings, place of its least q-gram.
_TOLD = (np.int64, np.int64, np.int32, np.int32, np.uint8)


def _pack(data: np.ndarray, at: np.ndarray, told: tuple[np.ndarray, ...], low: np.ndarray, length: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Stretches by range, what is told of them and their bytes compressed together."""
    part = part_of(mix(low), parts)  # least values are small, so they are spread again
    order = np.lexsort((low, part))
    part, at = part[order], at[order]
    told = tuple(t[order].astype(k) for t, k in zip(told, _TOLD, strict=True))
    bounds = np.concatenate((group_starts(part), [len(part)]))
    rows = []
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        text = data[gather(at[s:e], told[3][s:e].astype(np.int64) + length - 1)]
        raw = b"".join((np.int64(e - s).tobytes(), *(t[s:e].tobytes() for t in told), text.tobytes()))
        rows.append((int(part[s]), len(raw), pa.compress(raw, "zstd", asbytes=True)))
    for k in range(0, len(rows), 64):
        owner, size, packed = zip(*rows[k : k + 64], strict=True)
        none = [pa.array([b""] * len(owner), pa.binary())] * len(RUNS)
        yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int32()), pa.array([False] * len(owner)), pa.array(size, pa.int64()), pa.array(packed, pa.binary()), *none], _NAMES)


def _unpack(raw: bytes) -> tuple[np.ndarray, ...]:
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for k in _TOLD:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return *out, np.frombuffer(raw, np.uint8, -1, at)


def _sorted(high: np.ndarray, low: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of pairs of numbers below ``n``, and the pairs in that order as one number each."""
    bits = n.bit_length()
    if 3 * bits > 63:
        key = high * n + low
        order = np.argsort(key)
        return order, key[order]
    # Pairs and places fit one number, and plain numbers are sorted twice as fast as their order is found.
    packed = np.sort((high << 2 * bits) | (low << bits) | np.arange(len(high)))
    return packed & ((1 << bits) - 1), packed >> bits


def buckets(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings of ``length`` bytes at ``at`` by bucket, and where buckets of equal strings begin.

    A suffix's pointer is the place of its bucket's first member in the sorted order.  Only
    members of buckets with several are sorted again.  A suffix too near the end of the data
    for a round's offset is left as it is: no string begins there, nor asks for its bucket.
    """
    eights = _eights(data)
    n = len(eights)
    order = np.argsort(eights)
    heads = group_starts(eights[order])
    size = np.diff(np.concatenate((heads, [n])))
    pointer = np.empty(n, np.int64)
    pointer[order] = np.repeat(heads, size)
    depth = FIRST
    while depth < length:
        step = min(depth, length - depth)
        mine = order[np.repeat(size > 1, size)]
        mine = mine[mine + step < n]
        by, key = _sorted(pointer[mine], pointer[mine + step], n)
        order = mine[by]
        heads = group_starts(key)
        size = np.diff(np.concatenate((heads, [len(order)])))
        old = pointer[order]
        tops = group_starts(old)
        pointer[order] = old + np.repeat(heads, size) - np.repeat(tops, np.diff(np.concatenate((tops, [len(order)]))))
        depth += step
    found = pointer[at]
    order = np.argsort(found)
    return order, group_starts(found[order])


def _shared(low: np.ndarray, doc: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the stretches ``of``: those whose q-gram several documents have, by q-gram, and where each q-gram begins."""
    order = of[np.argsort(low[of])]
    heads = group_starts(low[order])
    size = np.diff(np.concatenate((heads, [len(order)])))
    if not len(order):
        return order, np.zeros(1, np.int64)
    many = np.minimum.reduceat(doc[order], heads) != np.maximum.reduceat(doc[order], heads)
    return order[np.repeat(many, size)], np.concatenate(([0], np.cumsum(size[many])))


def _whole(data: np.ndarray, start: np.ndarray, width: np.ndarray, doc: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which of the stretches ``of`` a smaller document has whole: equal hashes, then equal bytes."""
    names = [np.zeros(0, _U)]
    for s, e in slices(np.concatenate(([0], np.cumsum(width[of]))), CHUNK_BYTES):
        mine = of[s:e]
        ends = np.cumsum(width[mine])
        names.append(run_hashes(data[gather(start[mine], width[mine])].astype(_U) + _U(1), ends - width[mine], ends))
    name = np.concatenate(names)
    by = np.lexsort((doc[of], width[of], name))
    heads = group_starts(name[by], width[of][by])
    head = np.repeat(by[heads], np.diff(np.concatenate((heads, [len(by)]))))
    maybe = doc[of[by]] != doc[of[head]]
    by, head = of[by[maybe]], of[head[maybe]]
    same = [_equal(data, start[by[k : k + STEP]], start[head[k : k + STEP]], width[by[k : k + STEP]]) for k in range(0, len(by), STEP)]
    return by[np.concatenate([np.zeros(0, bool), *same])]


def _settle(length: int, gram: int, parts: int):
    def run(table: pa.Table) -> pa.Table:
        local = table.column("local").combine_chunks()
        own, rest = table.filter(local).combine_chunks(), table.filter(pa.compute.invert(local))
        settled = [[own.column(c).chunk(0) for c in ("part", *RUNS)]] if own.num_rows else []
        kept = [
            _unpack(pa.decompress(packed.as_buffer(), size, "zstd", asbytes=True))
            for packed, size in zip((x for c in rest.column("packed").chunks for x in c), rest.column("size").to_pylist(), strict=True)
        ]
        if not kept:
            return runs_table(RUNS, *settled)
        doc, copy, pos, n, place, data = (np.concatenate(x) for x in zip(*kept, strict=True))
        del kept
        pos, n = pos.astype(np.int64), n.astype(np.int64)
        width = n + length - 1
        start = np.cumsum(width) - width
        eights = np.ndarray((max(len(data) - 7, 0),), "<u8", data, 0, (1,))
        low = _name(eights[start + place], eights[start + place + gram - 8])
        order, _ = _shared(low, doc, np.arange(len(low)))
        whole = _whole(data, start, width, doc, order)
        gone_runs = [(doc[whole], copy[whole], pos[whole], n[whole])]
        left = np.ones(len(low), bool)
        left[whole] = False
        # What has gone whole takes nothing from others that its smaller double does not take too.
        order, heads = _shared(low, doc, order[left[order]])
        reach = np.concatenate(([0], np.cumsum(width[order])))[heads]
        for s, e in slices(reach, CHUNK_BYTES):
            mine = order[heads[s] : heads[e]]
            text = data[gather(start[mine], width[mine])]
            at = gather(np.cumsum(width[mine]) - width[mine], n[mine])
            item = np.repeat(np.arange(len(mine)), n[mine])
            by, top = buckets(text, at, length)
            owner = doc[mine][item]
            count = np.diff(np.concatenate((top, [len(by)])))
            gone = np.zeros(len(at), bool)
            gone[by] = owner[by] > np.repeat(np.minimum.reduceat(owner[by], top), count)
            out = np.flatnonzero(gone)
            if len(out):
                first = np.concatenate(([0], np.cumsum(n[mine])))[:-1]
                spot = pos[mine][item[out]] + out - first[item[out]]
                begin, length_of, (d, c) = as_runs(spot, owner[out], copy[mine][item[out]])
                gone_runs.append((d, c, begin, length_of))
        every = [np.concatenate(x) for x in zip(*gone_runs, strict=True)]
        if len(every[0]):
            settled.append(pack_runs(RUNS, every, parts))
        return runs_table(RUNS, *settled)

    return run


def repeated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The columns of ``removal.MERGED`` of what a smaller document has too; spans are pairs of first and last + 1 byte."""
    rows, parts, _ = numbered(docs, id_col, text)
    sent = rows.mapInArrow(rested(_send(length, gram, parts)), _SENT)
    return stored(merged(sent.groupBy("part").applyInArrow(rested(_settle(length, gram, parts)), runs_schema(RUNS)), length, RUNS), "suffix-found")[0]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, removed, pieces, kept = [], [], [], []
        spans_col = batch.column("spans")
        for k, text in enumerate(batch.column("text")):
            raw = (text.as_py() or "").encode()
            n.append(len(raw))
            gone = cut = 0
            if spans_col[k].is_valid:
                left, at = [], 0
                for s, e in np.frombuffer(spans_col[k].as_py(), np.int32).reshape(-1, 2).tolist():
                    left.append(raw[at:s])
                    gone, cut, at = gone + e - s, cut + 1, e
                raw = b"".join(left) + raw[at:]
            removed.append(gone)
            pieces.append(cut)
            kept.append(raw)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(pieces, pa.int64()), spans_col, pa.array(kept, pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"],
        )


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (null: nothing goes) and kept bytes.

    Null texts are empty.  Texts shorter than ``length`` bytes stay whole.  Rows with a null id
    stay whole and take nothing from others.  Rows that share an id take nothing from each
    other; each loses what a smaller id has of its own text.  What is kept may begin or end
    inside a character.
    """
    kind = dict(docs.dtypes)[id_col]
    both = with_spans(docs, id_col, text, repeated(docs, id_col, text, length), "suffix-spans")
    return both.mapInArrow(rested(_cut), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, spans binary, kept binary")
