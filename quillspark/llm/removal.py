"""What the two substring operators share: telling documents apart, routing by hash, gathering removals.

Work is shuffled as packed arrays, one row for each batch of texts and hash range, so that a
window costs its few bytes and not a row.  A document is an id and, should rows share the id
but not the text, a hash of the text: those are copies of an id, judged each for itself.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import broadcast_measured, hold_batches, join_measured, rested, shuffle_partitions, stored
from .textbuf import covered, intervals

#: Text, in bytes, whose windows one reducing call holds; more text means more hash ranges.
PART_BYTES = 6 << 20

#: Text, in bytes, that a map task deduplicates at once before it sends anything.
BATCH_BYTES = 4 << 20

#: What names a document.
DOCUMENT = ("doc_id", "copy")


def numbered(docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, int, int]:
    """doc_id, copy and text of the rows of ``docs`` that have both; hash ranges; bytes of text.

    ``copy`` is 0 but for ids with several texts.
    """
    hold_batches(docs.sparkSession)
    rows = docs.filter(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    one, two = F.xxhash64("text"), F.xxhash64(F.lit(1), "text")
    told, _ = stored(
        rows.groupBy("doc_id").agg(((F.min(one) != F.max(one)) | (F.min(two) != F.max(two))).alias("several"), F.sum(F.octet_length("text")).alias("size")), "removal-documents"
    )
    size = told.agg(F.sum("size")).first()[0] or 0
    several = told.filter("several").select("doc_id", "several")
    if several.isEmpty():
        rows = rows.select("doc_id", F.lit(0).cast("long").alias("copy"), "text")
    else:
        rows = join_measured(rows, several, "doc_id", "removal-several").select("doc_id", F.when(F.col("several"), one).otherwise(0).alias("copy"), "text")
    return rows, int(max(shuffle_partitions(docs.sparkSession), -(-size // PART_BYTES))), int(size)


def with_spans(docs: DataFrame, id_col: str, text: str, spans: DataFrame, name: str) -> DataFrame:
    """doc_id, text and spans of every row of ``docs``; ``spans`` has the columns of ``MERGED``."""
    whole = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    kept = spans.select("doc_id", "copy", "spans")
    spans_of = F.when(F.col("text").isNotNull(), F.col("spans")).alias("spans")
    if kept.filter("copy <> 0").isEmpty():
        return join_measured(whole, kept.select("doc_id", "spans"), "doc_id", name).select("doc_id", "text", spans_of)
    # Of an id with several texts every copy that loses something has a hash; one that is not named loses nothing.
    named = broadcast_measured(kept.withColumnsRenamed({"doc_id": "__id", "copy": "__copy"}), name)
    fits = (F.col("doc_id").cast("long") == F.col("__id")) & ((F.col("__copy") == 0) | (F.col("__copy") == F.xxhash64("text")))
    return whole.join(named, fits, "left").select("doc_id", "text", spans_of)


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Range of a 64-bit hash, in ascending order of the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def binary_column(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Rows ``values[cuts[k]:cuts[k + 1]]`` as bytes."""
    values = np.ascontiguousarray(values)
    offsets = (np.asarray(cuts) * values.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())])


def group_starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination begins in arrays that are sorted together."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


#: Columns of packed runs of windows, and the kinds of their arrays: document, first window and number of windows ...
RUNS = {"docs": np.int64, "copies": np.int64, "starts": np.int32, "counts": np.int32}

#: ... and where the same words stand in a document with a smaller id: that document, and its first window less this one's.
SOURCED = RUNS | {"source_docs": np.int64, "source_copies": np.int64, "shifts": np.int32}


def runs_schema(kinds: dict[str, type]) -> str:
    return "bucket int, " + ", ".join(f"{c} binary" for c in kinds)


def pack_runs(kinds: dict[str, type], arrays: Sequence[np.ndarray], buckets: int) -> list[pa.Array]:
    """Runs of windows by bucket of their document: a row for each bucket, not for each document."""
    doc, copy, start = arrays[:3]
    bucket = ((doc ^ copy) % buckets).astype(np.int32)
    order = np.lexsort((start, copy, doc, bucket))
    bounds = np.concatenate((group_starts(bucket[order]), [len(order)]))
    return [pa.array(bucket[order][bounds[:-1]]), *(binary_column(a[order].astype(k), bounds) for a, k in zip(arrays, kinds.values(), strict=True))]


def runs_table(kinds: dict[str, type], *parts: list[pa.Array]) -> pa.Table:
    names = {"bucket": pa.int32()} | dict.fromkeys(kinds, pa.binary())
    return pa.table({n: pa.chunked_array([p[k] for p in parts], t) for k, (n, t) in enumerate(names.items())})


def joined(table: pa.Table, name: str, kind: type) -> np.ndarray:
    """All arrays of a binary column, one after another."""
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for c in table.column(name).chunks for x in c] or [np.zeros(0, kind)])


def run_starts(pos: np.ndarray, *same: np.ndarray) -> np.ndarray:
    """Where runs of consecutive positions begin, in which everything else stays the same."""
    new = np.ones(len(pos), bool)
    new[1:] = pos[1:] != pos[:-1] + 1
    for s in same:
        new[1:] |= s[1:] != s[:-1]
    return np.flatnonzero(new)


def as_runs(pos: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """First position and length of each run, and what stays the same in it."""
    at = run_starts(pos, *same)
    return pos[at], np.diff(np.concatenate((at, [len(pos)]))), [s[at] for s in same]


#: Columns of ``merged``; proof, where runs are sourced, has 32-bit pairs of first and number of windows and 64-bit sources.
MERGED = "doc_id long, copy long, spans binary, proof binary"


def _merge(kinds: dict[str, type], length: int):
    def run(table: pa.Table) -> pa.Table:
        found = [joined(table, c, k) for c, k in kinds.items()]
        order = np.lexsort((found[2], found[1], found[0]))
        doc, copy, start, count, *source = (f[order] for f in found)
        start, end = start.astype(np.int64), start.astype(np.int64) + count + length - 1
        heads = group_starts(doc, copy)
        # The furthest end so far within a document: documents are set apart by more than any length.
        apart = np.repeat(np.arange(len(heads)), np.diff(np.concatenate((heads, [len(doc)])))) * (int(end.max(initial=0)) + 1)
        reach = np.maximum.accumulate(end + apart) - apart
        new = np.ones(len(doc), bool)
        new[1:] = start[1:] > reach[:-1]
        new[heads] = True
        first = np.flatnonzero(new)
        last = np.concatenate((first[1:], [len(doc)])) - 1
        spans = np.stack((start[first], reach[last]), 1).astype(np.int32).ravel()
        cuts = np.concatenate((np.searchsorted(first, heads), [len(first)])) * 2
        if source:
            # Runs that go on with the same source are one.
            on = np.ones(len(doc), bool)
            on[1:] = start[1:] != start[:-1] + count[:-1]
            for s in (doc, copy, *source):
                on[1:] |= s[1:] != s[:-1]
            at = np.flatnonzero(on)
            total = np.add.reduceat(count.astype(np.int64), at) if len(at) else at
            proof = np.stack((start[at], total, source[0][at], source[1][at], start[at] + source[2][at]), 1).astype(np.int64).ravel()
            proofs = binary_column(proof, np.concatenate((np.searchsorted(at, heads), [len(at)])) * 5)
        else:
            proofs = pa.array([None] * len(heads), pa.binary())
        return pa.table({"doc_id": pa.array(doc[heads]), "copy": pa.array(copy[heads]), "spans": binary_column(spans, cuts), "proof": proofs})

    return run


def merged(runs: DataFrame, length: int, kinds: dict[str, type]) -> DataFrame:
    """Columns of ``MERGED`` for each document that loses something: maximal removed intervals as 32-bit (start, end) pairs.

    ``runs`` has the columns of ``runs_schema``; there are as many buckets as hash ranges.
    """
    return runs.groupBy("bucket").applyInArrow(rested(_merge(kinds, length)), MERGED)


def brute_force(rows: Sequence[tuple[int | None, Sequence]], length: int) -> list[np.ndarray]:
    """Marks of removed elements of each row's sequence, the plain way; for tests."""
    first: dict[tuple, int] = {}
    for d, seq in rows:
        for i in range(len(seq) - length + 1) if d is not None else ():
            key = tuple(seq[i : i + length])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, seq in rows:
        starts = [i for i in range(len(seq) - length + 1) if first[tuple(seq[i : i + length])] < d] if d is not None else []
        out.append(covered(np.array(starts, np.int64), length, len(seq)))
    return out


__all__ = [
    "BATCH_BYTES", "DOCUMENT", "MERGED", "RUNS", "SOURCED", "as_runs", "binary_column", "brute_force", "group_starts", "intervals", "joined", "merged", "numbered", "pack_runs", "part_of",
    "run_starts", "runs_schema", "runs_table", "with_spans",
]
