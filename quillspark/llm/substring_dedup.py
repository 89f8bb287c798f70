"""Substring deduplication by Rabin-Karp hashes of every window of a fixed number of words.

Each task hashes all windows of a batch of documents with one running polynomial, settles what
repeats inside the batch, and sends the rest, packed, to the range of its hash.  There the
windows are counted: the smallest document of each hash keeps it, and every other one loses
it.  Repeated windows of a document are merged into maximal intervals.  Before anything is cut,
the words of each removed run are compared with those of the document that keeps them; should
two different runs ever share their hashes, everything is hashed anew with other numbers.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .removal import BATCH_BYTES, DOCUMENT, SOURCED, as_runs, binary_column, group_starts, joined, merged, numbered, pack_runs, part_of, runs_schema, runs_table, with_spans
from .tables import broadcast_measured, rested, stored
from .textbuf import WHITE, buffers, run_hashes, slices, spans, word_hashes

#: Words of a window.
WINDOW = 50

#: Bytes of text from which on the second hash has 32 bits and not 16, so that a second try stays unlikely.
WIDE_BYTES = 1 << 39

#: Removals found inside a batch, or windows with their documents and the high bits of their positions.
_PACKED = {c: np.uint8 for c in ("hashes", "more", "low", "seg_doc", "seg_copy", "seg_high", "seg_n")} | SOURCED
_SENT = "part int, local boolean, " + ", ".join(f"{c} binary" for c in _PACKED)
_NAMES = [x.split()[0] for x in _SENT.split(", ")]


def _batch_words(rows: pa.RecordBatch, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids in ascending order with their copies, hashes of all words and the first word of each row."""
    ids, copies = (rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in DOCUMENT)
    order = np.lexsort((copies, ids))
    data, offs = buffers(rows.column("text").take(pa.array(order)))
    hashes, first = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for a, b in slices(offs):
        own = offs[a : b + 1] - offs[a]
        raw = data[offs[a] : offs[b]]
        starts, ends, cut = spans(raw, own, WHITE)
        hashes.append(word_hashes(raw, starts, ends, seed))
        first.append(cut[1:] + first[-1][-1])
    return ids[order], copies[order], np.concatenate(hashes), np.concatenate(first)


def _windows(first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and first word of every window that lies in one row."""
    count = np.maximum(np.diff(first) - window + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    base = np.concatenate(([0], np.cumsum(count)))[:-1]
    return row, np.arange(len(row)) - base[row] + first[row]


def _by_hash(h: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by both hashes that leaves equal ones as they are, and where each group begins."""
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if np.any(same & (more[order][1:] != more[order][:-1])):
        order = np.lexsort((more, h))
    return order, group_starts(h[order], more[order])


def _send(window: int, parts: int, seed: int, wide: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offs = buffers(batch.column("text"))
            for a, b in slices(offs, BATCH_BYTES):
                ids, copies, words, first = _batch_words(batch.slice(a, b - a), seed)
                row, at = _windows(first, window)
                if not len(at):
                    continue
                h = run_hashes(words, at, at + window)
                more = (run_hashes(words, at, at + window, 1) >> np.uint64(64 - 8 * np.dtype(wide).itemsize)).astype(wide)
                doc, copy, pos = ids[row], copies[row], at - first[row]
                # Rows are in order of their id, so the first of a group has the smallest.
                order, heads = _by_hash(h, more)
                size = np.diff(np.concatenate((heads, [len(order)])))
                head = np.empty(len(order), np.int64)
                head[order] = np.repeat(order[heads], size)
                later = doc != doc[head]
                yield from _pack(parts, h, more, doc, copy, pos, np.flatnonzero(~later))
                gone = np.flatnonzero(later)
                if len(gone):
                    whose = head[gone]
                    start, count, (d, c, *source) = as_runs(pos[gone], doc[gone], copy[gone], doc[whose], copy[whose], pos[whose] - pos[gone])
                    bucket, *arrays = pack_runs(SOURCED, (d, c, start, count, *source), parts)
                    none = [pa.array([b""] * len(bucket), pa.binary())] * (len(_PACKED) - len(SOURCED))
                    yield pa.RecordBatch.from_arrays([bucket, pa.array(np.ones(len(bucket), bool)), *none, *arrays], _NAMES)

    return run


def _pack(parts: int, h: np.ndarray, more: np.ndarray, doc: np.ndarray, copy: np.ndarray, pos: np.ndarray, keep: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Windows by range; a segment is a document and the high bits of its positions."""
    part = part_of(h[keep], parts)
    order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
    part, keep = part[order], keep[order]
    cuts = group_starts(part)
    bounds = np.concatenate((cuts, [len(part)]))
    high = pos[keep] >> 16
    segs = group_starts(part, doc[keep], copy[keep], high)
    seg_bounds = np.searchsorted(segs, bounds)
    seg_n = np.diff(np.concatenate((segs, [len(part)]))) - 1
    n = len(cuts)
    none = [pa.array([b""] * n, pa.binary())] * len(SOURCED)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(part[cuts].astype(np.int32)), pa.array(np.zeros(n, bool)), binary_column(h[keep], bounds), binary_column(more[keep], bounds),
            binary_column((pos[keep] & 0xFFFF).astype(np.uint16), bounds), binary_column(doc[keep][segs], seg_bounds), binary_column(copy[keep][segs], seg_bounds),
            binary_column(high[segs].astype(np.uint16), seg_bounds), binary_column(seg_n.astype(np.uint16), seg_bounds), *none,
        ],
        _NAMES,
    )


def _settle(parts: int, wide: type):
    """Windows of one range that a smaller document has too, as packed runs with that document."""

    def run(table: pa.Table) -> pa.Table:
        local = table.column("local").combine_chunks()
        own = table.filter(local).combine_chunks()
        rest = table.filter(pa.compute.invert(local))
        out = [[own.column(c).chunk(0) for c in ("part", *SOURCED)]] if own.num_rows else []
        if rest.num_rows:
            h, more = joined(rest, "hashes", np.uint64), joined(rest, "more", wide)
            seg_n = joined(rest, "seg_n", np.uint16).astype(np.int64) + 1
            doc, copy = (np.repeat(joined(rest, c, np.int64), seg_n) for c in ("seg_doc", "seg_copy"))
            pos = joined(rest, "low", np.uint16) + (np.repeat(joined(rest, "seg_high", np.uint16).astype(np.int64), seg_n) << 16)
            order, heads = _by_hash(h, more)
            size = np.diff(np.concatenate((heads, [len(order)])))
            order, size = order[np.repeat(size > 1, size)], size[size > 1]
            if len(order):
                tops = np.concatenate(([0], np.cumsum(size)))[:-1]
                group = np.repeat(np.arange(len(size)), size)
                # Within a group: the smallest id, of its copies and places the first.
                order = order[np.lexsort((pos[order], copy[order], doc[order], group))]
                head = np.repeat(order[tops], size)
                gone = doc[order] != doc[head]
                order, head = order[gone], head[gone]
                if len(order):
                    arrays = doc[order], copy[order], pos[order], np.ones(len(order), np.int64), doc[head], copy[head], pos[head] - pos[order]
                    out.append(pack_runs(SOURCED, arrays, parts))
        return runs_table(SOURCED, *out)

    return run


def _proofs(window: int):
    """Removed runs: document, first word, number of words, and where the same words must stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 5) for x in batch.column("proof")]
            n = [len(r) for r in rows]
            every = np.concatenate([*rows, np.zeros((0, 5), np.int64)])
            named = [pa.array(np.repeat(batch.column(c).to_numpy(), n)) for c in DOCUMENT]
            cols = [every[:, 0].astype(np.int32), (every[:, 1] + window - 1).astype(np.int32), every[:, 2], every[:, 3], every[:, 4].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*named, *map(pa.array, cols)], [*DOCUMENT, "at", "n", "source_doc", "source_copy", "source_at"])

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest of the words of each asked run."""
    for batch in batches:
        out: list[tuple[int, int, int, int, bytes]] = []
        for doc, copy, text, asks in zip(*(batch.column(c) for c in (*DOCUMENT, "text", "asks")), strict=True):
            words = text.as_py().encode().split()
            for ask in asks.as_py():
                at, n = ask["at"], ask["n"]
                out.append((doc.as_py(), copy.as_py(), at, n, hashlib.sha256(b" ".join(words[at : at + n])).digest()))
        cols = list(zip(*out, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [*DOCUMENT, "at", "n", "digest"])


def _wrong(rows: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """Removed runs whose words are not those of the document that keeps them."""
    runs, _ = stored(
        found.select(*DOCUMENT, "proof").mapInArrow(rested(_proofs(window)), "doc_id long, copy long, at int, n int, source_doc long, source_copy long, source_at int"), "substring-runs"
    )
    source = {"doc_id": "source_doc", "copy": "source_copy", "at": "source_at", "n": "n"}
    spots = runs.select(*source).unionByName(runs.select(*(F.col(v).alias(k) for k, v in source.items()))).distinct()
    # A document is asked for each of its runs once, however many documents have them.
    asks = spots.groupBy(*DOCUMENT).agg(F.collect_list(F.struct("at", "n")).alias("asks"))
    asked = rows.join(broadcast_measured(asks, "substring-asks"), list(DOCUMENT)).select(*DOCUMENT, "text", "asks")
    told, _ = stored(asked.mapInArrow(rested(_digests), "doc_id long, copy long, at int, n int, digest binary").distinct(), "substring-digests")
    kept = told.select(*(F.col(k).alias(v) for k, v in source.items()), F.col("digest").alias("source_digest"))
    both = runs.join(told, [*DOCUMENT, "at", "n"]).join(kept, [*source.values()])
    return both.filter("digest <> source_digest")


def repeated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = 0) -> DataFrame:
    """The columns of ``removal.MERGED`` of what a smaller document has too; spans are pairs of first and last + 1 word."""
    rows, parts, size = numbered(docs, id_col, text)
    wide = np.uint16 if size < WIDE_BYTES else np.uint32
    for again in itertools.count(seed):
        sent = rows.mapInArrow(rested(_send(window, parts, again, wide)), _SENT)
        found, _ = stored(merged(sent.groupBy("part").applyInArrow(rested(_settle(parts, wide)), runs_schema(SOURCED)), window, SOURCED), "substring-found")
        if _wrong(rows, found, window).isEmpty():
            return found
    raise AssertionError


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, removed, kept = [], [], []
        spans_col = batch.column("spans")
        for k, text in enumerate(batch.column("text")):
            words = (text.as_py() or "").encode().split()
            n.append(len(words))
            gone = 0
            if spans_col[k].is_valid:
                left, at = [], 0
                for s, e in np.frombuffer(spans_col[k].as_py(), np.int32).reshape(-1, 2).tolist():
                    left += words[at:s]
                    gone += e - s
                    at = e
                words = left + words[at:]
            removed.append(gone)
            kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), spans_col, pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "spans", "kept"]
        )


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, spans (null: nothing goes) and kept (words joined by a space).

    Null texts have no words.  Texts shorter than a window stay whole.  Rows with a null id
    stay whole and take nothing from others.  Rows that share an id take nothing from each
    other; each loses what a smaller id has of its own text.  Nothing is removed that was not
    compared, by a SHA-256 digest of its words, with the words of a smaller document.
    """
    kind = dict(docs.dtypes)[id_col]
    both = with_spans(docs, id_col, text, repeated(docs, id_col, text, window), "substring-spans")
    return both.mapInArrow(rested(_cut), f"doc_id {kind}, n_words long, n_removed long, spans binary, kept string")
