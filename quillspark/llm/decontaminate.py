"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item is cut into windows.  A window can lie in a document only if each of its
shingles does, so its rarest shingle (the prefix) is enough to look for: shingles are ordered
by their count over the whole corpus and each window is filed under its rarest one, with the
shingle's place in the window.  Documents' shingles that may be a prefix are joined with that
table; a match must leave room for the whole window inside the document (length and positional
bounds), and what is left is compared word by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import KEY, broadcast_measured, hold_batches, join_rows, keyed, rested, stored
from .textbuf import buffers, gap_table, run_hashes, slices, spans, word_hashes

#: Lower-cases A-Z and turns every separator into a space.
_FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_FOLD_TABLE = np.frombuffer(_FOLD, np.uint8)
_GAPS = gap_table(bytes(b for b in range(256) if b != 0x20))

#: Words of a window and of a shingle.
WINDOW, SHINGLE = 10, 5

#: Bits, as a power of two, of the largest bitmap of shingles that is sent to the tasks.
MOST_BITS = 27


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def _item_windows(window: int, shingle: int):
    """item, words of each window, words of a shingle and the hashes of its shingles by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, windows, widths, hashes = [], [], [], []
            for name, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = _words(text)
                if not words:
                    continue
                raw = b" ".join(words)
                data, offs = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
                starts, ends, _ = spans(data, offs, _GAPS)
                n, w = min(window, len(words)), min(shingle, window, len(words))
                at = np.arange(len(words) - w + 1)
                own = run_hashes(word_hashes(data, starts, ends), at, at + w).view(np.int64)
                for s in range(len(words) - n + 1):
                    names.append(name)
                    windows.append(b" ".join(words[s : s + n]).decode())
                    widths.append(w)
                    hashes.append(own[s : s + n - w + 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(windows, pa.string()), pa.array(widths, pa.int32()), pa.array(hashes, pa.list_(pa.int64()))], ["item", "words", "w", "shingles"]
            )

    return run


class _Bits:
    """Which hashes may be in a set: a bit for each value of their high bits.

    It has ``2 ** MOST_BITS`` bits at most, whatever the set; a false positive costs a row.
    """

    def __init__(self, shingles: DataFrame) -> None:
        n = shingles.count()
        self.bits = min(max(20, int(16 * n).bit_length()), MOST_BITS)
        spot = F.expr(f"shiftrightunsigned(shingle, {64 - self.bits})")
        rows = shingles.select("w", F.shiftright(spot, 6).alias("at"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(shingle, {64 - self.bits}) & 63 AS INT))").alias("bit"))
        found = rows.groupBy("w", "at").agg(F.bit_or("bit").alias("bit")).toArrow()  # 2 ** (bits - 6) rows at most for each of the few widths
        w, at, bit = (found.column(c).to_numpy() for c in ("w", "at", "bit"))
        self.sets = {}
        for k in np.unique(w).tolist():
            self.sets[k] = np.zeros(1 << (self.bits - 6), np.uint64)
            self.sets[k][at[w == k]] = bit[w == k].view(np.uint64)

    def hits(self, w: int, hashes: np.ndarray) -> np.ndarray:
        spot = hashes >> np.uint64(64 - self.bits)
        return np.flatnonzero(self.sets[w][(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63)) & np.uint64(1))


def _batches(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple]:
    """Batch row range, folded bytes, word spans and hashes, first word of each row."""
    for batch in batches:
        data, offs = buffers(batch.column(text))
        for a, b in slices(offs):
            own = offs[a : b + 1] - offs[a]
            raw = _FOLD_TABLE[data[offs[a] : offs[b]]]
            starts, ends, first = spans(raw, own, _GAPS)
            yield batch, a, b, raw, starts, ends, first, word_hashes(raw, starts, ends)


def _runs(first: np.ndarray, w: int, n: int) -> np.ndarray:
    """Starts of runs of ``w`` words that stay in one row."""
    at = np.arange(max(n - w + 1, 0))
    row = np.searchsorted(first, at, "right") - 1
    return at[at + w <= first[row + 1]]


def _count(bits: Broadcast):
    """w, shingle and how often it occurs in a run of texts, of the shingles that may be asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, _, starts, _, first, hashes in _batches(batches, "text"):
            for w in bits.value.sets:
                at = _runs(first, w, len(starts))
                run_h = run_hashes(hashes, at, at + w)
                found, n = np.unique(run_h[bits.value.hits(w, run_h)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), w, np.int32)), pa.array(found.view(np.int64)), pa.array(n)], ["w", "shingle", "n"])

    return run


_FOUND = "w int, shingle long, at int, before int, context string"
_FOUND_TYPE = pa.list_(pa.struct([("w", pa.int32()), ("shingle", pa.int64()), ("at", pa.int32()), ("before", pa.int32()), ("context", pa.string())]))


def _find(bits: Broadcast, window: int):
    """Row key, n_words and, of each place where a prefix may be, the words that a window there could have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, b, raw, starts, ends, first, hashes in _batches(batches, "text"):
            places, widths, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for w in bits.value.sets:
                at = _runs(first, w, len(starts))
                run_h = run_hashes(hashes, at, at + w)
                own = bits.value.hits(w, run_h)
                places.append(at[own])
                widths.append(np.full(len(own), w))
                keys.append(run_h[own])
            at, w, h = np.concatenate(places), np.concatenate(widths), np.concatenate(keys)
            order = np.argsort(at, kind="stable")
            at, w, h = at[order], w[order], h[order]
            row = np.searchsorted(first, at, "right") - 1
            low, high = np.maximum(first[row], at - window + 1), np.minimum(first[row + 1], at + window)
            text = raw.tobytes()
            context = [b" ".join(text[i:j].split()).decode() for i, j in zip(starts[low].tolist(), ends[high - 1].tolist(), strict=True)]
            found = pa.StructArray.from_arrays(
                [pa.array(w.astype(np.int32)), pa.array(h.view(np.int64)), pa.array((at - first[row]).astype(np.int32)), pa.array((at - low).astype(np.int32)), pa.array(context, pa.string())],
                fields=list(_FOUND_TYPE.value_type),
            )
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, first).astype(np.int32)), found)
            yield pa.RecordBatch.from_arrays([batch.column(KEY)[a:b], pa.array(np.diff(first).astype(np.int64)), lists], [KEY, "n_words", "found"])

    return run


def _hits(rows: DataFrame, items: DataFrame, window: int, shingle: int, item_id: str, item_text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From keyed rows with a text: key and n_words of each; key, first and last + 1 word and words of each window in it; windows and their items."""
    hold_batches(rows.sparkSession)
    sc = rows.sparkSession.sparkContext
    listed = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("None")).alias("item"), F.col(item_text).alias("text"))
    made, _ = stored(listed.mapInArrow(rested(_item_windows(window, shingle)), "item string, words string, w int, shingles array<long>"), "leaks-windows")
    windows = made.dropDuplicates(["words"]).select("words", "w", F.posexplode("shingles").alias("place", "shingle"))
    # The order of rarity: how often each shingle of a window occurs in all texts.
    every, _ = stored(windows.select("w", "shingle").distinct(), "leaks-shingles")
    told = rows.select("text").mapInArrow(rested(_count(sc.broadcast(_Bits(every)))), "w int, shingle long, n long")
    counts, _ = stored(told.join(every, ["w", "shingle"], "left_semi").groupBy("w", "shingle").agg(F.sum("n").alias("n")), "leaks-counts")
    # A window of which a shingle never occurs is not there at all; of the others the rarest shingle is the prefix.
    least = windows.join(counts, ["w", "shingle"], "left").groupBy("words", "w").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "place")).alias("p"))
    prefix, _ = stored(least.filter("p.n > 0").select("words", "w", "p.shingle", "p.place", F.size(F.split("words", " ")).alias("n")), "leaks-prefix")
    found = rows.mapInArrow(rested(_find(sc.broadcast(_Bits(prefix.select("w", "shingle"))), window)), f"{KEY} {dict(rows.dtypes)[KEY]}, n_words long, found array<struct<{_FOUND.replace(' ', ':').replace(',:', ',')}>>")
    found, _ = stored(found, "leaks-found")
    spots = found.select(KEY, "n_words", F.explode("found").alias("f")).select(KEY, "n_words", "f.*")
    met = spots.join(broadcast_measured(prefix, "leaks-sent"), ["w", "shingle"])
    start = F.col("at") - F.col("place")
    fits = (start >= 0) & (start + F.col("n") <= F.col("n_words"))
    same = F.array_join(F.slice(F.split("context", " "), F.col("before") - F.col("place") + 1, F.col("n")), " ") == F.col("words")
    hits = met.filter(fits).filter(same).select(KEY, start.alias("start"), (start + F.col("n")).alias("end"), "words")
    return found.select(KEY, "n_words"), stored(hits, "leaks-hits")[0], made.select("words", "item").distinct()


def _merged(spans: Column) -> Column:
    """Sorted intervals that touch or overlap as one."""
    one = "struct<start:int,end:int>"
    start = F.struct(F.array().cast(f"array<{one}>").alias("done"), F.lit(None).cast(one).alias("last"))

    def step(acc: Column, x: Column) -> Column:
        on = acc["last"].isNotNull() & (x["start"] <= acc["last"]["end"])
        last = F.when(on, F.struct(acc["last"]["start"].alias("start"), F.greatest(acc["last"]["end"], x["end"]).alias("end"))).otherwise(x)
        done = F.when(on | acc["last"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["last"])))
        return F.struct(done.alias("done"), last.alias("last"))

    return F.aggregate(F.sort_array(spans), start, step, lambda acc: F.concat(acc["done"], F.array(acc["last"])))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, id_col: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, hits, items of every document.

    ``hits`` holds the merged word intervals that lie in an occurrence of a window, ``items``
    the sorted ids of the items those windows belong to.

    Windows, counts and prefixes are tables, so neither the benchmark nor its shingles are held
    in one place; what is sent to the tasks is a bitmap of a bounded size.  Null texts have no
    words; an item without words has no window; a null item id is called "None"; equal item ids
    are one item.  Repeated documents each get a row.  Either table may be empty.
    """
    rows = keyed(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), "doc_id")
    words, hits, members = _hits(rows, items, window, shingle, item_id, item_text)
    spots = hits.groupBy(KEY).agg(_merged(F.collect_set(F.struct("start", "end"))).alias("hits"))
    names = hits.select(KEY, "words").distinct().join(members, "words").groupBy(KEY).agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = join_rows(words, spots.join(names, KEY), "leaks-rows", "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    n_hit = F.aggregate(F.coalesce("hits", none), F.lit(0).cast("long"), lambda n, x: n + (x["end"] - x["start"]))
    return out.select(F.col(f"{KEY}.id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.coalesce("hits", none).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def digest(found: DataFrame) -> DataFrame:
    """The summary row of each document from ``contamination``."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """Rows of ``docs`` in which no window of an item occurs, with all their columns; each by its own text."""
    rows = keyed(docs, id_col)
    _, hits, _ = _hits(rows.select(KEY, F.col(text).alias("text")), items, window, shingle, item_id, item_text)
    return join_rows(rows, hits.select(KEY).distinct(), "leaks-gone", "left_anti").drop(KEY)


def brute_force(doc: str | None, items: list[tuple[object, str | None]], window: int = WINDOW) -> tuple[int, int, list[str]]:
    """Words, words hit and items of one document, the plain way; for tests."""
    words = _words(doc)
    hit, names = set(), set()
    for name, text in items:
        own = _words(text)
        for s in range(max(len(own) - window, 0) + 1 if own else 0):
            want = own[s : s + window]
            for at in range(len(words) - len(want) + 1):
                if words[at : at + len(want)] == want:
                    hit.update(range(at, at + len(want)))
                    names.add(str(name))
    return len(words), len(hit), sorted(names)


def items_digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()
