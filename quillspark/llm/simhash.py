"""SimHash near-duplicate groups by multi-index hashing.

Fingerprints are cut into segments.  If two differ in at most ``radius`` bits, then in some
segment they differ in no more bits than that segment's share of the radius, so it is enough
to enumerate the small Hamming balls within each segment, to fetch what the table holds under
those keys and to verify the whole distance.  Verified links are thinned to a forest as they
are found, so a dense group never becomes its pairs, and components follow from a distributed
contraction of the forests.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import KEY, all_but_least, broadcast_measured, drop, hold_batches, keyed, rested, shuffle_partitions, stored
from .textbuf import WHITE, buffers, slices, spans

#: Words of a shingle, seed of its hash, bits that linked fingerprints may differ in.
SHINGLE, SEED, RADIUS = 4, 42, 4

#: Bits of the segments.  Three segments: two are searched to distance 1, one exactly.
SEGMENTS = (22, 21, 21)

#: Fingerprints under one key that are compared in one go.
TILE = 1024

#: Own fingerprints of a key in one task; a key with more is dealt to several, each with a block of them.
BLOCK = 8192

#: Links that a task holds before it thins them, and links that are thinned together between tasks.
HELD, THINNED = 1 << 19, 1 << 21

_LOWER = np.frombuffer(bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)), np.uint8)


def fingerprint_of(hashes: list[int]) -> int:
    """Bits set in over half of the hashes; 0 for none."""
    if not hashes:
        return 0
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(bits.sum(0, dtype=np.int64) * 2 > len(hashes)).tobytes(), "big")


def _fingerprints(shingle: int, seed: int):
    digest = xxhash.xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = buffers(batch.column("text"))
            out: list[int] = []
            for a, b in slices(offs):
                own = offs[a : b + 1] - offs[a]
                raw = _LOWER[data[offs[a] : offs[b]]]
                starts, ends, first = spans(raw, own, WHITE)
                # The words of all rows, one space apart, as one string of bytes.
                length = ends - starts + 1
                place = np.concatenate(([0], np.cumsum(length)))
                line = np.full(int(place[-1]), 0x20, np.uint8)
                keep = np.repeat(starts - place[:-1], length) + np.arange(place[-1])
                inside = np.ones(len(line), bool)
                inside[place[1:] - 1] = False
                line[inside] = raw[keep[inside]]
                text, begin, end = line.tobytes(), place[:-1].tolist(), (place[1:] - 1).tolist()
                for k in range(b - a):
                    i, j = int(first[k]), int(first[k + 1])
                    if j - i < shingle:
                        out.append(fingerprint_of([digest(text[begin[i] : end[j - 1]], seed)]) if j > i else 0)
                        continue
                    hashes = [digest(text[s:e], seed) for s, e in zip(begin[i : j - shingle + 1], end[i + shingle - 1 : j], strict=True)]
                    out.append(fingerprint_of(hashes))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(out, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long) of every document."""
    hold_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(rested(_fingerprints(shingle, seed)), f"doc_id {kind}, fp long")


def segment_radii(segments: tuple[int, ...], radius: int) -> list[int]:
    """Shares of the radius, by the pigeonhole rule: they sum to radius - segments + 1.

    A share of -1 means that the segment need not be searched.
    """
    base, more = divmod(radius + 1, len(segments))
    return [base + (k < more) - 1 for k in range(len(segments))]


def ball(bits: int, radius: int) -> np.ndarray:
    """Masks of at most ``radius`` bits among ``bits``."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)], np.uint64)


def _probes(segments: tuple[int, ...], radius: int, around: bool = True):
    """Rows (key, fp, own): each fingerprint under its own keys and, if asked, those around them."""
    plan, shift = [], 0
    for k, (bits, r) in enumerate(zip(segments, segment_radii(segments, radius), strict=True)):
        if r >= 0:
            plan.append((k, shift, bits, ball(bits, r if around else 0)))
        shift += bits
    step = 1 << 14

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                fp = batch.column("fp").slice(a, step).to_numpy().view(np.uint64)
                for k, at, bits, masks in plan:
                    own = (fp >> np.uint64(at)) & np.uint64((1 << bits) - 1)
                    keys = ((own[:, None] ^ masks[None, :]) | np.uint64(k << 60)).view(np.int64).ravel()
                    m = len(masks)
                    mine = np.zeros((len(fp), m), bool)
                    mine[:, 0] = True
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(fp.view(np.int64), m)), pa.array(mine.ravel())], ["key", "fp", "own"])

    return run


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components: each node that is not its component's smallest, and that one."""
    if not len(a):
        return a, b
    nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        up = root.copy()
        np.minimum.at(up, root[x], low)
        np.minimum.at(up, root[y], low)
        while not np.array_equal(up[up], up):
            up = up[up]
        if np.array_equal(up, root):
            break
        root = up
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


class _Links:
    """Links found so far, thinned whenever there are many."""

    def __init__(self) -> None:
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []
        self.n = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a.append(a)
        self.b.append(b)
        self.n += len(a)
        if self.n > HELD:
            a, b = self.take()
            self.a, self.b, self.n = [a], [b], 0  # a forest counts as nothing, or it would be thinned again at once

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        found = forest(np.concatenate([none, *self.a]), np.concatenate([none, *self.b]))
        self.a, self.b, self.n = [], [], 0
        return found


def _compare(own: np.ndarray, rest: np.ndarray, radius: int, links: _Links) -> None:
    """Links between the own fingerprints of a key and others, in tiles."""
    for a in range(0, len(own), TILE):
        mine = own[a : a + TILE]
        for b in range(0, len(rest), TILE):
            other = rest[b : b + TILE]
            x, y = np.nonzero(np.bitwise_count(mine[:, None] ^ other[None, :]) <= radius)
            one, two = mine[x].view(np.int64), other[y].view(np.int64)
            new = one != two
            links.add(one[new], two[new])


def _few(fp: np.ndarray, own: np.ndarray, starts: np.ndarray, ends: np.ndarray, radius: int, links: _Links) -> None:
    """The same for many small keys at once: their own rows times their rows, in steps of a bounded size."""
    row = np.flatnonzero(own)
    key = np.searchsorted(starts, row, "right") - 1
    row, key = row[key >= 0], key[key >= 0]
    row, key = row[row < ends[key]], key[row < ends[key]]
    width = ends[key] - starts[key]
    total = np.concatenate(([0], np.cumsum(width)))
    cut = 0
    while cut < len(row):
        to = max(int(np.searchsorted(total, total[cut] + TILE * TILE, "right")) - 1, cut + 1)
        w = width[cut:to]
        one = np.repeat(row[cut:to], w)
        two = np.arange(len(one)) - np.repeat(total[cut:to] - total[cut], w) + np.repeat(starts[key[cut:to]], w)
        near = (np.bitwise_count(fp[one] ^ fp[two]) <= radius) & (fp[one] != fp[two])
        links.add(fp[one[near]].view(np.int64), fp[two[near]].view(np.int64))
        cut = to


def _verify(radius: int):
    """Rows sorted by key and salt, own ones first -> links (a, b), thinned to forests.

    A task holds one Arrow batch, the own rows of one key and salt (a block of them) and a
    forest of what it has linked, however many rows the key has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = _Links()
        last, block = None, np.zeros(0, np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            key, salt, fp, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "salt", "fp", "own"))
            fp = fp.view(np.uint64)
            edge = np.flatnonzero((np.diff(key) != 0) | (np.diff(salt) != 0)) + 1
            starts, ends = np.concatenate(([0], edge)), np.concatenate((edge, [len(key)]))
            # The first and the last key of a batch may go on in another, so they go through the held block.
            inner = slice(1, len(starts) - 1)
            size = ends[inner] - starts[inner]
            small, large = starts[inner][size > 1][size[size > 1] <= 64], starts[inner][size > 64]
            if len(small):
                _few(fp, own, small, ends[inner][(size > 1) & (size <= 64)], radius, links)
            for s, e in [(0, ends[0]), *zip(large.tolist(), ends[inner][size > 64].tolist(), strict=True), *([(starts[-1], ends[-1])] if len(starts) > 1 else [])]:
                if (key[s], salt[s]) != last:
                    last, block = (key[s], salt[s]), np.zeros(0, np.uint64)
                mine, rest = fp[s:e][own[s:e]], fp[s:e][~own[s:e]]
                if len(mine):
                    _compare(mine, np.concatenate((block, mine)), radius, links)
                    block = np.concatenate((block, mine))
                if len(block) and len(rest):
                    _compare(block, rest, radius, links)
        a, b = links.take()
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    links = _Links()
    for batch in batches:
        links.add(batch.column("a").to_numpy(), batch.column("b").to_numpy())
    a, b = links.take()
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def links(points: DataFrame, radius: int = RADIUS, segments: tuple[int, ...] = SEGMENTS, block: int = BLOCK) -> DataFrame:
    """Links (a > b) between the distinct fingerprints ``fp``, thinned to forests.

    Their components are those of all pairs within ``radius`` bits.  A key with more than
    ``block`` own fingerprints is dealt to several tasks: each takes a share of them and meets
    all rows of the key, which it reads as a stream.
    """
    spark = points.sparkSession
    rows = "key long, fp long, own boolean"
    own = points.mapInArrow(rested(_probes(segments, radius, around=False)), rows)
    # Fewer rows than fingerprints / block.
    busy = own.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block).select("key", F.ceil(F.col("n") / block).cast("int").alias("shares"))
    probes = points.mapInArrow(rested(_probes(segments, radius)), rows).join(broadcast_measured(busy, "simhash-busy"), "key", "left")
    shares = F.coalesce("shares", F.lit(1))
    dealt = probes.select("key", "fp", "own", shares.alias("shares"), F.explode(F.sequence(F.lit(0), shares - 1)).alias("salt"))
    dealt = dealt.select("key", "salt", "fp", (F.col("own") & (F.pmod(F.xxhash64("fp"), F.col("shares")) == F.col("salt"))).alias("own"))
    met = dealt.repartition(shuffle_partitions(spark), "key", "salt").sortWithinPartitions("key", "salt", F.desc("own"))
    return met.mapInArrow(rested(_verify(radius)), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (smallest node reachable) of every node that an edge names.

    Edges are first thinned to forests, a bounded number at a time.  What those leave is
    contracted by alternating large stars and small stars; each round is two joins on node
    keys, whose skewed side Spark may split, and is written before the next.
    """
    now, path = stored(edges.select("a", "b"), "components")
    n = now.count()
    now, new = stored(now.repartition(max(1, -(-n // THINNED))).mapInArrow(rested(_thin), "a long, b long"), "components")
    drop(now.sparkSession, path)
    path = new
    # Up to THINNED edges are one forest by now, and then there is nothing to contract.
    while n > THINNED and not _stars(now):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Large star: larger neighbours go to the smallest of the closed neighbourhood.
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: smaller neighbours, and the node, go to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after, new = stored(small.select("e.a", "e.b").filter("a <> b").distinct(), "components")
        drop(now.sparkSession, path)
        now, path = after, new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one edge to a root."""
    again = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a")
    return again.unionByName(edges.join(edges.select(F.col("b").alias("a")), "a", "left_semi").select("a")).isEmpty()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, segments: tuple[int, ...] = SEGMENTS) -> DataFrame:
    """doc_id, fp, component_id of every document.

    Null and empty texts have fingerprint 0 and are linked like any other.  Repeated rows each
    get a row.  A row with a null id gets its component's smallest id; if the component has
    none, null.  Ids are integers.  An empty table gives an empty result.
    """
    marked, _ = stored(fingerprints(docs, id_col, text, shingle), "simhash-fingerprints")
    points, _ = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-points")
    roots, _ = stored(components(links(points.select("fp"), radius, segments)), "simhash-roots")
    placed = points.join(roots, points["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "rep")
    least = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    named, _ = stored(placed.join(least, "root").select("fp", "component_id"), "simhash-named")
    return marked.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, segments: tuple[int, ...] = SEGMENTS,
               similarity: tuple[int, int] | None = None) -> DataFrame:
    """Rows of ``docs`` that represent their group, with all their columns: the smallest id, null last.

    Groups chain texts whose fingerprints differ in at most ``radius`` bits; with ``similarity``,
    a fraction, texts whose shingles have at least that Jaccard similarity (see ``similar``).
    Verdicts are on rows, so rows that share an id, or have none, are judged by their own texts.
    """
    if similarity:
        from .similar import near_components

        return all_but_least(docs, near_components(docs, id_col, text, shingle, radius, segments, similarity), id_col, "near-gone")
    rows = keyed(docs, id_col).select(KEY, F.col(text).alias("text"))
    marked, _ = stored(fingerprints(rows, KEY, "text", shingle).withColumnRenamed("doc_id", KEY), "simhash-rows")
    points, _ = stored(marked.select("fp").distinct(), "simhash-points")
    roots, _ = stored(components(links(points, radius, segments)), "simhash-roots")
    placed = marked.join(roots, marked["fp"] == roots["node"], "left").select(KEY, F.coalesce("root", "fp").alias("component"))
    return all_but_least(docs, placed, id_col, "near-gone")
