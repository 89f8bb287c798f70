"""Near copies: SimHash and MinHash propose them, the exact Jaccard similarity of word shingles decides.

Two texts are near copies if their sets of five-word shingles have a Jaccard similarity of at
least 0.8.  Candidates have fingerprints within a few bits, found by the multi-index search of
``simhash``, or share a band of MinHash values: at that similarity most fingerprints differ in
more bits than a search can afford, and a pair of similarity s shares a band with probability
1 - (1 - s**BAND_ROWS)**BANDS, 0.9996 at 0.8.  The texts of one candidate component are brought
together as sets of 64-bit shingle hashes, in blocks of a bounded size, and compared there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .simhash import RADIUS, SEGMENTS, components, links
from .tables import KEY, broadcast_measured, hold_batches, join_rows, keyed, rested, shuffle_partitions, stored
from .textbuf import ASCII_LOWER, WHITE, buffers, mix, run_hashes, slices, spans, word_hashes

#: Words of a shingle.
SHINGLE = 5

#: Least similarity of near copies, as a fraction.
SIMILAR = (4, 5)

#: MinHash bands, and values of each.
BANDS, BAND_ROWS = 20, 5

#: Sets that are compared with one in one go.
TILE = 1024

#: Bytes of the shingle hashes of one block of a candidate component; two blocks meet in a task.
BLOCK_BYTES = 32 << 20

_rng = np.random.default_rng(42)
_MULTIPLY = _rng.integers(0, 1 << 64, BANDS * BAND_ROWS, np.uint64) | np.uint64(1)
_FLIP = _rng.integers(0, 1 << 64, BANDS * BAND_ROWS, np.uint64)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all rows, and the first of each row.

    Letters A to Z count as a to z.  A text with fewer words is one shingle; without any, none.
    """
    raw = ASCII_LOWER[data]
    starts, ends, first = spans(raw, offsets, WHITE)
    words = np.diff(first)
    count = np.where(words >= shingle, words - shingle + 1, words > 0)
    at = np.concatenate(([0], np.cumsum(count)))
    row = np.repeat(np.arange(len(words)), count)
    begin = first[:-1][row] + np.arange(at[-1]) - at[:-1][row]
    return run_hashes(word_hashes(raw, starts, ends), begin, np.minimum(begin + shingle, first[1:][row])), at


def fingerprints_of(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 64-bit SimHash of each row's hashes: bits set in over half of them; 0 for none."""
    n = np.diff(at)
    has = np.flatnonzero(n)
    out = np.zeros(len(n), np.uint64)
    if len(has):
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        most = np.add.reduceat(bits, at[has], axis=0, dtype=np.int32) * 2 > n[has, None]
        out[has] = np.packbits(most, axis=1).view(">u8").ravel()
    return out


def _signatures(shingle: int):
    """Row key, node (a hash of the shingles with their counts), number of shingles, fingerprint and the keys of the bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = buffers(batch.column("text"))
            for a, b in slices(offs):
                hashes, at = shingle_hashes(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], shingle)
                has = np.flatnonzero(np.diff(at))
                node, keys = np.zeros(b - a, np.uint64), np.zeros((b - a, BANDS), np.uint64)
                if len(has):
                    node[has] = mix(np.add.reduceat(mix(hashes), at[has]))
                for k in range(BANDS):
                    key = np.full(b - a, k + 1, np.uint64)
                    for j in range(k * BAND_ROWS, (k + 1) * BAND_ROWS):
                        if len(has):
                            key[has] += np.minimum.reduceat((hashes ^ _FLIP[j]) * _MULTIPLY[j], at[has])
                        key = mix(key)
                    keys[:, k] = key
                lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), keys.view(np.int64).ravel())
                cols = [pa.array(np.diff(at).astype(np.int64)), pa.array(fingerprints_of(hashes, at).view(np.int64)), lists]
                yield pa.RecordBatch.from_arrays([batch.column(KEY)[a:b], pa.array(node.view(np.int64)), *cols], [KEY, "node", "n", "fp", "bands"])

    return run


def _sets(shingle: int):
    """root, node, block, blocks and the sorted distinct shingle hashes, 8 bytes each."""
    names = ["root", "node", "block", "blocks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = buffers(batch.column("text"))
            for a, b in slices(offs):
                hashes, at = shingle_hashes(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], shingle)
                own = [np.unique(hashes[i:j]).tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(own, pa.binary())], [*names, "shingles"])

    return run


def _alike(one: np.ndarray, sets: list[np.ndarray], similar: tuple[int, int]) -> np.ndarray:
    """Which of ``sets`` have at least that similarity to ``one``."""
    up, down = similar
    size = np.array([len(s) for s in sets])
    near = np.minimum(size, len(one)) * down >= np.maximum(size, len(one)) * up
    todo = np.flatnonzero(near & (size > 0))
    for a in range(0, len(todo), TILE):
        at = todo[a : a + TILE]
        every = np.concatenate([sets[k] for k in at.tolist()])
        place = np.minimum(np.searchsorted(one, every), len(one) - 1)
        both = np.add.reduceat((one[place] == every).astype(np.int64), np.concatenate(([0], np.cumsum(size[at])[:-1])))
        near[at] = both * (up + down) >= up * (size[at] + len(one))
    return near


def linked(nodes: list[int], sets: list[np.ndarray], similar: tuple[int, int] = SIMILAR) -> Iterator[tuple[int, int]]:
    """(node, smallest node of its component) of each node that is not the smallest.

    A component is searched breadth first, and only what no member has reached is compared.
    """
    left = sorted(range(len(nodes)), key=nodes.__getitem__)
    while left:
        root, left = left[0], left[1:]
        queue = [root]
        while queue and left:
            near = _alike(sets[queue.pop()], [sets[k] for k in left], similar)
            new = [left[k] for k in np.flatnonzero(near).tolist()]
            yield from ((nodes[k], nodes[root]) for k in new)
            queue += new
            left = [left[k] for k in np.flatnonzero(~near).tolist()]


def across(one: list[np.ndarray], two: list[np.ndarray], similar: tuple[int, int] = SIMILAR) -> np.ndarray:
    """A label for each set of both blocks; sets that links between the blocks join share one.

    A set is compared only with those of the other block that it is not yet joined to.
    """
    label = np.arange(len(one) + len(two))
    for k, own in enumerate(one):
        todo = np.flatnonzero(label[len(one) :] != label[k])
        for a in range(0, len(todo), TILE):
            at = todo[a : a + TILE]
            at = at[label[len(one) + at] != label[k]]
            met = at[_alike(own, [two[x] for x in at.tolist()], similar)]
            if len(met):
                joined = np.isin(label, label[len(one) + met]) | (label == label[k])
                label[joined] = label[joined].min()
    return label


def _compare(similar: tuple[int, int]):
    """Rows sorted by root and pair of blocks -> links (node, smaller node) of what is verified."""

    def emit(nodes: list[int], sets: list[np.ndarray], blocks: list[int]) -> pa.RecordBatch:
        if blocks[0] == blocks[-1]:
            pairs = list(linked(nodes, sets, similar))
        else:
            cut = blocks.index(blocks[-1])
            label = across(sets[:cut], sets[cut:], similar)
            least: dict[int, int] = {}
            for x, n in zip(label.tolist(), nodes, strict=True):
                least[x] = min(n, least.get(x, n))
            pairs = [(n, least[x]) for x, n in zip(label.tolist(), nodes, strict=True) if n != least[x]]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, nodes, sets, blocks = None, [], [], []
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("root", "i", "j", "node", "block")), strict=True)
            for (root, i, j, node, block), own in zip(keys, batch.column("shingles"), strict=True):
                if (root, i, j) != last and nodes:
                    # Of two blocks one may have no texts; what it would be compared with is another task's.
                    if last[1] == last[2] or blocks[0] != blocks[-1]:
                        yield emit(nodes, sets, blocks)
                    nodes, sets, blocks = [], [], []
                last = root, i, j
                nodes.append(node)
                sets.append(np.frombuffer(own.as_py(), np.uint64))
                blocks.append(block)
        if nodes and (last[1] == last[2] or blocks[0] != blocks[-1]):
            yield emit(nodes, sets, blocks)

    return run


def near_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, segments: tuple[int, ...] = SEGMENTS, similar: tuple[int, int] = SIMILAR,
                    block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Row key (``tables.keyed``) and component of every row; components chain near copies.

    Null and empty texts have no shingle and are copies of each other.  A candidate component
    whose hashes take more than ``block_bytes`` is cut into blocks, and each pair of blocks is a
    task of its own.
    """
    spark = docs.sparkSession
    hold_batches(spark)
    texts = keyed(docs, id_col).select(KEY, F.col(text).alias("text"))
    kind = dict(texts.dtypes)[KEY]
    marked, _ = stored(texts.mapInArrow(rested(_signatures(shingle)), f"{KEY} {kind}, node long, n long, fp long, bands array<long>"), "similar-signatures")
    # Fingerprints within the radius, by the fingerprint's smallest node.
    reps, _ = stored(marked.groupBy("fp").agg(F.min("node").alias("rep")), "similar-fingerprints")
    close = links(reps.select("fp"), radius, segments).join(reps.withColumnsRenamed({"fp": "a", "rep": "one"}), "a").join(reps.withColumnsRenamed({"fp": "b", "rep": "two"}), "b")
    close = close.select(F.greatest("one", "two").alias("a"), F.least("one", "two").alias("b"))
    same = marked.join(reps, "fp").filter("node > rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    filed = marked.select("node", F.explode("bands").alias("band"))
    busy, _ = stored(filed.groupBy("band").agg(F.min("node").alias("b"), F.max("node").alias("top")).filter("b < top").drop("top"), "similar-bands")
    banded = filed.join(busy, "band").filter("node > b").select(F.col("node").alias("a"), "b")
    roots, _ = stored(components(close.unionByName(same).unionByName(banded).distinct()), "similar-candidates")
    # One row of each node is enough for its shingles.
    met = marked.groupBy("node").agg(F.min(KEY).alias(KEY), F.max("n").alias("n")).join(roots, "node")
    large = met.groupBy("root").agg(F.ceil(F.sum("n") * 8 / block_bytes).cast("int").alias("blocks")).filter("blocks > 1")
    met = met.join(broadcast_measured(large, "similar-large"), "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    met = met.select(KEY, "node", "root", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "blocks")
    sets = join_rows(texts, met, "similar-met").select("text", "root", "node", "block", "blocks").mapInArrow(rested(_sets(shingle)), "root long, node long, block int, blocks int, shingles binary")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    dealt = sets.select("root", "node", "block", "shingles", F.explode(pairs).alias("p")).select("root", "p.i", "p.j", "node", "block", "shingles")
    found = dealt.repartition(shuffle_partitions(spark), "root", "i", "j").sortWithinPartitions("root", "i", "j", "block").mapInArrow(rested(_compare(similar)), "a long, b long")
    verified, _ = stored(components(found), "similar-roots")
    return marked.select(KEY, "node").join(verified, "node", "left").select(KEY, F.coalesce("root", "node").alias("component"))
