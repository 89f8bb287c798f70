"""Minimum-cost-flow resharding.

Given the shard that each row lies in now and a new number of shards, rows are counted and
ranked per old shard, a flow over a graph whose size depends only on the shard counts says
how many rows go from where to where so that the fewest bytes move, and the ranks turn that
into a shard and a gapless slot for each row.  Only shards that give or take rows are written
again.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import BROADCAST_BYTES, KEY, keyed, new_path, one_of_equal, shuffle_partitions, size_of, stored

#: Bytes a row takes beside its text.
ROW_OVERHEAD = 16


@dataclass(frozen=True)
class Transfer:
    """Rows ``first`` to ``last - 1`` in size order of old shard ``source`` go to ``target``."""

    source: int
    target: int
    first: int
    last: int


class _Network:
    """Successive cheapest augmenting paths with potentials; capacities and costs are exact integers."""

    def __init__(self, nodes: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        for u, v, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[u].append(len(self.to))
            self.to.append(v)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def solve(self, source: int, sink: int) -> None:
        n = len(self.out)
        height = [0] * n
        while True:
            far, via, heap = [None] * n, [-1] * n, [(0, source)]
            far[source] = 0
            while heap:
                d, u = heapq.heappop(heap)
                if d > far[u]:
                    continue
                for e in self.out[u]:
                    v = self.to[e]
                    if self.room[e] and (far[v] is None or d + self.cost[e] + height[u] - height[v] < far[v]):
                        far[v], via[v] = d + self.cost[e] + height[u] - height[v], e
                        heapq.heappush(heap, (far[v], v))
            if far[sink] is None:
                return
            top = max(x for x in far if x is not None)
            for v in range(n):
                height[v] += top if far[v] is None else far[v]
            path, v = [], sink
            while v != source:
                path.append(via[v])
                v = self.to[via[v] ^ 1]
            pushed = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= pushed
                self.room[e ^ 1] += pushed


def plan_transfers(blocks: dict[int, list[tuple[int, int]]], n_new: int) -> list[Transfer]:
    """Block transfers that even out row counts and move the fewest bytes.

    ``blocks``: for each old shard its blocks in size order, each (rows, bytes of a row times
    rows).  Old shards numbered below ``n_new`` live on; the others are emptied.  Every new
    shard gets the even share or one row more, and the flow chooses which get one more.
    """
    total = sum(rows for own in blocks.values() for rows, _ in own)
    share, extra = divmod(total, n_new)
    scale = 1
    for own in blocks.values():
        for rows, _ in own:
            scale = max(scale, rows)
    old = sorted(blocks)
    source, sink, pool, more = 0, 1, 2, 3
    first_new = 4
    network = _Network(first_new + n_new + sum(len(blocks[i]) for i in old))
    at, moved = first_new + n_new, []
    for i in old:
        for k, (rows, size) in enumerate(blocks[i]):
            network.arc(source, at, rows, 0)
            if i < n_new:
                network.arc(at, first_new + i, rows, 0)
            moved.append((i, k, network.arc(at, pool, rows, -(-size * scale // max(rows, 1)))))
            at += 1
    taken = [network.arc(pool, first_new + j, total, 0) for j in range(n_new)]
    for j in range(n_new):
        network.arc(first_new + j, sink, share, 0)
        network.arc(first_new + j, more, 1, 0)
    network.arc(more, sink, extra, 0)
    network.solve(source, sink)

    gives = dict.fromkeys(old, 0)
    for i, _, e in moved:
        gives[i] += network.room[e ^ 1]
    needs = [[j, network.room[e ^ 1]] for j, e in enumerate(taken)]
    plan, at = [], 0
    for i in old:
        rank = 0
        while rank < gives[i]:
            while not needs[at][1]:
                at += 1
            n = min(gives[i] - rank, needs[at][1])
            plan.append(Transfer(i, needs[at][0], rank, rank + n))
            rank += n
            needs[at][1] -= n
    return plan


def ranked(rows: DataFrame) -> DataFrame:
    """Add ``rank``: place of a row in its old shard, by size and then id, from 0.

    Rows are range-partitioned on (old_shard, size, doc_id), which splits even a size that a
    third of all rows have; counts per task, not rows, are added up for the offsets.
    """
    spark = rows.sparkSession
    dealt = (
        rows.repartitionByRange(shuffle_partitions(spark), "old_shard", "size", "doc_id")
        .sortWithinPartitions("old_shard", "size", "doc_id")
        .withColumn("place", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("place", 33))
    )
    kept, _ = stored(dealt, "reshard-ranked")
    # As many rows as tasks and shards together.
    counts = kept.groupBy("old_shard", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).collect()
    before, seen = [], {}
    for r in sorted(counts, key=lambda r: (r.old_shard, r.part)):
        before.append((r.old_shard, r.part, seen.get(r.old_shard, 0) - r.first))
        seen[r.old_shard] = seen.get(r.old_shard, 0) + r.n
    shift = spark.createDataFrame(before, "old_shard int, part long, shift long")
    return kept.join(F.broadcast(shift), ["old_shard", "part"]).withColumn("rank", F.col("place") + F.col("shift")).drop("place", "part", "shift")


def reshard(rows: DataFrame, n_new: int) -> tuple[DataFrame, list[Transfer]]:
    """Assign each row a new shard and slot under the law ``rows``.

    ``rows`` has doc_id, size (bytes) and old_shard, and any further columns.  Returns them
    with ``shard`` and ``slot``, and the transfers.  Counts of any two shards differ by one at
    most; the bytes moved are the fewest that this allows.
    """
    spark = rows.sparkSession
    at, _ = stored(ranked(rows), "reshard-ranks")
    sizes = {r.old_shard: r.n for r in at.groupBy("old_shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    if not total:
        return at.withColumn("shard", F.lit(0)).withColumn("slot", F.col("rank")).drop("rank"), []
    # A shard keeps the share, one row more, or all it has, so its ranks fall into three blocks.
    share = total // n_new
    low = {i: max(0, n - share - 1) if i < n_new else n for i, n in sizes.items()}
    high = {i: max(0, n - share) if i < n_new else n for i, n in sizes.items()}
    cut = spark.createDataFrame([(i, low[i], high[i]) for i in sizes], "old_shard int, low long, high long")
    block = F.when(F.col("rank") < F.col("low"), 0).when(F.col("rank") < F.col("high"), 1).otherwise(2)
    told = at.join(F.broadcast(cut), "old_shard").groupBy("old_shard", block.alias("block")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).collect()
    blocks: dict[int, list[tuple[int, int]]] = {}
    for r in sorted(told, key=lambda r: (r.old_shard, r.block)):
        blocks.setdefault(r.old_shard, []).append((r.n, r.bytes))
    plan = plan_transfers(blocks, n_new)

    gives = dict.fromkeys(sizes, 0)
    for t in plan:
        gives[t.source] += t.last - t.first
    filled = {j: sizes.get(j, 0) - gives.get(j, 0) for j in range(n_new)}
    ways = []
    for i, n in sizes.items():
        if gives[i] < n:
            ways.append((i, gives[i], n, i, -gives[i]))
    for t in plan:
        ways.append((t.source, t.first, t.last, t.target, filled[t.target] - t.first))
        filled[t.target] += t.last - t.first
    way = spark.createDataFrame(ways, "from_shard int, first long, last long, shard int, shift long")
    inside = (at["old_shard"] == way["from_shard"]) & (at["rank"] >= way["first"]) & (at["rank"] < way["last"])
    out = at.join(F.broadcast(way), inside).withColumn("slot", F.col("rank") + F.col("shift"))
    return out.drop("from_shard", "first", "last", "shift", "rank"), plan


def sized(docs: DataFrame, old_shard: Column, id_col: str = "doc_id", text: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32 and old_shard of each document, and the columns ``more``; null text counts as empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(body) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        old_shard.cast("int").alias("old_shard"),
        *more,
    )


def hashed_shard(id_col: str, n_old: int) -> Column:
    """The layout a table is in before: rows dealt by a hash of their id."""
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(n_old))


def shard_documents(docs: DataFrame, n_old: int, n_new: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs``.

    The shards that give or take rows are written, and size, checksum, shard and slot of their
    rows are those of the files; the rows of other shards stay where they are.

    Rows with a null id are dealt like any other.  Repeated rows each get a slot of their own;
    which of them gets which is fixed when the ranks are written.  Null text has size 16 and
    the checksum of the empty text.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    whole = keyed(docs, id_col).withColumn("__key", F.struct(f"{KEY}.a", f"{KEY}.b"))
    rows, _ = stored(sized(whole, hashed_shard(id_col, n_old), id_col, text, ("__key",)), "reshard-sizes")
    placed, plan = reshard(rows, n_new)
    touched = sorted({t.source for t in plan} | {t.target for t in plan})
    out = placed.filter(~F.col("shard").isin(touched)).select("doc_id", "size", "text_crc32", "shard", "slot")
    if plan:
        # Rows equal in every column share a key: one of them is joined with all their places.
        texts = one_of_equal(whole, "reshard-equal").select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), "__key", *(F.col(f"`{c}`").alias(f"__{k}_{c}") for k, c in enumerate(docs.columns) if c not in (id_col, text)))
        files = rewrite_affected(texts, placed.select(F.col("__key").alias("doc_id"), "shard", "slot"), plan, new_path(spark, "reshard-shards"), "__key")
        out = out.unionByName(sized(files, F.col("shard"), more=("shard", "slot")).drop("old_shard"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def rewrite_affected(docs: DataFrame, placed: DataFrame, plan: list[Transfer], path: str, id_col: str = "doc_id", rows_per_file: int = 100_000) -> DataFrame:
    """Write the documents of every shard that gives or takes rows, by shard and slot.

    Shards that no transfer names keep their files.  ``placed`` is from ``reshard`` with the
    same ids, unique in ``docs``.  A shard is written by as many tasks as its rows need.
    """
    spark = docs.sparkSession
    touched = sorted({t.source for t in plan} | {t.target for t in plan})
    place, at = stored(placed.filter(F.col("shard").isin(touched)).select(F.col("doc_id").alias("__id"), "shard", "slot"), "reshard-places")
    if size_of(spark, at) <= BROADCAST_BYTES:
        place = F.broadcast(place)
    rows = docs.join(place, F.col(id_col) == F.col("__id")).drop("__id")
    (
        rows.repartition("shard", F.floor(F.col("slot") / rows_per_file))
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard").option("maxRecordsPerFile", rows_per_file).parquet(path)
    )
    return spark.read.schema(rows.schema).parquet(path)
