"""Resharding by minimum-cost flow: blocks move so that the fewest bytes are rewritten."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfcast.llm.storage import small_enough, staged

#: Blocks of a shard: what moves. Their number doesn't follow the data.
BLOCKS = 512
#: A block above this share of a shard's capacity is cut by a further hash of the text, and a group of
#: equal texts that is that large by itself by document; no other group is spread over several blocks.
LARGE_BLOCK = 0.25
CUTS = 64


@dataclass
class _Edge:
    to: int
    room: int
    cost: int
    back: int


def min_cost_flow(supply: list[int], room: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Amounts from each source to each sink that use up the supply at the least cost.

    Successive shortest paths with potentials; the graph has one node per shard, old or new.
    """
    n, m = len(supply), len(room)
    source, sink = n + m, n + m + 1
    graph: list[list[_Edge]] = [[] for _ in range(n + m + 2)]

    def edge(a: int, b: int, amount: int, price: int) -> None:
        graph[a].append(_Edge(b, amount, price, len(graph[b])))
        graph[b].append(_Edge(a, 0, -price, len(graph[a]) - 1))

    for i, amount in enumerate(supply):
        edge(source, i, amount, 0)
        for j in range(m):
            edge(i, n + j, amount, cost[i][j])
    for j, amount in enumerate(room):
        edge(n + j, sink, amount, 0)
    height = [0] * len(graph)
    while True:
        far: list[int | None] = [None] * len(graph)
        came: list[tuple[int, int] | None] = [None] * len(graph)
        far[source], queue = 0, [(0, source)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for k, e in enumerate(graph[a]):
                if e.room:
                    there = d + e.cost + height[a] - height[e.to]
                    if far[e.to] is None or there < far[e.to]:
                        far[e.to], came[e.to] = there, (a, k)
                        heapq.heappush(queue, (there, e.to))
        if far[sink] is None:
            break
        height = [h + (f if f is not None else far[sink]) for h, f in zip(height, far, strict=True)]
        path, at = [], sink
        while at != source:
            a, k = came[at]
            path.append(graph[a][k])
            at = a
        amount = min(e.room for e in path)
        for e in path:
            e.room -= amount
            graph[e.to][e.back].room += amount
    flows = [[0] * m for _ in range(n)]
    for i in range(n):
        for e in graph[i]:
            if n <= e.to < n + m:
                flows[i][e.to - n] = graph[e.to][e.back].room
    return flows


def plan_transfers(blocks: dict[tuple[int, int], int], old: int, new: int) -> dict[tuple[int, int], int]:
    """New shard of every block (old shard, block): sizes end near equal, the fewest bytes move.

    The flow says how many bytes go from an old shard to each new one; a shard's blocks then fill
    these amounts, largest first, each where most is left to fill.
    """
    total = sum(blocks.values())
    capacity = [total * (j + 1) // new - total * j // new for j in range(new)]
    supply = [sum(size for (shard, _), size in blocks.items() if shard == i) for i in range(old)]
    flows = min_cost_flow(supply, capacity, [[0 if i == j else 1 for j in range(new)] for i in range(old)])
    placed: dict[tuple[int, int], int] = {}
    left = list(capacity)
    for i in range(old):
        wish = list(flows[i])
        mine = sorted(((size, block) for (shard, block), size in blocks.items() if shard == i), key=lambda x: (-x[0], x[1]))
        for size, block in mine:
            to = max(range(new), key=lambda j: (wish[j], j == i, -j))
            wish[to] -= size
            left[to] -= size
            placed[i, block] = to
    # rounding of whole blocks: the smallest ones level what is over
    small = sorted(blocks, key=lambda b: (blocks[b], b))
    for block in small:
        a = placed[block]
        b = max(range(new), key=lambda j: (left[j], -j))
        if left[a] < 0 and left[b] - blocks[block] > left[a]:
            left[a] += blocks[block]
            left[b] -= blocks[block]
            placed[block] = b
    return placed


def _written(rows: DataFrame, path: str) -> None:
    rows.write.option("maxRecordsPerFile", 1_000_000).option("compression", "zstd").partitionBy("shard").parquet(path)


def _move_folder(spark: SparkSession, source: str, target: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs
    source, target = hadoop.Path(source), hadoop.Path(target)
    store = source.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.rename(source, target):
        raise OSError(f"{source} can't be moved to {target}")


def reshard(
    docs: DataFrame, path: str, old_shards: int, new_shards: int, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(rows with their shard and slot, the block transfers) of a move to ``new_shards``.

    The old layout puts a text into one of ``old_shards`` and there into one of ``BLOCKS`` by its
    hash, so equal texts share a block and move together, unless they alone exceed ``LARGE_BLOCK`` of
    a shard. Block sizes (UTF-8 bytes of the text plus
    1), their number bounded by the two parameters, go to the flow on the driver; shards of the new
    layout get near equal sizes while the fewest bytes leave their shard. The old layout is written
    to ``path``-old, one folder for each shard. Shards that lose or gain a block are written anew
    below ``path`` from the old files; folders of the others are moved there, so ``path`` holds all
    rows. Rows: id, size, text_crc32, old_shard, shard, slot, moved. Slots count from 0 in every
    shard, ordered by block and id.

    Null texts are empty ones. Ids may be null, and repeat: repeated rows get slots of their own.
    Other columns are not looked at. An empty table gives no rows and no transfers.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"))
    key = F.xxhash64("text", F.lit(17))
    rows = rows.select(
        "id", "text", key.alias("key"), (F.octet_length("text") + 1).cast("long").alias("size"),
        F.pmod(key, F.lit(old_shards)).cast("int").alias("old_shard"),
        F.pmod(F.xxhash64("text", F.lit(29)), F.lit(BLOCKS)).cast("int").alias("whole"),
        F.pmod(F.xxhash64("id", F.lit(5)), F.lit(CUTS)).cast("int").alias("cut"),
    )
    sums = {
        (r["old_shard"], r["whole"]): r["size"]
        for r in rows.groupBy("old_shard", "whole").agg(F.sum("size").alias("size")).collect()
    }
    limit = LARGE_BLOCK * sum(sums.values()) / new_shards
    large = {b for b, size in sums.items() if size > limit}
    # numbers of a block: itself, its cuts by text, its cuts by document
    numbers = 2 * CUTS + 1
    blocks = {(s, w * numbers): size for (s, w), size in sums.items() if (s, w) not in large}
    spark = docs.sparkSession
    # of large blocks there are a few at most, whatever the data
    marks = F.broadcast(
        spark.createDataFrame(sorted(large), "old_shard int, whole int").withColumn("is_large", F.lit(True))
    )
    block: Column = F.col("whole") * numbers
    if large:
        marked = rows.join(marks, ["old_shard", "whole"])
        heavy = marked.groupBy("old_shard", "whole", "key").agg(F.sum("size").alias("size")).where(F.col("size") > limit)
        # as few: each has its share of a shard
        hot = F.broadcast(
            spark.createDataFrame([(r["key"],) for r in heavy.collect()], "key long").withColumn("is_hot", F.lit(True))
        )
        by_text = F.pmod(F.xxhash64("text", F.lit(41)), F.lit(CUTS)).cast("int")
        inner = F.when(F.col("is_hot"), 1 + CUTS + F.col("cut")).otherwise(1 + by_text)
        block = F.when(F.col("is_large"), block + inner).otherwise(block)
        rows = rows.join(marks, ["old_shard", "whole"], "left").join(hot, "key", "left")
        cells = rows.where("is_large").groupBy("old_shard", block.alias("block")).agg(F.sum("size").alias("size"))
        blocks |= {(r["old_shard"], r["block"]): r["size"] for r in cells.collect()}
    placed = plan_transfers(blocks, old_shards, new_shards)
    transfers = spark.createDataFrame(
        [(s, b, blocks[s, b], to) for (s, b), to in sorted(placed.items())],
        "old_shard int, block int, bytes long, shard int",
    )
    columns = ["id", "text", "size", "old_shard", "block", "cut", "shard"]
    schema = "id long, text string, size long, old_shard int, block int, cut int, shard int"
    old = rows.withColumn("block", block).withColumn("shard", F.col("old_shard")).select(*columns)
    _written(old, f"{path}-old")

    changed = {x for (s, _), to in placed.items() if s != to for x in (s, to)}
    # both tables have a row per block at most
    again = spark.read.schema(schema).parquet(f"{path}-old").drop("shard").join(
        F.broadcast(transfers.select("old_shard", "block", "shard")), ["old_shard", "block"]
    ).where(F.col("shard").isin(sorted(changed)))
    _written(again.select(*columns).repartition("shard", "block", "cut"), path)
    for shard in sorted({s for s, _ in placed} - changed):
        _move_folder(spark, f"{path}-old/shard={shard}", f"{path}/shard={shard}")
    everything = spark.read.schema(schema).parquet(path).withColumn("moved", F.col("shard") != F.col("old_shard"))
    narrow = staged(
        everything.select(
            "id", "size", F.crc32(F.col("text").cast("binary")).alias("text_crc32"), "old_shard", "block", "cut", "shard", "moved"
        ),
        "reshard-rows",
    )
    # slots: a number inside a cell, bounded by its share of a block, on top of the cells before it
    cell = ["shard", "old_shard", "block", "cut"]
    counts = narrow.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("shard").orderBy("old_shard", "block", "cut")) - F.col("n")
    first = staged(counts.select(*cell, ahead.alias("first")), "reshard-slots")
    inside = F.row_number().over(Window.partitionBy(*cell).orderBy("id", "size", "text_crc32")) - 1
    out = narrow.withColumn("inside", inside).join(small_enough(first, 48), cell).select(
        F.col("id").alias(id_col), "size", "text_crc32", "old_shard", "shard",
        (F.col("first") + F.col("inside")).cast("long").alias("slot"), "moved",
    )
    return out, transfers
