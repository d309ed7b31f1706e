"""Merkle manifest of a dataset: a tree per group, their roots in a tree of their own, witnesses.

A tree is grown by streaming appends: nodes wait in the open run of their level, and a run that is
full or last becomes the next level's node. Whoever lies below a run then has its witness extended by
the run's other nodes. Leaves are numbered by prefix sums over sorted ranges and dealt into aligned
blocks, each grown in one task; block roots are appended to the next tier of blocks in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm.storage import small_enough, staged

#: Nodes of a run, and levels and nodes of a block.
WIDTH = 8
BLOCK_LEVELS = 4
BLOCK = WIDTH**BLOCK_LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def joined_digest(nodes: list[bytes]) -> bytes:
    """The digest of digests, which are joined as hexadecimal text."""
    return hashlib.sha256(b"".join(nodes).hex().encode()).digest()


def height(total: int) -> int:
    """Levels above ``total`` nodes until one remains, in a block of them ``BLOCK_LEVELS`` at most."""
    levels = 0
    while total > 1 and levels < BLOCK_LEVELS:
        total, levels = -(-total // WIDTH), levels + 1
    return levels


class Appender:
    """A tree that grows to the right, of ``levels`` runs above its leaves."""

    def __init__(self, levels: int) -> None:
        self.levels = levels
        self.open: list[list[tuple[bytes, list[list[bytes]]]]] = [[] for _ in range(levels + 1)]

    def append(self, node: bytes, witness: list[bytes] | None = None) -> None:
        """``witness`` gets a step for every run above the node, as soon as the run is complete."""
        self._push(0, node, [] if witness is None else [witness])

    def _push(self, level: int, node: bytes, below: list[list[bytes]]) -> None:
        self.open[level].append((node, below))
        if len(self.open[level]) == WIDTH and level < self.levels:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        nodes, below = [node for node, _ in run], []
        for at, (_, witnesses) in enumerate(run):
            if witnesses:
                step = bytes((at, len(run) - 1)) + b"".join(nodes[:at] + nodes[at + 1:])
                for witness in witnesses:
                    witness.append(step)
                below += witnesses
        self._push(level + 1, joined_digest(nodes), below)

    def finish(self) -> bytes:
        """The root; the last run of each level is closed with what it has."""
        for level in range(self.levels):
            if self.open[level]:
                self._close(level)
        return self.open[self.levels][0][0]


def steps(witness: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """(place in the run, the run's other nodes) for each level."""
    at = 0
    while at < len(witness):
        place, n = witness[at], witness[at + 1]
        at += 2
        yield place, [witness[at + 32 * i: at + 32 * i + 32] for i in range(n)]
        at += 32 * n


def folded(node: bytes, witness: bytes) -> bytes:
    """The root that follows from ``node`` and its witness."""
    for place, others in steps(witness):
        node = joined_digest([*others[:place], node, *others[place:]])
    return node


def proof(witness: bytes) -> bytes:
    """The digest of all other nodes on the way up."""
    return joined_digest([other for _, others in steps(witness) for other in others])


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _leaf(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[_field(c) for c in fields]).cast("binary"), 256))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted range with the range's number and their place in their tree's part of it."""
    part, tree, place = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        places = []
        for name in batch.column("tree").to_pylist():
            tree, place = (tree, place + 1) if name == tree else (name, 0)
            places.append(place)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64())],
            names=[*batch.schema.names, "part", "place"],
        )


def _blocks(nodes: DataFrame) -> DataFrame:
    """(tree, total, block, members): aligned blocks of nodes (tree, total, at, id, node, claim)."""
    member = F.struct((F.col("at") % BLOCK).cast("int").alias("spot"), "id", "node", "claim")
    blocks = nodes.groupBy("tree", "total", F.floor(F.col("at") / BLOCK).cast("long").alias("block")).agg(
        F.sort_array(F.collect_list(member)).alias("members")
    )
    return staged(blocks, "merkle-blocks")


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roots = []
        for total, members in zip(batch.column("total").to_pylist(), batch.column("members"), strict=True):
            tree = Appender(height(total))
            for node in members.values.field("node").to_pylist():
                tree.append(node)
            roots.append(tree.finish())
        names = ["tree", "total", "block"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(roots, pa.binary())], names=[*names, "root"])


def _tiers(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of every tier, leaves first, and a root (tree, node) for each tree."""
    tiers = []
    while True:
        tiers.append(_blocks(nodes))
        above = tiers[-1].mapInArrow(_roots, "tree string, total long, block long, root binary")
        nodes = staged(
            above.select(
                "tree", F.ceil(F.col("total") / BLOCK).cast("long").alias("total"), F.col("block").alias("at"),
                F.lit(None).cast("long").alias("id"), F.col("root").alias("node"), F.lit(None).cast("binary").alias("claim"),
            ),
            "merkle-roots",
        )
        if (nodes.agg(F.max("total")).first()[0] or 0) <= 1:
            return tiers, nodes.select("tree", "node")


_WITNESSED = "tree string, at long, id long, node binary, claim binary, witness binary"


def _witnesses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of blocks with their witnesses, which the block's own way up completes."""
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("tree", "total", "block", "above")]
        for name, total, block, above, members in zip(*columns, batch.column("members"), strict=True):
            tree, witnesses = Appender(height(total)), []
            for node in members.values.field("node").to_pylist():
                witnesses.append([])
                tree.append(node, witnesses[-1])
            tree.finish()
            n = len(witnesses)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * n, pa.string()), pa.array(range(block * BLOCK, block * BLOCK + n), pa.int64()),
                    *[members.values.field(c) for c in ("id", "node", "claim")],
                    pa.array([b"".join(w) + (above or b"") for w in witnesses], pa.binary()),
                ],
                names=["tree", "at", "id", "node", "claim", "witness"],
            )


def _descend(tiers: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Witnesses of the lowest tier's members, from those of the trees' roots (tree, at, witness)."""
    ways = tops
    for blocks in reversed(tiers):
        ways = small_enough(staged(ways, "merkle-ways"), 64 + 32 * WIDTH * BLOCK_LEVELS)
        ways = ways.select("tree", F.col("at").alias("block"), F.col("witness").alias("above"))
        ways = blocks.join(ways, ["tree", "block"], "left").mapInArrow(_witnesses, _WITNESSED)
        if blocks is not tiers[0]:
            ways = ways.select("tree", "at", "witness")
    return ways


def _checked(root: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            claims, witnesses = batch.column("claim").to_pylist(), batch.column("witness").to_pylist()
            reached = [folded(c, w) for c, w in zip(claims, witnesses, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), batch.column("node"), batch.column("tree"), batch.column("witness"),
                    pa.array([proof(w).hex() for w in witnesses]), pa.array([r.hex() for r in reached]),
                    pa.array([r == root for r in reached]),
                ],
                names=["id", "leaf", "tree", "witness", "proof_sha256", "folded_root", "verified"],
            )

    return run


def tampered(text: Column, id_: Column) -> Column:
    """``text`` with A-Z lowered where 3 divides the crc32 of the id in decimals."""
    chosen = F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 0, F.lit(False))
    return F.when(chosen, F.translate(text, _UPPER, _UPPER.lower())).otherwise(text)


def manifest(docs: DataFrame, claimed: Column | None = None) -> DataFrame:
    """One row per input row: doc_id, leaf, subroot, root, witness, proof_sha256, folded_root, verified.

    A leaf is the sha256 of ``FIELDS``, each with its length. Leaves of one lang form a tree in the
    order of doc_id; the trees' roots form one in the order of lang. Every 8 nodes side by side, in
    the last run fewer, become the digest of their digests while several remain. ``claimed`` is a
    text to be checked instead of the row's own: folded_root follows from it and the row's witness,
    verified says if that is the root. witness holds, level by level, the row's place in its run and
    the run's other digests; ``folded`` and ``steps`` read it.

    Texts are hashed in their scan; what is sorted and dealt out are digests. Leaves are numbered by
    prefix sums over ranges of (lang, doc_id, leaf, row), so neither a lang with most rows nor
    repeated rows fill a task; a task holds a block of ``BLOCK`` nodes. Per tier rows shrink by
    ``BLOCK``, so even 10^10 rows need three.

    Null fields count as ``-``; null langs form a tree of their own, the first; null ids come first
    in their tree, equal ids by their leaves, and rows that repeat all fields are leaves each. Other
    columns are not looked at. An empty table gives no row.
    """
    fields = [F.col(c) for c in FIELDS]
    leaf = _leaf(fields)
    claim = leaf if claimed is None else F.when(claimed.eqNullSafe(F.col("text")), leaf).otherwise(_leaf([*fields[:-1], claimed]))
    leaves = staged(
        docs.select(
            # a prefix tells the null lang, which comes first, from all others
            F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("tree"),
            F.col("doc_id").cast("long").alias("id"), leaf.alias("node"), claim.alias("claim"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "merkle-leaves",
    )
    order = ["tree", F.asc_nulls_first("id"), "node", "row"]
    numbered = staged(
        leaves.repartitionByRange(*order).sortWithinPartitions(*order).drop("row")
        .mapInArrow(_numbered, "tree string, id long, node binary, claim binary, part int, place long"),
        "merkle-order",
    )
    sizes = numbered.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"))
    tree = Window.partitionBy("tree")
    ahead = F.sum("n").over(tree.orderBy("part")) - F.col("n")
    offsets = staged(sizes.select("tree", "part", ahead.alias("ahead"), F.sum("n").over(tree).alias("total")), "merkle-offsets")
    nodes = numbered.join(small_enough(offsets, 64), ["tree", "part"]).select(
        "tree", "total", (F.col("ahead") + F.col("place")).alias("at"), "id", "node", "claim"
    )
    tiers, subroots = _tiers(nodes)

    # one row per lang, so a window over all of them is small
    trees = staged(subroots.select("*", (F.row_number().over(Window.orderBy("tree")) - 1).alias("at")), "merkle-trees")
    count = trees.count()
    one = F.lit("").alias("tree")
    over, top = _tiers(
        trees.select(
            one, F.lit(count).cast("long").alias("total"), F.col("at").cast("long").alias("at"),
            F.lit(None).cast("long").alias("id"), "node", F.lit(None).cast("binary").alias("claim"),
        )
    )
    found = top.first()
    root = bytes(found["node"]) if found else b""
    none = F.lit(b"").alias("witness")
    ways = _descend(over, top.select("tree", F.lit(0).cast("long").alias("at"), none)).select("at", "witness")
    tops = trees.join(ways, "at").select("tree", F.lit(0).cast("long").alias("at"), "witness")
    rows = _descend(tiers, tops).mapInArrow(
        _checked(root),
        "id long, leaf binary, tree string, witness binary, proof_sha256 string, folded_root string, verified boolean",
    )
    names = small_enough(trees.select("tree", F.lower(F.hex("node")).alias("subroot")), 128)
    return rows.join(names, "tree").select(
        F.col("id").alias("doc_id"), F.lower(F.hex("leaf")).alias("leaf"), "subroot", F.lit(root.hex()).alias("root"),
        "witness", "proof_sha256", "folded_root", "verified",
    )
