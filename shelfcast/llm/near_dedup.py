"""Near duplicates by a chosen-path set similarity join over minwise tokens.

Every document's set of word shingles gets ``TOKENS`` minwise tokens. A tree branches documents by
tokens it chooses: at each node every token position not used above it is chosen with probability
1 / (similarity * their number), the same for all documents of the node, so that a pair at the
wanted similarity is expected to share one child, and one position at least is. Nodes of at most ``NODE`` documents are compared
exhaustively, on their full sets; larger ones are branched again. Independent trees, with other
positions at their roots, bring the recall up.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm import text as tx
from shelfcast.llm.components import components
from shelfcast.llm.storage import small_enough, staged

WORDS = 5
SIMILARITY_PCT = 75
#: Minwise hashes of a document. All make up its sketch, one byte each; the first are its tokens.
HASHES = 128
TOKENS = 40
#: Independent trees over the tokens.
TREES = 10
#: Documents of the largest node that one task compares.
NODE = 4096
#: Documents, expected, of a larger node that all others are compared with before it is branched.
PIVOTS = 8
#: Share of equal sketch bytes below which sets aren't compared: four deviations below 0.75.
LEAST_SHARED = 0.597
#: Levels after which a node is cut into blocks instead of being branched once more.
LEVELS = 8

_FACTORS = tx.constants(HASHES, 101)


def roots() -> list[int]:
    """Positions chosen at the trees' roots; each tree has one at least, none is used twice."""
    draws = tx.mix(np.arange(TREES * TOKENS, dtype=np.uint64) + np.uint64(7)).reshape(TREES, TOKENS)
    share = (draws >> np.uint64(11)).astype(np.float64) / 2.0**53
    used: list[int] = []
    for tree in range(TREES):
        free = [i for i in np.argsort(share[tree]).tolist() if i not in used]
        chosen = [i for i in free if share[tree, i] < 100 / (SIMILARITY_PCT * TOKENS)]
        used += chosen or free[:1]
    return used


def _sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, distinct shingle hashes by row, their offsets)."""
    for first, last, data, offsets in tx.slices(column):
        words, rows = tx.word_hashes(data, offsets)
        grams, at = tx.windows(words, rows, last - first, WORDS)
        parts = [np.unique(grams[at[i]: at[i + 1]]) for i in range(last - first)]
        ends = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
        yield first, last, np.concatenate(parts) if parts else grams[:0], ends


def _minima(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Minwise hashes, one row of ``HASHES`` 32-bit numbers for each row that has a set.

    The least of many hashes is a small number: it is mixed before it is cut, or the upper half of
    those of long texts would hold a few bits only, and unrelated texts would share tokens.
    """
    full = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(full), HASHES), dtype="<u4")
    for i, factor in enumerate(_FACTORS):
        out[:, i] = tx.mix(np.minimum.reduceat(values * factor, full)) >> np.uint64(32)
    return out


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, values, offsets in _sets(batch.column("text")):
            sizes = np.diff(offsets)
            full = sizes > 0
            one, two = np.zeros(len(sizes), "i8"), np.zeros(len(sizes), "i8")
            tokens, sketches = [None] * len(sizes), [None] * len(sizes)
            if full.any():
                starts = offsets[:-1][full]
                one[full] = np.add.reduceat(values, starts).view("i8")
                two[full] = np.add.reduceat(tx.mix(values), starts).view("i8")
                minima = _minima(values, offsets)
                short = minima.astype(np.uint8)
                for i, row in enumerate(np.flatnonzero(full).tolist()):
                    tokens[row], sketches[row] = minima[i, :TOKENS].tobytes(), short[i].tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").slice(first, last - first), pa.array(sizes), pa.array(one), pa.array(two),
                    pa.array(tokens, pa.binary()), pa.array(sketches, pa.binary()),
                ],
                names=["id", "n_shingles", "set_a", "set_b", "tokens", "sketch"],
            )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, values, offsets in _sets(batch.column("text")):
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").slice(first, last - first),
                    pa.array([values[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary()),
                ],
                names=["id", "shingles"],
            )


def _stacked(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, width)


def _whole_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by node, regrouped so that no node is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        nodes = batch.column("node").to_numpy()
        if held and held[-1].column("node")[-1].as_py() != nodes[0]:
            yield pa.Table.from_batches(held)
            held = []
        last = int(np.searchsorted(nodes != nodes[-1], False)) if nodes[0] == nodes[-1] else int(np.flatnonzero(nodes != nodes[-1])[-1]) + 1
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _sized(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(n, m) >= SIMILARITY_PCT * np.maximum(n, m)


def _flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a partner in their node that sizes and sketches allow, and that no small node of an
    earlier root has met already. All pairs of a node are looked at, none is given."""
    for table in _whole_nodes(batches):
        node, rep, n = (table.column(c).to_numpy() for c in ("node", "rep", "n"))
        sketch = _stacked(table.column("sketch"), "u1", HASHES)
        earlier = _lists(table.column("earlier"))
        good = np.zeros(len(node), bool)
        for lag in range(1, len(node)):
            at = np.flatnonzero(node[lag:] == node[:-lag])
            if not len(at):
                break
            at = at[_sized(n[at], n[at + lag])]
            at = at[(sketch[at] == sketch[at + lag]).mean(axis=1) >= LEAST_SHARED]
            at = at[~((earlier[at] == earlier[at + lag]) & (earlier[at] != 0)).any(axis=1)]
            good[at] = good[at + lag] = True
        for part in table.filter(pa.array(good)).combine_chunks().to_batches():
            yield part


def _lists(column: pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each node on full sets. Documents that links have joined already aren't compared
    again, so a node gives fewer links than it has documents."""
    for table in _whole_nodes(batches):
        node, rep, n = (table.column(c).to_numpy() for c in ("node", "rep", "n"))
        sketch, earlier = _stacked(table.column("sketch"), "u1", HASHES), _lists(table.column("earlier"))
        sets = [np.frombuffer(x.as_buffer(), "<u8") for x in table.column("shingles")]
        edges = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1], [True])))
        links: list[tuple[int, int]] = []
        for first, last in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            group = np.arange(last - first)  # component of each row of the node
            for i in range(first, last - 1):
                rest = np.arange(i + 1, last)
                rest = rest[(group[rest - first] != group[i - first]) & _sized(n[rest], n[i])]
                rest = rest[(sketch[rest] == sketch[i]).mean(axis=1) >= LEAST_SHARED]
                rest = rest[~((earlier[rest] == earlier[i]) & (earlier[i] != 0)).any(axis=1)]
                if not len(rest):
                    continue
                for j in rest[_similar(sets[i], [sets[j] for j in rest.tolist()])].tolist():
                    a, b = group[i - first], group[j - first]
                    if a != b:
                        group[group == b] = a
                        links.append((rep[i], rep[j]))
        if links:
            both = np.array(links)
            yield pa.RecordBatch.from_arrays([pa.array(both.min(axis=1)), pa.array(both.max(axis=1))], names=["a", "b"])


def _similar(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Whether each of ``others`` is similar enough to ``one``; all are sorted and not empty."""
    sizes = np.array([len(x) for x in others])
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    shared = np.add.reduceat((one[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
    return 100 * shared >= SIMILARITY_PCT * (len(one) + sizes - shared)


def _to_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of rows with the pivots of their node that sizes and sketches allow."""
    for batch in batches:
        rep, n = batch.column("rep").to_numpy(), batch.column("n").to_numpy()
        sketch, lists, pairs = _stacked(batch.column("sketch"), "u1", HASHES), batch.column("pivots"), []
        for i in range(batch.num_rows):
            pivots = lists[i].values
            p_rep, p_n = pivots.field("rep").to_numpy(), pivots.field("n").to_numpy()
            fits = _sized(p_n, n[i]) & (p_rep != rep[i])
            fits &= (_stacked(pivots.field("sketch"), "u1", HASHES) == sketch[i]).mean(axis=1) >= LEAST_SHARED
            pairs += [(min(rep[i], p), max(rep[i], p)) for p in p_rep[fits].tolist()]
        if pairs:
            both = np.array(pairs)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = zip(batch.column("left_set"), batch.column("right_set"), strict=True)
        keep = [
            bool(_similar(np.frombuffer(x.as_buffer(), "<u8"), [np.frombuffer(y.as_buffer(), "<u8")])[0]) for x, y in sides
        ]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the children. A node chooses among the positions not used on its way (bits of
    ``used``), each with 1 / (similarity * their number), and the one drawn lowest if none is."""
    places = np.arange(TOKENS)
    for batch in batches:
        node = batch.column("node").to_numpy().view(np.uint64)
        used = batch.column("used").to_numpy()
        tokens = _stacked(batch.column("tokens"), "<u4", TOKENS)
        free = (used[:, None] >> places) & 1 == 0
        share = (tx.mix(node[:, None] ^ _FACTORS[:TOKENS]) >> np.uint64(11)).astype(np.float64) / 2.0**53
        share[~free] = np.inf
        picked = share < 100 / (SIMILARITY_PCT * np.maximum(free.sum(axis=1), 1))[:, None]
        bare = np.flatnonzero(~picked.any(axis=1) & free.any(axis=1))
        picked[bare, share[bare].argmin(axis=1)] = True
        rows, at = np.nonzero(picked)
        keys = tx.mix(tx.mix(node[rows] + _FACTORS[at]) ^ tokens[rows, at].astype(np.uint64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.view("i8")), batch.column("rep").take(pa.array(rows)), pa.array(used[rows] | 1 << at)],
            names=["node", "rep", "used"],
        )


_PAIR = "a long, b long"


_ROW = "node long, rep long, n long, sketch binary, earlier array<long>"


def _sets_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Full sets of the documents that ``ids`` (id) lists: their texts are read again."""
    wanted = staged(ids.distinct(), "near-ids")
    found = texts.join(small_enough(wanted, 32), "id", "left_semi")
    return staged(found.mapInArrow(_full_sets, "id long, shingles binary"), "near-sets")


def _compared(rows: DataFrame, described: DataFrame, texts: DataFrame) -> DataFrame:
    """Links within the nodes of ``rows`` (node, rep, earlier), all of ``NODE`` rows at most."""
    seen = rows.join(described.select("rep", "n", "sketch"), "rep").select("node", "rep", "n", "sketch", "earlier")
    flagged = staged(seen.repartition("node").sortWithinPartitions("node").mapInArrow(_flagged, _ROW), "near-flagged")
    if flagged.isEmpty():
        return texts.sparkSession.createDataFrame([], _PAIR)
    sets = _sets_of(texts, flagged.select(F.col("rep").alias("id")))
    ordered = flagged.join(sets.withColumnRenamed("id", "rep"), "rep").repartition("node").sortWithinPartitions("node")
    columns = ["node", "rep", "n", "sketch", "earlier", "shingles"]
    return staged(ordered.select(*columns).mapInArrow(_linked, _PAIR), "near-links")


def _star(rows: DataFrame, described: DataFrame, texts: DataFrame, level: int) -> DataFrame:
    """Links of the rows (node, rep, count) of large nodes with a few pivots of their node."""
    held = rows.join(described.select("rep", "n", "sketch"), "rep")
    draw = F.shiftrightunsigned(F.xxhash64("rep", F.lit(level)), 1) / F.lit(2.0**63)
    pivots = held.where(draw < PIVOTS / F.col("count")).groupBy("node").agg(
        F.collect_list(F.struct("rep", "n", "sketch")).alias("pivots")
    )
    pairs = staged(
        held.join(pivots, "node").select("rep", "n", "sketch", "pivots").mapInArrow(_to_pivots, _PAIR).distinct(),
        "near-pairs",
    )
    if pairs.isEmpty():
        return pairs
    sets = _sets_of(texts, pairs.select(F.explode(F.array("a", "b")).alias("id")))
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("left_set"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("right_set"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "left_set", "right_set")
    return staged(both.mapInArrow(_confirmed, _PAIR), "near-links")


def links_of(texts: DataFrame, described: DataFrame) -> DataFrame:
    """Links (a, b), of the wanted similarity, that connect whatever such links connect.

    ``described`` has one row per distinct set: rep, n, tokens, sketch; ``texts`` has id and text.
    Full sets are built, and shuffled, only for documents that sketches leave open in some node.
    """
    key = [F.xxhash64(F.lit(i), F.substring("tokens", 4 * i + 1, 4)) for i in roots()]
    spread = described.select("rep", F.posexplode(F.array(*key)).alias("root", "node"))
    nodes = staged(spread.groupBy("node").count().where("count > 1"), "near-nodes")
    rows = staged(spread.join(nodes, "node"), "near-rows")
    # a pair is compared in the first small node that it shares: rows carry those of earlier roots
    places = range(len(key))
    small = rows.where(F.col("count") <= NODE).groupBy("rep").agg(
        *[F.max(F.when(F.col("root") == k, F.col("node"))).alias(f"n{k}") for k in places]
    )
    nothing = F.lit(0).cast("long")
    each = F.posexplode(F.array(*[F.col(f"n{k}") for k in places])).alias("root", "node")
    before = F.array(*[F.when(F.col("root") > k, F.coalesce(f"n{k}", nothing)).otherwise(nothing) for k in places])
    first = small.select("rep", *[f"n{k}" for k in places], each).where("node IS NOT NULL")
    links = [_compared(first.select("node", "rep", before.alias("earlier")), described, texts)]

    none = F.array_repeat(nothing, len(key))
    bits = F.array(*[F.lit(1 << i).cast("long") for i in roots()])
    large = rows.where(F.col("count") > NODE).select("node", "rep", "count", F.get(bits, "root").alias("used"))
    level = 1
    while not large.isEmpty():
        links.append(_star(large, described, texts, level))
        # a node whose documents are one component by now is done
        labels = components(reduce(DataFrame.union, links)).select(F.col("vertex").alias("rep"), "label")
        part = F.coalesce("label", "rep")
        parts = large.join(labels, "rep", "left").groupBy("node").agg(F.min(part).alias("low"), F.max(part).alias("high"))
        open_nodes = staged(parts.where("low <> high").select("node"), "near-open")
        open_rows = large.join(open_nodes, "node", "left_semi")
        level += 1
        if level > min(LEVELS, TOKENS):
            # every two blocks of a node meet in a node of their own
            blocks = F.ceil(2 * F.col("count") / NODE).cast("int")
            mine = F.pmod(F.xxhash64("rep", F.lit(level)), blocks).cast("int")
            pairs = open_rows.select("node", "rep", mine.alias("mine"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
            key_of = F.xxhash64("node", F.least("mine", "other"), F.greatest("mine", "other"))
            links.append(_compared(pairs.select(key_of.alias("node"), "rep", none.alias("earlier")), described, texts))
            break
        branched = staged(
            open_rows.select("node", "rep", "used").join(described.select("rep", "tokens"), "rep")
            .mapInArrow(_children, "node long, rep long, used long"),
            "near-branched",
        )
        sizes = staged(branched.groupBy("node").count().where("count > 1"), "near-nodes")
        children = staged(branched.join(sizes, "node"), "near-rows")
        links.append(_compared(children.where(F.col("count") <= NODE).select("node", "rep", none.alias("earlier")), described, texts))
        large = children.where(F.col("count") > NODE).select("node", "rep", "count", "used")
    return reduce(DataFrame.union, links)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Words are runs of other characters than white space, A-Z lowered. A document's set holds its
    distinct shingles of ``WORDS`` words; with fewer words the whole sequence is the one shingle;
    without words the set is empty and linked with nothing. Documents whose sets have a Jaccard
    similarity of ``SIMILARITY_PCT`` percent are linked; a component's id is its smallest document.

    Equal sets are one vertex, so copies meet in no node; ids are numbers. Rows that repeat an id
    are one document and share their result. A row without id is linked with nothing and is kept,
    with component_id null. Null texts are empty. Other columns are not looked at.
    """
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = staged(
        texts.mapInArrow(_describe, "id long, n_shingles long, set_a long, set_b long, tokens binary, sketch binary"),
        "near-described",
    )
    usable = (F.col("n_shingles") > 0) & F.col("id").isNotNull()
    same = ["set_a", "set_b", "n_shingles"]
    groups = staged(
        rows.where(usable).groupBy(*same).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("members")),
        "near-groups",
    )
    reps = groups.select("rep").distinct()
    described = staged(
        rows.where(usable).join(reps, rows["id"] == reps["rep"], "left_semi")
        .select(F.col("id").alias("rep"), F.col("n_shingles").alias("n"), "tokens", "sketch").dropDuplicates(["rep"]),
        "near-sketches",
    )
    # one word sequence below the shingle length is similar to itself only
    links = links_of(texts.where("id IS NOT NULL"), described)
    labels = components(links).select(F.col("vertex").alias("rep"), "label")
    # sets with a single document and no link need no join
    named = groups.join(labels, "rep", "left").where("members > 1 OR label IS NOT NULL").select(
        *same, F.coalesce("label", "rep").alias("label")
    )
    out = rows.drop("tokens", "sketch").join(named, same, "left")
    component = F.when(usable, F.coalesce("label", "id")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col), "n_shingles", component.alias("component_id"),
        component.eqNullSafe(F.col("id")).alias("kept"),
    )
