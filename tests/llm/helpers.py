"""Small document tables with every awkward case, and brute-force versions of the operators."""

from __future__ import annotations

import random
import re

WORDS = "the of and river stone garden paper light music window forest engine market silver winter story".split()


def words(n: int, seed: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + str(draw.randrange(40)) for _ in range(n))


def awkward_rows() -> list[tuple]:
    """(doc_id, text): nulls, empties, repeats, ties, near copies, shared passages, a long text."""
    base, passage = words(120, 1), words(140, 2)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base), (2, base), (3, base.replace(" ", "  ")), (4, " ".join(near)), (5, None), (6, ""), (7, " \n\t "),
        (8, "one two"), (9, "ONE\ttwo"), (10, f"{words(30, 3)} {passage} {words(30, 4)}"), (11, f"{words(50, 5)} {passage}"),
        (12, "x" * 1500), (13, words(4000, 6)), (14, words(60, 7)), (14, words(60, 7)), (None, words(50, 8)),
        (None, base), (15, "á é \x85 ü 日本語  　 x"), (16, words(3, 9) + "\n" + words(3, 9)), (17, "line again\n" * 90),
    ]
    return rows


def table(spark, rows, columns="doc_id long, text string"):
    return spark.createDataFrame(rows, columns)


def clashing(df):
    """The same table with columns named like those the operators use inside."""
    from pyspark.sql import functions as F

    names = ["id", "hash", "part", "n", "node", "segment", "kept", "score", "value", "block", "page", "size"]
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def shingles(text) -> frozenset:
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < 5 else [tuple(w[i: i + 5]) for i in range(len(w) - 4)])


def components(rows) -> dict:
    """Component by document id, over all pairs."""
    sets = {d: shingles(t) for d, t in rows if d is not None}
    label = {d: d for d in sets}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {d: root(d) for d in ids}


def repeated_cover(texts: list[str | None], width: int = 400) -> list[list[tuple[int, int]]]:
    """Maximal removed runs of each text, by counting every string of ``width`` bytes."""
    from collections import Counter

    data = [(t or "").encode() for t in texts]
    counts = Counter(d[i: i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for d in data:
        spans: list[list[int]] = []
        for i in range(len(d) - width + 1):
            if counts[d[i: i + width]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + width
                else:
                    spans.append([i, i + width])
        out.append([tuple(s) for s in spans])
    return out
