"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.storage import staged


def _spread(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Each vertex takes the smallest label among its own, its neighbours' and that label's."""
    near = links.join(labels, links["dst"] == labels["vertex"]).select(
        F.col("src").alias("vertex"), "label"
    )
    best = labels.unionByName(near).groupBy("vertex").agg(F.min("label").alias("label"))
    above = labels.select(F.col("vertex").alias("label"), F.col("label").alias("above"))
    return best.join(above, "label", "left").select(
        "vertex", F.least("label", F.coalesce("above", "label")).alias("label")
    )


def both_ways(links: DataFrame) -> DataFrame:
    """Links (a, b) as distinct directed edges (src, dst)."""
    return links.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(
        links.select("b", "a")
    ).distinct()


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(vertex, label) of every vertex of ``links`` (a, b): the smallest vertex it can reach.

    Labels spread over the links, and each round also follows the label's own label, so the number
    of rounds grows with the logarithm of a component's diameter. Every round is written to the
    shared folder. With ``rounds`` it stops early: equal labels then still mean one component, and
    a component may have several labels. An empty table gives an empty one.
    """
    edges = staged(both_ways(links), "edges")
    labels = staged(
        edges.groupBy(F.col("src").alias("vertex")).agg(F.min("dst").alias("label"))
        .select("vertex", F.least("vertex", "label").alias("label")),
        "labels",
    )
    done = 0
    while rounds is None or done < rounds:
        spread = staged(_spread(edges, labels), "labels")
        done += 1
        if rounds is None or done < rounds:
            moved = spread.join(labels.withColumnRenamed("label", "old"), "vertex").where("label <> old")
            if moved.isEmpty():
                return spread
        labels = spread
    return labels
