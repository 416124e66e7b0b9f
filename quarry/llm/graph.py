"""Connected components of a graph given by its links, without bringing nodes or links to the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common

#: Links that one task is given at least; small graphs would spend their time on starting tasks.
TASK_LINKS = 100_000


def components(links: DataFrame) -> DataFrame:
    """node, comp (the smallest node of its component) for every node of links(a, b).

    Each round every node with a smaller neighbour points to the smallest one, chains of pointers are followed to
    their roots, and the links between roots remain: their number falls by a constant factor or more a round.
    """
    edges = common.cut(_between(links, "a", "b"))
    tasks = 1 + edges.count() // TASK_LINKS

    def cut(df: DataFrame) -> DataFrame:
        return common.cut(df.coalesce(tasks))

    edges = cut(edges)
    labels = cut(edges.select(F.col("hi").alias("node")).union(edges.select("lo")).distinct().withColumn("comp", F.col("node")))
    while not edges.isEmpty():
        parents = _roots(cut(edges.groupBy("hi").agg(F.min("lo").alias("lo"))), cut)
        labels = cut(_follow(labels, "comp", parents))
        edges = cut(_between(_follow(_follow(edges, "hi", parents), "lo", parents), "hi", "lo"))
    return labels


def _between(links: DataFrame, a: str, b: str) -> DataFrame:
    return links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()


def _follow(rows: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """rows with column replaced by its root, where it has one."""
    found = parents.select(F.col("hi").alias("__hi"), F.col("lo").alias("__lo"))
    return rows.join(found, rows[column] == F.col("__hi"), "left").withColumn(column, F.coalesce("__lo", column)).select(*rows.columns)


def _roots(parents: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pointers doubled until all lead to roots; they go down in the order of nodes, so there are no circles."""
    while True:
        longer = cut(_follow(parents.withColumn("was", F.col("lo")), "lo", parents))
        parents = longer.select("hi", "lo")
        if longer.where("lo <> was").isEmpty():
            return parents
