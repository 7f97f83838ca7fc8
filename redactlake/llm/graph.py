"""Connected components of a table of links, by contraction in random orders."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactlake.llm.common import forget, saved, sized


def components(links: DataFrame) -> DataFrame:
    """links: a, b (longs). Returns node, root: for every node of a link the smallest node that it can be reached from.

    Each round puts the nodes in another order by a hash. A node goes over to its first neighbour, if that comes before itself,
    and from there one step further; the links follow, and links within a node fall away. Whatever the ids are, a node comes
    first among its neighbours in at most every other round on average, so the number of rounds grows with the logarithm of
    the nodes, for paths and stars too. What a round needs is written to the shared folder, and what it has used is deleted.
    First neighbours are found with partial aggregation, so that one node with a very large number of links is no burden for
    a single task. Null ends are no links. An empty table gives an empty result.
    """
    links = saved(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    nodes = saved(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("at")), "nodes", by_size=True)

    def moved(rows: DataFrame, to: DataFrame, c: str) -> DataFrame:
        return rows.join(sized(to).select(F.col("a").alias(c), F.col("to").alias("_to")), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")

    for salt in count():
        if links.isEmpty():
            break

        def place(c: str, salt: int = salt) -> Column:
            return F.xxhash64(F.col(c), F.lit(salt))

        both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min_by("b", place("b")).alias("to"))
        first = saved(first.where(place("to") < place("a")), "first-neighbours", by_size=True)
        to = saved(moved(first, first, "to"), "goes-to", by_size=True)
        used = (links, nodes, first, to)
        nodes = saved(moved(nodes, to, "at"), "nodes", by_size=True)
        links = moved(moved(links, to, "a"), to, "b").where("a <> b")
        links = saved(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links", by_size=True)
        forget(*used)
    nodes = sized(nodes)
    least = nodes.groupBy("at").agg(F.min("node").alias("root"))
    found = saved(nodes.join(least, "at").select("node", "root"), "components", by_size=True)
    forget(links, nodes)
    return found
