"""Connected components over links that stay in the cluster: alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, shared_dir, written

#: Bytes of a link.
WIDTH = 16


def components(links: DataFrame, rounds: int = 40, most: int | None = None) -> DataFrame:
    """(node, component): for every node of the links (a, b), the smallest node that it is linked with, itself included.

    Each round links every node's larger neighbours to its smallest one, then every node's smaller neighbours to the
    smallest; the number of rounds grows with the logarithm of the longest chain. Minima are aggregated before they are
    shuffled, so for them a node with a third of all links is one row of each task; in the joins with the minima such a
    node is a large key, which adaptive execution splits. Each round ends in a written table, and so does the result, but
    for a union; links are read once. `most` is about how many links there may be, if known: it bounds the files. Null
    nodes don't occur; loops and repeated links change nothing; an empty table has no components.
    """
    folder = shared_dir(links.sparkSession)
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    links = written(gathered(links, most and WIDTH * most), "links0", folder)
    size = WIDTH * links.count()
    for r in range(1, rounds + 1):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        large = written(gathered(large, size), f"large{r}", folder)
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select("m", "a", "b")
        small = small.select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), "b"))).alias("x")).select("x.*").filter("a < b").distinct()
        small = written(gathered(small, size), f"links{r}", folder)
        # Stars whose centres are nobody's leaf: every link leads straight to its component.
        if small.select("b").join(small.select(F.col("a").alias("b")), "b", "left_semi").isEmpty() and small.groupBy("b").count().filter("count > 1").isEmpty():
            return small.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(small.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("component")))
        links = small
    raise RuntimeError(f"components aren't settled after {rounds} rounds")
