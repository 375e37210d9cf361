"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import remove, written


def connected_components(edges: DataFrame) -> DataFrame:
    """The component of every node that has an edge.

    edges: columns u, v (long), in any direction, repeats and loops allowed; nulls are dropped.
    Returns node, root: root is the smallest node of the component. An empty edge table gives no rows.

    Each round points every node at its smallest neighbour, follows that pointer once more, and
    contracts the edges onto the pointers, so chains shrink geometrically and stars vanish in one
    round. A hub's many edges are combined before the shuffle of the aggregation, and the joins that
    read them can be split by adaptive execution. Rounds are cut by written tables.
    """
    spark = edges.sparkSession
    edges = written(edges.where("u <> v").select("u", "v").distinct(), "edges")
    roots = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p"))
        least = written(least, "pointers")
        twice = least.alias("a").join(least.alias("b"), F.col("a.p") == F.col("b.u")).select("a.u", "b.p")
        twice = written(twice, "pointers2")
        if roots is None:
            now = twice.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            now = roots.join(twice, roots["root"] == twice["u"], "left").select(
                "node", F.coalesce("p", "root").alias("root")
            )
        now = written(now, "roots")
        p, q = twice.alias("p"), twice.alias("q")
        contracted = edges.alias("e").join(p, F.col("e.u") == F.col("p.u")).join(q, F.col("e.v") == F.col("q.u"))
        contracted = contracted.select(F.col("p.p").alias("u"), F.col("q.p").alias("v")).where("u <> v").distinct()
        contracted = written(contracted, "edges")
        remove(spark, edges, least, twice, *([] if roots is None else [roots]))
        edges, roots = contracted, now
    if roots is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots
