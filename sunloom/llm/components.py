"""Connected components of a table of links, by contraction: no task sees a whole component, nothing goes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunloom.llm.common import staged


def components(links: DataFrame, folder: str, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node in `links`; the root is the smallest node of its component.

    Every round hooks each node that has a smaller neighbour to the smallest one, and rewrites links and labels through
    these hooks; links between hooked nodes keep chains together, so chains halve each round. Links shrink until none is
    left: rounds grow with the logarithm of the longest chain. Links with a null end are ignored, links from a node to itself
    only make it known; an empty table gives an empty table.
    """
    links = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    nodes = links.select(F.explode(F.array("x", "y")).alias("node")).distinct()
    labels = staged(nodes.withColumn("root", F.col("node")), folder, "labels-0")
    links = staged(links.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), folder, "links-0")
    step = 0
    while not links.isEmpty():
        step += 1
        hooks = staged(links.groupBy(F.col("x").alias("from")).agg(F.min("y").alias("to")), folder, f"hooks-{step}")
        left, right = hooks.toDF("x", "x2"), hooks.toDF("y", "y2")
        moved = links.join(left, "x").join(right, "y", "left").select(F.col("x2").alias("x"), F.coalesce("y2", "y").alias("y"))
        moved = moved.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
        labels = staged(labels.join(hooks.toDF("root", "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")),
                        folder, f"labels-{step}")
        links = staged(moved, folder, f"links-{step}")
    return labels
