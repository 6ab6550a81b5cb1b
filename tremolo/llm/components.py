"""Connected components of an edge table by alternating star contractions.

Each round moves every node's links to the smallest node it knows, first over its larger
neighbours, then over its smaller ones. Rounds needed grow with the logarithm of the
longest path; every step is a grouped minimum and an equi-join, so that a hub with very
many links is aggregated before it is shuffled and its join can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolo.llm._store import cut

#: Edges that a task takes, about: few edges go in few tasks, whatever the number of shuffle partitions.
EDGES = 200_000


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, comp) for each node of edges(a, b); comp is the component's smallest node."""
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    tasks = e.count() // EDGES + 1  # no round has more edges
    before = None
    while True:
        e = e.coalesce(tasks)
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks).distinct().coalesce(tasks)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = cut(small.where("u <> v").coalesce(tasks).distinct().coalesce(tasks))
        now = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == before or not now[0]:
            break
        before = now
    return e.toDF("node", "comp").union(e.select("v", "v").distinct()).distinct().coalesce(tasks)
