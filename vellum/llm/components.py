"""Connected components of an edge table, by alternating large stars and small stars until nothing moves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import forget, staged


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and root, the smallest node reachable, for every node of edges (u, v: long) but the roots themselves.

    Each round takes hot nodes apart by partial aggregation and adaptive joins; its edges are written to the shared
    folder, which also cuts the lineage. Loops and repeated edges do no harm; no edges give no rows.
    """
    stars = staged(edges.select("u", "v").where("u <> v").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        last, stars = stars, staged(small.where("u <> v").distinct(), "stars")
        forget(last)
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"the components are not found after {most_rounds} rounds")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
