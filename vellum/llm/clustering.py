"""Clusters of whole-number vectors around centroids, by sort-means.

Each round orders, for each centroid, the others by distance from it. A vector scans them in the order of the centroid
that it was assigned to before, and stops at the first that lies strictly beyond twice the vector's distance to that
centroid: by the triangle inequality neither it nor any after it can be nearer, or as near. All sums and distances are
whole numbers, so results don't depend on how rows are dealt.

Rounds are passes over a table of vectors with their assignments, written once a round; no vector is shuffled. What
comes together from all tasks is a sum a centroid and component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import forget, staged

#: The largest component with which four times a squared distance, over 64 components, fits into 63 bits.
LARGEST = 2**26


def whole(vectors: DataFrame, size: int = 64, scale: int = 256) -> DataFrame:
    """vec_id and v, array<int>: floor(scale * x) of each component x as double, of vectors with exactly ``size``
    components, none of them null, NaN or infinite. A component beyond LARGEST raises."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    finite = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    held = vectors.select("vec_id", x.alias("x")).where((F.size("x") == size) & F.coalesce(finite, F.lit(False)))
    cut = lambda e: F.when(F.abs(F.floor(e * scale).cast("double")) <= LARGEST, F.floor(e * scale)).otherwise(F.raise_error(F.lit("component too large")))
    return held.select("vec_id", F.transform("x", lambda e: cut(e).cast("int")).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: str = "2:") -> np.ndarray:
    """The k vectors with the smallest sha256 of seed and vec_id, in that order; all if there are fewer. Of vectors that
    share an id the smaller comes first; those with a null id come last."""
    key = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(key.alias("key"), "v").orderBy(F.asc_nulls_last("key"), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of a to b (one row, or one for each)."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


class SortMeans:
    """One round's centroids, with the others of each in the order of their distance."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.between = np.array([squared(centroids, c) for c in centroids])
        self.order = np.argsort(self.between, axis=1, kind="stable")

    def assigned(self, v: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each vector (of equally near ones that with the smaller number) and its squared distance."""
        cluster, distance = before.copy(), squared(v, self.centroids[before])
        by = np.argsort(before, kind="stable")
        firsts = np.searchsorted(before[by], np.arange(len(self.centroids) + 1))
        for a in np.flatnonzero(np.diff(firsts)):
            own = by[firsts[a] : firsts[a + 1]]
            reach = 4 * distance[own]
            down = np.argsort(-reach, kind="stable")
            own, reach = own[down], reach[down]
            for c in self.order[a]:
                # rows stop one by one, as the centroids get farther from a and the rows stand by falling reach
                own = own[: np.searchsorted(-reach[: len(own)], -self.between[a, c], "right")]
                if not len(own):
                    break
                if c == a:
                    continue
                d = squared(v[own], self.centroids[c])
                nearer = (d < distance[own]) | (d == distance[own]) & (c < cluster[own])
                cluster[own[nearer]], distance[own[nearer]] = c, d[nearer]
        return cluster, distance


ASSIGNED = "vec_id long, v array<int>, cluster int, distance long"


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vectors (vec_id, v, cluster: that of the round before) with their nearest centroid and squared distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        means = SortMeans(centroids)
        for batch in batches:
            v = batch.column(1)
            flat = v.flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, -1)
            cluster, distance = means.assigned(flat, batch.column(2).to_numpy().astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), v, pa.array(cluster, pa.int32()), pa.array(distance)], ["vec_id", "v", "cluster", "distance"])

    return vectors.select("vec_id", "v", "cluster").mapInArrow(run, ASSIGNED)


def moved(assigned: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid with vectors as floor(sum / count) of their components; the others as they were. Tasks add up their
    own vectors first, so that a row a centroid leaves each."""
    shape = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(shape, np.int64), np.zeros(shape[0], np.int64)
        for batch in batches:
            v = batch.column(0).flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, -1)
            cluster = batch.column(1).to_numpy()
            by = np.argsort(cluster, kind="stable")
            own, first = np.unique(cluster[by], return_index=True)
            if len(own):
                total[own] += np.add.reduceat(v[by], first)
                n += np.bincount(cluster, minlength=len(n))
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(n[own]), pa.array(total[own].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = assigned.select("v", "cluster").mapInArrow(run, "cluster int, n long, sums array<long>")
    sums = parts.select("cluster", "n", F.posexplode("sums").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    out = centroids.copy()
    for cluster, at, n, x in sums.collect():
        out[cluster, at] = x // n
    return out


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, size: int = 64) -> tuple[DataFrame, np.ndarray]:
    """vec_id, v, cluster and distance (squared) of the vectors that ``whole`` keeps, and the centroids, after so many
    rounds of assigning and moving and one more assignment.

    vectors: vec_id and embedding (array of numbers); other columns are ignored. Rows that repeat a vec_id, or have none,
    are vectors of their own. Fewer than k vectors give as many centroids; none give no rows. Of the data the driver
    holds k vectors, and a sum a centroid and component.
    """
    now = staged(whole(vectors, size).withColumn("cluster", F.lit(0)), "vectors")
    centroids = first_centroids(now, k)
    if not len(centroids):
        return now.withColumn("distance", F.lit(0).cast("long")), np.empty((0, size), np.int64)
    for _ in range(rounds):
        done = staged(assign(now, centroids), "assigned")
        forget(now)
        now, centroids = done, moved(done, centroids)
    done = staged(assign(now, centroids), "assigned")
    forget(now)
    return done, centroids


def report(vectors: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector."""
    found, centroids = cluster(vectors)
    spark = vectors.sparkSession
    sums = {c: n for c, n in found.groupBy("cluster").agg(F.sum("distance")).collect()}
    text = [",".join(map(str, c)) for c in centroids.tolist()]
    schema = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType()), T.StructField("text", T.StringType())])
    rows = spark.createDataFrame([(c, n, sum(sums.values()), text[c]) for c, n in sums.items()], schema)
    rows = rows.withColumn("centroid_sha256", F.sha2("text", 256)).drop("text")
    return found.join(F.broadcast(rows), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(k: int = 40, rounds: int = 5) -> str:
    sql = [f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR))) - 1 AS c, v AS m FROM v ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)) LIMIT {k}
)"""]
    for r in range(rounds + 1):
        sql.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, any_value(v) AS v, arg_min(c, d * 100 + c) AS c, min(d) AS d FROM (
    SELECT vec_id, v, c, CAST(list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v, c{r}
  ) GROUP BY vec_id
)""")
        if r < rounds:
            sql.append(f"""s{r} AS (
  SELECT c, i, CAST(floor(sum(x) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS x FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY c, i
), c{r + 1} AS MATERIALIZED (
  SELECT c, coalesce(any_value(n.m), any_value(o.m)) AS m FROM c{r} o LEFT JOIN (SELECT c, list(x ORDER BY i) AS m FROM s{r} GROUP BY c) n USING (c) GROUP BY c
)""")
    return ", ".join(sql) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (c)
"""
