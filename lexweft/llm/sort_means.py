"""Centroid clustering by sort-means, in whole numbers.

Each round orders, for every centroid, the others by their distance from it. A
vector starts at the centroid it was assigned to last and scans that centroid's
list: one that is strictly farther from it than twice the vector's own distance
can't be nearer to the vector, nor as near, and neither can those behind it, so
the scan stops there. What it finds is the nearest of all centroids, of equal ones
that of the smallest number.

Components become floor(``scale`` * x), and distances and sums are of whole
numbers, so results depend neither on the order of rows nor on partitions.
Vectors are written once a round together with their assignment, as small
whole numbers, and a round's table goes when the next is written; each task adds
up its vectors per centroid. The driver holds ``k`` centroids and sums.

Defined results for odd input: vectors that are null, of another length, or with
null, infinite or NaN components are left out; one with a whole number of 2^26 or
more, whose distances might not fit a long, is an error. Rows that repeat a
vec_id are vectors of their own; a null vec_id is never a first centroid unless
there are no others. With fewer than ``k`` vectors there are as many centroids. Other columns are
ignored. An empty table gives an empty result.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweft.llm.common import bound_batches, table
from lexweft.sources.shared import discard, write_shared

#: Whole numbers below this have distances whose fourfold fits a long, for up to 64 components or so.
LARGEST = 1 << 26
OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def whole_vectors(df: DataFrame, column: str = "embedding", dims: int = 64, scale: int = 1024) -> DataFrame:
    """``(vec_id, v)`` of the rows whose vector has ``dims`` finite components, v in whole numbers."""
    x = F.col(column)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    good = df.where(x.isNotNull() & (F.size(x) == dims) & finite)
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    fits = F.forall(whole, lambda c: F.abs(c) < LARGEST)
    message = F.concat(F.lit("vector "), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")), F.lit(f" has a component of {LARGEST} or more"))
    return good.select(F.col("vec_id").cast("long"), F.when(fits, whole.cast("array<int>")).otherwise(F.raise_error(message)).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``seed:vec_id``, in that order; equal ids by their components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(key.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def nearest(x: np.ndarray, last: np.ndarray, centroids: np.ndarray):
    """``(number, squared distance)`` of the centroid nearest to each row of ``x``, scanned from its ``last`` one."""
    between = ((centroids[:, None] - centroids[None]) ** 2).sum(2)
    order = between.copy()
    np.fill_diagonal(order, -1)  # itself, then the others
    order = np.argsort(order, axis=1, kind="stable")[:, 1:]
    own = ((x - centroids[last]) ** 2).sum(1)
    best, least, going = last.copy(), own.copy(), np.arange(len(x))
    for place in range(order.shape[1]):
        other = order[last[going], place]
        # Squares: beyond twice the distance is above four times its square.
        within = between[last[going], other] <= 4 * own[going]
        going, other = going[within], other[within]
        if not len(going):
            break
        found = ((x[going] - centroids[other]) ** 2).sum(1)
        better = (found < least[going]) | ((found == least[going]) & (other < best[going]))
        best[going[better]], least[going[better]] = other[better], found[better]
    return best, least


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vectors`` (vec_id, v, cluster) with ``cluster`` and ``distance`` by ``centroids``."""
    dims = centroids.shape[1]

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
            best, least = nearest(x, batch.column(2).to_numpy().astype(np.int64), centroids)
            columns = [batch.column(0), batch.column(1), pa.array(best.astype(np.int32)), pa.array(least)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "cluster", "distance"])

    return vectors.select("vec_id", "v", "cluster").mapInArrow(run, "vec_id long, v array<int>, cluster int, distance long")


def moved(assignment: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid as the floored mean of its vectors; one without any stays."""
    k, dims = centroids.shape

    def add(batches):
        sums, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            of = batch.column(1).to_numpy()
            for c in np.unique(of):
                sums[c] += x[of == c].sum(0, dtype=np.int64)
            n += np.bincount(of, minlength=k)
        some = np.flatnonzero(n)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * dims), pa.array(sums[some].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), lists], names=["cluster", "n", "sums"])

    # As many rows as centroids from a task; sums as decimals, which don't overflow however many tasks there are.
    parts = assignment.select("v", "cluster").mapInArrow(add, "cluster int, n long, sums array<long>")
    each = parts.select("cluster", "n", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i")
    out = centroids.copy()
    for row in each.agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():  # a row for each component of a centroid
        out[row.cluster, row.i] = int(row.s) // row.n
    return out


def sort_means(df: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3, scale: int = 1024, column: str = "embedding"):
    """``(assignment, centroids)``: ``(vec_id, v, cluster, distance)`` by the centroids after ``rounds`` rounds."""
    spark = df.sparkSession
    bound_batches(spark)
    now, path = write_shared(whole_vectors(df, column, dims, scale).withColumn("cluster", F.lit(0)), "vectors")
    centroids = first_centroids(now, k, seed)
    for step in range(rounds + 1 if len(centroids) else 0):
        before = path
        now, path = write_shared(assigned(now, centroids), f"round-{step}")
        discard(spark, before)
        if step < rounds:
            centroids = moved(now, centroids)
    return now, centroids


def op12_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    assignment, centroids = sort_means(table(spark, sf_dir, "embeddings"))
    if not len(centroids):
        return spark.createDataFrame([], OUT)
    inertia = {r.cluster: int(r.s) for r in assignment.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    rows = [
        (no, inertia.get(no, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest())
        for no, c in enumerate(centroids)
    ]
    named = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows
    return assignment.drop("v").join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3, scale: int = 1024) -> str:
    apart = "list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, v, no, d FROM (
    SELECT x.vec_id, x.v, c.no, {apart} AS d,
           row_number() OVER (PARTITION BY x.vec_id ORDER BY {apart}, c.no) AS nth
    FROM whole x, c{r} c) WHERE nth = 1)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c.no, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
    SELECT no, list(mean ORDER BY i) AS v FROM (
      SELECT no, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS mean FROM (
        SELECT no, i, sum(e)::HUGEINT AS s, count(*) AS n FROM (
          SELECT no, unnest(v) AS e, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY no, i)) GROUP BY no) m USING (no))""")
    last, final = f"a{rounds}", f"c{rounds}"
    return f"""
WITH whole AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS no, v FROM whole ORDER BY 1 LIMIT {k}
), {", ".join(steps)}
SELECT vec_id, no::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY no))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string({final}.v, ',')) AS centroid_sha256
FROM {last} JOIN {final} USING (no)
"""


QUERIES = {"op12_sort_means": op12_sort_means}
ORACLES = {"op12_sort_means": _sql()}
