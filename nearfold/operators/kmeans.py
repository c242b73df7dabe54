"""Clustering: assignment, Lloyd's iterations, two-level training.

Centroids are a bounded table (clusters times dimensions): they are kept on the driver between iterations, which cuts the
lineage, and sent to the tasks.  Points stay where they are; an iteration moves one partial sum for each cluster and task.
Assignment works on Arrow batches: one matrix product ranks all centroids by |c|**2 - 2 v.c, and the distance itself is taken
of the nearest only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfold.operators.ranks import values_at
from nearfold.session import ship, stored

#: The most values (clusters times dimensions) of a centroid table.
MOST_VALUES = 16 << 20
#: Distances that are worked on at once.
CELLS = 1 << 21


def centroid_frame(spark: SparkSession, centroids: list, coarse: list[int] | None = None) -> DataFrame:
    """(c_id, centroid) of a list of vectors, numbered from 0; with ``coarse`` also the cluster each is under."""
    if sum(map(len, centroids)) > MOST_VALUES:
        raise ValueError("too many centroids to send to every task")
    values = [[float(x) for x in c] for c in centroids]
    if coarse is None:
        return spark.createDataFrame([(i, c) for i, c in enumerate(values)], "c_id int, centroid array<double>")
    return spark.createDataFrame([(i, g, c) for i, (g, c) in enumerate(zip(coarse, values))], "c_id int, coarse_id int, centroid array<double>")


def held_centroids(centroids: DataFrame, dims: int, number: str = "c_id") -> tuple[np.ndarray, np.ndarray]:
    """Numbers in order and centroids of a table of bounded size, on the driver."""
    rows = centroids.select(number, "centroid").limit(MOST_VALUES // dims + 1).collect()
    if len(rows) * dims > MOST_VALUES:
        raise ValueError("too many centroids to send to every task")
    rows.sort(key=lambda r: r[number])
    if any(len(r["centroid"]) != dims for r in rows):
        raise ValueError(f"a centroid hasn't {dims} values")
    return np.array([r[number] for r in rows], np.int64), np.array([r["centroid"] for r in rows], np.float64).reshape(len(rows), dims)


def evenly_spaced(points: DataFrame, k: int) -> DataFrame:
    """(c_id, centroid): the points at places floor(i n / k) by vec_id, for reproducible starts.

    Identifiers are counted in bins and not sorted; the k vectors are fetched by a semi-join and, being a bounded table, go
    through the driver, so that what comes after doesn't search for them again.
    """
    n = points.count()
    if n == 0:
        raise ValueError("no points")
    places = sorted({i * n // k for i in range(k)})
    chosen = values_at(points.select("vec_id"), "vec_id", [], lambda _: [F.lit(p) for p in places]).select(F.col("value").alias("vec_id"), F.col("nth").alias("c_id"))
    rows = points.join(F.broadcast(chosen), "vec_id").select("c_id", F.col("vector").cast("array<double>").alias("centroid")).collect()
    return centroid_frame(points.sparkSession, [r["centroid"] for r in sorted(rows, key=lambda r: r["c_id"])])


def sample_start(points: DataFrame, k: int, seed: int) -> DataFrame:
    """(c_id, centroid): k points drawn at random; all of them if there are fewer."""
    drawn = points.withColumn("__u", F.rand(seed)).orderBy("__u", "vec_id").limit(k)
    return drawn.select((F.row_number().over(Window.orderBy("__u", "vec_id")) - 1).cast("int").alias("c_id"), F.col("vector").cast("array<double>").alias("centroid"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The rows of a column of vectors; a vector of another length or a null is an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if column.null_count or len(flat) != len(column) * dims or (len(column) and (column.value_lengths().to_numpy(zero_copy_only=False) != dims).any()):
        raise ValueError(f"a vector hasn't {dims} values")
    return flat.astype(np.float64).reshape(len(column), dims)


def distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows, added from the first dimension to the last, as the expressions add them."""
    d = np.zeros(np.broadcast_shapes(v.shape[:-1], c.shape[:-1]))
    for i in range(v.shape[-1]):
        x = v[..., i] - c[..., i]
        d += x * x
    return d


def nearest(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place in ``c`` of the nearest row to each of ``v``, ties to the first, and its squared distance."""
    norm = (c * c).sum(axis=1)
    at, d = np.zeros(len(v), np.int64), np.zeros(len(v))
    step = max(1, CELLS // max(1, len(c)))
    for a in range(0, len(v), step):
        part = v[a : a + step]
        rank = norm - 2 * (part @ c.T)
        least = rank.min(axis=1, keepdims=True)
        # The product rounds otherwise than the sum of squares: whatever it can't tell apart is measured.
        near = rank <= least + 1e-12 * (norm.max() + (part * part).sum(axis=1, keepdims=True) + 1)
        best = rank.argmin(axis=1)
        for r in np.flatnonzero(near.sum(axis=1) > 1).tolist():
            some = np.flatnonzero(near[r])
            best[r] = some[distances(part[r], c[some]).argmin()]
        at[a : a + step] = best
        d[a : a + step] = distances(part, c[best])
    return at, d


def assign(points: DataFrame, centroids: DataFrame, dims: int) -> DataFrame:
    """``points`` with c_id, the nearest centroid's number, and its squared distance d; columns of these names are replaced.

    The centroids are sent to the tasks (their size is checked), so nothing is shuffled however many clusters there are.
    """
    ship(points.sparkSession)
    number, c = held_centroids(centroids, dims)
    kept = [f for f in points.schema.fields if f.name.lower() not in ("c_id", "d")]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField("c_id", T.IntegerType()), T.StructField("d", T.DoubleType())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                at, d = nearest(matrix(batch.column("vector"), dims), c)
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(number[at].astype(np.int32)), pa.array(d)], names=[*names, "c_id", "d"])

    return points.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, schema)


def means(assigned: DataFrame, dims: int, by: tuple[str, ...] = ("c_id",)) -> DataFrame:
    """(by, centroid, cnt): the mean of each cluster's points."""
    mean = F.array(*[F.avg(F.get("vector", F.lit(i)).cast("double")) for i in range(dims)])
    return assigned.groupBy(*by).agg(mean.alias("centroid"), F.count(F.lit(1)).alias("cnt"))


def lloyd_step(points: DataFrame, centroids: DataFrame, dims: int) -> DataFrame:
    """(c_id, centroid, moved): the clusters' means, an empty cluster keeping its centroid; moved: the largest change."""
    fresh = means(assign(points, centroids, dims), dims).select("c_id", F.col("centroid").alias("__m"))
    joined = centroids.join(fresh, "c_id", "left").withColumn("__new", F.coalesce("__m", "centroid"))
    moved = F.array_max(F.zip_with("__new", "centroid", lambda a, b: F.abs(a - b)))
    return joined.select("c_id", F.col("__new").alias("centroid"), moved.alias("moved"))


def lloyd(points: DataFrame, start: DataFrame, dims: int, iterations: int = 5, epsilon: float = 1e-6) -> DataFrame:
    """(c_id, centroid) after at most ``iterations`` steps, or when no value moves by epsilon."""
    spark = points.sparkSession
    now = start
    for _ in range(iterations):
        rows = lloyd_step(points, now, dims).orderBy("c_id").collect()
        now = centroid_frame(spark, [r["centroid"] for r in rows])
        if max(r["moved"] for r in rows) < epsilon:
            break
    return now


def _evenly_within(placed: DataFrame, fine: int) -> DataFrame:
    """(coarse_id, nth, vec_id): of each cluster's points those at places floor(i n / fine) by vec_id."""
    chosen = values_at(placed, "vec_id", ["coarse_id"], lambda n: [F.floor(F.lit(i) * n / F.lit(fine)) for i in range(fine)])
    return chosen.groupBy("coarse_id", F.col("value").alias("vec_id")).agg(F.min("nth").alias("nth"))


def _drawn_within(placed: DataFrame, fine: int, seed: int) -> DataFrame:
    w = Window.partitionBy("coarse_id").orderBy("__u", "vec_id")
    drawn = placed.select("coarse_id", "vec_id").withColumn("__u", F.rand(seed)).withColumn("nth", F.row_number().over(w) - 1)
    return drawn.where(F.col("nth") < fine).select("coarse_id", "nth", "vec_id")


def two_level(points: DataFrame, dims: int, coarse: int = 128, fine: int = 64, iterations: int = 5, epsilon: float = 1e-6, seed: int = 42, start: str = "drawn") -> DataFrame:
    """(c_id, coarse_id, centroid): coarse clusters, and ``fine`` clusters of each one's points, numbered through.

    All fine clusterings advance together: a point is compared with the centroids under its coarse cluster only, and a step
    is one aggregation.  A coarse cluster with fewer points than ``fine`` has its points as centroids and zero vectors for
    the rest, an empty one zero vectors only; those stay in the table and can be probed.  start: "drawn" at random by
    ``seed``, or "even", by places in the order of vec_id.
    """
    spark = points.sparkSession
    if coarse * fine * dims > MOST_VALUES:
        raise ValueError("too many centroids to send to every task")
    top = lloyd(points, evenly_spaced(points, coarse) if start == "even" else sample_start(points, coarse, seed), dims, iterations, epsilon)
    # Written once: each fine iteration reads what cluster a point is in and doesn't find it out again.
    placed = stored(assign(points.select("vec_id", F.col("vector").cast("array<double>").alias("vector")), top, dims).select("vec_id", "vector", F.col("c_id").alias("coarse_id")), "placed")
    chosen = _evenly_within(placed, fine) if start == "even" else _drawn_within(placed, fine, seed + 1)
    drawn = placed.join(F.broadcast(chosen), ["coarse_id", "vec_id"]).orderBy("coarse_id", "nth").collect()
    table = np.zeros((coarse, fine, dims))
    size = np.zeros(coarse, np.int64)
    for r in drawn:
        table[r["coarse_id"], size[r["coarse_id"]]] = r["vector"]
        size[r["coarse_id"]] += 1
    schema = "coarse_id int, c_id int, vector array<double>"
    for _ in range(iterations):
        now = table.copy()

        def run(batches, now=now):
            for batch in batches:
                if not batch.num_rows:
                    continue
                group = batch.column("coarse_id").to_numpy(zero_copy_only=False)
                v, own = matrix(batch.column("vector"), dims), np.zeros(len(group), np.int32)
                for g in np.unique(group).tolist():
                    rows = np.flatnonzero(group == g)
                    own[rows] = nearest(v[rows], now[g, : size[g]])[0]
                yield pa.RecordBatch.from_arrays([batch.column("coarse_id"), pa.array(own), batch.column("vector")], names=["coarse_id", "c_id", "vector"])

        found = means(placed.select("coarse_id", "vector").mapInArrow(run, schema), dims, ("coarse_id", "c_id")).collect()
        for r in found:
            table[r["coarse_id"], r["c_id"]] = r["centroid"]
        if np.abs(table - now).max() < epsilon:
            break
    return centroid_frame(spark, table.reshape(coarse * fine, dims).tolist(), np.repeat(np.arange(coarse), fine).tolist())
