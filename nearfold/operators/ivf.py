"""An inverted-file index: quantized vectors by partition, and approximate search in the nearest partitions.

Two metrics meet in a search, on purpose: partitions are chosen by the raw query against raw centroids, candidates by
quantized query against quantized vectors.  In the second one "nothing known" (255) is *nearest* to 1.0 (254), although it
is farthest from it (-1 and 1) in exact search.  Centroids are kept in single precision, and queries in double.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from nearfold.functions import expressions as X
from nearfold.operators import kmeans, knn
from nearfold.operators.knn import check_k, sent, top_k
from nearfold.operators.scoring import running_offsets
from nearfold.session import ship, stored
from nearfold.sources.files import read_binary_ids, read_binary_index, write_binary_ids, write_binary_index

PROBES = 8
PROBES_ENV = "IVF_PROBE_COUNT"
#: Directories of a written index: lists are clustered by partition within this many of them.
FOLDERS = 128
#: Vectors that a file of a written index should have.
FILE_VECTORS = 4_000_000


def probe_count(probes: int = 0) -> int:
    """A positive argument; else a positive whole number in the environment; else 8."""
    if probes > 0:
        return probes
    text = os.environ.get(PROBES_ENV, "")
    return int(text) if text.isascii() and text.isdigit() and int(text) > 0 else PROBES


@dataclass
class Index:
    """centroids(part_id, centroid, byte_offset, cnt) with empty partitions kept, lists(part_id, folder, vec_id, levels, label)."""

    centroids: DataFrame
    lists: DataFrame
    dims: int

    def check(self) -> Index:
        need = {"centroids": {"part_id", "centroid", "byte_offset", "cnt"}, "lists": {"part_id", "vec_id", "levels", "label"}}
        for name, columns in need.items():
            if missing := columns - set(getattr(self, name).columns):
                raise ValueError(f"{name} has no {sorted(missing)}")
        if self.centroids.where(F.size("centroid") != self.dims).take(1):
            raise ValueError(f"a centroid hasn't {self.dims} values")
        return self

    def partition_count(self) -> int:
        return self.centroids.count()

    def vector_count(self) -> int:
        return self.centroids.agg(F.coalesce(F.sum("cnt"), F.lit(0))).first()[0]

    def partition(self, part_id: int) -> tuple[list[float], int, int]:
        """A partition's centroid, byte offset and count; zeros for a number that there is none of."""
        row = self.centroids.where(F.col("part_id") == part_id).first()
        return (list(row["centroid"]), row["byte_offset"], row["cnt"]) if row else ([0.0] * self.dims, 0, 0)

    def vector_at(self, part_id: int, place: int) -> list[int]:
        """The levels of a partition's vector at a place in the order of their numbers, from 0; an IndexError if there is none."""
        return list(self._at(part_id, place)["levels"])

    def label_at(self, part_id: int, place: int) -> str:
        """The label of the same."""
        return X.FRAUD if self._at(part_id, place)["label"] == 1 else X.LEGIT

    def _at(self, part_id: int, place: int):
        own = self.lists.where((F.col("folder") == part_id % FOLDERS) & (F.col("part_id") == part_id))
        rows = own.orderBy("vec_id").limit(place + 1).offset(place).collect() if place >= 0 else []
        if not rows:
            raise IndexError(f"partition {part_id} has no vector {place}")
        return rows[0]

    def vectors(self, part_id: int) -> DataFrame:
        return self.lists.where(F.col("part_id") == part_id).select("vec_id", "levels", X.label_text(F.col("label")).alias("label"))

    def settled(self) -> Index:
        """The same index, written to the shared folder once, so that searches read it and don't build it again."""
        return Index(stored(self.centroids, "centroids"), stored(self.lists, "lists"), self.dims)

    def cache(self) -> Index:
        self.centroids.cache()
        self.lists.cache()
        return self

    def close(self) -> None:
        self.centroids.unpersist()
        self.lists.unpersist()


def partition_sizes(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """(part_id, cnt) of every partition, empty ones with 0."""
    counts = assigned.groupBy(F.col("c_id").alias("part_id")).agg(F.count(F.lit(1)).alias("__n"))
    return centroids.select(F.col("c_id").alias("part_id"), "centroid").join(counts, "part_id", "left").select("part_id", "centroid", F.coalesce("__n", F.lit(0)).cast("long").alias("cnt"))


def build(references: DataFrame, centroids: DataFrame, dims: int) -> Index:
    """The index of references(vec_id, vector, label) with centroids(c_id, centroid)."""
    assigned = kmeans.assign(references, centroids, dims)
    centroids = centroids.withColumn("centroid", F.col("centroid").cast("array<float>"))
    sizes = partition_sizes(assigned, centroids)
    meta = running_offsets(sizes, "part_id", F.col("cnt") * F.lit(dims)).select("part_id", "centroid", "byte_offset", "cnt")
    lists = assigned.select(F.col("c_id").alias("part_id"), F.pmod("c_id", F.lit(FOLDERS)).alias("folder"), "vec_id", X.quantize(F.col("vector")).alias("levels"), X.label_code(F.col("label")).alias("label"))
    return Index(meta, lists, dims)


def clustered(lists: DataFrame, vectors: int) -> DataFrame:
    """Lists with the vectors of a partition together, in the order of their numbers.

    A folder is cut into as many pieces by part_id as give files of FILE_VECTORS, and a task makes one of them.
    """
    pieces = max(1, -(-vectors // (FILE_VECTORS * FOLDERS)))
    piece = F.pmod(F.floor(F.col("part_id") / FOLDERS), F.lit(pieces))
    return lists.repartition(FOLDERS * pieces, "folder", piece).sortWithinPartitions("folder", "part_id", "vec_id")


def write(index: Index, path: str) -> None:
    """Parquet: lists in folders, sorted by partition, so that a search reads the row groups of what it probes."""
    index.centroids.coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    clustered(index.lists, index.vector_count()).write.mode("overwrite").partitionBy("folder").parquet(f"{path}/lists")


def from_binary(spark: SparkSession, path: str, dims: int = 14) -> Index:
    """The searchable index of a binary index file; vec_id is what the file beside it says, or else the place in the file."""
    centroids, counts, levels, labels = read_binary_index(path, dims)
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    if offsets[-1] != len(labels):
        raise ValueError("the partitions' counts don't add up to the vectors")
    meta = [(i, c, int(o) * dims, int(n)) for i, (c, o, n) in enumerate(zip(centroids.tolist(), offsets, counts))]
    part = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, len(labels) * dims + 1, dims, dtype=np.int32)), pa.array(levels.reshape(-1).astype(np.int32)))
    table = pa.table({"part_id": part, "folder": (part % FOLDERS).astype(np.int32), "vec_id": read_binary_ids(path, len(labels)), "levels": flat, "label": (labels == 1).astype(np.int32)})
    return Index(spark.createDataFrame(meta, "part_id int, centroid array<float>, byte_offset long, cnt long"), spark.createDataFrame(table), dims).check()


def to_binary(index: Index, path: str) -> None:
    """Writes the binary index file of an index, whose offsets must fit in 32 bits; partition by partition through the driver.

    Whole-number vec_ids, by which ties are settled, are written to a file beside it.
    """
    meta = index.centroids.orderBy("part_id").collect()
    if [r["part_id"] for r in meta] != list(range(len(meta))):
        raise ValueError("partitions aren't numbered through from 0")
    rows = index.lists.select("part_id", "vec_id", "levels", "label").orderBy("part_id", "vec_id")
    ids = []

    def parts():
        for some in _in_lots(rows.toLocalIterator(), 100_000):
            ids.append([r["vec_id"] for r in some])
            yield np.array([r["levels"] for r in some], np.uint8), np.array([r["label"] for r in some], np.uint8)

    write_binary_index(path, np.array([r["centroid"] for r in meta], np.float32).reshape(len(meta), index.dims), np.array([r["cnt"] for r in meta], np.int64), parts())
    if isinstance(rows.schema["vec_id"].dataType, IntegralType):
        write_binary_ids(path, np.array([i for some in ids for i in some], np.int64))


def _in_lots(rows, size: int):
    lot = []
    for r in rows:
        lot.append(r)
        if len(lot) == size:
            yield lot
            lot = []
    if lot:
        yield lot


def load(spark: SparkSession, path: str, dims: int) -> Index:
    return Index(spark.read.parquet(f"{path}/centroids"), spark.read.parquet(f"{path}/lists"), dims).check()


def probe(queries: DataFrame, index: Index, probes: int = 0) -> DataFrame:
    """(q_id, rank, part_id, distance): the partitions whose centroids are nearest to the raw query, ties to the lower.

    Each query is compared with all centroids, which are sent to the tasks, where it is read; nothing is shuffled or sorted
    but the distances of one query.
    """
    ship(queries.sparkSession)
    number, c = kmeans.held_centroids(index.centroids, index.dims, "part_id")
    n = min(probe_count(probes), len(number))
    kind = queries.schema["q_id"].dataType.simpleString()
    dims = index.dims

    def run(batches):
        for batch in batches:
            v = kmeans.matrix(batch.column("vector"), dims)
            step = max(1, kmeans.CELLS // max(1, len(c)))
            for a in range(0, len(v), step):
                d = kmeans.distances(v[a : a + step, None, :], c[None, :, :])
                if n < len(c):
                    # Those at the last distance that counts may be more than are wanted: the lowest numbers are.
                    limit = np.partition(d, n - 1, axis=1)[:, n - 1 : n]
                    row, col = np.nonzero(d <= limit)
                else:
                    row, col = (x.reshape(-1) for x in np.indices(d.shape))
                order = np.lexsort((col, d[row, col], row))
                row, col = row[order], col[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                row, col, rank = row[rank < n], col[rank < n], rank[rank < n]
                yield pa.RecordBatch.from_arrays([batch.column("q_id").take(pa.array(a + row)), pa.array((rank + 1).astype(np.int32)), pa.array(number[col].astype(np.int32)), pa.array(d[row, col])], names=["q_id", "rank", "part_id", "distance"])

    return queries.select("q_id", "vector").mapInArrow(run, f"q_id {kind}, rank int, part_id int, distance double")


def _chosen(queries: DataFrame, index: Index, probes: int, expand_to: int) -> DataFrame:
    """(q_id, part_id): the partitions that each query searches; see candidates."""
    chosen = probe(queries, index, index.partition_count() if expand_to else probes)
    if expand_to:
        w = Window.partitionBy("q_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
        sized = chosen.join(F.broadcast(index.centroids.select("part_id", "cnt")), "part_id")
        chosen = sized.withColumn("__b", F.coalesce(F.sum("cnt").over(w), F.lit(0))).where((F.col("rank") <= probe_count(probes)) | (F.col("__b") < expand_to))
    return chosen.select("q_id", "part_id")


def candidates(queries: DataFrame, index: Index, probes: int = 0, expand_to: int = 0) -> DataFrame:
    """(q_id, vec_id, label, levels, distance) of all vectors in the probed partitions, by quantized distance.

    The probed pairs are joined to the lists on their partition (and folder, which prunes directories at run time).
    expand_to: probes on, nearest first, until the partitions hold that many vectors; off by default, so a search may find
    fewer than k.
    """
    q = queries.select("q_id", X.quantize(F.col("vector")).alias("__q"))
    wanted = _chosen(queries, index, probes, expand_to).join(q, "q_id").withColumn("folder", F.pmod("part_id", F.lit(FOLDERS)))
    d = X.squared_l2(F.col("__q"), F.col("levels"), index.dims, "long")
    # The side with the probes is small: a row of a few numbers for each probe of each query.
    return index.lists.join(sent(wanted, index.dims), ["folder", "part_id"]).select("q_id", "vec_id", F.col("label").alias("code"), "levels", d.alias("distance"))


def _blocks(queries: DataFrame, index: Index, k: int, probes: int, expand_to: int, n: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """(q_id, vec_id, code, distance, carried) of what can be among the k nearest, of ``n`` queries.

    A partition's queries and vectors meet in one task, or block by block where they are many; each passes on k rows for each
    query.  Only folders and partitions that some query searches are read.
    """
    chosen, block = _chosen(queries, index, probes, expand_to), knn.SENT_BYTES
    if n * (8 * index.dims + 16) > block:
        chosen = stored(chosen, "probes")
    asked = {r["part_id"]: r["count"] for r in chosen.groupBy("part_id").count().collect()}
    held = {r["part_id"]: r["cnt"] for r in index.centroids.select("part_id", "cnt").collect()}
    work = max(knn.WORK, sum(m * held[p] for p, m in asked.items()) * index.dims // knn.SPREAD)
    plan, cells = [], 0
    for p, m in sorted(asked.items()):
        a, b = knn.pieces(m, held[p], index.dims, block, work, knn.COPY_BYTES // len(asked))
        plan.append((p, a, b, cells))
        cells += a * b
    plan = F.broadcast(queries.sparkSession.createDataFrame(plan, "part_id int, __a int, __b int, __first int"))
    spread = lambda by, of_queries: knn.cell(F.col("__first"), F.col("__a"), F.col("__b"), by, of_queries)
    wanted = chosen.join(queries.select("q_id", X.quantize(F.col("vector")).alias("vector")), "q_id").join(plan, "part_id")
    lists = index.lists.where(F.col("folder").isin(sorted({p % FOLDERS for p in asked})) & F.col("part_id").isin(sorted(asked))).join(plan, "part_id")
    # The kernel's sums of squared levels are whole numbers far below 2**53.
    left, right = wanted.select("q_id", "vector", spread("q_id", True)), lists.select("vec_id", F.col("label").alias("code"), F.col("levels").alias("vector"), *carried, spread("vec_id", False))
    return knn.nearest_in_cells(left, right, k, index.dims, max(1, cells), distance="long")


def _nearest(queries: DataFrame, index: Index, k: int, probes: int, expand_to: int, strategy: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """(q_id, rank, vec_id, code, distance, carried); see search_labels."""
    check_k(k)
    n, parts = queries.count(), max(1, index.partition_count())
    pairs = n * (index.vector_count() * min(probe_count(probes), parts) / parts + expand_to)
    if strategy == "blocks" or pairs > knn.PAIRS:
        return top_k(_blocks(queries, index, k, probes, expand_to, n, carried), k)
    return top_k(candidates(queries, index, probes, expand_to).select("q_id", "vec_id", "code", "distance", *carried), k)


def search_labels(queries: DataFrame, index: Index, k: int = 5, probes: int = 0, expand_to: int = 0, strategy: str = "columns") -> DataFrame:
    """(q_id, rank, vec_id, distance, label): the k nearest candidates; levels aren't turned back into values.

    strategy "columns" is a join and an unrolled expression, a row for each candidate; "blocks" compares a partition's
    vectors with the queries that search it on arrays, and so does "columns" beyond knn.PAIRS.  Both give the same rows.
    """
    found = _nearest(queries, index, k, probes, expand_to, strategy)
    return found.select("q_id", "rank", "vec_id", "distance", X.label_text(F.col("code")).alias("label"))


def search(queries: DataFrame, index: Index, k: int = 5, probes: int = 0, expand_to: int = 0, strategy: str = "columns") -> DataFrame:
    """As search_labels, with each neighbour's ``vector`` put back from its levels (which loses a little)."""
    found = _nearest(queries, index, k, probes, expand_to, strategy, ("levels",))
    return found.select("q_id", "rank", "vec_id", "distance", X.label_text(F.col("code")).alias("label"), X.dequantize(F.col("levels")).alias("vector"))
