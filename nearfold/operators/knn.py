"""Exact nearest neighbours of many queries at once."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfold.functions import expressions as X
from nearfold.operators.kmeans import matrix
from nearfold.operators.nearest import k_nearest
from nearfold.session import ship

#: Bytes of queries that are sent to every task, and of either side of a block.
SENT_BYTES = 64 << 20
#: Pairs of queries and references that are formed as rows; more are compared on arrays, block by block.
PAIRS = 1 << 22
#: Values (pairs times dimensions) that a pair of blocks should compare, and how many pairs of blocks there are for that at most.
WORK, SPREAD = 4_000_000_000, 96
#: For that, rows are copied so many times at most on average, or as often as fits in so many bytes.
COPIES, COPY_BYTES = 8, 512 << 20


def check_k(k: int, n: int | None = None) -> None:
    if k <= 0:
        raise ValueError(f"k must be positive, got {k}")
    if n is not None and n == 0:
        raise ValueError("no references")
    if n is not None and k > n:
        raise ValueError(f"k is {k}, but there are {n} references")


def top_k(pairs: DataFrame, k: int, by: str = "q_id", order: tuple[str, ...] = ("distance", "vec_id")) -> DataFrame:
    """The first k rows of each group in a total order, with their ``rank``; cut down on the map side first."""
    w = Window.partitionBy(by).orderBy(*order)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def sent(queries: DataFrame, dims: int) -> DataFrame:
    """Queries with a broadcast hint if they are small enough."""
    return F.broadcast(queries) if queries.count() * (8 * dims + 16) <= SENT_BYTES else queries


def exact_knn(queries: DataFrame, references: DataFrame, k: int = 5, dims: int = 14, strategy: str = "columns", distance: Column | None = None, checked: bool = True) -> DataFrame:
    """(q_id, rank, vec_id, distance, label): the k nearest of ``references(vec_id, vector, label)`` to each query.

    Ties go to the lower vec_id.  strategy "columns" is an unrolled expression over broadcast queries, a row for each pair;
    "blocks" compares arrays and passes on k rows for each query and block, see block_join, and so does "columns" beyond
    PAIRS.  Both add in the same order and give the same bits.  checked: k references at least must be there.
    """
    check_k(k)
    n = references.count()
    if checked and n < k:
        check_k(k, n)
    if distance is None and (strategy == "blocks" or queries.count() * n > PAIRS):
        return top_k(block_join(queries, references, k, dims), k).select("q_id", "rank", "vec_id", "distance", "label")
    q = sent(queries.select("q_id", F.col("vector").alias("__q")), dims)
    d = distance if distance is not None else X.squared_l2(F.col("__q"), F.col("vector"), dims)
    pairs = references.select("vec_id", "vector", "label").crossJoin(q).select("q_id", "vec_id", "label", d.alias("distance"))
    return top_k(pairs, k).select("q_id", "rank", "vec_id", "distance", "label")


def pieces(queries: int, references: int, dims: int, block_bytes: int, work: int, copy_bytes: int) -> tuple[int, int]:
    """How many blocks to cut queries and references into: each in ``block_bytes``, and ``work`` for each pair of blocks.

    Every block of one side is copied for each of the other, so ``work`` counts only while copies stay within COPIES or
    ``copy_bytes``.  Queries are cut rather: among more references a search leaves out more of them.
    """
    size = 8 * dims + 16
    a, b = (int(n * size // block_bytes) + 1 for n in (queries, references))
    most = max(copy_bytes, COPIES * (queries + references) * size)
    while a * b * work < queries * references * dims:
        x, y = (a + 1, b) if 4 * b * queries >= a * references else (a, b + 1)
        if (x * references + y * queries) * size > most:
            break
        a, b = x, y
    return a, b


def block_join(queries: DataFrame, references: DataFrame, k: int, dims: int, block_bytes: int | None = None) -> DataFrame:
    """(q_id, vec_id, label, distance) of what can be among the k nearest: each block of queries meets each of references.

    Both sides are cut into blocks that fit in a task by hashes of their numbers; queries are copied once for each block of
    references and the other way round, and each pair of blocks passes on k rows for each query, so the final ranking
    sees k rows for each query and block of references.
    """
    n, m = queries.count(), references.count()
    a, b = pieces(n, m, dims, block_bytes or SENT_BYTES, max(WORK, n * m * dims // SPREAD), COPY_BYTES)
    left = queries.select("q_id", "vector", cell(F.lit(0), F.lit(a), F.lit(b), "q_id", True))
    right = references.select("vec_id", "vector", "label", cell(F.lit(0), F.lit(a), F.lit(b), "vec_id", False))
    return nearest_in_cells(left, right, k, dims, a * b)


def cell(first: Column, a: Column, b: Column, by: str, of_queries: bool) -> Column:
    """The numbers from ``first`` on of the pairs of blocks, of a x b, that a row belongs to: all that have its own block."""
    own = F.pmod(F.xxhash64(by), a if of_queries else b)
    places = F.sequence(F.lit(0), (b if of_queries else a) - 1)
    spot = (lambda j: first + own * b + j) if of_queries else (lambda j: first + j * b + own)
    return F.explode(F.transform(places, lambda j: spot(j).cast("int"))).alias("__cell")


def nearest_in_cells(queries: DataFrame, references: DataFrame, k: int, dims: int, cells: int, vector: str = "vector", distance: str = "double") -> DataFrame:
    """(q_id, columns of references but for ``__cell``, distance): of each query the k nearest references of its cell.

    ``queries(q_id, vector, __cell)`` and ``references(vec_id, .., __cell)``; cells must fit in a task.  Ties go to the lower
    vec_id.  A column named "vector" isn't passed on.
    """
    ship(queries.sparkSession)
    carried = [f for f in references.schema.fields if f.name not in ("__cell", "vector")]
    schema = T.StructType([queries.schema["q_id"], *carried, T.StructField("distance", T.DoubleType() if distance == "double" else T.LongType())])
    names, kind = [f.name for f in carried], pa.float64() if distance == "double" else pa.int64()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pc.sort_indices(right, sort_keys=[("vec_id", "ascending")], null_placement="at_start"))
        a, b, d = k_nearest(matrix(left.column("vector"), dims), matrix(right.column(vector), dims), k)
        a, b = pa.array(a), pa.array(b)
        return pa.table({"q_id": left.column("q_id").take(a)} | {n: right.column(n).take(b) for n in names} | {"distance": pa.array(d).cast(kind)})

    # More partitions than cells, since those that hashes put together wait for each other.
    n = min(3 * cells, max(cells, 2000))
    both = (df.repartition(n, "__cell").groupBy("__cell") for df in (queries, references))
    return next(both).cogroup(next(both)).applyInArrow(run, schema)
