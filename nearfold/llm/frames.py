"""DataFrame helpers that the operators share: cutting lineage, identifier filters, connected components."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfold.session import cut, new_folder, stored

__all__ = ["IdFilter", "connected_components", "cut", "keep_candidates", "new_folder", "packed", "row_bytes", "stored", "unused", "verified_edges", "whole_groups", "with_leader", "with_owned_leader"]

#: Largest number of bits of an identifier filter (16 MB); with more identifiers it only lets more rows through.
FILTER_BITS = 1 << 27


class IdFilter:
    """A bitmap of identifiers of fixed greatest size, for dropping rows before a join.

    It never drops an identifier that was put in, so the join after it decides; its size doesn't grow past
    ``FILTER_BITS`` with the data.  hashed: the identifiers are hashes already, and are looked up by ``has_hashed``.
    """

    def __init__(self, ids: DataFrame, column: str, hashed: bool = False):
        self.column, self.hashed = column, hashed
        n = ids.count()
        self.bits = int(min(FILTER_BITS, max(1 << 16, 1 << (16 * n).bit_length())))
        bucket, position = self._spot()
        parts = ids.select(bucket.alias("b"), position.alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).collect()
        bitmap = np.zeros(((self.bits >> 15) + 1, 4096), np.uint8)
        for part in parts:
            bitmap[part["b"]] = np.frombuffer(bytes(part["m"]), np.uint8)
        self.bitmap = bitmap.reshape(-1)

    def _spot(self):
        own = F.col(self.column)
        at = F.pmod(own if self.hashed else F.xxhash64(own), F.lit(self.bits))
        return F.bitmap_bucket_number(at), F.bitmap_bit_position(at)

    def _set(self, byte: np.ndarray, bit: np.ndarray) -> np.ndarray:
        return (self.bitmap[byte] >> bit.astype(np.uint8)) & 1 == 1

    def has_hashed(self, h: np.ndarray) -> np.ndarray:
        """Which of some hashes may be in; the same place as bitmap_bucket_number and bitmap_bit_position give."""
        at = np.mod(h.view(np.int64), self.bits)
        # Bucket numbers begin at 1 for places from 1 on, and at 0 for the place 0.
        bucket, position = np.where(at > 0, 1 + ((at - 1) >> 15), 0), np.where(at > 0, (at - 1) & 32767, 0)
        return self._set(bucket * 4096 + (position >> 3), position & 7)

    def kept(self, df: DataFrame, carry: list[str]) -> DataFrame:
        """The rows of ``df`` (the column and ``carry``) whose identifier may be in."""
        names = [self.column, *carry]
        b, p = unused("__b", names), unused("__p", names)
        bucket, position = self._spot()
        source = df.select(*[F.col(f"`{n}`") for n in names], bucket.alias(b), position.alias(p)).where(F.col(f"`{self.column}`").isNotNull())

        def scan(batches):
            for batch in batches:
                if batch.num_rows:
                    at = batch.column(b).to_numpy(zero_copy_only=False).astype(np.int64)
                    position = batch.column(p).to_numpy(zero_copy_only=False)
                    ok = self._set(at * 4096 + (position >> 3), position & 7)
                    if ok.any():
                        yield batch.select(names).filter(pa.array(ok))

        return source.mapInArrow(scan, df.select(*[F.col(f"`{n}`") for n in names]).schema)


def unused(name: str, taken: list[str]) -> str:
    """A column name that isn't among ``taken``, whatever their case."""
    held = {t.lower() for t in taken}
    while name.lower() in held:
        name += "_"
    return name


def row_bytes(df: DataFrame):
    """About how many bytes a row has in memory, with all its columns."""
    total = F.lit(0)
    for f in df.schema.fields:
        own = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(own), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(own))), F.lit(0))
        total = total + 8
    return total.cast("long")


def keep_candidates(df: DataFrame, ids: DataFrame, column: str, carry: list[str]) -> DataFrame:
    """The rows of ``df`` (``column`` and ``carry``) whose ``column`` is in ``ids``.

    A bitmap drops most others while they are scanned, so that the join moves little more than what it keeps.
    """
    return IdFilter(ids, column).kept(df, carry).join(ids.select(column).distinct(), column, "left_semi")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b): label is the least node of its component.

    Alternates the large-star and small-star steps of Kiveris and others ("Connected Components in MapReduce and
    Beyond", 2014): every step is one shuffle on a node, a hub's rows are halved by the distinct before it, and the
    number of rounds is logarithmic.  Each round is cut, so a lost executor costs that round at most.  Rows with a null
    end or equal ends are no edges.
    """
    edges = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = cut(edges)
    by_a = Window.partitionBy("a")
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (
            both.withColumn("m", F.least(F.min("b").over(by_a), F.col("a")))
            .where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        small = large.withColumn("m", F.min("b").over(by_a))
        star = F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = cut(small.select(F.inline(star)).where(F.col("a") != F.col("b")).distinct())
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 30)))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )


def with_leader(rows: DataFrame) -> DataFrame:
    """The rows (bucket, node) of buckets with more than one node, and the bucket's least node as ``leader``."""
    of_bucket = Window.partitionBy("bucket")
    both = rows.withColumn("leader", F.min("node").over(of_bucket)).withColumn("last", F.max("node").over(of_bucket))
    return stored(both.where("leader != last").select("bucket", "node", "leader"), "members")


def _owned(bucket: np.ndarray, node: np.ndarray, owners: np.ndarray) -> pa.RecordBatch | None:
    """See with_owned_leader, for whole buckets in order."""
    # One row for each node of a bucket.
    at = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (node[1:] != node[:-1])]))
    bucket, node, owners = bucket[at], node[at], np.add.reduceat(owners, at)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    size = np.diff(first, append=len(bucket))
    ok = np.repeat(np.minimum.reduceat(owners, first) != np.maximum.reduceat(owners, first), size)
    columns = [bucket, node, np.repeat(node[first], size), owners, np.repeat(owners[first], size)]
    return pa.RecordBatch.from_arrays([pa.array(c[ok]) for c in columns], names=["bucket", "node", "leader", "owners", "leads"]) if ok.any() else None


#: Bytes of the rows that with_owned_leader sorts at a time.
PART_BYTES = 8 << 20


def packed(bucket: np.ndarray, node: np.ndarray, owners: np.ndarray, parts: int) -> pa.RecordBatch:
    """Rows (part, rows) of the rows' bytes for each of ``parts`` ranges of buckets: a few long rows to move for very many short ones."""
    part = ((bucket.view(np.uint64) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    order = np.argsort(part, kind="stable")
    rows = np.stack([x.view(np.int64)[order] for x in (bucket, node, owners)], axis=1)
    own, at = np.unique(part[order], return_index=True)
    ends = pa.py_buffer((24 * np.append(at, len(rows))).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(own), [None, ends, pa.py_buffer(rows)])], names=["part", "rows"])


def _whole_part(rows: list[np.ndarray]) -> pa.RecordBatch | None:
    """See with_owned_leader, for all rows of a range of buckets."""
    bucket, node, owners = np.concatenate(rows).T
    order = np.argsort(bucket)
    same = np.diff(bucket[order]) == 0
    # Most buckets have one row.
    order = order[np.append(same, False) | np.append(False, same)]
    if not len(order):
        return None
    order = order[np.lexsort((node[order], bucket[order]))]
    return _owned(bucket[order], node[order], owners[order])


def with_owned_leader(rows: DataFrame) -> DataFrame:
    """As with_leader, for rows (bucket, node, owners), with the ``owners`` of each node and those of the leader as ``leads``.

    owners is a sum of hashes of a node's owners; a node may have several rows, whose sums are added.  Buckets of which all
    nodes have the same owners are dropped.  Rows may be given as ``packed`` has them; a range of buckets is looked at at a
    time, and Spark, which sorts the ranges, spills what doesn't fit.
    """
    if "bucket" in rows.columns:

        def pack(batches):
            for batch in batches:
                if batch.num_rows:
                    yield packed(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "node", "owners")), 1)

        rows = rows.mapInArrow(pack, "part int, rows binary")

    def run(batches):
        held: list[np.ndarray] = []
        last = None
        for batch in batches:
            for part, row in zip(batch.column("part").to_pylist(), batch.column("rows")):
                if part != last and held:
                    if (made := _whole_part(held)) is not None:
                        yield made
                    held = []
                last = part
                # A copy, so that no batch is kept for a part of it.
                held.append(np.frombuffer(row.as_buffer(), np.int64).reshape(-1, 3).copy())
        if held and (made := _whole_part(held)) is not None:
            yield made

    in_order = rows.repartition("part").sortWithinPartitions("part")
    return stored(in_order.mapInArrow(run, "bucket long, node long, leader long, owners long, leads long"), "members")


def whole_groups(df: DataFrame, column: str, found: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """What ``found`` makes of the rows of ``df``, which it is given sorted by ``column``, rows of equal values always together."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            of = batch.column(column).to_numpy(zero_copy_only=False)
            # The last group may go on in the next batch.
            cut = int(np.searchsorted(of, of[-1]))
            if cut or (held and held[0].column(column)[0].as_py() != of[0]):
                yield found(pa.concat_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield found(pa.concat_batches(held))

    return df.repartition(column).sortWithinPartitions(column).mapInArrow(run, schema)


def verified_edges(members: DataFrame, verify: Callable[[DataFrame], DataFrame], sketch: list[str] | None = None, alike: Column | None = None, pairs: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Edges (a, b) with the same components as all pairs (a, b) of nodes that share a bucket and that ``verify`` keeps.

    members: (bucket, node, leader) as with_leader gives them, of buckets with more than one node.  Each node is checked against its bucket's leader,
    which is linear.  Every pair of a bucket whose nodes aren't in one component by then is checked as well; a pair within
    a component can't change the components.  No bucket or pair is left out, but for pairs with the same ``owners`` if
    members have them, and pairs of which the columns ``sketch`` already show that verify won't keep them: alike is the
    condition on a member and its leader, and pairs gives the (a, b) of rows (bucket, node, owners, label and the sketch)
    that share a bucket, differ in owners and label and meet it; without it all pairs are formed.
    """
    owned, sketch = "owners" in members.columns, sketch or []
    star = members.where("node != leader" + " AND owners != leads" * owned)
    if alike is not None:
        star = star.where(alike)
    found = stored(verify(star.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()), "edges")
    labels = connected_components(found).withColumnRenamed("node", "named")
    named = members.join(labels, members.node == labels.named, "left").select("bucket", "node", "leader", *["owners"] * owned, *sketch, F.coalesce("label", "node").alias("label"))
    if pairs is not None:
        rest = pairs(named.where("node != leader").drop("leader"))
    else:
        of_bucket = Window.partitionBy("bucket")
        apart = named.withColumn("lo", F.min("label").over(of_bucket)).withColumn("hi", F.max("label").over(of_bucket))
        apart = stored(apart.where("lo != hi AND node != leader").select("bucket", "node", *["owners"] * owned, "label"), "apart")
        p, q = apart.alias("p"), apart.alias("q")
        other = (F.col("p.bucket") == F.col("q.bucket")) & (F.col("p.node") < F.col("q.node")) & (F.col("p.label") != F.col("q.label"))
        if owned:
            other &= F.col("p.owners") != F.col("q.owners")
        rest = p.join(q, other).select(F.col("p.node").alias("a"), F.col("q.node").alias("b"))
    return found.union(stored(verify(rest.distinct()), "edges"))
