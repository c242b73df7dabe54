"""Sharding in random order: a two-pass external shuffle.

Pass one scatters the records into buckets by a seeded hash, as many buckets as are needed for one to fit in memory; pass
two puts each bucket into a fixed order, permutes it by Fisher and Yates' shuffle with a generator seeded by the bucket, and
writes it as a shard.  Every record is moved once, and a task holds one bucket.

The hash is of a record's content and of how many equal ones its task had before it, so equal records spread over all buckets
as others do.  Equal records are interchangeable, so a task that runs again, in whatever order it reads, gives the same; the
order of records that occur once depends on them and the seed only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfold.llm import files
from nearfold.llm import textkernel as tk
from nearfold.llm.frames import new_folder, row_bytes, unused

BUCKET_BYTES = 32 << 20


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A uniform permutation of 0 .. n - 1."""
    rng = np.random.Generator(np.random.PCG64([seed, bucket]))
    pick = rng.integers(0, np.arange(1, n + 1)).tolist() if n else []
    order = list(range(n))
    for i in range(n - 1, 0, -1):
        j = pick[i]
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


class Occurrences:
    """How many equal hashes came before each one, over all arrays that are given."""

    def __init__(self):
        self.seen, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def before(self, h: np.ndarray) -> np.ndarray:
        order = np.argsort(h, kind="stable")
        key = h[order]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(h) else np.zeros(0, np.int64)
        size = np.diff(begin, append=len(h))
        own = key[begin]
        known = np.zeros(len(own), np.int64)
        if len(self.seen):
            at = np.minimum(np.searchsorted(self.seen, own), len(self.seen) - 1)
            known = np.where(self.seen[at] == own, self.count[at], 0)
        out = np.empty(len(h), np.int64)
        out[order] = np.arange(len(h)) - np.repeat(begin, size) + np.repeat(known, size)
        both = np.concatenate([self.seen, own])
        self.seen, back = np.unique(both, return_inverse=True)
        self.count = np.bincount(back, weights=np.concatenate([self.count, size]), minlength=len(self.seen)).astype(np.int64)
        return out


def bucket_of(h: np.ndarray, before: np.ndarray, buckets: int) -> np.ndarray:
    return (tk.mix(h ^ tk.mix(before.astype(np.uint64))) % np.uint64(buckets)).astype(np.int32)


def shuffle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 19380101, bucket_bytes: int = BUCKET_BYTES, folder: str | None = None) -> DataFrame:
    """``docs`` with every column, a ``shard`` and a ``position`` in it; both together are a random order of all rows.

    folder: writes each bucket as a Parquet file there as well, its rows in their order, when the result is computed.
    A bucket's fixed order is by key (null last), then text, then the other columns as JSON.

    Defined results: every row is kept, with nulls and repeated rows; columns named shard or position are replaced;
    an empty table stays empty; buckets are counted by the bytes of all columns; a text larger than a bucket has a larger
    bucket; equal rows are spread like others, and which of them has which place can't be told.
    """
    own = [f for f in docs.schema.fields if f.name.lower() not in ("shard", "position")]
    names = [f.name for f in own]
    total = docs.select(row_bytes(docs).alias("n")).agg(F.sum("n")).first()[0] or 0
    buckets = int(total // bucket_bytes) + 1
    rest = unused("__rest", [*names, "shard", "position"])
    mark = unused("__hash", [*names, "shard", "position", rest])
    others = [F.col(f"`{n}`") for n in names if n not in (key, text)]
    as_text = (F.to_json(F.struct(*others)) if others else F.lit("")).alias(rest)
    source = docs.select(*[F.col(f"`{n}`") for n in names], as_text)
    source = source.withColumn(mark, F.xxhash64(F.lit(seed), F.col(f"`{key}`"), F.col(f"`{text}`"), F.col(rest)))
    schema = T.StructType([*own, T.StructField("shard", T.IntegerType()), T.StructField("position", T.LongType())])

    def scatter(batches):
        seen = Occurrences()
        for batch in batches:
            h = batch.column(mark).to_numpy(zero_copy_only=False).view(np.uint64)
            shard = bucket_of(h, seen.before(h), buckets)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in (*names, rest)), pa.array(shard)], names=[*names, rest, "shard"])

    def permute(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        bucket = table.column("shard")[0].as_py()
        table = table.sort_by([(key, "ascending"), (text, "ascending"), (rest, "ascending")]).drop_columns([rest])
        table = table.take(pa.array(fisher_yates(len(table), seed, bucket)))
        table = table.append_column("position", pa.array(np.arange(len(table))))
        if folder:
            out = pa.BufferOutputStream()
            pq.write_table(table, out)
            files.put(folder, f"shard-{bucket:06d}.parquet", [out.getvalue()])
        yield from table.to_batches(max_chunksize=10_000)

    if folder:
        files.make(folder)
    moved = T.StructType([*own, T.StructField(rest, T.StringType()), T.StructField("shard", T.IntegerType())])
    return source.mapInArrow(scatter, moved).repartitionById(buckets, "shard").mapInArrow(permute, schema)


def write_shuffled(docs: DataFrame, folder: str | None = None, **parameters) -> DataFrame:
    """As shuffle, with the shards written to ``folder``, by default a new one in the shared folder."""
    return shuffle(docs, folder=folder or new_folder(docs.sparkSession, "shuffled"), **parameters)
