"""Reading and writing the engine's inputs and outputs."""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfold.functions import expressions as X
from nearfold.functions.features import DIMS, PAYLOAD, Config

REFERENCE_SCHEMA = "vector array<double>, label string"


def read_references(spark: SparkSession, path: str, dims: int = DIMS, partitions: int | None = None) -> DataFrame:
    """Labelled vectors (vec_id, vector, label) of a JSON array, plain or gzipped; a wrong length is an error when read.

    A gzipped array can't be split, so one task reads each file; ``partitions`` spreads the rows afterwards.  vec_id
    numbers the rows in the files' order.
    """
    rows = spark.read.schema(REFERENCE_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    checked = F.when(F.size("vector") == dims, F.col("vector")).otherwise(F.raise_error(F.concat(F.lit(f"expected {dims} values, got "), F.coalesce(F.size("vector"), F.lit(0)).cast("string"))).cast("array<double>"))
    rows = rows.select(F.monotonically_increasing_id().alias("vec_id"), checked.alias("vector"), "label")
    return rows.repartition(partitions) if partitions else rows


def load_examples(spark: SparkSession, path: str, dims: int = DIMS) -> DataFrame:
    """As read_references, for small fixtures: an empty file is an error, and labels stay as they are."""
    rows = read_references(spark, path, dims)
    if not rows.take(1):
        raise ValueError("no references")
    return rows


def read_config(path: str, **defaults: float) -> Config:
    with open(path, encoding="utf-8") as f:
        return Config(**(defaults | {k: float(v) for k, v in json.load(f).items()}))


def read_risks(spark: SparkSession, path: str) -> DataFrame:
    """(mcc, risk) of a JSON object from merchant category to risk."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", "map<string,double>")).alias("mcc", "risk"))


def load_resources(spark: SparkSession, config_path: str, risks_path: str) -> tuple[Config, DataFrame]:
    """Both or neither: an error in one leaves nothing loaded."""
    config = read_config(config_path)
    risks = read_risks(spark, risks_path)
    if risks.where("risk IS NULL").take(1) or not risks.take(1):
        raise ValueError("risks can't be read")
    return config, risks


#: Names of the payload's fields at any depth, and those of them that hold text.
_NAMES = ["id", "transaction", "amount", "installments", "requested_at", "customer", "avg_amount", "tx_count_24h", "known_merchants", "merchant", "mcc", "terminal", "is_online", "card_present", "km_from_home", "last_transaction", "timestamp", "km_from_current"]
_TEXTS = "id|requested_at|mcc|timestamp"
_STRING = r'"(?:[^"\\]|\\.)*"'


def _as_named(text: Column) -> Column:
    """JSON text with the payload's names in small letters.  A quote within a JSON text has a backslash, so only names match."""
    small = text
    for name in _NAMES:
        small = F.regexp_replace(small, rf'(?i)"{name}"\s*:', f'"{name}":')
    return F.when(text.rlike(r'"[a-z0-9_]*[A-Z][A-Za-z0-9_]*"\s*:'), small).otherwise(text)


def _typed(text: Column) -> Column:
    """Whether fields that hold text have text or null, and the list of merchants only such."""
    number = text.rlike(rf'"(?:{_TEXTS})"\s*:\s*[^\s"n]')
    listed, good = text.rlike(r'"known_merchants"\s*:\s*\['), text.rlike(rf'"known_merchants"\s*:\s*\[\s*(?:(?:{_STRING}|null)\s*(?:,\s*(?:{_STRING}|null)\s*)*)?\]')
    return ~number & (~listed | good)


def decode_payloads(requests: DataFrame, column: str = "value") -> DataFrame:
    """``requests`` with the payload's columns and ``decoded``: whether the text was a payload of the right types.

    A text that isn't decodes to nothing at all, like a record whose types don't fit.  Names count whatever their case; a
    number is no text.
    """
    names = requests.columns
    p, t = "__p", "__t"
    while {p, t} & {n.lower() for n in names}:
        p, t = p + "_", t + "_"
    schema = T.StructType([*PAYLOAD.fields, T.StructField("_corrupt", T.StringType())])
    parsed = requests.withColumn(t, _as_named(F.col(f"`{column}`")))
    parsed = parsed.withColumn(p, F.from_json(F.col(t), schema, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}))
    good = F.col(p).isNotNull() & F.col(f"{p}._corrupt").isNull() & _typed(F.col(t))
    fields = [F.when(good, F.col(f"{p}.{n}")).alias(n) for n in PAYLOAD.names]
    return parsed.select(*[F.col(f"`{c}`") for c in names], *fields, F.coalesce(good, F.lit(False)).alias("decoded"))


def encode_decisions(decisions: DataFrame, into: str = "value") -> DataFrame:
    """``decisions(approved, fraud_score)`` with the JSON text of both; absent ones become the safe default."""
    whole = F.struct(F.coalesce("approved", F.lit(True)).alias("approved"), F.coalesce("fraud_score", F.lit(0.0)).alias("fraud_score"))
    return decisions.withColumn(into, F.to_json(whole))


def random_vectors(spark: SparkSession, n: int, dims: int = DIMS, seed: int = 42) -> DataFrame:
    """(vec_id, vector): uniform in [0, 1), in the history dimensions in [-1, 1)."""
    values = [F.rand(seed + i) * 2 - 1 if i in X.HISTORY_DIMS else F.rand(seed + i) for i in range(dims)]
    return spark.range(n).select(F.col("id").alias("vec_id"), F.array(*values).alias("vector"))


def random_payloads(spark: SparkSession, n: int, seed: int = 99) -> DataFrame:
    """``n`` payloads of plausible values, half of them without a last transaction."""
    r = lambda k: F.rand(seed + k)
    at = lambda k: F.date_format(F.timestamp_seconds(F.lit(1_772_000_000) + (r(k) * 2_000_000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    mcc = F.element_at(F.array(*map(F.lit, "7802 5999 5411 7801 5944 5812 5912".split())), (r(5) * 7).cast("int") + 1)
    shop = lambda k: F.concat(F.lit("M-"), (r(k) * 50).cast("int").cast("string"))
    last = F.struct(at(11).alias("timestamp"), (r(12) * 1200).alias("km_from_current"))
    return spark.range(n).select(
        F.concat(F.lit("tx-"), F.col("id").cast("string")).alias("id"),
        F.struct((r(0) * 12_000).alias("amount"), ((r(1) * 12).cast("int") + 1).alias("installments"), at(2).alias("requested_at")).alias("transaction"),
        F.struct((r(3) * 5_000).alias("avg_amount"), (r(4) * 25).cast("int").alias("tx_count_24h"), F.array(shop(6), shop(7)).alias("known_merchants")).alias("customer"),
        F.struct(shop(8).alias("id"), mcc.alias("mcc"), (r(9) * 12_000).alias("avg_amount")).alias("merchant"),
        F.struct((r(10) < 0.5).alias("is_online"), (r(13) < 0.5).alias("card_present"), (r(14) * 1500).alias("km_from_home")).alias("terminal"),
        F.when(r(15) < 0.5, last).alias("last_transaction"),
    )


MAGIC, HEAD = b"RVI1", struct.Struct("<4s5I")


def read_binary_index(path: str, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A binary index file's centroids, counts, vectors of levels, and labels.

    Unlike a mapped file it is checked whole: the magic, version, dimensions and length must all fit.
    """
    with open(path, "rb") as f:
        raw = f.read()
    if len(raw) < HEAD.size:
        raise ValueError("too small for a header")
    magic, version, parts, n, d, _ = HEAD.unpack_from(raw)
    if magic != MAGIC or version != 1 or d != dims:
        raise ValueError(f"not an index of version 1 with {dims} dimensions")
    meta = np.dtype([("centroid", "<f4", (dims,)), ("offset", "<u4"), ("count", "<u4")])
    if len(raw) != HEAD.size + parts * meta.itemsize + n * (dims + 1):
        raise ValueError("truncated, or longer than its header says")
    table = np.frombuffer(raw, meta, parts, HEAD.size)
    at = HEAD.size + parts * meta.itemsize
    return table["centroid"], table["count"], np.frombuffer(raw, np.uint8, n * dims, at).reshape(n, dims), np.frombuffer(raw, np.uint8, n, at + n * dims)


def write_binary_index(path: str, centroids: np.ndarray, counts: np.ndarray, parts: Iterable[tuple[np.ndarray, np.ndarray]]) -> None:
    """The same file: header, centroids with offsets and counts, vectors by partition, labels.

    parts: levels and labels of the vectors in the partitions' order, in lots; only the labels are held.  The file is
    written beside its name, flushed to the disk and moved into place, so a reader finds the old one or the whole new one.
    """
    dims = centroids.shape[1]
    meta = np.zeros(len(counts), np.dtype([("centroid", "<f4", (dims,)), ("offset", "<u4"), ("count", "<u4")]))
    offset = np.concatenate([[0], np.cumsum(counts)[:-1]]) * dims
    if len(offset) and offset.max() >= 1 << 32:
        raise ValueError("offsets beyond 32 bits: write Parquet instead")
    meta["centroid"], meta["offset"], meta["count"] = centroids, offset, counts
    total = int(np.sum(counts))
    held = []
    draft = f"{path}.{uuid.uuid4().hex}"
    try:
        with open(draft, "wb", buffering=1 << 16) as f:
            f.write(HEAD.pack(MAGIC, 1, len(counts), total, dims, 1))
            f.write(meta.tobytes())
            for levels, labels in parts:
                f.write(levels.astype(np.uint8).tobytes())
                held.append(labels.astype(np.uint8))
            if sum(map(len, held)) != total:
                raise ValueError("the partitions' counts don't add up to the vectors")
            for labels in held:
                f.write(labels.tobytes())
            f.flush()
            os.fsync(f.fileno())
        os.replace(draft, path)
    finally:
        if os.path.exists(draft):
            os.remove(draft)


def _sum_of(path: str) -> int:
    """A check sum of a file's bytes."""
    total = 0
    with open(path, "rb") as f:
        while some := f.read(1 << 20):
            total = zlib.crc32(some, total)
    return total


def write_binary_ids(path: str, ids: np.ndarray) -> None:
    """The numbers of the vectors of the binary index file at ``path``, in its order, in a file beside it.

    The format has no place for them.  The file begins with the index's check sum, so the numbers of another one are noticed.
    """
    draft = f"{path}.{uuid.uuid4().hex}"
    try:
        with open(draft, "wb") as f:
            f.write(struct.pack("<Q", _sum_of(path)))
            f.write(ids.astype("<i8").tobytes())
            f.flush()
            os.fsync(f.fileno())
        os.replace(draft, f"{path}.ids")
    finally:
        if os.path.exists(draft):
            os.remove(draft)


def read_binary_ids(path: str, n: int) -> np.ndarray:
    """Those numbers; 0 .. n - 1 where there is no such file."""
    if not os.path.exists(f"{path}.ids"):
        return np.arange(n)
    with open(f"{path}.ids", "rb") as f:
        raw = f.read()
    if len(raw) != 8 * (n + 1) or struct.unpack_from("<Q", raw)[0] != _sum_of(path):
        raise ValueError(f"{path}.ids has the numbers of another index")
    return np.frombuffer(raw, "<i8", n, 8).astype(np.int64)
