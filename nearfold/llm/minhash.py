"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard verification, one document kept of each group.

Circulant MinHash (Li and Li, "C-MinHash", 2022) needs two permutations of the universe [0, 2**20) that shingles are
hashed to: the first one, sigma, breaks up any structure; the second one, pi, is a table that is shifted circularly by k
for coordinate k, so coordinate k of a text is the least pi[(sigma(x) + k) mod 2**20] over its shingles x.

The search is for *groups*, and finds the same ones as checking every colliding pair would:

1.  Documents with equal word sequences are collapsed first (any number of them, one row each), so a thousand copies
    cost no more than a thousand rows.
2.  In every bucket each member is checked against the bucket's least document (a star, linear in the bucket).
3.  Groups so far are joined to components.  Every pair of a bucket whose members are still in different components is
    then checked too; a pair within one component can't change the groups.  So there is no cap on buckets or pairs.

What moves: a signature row of 32 longs for each document, a row for each band of each distinct document, and the text of
candidates only (others are dropped while scanned by a bitmap of fixed size).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfold.llm import textkernel as tk
from nearfold.llm.frames import connected_components, cut, keep_candidates, unused, verified_edges, with_leader

UNIVERSE = 1 << 20
SIGNATURE_SCHEMA = "doc_id long, h1 long, h2 long, bands array<long>"


class Circulant:
    """The two permutations and the signatures that they give."""

    def __init__(self, coordinates: int, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        pi = rng.permutation(UNIVERSE).astype(np.uint32)
        self.k = coordinates
        self.shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: coordinates - 1]]), coordinates)
        self.factor, self.term = int(rng.integers(1, UNIVERSE) | 1), int(rng.integers(UNIVERSE))

    def sigma(self, x: np.ndarray) -> np.ndarray:
        """A bijection of [0, 2**20): an odd factor and a term, then high bits folded into low ones, twice."""
        x = (x & np.uint64(UNIVERSE - 1)).astype(np.int64)
        for _ in range(2):
            x = (x * self.factor + self.term) & (UNIVERSE - 1)
            x ^= x >> 10
        return x

    def signatures(self, shingle: np.ndarray, row: np.ndarray, n: int, block: int = 4096) -> np.ndarray:
        """An n by k array; ``row`` goes up.  A text without shingles has the greatest value everywhere."""
        out = np.full((n, self.k), np.iinfo(np.uint32).max, np.uint32)
        spot = self.sigma(shingle)
        for at in range(0, len(spot), block):
            r = row[at : at + block]
            begin = np.concatenate([[0], np.flatnonzero(np.diff(r)) + 1])
            least = np.minimum.reduceat(self.shifted[spot[at : at + block]], begin, axis=0)
            out[r[begin]] = np.minimum(out[r[begin]], least)
        return out


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(signature), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(signature), b + 1, np.uint64)
        for r in range(rows):
            h = tk.mix(h * np.uint64(0x9E3779B97F4A7C15) + signature[:, b * rows + r].astype(np.uint64))
        out[:, b] = h
    return out


def signatures(docs: DataFrame, n: int, bands: int, rows: int, seed: int) -> DataFrame:
    """doc_id, a 128-bit hash of the word sequence, and the band hashes, for texts with a word and a doc_id."""

    def run(batches):
        circulant = Circulant(bands * rows, seed)
        for batch in batches:
            data, offsets = tk.text_buffer(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for a, b in tk.chunks(offsets):
                own = offsets[a : b + 1] - offsets[a]
                words = tk.Words(data[offsets[a] : offsets[b]], own)
                has = np.flatnonzero(np.diff(words.first))
                if not len(has):
                    continue
                h = words.hashes()
                place = (np.arange(len(h)) - words.first[words.row]).astype(np.uint64)
                begin = words.first[:-1][has]
                whole = [np.add.reduceat(tk.mix(h + place * np.uint64(c)), begin) for c in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F)]
                shingle, row = tk.shingles(h, words.first, n)
                hashed = band_hashes(circulant.signatures(shingle, row, b - a)[has], bands, rows)
                flat = pa.array(tk.to_long(hashed.reshape(-1)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(has) * bands + 1, bands, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][has]), *(pa.array(tk.to_long(w)) for w in whole), lists], names=["doc_id", "h1", "h2", "bands"])

    return docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, SIGNATURE_SCHEMA)


def jaccard_counts(left: pa.Array, right: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of texts the number of word n-shingles that both have and that either has.

    Exact: words are compared as bytes (numbered by a dictionary), shingles as runs of those numbers.
    """
    pairs = len(left)
    data, offsets = tk.text_buffer(pa.chunked_array([left, right]).combine_chunks())
    words = tk.Words(data, offsets)
    number, _ = words.ids()
    key, row = None, None
    for k in range(n):
        step, row = _shingle_step(number, words.first, n, k)
        # Shingle prefixes are numbered anew at each step, so that the numbers stay small and exact.
        key = step if key is None else np.unique(key * (int(number.max(initial=0)) + 2) + step, return_inverse=True)[1]
    if key is None or not len(key):
        return np.zeros(pairs, np.int64), np.zeros(pairs, np.int64)
    size = int(key.max()) + 1
    side = row >= pairs
    each = np.unique((row % pairs).astype(np.int64) * size + key)
    lefts = np.unique(row[~side].astype(np.int64) * size + key[~side])
    rights = np.unique((row[side] - pairs).astype(np.int64) * size + key[side])
    count = lambda x: np.bincount(x // size, minlength=pairs)
    either = count(each)
    return count(lefts) + count(rights) - either, either


def _shingle_step(number: np.ndarray, first: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    count = np.diff(first)
    lengths = np.where(count >= n, count - n + 1, (count > 0).astype(count.dtype))
    row = np.repeat(np.arange(len(count)), lengths)
    begin = np.zeros(len(count), np.int64)
    np.cumsum(lengths[:-1], out=begin[1:])
    at = first[:-1][row] + (np.arange(len(row)) - begin[row]) + k
    padded = np.concatenate([number, np.zeros(n, np.int64)])
    return np.where(at < first[1:][row], padded[at] + 1, 0), row


def verify(pairs: DataFrame, docs: DataFrame, n: int, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of doc_ids whose texts have a Jaccard similarity of threshold or more."""
    pairs = cut(pairs)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = keep_candidates(docs, ids, "doc_id", ["text"])
    texts = texts.where("text IS NOT NULL")
    joined = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y")), "b")

    def run(batches):
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            size = np.concatenate([[0], np.cumsum(pc.add(pc.binary_length(x), pc.binary_length(y)).to_numpy(zero_copy_only=False))])
            for a, b in tk.chunks(size):
                both, either = jaccard_counts(x[a:b], y[a:b], n)
                ok = (both * threshold[1] >= either * threshold[0]) & (either > 0)
                if ok.any():
                    yield batch.slice(a, b - a).select(["a", "b"]).filter(pa.array(ok))

    return joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, n: int = 3, threshold: tuple[int, int] = (3, 5), bands: int = 32, rows: int = 4, seed: int = 20240229) -> DataFrame:
    """Groups of near-copies: a row (doc_id, group_id, kept) for each member of a group of two documents or more.

    Two documents are near-copies if the sets of their word n-shingles have a Jaccard similarity of ``threshold`` (a
    fraction, numerator and denominator) or more; groups are the components of that relation among pairs that share one
    of ``bands`` bands of ``rows`` coordinates.  At 3/5 a pair is found with probability 1 - (1 - .6**4)**32 = 0.988, at
    0.7 with 0.9998, and most groups hang together by several pairs.  group_id is the group's least doc_id, and that
    document is kept.

    Defined results for ``docs(doc_id, text)``: a document without a near-copy is in no row; a null or blank text has no
    shingles, so it has no copies; a text shorter than n words is one shingle; rows that share a doc_id count as one
    document, whose copies are those of any of its rows; rows with a null doc_id can't be named and are in no group;
    other columns are ignored; an empty table gives an empty result.
    """
    least = F.min("doc_id").over(Window.partitionBy("h1", "h2"))
    signed = signatures(docs, n, bands, rows, seed).withColumn("rep", least)
    signed = cut(signed.select("doc_id", "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("bands")).alias("bands")))
    members = with_leader(signed.where("doc_id = rep").select(F.explode("bands").alias("bucket"), F.col("doc_id").alias("node")))
    found = verified_edges(members, lambda pairs: verify(pairs, docs, n, threshold))
    copies = signed.where("doc_id != rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    groups = connected_components(found.union(copies))
    return groups.select(F.col("node").alias("doc_id"), F.col("label").alias("group_id"), (F.col("node") == F.col("label")).alias("kept"))


def deduplicate(docs: DataFrame, **parameters) -> DataFrame:
    """One document of each group, with all its columns: the one with the group's least doc_id.

    Rows that share a kept doc_id are copies as well: the one with the least text (then the least other columns, compared
    as JSON) stays, null last.  Rows with a null doc_id stay all.
    """
    gone, nth = unused("__gone", docs.columns), unused("__nth", docs.columns)
    removed = near_duplicates(docs.select("doc_id", "text"), **parameters).where("NOT kept").select(F.col("doc_id").alias(gone))
    rest = docs.join(removed, docs["doc_id"] == removed[gone], "left_anti")
    order = [F.col("text").asc_nulls_last(), F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(0).alias("x")]))]
    kept = rest.where("doc_id IS NOT NULL").withColumn(nth, F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).where(F.col(nth) == 1).drop(nth)
    return kept.unionByName(rest.where("doc_id IS NULL"))
