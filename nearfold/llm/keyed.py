"""Token ids in raw shard files, with a minimal perfect hash index for keyed access in constant time.

A document's shard is a seeded hash of its key.  A shard is two files: the ids of its documents as little-endian integers
one after another (2 bytes each if the vocabulary allows it), and an index.  The index is a minimal perfect hash of the
shard's keys (levels of bit arrays with ranks, as in Limasset and others, "Fast and scalable minimal perfect hashing",
2017): it maps a key to a slot 0 .. n - 1; slots hold a 32-bit fingerprint of their key, so that a foreign key is noticed,
and the place where the document's ids begin.  A lookup reads a few words of the index - a bit and a rank for each level that
it tries, one slot - and one slice of the ids, whatever the size of the corpus; a task with so many keys that this would be
more than the index itself reads that whole.

Texts are encoded where they are read; the one shuffle moves the encoded ids to their shards, one to a task.  A shard's task
makes both files in memory and moves them into place, so running it again gives the same files.  The number of shards, which
a lookup needs, is in the folder's manifest.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.llm import bpe, files
from nearfold.llm import textkernel as tk
from nearfold.llm.frames import new_folder

#: Bytes of text that a shard should have.
SHARD_BYTES = 32 << 20
GAMMA = 2.0
MANIFEST = "manifest.json"
MAGIC = 0x31584449464E
ENTRY_SCHEMA = "doc_id long, shard int, slot long, fingerprint long, byte_offset long, n_ids long"


def _scrambled(keys: np.ndarray, salt: int) -> np.ndarray:
    return tk.mix(keys.view(np.uint64) ^ tk.mix(np.array([salt], np.uint64)))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_scrambled(keys, 0xF1F1) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: ``bits`` of all levels, ``sizes`` of the levels, ranks by word."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray):
        self.bits, self.sizes = bits, sizes
        self.base = np.concatenate([[0], np.cumsum(sizes)])
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(bits).astype(np.int64))])[: len(bits)]

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        """Each level keeps the keys that hash to a place of their own; the others go to the next level."""
        flags, sizes = [], []
        while len(keys):
            size = -(-int(len(keys) * GAMMA + 1) // 64) * 64
            place = (_scrambled(keys, len(sizes) + 1) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            flags.append(alone)
            sizes.append(size)
            keys = keys[~alone[place]]
        packed = np.packbits(np.concatenate(flags), bitorder="little").view(np.uint64) if flags else np.zeros(0, np.uint64)
        return cls(packed, np.array(sizes, np.int64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for some keys that aren't in the set (others get a slot all the same)."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            at = self.base[level] + (_scrambled(keys[left], level + 1) % np.uint64(size)).astype(np.int64)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (self.bits[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(self.bits[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[hit]] = (self.rank[word] + below)[hit]
            left = left[~hit]
        return out


class Index:
    """A shard's index: slot of a key, its fingerprint, and where its ids begin and end in the payload."""

    def __init__(self, hashed: PerfectHash, prints: np.ndarray, offsets: np.ndarray, width: int):
        self.hashed, self.prints, self.offsets, self.width = hashed, prints, offsets, width

    def to_bytes(self) -> list[bytes]:
        head = np.array([MAGIC, self.width, len(self.prints), len(self.hashed.sizes), len(self.hashed.bits)], "<i8")
        return [head.tobytes(), self.hashed.sizes.astype("<i8").tobytes(), self.hashed.bits.astype("<u8").tobytes(), self.hashed.rank.astype("<i8").tobytes(), self.offsets.astype("<i8").tobytes(), self.prints.astype("<u4").tobytes()]

    @classmethod
    def from_bytes(cls, raw: bytes) -> Index:
        width, n, levels, words = _head(raw)
        at = HEAD
        sizes = np.frombuffer(raw, "<i8", levels, at)
        bits = np.frombuffer(raw, "<u8", words, at := at + 8 * levels)
        offsets = np.frombuffer(raw, "<i8", n + 1, at := at + 16 * words)
        prints = np.frombuffer(raw, "<u4", n, at + 8 * (n + 1))
        return cls(PerfectHash(bits, sizes), prints, offsets, width)

    def places(self, keys: np.ndarray) -> list[tuple[int, int] | None]:
        """Where each key's ids begin and end, or None where the fingerprint says that the key isn't here."""
        slot = self.hashed.slots(keys)
        ok = slot >= 0
        ok[ok] = self.prints[slot[ok]] == fingerprints(keys)[ok]
        return [tuple(self.offsets[s : s + 2].tolist()) if o else None for s, o in zip(slot.tolist(), ok.tolist())]


HEAD = 40


def _head(raw: bytes) -> tuple[int, int, int, int]:
    magic, width, n, levels, words = np.frombuffer(raw, "<i8", 5).tolist()
    if magic != MAGIC:
        raise ValueError("not an index of this kind")
    return width, n, levels, words


class StoredIndex:
    """The same of an index that stays where it is: a few words are read for each key."""

    def __init__(self, file):
        self.file = file
        self.width, self.n, levels, words = _head(self.file.read_at(HEAD, 0))
        self.sizes = np.frombuffer(self.file.read_at(8 * levels, HEAD), "<i8").tolist()
        self.bits = HEAD + 8 * levels
        self.ranks = self.bits + 8 * words
        self.offsets = self.ranks + 8 * words
        self.prints = self.offsets + 8 * (self.n + 1)

    def _at(self, kind: str, base: int, k: int, count: int = 1) -> list[int]:
        size = np.dtype(kind).itemsize
        return np.frombuffer(self.file.read_at(size * count, base + size * k), kind).tolist()

    def places(self, keys: np.ndarray) -> list[tuple[int, int] | None]:
        out: list[tuple[int, int] | None] = []
        for j in range(len(keys)):
            key, base, found = keys[j : j + 1], 0, None
            for level, size in enumerate(self.sizes):
                at = base + int(_scrambled(key, level + 1)[0] % np.uint64(size))
                (word,) = self._at("<u8", self.bits, at >> 6)
                if word >> (at & 63) & 1:
                    slot = self._at("<i8", self.ranks, at >> 6)[0] + (word & ((1 << (at & 63)) - 1)).bit_count()
                    if self._at("<u4", self.prints, slot)[0] == int(fingerprints(key)[0]):
                        found = tuple(self._at("<i8", self.offsets, slot, 2))
                    break
                base += size
            out.append(found)
        return out


#: Bytes that a key's lookup reads of a stored index, about.
KEY_BYTES = 64


def shard_name(shard: int) -> str:
    return f"shard-{shard:06d}"


def shard_of(shards: int):
    return F.pmod(F.xxhash64(F.lit("shard"), F.col("doc_id")), F.lit(shards)).cast("int").alias("shard")


def payloads(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): the encoded text as bytes, 2 for each id if all ids of the vocabulary fit."""

    def run(batches):
        own = bpe.codec(path)
        kind = np.dtype("<u2") if own.size <= 1 << 16 else np.dtype("<u4")
        for batch in bpe.together(batches):
            for a, b, ids, ends in own.encode_parts(*tk.text_buffer(batch.column("text"))):
                raw = ids.astype(kind)
                packed = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((ends * kind.itemsize).astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), packed], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, "doc_id long, ids binary")


def write_shards(docs: DataFrame, folder: str | None = None, path: str = bpe.VOCABULARY, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes ``docs(doc_id, text)`` to ``folder`` (by default a new one in the shared folder) when the result is computed.

    The result has a row for each key: its shard, slot, fingerprint, the byte its ids begin at, and how many they are.

    Defined results: a null doc_id is no key and a null text no document, both are left out; an empty text has no ids; of
    rows that share a doc_id the one whose encoded bytes are least is stored; other columns are ignored; an empty table
    writes no shard; texts of any length are stored whole.
    """
    folder = folder or new_folder(docs.sparkSession, "shards")
    files.make(folder)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = int(size // shard_bytes) + 1
    width = 2 if bpe.codec(path).size <= 1 << 16 else 4
    files.put(folder, MANIFEST, [json.dumps({"shards": shards, "width": width}).encode()])

    def write(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        shard = table.column("shard")[0].as_py()
        table = table.sort_by([("doc_id", "ascending"), ("ids", "ascending")])
        keys = table.column("doc_id").to_numpy()
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        table, keys = table.filter(pa.array(new)), keys[new]
        hashed = PerfectHash.of(keys)
        order = np.argsort(hashed.slots(keys))
        payload = table.column("ids").combine_chunks()
        length = np.diff(tk.text_buffer(payload)[1])[order]
        offsets = np.concatenate([[0], np.cumsum(length)])
        files.put(folder, shard_name(shard) + ".ids", [tk.text_buffer(payload.take(pa.array(order)))[0].tobytes()])
        index = Index(hashed, fingerprints(keys)[order], offsets, width)
        files.put(folder, shard_name(shard) + ".idx", index.to_bytes())
        columns = {"doc_id": keys[order], "shard": np.full(len(keys), shard, np.int32), "slot": np.arange(len(keys)), "fingerprint": index.prints.astype(np.int64), "byte_offset": offsets[:-1], "n_ids": length // width}
        yield from pa.table(columns).to_batches()

    return payloads(docs, path).withColumn("shard", shard_of(shards)).repartitionById(shards, "shard").mapInArrow(write, ENTRY_SCHEMA)


def lookup(keys: DataFrame, folder: str) -> DataFrame:
    """(doc_id, ids) for every row of ``keys(doc_id)``: array<int>, or null if the folder has no such key, as it has no null.

    Keys go to the task that has their shard open; equal keys are looked up each.
    """
    shards = json.loads(files.get(folder, MANIFEST))["shards"]

    def run(table: pa.Table) -> pa.Table:
        wanted = table.column("doc_id")
        nothing = pa.table({"doc_id": wanted, "ids": pa.nulls(len(wanted), pa.list_(pa.int32()))})
        shard = table.column("shard")[0].as_py()
        if shard is None:
            return nothing
        at, path = files.opened(folder)
        name = f"{path}/{shard_name(shard)}"
        if at.get_file_info(name + ".idx").type == fs.FileType.NotFound:
            return nothing
        out = []
        with at.open_input_file(name + ".idx") as i, at.open_input_file(name + ".ids") as f:
            index = StoredIndex(i) if len(wanted) * KEY_BYTES < i.size() else Index.from_bytes(i.read())
            kind = np.dtype("<u2") if index.width == 2 else np.dtype("<u4")
            for place in index.places(wanted.to_numpy()):
                out.append(None if place is None else np.frombuffer(f.read_at(place[1] - place[0], place[0]), kind).astype(np.int32))
        return pa.table({"doc_id": wanted, "ids": pa.array(out, pa.list_(pa.int32()))})

    own = shard_of(shards)
    return keys.select("doc_id").withColumn("shard", F.when(F.col("doc_id").isNotNull(), own)).groupBy("shard").applyInArrow(run, "doc_id long, ids array<int>")
