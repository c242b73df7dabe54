"""Byte-level BPE encoding and decoding with a public vocabulary, by a pair occurrence index.

A batch of a partition's texts is split into pre-tokens with array operations on the bytes.  The distinct pre-tokens that
the worker hasn't met yet are laid out one after another as linked symbols, and the index maps every mergeable pair to
*all* positions at which it occurs in them.  Active ranks are then applied in ascending order, each one to its whole list
at once; a merge changes the pairs to its left and right, so their lists get the new positions (stale entries are
recognised because every position remembers its present rank).  Texts are put together from their pre-tokens' ids.

Nothing is shuffled: encoding and decoding run where a text is read.
"""

from __future__ import annotations

import base64
import functools
import heapq
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfold.llm import textkernel as tk

#: Where the public vocabulary is; pass another path to any operator that encodes.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words that a worker remembers the ids of; when there are more it forgets them and goes on.
REMEMBERED = 300_000
#: Bytes of new words whose pairs are indexed together.
INDEXED = 2 << 20

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def char_classes() -> np.ndarray:
    """The class of every code point: letter, number, white space or other."""
    major = np.frombuffer("".join(unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)).encode(), np.uint8)
    out = np.full(len(major), OTHER, np.uint8)
    out[major == ord("L")] = LETTER
    out[major == ord("N")] = NUMBER
    out[_WHITE] = SPACE
    return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of valid UTF-8, and the byte that each one begins at."""
    if not (data >= 0x80).any():
        return data.astype(np.int32), np.arange(len(data))
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.int32)
    out = lead.copy()
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    for low, keep, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        pick = np.flatnonzero((lead >= low) & (lead < (low | (0xFF >> (more + 2)) + 1 if more < 3 else 0x100)))
        if len(pick):
            c = lead[pick] & keep
            for k in range(1, more + 1):
                c = (c << 6) | (padded[at[pick] + k] & 0x3F)
            out[pick] = c
    return out, at


def pretokens(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bytes at which pre-tokens begin, for texts that lie one after another.

    The split is that of the public byte-level vocabularies: contractions, letters, numbers or other signs with at most
    one blank before them, and white space, the last white character of a run apart if a word follows.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    char, at = code_points(data)
    n = len(char)
    kind = char_classes()[char]
    fresh = np.zeros(n + 1, bool)
    fresh[np.searchsorted(at, offsets[:-1][np.diff(offsets) > 0])] = True
    fresh[n] = True
    begin = fresh[:-1].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    white = kind == SPACE
    last = np.zeros(n, bool)
    last[:-1] = white[:-1] & ~white[1:] & ~fresh[1:-1]
    begin |= last
    blank = np.flatnonzero(last & (char == 32))
    begin[blank + 1] = False
    quote = np.flatnonzero(begin & (char == 39))
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~fresh[quote + 1]]
    if len(quote):
        one = char[quote + 1]
        third = np.minimum(quote + 2, n - 1)
        two = np.where((quote + 2 < n) & ~fresh[quote + 2], char[third], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        hit = quote[short | long]
        begin[hit + 1] = False
        rest = hit + np.where(short[short | long], 2, 3)
        rest = rest[rest < n]
        rest = rest[~fresh[rest] & (kind[rest] == LETTER)]
        begin[rest] = True
    return at[begin]


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The positions of the slices start .. start + length, one slice after another."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = length > 0
    start, length = start[keep], length[keep]
    step = np.ones(total, np.int64)
    heads = np.cumsum(length)[:-1]
    step[0] = start[0]
    step[heads] = start[1:] - start[:-1] - length[:-1] + 1
    return np.cumsum(step)


class Codec:
    """A vocabulary's merges as sorted arrays, and the bytes of every id."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(ranks.values()) + 1
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        keys, made = [], []
        lower: set[int] = set()
        for word, rank in ranks.items():
            for cut in range(1, len(word)):
                a, b = ranks.get(word[:cut]), ranks.get(word[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    made.append(rank)
                    lower.update(x for x in (a, b) if x > rank)
        order = np.argsort(keys)
        self.pair = np.array(keys, np.int64)[order]
        self.rank = np.array(made, np.int64)[order]
        #: Ids whose making can bring up a pair of a lower rank: of these, one merge a word is made at a time.
        self.careful = lower
        by_id = [b""] * self.size
        for word, rank in ranks.items():
            by_id[rank] = word
        self.length = np.array([len(w) for w in by_id], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.large_binary())
        self.flat, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of merging each pair, or the vocabulary's size if it doesn't merge."""
        key = a.astype(np.int64) * self.size + b
        spot = np.searchsorted(self.pair[:-1], key)
        return np.where((self.pair[spot] == key) & (a >= 0) & (b >= 0), self.rank[spot], self.size).astype(np.int32)

    def merge(self, data: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words that lie in ``data`` one after another, and how many each one has."""
        words = len(length)
        # A separator before every word and one at the end: neighbours always exist and never merge.
        n = len(data) + words + 1
        begin = np.cumsum(length + 1) - length - 1
        sym = np.full(n, -1, np.int32)
        inner = np.ones(n, bool)
        inner[begin] = False
        inner[n - 1] = False
        sym[inner] = self.byte_id[data]
        word = np.repeat(np.arange(words + 1, dtype=np.int32), np.concatenate([length + 1, [1]]))
        after, prior = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        none = self.size
        rank = np.full(n, none, np.int32)
        for lo in range(0, n - 1, tk.CHUNK):
            hi = min(lo + tk.CHUNK, n - 1)
            rank[lo:hi] = self.lookup(sym[lo:hi], sym[lo + 1 : hi + 1])
        order = np.argsort(rank, kind="stable")
        order = order[: np.searchsorted(rank[order], none)]
        active, at = np.unique(rank[order], return_index=True)
        index: dict[int, list[np.ndarray]] = {int(r): [p] for r, p in zip(active, np.split(order, at[1:]))}
        heap = [int(r) for r in active]
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r, None)
            if lists is None:
                continue
            spot = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            spot = spot[rank[spot] == r]
            if not len(spot):
                continue
            if len(spot) > 1:
                chained = np.zeros(len(spot), bool)
                chained[1:] = after[spot[:-1]] == spot[1:]
                if chained.any():  # of overlapping occurrences every second one merges, from the left
                    head = np.maximum.accumulate(np.where(chained, 0, np.arange(len(spot))))
                    spot = spot[(np.arange(len(spot)) - head) % 2 == 0]
                if r in self.careful:
                    lead = np.ones(len(spot), bool)
                    lead[1:] = word[spot[1:]] != word[spot[:-1]]
                    if not lead.all():
                        index[r] = [spot[~lead]]
                        heapq.heappush(heap, r)
                        spot = spot[lead]
            right = after[spot]
            far = after[right]
            sym[spot] = r
            sym[right] = -2
            rank[right] = none
            after[spot] = far
            prior[far] = spot
            left = prior[spot]
            touched = np.concatenate([left[sym[left] >= 0], spot])
            changed = self.lookup(sym[touched], sym[after[touched]])
            rank[touched] = changed
            live = changed < none
            if live.any():
                touched, changed = touched[live], changed[live]
                if len(touched) > 1:
                    order = np.argsort(changed, kind="stable")
                    touched, changed = touched[order], changed[order]
                cuts = np.flatnonzero(np.diff(changed)) + 1
                for k, part in zip(changed[np.concatenate([[0], cuts])].tolist(), np.split(touched, cuts)):
                    if k in index:
                        index[k].append(part)
                    else:
                        index[k] = [part]
                        heapq.heappush(heap, k)
        kept = sym >= 0
        return sym[kept], np.bincount(word[kept], minlength=words)[:words]

    def encode_parts(self, data: np.ndarray, offsets: np.ndarray, size: int = 4 * tk.CHUNK):
        """For slices of texts that lie in ``data`` one after another: (first, last + 1, ids, offsets of each text's ids).

        All slices are split into pre-tokens first, so that the pairs of all their new words are indexed together.
        """
        if len(self.known) > REMEMBERED:
            self.forget()
        spans, firsts, tokens = [], [], []
        for a, b in tk.chunks(offsets, size):
            piece, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            begin = np.concatenate([pretokens(piece[own[x] : own[y]], own[x : y + 1] - own[x]) + own[x] for x, y in tk.chunks(own)])
            edges = np.append(begin, len(piece)).astype(np.int32 if len(piece) < 1 << 31 else np.int64)
            tokens.append(pa.Array.from_buffers(pa.binary() if edges.itemsize == 4 else pa.large_binary(), len(begin), [None, pa.py_buffer(edges), pa.py_buffer(piece)]))
            spans.append((a, b))
            firsts.append(np.searchsorted(begin, own))
        if not spans:
            return
        if len({t.type for t in tokens}) > 1:
            tokens = [t.cast(pa.large_binary()) for t in tokens]
        coded = pa.chunked_array(tokens).dictionary_encode()
        words = coded.chunk(coded.num_chunks - 1).dictionary.cast(pa.large_binary())
        indices = [c.indices.to_numpy(zero_copy_only=False) for c in coded.chunks]
        del tokens, coded
        found = pc.index_in(words, value_set=self.known)
        number = found.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int32)
        if found.null_count:
            fresh = found.is_null()
            new = words.filter(fresh)
            number[fresh.to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(len(new))
            spelled, ends = tk.text_buffer(new)
            for a, b in tk.chunks(ends, INDEXED):
                ids, count = self.merge(spelled[ends[a] : ends[b]], np.diff(ends[a : b + 1]))
                self.flat = np.concatenate([self.flat, ids])
                self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(count)])
            self.known = pa.concat_arrays([self.known, new])
        for k, ((a, b), first) in enumerate(zip(spans, firsts)):
            own = number[indices[k]]
            indices[k] = None
            length = self.at[own + 1] - self.at[own]
            reach = np.concatenate([[0], np.cumsum(length)])
            yield a, b, self.flat[ragged(self.at[own], length)], reach[first]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and the n + 1 offsets of each text's ids."""
        parts = list(self.encode_parts(data, offsets))
        ends, total = [np.zeros(1, np.int64)], 0
        for _, _, ids, own in parts:
            ends.append(total + own[1:])
            total += len(ids)
        return np.concatenate([np.zeros(0, np.int32), *(p[2] for p in parts)]), np.concatenate(ends)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids, and the offsets of each text's bytes."""
        length = self.length[ids]
        reach = np.concatenate([[0], np.cumsum(length)])
        out = [self.bytes[ragged(self.start[ids[a : a + tk.CHUNK]], length[a : a + tk.CHUNK])] for a in range(0, len(ids), tk.CHUNK)]
        return np.concatenate(out) if out else np.zeros(0, np.uint8), reach[offsets]


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


#: Bytes of rows that are encoded together, whatever the size of the batches they come in.
TOGETHER = 32 << 20


def together(batches, size: int = TOGETHER):
    """The rows of small batches in batches of about ``size`` bytes."""
    held, total = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            total += batch.nbytes
            if total >= size:
                yield _one(held)
                held, total = [], 0
    if held:
        yield _one(held)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _lists(ids: np.ndarray, offsets: np.ndarray, missing: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()), mask=pa.array(missing))


def encode(df: DataFrame, column: str = "text", into: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """``df`` with the ids of ``column`` as an array<int> column ``into`` (an existing one of that name, in any case, is replaced).

    Defined results: a null text has null ids, an empty one an empty array; texts of any length are encoded whole; every
    other column and row is kept as it is.
    """
    others = [f for f in df.schema.fields if f.name.lower() != into.lower()]
    schema = T.StructType([*others, T.StructField(into, T.ArrayType(T.IntegerType()))])
    names = [f.name for f in schema.fields]

    def run(batches):
        own = codec(path)
        for batch in together(batches):
            for a, b, ids, ends in own.encode_parts(*tk.text_buffer(batch.column(column))):
                part = batch.slice(a, b - a)
                lists = _lists(ids, ends, part.column(column).is_null().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names[:-1]), lists], names=names)

    return df.select(*[f"`{f.name}`" for f in others]).mapInArrow(run, schema)


def _texts(data: np.ndarray, ends: np.ndarray, missing: np.ndarray) -> pa.Array:
    raw = pa.Array.from_buffers(pa.large_binary(), len(missing), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
    try:
        text = raw.cast(pa.large_string())
    except pa.ArrowInvalid:
        text = pa.array([w.decode("utf-8", "replace") for w in raw.to_pylist()], pa.large_string())
    text = text.cast(pa.string())
    return pc.if_else(pa.array(missing), pa.scalar(None, pa.string()), text) if missing.any() else text


def decode(df: DataFrame, column: str = "ids", into: str = "decoded", path: str = VOCABULARY) -> DataFrame:
    """``df`` with the text that the ids of ``column`` stand for as ``into`` (an existing one of that name, in any case, is replaced).

    Defined results: null ids give a null text, an empty array an empty one; ids that aren't in the vocabulary raise an
    error; bytes that aren't valid UTF-8 (ids cut within a character) become U+FFFD.
    """
    others = [f for f in df.schema.fields if f.name.lower() != into.lower()]
    schema = T.StructType([*others, T.StructField(into, T.StringType())])
    names = [f.name for f in schema.fields]

    def run(batches):
        own = codec(path)
        for batch in batches:
            if batch.num_rows:
                lists = batch.column(column)
                missing = lists.is_null().to_numpy(zero_copy_only=False)
                length = np.where(missing, 0, np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                data, ends = own.decode(ids, np.concatenate([[0], np.cumsum(length)]))
                text = _texts(data, ends, missing)
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names[:-1]), text], names=names)

    return df.select(*[f"`{f.name}`" for f in others]).mapInArrow(run, schema)


def encode_and_decode(df: DataFrame, column: str = "text", ids: str = "ids", decoded: str = "decoded", path: str = VOCABULARY) -> DataFrame:
    """``decode(encode(df))`` in one pass of one worker: the texts' ids, and the texts that these stand for.

    Results are defined as those of encode and decode; existing columns of the new names are replaced.
    """
    others = [f for f in df.schema.fields if f.name.lower() not in (ids.lower(), decoded.lower())]
    schema = T.StructType([*others, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])
    names = [f.name for f in schema.fields]

    def run(batches):
        own = codec(path)
        for batch in together(batches):
            for a, b, made, ends in own.encode_parts(*tk.text_buffer(batch.column(column))):
                part = batch.slice(a, b - a)
                missing = part.column(column).is_null().to_numpy(zero_copy_only=False)
                columns = [*(part.column(n) for n in names[:-2]), _lists(made, ends, missing), _texts(*own.decode(made, ends), missing)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.select(*[f"`{f.name}`" for f in others]).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, ids, n_ids and the text decoded from them, for every row of ``docs(doc_id, text)``."""
    done = encode_and_decode(docs.select("doc_id", "text"), path=path)
    return done.select("doc_id", "ids", F.when(F.col("ids").isNotNull(), F.size("ids")).alias("n_ids"), "decoded")
