"""Benchmark decontamination: CGK embedding, bit sampling LSH over item-sized windows, exact edit verification.

Distances count words: an item of n words leaks into a text if some stretch of it can be turned into the item by
floor(n * rate) insertions, deletions and replacements of words at most.

The CGK random walk (Chakraborty, Goldenberg and Koucky, 2016) copies the word under a pointer again and again, and whether
the pointer moves on after a copy is a random bit of the step and the word; so texts at a small edit distance get embeddings
at a small Hamming distance.  A repetition of the bit sampling hashes the words at ``COORDINATES`` random places of a walk;
windows of an item's size are looked up in a table of the items' hashes, and each item found in any repetition is a
candidate.  How many repetitions are needed follows from ``target_recall``: for every length of item, windows that are
edited up to the limit and begin a little off are simulated, and walks are added until that share of them collides.
Candidates are verified by the exact edit distance of the item to the best stretch around the window.

An item of more than ``LONG`` words is searched by parts of at most that many: if a stretch is within rate * n edits of the
item, one of the parts at least is within that rate too, and it leads to the whole item, which is verified.

Most windows needn't be embedded: if a part is cut into k + 1 pieces, a stretch within k edits has one of them unchanged,
shifted by k words at most.  So only windows around an occurrence of a piece's beginning (its first three words, or fewer
if the piece is shorter) are looked up; this skips no window within the distance.  Around a piece windows begin at every
(1 + k // 8)-th word.

Texts stay where they are read: there is no shuffle.  The items are sent to the workers in parts of at most ``SENT`` bytes,
each with its own scan, so that a larger benchmark needs more passes and not more memory.  What is held of an item is about
eight bytes a word and for each repetition; nothing is padded to the longest item.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.llm import textkernel as tk

#: Bytes of items that one scan works with.
SENT = 16 << 20
PIECE = 3
#: Words of the longest part of an item that is looked for at once.
LONG = 48
COORDINATES = 2
#: Samples of coordinates that are taken of each walk, and simulated windows for each length of item.
SAMPLES, TRIALS = 4, 300
TARGET_RECALL = 0.99
#: Cells of arrays that are worked on at once.
CELLS = 1 << 18
FOUND_SCHEMA = "doc_id long, item_id long, start long, n_words long, edits long"


def grams(h: np.ndarray, g: int) -> np.ndarray:
    """A hash of every run of g words, wherever texts end."""
    n = len(h) - g + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(g):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += h[k : k + n] ^ np.uint64(g)
    return out * np.uint64(0x9E3779B97F4A7C15)


def best_stretches(item: np.ndarray, n: np.ndarray, text: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each pair of rows the least edit distance of the item's n words to a stretch of the text's ``size`` words.

    Also where the stretch begins and ends; of equally near ones the first, then the shortest.
    """
    pairs, width = text.shape
    # Edits in the high bits and the stretch's beginning in the low ones, so that the least number is the best stretch.
    one = np.int64(1) << 32
    column = np.arange(width + 1, dtype=np.int64)
    line = np.broadcast_to(column, (pairs, width + 1)).copy()
    out = np.zeros((3, pairs), np.int64)
    beyond = column > size[:, None]
    for i in range(item.shape[1] + 1):
        ended = np.flatnonzero(n == i)
        if len(ended):
            last = np.where(beyond[ended], np.iinfo(np.int64).max, line[ended])
            at = last.argmin(axis=1)
            value = last[np.arange(len(ended)), at]
            out[:, ended] = value >> 32, value & (one - 1), at
        if i == item.shape[1]:
            break
        fresh = line + one
        np.minimum(fresh[:, 1:], line[:, :-1] + (item[:, i : i + 1] != text) * one, out=fresh[:, 1:])
        # Words that only the text has: the least of x[j'] + j - j' over j' up to j.
        fresh -= column * one
        np.minimum.accumulate(fresh, axis=1, out=fresh)
        fresh += column * one
        line = fresh
    return out[0], out[1], out[2]


def ragged(h: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Rows of the n hashes from ``begin`` on, with zeros after them."""
    step = np.arange(int(n.max(initial=0)))
    at = begin[:, None] + step
    inside = step < n[:, None]
    return np.where(inside, h[np.where(inside, at, 0)], np.uint64(0)) if len(h) else np.zeros((len(n), len(step)), np.uint64)


class Walks:
    """The random bits of the walks and the coordinates that are sampled; more walks don't change the first ones."""

    def __init__(self, walks: int, steps: int, seed: int):
        make = lambda w: np.random.Generator(np.random.PCG64([seed, w]))
        #: As fractions of a walk's length, so that every length samples its whole walk.
        self.sample = [make(w).random((SAMPLES, COORDINATES)) for w in range(walks)]
        self.salt = [np.random.Generator(np.random.PCG64([seed, w, 1])).integers(1, 1 << 63, steps, dtype=np.uint64) for w in range(walks)]

    def keys(self, word: np.ndarray, n: np.ndarray) -> np.ndarray:
        """For rows of words of which the first n count a hash for each repetition.

        A walk has 2 n steps: moving half the time, its pointer gets to the end by then.  A repetition that samples a place
        beyond the last word has the hash 0, which is equal to none.
        """
        rows = np.arange(len(word))
        width = word.shape[1]
        padded = np.concatenate([word, np.zeros((len(word), 1), np.uint64)], axis=1)
        out = np.empty((len(word), len(self.salt) * SAMPLES), np.uint64)
        walked = np.zeros((len(word), 2 * width), np.uint64)
        for w, (salt, sample) in enumerate(zip(self.salt, self.sample)):
            at = np.zeros(len(word), np.int64)
            for t in range(2 * width):
                under = padded[rows, np.minimum(at, n)]
                walked[:, t] = under
                at += (((under ^ salt[t]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)).astype(np.int64)
            for s in range(SAMPLES):
                r = w * SAMPLES + s
                code = (n + 1).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(r)
                within = np.ones(len(word), bool)
                for c in range(COORDINATES):
                    under = walked[rows, (sample[s, c] * (2 * n)).astype(np.int64)]
                    within &= under != 0
                    code = tk.mix(code * np.uint64(0x9E3779B97F4A7C15) + under)
                out[:, r] = np.where(within, code, np.uint64(0))
        return out


def collide(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of hashes have one in common."""
    return ((a == b) & (a != 0)).any(axis=1)


def stride(k: np.ndarray | int):
    """Windows around a piece begin at every such word."""
    return 1 + k // 8


def simulated(n: int, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """An item of n words again and again, and windows of its size on copies with k edits, a little before or after them."""
    rng = np.random.Generator(np.random.PCG64([seed, n]))
    item = rng.integers(1, 1 << 63, (TRIALS, n), dtype=np.uint64)
    half = int(stride(k)) // 2
    window = np.zeros((TRIALS, n), np.uint64)
    for t in range(TRIALS):
        ws = item[t].tolist()
        for kind in rng.integers(0, 3, k).tolist():
            at = int(rng.integers(0, max(1, len(ws))))
            if kind == 0:
                ws[at : at + 1] = [int(rng.integers(1, 1 << 63))]
            elif kind == 1:
                ws[at:at] = [int(rng.integers(1, 1 << 63))]
            else:
                del ws[at]
        more = rng.integers(1, 1 << 63, half + n, dtype=np.uint64).tolist()
        begin = half + int(rng.integers(-half, half + 1))
        window[t] = np.array((more[:half] + ws + more[half:])[begin : begin + n], np.uint64)
    return item, window


@functools.lru_cache(maxsize=4096)
def walks_needed(n: int, k: int, target: float, seed: int) -> int:
    """Walks with which that share of edited windows collides with their items."""
    if k == 0:
        return 1
    item, window = simulated(n, k, seed)
    rows = max(1, CELLS // (2 * n))
    walks, hit = 0, np.zeros(TRIALS, bool)
    size = np.full(TRIALS, n)
    while hit.mean() < target:
        walks += 1
        own = Walks(walks, 2 * n, seed)
        own.sample, own.salt = own.sample[-1:], own.salt[-1:]
        for a in range(0, TRIALS, rows):
            left = np.arange(a, min(a + rows, TRIALS))
            left = left[~hit[left]]
            if len(left):
                hit[left] = collide(own.keys(item[left], size[left]), own.keys(window[left], size[left]))
    return walks


class Items:
    """The items of one part, and what is looked up while texts are scanned."""

    def __init__(self, ids: list[int], texts: list[str], rate: float, target: float, seed: int):
        data, offsets = tk.text_buffer(pa.array(texts, pa.large_string()))
        words = tk.Words(data, offsets)
        self.h, self.first = words.hashes(), words.first
        self.n = np.diff(words.first)
        has = np.flatnonzero(self.n > 0)
        self.id = np.array(ids, np.int64)
        self.k = np.floor(self.n * rate + 1e-9).astype(np.int64)
        #: The parts: the item each is of, where it begins in the item, its words and its edits.
        parts = [(j, int(self.n[j]) * p // c, int(self.n[j]) * (p + 1) // c) for j in has.tolist() for c in [-(-int(self.n[j]) // LONG)] for p in range(c)]
        self.owner, self.offset, end = (np.array(x, np.int64) for x in (zip(*parts) if parts else ((), (), ())))
        self.size = end - self.offset
        self.edits = np.floor(self.size * rate + 1e-9).astype(np.int64)
        begin = self.first[self.owner] + self.offset if parts else np.zeros(0, np.int64)
        seeds: dict[int, list[tuple[int, int, int]]] = {}
        for j, (n, k) in enumerate(zip(self.size.tolist(), self.edits.tolist())):
            own = self.h[begin[j] : begin[j] + n]
            at = [n * p // (k + 1) for p in range(k + 2)]
            for p in range(k + 1):
                g = min(PIECE, at[p + 1] - at[p])
                seeds.setdefault(g, []).append((int(grams(own[at[p] : at[p] + g], g)[0]), j, at[p]))
        #: For each length: the seeds' hashes in order, the part and the place of each, and a bitmap of hash prefixes.
        self.seeds = {}
        for g, rows in seeds.items():
            rows.sort()
            key = np.array([r[0] for r in rows], np.uint64)
            near = np.zeros(1 << 20, bool)
            near[(key >> np.uint64(44)).astype(np.int64)] = True
            self.seeds[g] = key, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), near
        needed = max((walks_needed(n, k, target, seed) for n, k in set(zip(self.size.tolist(), self.edits.tolist()))), default=1)
        self.walks = Walks(needed, 2 * LONG, seed)
        #: The parts' hashes of all repetitions in order, and the parts they are of.
        keys, owner = [], []
        for some in self.blocks(np.arange(len(parts)), self.size):
            made = self.walks.keys(ragged(self.h, begin[some], self.size[some]), self.size[some])
            keys.append(made.reshape(-1))
            owner.append(np.repeat(some, made.shape[1]))
        self.key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(self.key, kind="stable")
        order = order[self.key[order] != 0]
        self.key, self.part = self.key[order], (np.concatenate(owner) if owner else np.zeros(0, np.int64))[order]

    @staticmethod
    def blocks(what: np.ndarray, n: np.ndarray):
        """``what`` in parts of about CELLS cells, those of like length n together, so that little is padded."""
        order = np.argsort(n, kind="stable")
        what, n = what[order], n[order]
        at = 0
        while at < len(what):
            # Rows are padded to the longest of the part, which is the last.
            fits = np.flatnonzero(n[at : at + CELLS] * np.arange(1, len(n[at : at + CELLS]) + 1) > CELLS)
            to = at + max(1, int(fits[0]) if len(fits) else len(n[at : at + CELLS]))
            yield what[at:to]
            at = to

    def windows(self, h: np.ndarray, first: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows around pieces: the first word of each and its size, once each."""
        found = []
        top = LONG + 1
        for g, (key, owner, place, near) in self.seeds.items():
            code = grams(h, g)
            spot = np.flatnonzero(near[(code >> np.uint64(44)).astype(np.int64)])
            spot = spot[row[spot] == row[spot + g - 1]]
            lo, hi = np.searchsorted(key, code[spot]), np.searchsorted(key, code[spot], side="right")
            keep = hi > lo
            spot, lo, count = spot[keep], lo[keep], (hi - lo)[keep]
            seed = np.repeat(lo, count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
            spot = np.repeat(spot, count)
            part = owner[seed]
            k = self.edits[part]
            step = stride(k)
            reach = 2 * k // step + 1
            shift = (np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)) * np.repeat(step, reach)
            start = np.repeat(spot - place[seed] - k, reach) + shift
            # A text may begin or end within the item: windows begin with it at the earliest and may be shorter.
            start = np.maximum(start, np.repeat(first[row[spot]], reach))
            ok = start < np.repeat(first[row[spot] + 1], reach)
            found.append((start * top + np.repeat(self.size[part], reach))[ok])
        window = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return window // top, window % top

    def candidates(self, h: np.ndarray, first: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows (their first words) and parts with a hash in common."""
        start, n = self.windows(h, first, row)
        starts, parts = [], []
        for some in self.blocks(np.arange(len(start)), n):
            size = np.minimum(n[some], first[row[start[some]] + 1] - start[some])
            word = np.zeros((len(some), int(n[some].max())), np.uint64)
            have = ragged(h, start[some], size)
            word[:, : have.shape[1]] = have
            key = self.walks.keys(word, n[some]).reshape(-1)
            lo, hi = np.searchsorted(self.key, key), np.searchsorted(self.key, key, side="right")
            hit = np.flatnonzero(hi > lo)
            count = (hi - lo)[hit]
            at = np.repeat(lo[hit], count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
            starts.append(np.repeat(start[some][hit // (len(key) // len(some))], count))
            parts.append(self.part[at])
        return (np.concatenate(starts), np.concatenate(parts)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def search(self, h: np.ndarray, first: np.ndarray, row: np.ndarray, exhaustive: bool = False) -> np.ndarray:
        """Stretches within an item's distance: their row, item, first word in the row, words, and edits.

        exhaustive: compares every item with the whole of every text, for measuring the recall of the search.
        """
        if exhaustive:
            r, item = (x.reshape(-1) for x in np.meshgrid(np.flatnonzero(np.diff(first) > 0), np.flatnonzero(self.n > 0), indexing="ij"))
            begin, end = first[r], first[r + 1]
        else:
            start, part = self.candidates(h, first, row)
            item = self.owner[part]
            # Candidates of an item that begin near each other are looked at together.
            wide = 2 * self.k[item] + 1
            cell = np.unique(np.stack([row[start], item, (start - self.offset[part] - first[row[start]]) // wide]), axis=1) if len(start) else np.zeros((3, 0), np.int64)
            r, item = cell[0], cell[1]
            k, wide = self.k[item], 2 * self.k[item] + 1
            # The words before a part may be more or fewer by the edits in them, and so may those after it.
            begin = np.maximum(first[r] + cell[2] * wide - 2 * k, first[r])
            end = np.minimum(first[r] + (cell[2] + 1) * wide + self.n[item] + 3 * k, first[r + 1])
        out = [np.zeros((5, 0), np.int64)]
        for some in self.blocks(np.arange(len(r)), end - begin):
            own, size = item[some], (end - begin)[some]
            edits, a, b = best_stretches(ragged(self.h, self.first[own], self.n[own]), self.n[own], ragged(h, begin[some], size), size)
            ok = edits <= self.k[own]
            out.append(np.stack([r[some], own, begin[some] + a - first[r[some]], b - a, edits])[:, ok])
        return np.concatenate(out, axis=1)


def parts_of(items: DataFrame, rate: float, target: float, seed: int):
    """The items in parts of at most SENT bytes of text; the total is looked at first."""
    items = items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(total // SENT) + 1
    spot = F.pmod(F.xxhash64("item_id"), F.lit(parts))
    for p in range(parts):
        rows = (items if parts == 1 else items.where(spot == p)).orderBy("item_id", "text").collect()
        yield Items([r["item_id"] for r in rows], [r["text"] for r in rows], rate, target, seed)


def _scan(batch: pa.RecordBatch, items: Items, exhaustive: bool = False):
    data, offsets = tk.text_buffer(batch.column("text"))
    for a, b in tk.chunks(offsets):
        words = tk.Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        found = items.search(words.hashes(), words.first, words.row, exhaustive)
        found[0] += a
        yield found


def leaks(docs: DataFrame, items: DataFrame, rate: float = 0.2, target_recall: float = TARGET_RECALL, seed: int = 20160607, exhaustive: bool = False) -> DataFrame:
    """A row for each document and item that leaks into it: the best stretch's first word, its words, and its edits.

    Of the stretches found, the one with the fewest edits counts, then the first, then the shortest.  exhaustive: compares
    every item with every text, without any search (the same definition by brute force; for tests).

    Defined results: null and blank texts and items match nothing; an item of fewer than 1 / rate words must occur
    unchanged; texts and items of any length are taken whole, and a text may begin or end within an item; repeated rows give
    repeated results; a null doc_id is carried as null; rows of items with a null item_id are left out; equal rows of items
    count once, and texts that share an item_id are searched each, the best one of them is given; other columns are ignored;
    empty tables give an empty result.
    """
    found = []
    for part in parts_of(items, rate, target_recall, seed):

        def run(batches, part=part):
            for batch in batches:
                ids = batch.column("doc_id")
                for row, item, start, n_words, edits in _scan(batch, part, exhaustive):
                    if not len(row):
                        continue
                    own = part.id[item]
                    order = np.lexsort((n_words, start, edits, own, row))
                    row, start, n_words, edits, own = row[order], start[order], n_words[order], edits[order], own[order]
                    best = np.ones(len(row), bool)
                    best[1:] = (row[1:] != row[:-1]) | (own[1:] != own[:-1])
                    columns = [ids.take(pa.array(row[best])), *(pa.array(x[best].astype(np.int64)) for x in (own, start, n_words, edits))]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "start", "n_words", "edits"])

        found.append(docs.select("doc_id", "text").where("text IS NOT NULL").mapInArrow(run, FOUND_SCHEMA))
    return functools.reduce(DataFrame.unionAll, found)


def without_leaks(docs: DataFrame, items: DataFrame, rate: float = 0.2, target_recall: float = TARGET_RECALL, seed: int = 20160607) -> DataFrame:
    """The rows of ``docs``, with all their columns, into which no item leaks; null and blank texts stay.  See leaks."""
    for part in parts_of(items, rate, target_recall, seed):

        def run(batches, part=part):
            for batch in batches:
                if batch.num_rows:
                    clean = np.ones(batch.num_rows, bool)
                    for found in _scan(batch, part):
                        clean[found[0]] = False
                    yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
