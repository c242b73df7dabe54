"""Language-model scores from Brown classes: exchange clustering, class transitions, word emissions, perplexity.

The model is the class bigram p(w | v) = p(class(w) | class(v)) p(w | class(w)).  Its counts are taken over the whole corpus:

1.  Words are counted (each task adds up what it reads, one shuffle adds up tasks).
2.  The ``vocabulary`` most frequent words get numbers; every other word is the word *rare* for now, and a text begins after
    the word *start*; so every word of every text counts.  Pairs of neighbouring numbers are counted the same way and written
    to the shared folder; that table has at most (vocabulary + 2)**2 rows however large the corpus is.
3.  Exchange clustering (Kneser and Ney, 1993; in rounds over counts that are gathered anew, as Uszkoreit and Brants, 2008):
    a round sums, for every word, how often each class stands before and after it - a bounded dense table - and moves each
    word, most frequent first, to the class that raises the likelihood of the class bigram most.  The likelihood is
    measured exactly after each round, and the best assignment is kept.
4.  Every other word is placed too: how often each class (or *rare*) stands before and after it is gathered by the word's
    hash, and it goes to the class where adding them raises the same likelihood most, the table held.  Hash, class and
    count of all these words, a table that grows with the corpus, lie in the shared folder as shards sorted by hash; a
    shard is written whole by one task.  Then the pairs of classes are counted anew over all words.
5.  Texts are scored where they are read.  Frequent words are looked up in the model, all others by hash in the shards,
    which are mapped where the shared folder is mounted (and read where it isn't), so no task holds the table.

Words are runs of non-blank bytes after ASCII letters are made small and ASCII punctuation made blank, told apart by 64-bit
hashes.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.llm import files
from nearfold.llm import textkernel as tk
from nearfold.llm.frames import new_folder

VOCABULARY = 8192
CLASSES = 64
ROUNDS = 4
#: Weight of the classes' own frequencies against the counts after a class.
PRIOR = 20.0
#: Keys that a task holds before it hands over what it has counted.
HELD = 3_000_000
#: Tasks that sum class contexts from the bounded table of pairs, and the parts of that sum.
READERS, BLOCKS = 16, 16
#: Words beyond the vocabulary that a shard should have.
SHARD_WORDS = 1 << 16
#: Contexts of such words that a task holds before it hands them over.
CONTEXTS_HELD = 1_000_000
SCORE_SCHEMA = "doc_id long, n_words long, log_prob double, perplexity double"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[c for c in range(33, 127) if not chr(c).isalnum()]] = 32


def word_hashes(data: np.ndarray, offsets: np.ndarray):
    """For chunks of the texts: the first text, the hashes of their words, and where each text's words begin."""
    for a, b in tk.chunks(offsets):
        words = tk.Words(_FOLD[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a])
        yield a, words.hashes(), words.first


class Tally:
    """Counts of 64-bit keys, handed over when there are many and at the end."""

    def __init__(self, names: list[str]):
        self.names, self.keys, self.counts, self.held = names, [], [], 0

    def add(self, keys: np.ndarray) -> None:
        k, c = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.counts.append(c)
        self.held += len(k)

    def merged(self) -> None:
        k, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        c = np.bincount(at, weights=np.concatenate(self.counts)).astype(np.int64)
        self.keys, self.counts, self.held = [k], [c], len(k)

    def flush(self, last: bool = False):
        if self.held > HELD or (last and self.held):
            before = self.held
            self.merged()
            if last or self.held > before // 2:
                yield pa.RecordBatch.from_arrays([pa.array(tk.to_long(self.keys[0])), pa.array(self.counts[0])], names=self.names)
                self.keys, self.counts, self.held = [], [], 0


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often each word, as its hash, occurs in ``docs(text)``."""

    def run(batches):
        tally = Tally(["word", "n"])
        for batch in batches:
            if batch.num_rows:
                for _, h, _ in word_hashes(*tk.text_buffer(batch.column("text"))):
                    tally.add(h)
                    yield from tally.flush()
        yield from tally.flush(last=True)

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Sorted hashes and their numbers; ``count`` by number; words beyond it are ``rare``, of which there are ``types``."""

    word: np.ndarray
    number: np.ndarray
    count: np.ndarray
    types: int

    @property
    def rare(self) -> int:
        return len(self.count)

    @property
    def start(self) -> int:
        return len(self.count) + 1

    def numbers(self, h: np.ndarray) -> np.ndarray:
        if not len(self.word):
            return np.full(len(h), self.rare, np.int64)
        at = np.minimum(np.searchsorted(self.word, h), len(self.word) - 1)
        return np.where(self.word[at] == h, self.number[at], self.rare)


def vocabulary(counts: DataFrame, size: int) -> Vocabulary:
    rows = counts.orderBy(F.desc("n"), "word").limit(size).collect()
    types = counts.count()
    word = np.array([r["word"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(word)
    return Vocabulary(word[order], order.astype(np.int64), np.array([r["n"] for r in rows], np.int64), max(types - len(rows), 0))


def pairs_of(number: np.ndarray, first: np.ndarray, start: int) -> np.ndarray:
    """The number before each word."""
    before = np.empty_like(number)
    before[1:] = number[:-1]
    begin = first[:-1][np.diff(first) > 0]
    before[begin] = start
    return before


def pair_counts(docs: DataFrame, held: Vocabulary) -> DataFrame:
    """(a, b, n): how often number b follows number a within a text of ``docs(text)``."""
    base = held.start + 1

    def run(batches):
        tally = Tally(["pair", "n"])
        for batch in batches:
            if batch.num_rows:
                for _, h, first in word_hashes(*tk.text_buffer(batch.column("text"))):
                    number = held.numbers(h)
                    tally.add(pairs_of(number, first, held.start) * base + number)
                    yield from tally.flush()
        yield from tally.flush(last=True)

    counted = docs.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return counted.select(F.expr(f"int(pair div {base})").alias("a"), F.expr(f"int(pair % {base})").alias("b"), "n")


def contexts(pairs: DataFrame, of: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each number how often each class follows it, how often each class stands before it, and it follows itself."""
    size = len(of)
    cells = size * (2 * classes + 1)
    edges = np.linspace(0, cells, BLOCKS + 1).astype(np.int64)

    def run(batches):
        total = np.zeros(cells, np.int64)
        for batch in batches:
            a, b, n = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a", "b", "n"))
            total[: size * classes] += np.bincount(a * classes + of[b], weights=n, minlength=size * classes).astype(np.int64)
            total[size * classes : 2 * size * classes] += np.bincount(b * classes + of[a], weights=n, minlength=size * classes).astype(np.int64)
            same = a == b
            total[2 * size * classes :] += np.bincount(a[same], weights=n[same], minlength=size).astype(np.int64)
        parts = [total[edges[k] : edges[k + 1]].tobytes() for k in range(BLOCKS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array(parts, pa.binary())], names=["block", "part"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(p, np.int64) for p in table.column("part").to_pylist())
        return pa.table({"block": table.column("block").slice(0, 1), "part": pa.array([total.tobytes()], pa.binary())})

    schema = "block int, part binary"
    rows = pairs.coalesce(READERS).mapInArrow(run, schema).groupBy("block").applyInArrow(add, schema).collect()
    whole = np.zeros(cells, np.int64)
    for r in rows:
        whole[edges[r["block"]] : edges[r["block"] + 1]] = np.frombuffer(bytes(r["part"]), np.int64)
    return whole[: size * classes].reshape(size, classes), whole[size * classes : 2 * size * classes].reshape(size, classes), whole[2 * size * classes :]


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def class_pairs(right: np.ndarray, of: np.ndarray, classes: int) -> np.ndarray:
    out = np.zeros((classes, classes))
    np.add.at(out, of, right)
    return out


def likelihood(table: np.ndarray) -> float:
    """The part of the log-likelihood of a class bigram that depends on the classes."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(axis=1)).sum() - _xlogx(table.sum(axis=0)).sum())


def exchange(of: np.ndarray, right: np.ndarray, left: np.ndarray, own: np.ndarray, movable: int, free: int, classes: int) -> np.ndarray:
    """One round: each of the first ``movable`` numbers goes to the best of the first ``free`` classes, ties to the least."""
    of = of.copy()
    table = class_pairs(right, of, classes)
    size = np.bincount(of[:movable], minlength=classes)
    for w in range(movable):
        was = of[w]
        if size[was] == 1:
            continue
        r, l, s = right[w].astype(float), left[w].astype(float), float(own[w])
        r[was] -= s
        l[was] -= s
        table[was] -= r
        table[:, was] -= l
        table[was, was] -= s
        np.maximum(table, 0, out=table)
        row, column = table.sum(axis=1), table.sum(axis=0)
        here = np.diag(table)
        gain = (_xlogx(table + r) - _xlogx(table)).sum(axis=1) + (_xlogx(table + l[:, None]) - _xlogx(table)).sum(axis=0)
        gain += _xlogx(here + r + l + s) - _xlogx(here + r) - _xlogx(here + l) + _xlogx(here)
        out, into = r.sum() + s, l.sum() + s
        gain -= _xlogx(row + out) - _xlogx(row) + _xlogx(column + into) - _xlogx(column)
        now = int(np.argmax(gain[:free]))
        if gain[now] <= gain[was] + 1e-9:
            now = was
        table[now] += r
        table[:, now] += l
        table[now, now] += s
        size[was] -= 1
        size[now] += 1
        of[w] = now
    return of


def cluster(pairs: DataFrame, held: Vocabulary, classes: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The class of every number and the counts of pairs of classes; *rare* and *start* have classes of their own."""
    free = max(1, min(classes, held.rare))
    of = np.concatenate([np.arange(held.rare) % free, [free, free + 1]]).astype(np.int64)
    best = None
    for k in range(rounds + 1):
        right, left, own = contexts(pairs, of, free + 2)
        table = class_pairs(right, of, free + 2)
        value = likelihood(table)
        if best is None or value > best[0]:
            best = value, of, table
        elif value <= best[0]:
            break
        if k < rounds:
            of = exchange(of, right, left, own, held.rare, free, free + 2)
    return best[1], best[2]


@dataclass
class Placed:
    """The words beyond the vocabulary, their classes and counts, in 2**bits shards in ``folder`` by their hashes' first bits."""

    folder: str
    bits: int

    def shard(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int32) if self.bits else np.zeros(len(h), np.int32)

    def write(self, shard: int, word: np.ndarray, of: np.ndarray, count: np.ndarray) -> None:
        """``word`` must go up."""
        parts = [np.array([len(word)], "<i8"), word.astype("<u8"), count.astype("<i8"), of.astype("<i4")]
        files.put(self.folder, f"words-{shard:06d}", [x.tobytes() for x in parts])

    def read(self, shard: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, path = files.opened(self.folder)
        name = f"words-{shard:06d}"
        try:
            raw = pa.memory_map(f"{path}/{name}").read_buffer() if isinstance(at, fs.LocalFileSystem) else files.get(self.folder, name)
        except FileNotFoundError:  # no word has such a hash
            return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64)
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        return np.frombuffer(raw, "<u8", n, 8), np.frombuffer(raw, "<i4", n, 8 + 16 * n), np.frombuffer(raw, "<i8", n, 8 + 8 * n)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class and the count of each word; -1 and 0 for words that aren't here."""
        wanted, back = np.unique(h, return_inverse=True)
        of, count = np.full(len(wanted), -1, np.int64), np.zeros(len(wanted), np.int64)
        shard = self.shard(wanted)
        for k in np.unique(shard).tolist():
            lo, hi = np.searchsorted(shard, [k, k + 1])
            word, cls, n = self.read(k)
            if len(word):
                at = np.minimum(np.searchsorted(word, wanted[lo:hi]), len(word) - 1)
                ok = word[at] == wanted[lo:hi]
                of[lo:hi] = np.where(ok, cls[at], -1)
                count[lo:hi] = np.where(ok, n[at], 0)
        return of[back], count[back]


@dataclass
class Model:
    """``of`` and ``emit`` by number; ``table`` counts pairs of classes, ``total`` words by class; ``placed`` has all other words."""

    held: Vocabulary
    of: np.ndarray
    step: np.ndarray
    emit: np.ndarray
    table: np.ndarray
    total: np.ndarray
    placed: Placed | None = None

    def classes(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class of each word and its log-probability within the class."""
        number = self.held.numbers(h)
        of, emit = self.of[number], self.emit[number]
        if self.placed:
            at = np.flatnonzero(number == self.held.rare)
            own, n = self.placed.find(h[at])
            at, own, n = at[own >= 0], own[own >= 0], n[own >= 0]
            of[at], emit[at] = own, np.log(n) - np.log(self.total[own])
        return of, emit

    def log_probs(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        of, emit = self.classes(h)
        return self.step[pairs_of(of, first, self.of[self.held.start]), of] + emit


def model_of(held: Vocabulary, of: np.ndarray, table: np.ndarray, others: np.ndarray | float = 0.0, placed: Placed | None = None) -> Model:
    """Smoothed probabilities: transitions are drawn to the classes' frequencies, rare words share their class evenly.

    ``others``: how many of the words of each class are ``placed`` ones.
    """
    into = table.sum(axis=0) + 1.0
    into[of[held.start]] = 1e-300  # nothing goes back to the start
    share = into / into.sum()
    step = np.log((table + PRIOR * share) / (table.sum(axis=1, keepdims=True) + PRIOR))
    total = np.bincount(of[: held.rare], weights=held.count, minlength=len(table)) + others
    emit = np.zeros(held.rare + 2)
    emit[: held.rare] = np.log(held.count / np.maximum(total[of[: held.rare]], 1))
    emit[held.rare] = -np.log(held.types + 1)
    return Model(held, of, step, emit, table, total, placed)


def word_contexts(docs: DataFrame, model: Model, placed: Placed) -> DataFrame:
    """(shard, word, context, n): how often a class stands before (context: the class) or after (the class and the number of
    classes) each word of ``docs(text)`` that the vocabulary hasn't; a task may give a word and context several times."""
    held, of, classes = model.held, model.of, len(model.table)

    def summed(words: list[np.ndarray], contexts: list[np.ndarray]):
        word, context = np.concatenate(words), np.concatenate(contexts)
        order = np.lexsort((context, word))
        word, context = word[order], context[order]
        at = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (context[1:] != context[:-1])]))
        n = np.diff(at, append=len(word))
        columns = [pa.array(placed.shard(word[at])), pa.array(tk.to_long(word[at])), pa.array(context[at].astype(np.int32)), pa.array(n.astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=["shard", "word", "context", "n"])

    def run(batches):
        words, contexts, have = [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            for _, h, first in word_hashes(*tk.text_buffer(batch.column("text"))):
                number = held.numbers(h)
                own = of[number]
                rare = number == held.rare
                last = np.zeros(len(h), bool)
                last[first[1:][np.diff(first) > 0] - 1] = True
                on = np.flatnonzero(rare & ~last)
                words += [h[rare], h[on]]
                contexts += [pairs_of(own, first, of[held.start])[rare], own[on + 1] + classes]
                have += len(words[-1]) + len(words[-2])
                if have > CONTEXTS_HELD:
                    yield summed(words, contexts)
                    words, contexts, have = [], [], 0
        if have:
            yield summed(words, contexts)

    return docs.select("text").mapInArrow(run, "shard int, word long, context int, n long")


def best_classes(first: np.ndarray, context: np.ndarray, n: np.ndarray, table: np.ndarray, free: int) -> np.ndarray:
    """For words whose contexts begin at ``first``: which of the first ``free`` classes raises the likelihood most, ties to the least."""
    classes = len(table)
    cell = np.concatenate([table[:, :free], table[:free].T])  # by context and class: the count that a word there adds to
    few = 16
    gain_of = np.stack([_xlogx(cell + k) - _xlogx(cell) for k in range(few)])
    row, column = table.sum(axis=1)[:free], table.sum(axis=0)[:free]
    last = np.concatenate([first[1:], [len(n)]])
    out = np.empty(len(first), np.int64)
    at = 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(last, first[at] + 20_000, side="right")))
        a, b = first[at], last[to - 1]
        m, c = n[a:b], context[a:b]
        gain = gain_of[np.minimum(m, few - 1), c]
        many = np.flatnonzero(m >= few)
        gain[many] = _xlogx(cell[c[many]] + m[many, None]) - _xlogx(cell[c[many]])
        begin = first[at:to] - a
        gain = np.add.reduceat(gain, begin, axis=0)
        into = np.add.reduceat(np.where(c < classes, m, 0), begin)[:, None]
        onto = np.add.reduceat(np.where(c < classes, 0, m), begin)[:, None]
        gain -= _xlogx(row + onto) - _xlogx(row) + _xlogx(column + into) - _xlogx(column)
        out[at:to] = gain.argmax(axis=1)
        at = to
    return out


def class_counts(docs: DataFrame, model: Model) -> np.ndarray:
    """How often each class follows each class in ``docs(text)``, all words in their places."""
    classes = len(model.table)

    def run(batches):
        total = np.zeros(classes * classes, np.int64)
        for batch in batches:
            if batch.num_rows:
                for _, h, first in word_hashes(*tk.text_buffer(batch.column("text"))):
                    of, _ = model.classes(h)
                    total += np.bincount(pairs_of(of, first, model.of[model.held.start]) * classes + of, minlength=classes * classes)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["pair", "n"])

    out = np.zeros(classes * classes)
    for r in docs.select("text").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r["pair"]] = r["n"]
    return out.reshape(classes, classes)


def complete(docs: DataFrame, model: Model) -> Model:
    """``model`` with a class and a count for every word of ``docs(text)``, the texts that it was trained on."""
    held, table = model.held, model.table
    if not held.types or not held.rare:
        return model
    docs = docs.select("text").where("text IS NOT NULL")
    placed = Placed(new_folder(docs.sparkSession, "placed"), max(0, (held.types // SHARD_WORDS).bit_length()))
    files.make(placed.folder)
    free, classes = int(model.of[held.rare]), len(table)

    def place(rows: pa.Table) -> pa.Table:
        word, context, n = (rows.column(c).to_numpy() for c in ("word", "context", "n"))
        word = word.view(np.uint64)
        order = np.lexsort((context, word))
        word, context, n = word[order], context[order], n[order]
        at = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (context[1:] != context[:-1])]))
        word, context, n = word[at], context[at], np.add.reduceat(n, at)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        count = np.add.reduceat(np.where(context < classes, n, 0), first)  # something stands before every word
        of = best_classes(first, context, n, table, free)
        shard = rows.column("shard")[0].as_py()
        placed.write(shard, word[first], of, count)
        total = np.bincount(of, weights=count, minlength=classes).astype(np.int64)
        return pa.table({"class": np.arange(classes, dtype=np.int32), "n": total})

    others = np.zeros(classes)
    for r in word_contexts(docs, model, placed).groupBy("shard").applyInArrow(place, "class int, n long").groupBy("class").agg(F.sum("n").alias("n")).collect():
        others[r["class"]] = r["n"]
    known = replace(held, types=0)
    table = class_counts(docs, model_of(known, model.of, table, others, placed))
    return model_of(known, model.of, table, others, placed)


def train(docs: DataFrame, size: int = VOCABULARY, classes: int = CLASSES, rounds: int = ROUNDS) -> Model:
    """The model of all texts of ``docs(text)`` that has all but its ``size`` words as one; null texts count for nothing."""
    docs = docs.select("text").where("text IS NOT NULL")
    spark = docs.sparkSession
    words = new_folder(spark, "words")
    word_counts(docs).write.parquet(words)
    held = vocabulary(spark.read.schema("word long, n long").parquet(words), size)
    folder = new_folder(spark, "pairs")
    pair_counts(docs, held).write.parquet(folder)
    of, table = cluster(spark.read.schema("a int, b int, n long").parquet(folder), held, classes, rounds)
    return model_of(held, of, table)


def score(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_words, log_prob and perplexity of every row of ``docs(doc_id, text)``, by a model of all its texts and words.

    Defined results: a null or blank text has no words, log_prob 0 and a null perplexity; a null doc_id is carried;
    repeated rows are counted and scored each; ties in frequency go to the lower hash; other columns are ignored; an
    empty table gives an empty result.
    """
    model = model or complete(docs, train(docs))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for a, h, first in word_hashes(*tk.text_buffer(batch.column("text"))):
                p = np.concatenate([[0.0], np.cumsum(model.log_probs(h, first))])
                n[a : a + len(first) - 1] = np.diff(first)
                total[a : a + len(first) - 1] = p[first[1:]] - p[first[:-1]]
            perplexity = pa.array(np.exp(-total / np.maximum(n, 1)), mask=n == 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(total), perplexity], names=["doc_id", "n_words", "log_prob", "perplexity"])

    return docs.select("doc_id", "text").mapInArrow(run, SCORE_SCHEMA)
