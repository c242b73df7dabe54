"""Passages that repeat across documents: paragraph MinHash banding, exact Jaccard, removals clustered by components.

Passages that are copied into other texts begin and end anywhere, seldom where lines do.  So paragraphs are blocks of
``BLOCK`` words whose beginnings the words themselves choose, by winnowing (Schleimer, Wilkerson and Aiken, 2003): of every
``REACH`` neighbouring four-word runs the one with the least hash begins a block.  Two texts that share a passage of
REACH + BLOCK = 48 words or more therefore share a whole block of it, wherever it stands in them.

1.  Blocks with equal words have the same hash, by which they are counted (partial sums first).
2.  MinHash signatures of the blocks' three-word shingles, ``BANDS`` bands of ``ROWS`` coordinates; colliding blocks are
    verified by their exact Jaccard similarity and joined to components.  No block or bucket is left out, and no pair
    but two sorts that can't matter: blocks that exactly the same documents have, as those that overlap in a text and its
    copies (joining them removes nothing more), and pairs whose sketches show that they aren't similar (see near_edges).
3.  Of a component's blocks those of the least doc_id stay, those of other documents are removals.  A text's removals that
    touch, or go on in the same document after a short gap, are one passage.  Its ends are moved outwards word by word
    as far as the text and the kept one agree, so that the whole repeat is reported.

Texts aren't shuffled.  They are read four times - for the blocks' places, their bands, the words of those that collide, and
the words around the passages' ends - and a bitmap of hashes says each time which blocks are wanted; reading again costs
less than keeping bands or texts.  What moves is three numbers for each block and band.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfold.llm import textkernel as tk
from nearfold.llm.frames import PART_BYTES, IdFilter, connected_components, packed, stored, verified_edges, whole_groups, with_owned_leader
from nearfold.llm.minhash import jaccard_counts

BLOCK, REACH, GRAM, SHINGLE = 24, 24, 4, 3
#: A pair of Jaccard similarity s shares a band with probability 1 - (1 - s**ROWS)**BANDS: 0.982 at 0.7, 0.993 at 0.75, 0.998 at 0.8.
BANDS, ROWS = 6, 2
#: Words that a passage has at least.
LEAST = 45
#: Blocks that a task holds before it hands over their bands, each block once.
HELD = 200_000
#: Members of a bucket beyond which they are compared by equal pieces of their sketches.
LARGE = 64
#: What a differing word costs against an equal one when a passage's end is moved outwards.
DIFFERENT = 2
PLACE_SCHEMA = "node long, doc_id long, start int"


def sliding(x: np.ndarray, width: int, of=np.minimum) -> np.ndarray:
    """The least (or greatest) of every ``width`` neighbours, by doubling."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    have = 1
    while 2 * have <= width:
        x = of(x[: len(x) - have], x[have:])
        have *= 2
    rest = width - have
    return of(x[:n], x[rest : rest + n])


def anchors(h: np.ndarray, first: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The words at which blocks begin."""
    n = len(h) - GRAM + 1
    chosen = np.zeros(len(h), bool)
    if n >= REACH:
        gram = np.zeros(n, np.uint64)
        for k in range(GRAM):
            gram = (gram ^ h[k : k + n]) * np.uint64(0xD6E8FEB86659FD93)
            gram ^= gram >> np.uint64(32)
        gram >>= np.uint64(1)
        least = sliding(gram, REACH)
        # Windows that reach into another text choose nothing.
        least = np.where(row[: len(least)] == row[REACH + GRAM - 2 : REACH + GRAM - 2 + len(least)], least, 0)
        edge = np.zeros(REACH - 1, np.uint64)
        chosen[:n] = sliding(np.concatenate([edge, least, edge]), REACH, np.maximum) == gram
        # A run of equal words chooses its beginning only.
        same = np.zeros(n, bool)
        same[1:] = (gram[1:] == gram[:-1]) & (row[1:n] == row[: n - 1])
        chosen[:n] &= ~same
    at = np.flatnonzero(chosen)
    return at[at + BLOCK <= first[row[at] + 1]]


class Blocks:
    """The blocks of a chunk of texts: the text ``row``, the first word's number ``start`` in it, the hash ``node`` of the words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.words = words = tk.Words(data, offsets)
        self.h = h = words.hashes()
        self.at = at = anchors(h, words.first, words.row)
        self.row = words.row[at]
        self.start = at - words.first[self.row]
        # A polynomial over the words' hashes; the slice's own power is taken out by the inverse.
        power, back = tk._power_tables(len(h) + 1)
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[: len(h)])])
        self.node = tk.mix((prefix[at + BLOCK] - prefix[at]) * back[at])

    def bands(self, seed: int) -> np.ndarray:
        """The hashes that name the blocks' buckets, a column for each band."""
        h, at = self.h, self.at
        out = np.zeros((len(at), BANDS), np.uint64)
        if len(at):
            n = len(h) - SHINGLE + 1
            shingle = np.zeros(n, np.uint64)
            for k in range(SHINGLE):
                shingle = (shingle ^ h[k : k + n]) * np.uint64(0xD6E8FEB86659FD93)
                shingle ^= shingle >> np.uint64(29)
            rng = np.random.Generator(np.random.PCG64(seed))
            for b in range(BANDS):
                code = np.full(len(at), b + 1, np.uint64)
                for _ in range(ROWS):
                    factor, term = (np.uint64(x) for x in rng.integers(1, 1 << 63, 2))
                    least = sliding(((shingle + term) * (factor | np.uint64(1))) >> np.uint64(8), BLOCK - SHINGLE + 1)[at]
                    code = tk.mix(code * np.uint64(0x9E3779B97F4A7C15) + least)
                out[:, b] = code
        return out

    def around(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the REACH words before and of those after some blocks, nearest first; 0 beyond the text."""
        padded = np.concatenate([np.zeros(REACH, np.uint64), self.h, np.zeros(REACH, np.uint64)])
        first, last = self.words.first[self.row[which]], self.words.first[self.row[which] + 1]
        step = np.arange(REACH)
        before, after = self.at[which, None] - 1 - step, self.at[which, None] + BLOCK + step
        return np.where(before >= first[:, None], padded[before + REACH], 0), np.where(after < last[:, None], padded[after + REACH], 0)


def scan(docs: DataFrame, schema: str, found) -> DataFrame:
    """Rows that ``found(ids, blocks)`` makes of the doc_ids and Blocks of each chunk of texts; None: no rows.

    A generator that is given nothing more is told so by two Nones.
    """

    def run(batches):
        make = found()
        for batch in batches:
            data, offsets = tk.text_buffer(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for a, b in tk.chunks(offsets):
                made = make(ids[a:b], Blocks(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                if made is not None:
                    yield made
        made = make(None, None)
        if made is not None:
            yield made

    return docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, schema)


def places(docs: DataFrame) -> DataFrame:
    """(node, doc_id, start) of every block."""

    def found():
        def make(ids, blocks):
            if ids is not None and len(blocks.at):
                return pa.RecordBatch.from_arrays([pa.array(tk.to_long(blocks.node)), pa.array(ids[blocks.row]), pa.array(blocks.start.astype(np.int32))], names=["node", "doc_id", "start"])

        return make

    return scan(docs, PLACE_SCHEMA, found)


def band_rows(docs: DataFrame, seed: int, parts: int) -> DataFrame:
    """(bucket, node, owners), packed: the bands of every block, and the sum of hashes of the documents that the task saw it in.

    A task gives a block once for each ``HELD`` that it holds, so that copies without number don't crowd their buckets.
    """

    def found():
        held: list[tuple[np.ndarray, ...]] = []

        def make(ids, blocks):
            if ids is not None:
                if len(blocks.at):
                    held.append((blocks.node, ids[blocks.row], blocks.bands(seed)))
                if sum(len(x[0]) for x in held) < HELD:
                    return None
            if not held:
                return None
            node, doc, bands = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((doc, node))
            node, doc, bands = node[order], doc[order], bands[order]
            new = np.concatenate([[True], node[1:] != node[:-1]])
            # A document that has a block several times counts once; it isn't split, so no other row counts it.
            each = tk.mix(doc.view(np.uint64)) * (new | np.concatenate([[True], doc[1:] != doc[:-1]])).astype(np.uint64)
            at = np.flatnonzero(new)
            owners = tk.to_long(np.add.reduceat(each, at))
            return packed(bands[at].reshape(-1), np.repeat(node[at], BANDS), np.repeat(owners, BANDS), parts)

        return make

    return scan(docs, "part int, rows binary", found)


def block_texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, block): the words of the blocks ``nodes(node)``, and of some others that the bitmap lets through."""
    held = IdFilter(nodes, "node", hashed=True)

    def found():
        seen: set[int] = set()

        def make(ids, blocks):
            if ids is None:
                return None
            wanted = np.flatnonzero(held.has_hashed(blocks.node))
            _, once = np.unique(blocks.node[wanted], return_index=True)
            wanted = wanted[once]
            names = blocks.node[wanted].tolist()
            new = [k for k, x in enumerate(names) if x not in seen]
            if not new:
                return None
            if len(seen) < 10 * HELD:  # beyond that a block may be given twice
                seen.update(names)
            wanted = wanted[new]
            w = blocks.words
            text = [bytes(w.data[s:e]) for s, e in zip(w.start[blocks.at[wanted]].tolist(), w.end[blocks.at[wanted] + BLOCK - 1].tolist())]
            return pa.RecordBatch.from_arrays([pa.array(tk.to_long(blocks.node[wanted])), pa.array(text, pa.binary())], names=["node", "block"])

        return make

    return scan(docs, "node long, block binary", found).join(nodes, "node", "left_semi").groupBy("node").agg(F.min("block").alias("block"))


def verify(pairs: DataFrame, text: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs of blocks whose sets of three-word shingles have a Jaccard similarity of ``threshold`` or more."""
    joined = pairs.join(text.select(F.col("node").alias("a"), F.col("block").alias("x")), "a").join(text.select(F.col("node").alias("b"), F.col("block").alias("y")), "b")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = batch.column("x"), batch.column("y")
                size = np.concatenate([[0], np.cumsum(pc.add(pc.binary_length(x), pc.binary_length(y)).to_numpy(zero_copy_only=False))])
                for a, b in tk.chunks(size):
                    both, either = jaccard_counts(x[a:b], y[a:b], SHINGLE)
                    ok = both * threshold[1] >= either * threshold[0]
                    yield batch.slice(a, b - a).select(["a", "b"]).filter(pa.array(ok))

    return joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def sketches(text: DataFrame) -> DataFrame:
    """(node, s0, s1, n): of each block 128 bits, of which each of its shingles sets one, and the number of its shingles."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                data, offsets = tk.text_buffer(batch.column("block"))
                words = tk.Words(data, offsets)
                shingle, row = tk.shingles(words.hashes(), words.first, SHINGLE)
                out = np.zeros((batch.num_rows, 2), np.uint64)
                bit = shingle >> np.uint64(57)
                np.bitwise_or.at(out, (row, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
                order = np.lexsort((shingle, row))
                shingle, row = shingle[order], row[order]
                new = np.append(True, (shingle[1:] != shingle[:-1]) | (row[1:] != row[:-1]))[: len(row)]
                n = np.bincount(row[new], minlength=batch.num_rows).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("node"), *(pa.array(tk.to_long(np.ascontiguousarray(out[:, k]))) for k in (0, 1)), pa.array(n)], names=["node", "s0", "s1", "n"])

    return text.select("node", "block").mapInArrow(run, "node long, s0 long, s1 long, n int")


def neighbours(group: np.ndarray):
    """The places (i, j), i before j, of all pairs of equal values of ``group``, in which equal values are together."""
    i, k = np.arange(len(group)), 1
    while len(i):
        i = i[i + k < len(group)]
        i = i[group[i] == group[i + k]]
        yield i, i + k
        k += 1


def alike_places(group: np.ndarray, s0: np.ndarray, s1: np.ndarray, n: np.ndarray, threshold: tuple[int, int], differ: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The places (i, j) of all pairs of a group whose sketches are alike (see near_edges) and that differ in each column of ``differ``.

    Alike sketches differ in fewer bits than a large group is cut into pieces of, so one piece is equal: only members
    with an equal piece are compared, in the first piece that they share.
    """
    less, more = threshold[1] - threshold[0], threshold[1] + threshold[0]
    half = less * 2 * (BLOCK - SHINGLE + 1) // more // 2 + 1
    # bitwise_count takes the absolute value of signed numbers.
    s0, s1 = s0.view(np.uint64), s1.view(np.uint64)
    _, of, size = np.unique(group, return_inverse=True, return_counts=True)
    large = np.flatnonzero(size[of] > LARGE)
    found = []

    def look(rows: np.ndarray, own: np.ndarray, pieces: list[np.ndarray]):
        for i, j in neighbours(own):
            i, j = rows[i], rows[j]
            ok = (np.bitwise_count(s0[i] ^ s0[j]).astype(np.int64) + np.bitwise_count(s1[i] ^ s1[j])) * more <= less * (n[i].astype(np.int64) + n[j])
            i, j = i[ok], j[ok]
            ok = np.ones(len(i), bool)
            for x in (*differ, *pieces):
                ok &= x[i] != x[j]
            found.append((i[ok], j[ok]))

    small = np.flatnonzero(size[of] <= LARGE)
    small = small[np.argsort(of[small], kind="stable")]
    look(small, of[small], [])
    if len(large):
        before: list[np.ndarray] = []
        for s in (s0, s1):
            for k in range(half):
                low, high = 64 * k // half, 64 * (k + 1) // half
                piece = (s >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)
                rows = large[np.lexsort((piece[large], of[large]))]
                new = np.append(True, (piece[rows[1:]] != piece[rows[:-1]]) | (of[rows[1:]] != of[rows[:-1]]))
                look(rows, np.cumsum(new), before)
                before = [*before, piece]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def alike_pairs(rows: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(a, b): the pairs of verified_edges, for rows (bucket, node, owners, s0, s1, n, label)."""

    def found(batch):
        bucket, node, s0, s1, n, *differ = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "node", "s0", "s1", "n", "owners", "label"))
        i, j = alike_places(bucket, s0, s1, n, threshold, differ)
        # A pair that several buckets of the task have is given once.
        pairs = np.unique(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], names=["a", "b"])

    return whole_groups(rows.select("bucket", "node", "owners", "s0", "s1", "n", "label"), "bucket", found, "a long, b long")


def near_edges(docs: DataFrame, threshold: tuple[int, int], seed: int, count: int | None = None) -> DataFrame:
    """(a, b): edges between blocks whose components are those of all colliding pairs of similar blocks.

    Of two blocks with p and q shingles and a similarity of t or more at most (1 - t) / (1 + t) * (p + q) shingles are in
    one of them only, and a bit that only one sketch has shows such a shingle: pairs with more such bits can't be similar
    and aren't formed.  count: the number of blocks, if it is known.
    """
    count = places(docs).count() if count is None else count
    members = with_owned_leader(band_rows(docs, seed, count * BANDS * 24 // PART_BYTES + 1))
    text = stored(block_texts(docs, members.select("node").distinct()), "block-texts")
    sketch = stored(sketches(text), "sketches")
    own = ["s0", "s1", "n"]
    of_leader = sketch.select(F.col("node").alias("leader"), *[F.col(c).alias(f"leader_{c}") for c in own])
    members = stored(members.join(sketch, "node").join(of_leader, "leader"), "sketched")
    alike = F.expr(f"(bit_count(s0 ^ leader_s0) + bit_count(s1 ^ leader_s1)) * {threshold[1] + threshold[0]} <= {threshold[1] - threshold[0]} * (n + leader_n)")
    return verified_edges(members, lambda pairs: verify(pairs, text, threshold), own, alike, lambda rows: alike_pairs(rows, threshold))


def contexts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, start, before, after): the words around the blocks with the hashes ``nodes(node)``; see Blocks.around."""
    held = IdFilter(nodes, "node", hashed=True)

    def found():
        def make(ids, blocks):
            if ids is None:
                return None
            wanted = np.flatnonzero(held.has_hashed(blocks.node))
            if not len(wanted):
                return None
            columns = []
            for x in blocks.around(wanted):
                # Half of each hash is enough to tell neighbours apart.
                raw = np.ascontiguousarray((x >> np.uint64(32)).astype(np.uint32))
                columns.append(pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * REACH), len(raw), [None, pa.py_buffer(raw)]).cast(pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array(ids[blocks.row[wanted]]), pa.array(blocks.start[wanted].astype(np.int32)), *columns], names=["doc_id", "start", "before", "after"])

        return make

    return scan(docs, "doc_id long, start int, before binary, after binary", found)


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How far rows of neighbours agree: where equal words less DIFFERENT for each differing one are most, the nearest such."""
    score = np.cumsum(np.where((a == b) & (a != 0), 1, -DIFFERENT), axis=1)
    best = score.argmax(axis=1)
    return np.where(score.max(axis=1) > 0, best + 1, 0)


def extended(passages: DataFrame, docs: DataFrame) -> DataFrame:
    """``passages(doc_id, head, tail, ...)`` with ``left`` and ``right``: the words by which head and tail go on.

    head and tail are the first and the last block: (start, node, kept_in, kept_start, kept_node).
    """
    ends = [F.col(x) for x in ("head", "tail")]
    nodes = passages.select(F.explode(F.array(*[e[n] for e in ends for n in ("node", "kept_node")])).alias("node")).distinct()
    around = contexts(docs, nodes)
    own = lambda name, column: around.select(F.col("doc_id").alias(f"{name}_d"), F.col("start").alias(f"{name}_s"), F.col(column).alias(name))
    asked = passages.select(F.explode(F.array(*[F.struct(F.col("doc_id"), F.col("head.start").alias("first"), F.lit(k).alias("side"), e["start"].alias("start"), e["kept_in"].alias("kept_in"), e["kept_start"].alias("kept_start")) for k, e in enumerate(ends)])).alias("q")).select("q.*")
    both = stored(around.dropDuplicates(["doc_id", "start"]), "contexts")
    around = both
    side = lambda s: F.when(F.col("side") == 0, F.col(f"{s}.before")).otherwise(F.col(f"{s}.after"))
    a, b = around.alias("a"), around.alias("b")
    asked = asked.join(a, (F.col("a.doc_id") == asked.doc_id) & (F.col("a.start") == asked.start)).select(asked["*"], side("a").alias("x"))
    asked = asked.join(b, (F.col("b.doc_id") == asked.kept_in) & (F.col("b.start") == asked.kept_start)).select(asked["doc_id"], asked["first"], asked["side"], asked["x"], side("b").alias("y"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, REACH) for c in ("x", "y"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("first"), batch.column("side"), pa.array(agreement(x, y))], names=["doc_id", "first", "side", "more"])

    more = asked.mapInArrow(run, "doc_id long, first int, side int, more long")
    more = more.groupBy("doc_id", "first").agg(*[F.sum(F.when(F.col("side") == k, F.col("more")).otherwise(0)).alias(n) for k, n in enumerate(("left", "right"))])
    kept = passages.withColumn("first", F.col("head.start"))
    return kept.join(more, ["doc_id", "first"])


def repeated(docs: DataFrame, threshold: tuple[int, int] = (7, 10), least: int = LEAST, seed: int = 20030609) -> DataFrame:
    """The passages of ``least`` words or more of ``docs(doc_id, text)`` that repeat what an earlier document has.

    A row (doc_id, first_word, n_words, blocks, kept_in) for each: its first word's number in the text (from 0), its
    length, the blocks that it is made of, and the documents, in order, in which the passages stay.  Any passage of
    REACH + BLOCK = 48 words that two documents share is found with certainty.  Edited ones are found where blocks of them
    have a Jaccard similarity of ``threshold``.

    Defined results: null, blank and shorter texts have no passages, very long ones are searched whole; what repeats within
    one document only isn't reported; of documents with equal passages the least doc_id keeps its own, and of equal places in
    it the first is compared with; rows with a null doc_id are left out; rows that share a doc_id count as one document (equal
    rows give the same passages, once); other columns are ignored; an empty table gives an empty result.
    """
    blocks = stored(places(docs), "blocks")
    labels = stored(connected_components(near_edges(docs, threshold, seed, blocks.count())), "labels")
    counted = blocks.groupBy("node").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo != hi").select("node")
    wanted = stored(counted.union(labels.select("node")).distinct(), "repeated")
    held = IdFilter(wanted, "node")
    several = held.kept(blocks, ["doc_id", "start"]).join(wanted, "node", "left_semi")
    named = stored(several.join(labels, "node", "left").select(F.coalesce("label", "node").alias("component"), "doc_id", "start", "node").distinct(), "named")
    # Counted with partial results and joined, so that a component of any size is no task of its own.
    keeps = named.groupBy("component").agg(F.min(F.struct("doc_id", "start", "node")).alias("keep"))
    with_keep = stored(named.join(keeps, "component"), "kept")
    # Where the kept document has a block of the same words, that one is what the removal repeats.
    same = with_keep.where("keep.doc_id = doc_id").groupBy(F.col("node").alias("same_node"), F.col("doc_id").alias("same_doc")).agg(F.min("start").alias("same_start"))
    gone = with_keep.where("keep.doc_id != doc_id")
    removals = gone.join(same, (gone.node == same.same_node) & (F.col("keep.doc_id") == F.col("same_doc")), "left").select(
        "doc_id",
        "start",
        "node",
        F.col("keep.doc_id").alias("kept_in"),
        F.coalesce("same_start", "keep.start").alias("kept_start"),
        F.when(F.col("same_start").isNotNull(), F.col("node")).otherwise(F.col("keep.node")).alias("kept_node"),
    )
    in_order = Window.partitionBy("doc_id").orderBy("start", "kept_in", "kept_start")
    # A similar block that begins near an equal one adds words to it that may not be repeated; moving ends finds those that are.
    equal = F.when(F.col("node") == F.col("kept_node"), F.col("start"))
    before = F.last(equal, ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(equal, ignorenulls=True).over(in_order.rowsBetween(0, Window.unboundedFollowing))
    near = F.least(F.col("start") - before, after - F.col("start"))
    removals = removals.withColumn("near", near).where(F.col("near").isNull() | (F.col("near") == 0) | (F.col("near") > BLOCK // 2))
    gap = F.col("start") - F.lag("start").over(in_order)
    goes_on = (gap <= BLOCK) | ((gap <= BLOCK + REACH) & (F.col("kept_in") == F.lag("kept_in").over(in_order)))
    opens = F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)
    parts = removals.withColumn("opens", opens).withColumn("passage", F.sum("opens").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    end = F.struct("start", "node", "kept_in", "kept_start", "kept_node")
    found = stored(
        parts.groupBy("doc_id", "passage").agg(
            F.min(end).alias("head"), F.max(end).alias("tail"), F.countDistinct("start").cast("int").alias("blocks"), F.sort_array(F.collect_set("kept_in")).alias("kept_in")
        ),
        "passages",
    )
    whole = extended(found, docs)
    n_words = F.col("tail.start") + BLOCK - F.col("head.start") + F.col("left") + F.col("right")
    return whole.select("doc_id", (F.col("head.start") - F.col("left")).cast("int").alias("first_word"), n_words.cast("int").alias("n_words"), "blocks", "kept_in").where(F.col("n_words") >= least)
