"""Quality rules: robust multivariate outliers by the minimum covariance determinant, for each language and source.

Five statistics are taken of each whole text: the shares of symbols and of capitals among its bytes, the shares of words
that repeat the word before and of three-word runs that occurred before, and the mean length of words.  Shares are shrunk
towards a usual rate by ``SHRINK`` words and put on the logit scale, so that short texts aren't outliers by chance.

For each (language, source) the mean and covariance of the most compact ``SHARE`` of its documents are found by
concentration steps: take the documents with the least Mahalanobis distances, estimate again, repeat.  They begin at several
deterministic robust starts, as in DetMCD (Hubert, Rousseeuw and Verdonck, 2012): medians and median deviations with no
correlation, with that of hyperbolic tangents, and with that of spatial signs.  After ``FIRST_STEPS`` the start with the least
determinant goes on until no determinant falls any more.  All documents take part at every step.  A step is two aggregations
over the narrow statistics, partial on the map side, so a hot source costs no more than others; the order statistics come
from counts in fine bins, which are exact to a bin's width and don't depend on how data are split.  Documents beyond the
cut-off are rejected.  Texts are never shuffled: estimates are joined by broadcast while there are at most ``SENT_GROUPS`` of
them, and by Spark's choice otherwise.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfold.llm import textkernel as tk
from nearfold.llm.frames import cut, unused

DIM = 5
SHARE = 0.75
SHRINK = 50
#: Concentration steps from every start, and the most steps in all; they end when no logarithm of a determinant falls by SETTLED.
FIRST_STEPS, MOST_STEPS, SETTLED = 2, 12, 0.02
STARTS = ("none", "tanh", "sign")
#: The least deviation that counts, on the logit scale: added to every estimate's spread.
FLOOR = 0.15
#: Squared distance beyond which a document is rejected: a chi-squared variable of 5 degrees exceeds it once in 7e8.
CUTOFF = 50.0
#: Documents a group needs for estimates of its own (four for each statistic); smaller ones use their language's, then those
#: of all.  An estimate of fewer is singular or as good as that.
LEAST = 20
SENT_GROUPS = 20_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,'-"]] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
#: Usual rates towards which the shares are shrunk.
_RATE = {"symbols": 0.03, "capitals": 0.03, "repeats": 0.05, "runs": 0.1}


def chi2_cdf(x: float, k: int) -> float:
    """The chi-squared distribution, by the series of the incomplete gamma function."""
    a, x = k / 2, x / 2
    term = total = 1 / a
    for n in range(1, 1000):
        term *= x / (a + n)
        total += term
        if term < total * 1e-16:
            break
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a)) if x > 0 else 0.0


def consistency(dim: int, share: float) -> float:
    """What a covariance of the most compact share is multiplied by to be right for normal data."""
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, dim) < share else (lo, mid)
    return share / chi2_cdf(lo, dim + 2)


def _logit(count: np.ndarray, n: np.ndarray, rate: float, shrink: float) -> np.ndarray:
    total = n + shrink
    p = (count + rate * total) / ((1 + 2 * rate) * total)
    return np.log(p / (1 - p))


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The five transformed statistics of each text; those of a text without words are those of no evidence."""
    n = len(offsets) - 1
    out = np.empty((n, DIM))
    for a, b in tk.chunks(offsets):
        piece, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        size = np.diff(own)
        within = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[own])  # noqa: B023, E731
        words = tk.Words(piece, own)
        count = np.diff(words.first)
        h = words.hashes()
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (words.row[1:] == words.row[:-1])
        run, row = tk.shingles(h, words.first, 3)
        order = np.argsort(run, kind="stable")
        # Equal runs are neighbours after sorting and, sorting being stable, those of a text follow each other.
        seen = np.zeros(len(run), bool)
        seen[1:] = (run[order][1:] == run[order][:-1]) & (row[order][1:] == row[order][:-1])
        old = np.bincount(row[order][seen], minlength=b - a)
        out[a:b, 0] = _logit(within(_SYMBOL[piece]), size, _RATE["symbols"], 6 * SHRINK)
        out[a:b, 1] = _logit(within(_CAPITAL[piece]), size, _RATE["capitals"], 6 * SHRINK)
        out[a:b, 2] = _logit(np.bincount(words.row[again], minlength=b - a), count, _RATE["repeats"], SHRINK)
        out[a:b, 3] = _logit(old, count, _RATE["runs"], SHRINK)
        letters = np.bincount(words.row, weights=words.end - words.start, minlength=b - a)
        out[a:b, 4] = np.log((letters + 5 * 20) / (count + 20))
    return out


def with_statistics(docs: DataFrame, carry: list[str], names: list[str]) -> DataFrame:
    """The columns ``carry`` and the statistics of ``text`` as doubles of the given names."""
    fields = [docs.schema[c] for c in carry]
    schema = T.StructType([*fields, *(T.StructField(x, T.DoubleType()) for x in names)])
    source = docs.select(*[F.col(f"`{c}`") for c in carry], *([] if "text" in carry else ["text"]))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = statistics(*tk.text_buffer(batch.column("text")))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), *(pa.array(x[:, k]) for k in range(DIM))], names=[*carry, *names])

    return source.mapInArrow(run, schema)


X = [f"x{i}" for i in range(DIM)]


def _key(*columns: str) -> Column:
    """A text that tells groups apart, null from every value included."""
    return F.to_json(F.struct(*columns)) if columns else F.lit("all")


def _send(small: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(small) if rows <= SENT_GROUPS else small


def _binned_quantile(df: DataFrame, by: list[str], bin_: Column, share: float, width: float) -> DataFrame:
    """For each group the least bin that, with those below it, holds ``share`` of the rows, as the bin's middle ``q``."""
    count = df.groupBy(*by, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    whole = Window.partitionBy(*by)
    below = count.withColumn("up", F.sum("c").over(whole.orderBy("bin"))).withColumn("n", F.sum("c").over(whole))
    return below.where(F.col("up") >= F.ceil(F.col("n") * F.lit(share))).groupBy(*by).agg(((F.min("bin") + 0.5) * width).alias("q"))


def _distance() -> Column:
    """The squared Mahalanobis distance from the joined estimates (m: mean, w: inverse covariance, row by row)."""
    d = [F.col(X[i]) - F.get("m", F.lit(i)) for i in range(DIM)]
    total = F.lit(0.0)
    for i in range(DIM):
        for j in range(i, DIM):
            total = total + d[i] * d[j] * F.get("w", F.lit(i * DIM + j)) * (1.0 if i == j else 2.0)
    return total


def _upper(p: np.ndarray) -> np.ndarray:
    """Symmetric matrices from rows of their upper triangles."""
    out = np.zeros((len(p), DIM, DIM))
    i, j = np.triu_indices(DIM)
    out[:, i, j] = out[:, j, i] = p
    return out


def _columns(batch: pa.RecordBatch, names: str) -> list[np.ndarray]:
    return [np.array(batch.column(c).to_pylist(), float) for c in names.split()]


ESTIMATE_SCHEMA = "g string, s int, m array<double>, w array<double>, centre array<double>, logdet double"


def _packed(batch: pa.RecordBatch, s: pa.Array, mean: np.ndarray, cov: np.ndarray, centre: np.ndarray) -> pa.RecordBatch:
    cov = cov + np.eye(DIM) * FLOOR**2
    columns = [batch.column("g"), s, pa.array(mean.tolist()), pa.array(np.linalg.inv(cov).reshape(len(cov), -1).tolist()), pa.array(centre.tolist()), pa.array(np.linalg.slogdet(cov)[1])]
    return pa.RecordBatch.from_arrays(columns, names=["g", "s", "m", "w", "centre", "logdet"])


def _products(y: list[Column]) -> list[Column]:
    return [F.sum(y[i] * y[j]) for i in range(DIM) for j in range(i, DIM)]


def _estimates(moments: DataFrame) -> DataFrame:
    """Means and inverse covariances from counts, sums and sums of products around the start's centre."""
    factor = consistency(DIM, SHARE)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                n, centre, s, p = _columns(batch, "n centre s p")
                mean = s / n[:, None]
                cov = _upper(p / n[:, None]) - mean[:, :, None] * mean[:, None, :]
                yield _packed(batch, batch.column("s_"), mean + centre, cov * factor, centre)

    return moments.mapInArrow(run, ESTIMATE_SCHEMA)


def _starts(rows: DataFrame, groups: int) -> DataFrame:
    """The estimates that concentration steps begin with, one of each kind of STARTS for each group of ``rows(g, X)``."""
    long = rows.select("g", F.posexplode(F.array(*X)).alias("i", "x"))
    median = cut(_binned_quantile(long, ["g", "i"], F.floor(F.col("x") / 0.01), 0.5, 0.01))
    off = long.join(_send(median, groups * DIM), ["g", "i"]).withColumn("off", F.abs(F.col("x") - F.col("q")))
    spread = _binned_quantile(off.select("g", "i", "off"), ["g", "i"], F.floor(F.col("off") / 0.01), 0.5, 0.01).withColumnRenamed("q", "mad")
    both = median.join(spread, ["g", "i"]).groupBy("g").agg(F.sort_array(F.collect_list(F.struct("i", "q", (F.col("mad") * 1.4826).alias("scale")))).alias("a"))
    centre = cut(both.select("g", F.col("a.q").alias("centre"), F.col("a.scale").alias("scale")))
    joined = rows.join(_send(centre, groups), "g")
    z = joined.select("g", "centre", "scale", *[((F.col(X[i]) - F.get("centre", F.lit(i))) / (F.get("scale", F.lit(i)) + FLOOR)).alias(f"z{i}") for i in range(DIM)])
    size = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(DIM)), F.lit(1e-12)))
    z = z.withColumn("size", size)
    tanh, sign = [F.tanh(f"z{i}") for i in range(DIM)], [F.col(f"z{i}") / F.col("size") for i in range(DIM)]
    sums = z.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.first("centre").alias("centre"), F.first("scale").alias("scale"), F.array(*map(F.sum, tanh)).alias("s"), F.array(*_products(tanh)).alias("p"), F.array(*_products(sign)).alias("u"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n, centre, scale, s, p, u = _columns(batch, "n centre scale s p u")
            mean = s / n[:, None]
            shapes = [np.broadcast_to(np.eye(DIM), (len(n), DIM, DIM)), _upper(p / n[:, None]) - mean[:, :, None] * mean[:, None, :], _upper(u / n[:, None])]
            for k, shape in enumerate(shapes):
                # Only the correlation is taken of the transformed values; a statistic that doesn't vary has none.
                d = np.sqrt(np.maximum(np.diagonal(shape, axis1=1, axis2=2), 1e-12))
                corr = 0.95 * shape / d[:, :, None] / d[:, None, :]
                corr[:, np.arange(DIM), np.arange(DIM)] = 1
                yield _packed(batch, pa.array([k] * len(n), pa.int32()), centre, corr * scale[:, :, None] * scale[:, None, :], centre)

    return sums.mapInArrow(run, ESTIMATE_SCHEMA)


def concentrated(rows: DataFrame, groups: int) -> DataFrame:
    """(g, m, w, logdet): the estimates that concentration steps end with for each group of ``rows(g, X)``."""
    estimates = cut(_starts(rows, groups))
    near = F.floor(F.log(F.col("d") + 1e-6) * 50)
    before: dict[str, float] = {}
    for step in range(MOST_STEPS):
        sent = len(STARTS) * groups
        measured = rows.join(_send(estimates, sent), "g").withColumn("d", _distance()).withColumn("near", near)
        limit = _binned_quantile(measured.select("g", "s", "near"), ["g", "s"], F.col("near"), SHARE, 1.0).select("g", "s", F.col("q").alias("limit"))
        inner = measured.join(_send(cut(limit), sent), ["g", "s"]).where("near <= limit")
        y = [F.col(X[i]) - F.get("centre", F.lit(i)) for i in range(DIM)]
        moments = inner.groupBy("g", F.col("s").alias("s_")).agg(F.count(F.lit(1)).alias("n"), F.first("centre").alias("centre"), F.array(*map(F.sum, y)).alias("s"), F.array(*_products(y)).alias("p"))
        estimates = _estimates(moments)
        if step + 1 == FIRST_STEPS:
            least = F.min_by(F.struct("s", "m", "w", "centre", "logdet"), F.struct("logdet", "s")).alias("best")
            estimates = estimates.groupBy("g").agg(least).select("g", "best.*")
        estimates = cut(estimates)
        if step + 1 < FIRST_STEPS:
            continue
        if groups > SENT_GROUPS:
            now = {"": estimates.agg(F.sum("logdet")).first()[0] or 0.0}
        else:
            now = {r["g"]: r["logdet"] for r in estimates.select("g", "logdet").collect()}
        if all(before.get(g, math.inf) - x < SETTLED for g, x in now.items()):
            break
        before = now
    return estimates.select("g", "m", "w", "logdet")


def fit(docs: DataFrame) -> tuple[DataFrame, int]:
    """Estimates (own, m, w, logdet) for each group of ``docs(text, lang, source)``, and how many groups there are."""
    stats = with_statistics(docs, ["lang", "source"], X).select(_key("lang", "source").alias("own"), _key("lang").alias("lang"), *X)
    stats = cut(stats)
    sizes = cut(stats.groupBy("own", "lang").agg(F.count(F.lit(1)).alias("n")))
    groups = sizes.count()
    levels = sizes.withColumn("of_lang", F.sum("n").over(Window.partitionBy("lang"))).crossJoin(_send(sizes.agg(F.sum("n").alias("of_all")), 1))
    levels = levels.withColumn("uses", F.when(F.col("n") >= LEAST, F.col("own")).when(F.col("of_lang") >= LEAST, F.col("lang")).when(F.col("of_all") >= LEAST, F.lit("all")))
    levels = cut(levels)
    needed = [r["uses"] for r in levels.where("uses IS NOT NULL AND uses != own").select("uses").distinct().collect()] if groups <= SENT_GROUPS else None
    pooled = levels.where("uses != own").select(F.col("uses").alias("g")).distinct()
    rows = stats.select(F.col("own").alias("g"), *X).join(_send(levels.where("uses = own").select(F.col("own").alias("g")), groups), "g", "left_semi")
    if needed is None or needed:
        rows = rows.union(stats.select(F.explode(F.array("lang", F.lit("all"))).alias("g"), *X).join(_send(pooled, groups), "g", "left_semi").select("g", *X))
    found = concentrated(rows, groups)
    return levels.join(found.withColumnRenamed("g", "uses"), "uses").select("own", "m", "w", "logdet"), groups


def with_distance(docs: DataFrame, name: str = "distance") -> DataFrame:
    """``docs`` with every column and the squared robust distance of each text from its language and source.

    Defined results: null and blank texts have no evidence of anything and get the distance of a text with all shares at
    their usual rates; very long texts are taken whole; a null language or source is a group like any other; repeated rows
    count and are given each; of starts with equal determinants the first in STARTS counts; the distance is null where fewer
    than ``LEAST`` documents exist in all; columns with clashing names are kept, except that ``name`` is replaced; an empty
    table gives an empty result.
    """
    estimates, groups = fit(docs)
    carry = [c for c in docs.columns if c.lower() != name.lower()]
    taken = [*docs.columns, name, "m", "w"]
    x = [unused(f"__x{i}", taken) for i in range(DIM)]
    own = unused("__own", taken)
    m, w = unused("__m", taken), unused("__w", taken)
    small = _send(estimates.select(F.col("own").alias(own), F.col("m").alias(m), F.col("w").alias(w)), groups)
    d = [F.col(x[i]) - F.get(m, F.lit(i)) for i in range(DIM)]
    total = F.lit(0.0)
    for i in range(DIM):
        for j in range(i, DIM):
            total = total + d[i] * d[j] * F.get(w, F.lit(i * DIM + j)) * (1.0 if i == j else 2.0)
    # The key is made where the statistics are, so that a text goes through one join at most.
    scored = with_statistics(docs, carry, x).withColumn(own, _key("lang", "source")).join(small, own, "left")
    return scored.select(*[F.col(f"`{c}`") for c in carry], total.alias(name))


def accepted(docs: DataFrame, cutoff: float = CUTOFF, name: str = "distance") -> DataFrame:
    """The rows of ``docs`` whose distance is ``cutoff`` at most or unknown, with the distance.  See with_distance."""
    return with_distance(docs, name).where(F.col(f"`{name}`").isNull() | (F.col(f"`{name}`") <= cutoff))


def reject_outliers(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` that aren't outliers, with exactly their columns.  See with_distance."""
    name = unused("__distance", docs.columns)
    return accepted(docs, cutoff, name).drop(name)
