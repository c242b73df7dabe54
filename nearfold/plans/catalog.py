"""The engine's queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfold.functions import expressions as X
from nearfold.functions.features import NAMES, Config, vectorize, with_risk
from nearfold.operators import ivf, kmeans, knn, scoring
from nearfold.plans.engine import Engine
from nearfold.session import ship, stored
from nearfold.sources.files import decode_payloads, encode_decisions

DIMS, PARTS, PROBES, K = 64, 16, 4, 5
CONFIG = Config(max_minutes=1440.0)
RISKS = {"5411": 0.15, "7802": 0.75, "5812": 0.3, "5944": 0.45}
MCCS = ("5411", "7802", "5812", "5999", "5944", "7801")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Inputs: labelled vectors (every fifth one is a query) and payloads made of orders.


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, vector, label): embeddings moved to [0, 1], a third of them without history (-1 in two dimensions)."""
    unit = F.transform("embedding", lambda x, i: F.when(i.isin(*X.HISTORY_DIMS) & (F.col("vec_id") % 3 == 0), F.lit(-1.0)).otherwise((x.cast("double") + 1) / 2))
    return table(spark, sf_dir, "embeddings").select("vec_id", unit.alias("vector"), F.when(F.col("label") < 3, X.FRAUD).otherwise(X.LEGIT).alias("label"))


def split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = vectors(spark, sf_dir)
    return v.where("vec_id % 5 = 0").select(F.col("vec_id").alias("q_id"), "vector"), v.where("vec_id % 5 != 0")


VECTORS_SQL = """e AS (SELECT vec_id, list_transform(range(1, 65), lambda i: CASE WHEN i IN (6, 7) AND vec_id % 3 = 0 THEN -1.0::DOUBLE ELSE (embedding[i]::DOUBLE + 1) / 2 END) AS v,
  CASE WHEN label < 3 THEN 'fraud' ELSE 'legit' END AS label FROM embeddings),
q AS (SELECT vec_id AS q_id, v FROM e WHERE vec_id % 5 = 0), r AS (SELECT * FROM e WHERE vec_id % 5 <> 0)"""
dist_sql = lambda a, b: f"list_reduce(list_transform(range(1, 65), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])), lambda x, y: x + y)"
dot_sql = lambda a, b: f"list_reduce(list_transform(range(1, 65), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE), lambda x, y: x + y)"
levels_sql = lambda v: f"list_transform({v}, lambda x: CASE WHEN x < 0 THEN 255 ELSE least(254, round(x * 254)::INTEGER) END)"
EXACT_SQL = f"""x AS (SELECT q_id, vec_id, label, {dist_sql('q.v', 'r.v')} AS distance FROM q CROSS JOIN r),
exact AS (SELECT q_id, rank, vec_id, distance, label FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY distance, vec_id)::INTEGER AS rank FROM x) WHERE rank <= {K})"""
vote_sql = lambda t: f"SELECT q_id, sum((label = 'fraud')::INTEGER)::DOUBLE / count(*) AS fraud_score, sum((label = 'fraud')::INTEGER)::DOUBLE / count(*) < 0.6 AS approved FROM {t} GROUP BY q_id"


def exact_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, r = split(spark, sf_dir)
    return knn.exact_knn(q, r, K, DIMS)


def exact_knn_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    q, r = split(spark, sf_dir)
    return knn.exact_knn(q, r, K, DIMS, strategy="blocks")


def knn_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.vote(exact_knn(spark, sf_dir))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q_id, payload columns): an order is a transaction, the customer's order before it the last transaction."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal"), "o_custkey")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    at = F.date_format(F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + k * 7919 % 86400), "yyyy-MM-dd'T'HH:mm:ss")
    stamp = F.concat(at, F.when(k % 4 == 0, F.lit("-03:00")).when(k % 97 == 0, F.lit("")).otherwise(F.lit("Z")))
    before = F.lag("stamp").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    o = o.withColumn("stamp", stamp).withColumn("before", before)
    return o.select(
        k.alias("q_id"),
        F.concat(F.lit("tx-"), k.cast("string")).alias("id"),
        F.struct((F.col("o_totalprice") / 25).alias("amount"), (k % 14).cast("int").alias("installments"), F.col("stamp").alias("requested_at")).alias("transaction"),
        F.struct(F.col("c_acctbal").alias("avg_amount"), (k % 25).cast("int").alias("tx_count_24h"), F.array(F.concat(F.lit("S"), (c % 7).cast("string")), F.concat(F.lit("S"), (c % 3).cast("string"))).alias("known_merchants")).alias("customer"),
        F.struct(F.concat(F.lit("S"), (k % 7).cast("string")).alias("id"), F.element_at(F.array(*map(F.lit, MCCS)), (k % 6 + 1).cast("int")).alias("mcc"), ((c % 200) * 60).cast("double").alias("avg_amount")).alias("merchant"),
        F.struct((k % 2 == 0).alias("is_online"), (k % 3 == 0).alias("card_present"), (k % 1500).cast("double").alias("km_from_home")).alias("terminal"),
        F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("timestamp"), (c % 1300).cast("double").alias("km_from_current"))).alias("last_transaction"),
    )


def risks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RISKS.items()), "mcc string, risk double")


PAYLOADS_SQL = f"""o AS (SELECT o_orderkey AS k, o_custkey AS c, o_totalprice / 25 AS amount, c_acctbal AS avg_amount, o_orderdate,
  o_orderdate::TIMESTAMP + to_seconds((o_orderkey * 7919) % 86400) AS wall, CASE WHEN o_orderkey % 4 = 0 THEN 3 ELSE 0 END AS off, (o_orderkey % 97 = 0 AND o_orderkey % 4 <> 0) AS bad
  FROM orders JOIN customer ON c_custkey = o_custkey),
p AS (SELECT *, wall + to_hours(off) AS instant, lag(wall + to_hours(off)) OVER w AS last_at, coalesce(lag(bad) OVER w, false) AS last_bad, lag(k) OVER w IS NULL AS no_last,
  [{", ".join(repr(m) for m in MCCS)}][k % 6 + 1] AS mcc FROM o WINDOW w AS (PARTITION BY c ORDER BY o_orderdate, k)),
risks AS (SELECT * FROM (VALUES {", ".join(f"('{m}', {r}::DOUBLE)" for m, r in RISKS.items())}) t(mcc, risk))"""
clamp_sql = lambda x: f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"
FEATURES_SQL = {
    "amount": clamp_sql("amount / 10000"),
    "installments": clamp_sql("(k % 14)::DOUBLE / 12"),
    "amount_vs_avg": f"CASE WHEN avg_amount <= 0 THEN 1.0 ELSE {clamp_sql('amount / avg_amount / 10')} END",
    "hour_of_day": "hour(wall) / 23.0::DOUBLE",
    "day_of_week": "(isodow(wall) - 1) / 6.0::DOUBLE",
    "minutes_since_last_tx": f"CASE WHEN no_last THEN -1.0 ELSE {clamp_sql('(epoch_us(instant) - epoch_us(last_at)) / 6e7::DOUBLE / 1440')} END",
    "km_from_last_tx": f"CASE WHEN no_last THEN -1.0 ELSE {clamp_sql('(c % 1300)::DOUBLE / 1000')} END",
    "km_from_home": clamp_sql("(k % 1500)::DOUBLE / 1000"),
    "tx_count_24h": clamp_sql("(k % 25)::DOUBLE / 20"),
    "is_online": "(k % 2 = 0)::INTEGER::DOUBLE",
    "card_present": "(k % 3 = 0)::INTEGER::DOUBLE",
    "unknown_merchant": "CASE WHEN k % 7 IN (c % 7, c % 3) THEN 0.0 ELSE 1.0 END",
    "mcc_risk": "coalesce(risk, 0.5)",
    "merchant_avg_amount": clamp_sql("((c % 200) * 60)::DOUBLE / 10000"),
}
VALID_SQL = "NOT bad AND NOT last_bad"


def vectorize_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = vectorize(payloads(spark, sf_dir), CONFIG, risks(spark))
    return done.select("q_id", *[F.get("features", F.lit(i)).alias(n) for i, n in enumerate(NAMES)])


VECTORIZE_SQL = f"""WITH {PAYLOADS_SQL} SELECT k AS q_id, {", ".join(f"CASE WHEN {VALID_SQL} THEN ({s})::DOUBLE END AS {n}" for n, s in FEATURES_SQL.items())}
FROM p LEFT JOIN risks USING (mcc)"""


def mcc_lookup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = with_risk(payloads(spark, sf_dir), risks(spark), "risk")
    return done.groupBy(F.col("merchant.mcc").alias("mcc"), F.coalesce("risk", F.lit(0.5)).alias("mcc_risk")).agg(F.count(F.lit(1)).alias("n"))


def last_tx_sentinel(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = vectorize_orders(spark, sf_dir).select("q_id", "minutes_since_last_tx", "km_from_last_tx")
    return f.where("minutes_since_last_tx = -1 OR minutes_since_last_tx BETWEEN 0.001 AND 0.999")


def hour_weekday_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 2 == 0, F.lit("+05:30")).otherwise(F.lit("Z")))
    e = table(spark, sf_dir, "events").select("event_id", text.alias("t"))
    return e.select("event_id", X.hour_of_day(F.col("t")).alias("hour_of_day"), X.day_of_week(F.col("t")).alias("day_of_week"), F.unix_micros(X.instant(F.col("t"))).alias("micros"))


HOUR_SQL = """SELECT event_id, hour(ts) / 23.0::DOUBLE AS hour_of_day, (isodow(ts) - 1) / 6.0::DOUBLE AS day_of_week,
epoch_us(date_trunc('second', ts)) - CASE WHEN event_id % 2 = 0 THEN 19800000000 ELSE 0 END AS micros FROM events"""


def known_merchant_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_suppkey")).alias("known"))
    item = F.col("l_orderkey") % 100 + 1
    return known.select("l_orderkey", F.size("known").alias("n_known"), X.unknown_member(item, F.col("known")).alias("unknown_merchant"))


def clamped_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", X.clamp(F.col("c_acctbal") / 5000).alias("share"), X.guarded_ratio(F.lit(900.0), F.col("c_acctbal"), 10.0).alias("ratio"))


def quantized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", X.quantize(F.col("vector")).alias("levels"), "label")


def quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantized(spark, sf_dir).select("vec_id", F.array_join(F.col("levels").cast("array<string>"), ",").alias("levels"), X.label_code(F.col("label")).alias("code"))


def dequantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = quantized(spark, sf_dir).select("vec_id", F.posexplode(X.dequantize(F.col("levels"))).alias("dim", "value"))
    return back


def quantized_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All partitions probed: quantized brute force through the index."""
    return ivf.search_labels(split(spark, sf_dir)[0], index(spark, sf_dir), K, PARTS)


LEVELS_SQL = f"""lq AS (SELECT q_id, v, {levels_sql('v')} AS l FROM q), lr AS (SELECT vec_id, label, v, {levels_sql('v')} AS l FROM r)"""
RANKED_SQL = f"row_number() OVER (PARTITION BY q_id ORDER BY distance, vec_id)::INTEGER AS rank"


def vector_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dot products, norms and rank distances of every reference and the seeds."""
    r, s = split(spark, sf_dir)[1], seeds(spark, sf_dir)
    v, c = F.col("vector"), F.col("centroid")
    norm = X.squared_norm(c, DIMS)
    pairs = r.crossJoin(F.broadcast(s)).where("vec_id % 10 = 1")
    return pairs.select("vec_id", "c_id", X.dot(v, c, DIMS).alias("dot"), norm.alias("norm"), X.rank_distance(v, c, norm, DIMS).alias("rank_distance"), X.squared_l2_folded(v, c).alias("folded"))


# Clustering and the index, from evenly spaced seeds so that they can be done again in SQL.


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.evenly_spaced(split(spark, sf_dir)[1], PARTS)


def index(spark: SparkSession, sf_dir: str) -> ivf.Index:
    return ivf.build(split(spark, sf_dir)[1], seeds(spark, sf_dir), DIMS).settled()


SEEDS_SQL = f"""n AS (SELECT count(*) AS n FROM r), ranked AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM r),
seeds AS (SELECT i::INTEGER AS c_id, ranked.v AS c, list_transform(ranked.v, lambda x: x::FLOAT::DOUBLE) AS cf FROM range(0, {PARTS}) t(i) JOIN n ON true JOIN ranked ON pos = i * n // {PARTS}),
near AS (SELECT vec_id, c_id, d FROM (SELECT vec_id, c_id, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, c_id) AS nth FROM
  (SELECT vec_id, c_id, {dist_sql('r.v', 'seeds.c')} AS d FROM r CROSS JOIN seeds)) WHERE nth = 1),
sizes AS (SELECT c_id AS part_id, count(vec_id) AS cnt FROM seeds LEFT JOIN near USING (c_id) GROUP BY c_id)"""
PROBE_SQL = f"""probe AS (SELECT q_id, rank, part_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY distance, part_id)::INTEGER AS rank FROM
  (SELECT q_id, c_id AS part_id, {dist_sql('q.v', 'seeds.cf')} AS distance FROM q CROSS JOIN seeds)) WHERE rank <= {PROBES})"""
IVF_SQL = f"""found AS (SELECT * FROM (SELECT *, {RANKED_SQL} FROM (SELECT q_id, vec_id, label, lr.l, {dist_sql('lq.l', 'lr.l')}::BIGINT AS distance
  FROM probe JOIN near ON near.c_id = probe.part_id JOIN lr USING (vec_id) JOIN lq USING (q_id))) WHERE rank <= {K})"""
ALL_SQL = f"WITH {VECTORS_SQL}, {LEVELS_SQL}, {SEEDS_SQL}, {PROBE_SQL}, {IVF_SQL}"


def assign_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.assign(split(spark, sf_dir)[1], seeds(spark, sf_dir), DIMS).select("vec_id", "c_id", "d")


def partition_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).centroids.select("part_id", "cnt")


def partition_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).centroids.select("part_id", "cnt", "byte_offset")


def partition_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's place in its partition."""
    lists = stored(ivf.clustered(index(spark, sf_dir).lists, 1), "layout")
    # Within a partition rows lie in the order that they were written in: their places follow from a file's row numbers.
    at = lists.select("part_id", "vec_id", "label", F.monotonically_increasing_id().alias("at"))
    first = at.groupBy("part_id").agg(F.min("at").alias("first"))
    return at.join(first, "part_id").select("part_id", "vec_id", "label", (F.col("at") - F.col("first")).cast("int").alias("place"))


def lloyd_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = kmeans.lloyd_step(split(spark, sf_dir)[1], seeds(spark, sf_dir), DIMS)
    return moved.select("c_id", F.round("moved", 6).alias("moved"), F.posexplode("centroid").alias("dim", "value")).withColumn("value", F.round("value", 6))


LLOYD_SQL = f"""WITH {VECTORS_SQL}, {SEEDS_SQL}, m AS (SELECT c_id, i - 1 AS dim, avg(v[i]) AS mean FROM near JOIN r USING (vec_id) CROSS JOIN range(1, 65) t(i) GROUP BY ALL),
w AS (SELECT c_id, (i - 1)::INTEGER AS dim, coalesce(mean, c[i]) AS value, abs(coalesce(mean, c[i]) - c[i]) AS diff FROM seeds CROSS JOIN range(1, 65) t(i) LEFT JOIN m USING (c_id) WHERE m.dim IS NULL OR m.dim = i - 1)
SELECT c_id, round(max(diff) OVER (PARTITION BY c_id), 6) AS moved, dim, round(value, 6) AS value FROM w"""


def ivf_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivf.probe(split(spark, sf_dir)[0], index(spark, sf_dir), PROBES).select("q_id", "rank", "part_id", "distance")


def ivf_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivf.search_labels(split(spark, sf_dir)[0], index(spark, sf_dir), K, PROBES)


def ivf_labels_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return ivf.search_labels(split(spark, sf_dir)[0], index(spark, sf_dir), K, PROBES, strategy="blocks")


def ivf_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ivf.search(split(spark, sf_dir)[0], index(spark, sf_dir), K, PROBES)
    return found.select("q_id", "rank", "vec_id", "distance", "label", F.posexplode("vector").alias("dim", "value"))


def ivf_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.vote(ivf_labels(spark, sf_dir))


def recall_at_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.label_recall(exact_knn(spark, sf_dir), ivf_labels(spark, sf_dir), K)


RECALL_SQL = f"""{ALL_SQL}, {EXACT_SQL}, a AS (SELECT q_id, label, count(*) AS n FROM exact GROUP BY ALL), b AS (SELECT q_id, label, count(*) AS m FROM found GROUP BY ALL)
SELECT q_id, sum(least(n, coalesce(m, 0)))::DOUBLE / 5 AS recall FROM a LEFT JOIN b USING (q_id, label) GROUP BY q_id"""


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = scoring.order_statistics(table(spark, sf_dir, "events"), "value", ["event_type"])
    return stats.withColumn("avg", F.round("avg", 6))


LATENCY_SQL = """WITH r AS (SELECT event_type, value, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY event_type ORDER BY value))
SELECT event_type, round(avg(value), 6) AS avg, max(value) FILTER (pos = least(floor(n * 0.5::DOUBLE), n - 1)) AS p50, max(value) FILTER (pos = least(floor(n * 0.9::DOUBLE), n - 1)) AS p90,
max(value) FILTER (pos = least(floor(n * 0.99::DOUBLE), n - 1)) AS p99, min(value) AS min, max(value) AS max FROM r GROUP BY event_type"""


def seed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References in the orders' feature space: orders of low keys, labelled by their priority."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("q_id"), "o_orderpriority")
    done = vectorize(payloads(spark, sf_dir).where("q_id % 10 = 3"), CONFIG, risks(spark), "vector").where("vector IS NOT NULL")
    return done.join(o, "q_id").select(F.col("q_id").alias("vec_id"), "vector", F.when(F.col("o_orderpriority").startswith("1"), X.FRAUD).otherwise(X.LEGIT).alias("label"))


def score_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From payload to decision, exactly; orders whose times can't be read are approved with 0.0."""
    references = stored(seed_labels(spark, sf_dir), "references")
    # Written once: the search counts queries and reads them again.
    q = stored(vectorize(payloads(spark, sf_dir).where("q_id % 50 = 0 OR q_id % 97 = 0"), CONFIG, risks(spark), "vector").select("q_id", "vector"), "queries")
    found = knn.exact_knn(q.where("vector IS NOT NULL").select("q_id", "vector"), references, K, strategy="blocks")
    votes = scoring.vote(found)
    return scoring.decide(q.select("q_id"), votes)


ORDER_VECTORS_SQL = f"""f AS (SELECT k AS q_id, {VALID_SQL} AS ok, [{", ".join(f"({s})::DOUBLE" for s in FEATURES_SQL.values())}] AS v FROM p LEFT JOIN risks USING (mcc))"""
SCORE_SQL = f"""WITH {PAYLOADS_SQL}, {ORDER_VECTORS_SQL},
q AS (SELECT * FROM f WHERE q_id % 50 = 0 OR q_id % 97 = 0),
r AS (SELECT q_id AS vec_id, v, CASE WHEN o_orderpriority LIKE '1%' THEN 'fraud' ELSE 'legit' END AS label FROM f JOIN orders ON o_orderkey = q_id WHERE ok AND q_id % 10 = 3),
x AS (SELECT q.q_id, vec_id, label, {dist_sql('q.v', 'r.v').replace('65', '15')} AS distance FROM q CROSS JOIN r WHERE q.ok),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY distance, vec_id) AS rank FROM x) WHERE rank <= 5), s AS ({vote_sql('t')})
SELECT q_id, coalesce(fraud_score, 0.0) AS fraud_score, coalesce(approved, true) AS approved FROM q LEFT JOIN s USING (q_id)"""


def engine_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON requests through the engine: every third is cut off and gets the safe default."""
    references = stored(seed_labels(spark, sf_dir), "references")
    made = ivf.build(references, kmeans.evenly_spaced(references, PARTS), 14).settled()
    p = payloads(spark, sf_dir).where("q_id % 250 = 0")
    text = F.to_json(F.struct(*[c for c in p.columns if c != "q_id"]))
    ship(spark)
    requests = stored(p.select("q_id", F.when(F.col("q_id") % 3 == 0, F.substring(text, 1, 40)).otherwise(text).alias("value")), "requests")
    return Engine(made, CONFIG, risks(spark), K, PARTS, strategy="blocks").prime().respond(requests)


ENGINE_SQL = f"""WITH {PAYLOADS_SQL}, {ORDER_VECTORS_SQL},
q AS (SELECT q_id, ok AND q_id % 3 <> 0 AS ok, {levels_sql('v')} AS v FROM f WHERE q_id % 250 = 0),
r AS (SELECT q_id AS vec_id, {levels_sql('v')} AS v, CASE WHEN o_orderpriority LIKE '1%' THEN 'fraud' ELSE 'legit' END AS label FROM f JOIN orders ON o_orderkey = q_id WHERE ok AND q_id % 10 = 3),
x AS (SELECT q.q_id, vec_id, label, {dist_sql('q.v', 'r.v').replace('65', '15')} AS distance FROM q CROSS JOIN r WHERE q.ok),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY distance, vec_id) AS rank FROM x) WHERE rank <= 5), s AS ({vote_sql('t')})
SELECT q_id, '{{"approved":' || coalesce(approved, true) || ',"fraud_score":' || coalesce(fraud_score, 0.0) || '}}' AS value FROM q LEFT JOIN s USING (q_id)"""


def failopen_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of which some are payloads: which decode, and the default answer of those that don't."""
    e = table(spark, sf_dir, "events").select("event_id", "value", F.concat(F.lit('{"id":"'), F.col("event_id").cast("string"), F.lit('","transaction":{"amount":'), F.when(F.col("event_id") % 3 == 0, F.lit('"x"')).otherwise(F.lit("12.5")), F.lit("}}")).alias("body"))
    done = decode_payloads(e, "body").select("event_id", "decoded", F.coalesce("transaction.amount", F.lit(0.0)).alias("amount"), F.when(F.col("decoded"), F.lit(0.4)).alias("fraud_score"), F.when(F.col("decoded"), X.approved(F.lit(0.4))).alias("approved"))
    return encode_decisions(done).select("event_id", "decoded", "amount", "value")


FAILOPEN_SQL = """SELECT event_id, event_id % 3 <> 0 AS decoded, CASE WHEN event_id % 3 <> 0 THEN 12.5 ELSE 0.0 END::DOUBLE AS amount,
CASE WHEN event_id % 3 <> 0 THEN '{"approved":true,"fraud_score":0.4}' ELSE '{"approved":true,"fraud_score":0.0}' END AS value FROM events"""


COARSE, FINE, ROUNDS = 4, 4, 2


def two_level_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids of both levels from evenly spaced starts: coarse ones by ROUNDS iterations, then FINE of each one's points."""
    made = kmeans.two_level(split(spark, sf_dir)[1], DIMS, COARSE, FINE, ROUNDS, start="even")
    return made.select("c_id", "coarse_id", F.posexplode("centroid").alias("dim", "value")).withColumn("value", F.round("value", 6))


def lloyd_ten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten iterations from evenly spaced points, and how many vectors each cluster then has."""
    r = split(spark, sf_dir)[1]
    centroids = kmeans.lloyd(r, seeds(spark, sf_dir), DIMS, 10, 0.0)
    sizes = kmeans.assign(r, centroids, DIMS).groupBy("c_id").agg(F.count(F.lit(1)).alias("cnt"))
    done = centroids.join(sizes, "c_id", "left").select("c_id", F.coalesce("cnt", F.lit(0)).alias("cnt"), F.posexplode("centroid").alias("dim", "value"))
    return done.withColumn("value", F.round("value", 6))


def iterations_sql(name: str, points: str, start: str, rounds: int, by: str = "0") -> str:
    """CTEs name_0 .. name_rounds(g, c_id, c) from ``start`` over ``points(vec_id, g, v)``; empty clusters keep their centroids."""
    out = [f"{name}_0 AS MATERIALIZED (SELECT g, c_id, c FROM {start})"]
    for k in range(rounds):
        out.append(
            f"""{name}_n{k} AS MATERIALIZED (SELECT vec_id, g, v, c_id FROM (SELECT p.vec_id, p.g, p.v, s.c_id, row_number() OVER (PARTITION BY p.vec_id ORDER BY {dist_sql('p.v', 's.c')}, s.c_id) AS nth
  FROM {points} p JOIN {name}_{k} s ON s.g = p.g) WHERE nth = 1),
{name}_m{k} AS MATERIALIZED (SELECT g, c_id, list(mean ORDER BY i) AS c FROM (SELECT g, c_id, i, avg(v[i]) AS mean FROM {name}_n{k} CROSS JOIN range(1, 65) t(i) GROUP BY ALL) GROUP BY g, c_id),
{name}_{k + 1} AS MATERIALIZED (SELECT s.g, s.c_id, coalesce(m.c, s.c) AS c FROM {name}_{k} s LEFT JOIN {name}_m{k} m ON m.g = s.g AND m.c_id = s.c_id)"""
        )
    return ",\n".join(out)


LLOYD_TEN_SQL = f"""WITH {VECTORS_SQL}, {SEEDS_SQL}, pts AS (SELECT vec_id, 0 AS g, v FROM r), zero AS (SELECT 0 AS g, c_id, c FROM seeds),
{iterations_sql('t', 'pts', 'zero', 11)}, cnts AS (SELECT c_id, count(*) AS cnt FROM t_n10 GROUP BY c_id)
SELECT c_id, coalesce(cnt, 0) AS cnt, (i - 1)::INTEGER AS dim, round(c[i], 6) AS value FROM t_10 LEFT JOIN cnts USING (c_id) CROSS JOIN range(1, 65) t(i)"""
TWO_LEVEL_SQL = f"""WITH {VECTORS_SQL}, n AS (SELECT count(*) AS n FROM r), ranked AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM r), pts AS (SELECT vec_id, 0 AS g, v FROM r),
s0 AS (SELECT 0 AS g, i::INTEGER AS c_id, ranked.v AS c FROM range(0, {COARSE}) t(i) JOIN n ON true JOIN ranked ON pos = i * n // {COARSE}),
{iterations_sql('t', 'pts', 's0', ROUNDS + 1)},
own AS MATERIALIZED (SELECT vec_id, c_id AS g, v FROM t_n{ROUNDS}), placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY vec_id) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM own),
s1 AS (SELECT g, i::INTEGER AS c_id, v AS c FROM range(0, {FINE}) t(i) JOIN placed ON pos = i * n // {FINE}),
{iterations_sql('f', 'own', 's1', ROUNDS)}
SELECT (g * {FINE} + c_id)::INTEGER AS c_id, g::INTEGER AS coarse_id, (i - 1)::INTEGER AS dim, round(c[i], 6) AS value FROM f_{ROUNDS} CROSS JOIN range(1, 65) t(i)"""


def binary_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index written to a binary file, read again and searched."""
    path = os.path.join(tempfile.mkdtemp(prefix="nearfold-index-"), "index.bin")
    ivf.to_binary(index(spark, sf_dir), path)
    back = ivf.from_binary(spark, path, DIMS)
    sizes = back.centroids.select(F.col("part_id"), "cnt", "byte_offset")
    found = ivf.search_labels(split(spark, sf_dir)[0], back, K, PROBES).groupBy("q_id").agg(F.sum("distance").alias("distance"), F.sum((F.col("label") == X.FRAUD).cast("int")).alias("frauds"))
    return found.crossJoin(sizes.agg(F.sum("cnt").alias("vectors"), F.max("byte_offset").alias("last_offset")))


BINARY_SQL = f"""{ALL_SQL} SELECT q_id, sum(distance)::BIGINT AS distance, sum((label = 'fraud')::INTEGER)::BIGINT AS frauds, any_value(vectors)::BIGINT AS vectors, any_value(last_offset)::BIGINT AS last_offset
FROM found CROSS JOIN (SELECT sum(cnt) AS vectors FROM sizes) CROSS JOIN (SELECT max(o) AS last_offset FROM (SELECT coalesce(sum(cnt * 64) OVER (ORDER BY part_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM sizes)) GROUP BY q_id"""


def strict_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which JSON texts decode: names in any case do, a number for a text doesn't, nor a list of merchants with one."""
    kind = F.col("event_id") % 6
    body = F.when(kind == 0, F.lit('{"ID":"a","Transaction":{"AMOUNT":2.5}}')).when(kind == 1, F.lit('{"id":7,"transaction":{"amount":2.5}}')).when(kind == 2, F.lit('{"id":"7","customer":{"known_merchants":["a",5]}}'))
    body = body.when(kind == 3, F.lit('{"id":"x \\"id\\": 5","transaction":{"amount":2.5}}')).when(kind == 4, F.lit('{"id":null,"customer":{"known_merchants":["a" , "b\\"]"]}}')).otherwise(F.lit('{"merchant":{"mcc":5411}}'))
    e = table(spark, sf_dir, "events").select("event_id", body.alias("body"))
    return decode_payloads(e, "body").select("event_id", "decoded", F.coalesce("transaction.amount", F.lit(0.0)).alias("amount"), F.coalesce(F.size("customer.known_merchants"), F.lit(0)).alias("merchants"))


STRICT_SQL = """SELECT event_id, event_id % 6 IN (0, 3, 4) AS decoded, CASE WHEN event_id % 6 IN (0, 3) THEN 2.5 ELSE 0.0 END::DOUBLE AS amount, CASE WHEN event_id % 6 = 4 THEN 2 ELSE 0 END::INTEGER AS merchants FROM events"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        knn_vote, exact_knn, exact_knn_blocks, vectorize_orders, mcc_lookup_default, last_tx_sentinel, hour_weekday_features, known_merchant_flag,
        clamped_ratios, quantize, dequantize, quantized_knn, vector_products, assign_nearest, partition_sizes, partition_offsets, partition_layout,
        lloyd_step, lloyd_ten, two_level_training, binary_index, strict_payloads, ivf_probe, ivf_labels, ivf_labels_blocks, ivf_knn, ivf_vote, recall_at_5, latency_percentiles, score_orders, engine_decisions,
        failopen_decisions,
    )
}

ORACLE_SQL: dict[str, str] = {
    "knn_vote": f"WITH {VECTORS_SQL}, {EXACT_SQL} {vote_sql('exact')}",
    "exact_knn": f"WITH {VECTORS_SQL}, {EXACT_SQL} SELECT * FROM exact",
    "exact_knn_blocks": f"WITH {VECTORS_SQL}, {EXACT_SQL} SELECT * FROM exact",
    "vectorize_orders": VECTORIZE_SQL,
    "mcc_lookup_default": f"WITH {PAYLOADS_SQL} SELECT mcc, coalesce(risk, 0.5) AS mcc_risk, count(*) AS n FROM p LEFT JOIN risks USING (mcc) GROUP BY ALL",
    "last_tx_sentinel": f"SELECT q_id, minutes_since_last_tx, km_from_last_tx FROM ({VECTORIZE_SQL}) WHERE minutes_since_last_tx = -1 OR minutes_since_last_tx BETWEEN 0.001 AND 0.999",
    "hour_weekday_features": HOUR_SQL,
    "known_merchant_flag": "SELECT l_orderkey, count(DISTINCT l_suppkey)::INTEGER AS n_known, CASE WHEN bool_or(l_suppkey = l_orderkey % 100 + 1) THEN 0.0 ELSE 1.0 END::DOUBLE AS unknown_merchant FROM lineitem GROUP BY l_orderkey",
    "clamped_ratios": f"SELECT c_custkey, {clamp_sql('c_acctbal / 5000')} AS share, CASE WHEN c_acctbal <= 0 THEN 1.0 ELSE {clamp_sql('900.0::DOUBLE / c_acctbal / 10')} END::DOUBLE AS ratio FROM customer",
    "quantize": f"WITH {VECTORS_SQL} SELECT vec_id, array_to_string({levels_sql('v')}, ',') AS levels, (label = 'fraud')::INTEGER AS code FROM e",
    "dequantize": f"WITH {VECTORS_SQL}, l AS (SELECT vec_id, {levels_sql('v')} AS l FROM e) SELECT vec_id, (i - 1)::INTEGER AS dim, CASE WHEN l[i] = 255 THEN (CASE WHEN i IN (6, 7) THEN -1.0 ELSE 1.0 END) ELSE l[i] / 255.0::DOUBLE END::DOUBLE AS value FROM l CROSS JOIN range(1, 65) t(i)",
    "quantized_knn": f"WITH {VECTORS_SQL}, {LEVELS_SQL}, x AS (SELECT q_id, vec_id, label, {dist_sql('lq.l', 'lr.l')}::BIGINT AS distance FROM lq CROSS JOIN lr) SELECT q_id, rank, vec_id, distance, label FROM (SELECT *, {RANKED_SQL} FROM x) WHERE rank <= {K}",
    "vector_products": f"WITH {VECTORS_SQL}, {SEEDS_SQL} SELECT vec_id, c_id, {dot_sql('r.v', 'c')} AS dot, {dot_sql('c', 'c')} AS norm, {dot_sql('c', 'c')} - 2 * {dot_sql('r.v', 'c')} AS rank_distance, {dist_sql('r.v', 'c')} AS folded FROM r CROSS JOIN seeds WHERE vec_id % 10 = 1",
    "assign_nearest": f"WITH {VECTORS_SQL}, {SEEDS_SQL} SELECT vec_id, c_id, d FROM near",
    "partition_sizes": f"WITH {VECTORS_SQL}, {SEEDS_SQL} SELECT part_id, cnt FROM sizes",
    "partition_offsets": f"WITH {VECTORS_SQL}, {SEEDS_SQL} SELECT part_id, cnt, coalesce(sum(cnt * 64) OVER (ORDER BY part_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_offset FROM sizes",
    "partition_layout": f"WITH {VECTORS_SQL}, {SEEDS_SQL} SELECT c_id AS part_id, vec_id, (label = 'fraud')::INTEGER AS label, (row_number() OVER (PARTITION BY c_id ORDER BY vec_id) - 1)::INTEGER AS place FROM near JOIN r USING (vec_id)",
    "lloyd_step": LLOYD_SQL,
    "lloyd_ten": LLOYD_TEN_SQL,
    "two_level_training": TWO_LEVEL_SQL,
    "binary_index": BINARY_SQL,
    "strict_payloads": STRICT_SQL,
    "ivf_probe": f"WITH {VECTORS_SQL}, {SEEDS_SQL}, {PROBE_SQL} SELECT * FROM probe",
    "ivf_labels": f"{ALL_SQL} SELECT q_id, rank, vec_id, distance, label FROM found",
    "ivf_labels_blocks": f"{ALL_SQL} SELECT q_id, rank, vec_id, distance, label FROM found",
    "ivf_knn": f"{ALL_SQL} SELECT q_id, rank, vec_id, distance, label, (i - 1)::INTEGER AS dim, CASE WHEN l[i] = 255 THEN (CASE WHEN i IN (6, 7) THEN -1.0 ELSE 1.0 END) ELSE l[i] / 255.0::DOUBLE END::DOUBLE AS value FROM found CROSS JOIN range(1, 65) t(i)",
    "ivf_vote": f"{ALL_SQL} {vote_sql('found')}",
    "recall_at_5": RECALL_SQL,
    "latency_percentiles": LATENCY_SQL,
    "score_orders": SCORE_SQL,
    "engine_decisions": ENGINE_SQL,
    "failopen_decisions": FAILOPEN_SQL,
}
