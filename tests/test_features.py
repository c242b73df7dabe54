import json

import pytest
from pyspark.sql import functions as F

from nearfold.functions import expressions as X
from nearfold.functions.features import NAMES, PAYLOAD, Config, vectorize
from nearfold.sources.files import decode_payloads, random_payloads, random_vectors

CONFIG = Config(max_minutes=1440)
LEGIT = {
    "id": "a", "transaction": {"amount": 41.12, "installments": 2, "requested_at": "2026-03-11T18:45:53Z"},
    "customer": {"avg_amount": 82.24, "tx_count_24h": 3, "known_merchants": ["M1", "M2"]}, "merchant": {"id": "M2", "mcc": "5411", "avg_amount": 60.25},
    "terminal": {"is_online": False, "card_present": True, "km_from_home": 29.23}, "last_transaction": None,
}
FRAUD = {
    "id": "b", "transaction": {"amount": 9505.97, "installments": 10, "requested_at": "2026-03-14T05:15:12Z"},
    "customer": {"avg_amount": 81.28, "tx_count_24h": 20, "known_merchants": ["M1"]}, "merchant": {"id": "M9", "mcc": "7802", "avg_amount": 54.86},
    "terminal": {"is_online": False, "card_present": True, "km_from_home": 952.27}, "last_transaction": None,
}


def features(spark, *payloads):
    risks = spark.createDataFrame([("5411", 0.15), ("7802", 0.75)], "mcc string, risk double")
    rows = spark.createDataFrame([(i, p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)], "q_id int, value string")
    return [r["features"] for r in vectorize(decode_payloads(rows), CONFIG, risks).orderBy("q_id").collect()]


def changed(path, value, base=LEGIT):
    out = json.loads(json.dumps(base))
    *outer, last = path.split(".")
    at = out
    for k in outer:
        at = at[k]
    at[last] = value
    return out


def values(text):
    return [float(x) for x in text.split()]


def test_two_published_examples(spark):
    a, b = features(spark, LEGIT, FRAUD)
    assert a == pytest.approx(values(".0041 .1667 .05 .7826 .3333 -1 -1 .0292 .15 0 1 0 .15 .006"), abs=1e-4)
    assert b == pytest.approx(values(".9506 .8333 1 .2174 .8333 -1 -1 .9523 1 0 1 1 .75 .0055"), abs=1e-4)


@pytest.mark.parametrize(
    ("path", "value", "name", "expected"),
    [
        ("transaction.requested_at", "2026-03-02T00:00:00Z", "day_of_week", 0.0),
        ("transaction.requested_at", "2026-03-08T00:00:00Z", "day_of_week", 1.0),
        ("transaction.requested_at", "2026-03-11T00:00:00Z", "day_of_week", 2 / 6),
        ("transaction.requested_at", "2026-03-11T23:30:00-03:00", "hour_of_day", 1.0),
        ("transaction.amount", 20000, "amount", 1.0),
        ("transaction.amount", -100, "amount", 0.0),
        ("customer.avg_amount", 0, "amount_vs_avg", 1.0),
        ("customer.avg_amount", -50, "amount_vs_avg", 1.0),
        ("customer.known_merchants", ["M2", "M2"], "unknown_merchant", 0.0),
        ("customer.known_merchants", None, "unknown_merchant", 1.0),
        ("merchant.id", "M3", "unknown_merchant", 1.0),
        ("merchant.mcc", "0000", "mcc_risk", 0.5),
        ("last_transaction", {"timestamp": "2026-03-11T13:20:53Z", "km_from_current": 18.8}, "minutes_since_last_tx", 325 / 1440),
        ("last_transaction", {"timestamp": "2026-03-12T13:20:53Z", "km_from_current": 18.8}, "minutes_since_last_tx", 0.0),
        ("last_transaction", {"timestamp": "2026-03-11T13:20:53Z", "km_from_current": 18.8}, "km_from_last_tx", 0.0188),
    ],
)
def test_edges(spark, path, value, name, expected):
    (v,) = features(spark, changed(path, value))
    assert v[NAMES.index(name)] == pytest.approx(expected)


def test_what_cannot_be_read_has_no_features(spark):
    bad = [changed("transaction.requested_at", t) for t in ("2026-03-11", "2026-03-11 18:45:53Z", "2026-02-30T00:00:00Z", "2026-03-11T18:45:53", None)]
    bad += [changed("last_transaction", {"timestamp": "never", "km_from_current": 1.0}), "{not json", changed("transaction.amount", "ten"), ""]
    assert features(spark, *bad) == [None] * len(bad)


def test_config_must_be_positive():
    with pytest.raises(ValueError):
        Config(max_minutes=0)


def test_quantization(spark):
    row = spark.createDataFrame([([0.0, 0.5, 1.0, -1.0, 1.4, -1.0, -0.2],)], "v array<double>").select(X.quantize(F.col("v")).alias("q")).withColumn("d", X.dequantize(F.col("q"))).first()
    assert row["q"] == [0, 127, 254, 255, 254, 255, 255]
    assert row["d"] == pytest.approx([0, 127 / 255, 254 / 255, 1.0, 254 / 255, -1.0, -1.0])


def test_sentinel_is_far_in_one_metric_and_near_in_the_other(spark):
    rows = spark.createDataFrame([([-1.0], [0.0]), ([-1.0], [1.0])], "a array<double>, b array<double>")
    raw = rows.select(X.squared_l2(F.col("a"), F.col("b"), 1).alias("d")).collect()
    level = rows.select(X.squared_l2(X.quantize(F.col("a")), X.quantize(F.col("b")), 1, "long").alias("d")).collect()
    assert [r["d"] for r in raw] == [1.0, 4.0]
    assert [r["d"] for r in level] == [65025, 1]


def test_generators(spark):
    assert random_vectors(spark, 10).where(F.size("vector") != 14).count() == 0
    p = random_payloads(spark, 20)
    assert set(PAYLOAD.names) == set(p.columns)
    risks = spark.createDataFrame([("5411", 0.15)], "mcc string, risk double")
    assert vectorize(p, CONFIG, risks).where("features IS NULL").count() == 0
