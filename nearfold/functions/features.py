"""Transactions to feature vectors."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfold.functions import expressions as X

DIMS = 14
NAMES = (
    "amount", "installments", "amount_vs_avg", "hour_of_day", "day_of_week", "minutes_since_last_tx", "km_from_last_tx",
    "km_from_home", "tx_count_24h", "is_online", "card_present", "unknown_merchant", "mcc_risk", "merchant_avg_amount",
)



def _record(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


_TEXT, _REAL, _WHOLE, _FLAG = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType()
PAYLOAD = _record(
    id=_TEXT,
    transaction=_record(amount=_REAL, installments=_WHOLE, requested_at=_TEXT),
    customer=_record(avg_amount=_REAL, tx_count_24h=_WHOLE, known_merchants=T.ArrayType(_TEXT)),
    merchant=_record(id=_TEXT, mcc=_TEXT, avg_amount=_REAL),
    terminal=_record(is_online=_FLAG, card_present=_FLAG, km_from_home=_REAL),
    last_transaction=_record(timestamp=_TEXT, km_from_current=_REAL),
)


@dataclass(frozen=True)
class Config:
    """What raw values are divided by; each must be positive.  max_minutes has no published value and must be given."""

    max_minutes: float
    max_amount: float = 10_000.0
    max_installments: float = 12.0
    amount_vs_avg_ratio: float = 10.0
    max_km: float = 1_000.0
    max_tx_count_24h: float = 20.0
    max_merchant_avg_amount: float = 10_000.0

    def __post_init__(self) -> None:
        for f in fields(self):
            if not getattr(self, f.name) > 0:
                raise ValueError(f"{f.name} must be positive")


def feature_columns(config: Config, risk: Column) -> list[Column]:
    """The 14 features of a row with the payload's columns; ``risk`` is the merchant category's, null if unknown."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("double"))
    off = lambda c: F.coalesce(F.col(c), F.lit(False))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    share = lambda c, most: X.clamp(zero(c) / F.lit(float(most)))
    now = text("transaction.requested_at")
    none = F.col("last_transaction").isNull()
    minutes = X.minutes_between(X.instant(now), X.instant(text("last_transaction.timestamp")))
    return [
        share("transaction.amount", config.max_amount),
        share("transaction.installments", config.max_installments),
        X.guarded_ratio(zero("transaction.amount"), zero("customer.avg_amount"), config.amount_vs_avg_ratio),
        X.hour_of_day(now),
        X.day_of_week(now),
        F.when(none, F.lit(-1.0)).otherwise(F.when(minutes.isNotNull(), X.clamp(minutes / F.lit(float(config.max_minutes))))),
        F.when(none, F.lit(-1.0)).otherwise(share("last_transaction.km_from_current", config.max_km)),
        share("terminal.km_from_home", config.max_km),
        share("customer.tx_count_24h", config.max_tx_count_24h),
        X.flag(off("terminal.is_online")),
        X.flag(off("terminal.card_present")),
        X.unknown_member(text("merchant.id"), F.coalesce(F.col("customer.known_merchants"), F.array().cast("array<string>"))),
        F.coalesce(risk, F.lit(0.5)),
        share("merchant.avg_amount", config.max_merchant_avg_amount),
    ]


#: Merchant categories that are sent to every task; a larger table is joined as Spark sees fit.
SENT_CATEGORIES = 100_000


def with_risk(payloads: DataFrame, risks: DataFrame, into: str = "__risk") -> DataFrame:
    """A left lookup of risks(mcc, risk) by merchant category; null where there is none."""
    table = risks.select(F.col("mcc").alias("__mcc"), F.col("risk").alias(into)).dropDuplicates(["__mcc"])
    if risks.count() <= SENT_CATEGORIES:
        table = F.broadcast(table)
    return payloads.join(table, F.col("merchant.mcc") == F.col("__mcc"), "left").drop("__mcc")


def vectorize(payloads: DataFrame, config: Config, risks: DataFrame, into: str = "features") -> DataFrame:
    """``payloads`` with an array of the 14 features, or null where a time isn't a strict RFC 3339 text.

    A missing scalar counts as zero, false or an empty text; only last_transaction may be absent, which gives -1 twice.
    """
    columns = feature_columns(config, F.col("__risk"))
    whole = all_of([c.isNotNull() for c in (columns[3], columns[4], columns[5])])
    return with_risk(payloads, risks).withColumn(into, F.when(whole, F.array(*columns))).drop("__risk")


def all_of(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
