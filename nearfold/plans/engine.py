"""The scoring engine: payloads in, one decision for each out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.functions.features import Config, vectorize
from nearfold.operators import ivf, scoring
from nearfold.operators.knn import exact_knn
from nearfold.sources.files import decode_payloads, encode_decisions


class Engine:
    """A loaded index with its configuration; ready once the index is resident."""

    def __init__(self, index: ivf.Index, config: Config, risks: DataFrame, k: int = 5, probes: int = 0, strategy: str = "columns"):
        self.index, self.config, self.risks, self.k, self.strategy = index.check(), config, risks, k, strategy
        self.probes = ivf.probe_count(probes)
        self.is_ready = False

    def prime(self) -> Engine:
        """Keep the index in memory and read it once."""
        self.index.cache()
        self.index.lists.count()
        self.is_ready = True
        return self

    def close(self) -> None:
        self.index.close()
        self.is_ready = False

    def ready(self) -> tuple[int, str]:
        """What a readiness probe answers: a status and a body."""
        return (200, '{"status":"ready"}') if self.is_ready else (503, "")

    def score(self, payloads: DataFrame, by: str = "q_id") -> DataFrame:
        """``payloads`` (its columns and ``by``, unique) with fraud_score and approved; no row is ever lost."""
        vectors = vectorize(payloads, self.config, self.risks, "vector").where("vector IS NOT NULL").select(F.col(by).alias("q_id"), "vector")
        votes = scoring.vote(ivf.search_labels(vectors, self.index, self.k, self.probes, strategy=self.strategy)).withColumnRenamed("q_id", by)
        return scoring.decide(payloads, votes, by)

    def score_exactly(self, payloads: DataFrame, references: DataFrame, by: str = "q_id") -> DataFrame:
        """The same by exact search over raw references(vec_id, vector, label)."""
        vectors = vectorize(payloads, self.config, self.risks, "vector").where("vector IS NOT NULL").select(F.col(by).alias("q_id"), "vector")
        votes = scoring.vote(exact_knn(vectors, references, self.k, self.index.dims)).withColumnRenamed("q_id", by)
        return scoring.decide(payloads, votes, by)

    def respond(self, requests: DataFrame, column: str = "value", by: str = "q_id") -> DataFrame:
        """(by, value): the JSON decision on each JSON request of requests(by, column), the safe default if it can't be read."""
        payloads = decode_payloads(requests, column).drop(column)
        return encode_decisions(self.score(payloads, by)).select(by, "value")
