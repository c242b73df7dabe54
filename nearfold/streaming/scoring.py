"""Scoring a stream of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from nearfold.plans.engine import Engine


def score_stream(requests: DataFrame, engine: Engine, output: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Writes decisions on a stream of requests(q_id, value) to Parquet under ``output``, a folder for each micro-batch.

    Scoring is stateless and ranks by a window, which streams don't allow, so each micro-batch is scored as a batch.  A
    batch that is run again overwrites its own folder: every request is answered once.
    """

    def handle(batch: DataFrame, number: int) -> None:
        engine.respond(batch).write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = requests.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


