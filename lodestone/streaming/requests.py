"""Answering a stream of JSON requests: every micro-batch is one batch of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.service import Engine


def answer_stream(engine: Engine, requests: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append (value, response) for every request of the streaming column ``value`` to Parquet files under ``out``.

    Batches are written under their number, so a batch that is repeated after a failure replaces itself.
    """

    def answer(batch: DataFrame, number: int) -> None:
        engine.answer(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = requests.select(F.col("value")).writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
