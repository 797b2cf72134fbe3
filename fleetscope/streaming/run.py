"""Running the alerts to files."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.nulls import asc, desc
from ..operators.topn import top_n_wide


def run_available(stream: DataFrame, path: str, offsets: str) -> DataFrame:
    """Process everything available with exactly-once parquet output, then return what was written so far."""
    query = (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", offsets)
             .trigger(availableNow=True).start(path))
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def top_events_each_batch(event_counts: DataFrame, path: str, offsets: str, n: int = 5):
    """Rank the events of every finished sample.

    With append output a micro-batch holds whole samples, so ranking inside it is complete. Each
    batch owns one folder and overwrites it, so a batch that is run again leaves no duplicates.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        ranked = top_n_wide(batch, ["sample_time"], ["event", "sessions"], [desc("sessions"), asc("event")], n)
        ranked.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = (event_counts.writeStream.outputMode("append").option("checkpointLocation", offsets)
             .trigger(availableNow=True).foreachBatch(write).start())
    query.awaitTermination()
    return event_counts.sparkSession.read.parquet(path).drop("batch")
