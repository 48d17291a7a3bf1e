"""Cross-sectional scores of streamed bars: whole dates arrive in a micro-batch and are scored by the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.xsection import center_xsection


def standardize_stream(bars: DataFrame, column: str, path: str, checkpoint: str) -> StreamingQuery:
    """Append ``column`` standardized by date to the Parquet table at ``path``.

    A batch is written to a folder of its own by number, so a repeated batch replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn(column, center_xsection(column, "date", True)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return bars.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
