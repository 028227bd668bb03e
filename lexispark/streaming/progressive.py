"""Progressive results, and incremental ingestion with Structured Streaming (an extension)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def passes(spark: SparkSession, results: Iterable) -> DataFrame:
    """(pass, total_hits, hits) of a progressive search's results in order."""
    rows = [(i, r.total_hits, len(r.hits)) for i, r in enumerate(results)]
    return spark.createDataFrame(rows, "pass int, total_hits long, hits int")


def ingest(stream: DataFrame, tokens, out: str, checkpoint: str, id_col: str = "doc_id", time_col: str | None = None, delay: str = "10 minutes"):
    """Append the tokens of newly arriving documents to a Parquet table.

    ``tokens`` maps a batch DataFrame to its rows. With ``time_col`` a document
    that arrives again within the delay is dropped by a watermarked dedupe.
    Returns the running query.
    """
    if time_col is not None:
        stream = stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([id_col])

    def write(batch: DataFrame, n: int) -> None:
        # a batch that is run again after a failure replaces what it wrote before
        tokens(batch).withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
