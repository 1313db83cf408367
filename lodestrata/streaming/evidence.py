"""Evidence as it arrives: the merge of findings over a stream of reports.

The state is one row per finding key and window; late reports within the
watermark still merge, those after it are dropped by Structured Streaming. Each
micro-batch goes to its sink with the batch's number, so that a repeated batch
overwrites itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestrata.functions.ranks import CONFIDENCE, SEVERITY, rank, word

KEY = ["tool", "rule_id", "path", "start_line"]
REPORT = "report_id string, tool string, rule_id string, path string, start_line int, severity string, confidence string, received_at timestamp"


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """A stream of findings from JSON lines that are added to a folder."""
    return spark.readStream.schema(REPORT).option("maxFilesPerTrigger", 50).json(path)


def merge_stream(findings: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """One row per key and window: greatest severity and confidence, and how many reports; each report counts once."""
    once = findings.withWatermark("received_at", late).dropDuplicatesWithinWatermark(["report_id", *KEY])
    grouped = once.groupBy(F.window("received_at", window), *KEY).agg(F.max(rank("severity", SEVERITY)).alias("s"), F.max(rank("confidence", CONFIDENCE)).alias("c"), F.count("*").alias("reports"))
    return grouped.select(F.col("window.start").alias("window_start"), *KEY, word("s", SEVERITY).alias("severity"), word("c", CONFIDENCE).alias("confidence"), "reports")


def start(merged: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Writes updates to ``out``, a folder per batch."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    w = merged.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
