"""Incremental curation: new raw corpus files (S1 layout) arriving in a
folder are parsed and passed through the structural-edit filter (F1) as
they come, with exactly-once output through the checkpoint.  Both steps
are row-local, so the stream needs no state."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairloom.operators.pairs import structural_filter
from pairloom.sources.text_tables import parse_tsv_lines


def curate_stream(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, min_diff: int = 2,
                  max_diff_ratio: float = 0.4, available_now: bool = True) -> StreamingQuery:
    lines = spark.readStream.format("text").load(in_dir)
    raw = parse_tsv_lines(lines).withColumnRenamed("id", "pair_id")
    kept = structural_filter(raw, min_diff, max_diff_ratio).withColumn("ratio", F.round("ratio", 6))
    w = kept.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
