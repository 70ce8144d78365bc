"""Sinks (K1-K3)."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOM = "﻿"


def write_csv(df: DataFrame, out_dir: str, partition_by: Sequence[str] = ()) -> None:
    """K1: CSV with header into a directory of part files (created if
    absent), quotes doubled; ``partition_by`` writes one folder per
    value (e.g. split=train) in the same job."""
    w = df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
    # fields come back as they were: by default the writer trims them
    w = w.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(out_dir)


def write_report_csv(df: DataFrame, out_dir: str) -> None:
    """K2: a report as CSV parts whose headers start with a UTF-8 byte-order
    mark, so each opens in a spreadsheet.  The parts are written in parallel;
    Spark merges small ones and splits large ones, so a small report is one
    file and no report has to pass through one task."""
    first = df.columns[0]
    write_csv(df.withColumnRenamed(first, BOM + first).hint("rebalance"), out_dir)


def union_ragged(frames: Sequence[DataFrame]) -> DataFrame:
    """K3: records with different columns as one table: union by name,
    nulls where a column is absent."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def single_csv_path(out_dir: str) -> str:
    """Path of the part file of a coalesce(1) write (local folders)."""
    parts = sorted(p for p in os.listdir(out_dir) if p.startswith("part-"))
    return os.path.join(out_dir, parts[0])
