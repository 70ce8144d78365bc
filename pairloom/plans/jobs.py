"""End-to-end jobs (the three entry points of the original workflow), as
single lazy plans with one write each.

* ``curate_corpus``: raw TSV -> structural filter -> exact 80/10/10 split
  -> CSV per split (S1, F1, D1, K1), stage counts logged with ``observe``
  (A1) so no second job runs.
* ``synthesize``: translate the train and val splits (S5, U1, J3).
* ``evaluate_and_report``: model outputs, one scores table, leaderboard and
  the two spreadsheet reports (A7, X5, X7, K1, K2)."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pairloom.operators import report as RP
from pairloom.operators import rewrite as R
from pairloom.operators.pairs import structural_filter
from pairloom.operators.splits import split_80_10_10
from pairloom.session import materialized
from pairloom.sources import sinks
from pairloom.sources.text_tables import read_tsv

log = logging.getLogger("pairloom")


def percent_name(frac: float, stem: str = "train") -> str:
    """File stem with the sample size in percent."""
    return f"{stem}_{int(frac * 100)}percent"


def curate_corpus(spark: SparkSession, raw_path: str, out_dir: str, min_diff: int = 2,
                  max_diff_ratio: float = 0.4) -> dict:
    raw = read_tsv(spark, raw_path).withColumnRenamed("id", "pair_id")
    seen = Observation("raw")
    raw = raw.observe(seen, F.count(F.lit(1)).alias("rows"))
    kept = structural_filter(raw, min_diff, max_diff_ratio)
    cols = [c for c in raw.columns]  # the seven raw columns, as in the input
    split = split_80_10_10(kept.select(*cols), "pair_id", tie_cols=cols).withColumnRenamed("pair_id", "id")
    done = Observation("split")
    split = split.observe(
        done,
        *[F.sum((F.col("split") == s).cast("long")).alias(s) for s in ("train", "val", "test")],
    )
    sinks.write_csv(split, out_dir, partition_by=["split"])
    counts = {"loaded": seen.get.get("rows", 0), **{k: v or 0 for k, v in done.get.items()}}
    log.info("curated %s", counts)
    return counts


def synthesize(pairs_by_split: DataFrame, dictionary: DataFrame, target_lang: str) -> DataFrame:
    """Train and val pairs (column ``split``) translated into
    ``target_lang``; the originals are kept next to the translations."""
    x = pairs_by_split.where(F.col("split").isin("train", "val")).select(
        "pair_id", "split", F.lit(target_lang).alias("lang"),
        F.col("src_raw").alias("src_en_original"), F.col("tgt_raw").alias("tgt_en_original"),
    )
    texts = {"src_en_original": "src_raw", "tgt_en_original": "tgt_raw"}
    return R.translate(x, dictionary, ["pair_id", "lang"], texts, "lang", False)


def evaluate_and_report(evaluation, out_dir: str, models) -> DataFrame:
    """Writes leaderboard.csv, manual_inspection (BOM) and
    granular_inspection (BOM) folders; returns the leaderboard."""
    evaluation.prepare(scorers=True)
    scores = materialized(evaluation.scores(), "scores")  # read by both reports
    board = RP.leaderboard(scores)
    sinks.write_csv(RP.leaderboard_display(board).coalesce(1), f"{out_dir}/final_metrics_table")
    sinks.write_report_csv(RP.inspection_wide(evaluation.examples(), evaluation.outputs(), models),
                           f"{out_dir}/manual_inspection")
    sinks.write_report_csv(RP.granular_report(RP.example_scores(scores), models), f"{out_dir}/granular_inspection")
    return board


def synthesize_files(spark: SparkSession, data_dir: str, out_dir: str, dictionary: DataFrame, target_lang: str,
                     files: dict | None = None) -> dict[str, str]:
    """Entry B over files (S3, S5, U1, J3, K1): every (input, output) pair
    is read through the guarded scan (a missing file or missing columns is
    skipped with a message), translated into ``target_lang`` and written as
    CSV with the originals kept, one row out for each row in (ids may repeat or
    be missing: rows are told apart by their place in the file).  By default
    the train and val folders of ``curate_corpus`` are read, or CSV files of
    that name; the test split is left out."""
    from pyspark.sql import types as T

    from pairloom.sources.text_tables import RAW_COLUMNS, guarded_read_pairs, path_exists

    if files is None:
        curated = path_exists(spark, f"{data_dir.rstrip('/')}/split=train")
        files = {(f"split={s}" if curated else f"{s}_complex.csv"): f"{s}_synthetic" for s in ("train", "val")}
    schema = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])
    report = {}
    for name, out in files.items():
        df, msg = guarded_read_pairs(spark, f"{data_dir.rstrip('/')}/{name}", schema)
        if df is None:
            log.info(msg)
            report[name] = msg
            continue
        x = df.select(
            F.monotonically_increasing_id().alias("_row"), F.lit(target_lang).alias("lang"),
            F.col("src_raw").alias("src_en_original"), F.col("tgt_raw").alias("tgt_en_original"),
        )
        texts = {"src_en_original": "src_raw", "tgt_en_original": "tgt_raw"}
        x = R.translate(x, dictionary, "_row", texts, "lang", False)
        sinks.write_csv(x.select("src_raw", "tgt_raw", "src_en_original", "tgt_en_original"), f"{out_dir}/{out}")
        report[name] = "ok"
    return report
