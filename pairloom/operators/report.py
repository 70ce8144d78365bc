"""Reports over the long (id, model, prediction) table: leaderboard (A5,
A7, F5, C8), inspection table (X5, X6, J1), per-example report (X7, X8,
U9, F6, A6, C9-C11), head (X9) and failure listing (X10).

Two composite formulas exist and are kept apart on purpose:
leaderboard_composite = (acc * sim / ppl)^(1/3) with ppl <= 0 -> 9999;
row_composite = (style * content * 100 / max(ppl, 1))^(1/3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.rewrite import ERROR

INF = float("inf")


def leaderboard_composite(acc: Column, sim: Column, ppl: Column) -> Column:
    """A5 (C7): geometric mean of accuracy, similarity and 1/perplexity."""
    safe = F.when(ppl <= 0, F.lit(9999.0)).otherwise(ppl)
    return F.pow(acc * sim * (F.lit(1.0) / safe), F.lit(1.0 / 3.0))


def row_composite(style: Column, content: Column, ppl: Column) -> Column:
    """A6 (C10): per-example composite, perplexity clamped below at 1."""
    return F.pow(style * content * (F.lit(100.0) / F.greatest(ppl, F.lit(1.0))), F.lit(1.0 / 3.0))


def leaderboard(scores: DataFrame) -> DataFrame:
    """One row per model; F5 drops a model whose first prediction
    (lowest id) is "Error".  Metrics: A2 style accuracy, A4 content
    similarity, A3 mean perplexity (blank and NaN skipped, Infinity if
    none), A5 composite."""
    valid_ppl = F.when(~F.isnan("ppl"), F.col("ppl"))
    agg = scores.groupBy("model").agg(
        F.min_by("prediction", "id").alias("_first"),
        F.avg((F.col("style") == 0).cast("double")).alias("style_acc"),
        F.avg("f1").alias("content_sim"),
        F.coalesce(F.avg(valid_ppl), F.lit(INF)).alias("fluency_ppl"),
    )
    agg = agg.where(F.col("_first").isNull() | (F.col("_first") != ERROR)).drop("_first")
    return agg.withColumn("composite", leaderboard_composite(F.col("style_acc"), F.col("content_sim"), F.col("fluency_ppl")))


# Display header of the leaderboard table and display names
# of the four compared systems, as published.
DISPLAY_HEADERS = ["Model", "Style Acc (↑)", "Content Sim (↑)", "Fluency PPL (↓)", "Composite Score"]
DISPLAY_NAMES = {
    "pivot": "Baseline (Pivot)",
    "zero_shot": "Model 2 (ZeroShot)",
    "synthetic": "Model 3 (Synthetic)",
    "few_shot": "Model 4 (FewShot)",
}


def leaderboard_display(board: DataFrame) -> DataFrame:
    """Display strings (percent with 2 decimals, 3, 2 and 3 decimals),
    formatted in the last projection only."""
    name = F.col("model")
    for key, shown in DISPLAY_NAMES.items():
        name = F.when(F.col("model") == key, F.lit(shown)).otherwise(name)
    h = DISPLAY_HEADERS
    return board.select(
        name.alias(h[0]),
        F.concat(
            F.format_string("%.2f", F.col("style_acc") * 100),
            F.when(F.isnan("style_acc") | F.col("style_acc").isin(INF, -INF), F.lit("")).otherwise(F.lit("%")),
        ).alias(h[1]),
        F.format_string("%.3f", "content_sim").alias(h[2]),
        F.format_string("%.2f", "fluency_ppl").alias(h[3]),
        F.format_string("%.3f", "composite").alias(h[4]),
    )


def inspection_wide(examples: DataFrame, outputs: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per example, one ``Pred_<model>`` column per
    model; a missing prediction is padded with "".  The model list is
    explicit, so the pivot needs no extra job to find its values; the pivot
    groups by id only and the texts join back once per example (not once
    per model)."""
    grid = examples.select("id", F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
    full = grid.join(outputs.select("id", "model", "prediction"), ["id", "model"], "left").withColumn(
        "prediction", F.coalesce("prediction", F.lit(""))
    )
    wide = full.groupBy("id").pivot("model", list(models)).agg(F.first("prediction"))
    wide = examples.select("id", "input", "gold").join(wide, "id")
    return wide.select(
        F.col("id").alias("ID"),
        F.col("input").alias("Original_Biased"),
        F.col("gold").alias("Gold_Reference"),
        *[F.col(f"`{m}`").alias(f"Pred_{m}") for m in models],
    )


def example_scores(scores: DataFrame) -> DataFrame:
    """Per (example, model) report cells.  Empty or "Error"
    predictions are failures: Output "Error", Style 0, Content 0, Fluency
    99999, Composite null."""
    failed = F.col("prediction").isNull() | (F.col("prediction") == "") | (F.col("prediction") == ERROR)
    ppl = F.coalesce(F.col("ppl"), F.lit(INF))
    style = (F.col("style") == 0).cast("int")
    return scores.select(
        "id",
        "input",
        "gold",
        "model",
        F.when(failed, F.lit(ERROR)).otherwise(F.col("prediction")).alias("Output"),
        F.when(failed, F.lit(0)).otherwise(style).alias("Style"),
        F.when(failed, F.lit(0.0)).otherwise(F.round("f1", 3)).alias("Content"),
        F.when(failed, F.lit(99999.0)).otherwise(F.round(ppl, 1)).alias("Fluency"),
        F.when(failed, F.lit(None).cast("double"))
        .otherwise(F.round(row_composite(style.cast("double"), F.col("f1"), ppl), 3))
        .alias("Composite"),
    )


REPORT_FIELDS = ("Output", "Style", "Content", "Fluency", "Composite")


def granular_report(cells: DataFrame, models: Sequence[str]) -> DataFrame:
    """The wide per-example report, five columns per model in
    model order (null for a model without that example).  Pivoted by id
    only, in one aggregation that also takes the input and gold texts."""
    mine = {m: F.col("model") == m for m in models}
    cell = {f"{m}_{f}": F.first(F.when(mine[m], F.struct(f)), ignorenulls=True)[f] for m in models for f in REPORT_FIELDS}
    wide = cells.groupBy("id").agg(
        F.first("input").alias("input"), F.first("gold").alias("gold"), *[v.alias(k) for k, v in cell.items()]
    )
    cols = [F.col("id").alias("ID"), F.col("input").alias("Original_Input"), F.col("gold").alias("Gold_Reference")]
    cols += [F.col(f"`{c}`") for c in cell]
    return wide.select(*cols)
