"""Training-log analytics.

A log document holds a ``log_history`` array of ragged entries (training
entries with loss, evaluation entries with eval_loss, a final summary).
``events`` stands in for the history: every event is one entry, and
documents hold at most ``per_doc`` consecutive events, so no document
(one row) grows with the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRY = T.StructType(
    [
        T.StructField("step", T.LongType()),
        T.StructField("epoch", T.DoubleType()),
        T.StructField("loss", T.DoubleType()),
        T.StructField("learning_rate", T.DoubleType()),
        T.StructField("grad_norm", T.DoubleType()),
        T.StructField("eval_loss", T.DoubleType()),
    ]
)
LOG_DOC = T.StructType([T.StructField("global_step", T.LongType()), T.StructField("log_history", T.ArrayType(ENTRY))])


def event_entries(events: DataFrame) -> DataFrame:
    """(doc_id, entry) from events: step = event_id, epoch = k / 100;
    'view' events are evaluation entries (eval_loss = value), 'error'
    events lose their step, the others are training entries with loss =
    value; only 'click' carries a learning rate and only 'purchase' a
    gradient norm."""
    k = F.get_json_object("props", "$.k").cast("double")
    typ = F.col("event_type")
    train = ~typ.isin("view")
    entry = F.struct(
        F.when(typ != "error", F.col("event_id")).cast("long").alias("step"),
        (k / 100).alias("epoch"),
        F.when(train, F.col("value")).alias("loss"),
        F.when(typ == "click", F.col("value") / 1000).alias("learning_rate"),
        F.when(typ == "purchase", k).alias("grad_norm"),
        F.when(~train, F.col("value")).alias("eval_loss"),
    )
    return events.select(F.col("event_id"), entry.alias("entry"))


def log_documents(events: DataFrame, per_doc: int = 1024) -> DataFrame:
    """(doc_id, json): one JSON log document per block of ``per_doc``
    event ids (bounded collect)."""
    e = event_entries(events).withColumn("doc_id", F.floor(F.col("event_id") / per_doc))
    docs = e.groupBy("doc_id").agg(
        F.max("event_id").alias("global_step"),
        F.array_sort(F.collect_list(F.struct("event_id", "entry"))).alias("_h"),
    )
    return docs.select(
        "doc_id",
        F.to_json(F.struct("global_step", F.transform("_h", lambda x: x["entry"]).alias("log_history"))).alias("json"),
    )


def parse_log(docs: DataFrame, json_col: str = "json") -> DataFrame:
    """S4 in-table: parse with an explicit schema (no inference pass)."""
    return docs.select("*", F.from_json(json_col, LOG_DOC).alias("doc"))


def explode_log(parsed: DataFrame, keep=("doc_id",)) -> DataFrame:
    """Entries having both loss and step, learning rate and
    gradient norm defaulting to 0."""
    x = parsed.select(*keep, F.posexplode("doc.log_history").alias("idx", "e"))
    x = x.where(F.col("e.loss").isNotNull() & F.col("e.step").isNotNull())
    return x.select(
        *keep,
        "idx",
        F.col("e.step").alias("step"),
        F.col("e.loss").alias("loss"),
        F.coalesce(F.col("e.learning_rate"), F.lit(0.0)).alias("learning_rate"),
        F.coalesce(F.col("e.grad_norm"), F.lit(0.0)).alias("grad_norm"),
    )


def training_curve(exploded: DataFrame) -> DataFrame:
    """L1: the series behind the loss / learning-rate / gradient charts,
    in step order within each document (sorted inside partitions after a
    hash partitioning by document: no global sort)."""
    return exploded.repartition("doc_id").sortWithinPartitions("doc_id", "step", "idx")


def log_table(events: DataFrame) -> DataFrame:
    """K3/L2: ragged records (training entries, evaluation entries and one
    final summary per document) as one sparse table, by name with missing
    columns as nulls."""
    e = event_entries(events).select("event_id", "entry.*")
    e = e.withColumn("doc_id", F.floor(F.col("event_id") / 1024))
    train = e.where(F.col("loss").isNotNull()).select(
        "doc_id", "step", "epoch", "loss", "learning_rate", "grad_norm"
    )
    evals = e.where(F.col("eval_loss").isNotNull()).select(
        "doc_id", "step", "epoch", "eval_loss", (F.col("eval_loss") * 10).alias("eval_runtime")
    )
    final = e.groupBy("doc_id").agg(
        F.max("step").alias("step"),
        F.max("epoch").alias("epoch"),
        F.count(F.lit(1)).cast("double").alias("train_runtime"),
        F.avg("loss").alias("train_loss"),
    )
    return train.unionByName(evals, allowMissingColumns=True).unionByName(final, allowMissingColumns=True)


def curve_or_message(parsed: DataFrame) -> tuple[DataFrame | None, str]:
    """The caller-side guard: no usable training steps -> message."""
    x = explode_log(parsed)
    if x.isEmpty():
        return None, "the log has no training step with a loss"
    return training_curve(x), "ok"
