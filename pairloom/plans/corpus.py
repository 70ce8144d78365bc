"""Derived tables shared by the registered queries (lazy DataFrames)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators.pairs import revision_pairs
from pairloom.operators.splits import split_80_10_10
from pairloom.session import collect_garbage, ensure_checkpoint_dir, materialized, table


class Corpus:
    """Lazily built stand-in tables over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        # materialised tables go to the session's shared checkpoint folder
        ensure_checkpoint_dir(spark)
        self._pairs: DataFrame | None = None

    def t(self, name: str, *cols: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name, *cols)

    def documents(self) -> DataFrame:
        return self.t("documents", "doc_id", "text", "lang")

    def pairs(self) -> DataFrame:
        return revision_pairs(self.documents())

    def stored_pairs(self) -> DataFrame:
        """The pairs, written once for plans that read them several times."""
        if self._pairs is None:
            self._pairs = materialized(self.pairs(), "pairs")
            collect_garbage(self.spark)
        return self._pairs

    def split_pairs(self) -> DataFrame:
        return split_80_10_10(self.pairs() if self._pairs is None else self._pairs, "pair_id")

    def train_pairs(self) -> DataFrame:
        return self.split_pairs().where(F.col("split") == "train").drop("split")


def judge_training(c: Corpus) -> DataFrame:
    """Labelled texts for the style judge: documents with their toxicity
    label (1 = biased style, 0 = neutral)."""
    return c.documents().join(c.t("labels", "doc_id", "toxic"), "doc_id").select(
        "doc_id", "text", F.col("toxic").alias("label")
    )
