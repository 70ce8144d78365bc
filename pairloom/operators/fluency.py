"""Fluency (U6, C6, F3, F4, A3): perplexity under an add-one smoothed
bigram language model with sentence boundary tokens.  A classical
stand-in for the reference's neural language model; lower is better.

p(w | u) = (c(u, w) + 1) / (c(u) + V), where c(u) counts bigrams that
start with u and V is the number of distinct predicted tokens (words and
the end token).  Perplexity of a text = exp(mean of -ln p) over its
n + 1 bigrams.  Blank texts have no perplexity (null)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import computed_once, words
from pairloom.session import materialized

BOS, EOS = "<s>", "</s>"


def bigram_rows(df: DataFrame, ids, text: str = "text") -> DataFrame:
    """(ids..., u, w) for every bigram of <s> words </s>; blank and null
    texts give no rows.  One posexplode per text; the previous token is an
    index lookup into the same word array (no zipped struct arrays)."""
    ws = computed_once(df.select(*ids, F.col(text).alias("_text")), _ws=words("_text")).where(F.size("_ws") > 0)
    x = ws.select(*ids, "_ws", F.posexplode(F.concat("_ws", F.array(F.lit(EOS)))).alias("_i", "w"))
    u = F.when(F.col("_i") == 0, F.lit(BOS)).otherwise(F.get(F.col("_ws"), F.col("_i") - 1))
    return x.select(*ids, u.alias("u"), "w")


@dataclass
class BigramModel:
    bigrams: DataFrame  # u, w, c
    contexts: DataFrame  # u, cu
    vocab: Column  # scalar subquery V

    def write(self, path: str) -> None:
        """Save the counts as parquet (a shared folder on a cluster), so
        later jobs score without recounting the corpus."""
        self.bigrams.write.mode("overwrite").parquet(f"{path}/bigrams")
        self.contexts.write.mode("overwrite").parquet(f"{path}/contexts")

    @staticmethod
    def read(spark, path: str) -> "BigramModel":
        return _model(spark.read.parquet(f"{path}/bigrams"), spark.read.parquet(f"{path}/contexts"))


def _model(bigrams: DataFrame, contexts: DataFrame) -> BigramModel:
    """V without a pass over all bigrams: every word of the corpus is a
    context, as is the start mark, while the end mark is predicted; a text may
    also hold one of the marks as a word."""
    n = contexts.agg((F.count("u") - F.count(F.when(F.col("u") == EOS, 1))).alias("n")).select("n").scalar()
    marks = bigrams.where(F.col("w") == BOS).agg(F.count_distinct("w").alias("n")).select("n").scalar()
    return BigramModel(bigrams, contexts, n + marks)


def train_bigram(corpus: DataFrame, text: str = "text", materialize: bool = True) -> BigramModel:
    """Counts of every bigram and context of the corpus.  Both feed several
    joins and are written once (``materialize``) instead of being recounted
    by each; as stored tables they also leave a skewed join free to be split."""
    bg = bigram_rows(corpus, [], text).groupBy("u", "w").agg(F.count(F.lit(1)).alias("c"))
    if materialize:
        bg = materialized(bg, "bigrams")
    ctx = bg.groupBy("u").agg(F.sum("c").alias("cu"))
    return _model(bg, materialized(ctx, "contexts") if materialize else ctx)


def with_contexts(rows: DataFrame, model: BigramModel) -> DataFrame:
    """Left join of the context counts (``cu``) on ``u``.  Every text holds
    the start mark and the commonest words: both sides are plain scans or
    shuffles, so Spark broadcasts a small context table, and splits the hot
    contexts of a large one."""
    return rows.join(model.contexts, "u", "left")


def perplexity(texts: DataFrame, model: BigramModel, id_cols, text: str = "text", source: DataFrame | None = None) -> DataFrame:
    """Adds ``ppl`` to every row of ``texts`` (null for blank text).
    Bigrams are pre-aggregated per text before the two model joins; they are
    hashed and the model's, far more, only pass by them unsorted.  ``source``
    has the same ids and texts, where ``texts`` is a plan with more columns
    that is not to be run again for the bigrams."""
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    bg = bigram_rows(texts if source is None else source, ids, text).groupBy(*ids, "u", "w").agg(F.count(F.lit(1)).alias("k"))
    scored = (
        with_contexts(bg.hint("shuffle_hash").join(model.bigrams, ["u", "w"], "left"), model)
        .select(
            *ids,
            "k",
            (F.ln(F.coalesce(F.col("c"), F.lit(0)) + 1) - F.ln(F.coalesce(F.col("cu"), F.lit(0)) + model.vocab)).alias(
                "_lp"
            ),
        )
        .groupBy(*ids)
        .agg(F.exp(-F.sum(F.col("k") * F.col("_lp")) / F.sum("k")).alias("ppl"))
    )
    return texts.join(scored, ids, "left")


def mean_perplexity(scored: DataFrame, group_cols) -> DataFrame:
    """A3 with F3/F4: macro mean over non-blank, non-NaN texts; Infinity
    when none remain (``avg`` of a NaN would be NaN, so filter first)."""
    valid = F.when(~F.isnan("ppl"), F.col("ppl"))
    return scored.groupBy(*group_cols).agg(
        F.coalesce(F.avg(valid), F.lit(float("inf"))).alias("ppl_mean")
    )
