"""Fixed-length encoding (C12, C13) and token-loss aggregates.

Tokens are words (the reference's sub-word tokenizer is a per-row codec
and is not rebuilt).  The vocabulary holds the ``size`` most frequent
words (ties by word): id 0 is padding, 1 is unknown, word of rank r has
id r + 1.  Every text is split whole; the encoding keeps the first
``max_len`` tokens, which is the truncation rule of the encoder itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.text import words
from pairloom.operators import fluency as FL

PAD, UNK, IGNORE = 0, 1, -100


def vocabulary(texts: DataFrame, size: int = 8000, text: str = "text") -> DataFrame:
    """(word, id): top ``size`` words.  The top-k is a partial top-k per
    partition (no full sort); the final numbering window sees at most
    ``size`` rows, a fixed bound, so the table is broadcast when joined."""
    counts = texts.select(F.explode(words(text)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), F.asc("word")).limit(size)
    w = Window.orderBy(F.desc("n"), F.asc("word"))
    return top.select("word", (F.row_number().over(w) + 1).alias("id"))


def _pad(ids, value: int, max_len: int):
    return F.concat(ids, F.array_repeat(F.lit(value), F.lit(max_len) - F.size(ids)))


def encode_pairs(pairs: DataFrame, vocab: DataFrame, max_len: int = 128) -> DataFrame:
    """(pair_id, input_ids, attention_mask, labels, src_words, tgt_words):
    source ids right-padded with 0 and its mask; target ids with padding
    replaced by -100 (C13).  One explode of both sides, a broadcast join
    to the bounded vocabulary, one aggregation back per pair."""
    sides = pairs.select("pair_id", F.expr("stack(2, 0, src_raw, 1, tgt_raw) AS (side, _t)"))
    toks = sides.select("pair_id", "side", F.posexplode(F.slice(words("_t"), 1, max_len)).alias("pos", "word"))
    toks = toks.join(F.broadcast(vocab), "word", "left").select(
        "pair_id", "side", "pos", "word", F.coalesce("id", F.lit(UNK)).alias("id")
    )

    def side_list(k, field):
        return F.transform(
            F.array_sort(F.collect_list(F.when(F.col("side") == k, F.struct("pos", field)))), lambda x: x[field]
        )

    agg = toks.groupBy("pair_id").agg(
        side_list(0, "id").alias("_src"),
        side_list(1, "id").alias("_tgt"),
        side_list(0, "word").alias("src_words"),
        side_list(1, "word").alias("tgt_words"),
    )
    enc = pairs.select("pair_id").join(agg, "pair_id", "left")
    empty = F.array().cast("array<int>")
    src = F.coalesce(F.col("_src"), empty).cast("array<int>")
    tgt = F.coalesce(F.col("_tgt"), empty).cast("array<int>")
    return enc.select(
        "pair_id",
        _pad(src, PAD, max_len).alias("input_ids"),
        _pad(F.transform(src, lambda x: F.lit(1)), 0, max_len).alias("attention_mask"),
        F.transform(_pad(tgt, PAD, max_len), lambda x: F.when(x == PAD, F.lit(IGNORE)).otherwise(x)).alias("labels"),
        F.coalesce("src_words", F.array().cast("array<string>")).alias("src_words"),
        F.coalesce("tgt_words", F.array().cast("array<string>")).alias("tgt_words"),
    )


def token_losses(encoded: DataFrame, lm: FL.BigramModel) -> DataFrame:
    """(pair_id, pos, label, loss, weight) for every label position that is
    not masked: loss is the bigram model's -ln p of the target word given
    the previous one; weight is 2 where the target word differs from the
    source word at that position, 1 where it is unchanged.  Masked positions
    weigh nothing and end before the joins; a pair without any other keeps
    one row (pos and label null, loss and weight 0)."""
    # padding is on the right only, so the positions stay
    real = F.filter("labels", lambda x: x != IGNORE)
    x = encoded.select("pair_id", "src_words", "tgt_words", F.posexplode_outer(real).alias("pos", "label"))
    masked = F.col("label").isNull()
    prev = F.when(F.col("pos") == 0, F.lit(FL.BOS)).otherwise(F.get(F.col("tgt_words"), F.col("pos") - 1))
    x = x.select(
        "pair_id",
        "pos",
        "label",
        # words hold no space: pairs without a label meet nothing, each in a place of its own
        F.when(masked, F.concat(F.lit(" "), F.col("pair_id").cast("string"))).otherwise(prev).alias("u"),
        F.get(F.col("tgt_words"), F.col("pos")).alias("w"),
        F.get(F.col("src_words"), F.col("pos")).alias("_sw"),
    )
    x = FL.with_contexts(x.join(lm.bigrams, ["u", "w"], "left"), lm)
    lp = F.ln(F.coalesce(F.col("c"), F.lit(0)) + 1) - F.ln(F.coalesce(F.col("cu"), F.lit(0)) + lm.vocab)
    weight = F.when(masked, F.lit(0.0)).when(F.col("_sw").eqNullSafe(F.col("w")), F.lit(1.0)).otherwise(F.lit(2.0))
    return x.select("pair_id", "pos", "label", F.when(masked, F.lit(0.0)).otherwise(-lp).alias("loss"), weight.alias("weight"))


def masked_loss(losses: DataFrame) -> DataFrame:
    """Mean loss over positions whose label is not -100."""
    return losses.groupBy("pair_id").agg(
        F.avg(F.when(F.col("label") != IGNORE, F.col("loss"))).alias("masked_loss")
    )


def weighted_loss(losses: DataFrame, eps: float = 1e-9) -> DataFrame:
    """sum(loss * w) / (sum(w) + eps)."""
    return losses.groupBy("pair_id").agg(
        (F.sum(F.col("loss") * F.col("weight")) / (F.sum("weight") + F.lit(eps))).alias("weighted_loss")
    )
