"""Pairs: derive revision pairs, the structural-edit filter (F1) and the
wide-to-long labelled text table (X11/E1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.text import change_ratio, computed_once, first_words, word_count, word_edit_distance, words

KEY_WORDS = 5


def revision_pairs(documents: DataFrame, bucket_ids: int = 1 << 16) -> DataFrame:
    """Consecutive documents (by doc_id) of one language that share their
    first five words stand for successive revisions of one text.

    Output: pair_id (the later doc), lang, src_raw (earlier text), tgt_raw.
    Documents without an id, a language or a text are not paired.

    The previous-row lookup is a ``lag`` window, but a key (language and
    first five words) may hold a large share of the corpus, so the window
    is partitioned by (key, doc_id div bucket_ids): no window group exceeds
    ``bucket_ids`` documents.  The first row of a bucket takes its
    predecessor from the last row of the key's previous non-empty bucket,
    found through a small table of bucket bounds (one row per key-bucket,
    no text) and joined back only for those boundary rows."""
    d = (
        computed_once(
            documents.select("doc_id", "lang", "text").where(
                F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()
            ),
            k5=first_words("text", KEY_WORDS),
        )
        .select("doc_id", "lang", "text", "k5", F.expr(f"doc_id div {int(bucket_ids)}").alias("b"))
        # stated once here, so the constraints the joins below infer add
        # nothing and every branch shares one scan and one shuffle
        .where(F.col("k5").isNotNull() & F.col("b").isNotNull())
    )
    w = Window.partitionBy("lang", "k5", "b").orderBy("doc_id")
    loc = d.select(
        "*",
        F.lag("text").over(w).alias("src_raw"),
        F.lead("doc_id").over(w).alias("_next_id"),
    )
    body = loc.where(F.col("src_raw").isNotNull()).select(
        F.col("doc_id").alias("pair_id"), "lang", "src_raw", F.col("text").alias("tgt_raw")
    )
    # bucket bounds: the first row of every bucket, taken from the window
    # output (so the one corpus shuffle is reused), as small rows without text
    bounds = loc.where(F.col("src_raw").isNull()).select("lang", "k5", "b")
    wb = Window.partitionBy("lang", "k5").orderBy("b")
    links = bounds.select("lang", "k5", "b", F.lag("b").over(wb).alias("prev_b")).where(
        F.col("prev_b").isNotNull()
    )
    tails = loc.where(F.col("_next_id").isNull()).select("lang", "k5", "b", F.col("text").alias("src_raw"))
    carried = tails.join(
        links.select("lang", "k5", F.col("prev_b").alias("b"), F.col("b").alias("next_b")),
        ["lang", "k5", "b"],
    ).select("lang", "k5", F.col("next_b").alias("b"), "src_raw")
    # a key-bucket has one first row: joined by the window's own columns, these
    # texts are not dealt out again
    firsts = loc.where(F.col("src_raw").isNull()).select("lang", "k5", "b", "doc_id", "text")
    boundary = firsts.join(carried, ["lang", "k5", "b"]).select(
        F.col("doc_id").alias("pair_id"), "lang", "src_raw", F.col("text").alias("tgt_raw")
    )
    return body.unionByName(boundary)


def with_word_stats(pairs: DataFrame) -> DataFrame:
    """C1/C2 on both sides: word lists and counts, plus the longer length.
    Each text is split exactly once, whatever filters follow."""
    p = computed_once(pairs, s=words("src_raw"), t=words("tgt_raw"))
    return (
        p.withColumn("n_src", word_count("s"))
        .withColumn("n_tgt", word_count("t"))
        .withColumn("n_max", F.greatest("n_src", "n_tgt"))
    )


def structural_filter(pairs: DataFrame, min_diff: int = 2, max_diff_ratio: float = 0.4) -> DataFrame:
    """keep pairs whose word-level edit distance is at least
    ``min_diff`` and at most ``max_diff_ratio`` of the longer side (both
    bounds inclusive).  A pair with a null or blank side is dropped (F2/S6).

    Cheap predicates run first: identical word lists (distance 0) and a
    length gap above the ratio (the gap is a lower bound on the distance)
    are rejected before any distance is computed, and the distance itself
    is thresholded so the DP only fills a band of width ~ratio*n."""
    p = with_word_stats(pairs).where((F.col("n_src") > 0) & (F.col("n_tgt") > 0))
    if min_diff > 0:
        p = p.where(F.col("s") != F.col("t"))
    p = p.where(F.abs(F.col("n_src") - F.col("n_tgt")) <= F.lit(max_diff_ratio) * F.col("n_max"))
    thr = F.floor(F.lit(max_diff_ratio) * F.col("n_max")).cast("int") + F.lit(1)
    p = word_edit_distance(p.withColumn("_thr", thr), "s", "t", out="_d", threshold=F.col("_thr")).drop("_thr")
    p = computed_once(p, dist=F.col("_d")).drop("_d")
    p = p.where(F.col("dist") >= 0).withColumn("ratio", change_ratio("dist", "n_src", "n_tgt"))
    return p.where((F.col("dist") >= min_diff) & (F.col("ratio") <= max_diff_ratio)).drop("s", "t", "n_max")


def structural_flags(pairs: DataFrame, min_diff: int = 2, max_diff_ratio: float = 0.4) -> DataFrame:
    """F1 as a column: every pair with ``kept``.  Only pairs that pass the
    cheap predicates hand their words to the distance."""
    p = with_word_stats(pairs)
    gap = F.abs(F.col("n_src") - F.col("n_tgt")) <= F.lit(max_diff_ratio) * F.col("n_max")
    cand = (F.col("n_src") > 0) & (F.col("n_tgt") > 0) & gap & ((F.col("s") != F.col("t")) | F.lit(min_diff <= 0))
    p = p.withColumns({"_s": F.when(cand, F.col("s")), "_t": F.when(cand, F.col("t"))}).drop("s", "t")
    thr = F.floor(F.lit(max_diff_ratio) * F.col("n_max")).cast("int") + F.lit(1)
    p = word_edit_distance(p.withColumn("_thr", thr), "_s", "_t", out="_d", threshold=F.col("_thr"))
    p = computed_once(p.drop("_s", "_t", "_thr"), dist=F.col("_d")).drop("_d")
    kept = (F.col("dist") >= max(min_diff, 0)) & (change_ratio("dist", "n_src", "n_tgt") <= max_diff_ratio)
    return p.withColumn("kept", F.coalesce(kept, F.lit(False))).select(*pairs.columns, "kept")


def edit_distances(pairs: DataFrame) -> DataFrame:
    """C3/C4 for every pair: exact distance and change ratio."""
    p = with_word_stats(pairs)
    p = word_edit_distance(p, "s", "t")
    return p.select(
        "pair_id", "n_src", "n_tgt", "dist", F.round(change_ratio("dist", "n_src", "n_tgt"), 6).alias("ratio")
    )


def labelled_texts(pairs: DataFrame) -> DataFrame:
    """Each pair becomes two text rows, biased source label 1 and
    neutral target label 0, in one pass (no union of two scans)."""
    return pairs.select(
        "pair_id", F.expr("stack(2, src_raw, 1, tgt_raw, 0) AS (text, label)")
    ).select("pair_id", "text", F.col("label").cast("int").alias("label"))
