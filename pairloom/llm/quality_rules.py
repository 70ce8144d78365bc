"""Quality rules under weak supervision (operator 5, DataFrame functions only).

Rules over per-text counts vote good, vote bad or abstain; EM estimates how
far each can be trusted; the posterior probability of good replaces a filter
that every rule must pass.  Two hard rules stay (`base_failed`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm.common import BLANK_CLASS, slim, stored
from pairloom.llm.weak_labels import LabelModel, fit

WINDOW = 8
WORD = r"[^\x20\x09-\x0D]"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: production parameters of the voting rules: (share that is bad from, good up to)
SYMBOLS_PER_WORD = (0.10, 0.02)
DUP_LINE_SHARE = (0.50, 0.10)
REPEAT_SHARE = (0.30, 0.10)
UPPER_SHARE = (0.50, 0.20)   # of word characters
MEAN_WORD = (1.5, 20.0)      # characters: bad outside, else abstains
KEEP_FROM = 0.5


def _kept_chars(text: Column, drop: str) -> Column:
    return F.length(F.regexp_replace(text, drop, "")).cast("long")


def text_counts(docs: DataFrame, *carry: str) -> DataFrame:
    """Exact counts per (doc_id, text) row, with the columns to carry along; linear in the text's length but
    for a sort of the texts in which some window repeats."""
    t = F.col("text")
    # each step is a projection of its own: arrays are made once, never inlined
    a = docs.select(
        "doc_id", *carry,
        F.filter(F.split(t, BLANK_CLASS + "+"), lambda w: w != "").alias("words"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)).alias("lines"),
        _kept_chars(t, "[^#*$%&|<>]+").alias("n_symbols"),
        _kept_chars(t, r"[^\p{Lu}]+").alias("n_upper"))
    a = a.select("doc_id", *carry, "n_symbols", "n_upper",
                 F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
                 F.size("words").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"),
                 (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                 F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    windows = F.transform(
        F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int")),
        lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(WINDOW)]))
    a = a.withColumn("w", F.when(F.col("n_words") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>"))).drop("h")
    a = a.withColumn("repeats", F.size(F.array_distinct("w")) < F.size("w"))
    # texts with a repeated window: (window, place) sorted, then the places of
    # windows equal to a neighbour, then the words they cover together
    ranked = F.array_sort(F.transform("w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    a = a.withColumn("s", F.when(F.col("repeats"), ranked)).drop("w")
    same = lambda x, k: F.coalesce(F.get("s", k)["h"] == x["h"], F.lit(False))
    twice = F.filter("s", lambda x, k: same(x, k - 1) | same(x, k + 1))
    a = a.withColumn("p", F.array_sort(F.transform(twice, lambda x: x["i"]))).drop("s")
    covered = F.aggregate("p", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
                          lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")),
                          lambda acc: acc["n"])
    # behind a generator, so that a filter on a count is not pushed below with
    # the whole computation inlined once per reference
    counts = F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines",
                      F.when(F.col("repeats"), covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
                      "n_upper", "n_lines")
    return a.select("doc_id", *carry, F.inline(F.array(counts)))


def votes() -> dict[str, Column]:
    """The voting rules over the counts: 1 good, 0 bad, null abstains."""
    c = F.col
    per_word = F.try_divide(c("n_symbols"), c("n_words"))
    dup = F.try_divide(c("n_dup_lines"), c("n_lines"))
    rep = F.try_divide(c("n_repeat_words"), c("n_words"))
    upper = F.try_divide(c("n_upper"), c("word_chars"))
    mean = F.try_divide(c("word_chars"), c("n_words"))

    def low(x, bad, good):
        return F.when(x >= bad, 0).when(x <= good, 1)

    return {
        "v_symbols": low(per_word, *SYMBOLS_PER_WORD),
        "v_dup_lines": low(dup, *DUP_LINE_SHARE),
        "v_repeats": low(rep, *REPEAT_SHARE),
        "v_upper": low(upper, *UPPER_SHARE),
        "v_word_length": F.when((mean < MEAN_WORD[0]) | (mean > MEAN_WORD[1]), 0),
    }


def base_failed() -> Column:
    c = F.col
    return (c("n_words") < 20) | (100 * c("n_repeat_words") > 30 * c("n_words"))


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  keep_from: float = KEEP_FROM, model: LabelModel | None = None) -> DataFrame:
    """One row per input row: doc_id, the counts, base_failed, p_good, kept.

    kept is false where base_failed, else p_good >= keep_from.  The counts are
    written once to the shared folder: the fit and the result read them from
    there.  Null and empty texts have zero counts, fail the base rules and
    are not kept; a null id stays null; repeated rows are judged each; an
    empty table gives no rows; other columns are ignored."""
    rules = votes()
    counts = stored(text_counts(slim(df, id_col, text_col)), "quality").withColumns(rules)
    if model is None:
        model = fit(counts.where(~base_failed()), list(rules))
    return counts.select("doc_id", *COUNTS, base_failed().alias("base_failed"), model.posterior().alias("p_good"),
                         (~base_failed() & (model.posterior() >= keep_from)).alias("kept"))


def keep_good(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of ``df`` (all columns) that `quality_rules` keeps.  The counts
    are taken twice, for the fit and for the filter, so that no text is
    shuffled or stored."""
    rules = votes()
    model = fit(text_counts(slim(df, id_col, text_col)).withColumns(rules).where(~base_failed()), list(rules))
    rows = df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col], F.lit("")).alias("text"), F.struct(*[df[c] for c in df.columns]).alias("row_"))
    judged = text_counts(rows, "row_").withColumns(rules)
    return judged.where(~base_failed() & (model.posterior() >= keep_from)).select("row_.*")


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    return quality_rules(docs)
