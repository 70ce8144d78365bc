"""Registered queries: one callable (spark, sf_dir) -> DataFrame per
operator of the inventory.  Column names match ``oracle.ORACLE_SQL``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators import pairs as P
from pairloom.operators import splits as S
from pairloom.plans.corpus import Corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def revision_pairs(spark, sf_dir):
    return Corpus(spark, sf_dir).pairs()


@query
def word_stats(spark, sf_dir):
    p = P.with_word_stats(Corpus(spark, sf_dir).pairs())
    return p.select("pair_id", "lang", "n_src", "n_tgt", "n_max")


@query
def word_edit_distance(spark, sf_dir):
    return P.edit_distances(Corpus(spark, sf_dir).pairs())


@query
def structural_filter(spark, sf_dir):
    kept = P.structural_filter(Corpus(spark, sf_dir).pairs())
    return kept.select(
        "pair_id", "lang", "src_raw", "tgt_raw", "n_src", "n_tgt", "dist", F.round("ratio", 6).alias("ratio")
    )


@query
def split_80_10_10(spark, sf_dir):
    return Corpus(spark, sf_dir).split_pairs().select("pair_id", "split")


@query
def labelled_texts(spark, sf_dir):
    return P.labelled_texts(Corpus(spark, sf_dir).pairs())


@query
def judge_split(spark, sf_dir):
    lt = P.labelled_texts(Corpus(spark, sf_dir).pairs())
    return S.split_90_10(lt, ["pair_id", "label"]).select("pair_id", "label", "split")


@query
def judge_split_grouped(spark, sf_dir):
    """D2 with ``group_cols``: both sides of a pair in one split."""
    lt = P.labelled_texts(Corpus(spark, sf_dir).pairs())
    return S.split_90_10(lt, ["pair_id", "label"], group_cols=["pair_id"]).select("pair_id", "label", "split")


@query
def curated_split(spark, sf_dir):
    """F1 then D1: the splits of the pairs that the structural filter keeps."""
    kept = P.structural_filter(Corpus(spark, sf_dir).pairs())
    return S.split_80_10_10(kept.select("pair_id", "lang"), "pair_id").select("pair_id", "lang", "split")


@query
def dense_ids(spark, sf_dir):
    """X2 over all pairs."""
    return S.dense_ids(Corpus(spark, sf_dir).pairs(), "pair_id").select("pair_id", "ID")


@query
def sample_n(spark, sf_dir):
    return S.sample_n(Corpus(spark, sf_dir).pairs(), 100, "pair_id").select("pair_id", "lang")


@query
def sample_frac(spark, sf_dir):
    # 10% of the training pairs (1% is the API default; at small scale
    # factors 1% leaves too few rows to check anything)
    return S.sample_frac(Corpus(spark, sf_dir).train_pairs(), 0.1, "pair_id").select("pair_id", "lang")


@query
def stage_counts(spark, sf_dir):
    """A1: every count from one pass; what a pair passed travels with it."""
    c = Corpus(spark, sf_dir)
    flags = S.split_80_10_10(P.structural_flags(c.pairs()), "pair_id")
    counts = flags.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count(F.when(F.col("kept"), 1)).alias("kept"),
        *[F.count(F.when(F.col("split") == s, 1)).alias(s) for s in ("train", "val", "test")],
    )
    docs = c.documents().agg(F.count(F.lit(1)).alias("n")).select("n").scalar()  # from the files' footers
    stages = ["documents", *counts.columns]
    rows = counts.withColumn("documents", docs).select(F.expr(f"stack({len(stages)}, {', '.join(f"'{s}', `{s}`" for s in stages)}) AS (stage, n)"))
    # a split without rows has no count, as in a count by split
    return rows.where((F.col("n") > 0) | ~F.col("stage").isin("train", "val", "test")).select("stage", F.col("n").cast("bigint").alias("n"))


@query
def budget(spark, sf_dir):
    """C14 over the few-shot samples of the training pairs (1% and 10%)."""
    r = S.global_rank(Corpus(spark, sf_dir).train_pairs(), "pair_id")
    rows = []
    for frac in (0.01, 0.1):
        k = F.bround(F.lit(frac) * F.col("_n"), 0)
        rows.append(
            r.agg(F.sum(F.when(F.col("_rank") < k, 1).otherwise(0)).cast("bigint").alias("n")).select(
                F.lit(int(frac * 100)).alias("percent"), "n"
            )
        )
    df = rows[0].unionByName(rows[1])
    steps = F.floor(F.col("n") / F.lit(32))
    return df.select(
        "percent",
        "n",
        steps.cast("bigint").alias("steps_per_epoch"),
        F.greatest(F.lit(10), F.ceil(F.lit(600) / F.greatest(F.lit(1), steps))).cast("bigint").alias("epochs"),
    )


# ---- scoring: judge, fluency, content --------------------------------------

from pairloom.operators import content as C  # noqa: E402
from pairloom.operators import fluency as FL  # noqa: E402
from pairloom.operators import fluency_kn as KN  # noqa: E402
from pairloom.operators import judge as J  # noqa: E402
from pairloom.operators import learner as LE  # noqa: E402
from pairloom.plans.corpus import judge_training  # noqa: E402


def _conversations(c: Corpus) -> DataFrame:
    return c.t("conversations", "conv_id", "turn", "role", "text")


@query
def judge_model(spark, sf_dir):
    m = J.train_judge(judge_training(Corpus(spark, sf_dir)))
    return m.words.select("word", "c0", "c1", F.round("lp0", 6).alias("lp0"), F.round("lp1", 6).alias("lp1"))


@query
def style_judge(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    m = J.train_judge(judge_training(c))
    return J.score_judge(_conversations(c), m, ["conv_id", "turn"]).select("conv_id", "turn", "style")


@query
def judge_validation(spark, sf_dir):
    """U4 with D2: losses and accuracy of the iterative judge on both sides of
    the 90/10 split, epoch by epoch."""
    lt = P.labelled_texts(Corpus(spark, sf_dir).pairs())
    sides = S.split_90_10(lt, ["pair_id", "label"])
    _, history = LE.train_linear(sides, F.col("split") == "val", epochs=3, dim=1 << 10)
    found = spark.createDataFrame([tuple(h.values()) for h in history], "epoch int, train_loss double, val_loss double, val_accuracy double")
    return found.select("epoch", *[F.round(c, 6).alias(c) for c in found.columns[1:]])


@query
def style_accuracy(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    scored = J.score_judge(_conversations(c), J.train_judge(judge_training(c)), ["conv_id", "turn"])
    return J.style_accuracy(scored, ["role"]).select("role", F.round("style_acc", 6).alias("style_acc"))


@query
def fluency_ppl(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    lm = FL.train_bigram(c.documents())
    return FL.perplexity(_conversations(c), lm, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round("ppl", 4).alias("ppl")
    )


@query
def fluency_kn(spark, sf_dir):
    """U6 by interpolated Kneser-Ney of order 3."""
    c = Corpus(spark, sf_dir)
    out = KN.perplexity_kn(_conversations(c), KN.train_kn(c.documents()), ["conv_id", "turn"], last=True)
    return out.select("conv_id", "turn", F.round("ppl_kn", 4).alias("ppl_kn"))


@query
def fluency_mean(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    scored = FL.perplexity(_conversations(c), FL.train_bigram(c.documents()), ["conv_id", "turn"])
    return FL.mean_perplexity(scored, ["role"]).select("role", F.round("ppl_mean", 4).alias("ppl_mean"))


@query
def content_f1(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    out = C.content_f1(c.stored_pairs(), c.t("embeddings", "vec_id", "embedding"), "pair_id", "tgt_raw", "src_raw")
    return out.select("pair_id", *[F.round(x, 6).alias(x) for x in ("p", "r", "f1")])


def _dirty_vectors(emb):
    """Embeddings with null, zero and repeated vectors, by rule."""
    e = F.when(F.col("vec_id") % 7 == 0, F.lit(None)).when(
        F.col("vec_id") % 11 == 0, F.transform("embedding", lambda x: (x * 0).cast("float"))
    ).otherwise(F.col("embedding"))
    again = emb.where("vec_id % 5 = 0").select("vec_id", F.reverse("embedding").alias("embedding"))
    return emb.select("vec_id", e.alias("embedding")).unionByName(again)


@query
def content_f1_dirty(spark, sf_dir):
    """U7 over vectors that are partly null, zero or repeated."""
    c = Corpus(spark, sf_dir)
    out = C.content_f1(c.stored_pairs(), _dirty_vectors(c.t("embeddings", "vec_id", "embedding")), "pair_id", "tgt_raw", "src_raw")
    return out.select("pair_id", *[F.round(x, 6).alias(x) for x in ("p", "r", "f1")])


@query
def content_mean(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    out = C.content_f1(c.stored_pairs(), c.t("embeddings", "vec_id", "embedding"), "pair_id", "tgt_raw", "src_raw")
    return out.groupBy("lang").agg(F.round(F.avg("f1"), 6).alias("content_mean"))


# ---- rewriting and reports --------------------------------------------------

from pairloom.operators import edits as ED  # noqa: E402
from pairloom.operators import report as RP  # noqa: E402
from pairloom.operators import rewrite as R  # noqa: E402
from pairloom.plans.evaluation import MODELS, Evaluation  # noqa: E402


def _ev(spark, sf_dir) -> Evaluation:
    return Evaluation(Corpus(spark, sf_dir))


@query
def translation_dictionary(spark, sf_dir):
    return _ev(spark, sf_dir).dictionary()


@query
def translate_pairs(spark, sf_dir):
    return _ev(spark, sf_dir).synthetic_plan()  # read once: nothing to store


@query
def neutral_lexicon(spark, sf_dir):
    lex = _ev(spark, sf_dir).pivot_lexicon()
    return lex.select("word", "pairs_with_word", "removed", F.round("rate", 6).alias("rate"))


@query
def neutralize_zero_shot(spark, sf_dir):
    return _ev(spark, sf_dir).branch("zero_shot").select("id", "lang", "prediction")


@query
def neutralize_synthetic(spark, sf_dir):
    return _ev(spark, sf_dir).branch("synthetic").select("id", "lang", "prediction")


@query
def neutralize_few_shot(spark, sf_dir):
    return _ev(spark, sf_dir).branch("few_shot").select("id", "lang", "prediction")


@query
def neutralize_pivot(spark, sf_dir):
    return _ev(spark, sf_dir).branch("pivot").select("id", "lang", "prediction")


def _edit_training(c: Corpus) -> DataFrame:
    """F1 pairs of the training split."""
    pairs = c.stored_pairs()
    train = c.split_pairs().where("split = 'train'").select("pair_id")
    return P.structural_filter(pairs).join(train, "pair_id").select("pair_id", "lang", "src_raw", "tgt_raw")


def _edit_rules(c: Corpus) -> DataFrame:
    # one place is enough here: at small scale factors no edit occurs twice
    # the training pairs are read for their edits and for the phrases' places
    return ED.learn_rules(materialized(_edit_training(c), "edit-training"), ["lang"], min_support=1)


@query
def edit_ops(spark, sf_dir):
    """The aligned edits of every pair that F1 keeps."""
    ops = ED.edit_ops(P.structural_filter(Corpus(spark, sf_dir).pairs()))
    phrase = lambda c: F.array_join(c, " ").alias(c)
    return ops.select("pair_id", "idx", "pos", "kind", F.col("left").alias("left_word"), phrase("src"), phrase("tgt"))


@query
def edit_rules(spark, sf_dir):
    """Rules learned from the edits of the training pairs."""
    r = _edit_rules(Corpus(spark, sf_dir))
    return r.select("lang", F.col("left").alias("left_word"), "phrase", F.col("to").alias("becomes"), "hits", "places",
                    F.round("rate", 6).alias("rate"))


@query
def neutralize_rules(spark, sf_dir):
    """The sources of all pairs rewritten by the rules of their language."""
    c = Corpus(spark, sf_dir)
    rules = materialized(_edit_rules(c), "edit-rules")  # of known size when the join is planned
    collect_garbage(spark)
    out = ED.apply_rules(c.stored_pairs(), rules, "pair_id", "src_raw", "prediction", ["lang"])
    return out.select("pair_id", "lang", "prediction")


@query
def model_outputs(spark, sf_dir):
    return _ev(spark, sf_dir).outputs(materialize=False).select("id", "model", "prediction")


def _scores(spark, sf_dir):
    return _ev(spark, sf_dir).prepare(scorers=True).scores()


@query
def leaderboard(spark, sf_dir):
    b = RP.leaderboard(_scores(spark, sf_dir))
    return b.select(
        "model",
        F.round("style_acc", 6).alias("style_acc"),
        F.round("content_sim", 6).alias("content_sim"),
        F.round("fluency_ppl", 4).alias("fluency_ppl"),
        F.round("composite", 6).alias("composite"),
    )


@query
def leaderboard_display(spark, sf_dir):
    return RP.leaderboard_display(RP.leaderboard(_scores(spark, sf_dir)))


@query
def inspection_wide(spark, sf_dir):
    ev = _ev(spark, sf_dir)
    return RP.inspection_wide(ev.examples(), ev.prepare().outputs(), MODELS)


@query
def granular_report(spark, sf_dir):
    return RP.granular_report(RP.example_scores(_scores(spark, sf_dir)), MODELS)


@query
def qualitative_head(spark, sf_dir):
    """The first three examples (by id) with every model's output."""
    ev = _ev(spark, sf_dir)
    head = ev.examples().orderBy("id").limit(3).select("id")
    return ev.outputs().join(head, "id").select("id", "input", "model", "prediction")


@query
def worst_examples(spark, sf_dir):
    """The report sorted by composite, lowest (and failed) first: the
    ten worst (example, model) cells."""
    cells = RP.example_scores(_scores(spark, sf_dir))
    return (
        cells.orderBy(F.asc_nulls_first("Composite"), "id", "model")
        .limit(10)
        .select("id", "model", "Output", "Style", "Content", "Fluency", "Composite")
    )


def _byte_count_model():
    """A deterministic model that fails on some texts."""

    def model(texts):
        sizes = [len(t.encode()) for t in texts]
        if any(n % 5 == 0 for n in sizes):
            raise ValueError("a text of this length")
        return [str(n) for n in sizes]

    return model


@query
def map_text(spark, sf_dir):
    """U8: a caller's model over all conversation turns; the rows on which it
    raises become "Error"."""
    t = _conversations(Corpus(spark, sf_dir))
    return R.map_text(t, "text", "prediction", _byte_count_model).select("conv_id", "turn", "prediction")


# ---- gold set, encoding, losses, logs, raw scan ------------------------------

from pyspark.sql import Window  # noqa: E402

from pairloom.functions.text import hash_key  # noqa: E402
from pairloom.operators import encode as EN  # noqa: E402
from pairloom.operators import logs as LG  # noqa: E402
from pairloom.session import collect_garbage, ensure_checkpoint_dir, materialized  # noqa: E402
from pairloom.sources import sinks as SI  # noqa: E402
from pairloom.sources import text_tables as TT  # noqa: E402


@query
def gold_set(spark, sf_dir):
    """100 sampled pivot-language test pairs with dense ids,
    both sides translated into the target language, originals kept."""
    ev = _ev(spark, sf_dir)
    test = ev.split_pairs().where((F.col("split") == "test") & (F.col("lang") == "en"))
    s = S.sample_n(test, 100, "pair_id")
    s = s.withColumn("ID", F.row_number().over(Window.orderBy(hash_key("pair_id"), "pair_id")) - 1)
    x = s.select("ID", F.lit("fr").alias("lang"), F.col("src_raw").alias("English_Ref"), "src_raw", "tgt_raw")
    d = ev.dictionary()
    x = R.translate(x, d, "ID", {"src_raw": "Target_Biased", "tgt_raw": "Target_Neutral_Gold"}, "lang", False)
    return x.select(F.col("ID").cast("int").alias("ID"), "English_Ref", "Target_Biased", "Target_Neutral_Gold")


def _encoded(spark, sf_dir):
    train = Corpus(spark, sf_dir).train_pairs()
    vocab = EN.vocabulary(P.labelled_texts(train), 8000)
    return EN.encode_pairs(train, vocab, 128)


@query
def encode_fixed(spark, sf_dir):
    return _encoded(spark, sf_dir).select("pair_id", "input_ids", "attention_mask", "labels")


def _losses(spark, sf_dir):
    lm = FL.train_bigram(Corpus(spark, sf_dir).documents())
    return EN.token_losses(_encoded(spark, sf_dir), lm)


@query
def masked_loss(spark, sf_dir):
    return EN.masked_loss(_losses(spark, sf_dir)).select("pair_id", F.round("masked_loss", 6).alias("masked_loss"))


@query
def weighted_loss(spark, sf_dir):
    return EN.weighted_loss(_losses(spark, sf_dir)).select(
        "pair_id", F.round("weighted_loss", 6).alias("weighted_loss")
    )


def _events(spark, sf_dir):
    return Corpus(spark, sf_dir).t("events", "event_id", "event_type", "value", "props")


@query
def log_explode(spark, sf_dir):
    docs = LG.log_documents(_events(spark, sf_dir))
    return LG.explode_log(LG.parse_log(docs))


@query
def log_union(spark, sf_dir):
    t = LG.log_table(_events(spark, sf_dir))
    return t.withColumn("train_loss", F.round("train_loss", 6))


@query
def tsv_scan(spark, sf_dir):
    """S1 over the lines of every document."""
    return TT.parse_tsv_lines(TT.text_lines(Corpus(spark, sf_dir).documents()))


@query
def csv_round_trip(spark, sf_dir):
    """K1 and S3: all pairs written as CSV, with quotes, line breaks and outer
    blanks in the fields and the columns in another order, read back by name;
    the raw layout's other columns are absent, hence null."""
    import uuid

    from pyspark.sql import types as T

    c = Corpus(spark, sf_dir)
    odd = lambda t: F.concat(F.lit(' "'), F.col(t), F.lit('",\n\t"" ')).alias(t)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pairloom-csv-{uuid.uuid4().hex}"
    SI.write_csv(c.pairs().select(odd("tgt_raw"), F.lit("x").alias("extra"), odd("src_raw"), F.col("pair_id").alias("id")), path)
    table, message = TT.guarded_read_pairs(spark, path, T.StructType([T.StructField(n, T.StringType()) for n in TT.RAW_COLUMNS]))
    if table is None:
        raise RuntimeError(message)
    return table


@query
def file_status(spark, sf_dir):
    """The log documents written as one file each, some of them
    spoiled by rule, read in one scan; how each file fared, and the training
    steps of the good ones."""
    import uuid

    c = Corpus(spark, sf_dir)
    docs = LG.log_documents(_events(spark, sf_dir)).repartition("doc_id")
    k = F.col("doc_id") % 7
    spoiled = F.when(k == 1, F.lit("{not json")).when(k == 2, F.lit('{"global_step": 1, "log_history": []}')).otherwise(F.col("json"))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pairloom-logs-{uuid.uuid4().hex}"
    docs.where(k != 3).select("doc_id", spoiled.alias("value")).write.partitionBy("doc_id").text(path)
    # one name per log file, as a caller has them
    names = [r[0] for r in c.t("events", "event_id").select(F.floor(F.col("event_id") / 1024)).distinct().collect()]
    good, status = TT.read_logs(spark, {str(n): f"{path}/doc_id={n}" for n in names})
    steps = LG.explode_log(good.select("name", F.struct("global_step", "log_history").alias("doc")), ["name"])
    steps = steps.groupBy("name").agg(F.count(F.lit(1)).alias("steps"))
    out = status.join(steps, "name", "left")
    return out.select(F.col("name").cast("bigint").alias("doc_id"), "status", "entries", F.coalesce("steps", F.lit(0)).cast("bigint").alias("steps"))
