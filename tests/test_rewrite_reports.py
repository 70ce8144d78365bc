import math
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from pairloom.operators import report as RP
from pairloom.operators import rewrite as R


def test_translate_and_passthrough(spark):
    d = spark.createDataFrame([("fr", "the", "le"), ("fr", "cat", "chat")], "lang string, pivot_word string, word string")
    df = spark.createDataFrame([(1, "fr", "the cat sat"), (2, "fr", "  "), (3, "fr", None)], "id long, lang string, t string")
    got = {r.id: r.o for r in R.translate(df, d, "id", "t", "lang", to_pivot=False, out="o").collect()}
    assert got == {1: "le chat sat", 2: "", 3: None}
    back = {r.id: r.o for r in R.translate(df.withColumn("t", F.lit("le chat")), d, "id", "t", "lang", True, "o").collect()}
    assert back[1] == "the cat"


def test_lexicon_learn_and_apply(spark):
    pairs = spark.createDataFrame(
        [("a very good x", "a good x"), ("very nice", "nice"), ("very b", "very b"), ("so very", "so")],
        "src_raw string, tgt_raw string",
    )
    lex = {r.word: (r.pairs_with_word, r.removed) for r in R.learn_lexicon(pairs).collect()}
    assert lex == {"very": (4, 3)}
    df = spark.createDataFrame([(1, "very very good"), (2, "very")], "id long, t string")
    got = {r.id: r.o for r in R.neutralize(df, R.learn_lexicon(pairs), "id", "t", "o").collect()}
    assert got == {1: "good", 2: ""}


def test_map_text_isolates_failures(spark):
    def Upper():
        def model(texts):
            if any(t == "boom" for t in texts):
                raise ValueError("bad row")
            return [t.upper() for t in texts]

        return model

    df = spark.createDataFrame([(i, "boom" if i == 3 else f"t{i}") for i in range(10)], "id long, t string").coalesce(1)
    got = {r.id: r.o for r in R.map_text(df, "t", "o", Upper, batch_size=4).collect()}
    assert got[3] == "Error" and got[2] == "T2" and got[0] == "T0"
    whole = {r.o for r in R.map_text(df, "t", "o", Upper, batch_size=4, fail_model=True).collect()}
    assert whole == {"Error"}


def test_map_text_factory_failure_and_short_output(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string").coalesce(1)

    def broken():
        raise RuntimeError("cannot load")

    assert {r.o for r in R.map_text(df, "t", "o", broken).collect()} == {"Error"}
    # a batch with too few outputs is a failure and is tried again row by row
    got = sorted(r.o for r in R.map_text(df, "t", "o", lambda: (lambda xs: xs[:1])).collect())
    assert got == ["a", "b"]
    assert {r.o for r in R.map_text(df, "t", "o", lambda: (lambda xs: [*xs, "more"])).collect()} == {"Error"}


def test_published_leaderboard_composites():
    # final metrics table rows 2-4 recomputed with the leaderboard formula
    for acc, sim, ppl, comp in [(0.72, 0.835, 36688.70, 0.025), (0.53, 0.950, 23755.12, 0.028), (0.62, 0.964, 25694.13, 0.029)]:
        assert round((acc * sim * (1 / ppl)) ** (1 / 3), 3) == comp


def test_composites_in_spark(spark):
    df = spark.createDataFrame([(0.72, 0.835, 36688.70), (0.5, 0.5, 0.0), (0.0, 0.9, 10.0)], "a double, s double, p double")
    got = [r.c for r in df.select(RP.leaderboard_composite(F.col("a"), F.col("s"), F.col("p")).alias("c")).collect()]
    assert round(got[0], 3) == 0.025
    assert math.isclose(got[1], (0.25 / 9999) ** (1 / 3))
    assert got[2] == 0.0


def test_budget_cross_check():
    # 905 few-shot rows -> 28 steps per epoch -> 22 epochs, as in the recorded log
    n = 905
    steps = n // 32
    assert steps == 28 and max(10, math.ceil(600 / max(1, steps))) == 22


def scores_frame(spark, rows):
    return spark.createDataFrame(
        rows, "id long, input string, gold string, model string, prediction string, style int, f1 double, ppl double"
    )


def test_leaderboard_drops_models_failing_first(spark):
    s = scores_frame(
        spark,
        [
            (0, "i", "g", "m1", "Error", 0, 0.0, 5.0),
            (1, "i", "g", "m1", "ok", 0, 1.0, 5.0),
            (0, "i", "g", "m2", "ok", 0, 1.0, 8.0),
            (1, "i", "g", "m2", "Error", 1, 0.5, float("nan")),
            (2, "i", "g", "m2", "  ", 0, 0.5, None),
        ],
    )
    b = {r.model: r for r in RP.leaderboard(s).collect()}
    assert set(b) == {"m2"}
    assert b["m2"].fluency_ppl == 8.0 and b["m2"].style_acc == pytest.approx(2 / 3)


def test_granular_failure_rules(spark):
    s = scores_frame(
        spark,
        [
            (0, "i", "g", "m1", "", 0, 0.9, 5.0),
            (0, "i", "g", "m2", "Error", 0, 0.9, 5.0),
            (0, "i", "g", "m3", "fine", 0, 0.9, 0.5),
            (0, "i", "g", "m4", "fine", 1, 0.9, 50.0),
        ],
    )
    cells = {r.model: r for r in RP.example_scores(s).collect()}
    assert cells["m1"].Output == "Error" and cells["m1"].Fluency == 99999.0 and cells["m1"].Composite is None
    assert cells["m2"].Style == 0 and cells["m2"].Content == 0.0
    assert cells["m3"].Style == 1 and cells["m3"].Composite == round((0.9 * 100) ** (1 / 3), 3)
    assert cells["m4"].Composite == 0.0
    wide = RP.granular_report(RP.example_scores(s), ["m1", "m2", "m3", "m4", "absent"])
    assert wide.columns[:4] == ["ID", "Original_Input", "Gold_Reference", "m1_Output"]
    assert "absent_Output" not in wide.columns or wide.first()["absent_Output"] is None


def test_inspection_pads_missing_predictions(spark):
    ex = spark.createDataFrame([(0, "i0", "g0"), (1, "i1", "g1")], "id long, input string, gold string")
    out = spark.createDataFrame([(0, "m1", "p")], "id long, model string, prediction string")
    rows = {r.ID: r for r in RP.inspection_wide(ex, out, ["m1", "m2"]).collect()}
    assert rows[0].Pred_m1 == "p" and rows[0].Pred_m2 == "" and rows[1].Pred_m1 == ""


def test_translate_two_columns_in_one_pass(spark):
    d = spark.createDataFrame([("fr", "the", "le"), ("fr", "cat", "chat")], "lang string, pivot_word string, word string")
    df = spark.createDataFrame(
        [(1, "fr", "the cat", "a cat"), (2, "fr", "", None), (3, "de", "the", "the")],
        "id long, lang string, s string, t string",
    )
    got = {r.id: (r.s2, r.t2, r.s) for r in R.translate(df, d, "id", {"s": "s2", "t": "t2"}, "lang", False).collect()}
    assert got == {1: ("le chat", "a chat", "the cat"), 2: ("", None, ""), 3: ("the", "the", "the")}


def test_sample_n_strict(spark):
    from pyspark.errors import PySparkException

    from pairloom.operators.splits import sample_n

    df = spark.range(5).withColumnRenamed("id", "pid")
    assert sample_n(df, 3, "pid", strict=True).count() == 3
    with pytest.raises(Exception) as e:
        sample_n(df, 10, "pid", strict=True).collect()
    assert "fewer than 10" in str(e.value) or isinstance(e.value, PySparkException)


def test_failing_and_custom_models_in_evaluation(spark):
    from conftest import SF01
    from pairloom.plans.corpus import Corpus
    from pairloom.plans.evaluation import Evaluation

    def broken(examples):
        raise RuntimeError("weights not found")

    def copy(examples):
        return R.map_text(examples, "input", "prediction", lambda: (lambda xs: list(xs)))

    ev = Evaluation(Corpus(spark, SF01), custom_models={"broken": broken, "copy": copy})
    assert ev.examples().count() > 0
    out = ev.outputs()
    preds = {(r.model, r.id): (r.prediction, r.input) for r in out.collect()}
    assert {p for (m, _), (p, _) in preds.items() if m == "broken"} == {"Error"}
    assert all(p == i for (m, _), (p, i) in preds.items() if m == "copy")
    board = {r.model for r in RP.leaderboard(ev.scores()).collect()}
    assert "broken" not in board and "copy" in board


def test_missing_judge_and_vectors_score_zero(spark):
    from conftest import SF01
    from pairloom.plans.corpus import Corpus
    from pairloom.plans.evaluation import Evaluation

    ev = Evaluation(Corpus(spark, SF01), with_judge=False, embeddings_table="absent_table")
    board = RP.leaderboard(ev.scores()).collect()
    assert board and all(r.style_acc == 0.0 and r.content_sim == 0.0 and r.composite == 0.0 for r in board)


def test_model_is_built_once_per_worker(spark, tmp_path):
    folder = str(tmp_path)

    def factory():
        import os
        import uuid

        open(os.path.join(folder, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
        return lambda xs: [x.upper() for x in xs]

    df = spark.range(640).selectExpr("id", "concat('t', id) AS t").repartition(32)
    got = {r.id: r.o for r in R.map_text(df, "t", "o", factory).collect()}
    assert got == {i: f"T{i}" for i in range(640)}
    workers = [name.split("-")[0] for name in os.listdir(folder)]
    assert len(workers) == len(set(workers)) < 32


def test_full_dictionary_equals_plain_ranks(spark):
    import random

    from pyspark.sql import Window

    rnd = random.Random(3)
    docs = spark.createDataFrame(
        [("en" if i % 3 else "fr", " ".join(f"w{min(rnd.randint(0, 80), rnd.randint(0, 80))}" for _ in range(20))) for i in range(120)]
        + [(None, "x y"), ("fr", None), ("en", "  ")],
        "lang string, text string",
    )
    order = [F.desc("n"), F.asc("word")]
    counts = docs.where("lang IS NOT NULL").selectExpr("lang", "explode(split(text, ' ')) AS word").where("word <> ''")
    counts = counts.groupBy("lang", "word").agg(F.count("*").alias("n"))
    exp = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    cols = ["lang", "word", "n", "rank"]
    assert sorted(R.word_ranks(docs).select(cols).collect()) == sorted(exp.select(cols).collect())
    top = exp.where("rank <= 7").select(cols)
    assert sorted(R.word_ranks(docs, 7).select(cols).collect()) == sorted(top.collect())


def test_evaluation_over_a_callers_tables(spark):
    from conftest import SF001
    from pairloom.plans.corpus import Corpus
    from pairloom.plans.evaluation import Evaluation

    gold = spark.createDataFrame(
        [(1, "fr", "le tres bon chat", "le chat"), (2, "fr", "un chien", "un chien")],
        "id long, lang string, input string, gold string",
    )

    def broken(examples):
        raise RuntimeError("no weights")

    def copy(examples):
        return examples.select("id", F.col("gold").alias("prediction"))

    ev = Evaluation(Corpus(spark, SF001), shipped=[], custom_models={"broken": broken, "copy": copy}, examples=gold)
    rows = {(r.model, r.id): r for r in ev.scores().collect()}
    assert set(rows) == {(m, i) for m in ("broken", "copy") for i in (1, 2)}
    assert rows["broken", 1].prediction == "Error" and rows["copy", 1].prediction == "le chat"
    assert [r.model for r in RP.leaderboard(ev.scores()).collect()] == ["copy"]


def test_spark_failures_of_a_model_surface(spark):
    from conftest import SF001
    from pairloom.plans.corpus import Corpus
    from pairloom.plans.evaluation import Evaluation

    gold = spark.createDataFrame([(1, "fr", "a", "b")], "id long, lang string, input string, gold string")
    bad = {"typo": lambda examples: examples.select("no_such_column")}
    with pytest.raises(AnalysisException):
        Evaluation(Corpus(spark, SF001), shipped=[], custom_models=bad, examples=gold).outputs()


def test_building_reports_runs_no_job(spark):
    """After ``prepare`` the reports are plans: jobs run at their action only."""
    from pairloom.plans.corpus import Corpus
    from pairloom.plans.evaluation import MODELS, Evaluation
    from tests.conftest import SF001

    ev = Evaluation(Corpus(spark, SF001)).prepare(scorers=True)
    sc = spark.sparkContext
    sc.setJobGroup("building", "no job expected")
    try:
        board = RP.leaderboard(ev.scores())
        cells = RP.granular_report(RP.example_scores(ev.scores()), MODELS)
        wide = RP.inspection_wide(ev.examples(), ev.outputs(), MODELS)
        assert list(sc.statusTracker().getJobIdsForGroup("building")) == []
        assert board.columns[0] == "model" and wide.columns[0] == "ID"
        cells.collect()
        assert len(sc.statusTracker().getJobIdsForGroup("building")) > 0
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
