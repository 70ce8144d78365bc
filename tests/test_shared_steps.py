"""Steps that several queries share do their work once."""

import os

from pyspark.sql import functions as F

from pairloom.operators import content as C
from pairloom.operators import edits as ED
from pairloom.operators import fluency as FL
from pairloom.operators import fluency_kn as KN
from pairloom.operators import pairs as P
from pairloom.operators import rewrite as R
from pairloom.operators import splits as S
from pairloom.session import ensure_checkpoint_dir


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def executed(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_texts_of_buckets_are_not_dealt_out_again(spark):
    rows = [(i, "en", f"one two three four five {i}") for i in (1, 2, 5, 9, 9, 12)] + [(3, "en", "six seven eight nine ten x")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    pairs = P.revision_pairs(df, bucket_ids=4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        got = sorted((r.pair_id, r.src_raw.split()[-1], r.tgt_raw.split()[-1]) for r in pairs.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "hashpartitioning(doc_id" not in plan and "hashpartitioning(lang" in plan
    assert got == [(2, "1", "2"), (5, "2", "5"), (9, "5", "9"), (9, "9", "9"), (12, "9", "12")]


def test_kneser_ney_writes_its_counts_only(spark):
    folder = ensure_checkpoint_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    m = KN.train_kn(spark.createDataFrame([("a b a b",), ("a b",), (None,)], "text string"))
    written = sorted(n.split("-")[1] for n in set(os.listdir(folder)) - before if n.startswith("pairloom-"))
    assert written == ["kn1", "kn2", "kn3"]
    got = {(r.v, r.w): (r.n, r.t, r.k) for r in m.two.collect()}
    # a b stands behind <s> and b, and is followed by a once and by the end twice
    assert got["a", "b"] == (2, 3, 2) and got["<s>", "<s>"] == (None, 2, 1)


def test_texts_meet_their_words_before_the_variants(spark):
    df = spark.createDataFrame([(1, "the cat"), (None, "the dog"), (2, None), (3, " ")], "id long, s string")
    d = spark.createDataFrame([("fr", "the", "le"), ("de", "the", "der"), ("de", "cat", "Katze")], "lang string, pivot_word string, word string")
    out = R.translate_to(df, d, "id", {"s": "t"}, "lang", ["de", "fr"])
    plan = optimized(out)
    assert "<=>" not in plan and plan.index("Generate inline") < plan.index("Join LeftOuter")
    got = {(r.id, r.lang): r.t for r in out.collect()}
    assert got == {(1, "de"): "der Katze", (1, "fr"): "le cat", (None, "de"): "der dog", (None, "fr"): "le dog",
                   (2, "de"): None, (2, "fr"): None, (3, "de"): "", (3, "fr"): ""}


def test_dropped_words_of_one_variant(spark):
    df = spark.createDataFrame([(1, "a b c")], "id long, s string")
    changes = spark.createDataFrame([("x", "a", None), ("y", "b", "B")], "model string, word string, to string")
    got = {r.model: r.t for r in R.rewrite_words(df, "id", {"s": "t"}, changes, (), {"model": ["x", "y", "z"]}).collect()}
    assert got == {"x": "b c", "y": "a B c", "z": "a b c"}


def test_lexicon_reads_its_pairs_once(spark):
    rows = [("a b a", "b"), ("a c", None), ("a", "a"), ("a b", ""), (None, "x")]
    lex = R.learn_lexicon(spark.createDataFrame(rows, "src_raw string, tgt_raw string"), min_support=1, min_rate=0.0)
    assert "Union" not in optimized(lex)
    assert {r.word: (r.pairs_with_word, r.removed) for r in lex.collect()} == {"a": (4, 2), "b": (2, 1), "c": (1, 0)}


def test_bigrams_split_each_text_once(spark):
    df = spark.createDataFrame([("a b",), (" ",), (None,)], "text string")
    rows = FL.bigram_rows(df, [])
    assert optimized(rows).count("split(") == 1
    assert sorted(tuple(r) for r in rows.collect()) == [("<s>", "a"), ("a", "b"), ("b", "</s>")]


def test_vocabulary_with_marks_as_words(spark):
    for texts in (["a b"], ["a <s> b"], ["</s> a"], ["<s> </s> <s>", "x"], ["", None]):
        m = FL.train_bigram(spark.createDataFrame([(t,) for t in texts], "text string"))
        assert spark.range(1).select(m.vocab).first()[0] == m.bigrams.select(F.countDistinct("w")).first()[0], texts


def test_word_counts_of_the_content_score_are_made_once(spark):
    emb = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(7)], "vec_id long, embedding array<float>")
    df = spark.createDataFrame([(i, f"w{i} a b", f"w{i} a c") for i in range(9)], "id long, c string, r string")
    assert "ReusedExchange" in executed(C.content_f1(df, emb, "id", "c", "r"))


def test_words_of_the_content_score_are_not_shuffled_by_row(spark):
    """Texts go to their group, no row per text and word; rows of one id are
    scored together, as are all without an id."""
    emb = spark.createDataFrame([(i, [float(i + 1), float(i * i), 1.0]) for i in range(50)], "vec_id long, embedding array<float>")
    df = spark.createDataFrame([(1, "a b", "c"), (1, "d", None), (None, "e f", "g"), (2, "a b d", "c"), (3, None, None)], "id long, c string, r string")
    out = C.content_f1(df, emb, "id", "c", "r", group_rows=1)
    assert "_side" not in optimized(out) and "ReusedExchange" in executed(out)
    got = {(r.id, r.c): r.f1 for r in out.collect()}
    assert len(got) == 5 and got[1, "a b"] == got[1, "d"] == got[2, "a b d"] > 0 and got[3, None] == 0
    one_group = {(r.id, r.c): r.f1 for r in C.content_f1(df, emb, "id", "c", "r").collect()}
    assert one_group == got


def test_places_of_phrases_are_counted_once(spark):
    rows = [("fr", "a b c", "a x c"), ("fr", "a b d", "a x d"), (None, "a b", "a x")]
    df = spark.createDataFrame(rows, "lang string, src_raw string, tgt_raw string")
    rules = ED.learn_rules(df, ["lang"], min_support=1)
    assert "ReusedExchange" in executed(rules)
    got = {(r.lang, r.left, r.phrase): (r.to, r.hits, r.places) for r in rules.collect()}
    assert got == {("fr", "a", "b"): ("x", 2, 2), ("fr", None, "b"): ("x", 2, 2)}


def test_scorers_read_the_outputs_not_each_other(spark):
    from pairloom.operators import judge as J
    from pairloom.operators import report as RP
    from pairloom.plans.corpus import Corpus
    from pairloom.plans.evaluation import Evaluation

    texts = spark.createDataFrame([(1, "a b", 1), (2, "a c c", 0)], "doc_id long, text string, label int")
    ex = spark.createDataFrame([(1, "fr", "a b", "a"), (2, "fr", "c", None), (None, "fr", " ", "b")], "id long, lang string, input string, gold string")
    vectors = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(5)], "vec_id long, embedding array<float>")
    ev = Evaluation(Corpus(spark, "/nowhere"), shipped=[], examples=ex, judge=J.train_judge(texts), fluency=FL.train_bigram(texts),
                    vectors=vectors, custom_models={"own": lambda e: e.select("id", F.col("input").alias("prediction"))})
    scores = ev.scores()
    for df in (RP.leaderboard(scores), RP.granular_report(RP.example_scores(scores), ["own"])):
        assert optimized(df).count("FlatMapCoGroupsInPandas") == 1
    got = {r.id: r for r in scores.collect()}
    assert (got[1].style, round(got[1].f1, 9), round(got[2].f1, 9), got[None].f1) == (1, 1.0, 1.0, 0.0)
    assert got[1].ppl > 1 and got[None].ppl is None


def test_words_of_a_block_meet_their_changes_once(spark):
    df = spark.createDataFrame([(i if i % 5 else None, "the cat" if i % 2 else "the dog", f"w{i}") for i in range(40)], "id long, s string, other string")
    changes = spark.createDataFrame([("the", "le"), ("dog", None)], "word string, to string")
    for chars in (1 << 22, 20):  # one block and many
        out = R.rewrite_words(df, "id", {"s": "t"}, changes, block_chars=chars)
        plan = optimized(out)
        assert "collect_list" not in plan and "FlatMapCoGroupsInArrow" in plan
        exp = sorted((f"w{i}", "le cat" if i % 2 else "le") for i in range(40))
        assert sorted((r.other, r.t) for r in out.collect()) == exp and out.columns == ["id", "s", "other", "t"]
    # texts of one id each go by their own words and languages
    twice = spark.createDataFrame([(1, "fr", "a b"), (1, "de", "a b"), (1, None, "a b")], "id long, lang string, s string")
    own = spark.createDataFrame([("fr", "a", "A"), ("de", "b", "B")], "lang string, word string, to string")
    got = {r.lang: r.t for r in R.rewrite_words(twice, "id", {"s": "t"}, own, ["lang"]).collect()}
    assert got == {"fr": "A b", "de": "a B", None: "a b"}


def test_a_sample_deals_out_the_last_bucket_only(spark):
    df = spark.createDataFrame([(i, "x" * 50) for i in range(500)], "id long, text string")
    got = S.sample_frac(df, 0.3, "id")
    exp = S.global_rank(df, "id").where("_rank < 150")
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in exp.collect()) and got.columns == ["id", "text"]
    plan = optimized(got)
    assert plan.index("Union") < plan.index("Window [row_number()")
    assert S.sample_frac(df, 0.0, "id").count() == 0 and S.sample_frac(df, 1.0, "id").count() == 500
    twice = spark.createDataFrame([(7, i) for i in range(10)], "id long, k long")  # one bucket
    assert S.sample_frac(twice, 0.3, "id").count() == 3
