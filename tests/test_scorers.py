import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import content as C
from pairloom.operators import encode as EN
from pairloom.operators import fluency as FL
from pairloom.operators import judge as J


@pytest.fixture(scope="module")
def emb(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)], 0) for i in range(5)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_content_f1_rules(spark, emb):
    df = spark.createDataFrame(
        [(1, "a b c", "a b c"), (2, "", "a b"), (3, "a a a b", "a b"), (4, None, "a")],
        "id long, cand string, ref string",
    )
    got = {r.id: r for r in C.content_f1(df, emb, "id", "cand", "ref").collect()}
    assert got[1].f1 == pytest.approx(1.0)  # identical texts
    assert got[2].f1 == 0.0 and got[4].f1 == 0.0  # empty or missing candidate
    assert got[3].f1 == pytest.approx(1.0)  # repeated words, same vectors


def test_content_f1_brute_force(spark, emb):
    import hashlib

    vecs = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in emb.collect()}
    unit = {k: v / np.linalg.norm(v) for k, v in vecs.items()}

    def vec(w):
        return unit[int(hashlib.md5(f"42:{w}".encode()).hexdigest()[:8], 16) % 5]

    def f1(c, r):
        cv, rv = [vec(w) for w in c.split()], [vec(w) for w in r.split()]
        p = np.mean([max(float(a @ b) for b in rv) for a in cv])
        q = np.mean([max(float(a @ b) for a in cv) for b in rv])
        return 2 * p * q / (p + q)

    rows = [(1, "the cat sat on the mat", "a cat is on a mat"), (2, "x y z", "z q")]
    df = spark.createDataFrame(rows, "id long, cand string, ref string")
    got = {r.id: r.f1 for r in C.content_f1(df, emb, "id", "cand", "ref").collect()}
    for i, c, r in rows:
        assert got[i] == pytest.approx(f1(c, r), abs=1e-9)


def test_fixed_length_encoding(spark):
    texts = {0: "", 1: "w", 127: " ".join(["w"] * 127), 128: " ".join(["w"] * 128), 129: " ".join(["w"] * 129)}
    pairs = spark.createDataFrame(
        [(n, texts[n], texts[n] + (" zz" if n else "zz")) for n in texts], "pair_id long, src_raw string, tgt_raw string"
    )
    vocab = spark.createDataFrame([("w", 2)], "word string, id int")
    got = {r.pair_id: r for r in EN.encode_pairs(pairs, vocab, 128).collect()}
    for n, r in got.items():
        k = min(n, 128)
        assert len(r.input_ids) == len(r.attention_mask) == len(r.labels) == 128
        assert r.input_ids == [2] * k + [0] * (128 - k)
        assert r.attention_mask == [1] * k + [0] * (128 - k)
        kt = min(n + 1, 128)
        assert r.labels[:kt] == ([2] * min(n, 128) + [EN.UNK])[:kt]  # unknown word -> 1
        assert r.labels[kt:] == [EN.IGNORE] * (128 - kt)


def test_perplexity_rules(spark):
    corpus = spark.createDataFrame([("a b",), ("a c",)], "text string")
    lm = FL.train_bigram(corpus)
    texts = spark.createDataFrame([(1, "a b", "r"), (2, "   ", "r"), (3, "", "s")], "id long, text string, g string")
    got = {r.id: r.ppl for r in FL.perplexity(texts, lm, "id").collect()}
    assert got[2] is None and got[3] is None  # blank texts are skipped
    # V = {a, b, c, </s>}; c(<s>,a)=2, c(<s>)=2; c(a,b)=1, c(a)=2; c(b,</s>)=1, c(b)=1
    expect = math.exp(-(math.log(3 / 6) + math.log(2 / 6) + math.log(2 / 5)) / 3)
    assert got[1] == pytest.approx(expect)
    means = {r.g: r.ppl_mean for r in FL.mean_perplexity(FL.perplexity(texts, lm, "id"), ["g"]).collect()}
    assert means["r"] == pytest.approx(expect) and means["s"] == float("inf")
    nan = spark.createDataFrame([("r", float("nan")), ("r", 4.0)], "g string, ppl double")
    assert FL.mean_perplexity(nan, ["g"]).first().ppl_mean == 4.0


def test_judge_ties_go_to_neutral(spark):
    labelled = spark.createDataFrame([("good", 0), ("bad", 1)], "text string, label int")
    m = J.train_judge(labelled)
    texts = spark.createDataFrame([(1, "bad bad"), (2, "good"), (3, "unknown")], "id long, text string")
    got = {r.id: r.style for r in J.score_judge(texts, m, "id").collect()}
    assert got == {1: 1, 2: 0, 3: 0}


def test_content_needs_no_broadcast(spark, emb):
    """Null, zero and repeated vectors; the same with broadcasts on and off."""
    dirty = emb.select("vec_id", "embedding").union(spark.createDataFrame(
        [(1, None), (2, [0.0] * 8), (3, [9.0] * 8), (None, [1.0] * 8)], "vec_id long, embedding array<float>"))
    rows = [(1, "the cat sat on the mat", "a cat is on a mat", 7.0), (2, "x y z", "z q", 7.0), (3, "", "a", 7.0)]
    df = spark.createDataFrame(rows, "id long, cand string, ref string, f1 double")
    run = lambda: sorted(C.content_f1(df, dirty, "id", "cand", "ref").select("id", "p", "r", "f1").collect())
    with_broadcast = run()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        without = run()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [r.id for r in without] == [1, 2, 3] and without[2].f1 == 0.0
    for a, b in zip(with_broadcast, without):
        assert list(a) == pytest.approx(list(b), abs=1e-12)


def test_models_round_trip(spark):
    import tempfile

    d = tempfile.mkdtemp(prefix="pairloom-model-")
    corpus = spark.createDataFrame([("a b",), ("a c",)], "text string")
    texts = spark.createDataFrame([(1, "a b c"), (2, "c a")], "id long, text string")
    lm = FL.train_bigram(corpus)
    lm.write(f"{d}/lm")
    same = FL.BigramModel.read(spark, f"{d}/lm")
    a = sorted(FL.perplexity(texts, lm, "id").collect())
    b = sorted(FL.perplexity(texts, same, "id").collect())
    assert a == b
    labelled = spark.createDataFrame([("good", 0), ("bad", 1), ("bad news", 1)], "text string, label int")
    m = J.train_judge(labelled)
    m.write(f"{d}/judge")
    m2 = J.JudgeModel.read(spark, f"{d}/judge")
    assert sorted(J.score_judge(texts, m, "id").collect()) == sorted(J.score_judge(texts, m2, "id").collect())
