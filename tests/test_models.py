"""Kneser-Ney fluency and the iterative judge against plain forms."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import fluency_kn as KN
from pairloom.operators import judge as J
from pairloom.operators import learner as LE
from pairloom.operators import packed_counts as PC

TEXTS = ["the cat sat on the mat", "the cat ran", "a dog sat on the cat", "the dog ran on", "", None, "a cat", "the cat sat on the mat"]


@pytest.fixture(scope="module")
def model(spark):
    m = KN.train_kn(spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(3))
    table = {r.key: (r.p, r.g) for r in m.ngrams.collect()}
    return m, table, spark.range(1).select(m.unknown).first()[0]


def test_probabilities_of_a_context_sum_to_one(model):
    _, table, unknown = model
    vocabulary = sorted({w for t in TEXTS if t for w in t.split()}) + ["</s>", "never"]
    for context in (["the", "cat"], ["on", "the"], ["never", "the"], ["cat", "never"], ["mat", "dog"], ["sat", "on"]):
        total = 0.0
        for w in vocabulary:
            logs = KN.log_probabilities([*context, w], table, unknown) if w != "</s>" else KN.log_probabilities(context, table, unknown)
            total += math.exp(logs[2])
        assert total == pytest.approx(1, abs=1e-12)


def test_perplexity_needs_only_the_texts_ngrams(spark, model):
    m, table, unknown = model
    rows = [(1, "the cat sat"), (2, "never seen words"), (3, " "), (4, None), (None, "a dog ran on the mat"), (5, "mat the"), (6, "word " * 3000)]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: r.ppl_kn for r in KN.perplexity_kn(df, m, "id").collect()}
    for i, t in rows:
        if not t or not t.split():
            assert got[i] is None
            continue
        logs = KN.log_probabilities(t.split(), table, unknown)
        assert got[i] == pytest.approx(math.exp(-sum(logs) / len(logs)))
    assert got[1] < got[2]


def test_empty_corpus_and_saved_model(spark, model, tmp_path):
    empty = KN.train_kn(spark.createDataFrame([], "text string"))
    df = spark.createDataFrame([(1, "any words")], "id long, text string")
    assert KN.perplexity_kn(df, empty, "id").first()["ppl_kn"] == 1.0
    model[0].write(str(tmp_path / "kn"))
    same = KN.KneserNey.read(spark, str(tmp_path / "kn"))
    assert KN.perplexity_kn(df, same, "id").collect() == KN.perplexity_kn(df, model[0], "id").collect()


def test_packed_sums_against_plain_ones(spark, monkeypatch):
    """Many chunks and buckets, odd words, an n-gram asked for; nothing is
    shuffled by row."""
    rnd = random.Random(2)
    words = ["a", "b", "é", "x" * 300, "日本", "\U0001f600", "'", "-"]
    rows = [(*rnd.choices(words, k=2), rnd.randint(0, 5)) for _ in range(900)]
    monkeypatch.setattr(PC, "CHUNK_GRAMS", 100)
    table = spark.createDataFrame(rows, "v string, w string, n long").repartition(3)
    exp = {}
    for v, w, n in rows:
        exp[v, w] = exp.get((v, w), 0) + n
    blocks = PC.packed_rows(table, "vw", ["n"], lambda v, w, n: ([v, w], [n, n * 0]), 7)
    out = PC.summed(blocks, "vw", ["n", "k"])
    assert {(r.v, r.w): (r.n, r.k) for r in out.collect()} == {x: (n, 0) for x, n in exp.items()}
    asked = spark.createDataFrame([("a", "é"), ("never", "a"), ("a", "é")], "v string, w string")
    more = PC.packed_rows(asked, "vw", [], lambda v, w: ([v, w], [np.zeros_like(v), np.ones_like(v)]), 7)
    got = sorted(map(tuple, PC.summed(blocks.unionAll(more), "vw", ["n", "_asked"], asked=True).collect()))
    assert got == [("a", "é", exp["a", "é"]), ("never", "a", 0)]
    # more words than three places of 63 bits hold
    codes = [np.array([5, 1, 5]), np.array([2, 2, 2]), np.array([9, 8, 9])]
    for size in (10, 1 << 22):
        c, [n] = PC._summed(codes, [np.array([1, 2, 3])], size)
        assert [x.tolist() for x in c] == [[1, 5], [2, 2], [8, 9]] and n.tolist() == [2, 4]


def test_counts_are_shuffled_packed_and_deleted_when_read(spark):
    from pairloom.session import ensure_checkpoint_dir

    folder = ensure_checkpoint_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    m = KN.train_kn(spark.createDataFrame([(t,) for t in TEXTS], "text string"))
    df = spark.createDataFrame([(1, "the cat sat"), (1, "the dog"), (2, None)], "id long, text string")
    kept = sorted(KN.perplexity_kn(df, m, "id").collect())
    out = KN.perplexity_kn(df, m, "id", last=True)
    assert sorted(n.split("-")[2 if n.startswith("pairloom-kn-") else 1] for n in set(os.listdir(folder)) - before) == ["lp", "lp"]
    assert [r.ppl_kn for r in sorted(out.collect())] == pytest.approx([r.ppl_kn for r in kept])
    assert kept[0].ppl_kn == kept[1].ppl_kn and kept[2].ppl_kn is None  # rows of one id are one text


def plain_epochs(rows, epochs, rate, dim, places):
    w, b, history = np.zeros(dim), 0.0, []
    x = np.zeros((len(rows), dim))
    for i, (t, _, _) in enumerate(rows):
        for word in t.split():
            x[i, places[word]] += 1 / len(t.split())
    y, val = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows])
    for _ in range(epochs + 1):
        z = x @ w + b
        loss = np.log1p(np.exp(np.where(y == 1, -z, z)))
        history.append((loss[~val].mean(), loss[val].mean(), ((z > 0) == (y == 1))[val].mean()))
        d = (1 / (1 + np.exp(-z)) - y)[~val]
        w, b = w - rate * (d[:, None] * x[~val]).mean(0), b - rate * d.mean()
    return history


def test_epochs_against_plain_gradient_descent(spark):
    rows = [("awful bad biased claim", 1, False), ("plain fact stated", 0, False), ("bad bad claim", 1, True), ("fact stated plain", 0, True),
            ("claim", 1, False), ("fact", 0, False), ("", 0, False), ("awful", 1, True)]
    df = spark.createDataFrame(rows, "text string, label int, held boolean").repartition(3)
    words = sorted({w for t, _, _ in rows for w in t.split()})
    found = LE.features(spark.createDataFrame([(w,) for w in words], "text string"), ["text"], dim=64).collect()
    exp = plain_epochs(rows, 4, 2.0, 64, {r.text: r.f[0] for r in found})
    judge, history = LE.train_linear(df, F.col("held"), epochs=4, rate=2.0, dim=64)
    assert [h["epoch"] for h in history] == [0, 1, 2, 3, 4]
    for h, e in zip(history, exp):
        assert (h["train_loss"], h["val_loss"], h["val_accuracy"]) == pytest.approx(e)
    assert history[-1]["val_loss"] < history[0]["val_loss"] == pytest.approx(math.log(2))
    scored = {r.text: r.style for r in judge.score(df, ["text", "label"]).collect()}
    assert scored["bad bad claim"] == 1 and scored["fact stated plain"] == 0


def test_learner_without_rows(spark):
    none = spark.createDataFrame([], "text string, label int, held boolean")
    judge, history = LE.train_linear(none, F.col("held"), epochs=2, dim=16)
    assert history[-1] == {"epoch": 2, "train_loss": None, "val_loss": None, "val_accuracy": None} and not judge.weights.any()
    dirty = spark.createDataFrame([(None, 1, False), ("a", None, False), ("a b", 1, None)], "text string, label int, held boolean")
    _, history = LE.train_linear(dirty, F.col("held"), epochs=1, dim=16)
    assert history[1]["train_loss"] < history[0]["train_loss"] and history[1]["val_loss"] is None


@pytest.mark.parametrize("labels,expected", [([0, 0], 0), ([1, 1], 1), ([], 0)])
def test_judge_of_one_class(spark, labels, expected):
    rows = [("one two", y) for y in labels]
    m = J.train_judge(spark.createDataFrame(rows, "text string, label int"))
    df = spark.createDataFrame([(1, "one"), (2, "unknown words"), (3, ""), (4, None)], "id long, text string")
    assert {r.style for r in J.score_judge(df, m, "id").collect()} == {expected}
