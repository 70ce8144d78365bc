"""The scale mechanisms give the same answer as the plain formulation."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from pairloom.functions.text import first_words, words
from pairloom.operators.logs import curve_or_message, parse_log
from pairloom.operators.rewrite import top_k_per_group


def test_salted_top_k_equals_plain_window(spark):
    rnd = random.Random(5)
    rows = [("hot" if rnd.random() < 0.7 else f"g{rnd.randint(0, 4)}", f"w{i}", rnd.randint(0, 20)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, word string, n long")
    order = [F.desc("n"), F.asc("word")]
    for k, salts in ((1, 8), (7, 4), (50, 16)):
        got = sorted(top_k_per_group(df, ["g"], order, k, "word", salts=salts).select("g", "word", "rank").collect())
        w = Window.partitionBy("g").orderBy(*order)
        exp = sorted(df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("g", "word", "rank").collect())
        assert got == exp


def test_first_words_equals_full_split(spark):
    rnd = random.Random(9)
    spaces = [" ", "\t", "\n", " ", "　", " ", "\x1c", "\x85", "  "]
    texts = []
    for _ in range(300):
        parts = [rnd.choice(spaces) if rnd.random() < 0.3 else ""]
        for _ in range(rnd.randint(0, 8)):
            parts.append(rnd.choice(["a", "bb", "é", "中文", "x-y", "'q'"]))
            parts.append("".join(rnd.choice(spaces) for _ in range(rnd.randint(1, 2))))
        texts.append("".join(parts))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", first_words("t", 5).alias("k"), F.slice(words("t"), 1, 5).alias("s"), F.size(words("t")).alias("n")).collect():
        assert r.k == (r.s if r.n >= 5 else None), repr(r.t)


def test_log_without_usable_steps(spark):
    doc = '{"global_step": 3, "log_history": [{"eval_loss": 0.5, "step": 3}, {"loss": 1.0}]}'
    parsed = parse_log(spark.createDataFrame([(0, doc)], "doc_id long, json string"))
    curve, msg = curve_or_message(parsed)
    assert curve is None and "no training step" in msg
    good = '{"global_step": 3, "log_history": [{"loss": 1.0, "step": 2}, {"loss": 0.5, "step": 1}]}'
    curve, msg = curve_or_message(parse_log(spark.createDataFrame([(0, good)], "doc_id long, json string")))
    assert msg == "ok" and [r.step for r in curve.collect()] == [1, 2]
