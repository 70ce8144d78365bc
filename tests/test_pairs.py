from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF01
from pairloom.functions.text import words
from pairloom.operators.pairs import labelled_texts, revision_pairs, structural_filter


def plain_lag(docs):
    d = docs.withColumn("ws", words("text")).where(F.size("ws") >= 5).withColumn("k5", F.slice("ws", 1, 5))
    w = Window.partitionBy("lang", "k5").orderBy("doc_id")
    p = d.select(F.col("doc_id").alias("pair_id"), "lang", F.lag("text").over(w).alias("src_raw"), F.col("text").alias("tgt_raw"))
    return p.where(F.col("src_raw").isNotNull())


def test_bucketed_lag_equals_plain_lag(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text", "lang")
    expect = sorted(plain_lag(docs).collect())
    for b in (1, 3, 64, 1 << 16):
        assert sorted(revision_pairs(docs, bucket_ids=b).collect()) == expect


def test_hot_key_split_across_buckets(spark):
    # one key holding every document: buckets of 2 ids, chain must be whole
    rows = [(i, "same five words here now " + str(i), "en") for i in range(0, 40, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.pair_id: r.src_raw for r in revision_pairs(docs, bucket_ids=2).collect()}
    ids = [r[0] for r in rows]
    assert got == {ids[i]: rows[i - 1][1] for i in range(1, len(ids))}


def test_structural_filter_edge_rows(spark):
    rows = [
        (1, "a b c d e", "a b c d x"),  # dist 1: drop
        (2, "a b c d e", "a b c x y"),  # dist 2, ratio exactly 0.4: keep
        (3, "a b c d e f g h i", "a b c d e f x y z w"),  # ratio 4/10 = 0.4 keep
        (4, "a b c d", "a b x y"),  # ratio 0.5: drop
        (5, None, "a b c"),  # null side: drop
        (6, "   ", "a b c"),  # blank side: drop
        (7, "a b c d e", "a b c d e"),  # identical: drop
    ]
    df = spark.createDataFrame(rows, "pair_id long, src_raw string, tgt_raw string")
    kept = {r.pair_id: (r.dist, r.ratio) for r in structural_filter(df).collect()}
    assert set(kept) == {2, 3}
    assert kept[2] == (2, 0.4)


def test_prefilters_do_not_change_result(spark):
    from test_words import lev

    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text", "lang")
    pairs = revision_pairs(docs).collect()
    expect = set()
    for p in pairs:
        s, t = p.src_raw.split(), p.tgt_raw.split()
        if not s or not t:
            continue
        d = lev(s, t)
        if d >= 2 and d / max(len(s), len(t)) <= 0.4:
            expect.add(p.pair_id)
    got = {r.pair_id for r in structural_filter(revision_pairs(docs)).collect()}
    assert got == expect


def test_labelled_texts_two_rows_per_pair(spark):
    df = spark.createDataFrame([(1, "s", "t")], "pair_id long, src_raw string, tgt_raw string")
    assert sorted(labelled_texts(df).collect()) == [(1, "s", 1), (1, "t", 0)]


def test_flags_agree_with_the_filter(spark):
    from pairloom.operators.pairs import structural_filter, structural_flags

    base = " ".join(f"w{i}" for i in range(20))
    texts = [base, base.replace("w3 ", "x "), base.replace("w3 w4", "x y"), "", None, "a b", base + " z" * 30, " ".join(reversed(base.split()))]
    rows = [(i * 10 + j, "en", a, b) for i, a in enumerate(texts) for j, b in enumerate(texts)]
    pairs = spark.createDataFrame(rows, "pair_id long, lang string, src_raw string, tgt_raw string")
    for args in ((2, 0.4), (0, 1.0), (1, 0.05)):
        kept = {r.pair_id for r in structural_filter(pairs, *args).collect()}
        flags = {r.pair_id: r.kept for r in structural_flags(pairs, *args).collect()}
        assert len(flags) == len(rows) and {k for k, v in flags.items() if v} == kept
