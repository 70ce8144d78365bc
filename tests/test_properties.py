"""Property checks (hypothesis) on the split and sample contracts."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairloom.operators.splits import sample_frac, split_80_10_10, split_90_10


@settings(max_examples=12, deadline=None)
@given(n=st.integers(min_value=0, max_value=400), seed=st.integers(min_value=0, max_value=10**6))
def test_split_contract(spark, n, seed):
    df = spark.range(n).withColumnRenamed("id", "pid")
    three = {r.split: r.c for r in split_80_10_10(df, "pid", seed=seed).groupBy("split").agg(F.count("*").alias("c")).collect()}
    temp = (n + 4) // 5
    test = (temp + 1) // 2
    assert (three.get("train", 0), three.get("val", 0), three.get("test", 0)) == (n - temp, temp - test, test)
    two = {r.split: r.c for r in split_90_10(df, "pid", seed=seed).groupBy("split").agg(F.count("*").alias("c")).collect()}
    assert (two.get("train", 0), two.get("val", 0)) == (n - (n + 9) // 10, (n + 9) // 10)


@settings(max_examples=10, deadline=None)
@given(n=st.integers(min_value=0, max_value=500), frac=st.floats(min_value=0.0, max_value=1.0))
def test_sample_fraction_is_exact(spark, n, frac):
    df = spark.range(n).withColumnRenamed("id", "pid")
    k = round(frac * n)  # Python rounds half to even, as the reference's sampler does
    assert sample_frac(df, frac, "pid").count() == k
