"""Results do not depend on the number of shuffle partitions."""

from conftest import SF001

import __spark_entry__ as E


def test_partition_count_invariance(spark):
    qs = E.queries()
    names = ["structural_filter", "split_80_10_10", "sample_frac", "judge_model", "content_f1", "leaderboard"]
    before = {n: sorted(map(tuple, qs[n](spark, SF001).collect())) for n in names}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        after = {n: sorted(map(tuple, qs[n](spark, SF001).collect())) for n in names}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    for n in names:
        assert before[n] == after[n], n
