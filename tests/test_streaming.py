import os
import tempfile

from pairloom.operators.pairs import structural_filter
from pairloom.sources.text_tables import read_tsv
from pairloom.streaming.curate import curate_stream


def test_curation_stream_equals_batch(spark):
    d = tempfile.mkdtemp(prefix="pairloom-stream-")
    src = os.path.join(d, "in")
    os.makedirs(src)
    rows = [
        ("1", "a b c d e", "a b c x y"),
        ("2", "a b c d e", "a b c d x"),
        ("3", "one two three four five six", "one two 3 four 5 six"),
    ]
    for i, r in enumerate(rows):
        with open(os.path.join(src, f"part{i}.tsv"), "w") as f:
            f.write("\t".join([r[0], "", "", r[1], r[2], "", ""]) + "\n")
    q = curate_stream(spark, src, os.path.join(d, "out"), os.path.join(d, "ckpt"))
    q.awaitTermination(120)
    got = sorted(r.pair_id for r in spark.read.parquet(os.path.join(d, "out")).collect())
    batch = read_tsv(spark, src).withColumnRenamed("id", "pair_id")
    assert got == sorted(r.pair_id for r in structural_filter(batch).collect()) == ["1", "3"]
