import json
import os
import tempfile

from pyspark.sql import types as T
from pyspark.sql.functions import col as F_col

from pairloom.operators.logs import explode_log
from pairloom.sources import sinks
from pairloom.sources import text_tables as TT

PAIR_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ["id", "src_raw", "tgt_raw"]])


def tmpdir():
    return tempfile.mkdtemp(prefix="pairloom-io-")


def test_tolerant_tsv(spark):
    d = tmpdir()
    p = os.path.join(d, "raw.tsv")
    lines = [
        "\t".join(["1", "a", "b", "c", "d", "e", "f"]),  # exact width
        "\t".join(["2", "a", "b"]),  # short: padded
        "\t".join(["3"] + ["x"] * 7),  # over-wide: dropped
        '4\t"lone\tq\tr\ts\tt\tu',  # quote is an ordinary character
        "",  # blank: skipped
        "5\tNA\tnull\t\t\t\t",
    ]
    with open(p, "w") as f:
        f.write("\n".join(lines) + "\n")
    got = {r.id: r for r in TT.read_tsv(spark, p).collect()}
    assert set(got) == {"1", "2", "4", "5"}
    assert got["2"].tgt_tok == "b" and got["2"].src_raw is None
    assert got["4"].src_tok == '"lone'
    assert got["5"].src_tok == "NA"
    na = {r.id: r for r in TT.read_tsv(spark, p, na_values=["NA", "null", ""]).collect()}
    assert na["5"].src_tok is None and na["5"].tgt_tok is None and na["5"].src_raw is None


def test_csv_round_trip_and_bom(spark):
    d = tmpdir()
    rows = [("1", 'he said "hi", then\nleft', "中文，文本"), ("2", "", None)]
    df = spark.createDataFrame(rows, PAIR_SCHEMA)
    sinks.write_csv(df, os.path.join(d, "out"))
    back = {r.id: r for r in TT.read_csv(spark, os.path.join(d, "out"), PAIR_SCHEMA).collect()}
    assert back["1"].src_raw == rows[0][1] and back["1"].tgt_raw == rows[0][2]
    assert back["2"].src_raw is None and back["2"].tgt_raw is None  # empty and null both read back null
    sinks.write_report_csv(df, os.path.join(d, "rep"))
    with open(sinks.single_csv_path(os.path.join(d, "rep")), "rb") as f:
        assert f.read(3) == b"\xef\xbb\xbf"


def test_guarded_scan(spark):
    d = tmpdir()
    df, msg = TT.guarded_read_pairs(spark, os.path.join(d, "absent.csv"), PAIR_SCHEMA)
    assert df is None and "not found" in msg
    p = os.path.join(d, "nocol.csv")
    with open(p, "w") as f:
        f.write("id,src_raw\n1,a\n")
    df, msg = TT.guarded_read_pairs(spark, p, PAIR_SCHEMA)
    assert df is None and "tgt_raw" in msg
    p2 = os.path.join(d, "ok.csv")
    with open(p2, "w") as f:
        f.write("id,src_raw,tgt_raw\n1,a,b\n")
    df, msg = TT.guarded_read_pairs(spark, p2, PAIR_SCHEMA)
    assert msg == "ok" and df.count() == 1


def test_log_json_scan(spark):
    d = tmpdir()
    df, msg = TT.read_log_json(spark, os.path.join(d, "absent.json"))
    assert df is None and "not found" in msg
    bad = os.path.join(d, "bad.json")
    with open(bad, "w") as f:
        f.write("{not json")
    df, msg = TT.read_log_json(spark, bad)
    assert df is None and "not valid JSON" in msg
    empty = os.path.join(d, "empty.json")
    with open(empty, "w") as f:
        json.dump({"global_step": 1, "log_history": []}, f)
    df, msg = TT.read_log_json(spark, empty)
    assert df is None and "no entries" in msg
    good = os.path.join(d, "good.json")
    hist = [
        {"step": 10, "loss": 1.5, "learning_rate": 1e-5, "grad_norm": 2.0, "epoch": 0.1},
        {"loss": 1.2, "epoch": 0.2},  # no step: skipped
        {"step": 20, "loss": 1.1, "epoch": 0.3},  # no grad_norm / learning_rate: 0
        {"step": 25, "eval_loss": 0.9, "epoch": 0.3},  # eval only: skipped
    ]
    with open(good, "w") as f:
        json.dump({"global_step": 25, "log_history": hist}, f, indent=2)
    df, msg = TT.read_log_json(spark, good)
    assert msg == "ok"
    rows = sorted((r.step, r.loss, r.learning_rate, r.grad_norm) for r in explode_log(df.select("doc_id", df.columns and __import__("pyspark.sql.functions", fromlist=["struct"]).struct("global_step", "log_history").alias("doc"))).collect())
    assert rows == [(10, 1.5, 1e-5, 2.0), (20, 1.1, 0.0, 0.0)]


def test_union_ragged(spark):
    a = spark.createDataFrame([(1, 0.5)], "step long, loss double")
    b = spark.createDataFrame([(2, 0.4)], "step long, eval_loss double")
    got = sorted(sinks.union_ragged([a, b]).collect(), key=lambda r: r.step)
    assert got[0].eval_loss is None and got[1].loss is None


def test_read_splits_tags_files(spark):
    d = tmpdir()
    for name in ("train_x.csv", "val_x.csv", "test_x.csv"):
        with open(os.path.join(d, name), "w") as f:
            f.write(f"id,src_raw,tgt_raw\n{name},a,b\n")
    df = TT.read_splits(spark, d, {"train": "train_x.csv", "val": "val_x.csv"}, PAIR_SCHEMA)
    assert sorted(r.split for r in df.collect()) == ["train", "val"]


def test_csv_columns_bind_by_name(spark, tmp_path):
    from pyspark.sql import types as T

    from pairloom.sources.text_tables import read_csv

    (tmp_path / "a.csv").write_text('tgt_raw,extra,src_raw\n"neutral, text",x,biased\n', encoding="utf-8")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "src_raw", "tgt_raw")])
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "a.csv"), schema).collect()] == [(None, "biased", "neutral, text")]


def test_tsv_skips_lines_of_spaces(spark):
    from pairloom.sources.text_tables import parse_tsv_lines

    lines = spark.createDataFrame([("1\ta",), ("",), ("   ",), ("2\tb",)], "value string")
    assert parse_tsv_lines(lines, columns=["id", "t"]).count() == 2


def test_splits_are_one_scan_and_bind_by_header(spark, tmp_path):
    (tmp_path / "train x.csv").write_text('tgt_raw,src_raw,id\n"n ""1"", a",b1,1\n')
    (tmp_path / "val.csv").write_text("tgt_raw,src_raw,id\nn2,b2,2\n")
    (tmp_path / "other.csv").write_text("﻿id,src_raw,tgt_raw,more\n3,b3,n3,z\n", encoding="utf-8")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "short.csv").write_text("id,src_raw\n4,b4\n")
    names = {"train": "train x.csv", "val": "val.csv", "more": "other.csv", "none": "empty.csv", "gone": "absent.csv", "short": "short.csv"}
    need = ("src_raw", "tgt_raw")
    df = TT.read_splits(spark, str(tmp_path), names, PAIR_SCHEMA, need)
    assert sorted(map(tuple, df.collect())) == [("1", "b1", 'n "1", a', "train"), ("2", "b2", "n2", "val"), ("3", "b3", "n3", "more")]
    one = TT.read_splits(spark, str(tmp_path), {"train": "train x.csv", "val": "val.csv"}, PAIR_SCHEMA)
    assert one._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 1
    assert TT.split_status(spark, str(tmp_path), names, need) == {
        "train": "ok", "val": "ok", "more": "ok", "none": "empty", "gone": "missing", "short": "lacks tgt_raw"}
    assert TT.read_splits(spark, str(tmp_path), {"gone": "absent.csv"}, PAIR_SCHEMA).count() == 0


def test_one_bad_log_leaves_the_others(spark, tmp_path):
    good = {"global_step": 2, "log_history": [{"step": 1, "loss": 0.5}, {"step": 2, "eval_loss": 0.4}]}
    for name, text in {"good": json.dumps(good, indent=1), "bad": "{not json", "none": '{"log_history": []}', "blank": ""}.items():
        (tmp_path / f"{name}.json").write_text(text)
    docs, status = TT.read_logs(spark, {n: str(tmp_path / f"{n}.json") for n in ("good", "bad", "none", "blank", "gone")})
    assert {r.name: (r.status, r.entries) for r in status.collect()} == {
        "good": ("ok", 2), "bad": ("corrupt", 0), "none": ("empty", 0), "blank": ("empty", 0), "gone": ("missing", 0)}
    assert [(r.name, len(r.log_history)) for r in docs.collect()] == [("good", 2)]
    docs, status = TT.read_logs(spark, {"gone": str(tmp_path / "gone.json")})
    assert docs.count() == 0 and [r.status for r in status.collect()] == ["missing"]


def test_report_parts_each_begin_with_the_mark(spark, tmp_path):
    df = spark.range(0, 40, 1, 4).select(F_col("id").cast("string").alias("ID"))
    sinks.write_report_csv(df, str(tmp_path / "small"))
    assert len(list((tmp_path / "small").glob("part-*"))) == 1
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as many parts as partitions
    try:
        sinks.write_report_csv(df, str(tmp_path / "large"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    parts = list((tmp_path / "large").glob("part-*"))
    assert len(parts) > 1 and all(p.read_bytes().startswith(b"\xef\xbb\xbfID\n") for p in parts)


def test_outer_blanks_survive_csv(spark, tmp_path):
    df = spark.createDataFrame([("1", "  a ", "\tb\n")], PAIR_SCHEMA)
    sinks.write_csv(df, str(tmp_path / "o"))
    assert [tuple(r) for r in TT.read_csv(spark, str(tmp_path / "o"), PAIR_SCHEMA).collect()] == [("1", "  a ", "\tb\n")]
