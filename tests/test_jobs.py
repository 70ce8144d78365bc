import os
import tempfile

from pyspark.sql import types as T

from pairloom.plans.jobs import curate_corpus, percent_name
from pairloom.sources.text_tables import RAW_COLUMNS, read_csv


def test_curate_corpus_end_to_end(spark):
    d = tempfile.mkdtemp(prefix="pairloom-job-")
    raw = os.path.join(d, "raw.tsv")
    with open(raw, "w") as f:
        for i in range(40):
            src = f"w{i} a b c d e"
            tgt = f"w{i} a b x y e" if i % 2 else f"w{i} a b c d e"
            f.write("\t".join([str(i), "", "", src, tgt, "", ""]) + "\n")
    counts = curate_corpus(spark, raw, os.path.join(d, "out"))
    assert counts["loaded"] == 40
    assert (counts["train"], counts["val"], counts["test"]) == (16, 2, 2)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])
    back = read_csv(spark, os.path.join(d, "out", "split=train"), schema)
    assert back.count() == 16 and back.where("src_raw like 'w%'").count() == 16


def test_percent_name():
    assert percent_name(0.01) == "train_1percent" and percent_name(0.1) == "train_10percent"


def test_synthesize_files_skips_missing(spark):
    from pairloom.plans.jobs import synthesize_files

    d = tempfile.mkdtemp(prefix="pairloom-syn-")
    with open(os.path.join(d, "train_complex.csv"), "w") as f:
        f.write(",".join(RAW_COLUMNS) + "\n")
        f.write("1,,,the cat,a cat,,\n")
    dic = spark.createDataFrame([("fr", "the", "le"), ("fr", "cat", "chat")], "lang string, pivot_word string, word string")
    rep = synthesize_files(spark, d, os.path.join(d, "out"), dic, "fr")
    assert rep["train_complex.csv"] == "ok" and "not found" in rep["val_complex.csv"]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ["src_raw", "tgt_raw", "src_en_original", "tgt_en_original"]])
    rows = read_csv(spark, os.path.join(d, "out", "train_synthetic"), schema).collect()
    assert [(r.src_raw, r.tgt_raw, r.src_en_original) for r in rows] == [("le chat", "a chat", "the cat")]


def test_evaluate_and_report_writes_three_reports(spark):
    from conftest import SF01
    from pairloom.plans.corpus import Corpus
    from pairloom.plans.evaluation import MODELS, Evaluation
    from pairloom.plans.jobs import evaluate_and_report
    from pairloom.sources.sinks import single_csv_path

    d = tempfile.mkdtemp(prefix="pairloom-rep-")
    board = evaluate_and_report(Evaluation(Corpus(spark, SF01)), d, MODELS)
    assert board.count() >= 1
    for name in ("manual_inspection", "granular_inspection"):
        with open(single_csv_path(os.path.join(d, name)), "rb") as f:
            assert f.read(3) == b"\xef\xbb\xbf"
    with open(single_csv_path(os.path.join(d, "final_metrics_table")), encoding="utf-8") as f:
        assert f.readline().startswith("Model,Style Acc")


def test_synthesize_keeps_every_row(spark):
    """Repeated and missing ids, reordered headers: n rows in, n rows out."""
    from collections import Counter

    from pairloom.plans.jobs import synthesize_files

    d = tempfile.mkdtemp(prefix="pairloom-rows-")
    rows = [("7", "the cat", "a cat"), ("7", "the dog", "a dog"), ("", "the cat", "a cat"), ("", "cat", "the")]
    with open(os.path.join(d, "train_complex.csv"), "w") as f:
        f.write("tgt_raw,id,src_raw,extra\n" + "".join(f"{t},{i},{s},x\n" for i, s, t in rows))
    dic = spark.createDataFrame([("fr", "the", "le"), ("fr", "cat", "chat")], "lang string, pivot_word string, word string")
    synthesize_files(spark, d, os.path.join(d, "out"), dic, "fr")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ["src_raw", "tgt_raw", "src_en_original"]])
    got = read_csv(spark, os.path.join(d, "out", "train_synthetic"), schema).collect()
    fr = {"the": "le", "cat": "chat"}
    exp = [(" ".join(fr.get(w, w) for w in s.split()), " ".join(fr.get(w, w) for w in t.split()), s) for _, s, t in rows]
    assert Counter((r.src_raw, r.tgt_raw, r.src_en_original) for r in got) == Counter(exp)


def test_curated_folders_feed_the_synthesis(spark):
    from pairloom.plans.jobs import synthesize_files

    d = tempfile.mkdtemp(prefix="pairloom-chain-")
    raw = os.path.join(d, "raw.tsv")
    with open(raw, "w") as f:
        for i in range(40):
            f.write("\t".join([str(i), "", "", f"w{i} a b c d e", f"w{i} a b x y e", "", ""]) + "\n")
    counts = curate_corpus(spark, raw, os.path.join(d, "curated"))
    dic = spark.createDataFrame([("fr", "a", "le")], "lang string, pivot_word string, word string")
    rep = synthesize_files(spark, os.path.join(d, "curated"), os.path.join(d, "out"), dic, "fr")
    assert rep == {"split=train": "ok", "split=val": "ok"}
    schema = T.StructType([T.StructField("src_raw", T.StringType())])
    for s in ("train", "val"):
        back = read_csv(spark, os.path.join(d, "out", f"{s}_synthetic"), schema)
        assert back.count() == counts[s] and back.where("src_raw like '% le b c d e'").count() == counts[s]
