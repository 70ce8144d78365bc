"""Token counts, BPE, quality rules, labels, PII, toxicity, URLs: each against a
plain formulation on small rows with nulls, empties, repeats and odd columns."""

import collections
import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", "   \n\t ", "one", "Σίσυφος ΣΑΣ İstanbul Å ﬁ \x1c\x85\xa0 x", "<|startoftext|>Hi there<|endoftext|> it's 42!!",
    "a" * 3000, "漢字🙂 " * 400, "the same line of words here\n" * 12, "word " * 70_000,
    " ".join(f"w{i}" for i in range(60)) + "\n" + " ".join(f"w{i}" for i in range(25)), "#$% " * 30 + "words and more words of text " * 5,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", i) for i, t in enumerate(TEXTS)] + [(None, "no id here", None, 0), (3, "one", "x", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, words string, n_words long")


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


def test_token_counts(spark, docs):
    import sentencepiece

    from pairloom.llm.token_counts import token_counts

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for chunk, overlap in ((16_384, 128), (64, 4)):
        got = token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"), chunk=chunk, overlap=overlap)
        exp = collections.Counter((i, len(t.encode()), len(sp.encode(t))) for i, t in texts_of(docs))
        assert collections.Counter((r[0], r[1], r[2]) for r in got.collect()) == exp
    assert got.agg(F.max("n_chunks")).first()[0] > 1
    assert got.agg(F.max("n_widened")).first()[0] > 0  # 3,000 times one letter: no stable place
    assert token_counts(docs.limit(0), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_bpe_round_trip(spark, docs):
    from tokenizers import Tokenizer

    from pairloom.llm.bpe import WordBpe, decode, encode, round_trip_digests

    path = public_tokenizers.path("word_bpe_49k.json")
    tk, own = Tokenizer.from_file(path), WordBpe(path)
    exp = collections.Counter()
    for i, t in texts_of(docs):
        ids = tk.encode(t, add_special_tokens=False).ids
        raw = np.asarray(ids, "<u4").tobytes()
        assert own.encode(t) == raw
        exp[i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(tk.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, round_trip_digests(docs, path).collect())) == exp
    back = decode(encode(docs.limit(9), path), path)
    assert [r["text"] for r in back.collect()] == [tk.decode(tk.encode(t, add_special_tokens=False).ids, skip_special_tokens=False) for _, t in texts_of(docs.limit(9))]
    # scan and heap merge alike
    for w in ("hello", "thththere", "x" * 50, "abcabcabc" * 9):
        parts = [own.byte_id[b] for b in w.encode()]
        assert own._scan(list(parts)) == own._heap(list(parts))


def brute_counts(t):
    w, c = WORD.findall(t), collections.defaultdict(list)
    for i in range(len(w) - 7):
        c[tuple(w[i : i + 8])].append(i)
    covered = {j for p in c.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_quality_rules_counts_and_filter(spark, docs):
    from pairloom.llm.quality_rules import keep_good, quality_rules

    out = quality_rules(docs).collect()
    exp = collections.Counter((i, *brute_counts(t)) for i, t in texts_of(docs))
    assert collections.Counter((r["doc_id"], *r[1:6]) for r in out) == exp
    for r in out:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    kept = keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in out if r["kept"])
    assert quality_rules(docs.limit(0)).count() == 0


def test_one_bad_vote_and_several_good_ones():
    """The effect of the prior's weight, as the README states it."""
    from pairloom.llm.weak_labels import fit_patterns

    for share, expected in ((0.01, 0.08), (0.1, 0.23), (0.2, 0.55)):
        n = round(100_000 * share)
        m = fit_patterns([((1,) * 6, 100_000 - n), ((0,) + (1,) * 5, n)], list("abcdef"))
        const, up, down = m.log_odds()
        assert abs(1 / (1 + np.exp(-(const + down[0] + sum(up[1:])))) - expected) < 0.01


def test_label_model_discounts_noise_and_trusts_symptoms():
    from pairloom.llm.weak_labels import fit_patterns

    m = fit_patterns([((1, 1, 1), 800), ((0, 1, 1), 60), ((1, 0, 1), 40), ((1, 1, 0), 450), ((0, 0, 1), 20)], ["a", "b", "noisy"])
    const, up, down = m.log_odds()
    post = lambda v: const + sum(u if x else d for x, u, d in zip(v, up, down))
    assert post((1, 1, 1)) > 0 and post((0, 0, 1)) < 0
    assert down[2] > down[0]  # the rule that fires on a third of all rows says less
    assert 0 < fit_patterns([], ["a"]).prior < 1  # no rows: the prior alone


def test_quality_classifier_held_out(spark):
    from conftest import SF01
    from pairloom.llm.quality_classifier import op2_quality_classifier

    got = op2_quality_classifier(spark, SF01).join(spark.read.parquet(f"{SF01}/labels.parquet"), "doc_id")
    right, n = got.agg(F.avg(((F.col("quality") == 1) == F.col("kept")).cast("int")), F.count("*")).first()
    assert n > 300 and right > 0.9


def test_quality_classifier_edges(spark, docs):
    from pairloom.llm.quality_classifier import quality_classifier

    got = quality_classifier(docs).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["kept"] for r in got if r["doc_id"] in (0, 1, 2)} == {False}
    assert quality_classifier(docs.limit(0)).count() == 0


def test_toxicity_held_out_and_edges(spark, docs):
    from conftest import SF01
    from pairloom.llm.toxicity import toxicity

    all_docs, labels = spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet")
    train = labels.where("doc_id % 3 <> 0")
    got = toxicity(all_docs, train).join(labels.where("doc_id % 3 = 0").withColumnRenamed("toxic", "truth"), "doc_id")
    right = got.agg(F.avg(((F.col("truth") == 1) == F.col("toxic")).cast("int"))).first()[0]
    assert right > 0.9
    none = toxicity(docs, spark.createDataFrame([(3, 0)], "doc_id long, toxic int")).collect()
    assert len(none) == docs.count() and not any(r["toxic"] for r in none)


def test_toxicity_label_ties(spark):
    """Two labels of one text, or of one id: the highest counts, on any partitioning."""
    from pairloom.llm.toxicity import train

    texts = [f"fine words number {i} here" for i in range(40)] + [f"vile filth vile number {i}" for i in range(40)]
    docs = spark.createDataFrame([*enumerate(texts), *((100 + i, t) for i, t in enumerate(texts))], "doc_id long, text string")
    labels = [(i, int(i >= 40)) for i in range(80)] + [(100 + i, 0) for i in range(80)] + [(50, 0), (60, None)]
    df = spark.createDataFrame(labels, "doc_id long, toxic int")
    models = [train(docs.repartition(n), df.repartition(n)) for n in (1, 9)]
    assert len(models[0].words) > 0 and (models[0].words == models[1].words).all()
    np.testing.assert_allclose(models[0].weights, models[1].weights)


def test_ordinal_thresholds_share_weights():
    from pairloom.llm.toxicity import fit_ordinal

    rows = [(np.asarray([0]), np.log1p([float(g * 3)])) if g else (np.zeros(0, np.int64), np.zeros(0)) for g in [0, 1, 2, 3] * 40]
    m = fit_ordinal(np.asarray([5], np.uint64), rows, np.asarray([0, 1, 2, 3] * 40))
    assert list(m.thresholds) == sorted(m.thresholds)
    s = [float(m.expected(np.asarray([m.weights[0] * np.log1p(3.0 * g)]))[0]) for g in range(4)]
    assert s == sorted(s) and s[0] < 0.5 < 2 < s[3]


def test_pii_surrogates(spark):
    from pairloom.llm.pii import Surrogates, luhn, pseudonymise, pseudonymise_rows, replace

    names = Surrogates(b"k")
    four = {"".join(map(str, names.permute("t", [int(c) for c in f"{i:04d}"], [10] * 4))) for i in range(10_000)}
    assert len(four) == 10_000  # a permutation: distinct entities stay distinct
    a, _ = replace("call +1 (743) 555-3824 now, or 743-555-3824", names)
    first, second = re.findall(r"\d{3}\D{1,2}\d{3}-\d{4}", a)
    assert re.sub(r"\D", "", first) == re.sub(r"\D", "", second) and "7435553824" not in re.sub(r"\D", "", a)
    card = replace("4111 1111 1111 1111", names)[0]
    assert re.fullmatch(r"\d{4}( \d{4}){3}", card) and luhn([int(c) for c in card if c.isdigit()])
    ip = replace("at 10.20.30.255.", names)[0]
    assert all(0 <= int(x) < 256 for x in re.findall(r"\d+", ip))
    he, she = replace("Mr. Paul Smith", names)[0], replace("Frau Anna Ross", names)[0]
    assert he != "Mr. Paul Smith" and she.startswith("Frau ") and he.startswith("Mr. ")
    rows = [(1, "mail a.b12@mail5.example.com"), (2, "A.B12@mail5.example.com again"), (3, None), (4, "nothing of 2024, 3.14"), (None, "1.2.3.4")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_entities"]) for r in pseudonymise(df, key=b"k").collect()}
    assert got[3] == ("", 0) and got[4] == (rows[3][1], 0) and got[None][1] == 1
    assert got[1][0].split()[1].lower() == got[2][0].split()[0].lower() != "a.b12@mail5.example.com"
    same = {r["doc_id"]: r["text"] for r in pseudonymise_rows(df, key=b"k").collect()}
    assert {k: v or "" for k, v in same.items()} == {k: v[0] for k, v in got.items()}


def test_pii_collisions_are_found(spark, monkeypatch):
    from pairloom.llm import pii

    schema = "kind string, entity string, gender string"
    df = spark.createDataFrame([("name", "Ab", ""), ("name", "Cd", "")], schema)
    assert pii.collisions(df, b"k", {}) == []
    # surrogates that coincide at the first draw and differ at the next
    first = lambda self, kind, text, gender="": "one" if not self.redrawn.get((kind, self.canonical(kind, text))) else f"two {text}"
    monkeypatch.setattr(pii.Surrogates, "surrogate", first)
    df = spark.createDataFrame([("email", "a@x.org", ""), ("email", "b@x.org", ""), ("email", "A@x.org", ""), ("ip", "1.2.3.4", "")], schema)
    assert [tuple(r) for r in pii.collisions(df, b"k", {})] == [("email", "b@x.org")]
    docs = spark.createDataFrame([(1, "a@x.org and b@x.org"), (2, "b@x.org")], "doc_id long, text string")
    assert pii.keyed(docs, b"k") == {("email", "b@x.org"): 1}


def test_pii_names_propagate_within_a_text():
    from pairloom.llm.pii import Surrogates, entities, replace

    names = Surrogates(b"k")
    text = "Mr. John Smith met us. John called; Smith paid, Johnson and Smith_2 did not. Mrs. Anna Ross saw Anna."
    got, n = replace(text, names)
    first, last = got.split(" ")[1:3]
    assert n == 5 and first != "John" and last != "Smith"
    assert f"us. {first} called; {last} paid, Johnson and Smith_2 did not" in got and "John " not in got
    assert got.count(names.surrogate("name", "Anna", "f")) == 2
    assert replace("John called; Smith paid.", names)[1] == 0  # no title in this text
    assert [e[0] for e in entities("token=abcdefabcdef.x@y.com")] == ["assigned", "email"]


def test_pii_ibans_stay_valid():
    from pairloom.llm.pii import Surrogates, iban_check, replace

    names = Surrogates(b"k")
    for iban in ("DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "FR1420041010050500013M02606"):
        got = replace(f"to {iban} today", names)[0][3:-6]
        assert iban_check(iban) == iban_check(got) == 1 and got != iban and len(got) == len(iban) and got[:2] == iban[:2]
    bad = replace("to DE88 3704 0044 0532 0130 00 today", names)[0]
    assert "DE88 3704" not in bad


def test_pii_is_linear_in_long_runs():
    import time

    from pairloom.llm.pii import Surrogates, replace

    t = time.process_time()
    for run in ("x1" * 500_000, "a.b-" * 250_000, "1" * 1_000_000, "x@" * 400_000, "Mr. Ab " * 10_000):
        replace(run, Surrogates(b"k"))
    assert time.process_time() - t < 60


def test_url_filter(spark):
    from pairloom.llm.url_filter import url_filter

    urls = [f"https://good{i}.example.net/en/page{i}" for i in range(30)] + [f"http://spam{i}.bad.net/x/{i}" for i in range(30)]
    urls += ["https://good99.example.org/en/page7", "http://spam77.bad.org/x/9", "HTTP://A.EXAMPLE.COM/de/1", "x.org/fr/", None, "",
             "http://org/fr/", "https://net", "s://h?q=/en/", "http://notexample.net/en/", "http://a.b.example.net/en/z#t"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, urls[0], "h")], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_filter(df).collect()}
    by = lambda u: got[urls.index(u)]
    assert by("https://good99.example.org/en/page7")["verdict"] == "allow"
    assert by("http://spam77.bad.org/x/9")["verdict"] == "block"
    assert tuple(by("HTTP://A.EXAMPLE.COM/de/1")[1:5]) == ("a.example.com", "/de/1", "example.com/de/", "block")
    assert tuple(by("x.org/fr/")[1:4]) == ("", "", None) and tuple(by(None)[1:4]) == ("", "", None)
    assert by("http://org/fr/")["rule"] == "org/fr/" and by("https://net")["rule"] is None
    assert tuple(by("s://h?q=/en/")[1:3]) == ("h", "")
    assert by("http://notexample.net/en/")["rule"] == "net/" and by("http://a.b.example.net/en/z#t")["path"] == "/en/z"
    assert url_filter(df.limit(0)).count() == 0
