"""Edit operations, rules and rewriting in place."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import edits as ED
from pairloom.operators import rewrite as R


def plain_trace(s, t):
    """The fixed alignment from the whole table."""
    d = [[i + j if not i or not j else 0 for j in range(len(t) + 1)] for i in range(len(s) + 1)]
    for i in range(1, len(s) + 1):
        for j in range(1, len(t) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (s[i - 1] != t[j - 1]))
    i, j, out = len(s), len(t), []
    while i or j:
        if i and j and d[i - 1][j - 1] + (s[i - 1] != t[j - 1]) == d[i][j]:
            i, j = i - 1, j - 1
            out.append((i, j, 1, 1))
        elif i and d[i - 1][j] + 1 == d[i][j]:
            i -= 1
            out.append((i, j, 1, 0))
        else:
            j -= 1
            out.append((i, j, 0, 1))
    return out, d[-1][-1]


@pytest.mark.parametrize("cells", [1, 12, 60, ED.CELLS])
def test_trace_in_strips_equals_the_whole_table(cells):
    r = random.Random(cells)
    for _ in range(120):
        s = np.array([r.randrange(4) for _ in range(r.randint(0, 14))], dtype=np.int64)
        t = np.array([r.randrange(4) for _ in range(r.randint(0, 14))], dtype=np.int64)
        assert ED._trace(s, t, cells) == plain_trace(list(s), list(t))[0]


def test_edits_rebuild_the_target():
    r = random.Random(5)
    for _ in range(200):
        x = [r.choice("abcde") for _ in range(r.randint(0, 20))]
        y = [r.choice("abcde") if r.random() < 0.3 else w for w in x if r.random() < 0.9]
        out, at, cost = [], 0, 0
        for e in ED._changed(x, y):
            assert e["src"] == x[e["pos"]:e["pos"] + len(e["src"])] and e["left"] == (x[e["pos"] - 1] if e["pos"] else "")
            assert e["kind"] == ("insert" if not e["src"] else "delete" if not e["tgt"] else "replace")
            out += x[at:e["pos"]] + e["tgt"]
            at = e["pos"] + len(e["src"])
            cost += max(len(e["src"]), len(e["tgt"]))
        assert out + x[at:] == y and cost == plain_trace(x, y)[1]


def test_rules_learned_and_applied(spark):
    pairs = spark.createDataFrame(
        [(1, "en", "he is a so called expert here", "he is an expert here"), (2, "en", "she is a so called writer", "she is an writer"),
         (3, "en", "the regime fell", "the government fell"), (4, "en", "a regime rose", "a government rose"), (5, "en", "old regime", "old regime"),
         (6, "en", "they claim that it", "they did claim that it"), (7, "en", "they claim so", "they did claim so"), (8, "de", "regime", None)],
        "pair_id long, lang string, src_raw string, tgt_raw string")
    rules = {(r["left"], r.phrase): (r.to, r.hits, r.places) for r in ED.learn_rules(pairs, ["lang"]).collect()}
    assert rules[("is", "a so called")] == ("an", 2, 2) and rules[(None, "a so called")] == ("an", 2, 2)
    assert rules[(None, "regime")] == ("government", 2, 3)  # one place in three stays
    assert rules[("they", "")] == ("did", 2, 2)
    df = spark.createDataFrame(
        [(1, "en", "it is a so called regime"), (2, "en", "they　say a  regime"), (3, "de", "regime"), (4, "en", "  "), (None, "en", "regime"), (5, "en", None)],
        "id long, lang string, t string")
    got = {r.id: r.o for r in ED.apply_rules(df, ED.learn_rules(pairs, ["lang"]), "id", "t", "o", ["lang"]).collect()}
    assert got == {1: "it is an government", 2: "they did say a government", 3: "regime", 4: "", None: "government", 5: None}
    assert ED.learn_rules(pairs.limit(0), ["lang"]).count() == 0
    assert ED.apply_rules(df, ED.learn_rules(pairs.limit(0), ["lang"]), "id", "t", "o", ["lang"]).where("o like '%government%'").count() == 0


def test_longest_phrase_and_context_win():
    keys = ["b", "a\tb", "b c", "\ta", "c\t", "x y", "y"]
    to = ["B", "AB", "BC", "first", "end", "", "Y"]
    assert ED.rewrite_by("a b q b c", keys, to) == "first AB q BC end"
    assert ED.rewrite_by("x y y", keys, to) == "Y"  # the longer phrase is deleted
    assert ED.rewrite_by("", keys, to) == "" and ED.rewrite_by("q q", [], []) == "q q"


def test_rewriting_keeps_words_in_place(spark):
    """Against a plain loop: variants, dropped words, null ids, clashing columns."""
    r = random.Random(1)
    vocabulary = [f"w{i}" for i in range(30)]
    rows = [(i if i else None, r.choice(["de", "fr"]), " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 80))), "x") for i in range(60)]
    changes = [(lang, w, r.choice([None, w.upper()]), m) for lang in ("de", "fr") for m in ("one", "two") for w in r.sample(vocabulary, 9)]
    df = spark.createDataFrame([*rows, (777, "de", None, "x")], "id long, lang string, t string, word string").repartition(7)
    c = spark.createDataFrame(changes, "lang string, word string, to string, model string")
    got = {(g.id, g.model): g.o for g in R.rewrite_words(df, "id", {"t": "o"}, c, ["lang"], {"model": ["one", "two"]}).collect()}
    table = {(lang, m, w): to for lang, w, to, m in changes}
    for i, lang, t, _ in rows:
        for m in ("one", "two"):
            exp = [table.get((lang, m, w), w) for w in t.split()]
            assert got[i, m] == " ".join(w for w in exp if w is not None)
    assert got[777, "one"] is None and len(got) == 122


def test_pivot_changes_equal_the_three_steps(spark):
    d = spark.createDataFrame([("fr", "the", "le"), ("fr", "bad", "mal"), ("fr", "cat", "chat")], "lang string, pivot_word string, word string")
    lex = spark.createDataFrame([("bad",), ("rude",)], "word string")
    df = spark.createDataFrame([(1, "fr", "le mal chat rude the cat"), (2, "de", "bad the"), (3, "fr", "")], "id long, lang string, t string")
    steps = R.translate(df, d, "id", "t", "lang", True, "e")
    steps = R.translate(R.neutralize(steps, lex, "id", "e", "n"), d, "id", "n", "lang", False, "o")
    changes = R.pivot_changes(R.text_words(df, ["lang"], ["t"]), d, lex)
    direct = R.rewrite_words(df, "id", {"t": "o"}, changes, ["lang"])
    assert sorted(direct.select("id", "o").collect()) == sorted(steps.select("id", "o").collect())


def test_ranks_do_not_depend_on_ranges(spark):
    rows = [(lang, f"w{i:03d}", i % 7) for lang in ("a", "b", "c") for i in range(200 if lang == "a" else 3)]
    df = spark.createDataFrame(rows, "lang string, word string, n int").repartition(9)
    got = R.dense_rank_rows(df, ["lang"], [F.desc("n"), F.asc("word")]).collect()
    for lang in ("a", "b", "c"):
        exp = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[2], r[1]))
        assert sorted((g["rank"], g["word"]) for g in got if g["lang"] == lang) == [(k, r[1]) for k, r in enumerate(exp, 1)]


def test_only_phrases_that_may_have_a_rule_are_joined(spark):
    """The keys of a text stay in its task, but for those with a rule and the
    few that a map of the rules' hashes cannot tell from them."""
    rules = spark.createDataFrame([(None, "b c", "x"), ("a", "d", "y"), ("", "", "z"), ("e", "", "w"), ("", "q r s", "")], "left string, phrase string, to string")
    texts = [(1, "a d b c e"), (2, "q r s t"), (3, None), (4, " "), (5, "q r"), (6, " ".join(f"w{i}" for i in range(5000)))]
    df = spark.createDataFrame(texts, "id long, t string")
    held = ED._rule_map(rules).tobytes()
    keys = df.select("id", F.col("t").alias("_text")).mapInArrow(ED._candidates(held, 3), "id long, word string").collect()
    exact = {(1, "a\td"), (1, "b c"), (1, "e\t"), *[(i, "\t") for i in range(1, 7)], (2, "\tq r s")}
    assert exact <= {tuple(k) for k in keys} and len(keys) < 100
    out = ED.apply_rules(df, rules, "id", "t", "o")
    assert "explode" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.id: r.o for r in out.collect()}
    assert got[1] == "z a y x e w" and got[2] == "t" and got[3] is None and got[4] == "z" and got[5] == "z q r" and got[6] == "z " + texts[5][1]
