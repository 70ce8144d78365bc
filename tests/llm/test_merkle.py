"""Merkle fingerprints: roots, likeness and located edits against plain forms."""

import collections
import hashlib
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pairloom.llm.merkle import Tree, compared_with_next, differing, fingerprint, fingerprints, likeness


def prose(seed, words=400):
    r = random.Random(seed)
    out = []
    for _ in range(words):
        out.append("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 9))) + r.choice(["", "", "", "", ".", ",", "\n", "\n\n"]))
    return " ".join(out)


def leaves(text):
    return [p for s in Tree(text).sections for par in s for p in par]


texts = st.text(alphabet="ab .\né漢。", max_size=300)


@settings(max_examples=600, deadline=None)
@given(texts, texts)
def test_likeness_is_that_of_the_leaves(a, b):
    """Going down only where branches differ gives what comparing all leaves
    gives; 1 for equal texts and only for them; both ways alike."""
    assert "\n".join(b"".join(p).decode() for s in Tree(a).sections for p in s) == a
    x, y = fingerprint(a), fingerprint(b)
    got = likeness(x, y)
    assert (x == y) == (a == b) == (got == 1.0) and got == likeness(y, x) and 0 <= got <= 1
    if a != b:
        la, lb = leaves(a), leaves(b)
        common = sum((collections.Counter(la) & collections.Counter(lb)).values())
        plain = 2 * common / (len(la) + len(lb)) if la or lb else 0.0
        assert got == min(plain, 1 - 1 / (len(la) + len(lb) + 1))


@settings(max_examples=600, deadline=None)
@given(texts, texts, texts, texts)
def test_edits_lie_within_the_located_spans(head, tail, one, other):
    a, b = head + one + tail, head + other + tail
    span = differing(Tree(a), Tree(b))
    if a == b:
        assert span is None
        return
    (p, q), (r, s) = span
    assert a[:p] == b[:r] and a[q:] == b[s:] and a[:p] + b[r:s] + a[q:] == b


def test_edits_change_few_leaves():
    text = prose(1, 3000)
    for at in (0, 5000, len(text) - 40):
        changed = text[:at] + "quite other words stand here now" + text[at + 20:]
        assert likeness(fingerprint(text), fingerprint(changed)) > 0.97
        (p, q), _ = differing(Tree(text), Tree(changed))
        assert q - p < 400 and p <= at
    assert likeness(fingerprint(text), fingerprint(prose(2, 3000))) < 0.05


def brute(rows, edits=True):
    """Multiset of rows by a plain sort; ties by a hash as Spark's are not known here."""
    out = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        e = t[:len(t) - half] + after[:half]
        span = differing(Tree(t), Tree(e))
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprint(t), fingerprint(e), likeness(fingerprint(t), fingerprint(e)),
                    likeness(fingerprint(t), fingerprint(after)), len(leaves(t)), span and span[0][0]))
    return out


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_leaves", "edit_from"]


@pytest.mark.parametrize("parts", [1, 9])
def test_next_documents_across_ranges(spark, parts):
    rows = [(i * 7 % 101, [prose(i, 60), "", None, "漢字。" * i, "a" * (i * 9), "one two"][i % 6]) for i in range(101)]
    rows.append((None, "no id"))
    df = spark.createDataFrame([(i, t, "x", 3, t) for i, t in rows], "doc_id long, text string, fingerprint string, part int, h string")
    got = compared_with_next(df.repartition(parts)).select(COLUMNS).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    assert collections.Counter(map(tuple, got)) == collections.Counter(brute(order))


def test_repeated_ids_and_rows(spark):
    rows = [(1, "same text here")] * 60 + [(1, "other")] * 2 + [(2, "last one stands")] * 30
    got = compared_with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).select(COLUMNS).collect()
    hashes = {t: h for t, h in spark.createDataFrame([(t,) for _, t in set(rows)], "t string").select("t", F.xxhash64("t")).collect()}
    order = sorted(rows, key=lambda r: (r[0], hashes[r[1]]))
    assert collections.Counter(map(tuple, got)) == collections.Counter(brute(order))


def test_edge_tables(spark):
    schema = "doc_id long, text string"
    assert compared_with_next(spark.createDataFrame([], schema)).count() == 0
    one = compared_with_next(spark.createDataFrame([(4, "only this. One text.")], schema)).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"only this.only this.").hexdigest()
    empty = compared_with_next(spark.createDataFrame([(4, None)], schema)).first()
    assert (empty["n_chars"], empty["near_edited"], empty["edit_from"]) == (0, 1.0, None)
    long = "word " * 300_000
    big = compared_with_next(spark.createDataFrame([(1, long), (2, "x")], schema)).where("doc_id = 1").first()
    assert big["n_chars"] == len(long) and 0.4 < big["near_edited"] < 1.0
    assert fingerprints(spark.createDataFrame([(1, None), (2, "a"), (3, "a")], schema)).select("fingerprint").distinct().count() == 2
