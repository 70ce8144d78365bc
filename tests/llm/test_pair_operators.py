"""Jaccard join, decontamination, substring dedup and the pipeline against
brute force."""

import hashlib
import random

import numpy as np
import pytest

VOCAB = [f"w{i}" for i in range(500)]


def edited(rnd, words, share):
    w = list(words)
    for _ in range(max(1, int(share * len(w)))):
        w[rnd.randrange(len(w))] = rnd.choice(VOCAB)
    return w


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    base = [[rnd.choice(VOCAB) for _ in range(n)] for n in (3, 12, 40, 90, 200, 700)]
    out = [None, "", " \n", "one", "One", "two words", "Two  words"]
    for b in base:
        out += [" ".join(b)] * 3 + [" ".join(edited(rnd, b, s)) for s in (0.01, 0.02, 0.03, 0.05, 0.1) for _ in range(4)]
    passage = " ".join(base[3])
    out += [" ".join(rnd.choice(VOCAB) for _ in range(30)) + " " + passage + " " + " ".join(rnd.choice(VOCAB) for _ in range(30)) for _ in range(25)]
    rnd.shuffle(out)
    return list(enumerate(out))


def brute_components(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    comp[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_jaccard_join(spark, rows, size, percent, monkeypatch):
    from pairloom.llm import jaccard_join as J

    monkeypatch.setattr(J, "BLOCK", 4)  # many blocks
    df = spark.createDataFrame([(i, t, 1) for i, t in rows] + [(None, "one", 1), (3, dict(rows)[3], 1)], "doc_id long, text string, cls int")
    got = J.jaccard_join(df, size=size, percent=percent).collect()
    exp = brute_components(rows, size, percent)
    assert len(got) == len(rows) + 2
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == exp[r["doc_id"]], r
    assert J.jaccard_join(df.limit(0)).count() == 0


def test_linked_sets_share_a_presented_part():
    from pairloom.llm.jaccard_join import Bands, fold, parity_bits, signatures

    rng = np.random.default_rng(1)
    for percent in (80, 90):
        bands = Bands(percent)
        for n in (5, 9, 10, 17, 40, 150, 900):
            for _ in range(20):
                x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
                cut = int(n * (100 - percent) / 100)
                y = np.sort(x[cut:])
                if 100 * len(y) >= percent * len(x) and len(y) < len(x):
                    assert np.intersect1d(signatures(x, bands), signatures(y, bands)).size
                bx, by = (np.frombuffer(parity_bits(s), np.uint64) for s in (x, y))
                m = min(len(bx), len(by))
                assert np.bitwise_count(fold(bx, m) ^ fold(by, m)).sum() <= len(np.setxor1d(x, y))


def brute_cut(rows):
    seen, out = set(), {}
    for i, t in sorted((i, t) for i, t in rows if i is not None):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            else:
                seen.add(w)
        spans = sum(1 for p in range(len(gone)) if gone[p] and (p == 0 or not gone[p - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [20_000, 2])
def test_substring_dedup(spark, rows, hot, monkeypatch):
    from pairloom.llm import substring_dedup as S

    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "BUCKET_RUNS", 50)
    more = [(1000, "ab" * 400), (1001, "ab" * 120 + "é" * 200), (1002, "x" * 99), (1003, "x" * 100), (1004, "x" * 101)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows + more] + [(1000, "ab" * 400, 0), (None, None, 0)], "doc_id long, text string, key int")
    got = S.substring_dedup(df.repartition(3)).collect()
    exp = brute_cut(rows + more)
    assert len(got) == len(rows) + len(more) + 2
    for r in got:
        if r["doc_id"] is not None:
            assert tuple(r)[1:] == exp[r["doc_id"]], r["doc_id"]
    assert S.substring_dedup(df.limit(0)).count() == 0


def test_open_runs_are_fetched_with_the_shuffle_of_the_result(spark):
    """No map of runs, which collide more the more runs there are: each text
    is shuffled once and the bytes of its own open runs are cut there."""
    from pairloom.llm import substring_dedup as S

    rnd = random.Random(7)
    letters = lambda n: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    same = letters(150)
    texts = [(i, letters(60) + same + letters(60)) for i in range(20)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = S.substring_dedup(df)
        got = {r.doc_id: tuple(r)[1:] for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "ReusedExchange" in plan and not hasattr(S, "MAP_BITS")
    assert got == brute_cut(texts)


def test_equal_neighbouring_runs_of_a_batch_are_dealt_as_one():
    import pyarrow as pa

    from pairloom.llm import substring_dedup as S

    text = bytes(random.Random(3).choices(range(97, 123), k=3000))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([0, 0, 0]), pa.array([text, text, text[:1000]], pa.binary())], names=["doc_id", "tag", "data"])
    [out] = S._scan([batch])
    marked = [(r["doc_id"], r["pos"] >> 8, r["ctx"]) for r in out.to_pylist() if r["pos"] & 128]
    # the last run of the cut text is shorter than that of the whole one
    assert marked[0] == (2, 0, 2901) and all(d == 3 for d, _, _ in marked[1:]) and len(marked) <= 2


def test_difference_cover():
    from pairloom.llm.substring_dedup import difference_cover

    for v in (7, 32, 64):
        d = difference_cover(v)
        assert {(a - b) % v for a in d for b in d} == set(range(v))


def test_open_groups_are_told_apart(spark):
    """Two groups of two whose 40-bit hashes have equal sums are both compared."""
    from pairloom.llm.jaccard_join import _across

    tiles = spark.createDataFrame([(1, 1100), (1, 2905), (2, 3856), (2, 3939), (3, 1100), (3, 2905)], "p long, cls long")
    classes = spark.createDataFrame([(c, 600, bytes([255] * 64)) for c in (1100, 2905, 3856, 3939)], "cls long, n long, bits binary")
    labels = spark.createDataFrame([], "v long, comp long")
    assert {tuple(r) for r in _across(tiles, classes, labels, 90).collect()} == {(1100, 2905), (3856, 3939)}


def test_sets_of_one_class_are_one_row(spark, monkeypatch):
    """With a full bitmap every copy of a class is picked; one row stays."""
    from pyspark.sql import functions as F

    from pairloom.llm import jaccard_join as J

    monkeypatch.setattr(J, "FILTER_BITS", 1 << 15)
    docs = spark.createDataFrame([(i, "a b c d e" if i % 3 else f"x{i} y z") for i in range(600)], "doc_id long, text string").repartition(5)
    wanted = spark.range(300_000).select(F.col("id").alias("rep"))
    got = [r["cls"] for r in J._sets(docs, wanted, 3).collect()]
    assert len(got) == len(set(got)) == 201


def test_decontamination_recall_and_exactness(spark):
    from pairloom.llm.decontaminate import MAX_SHARE, contaminated, without_contaminated

    rnd = random.Random(9)
    items = [(k, [rnd.choice(VOCAB) for _ in range(rnd.randrange(15, 60))]) for k in range(40)] + [(40, ["Short", "one", "here"])]
    docs, truth = [], {}
    for n in range(240):
        k, w = items[n % 40]
        w = edited(rnd, w, 0.1) if n % 2 else w
        docs.append((n, " ".join([rnd.choice(VOCAB) for _ in range(rnd.randrange(80))] + w + [rnd.choice(VOCAB) for _ in range(rnd.randrange(80))])))
        truth[n] = k
    docs += [(n, " ".join(rnd.choice(VOCAB) for _ in range(300))) for n in range(240, 300)]
    docs += [(300, None), (301, ""), (302, "a SHORT, one: here"), (None, "short one here")]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items] + [(41, None), (42, "")], "item_id long, text string")
    got = contaminated(df, bench).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    hit = sum((n, k) in found for n, k in truth.items()) / len(truth)
    assert hit >= 0.95 and all((n, truth[n]) in found for n in range(0, 240, 2))
    assert not [d for d, _ in found if d is not None and 240 <= d < 302] and (302, 40) in found and (None, 40) in found
    assert all(r["distance"] <= MAX_SHARE * r["n_item_words"] for r in got)
    clean = without_contaminated(df, bench)
    assert clean.columns == df.columns
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in found}
    # the benchmark in several blocks gives the same
    assert {(r["doc_id"], r["item_id"]) for r in contaminated(df, bench, block_words=300).collect()} == found
    assert contaminated(df.limit(0), bench).count() == 0 and contaminated(df, bench.limit(0)).count() == 0


def test_decontamination_edits_at_one_place():
    """Edits that crowd the head, the middle or the tail of an item, or are
    spread, replaced, inserted or missing words: items of 15 to 300 words."""
    from pairloom.llm.common import WordHashes
    from pairloom.llm.decontaminate import Index, windows

    rnd, known = random.Random(4), WordHashes()
    vocab = [f"w{i}" for i in range(3000)]
    some = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items, docs, truth = [], [], []
    for n in (15, 24, 40, 80, 100, 200, 300):
        for place in ("head", "middle", "tail", "spread"):
            for kind in ("replaced", "inserted", "missing"):
                for _ in range(5):
                    w, k = some(n), n // 5
                    at = set(rnd.sample(range(n), k)) if place == "spread" else set(
                        range(k) if place == "head" else range(n - k, n) if place == "tail" else range((n - k) // 2, (n + k) // 2))
                    e = [x for i, t in enumerate(w) for x in ([t] if i not in at else some(1) + [t] * (kind == "inserted") if kind != "missing" else [])]
                    items.append((len(items), known.array(w)))
                    docs.append(known.array(some(rnd.randrange(60)) + e + some(rnd.randrange(60))))
                    truth.append((n, place, kind))
    found = Index(items).search(docs)
    hits = {}
    for k, (key, rows) in enumerate(zip(truth, found)):
        for group in key:
            hits.setdefault(group, []).append(any(r[0] == k for r in rows))
    assert all(sum(h) >= 0.95 * len(h) for h in hits.values()), {g: sum(h) / len(h) for g, h in hits.items()}
    # the last window reaches the item's last words
    assert all(max(p for _, p in windows(n)) >= n - 48 for n in range(15, 400))


def test_decontamination_short_items():
    """Five to seven words allow one edit, which is always found; shorter
    items occur exactly."""
    from pairloom.llm.common import WordHashes
    from pairloom.llm.decontaminate import Index

    known = WordHashes()
    for n in range(1, 8):
        w = [f"w{i}" for i in range(n)]
        forms = [w] + [w[:i] + e for i in range(n) for e in (["x"] + w[i + 1 :], w[i + 1 :], ["x"] + w[i:])]
        docs = [known.array(a + f + b) for f in forms for a, b in (([], []), (["a", "b"], ["c", "d"]))]
        docs += [known.array(["a", "b"]), known.array([])]
        found = Index([(7, known.array(w)), (8, known.array([]))]).search(docs)
        at = lambda k: k // 2 if k < 2 * len(forms) else None
        for k, rows in enumerate(found):
            f = forms[at(k)] if at(k) is not None else None
            whole = f is not None and any(f[i : i + n] == w for i in range(len(f)))
            assert [r[:3] for r in rows] == ([(7, 0, n)] if whole else [(7, 1, n)] if f is not None and n > 4 else []), (n, f, rows)


def test_best_stretch_is_the_edit_distance():
    from pairloom.llm.decontaminate import best_stretch

    rnd = random.Random(2)
    for _ in range(40):
        a = [rnd.randrange(5) for _ in range(rnd.randrange(1, 9))]
        b = [rnd.randrange(5) for _ in range(rnd.randrange(1, 14))]

        def dist(x, y):
            row = list(range(len(y) + 1))
            for i, c in enumerate(x, 1):
                prev, row = row, [i]
                for j, e in enumerate(y, 1):
                    row.append(min(prev[j - 1] + (c != e), prev[j] + 1, row[-1] + 1))
            return row[-1]

        best = min(dist(a, b[s:e]) for s in range(len(b) + 1) for e in range(s, len(b) + 1))
        d, s, e = best_stretch(np.asarray(a, np.uint64), np.asarray(b, np.uint64))
        assert d == best == dist(a, b[s:e])


def test_near_copies_with_null_and_repeated_ids(spark):
    from corpus_pipeline import near_copies_stage

    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (2, a + " more"), (None, a), (None, a),  # copies of 1, two without an id
            (3, b), (3, b), (3, b),                          # one row three times
            (2, c), (None, c + " more"),                     # 2 again, over a text of its own
            (None, "d e f g h i j"), (None, "d e f g h i j"),  # copies, no id at all
            (4, ""), (4, ""), (None, None), (5, None)]       # without words: no copies
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n int").repartition(3)
    got = near_copies_stage(spark, df, "")
    assert got.columns == df.columns
    key = lambda r: (str(r[0]), str(r[1]))
    exp = [(1, a), (3, b), (2, c), (None, "d e f g h i j"), (4, ""), (4, ""), (None, None), (5, None)]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=key) == sorted(exp, key=key)


def test_pipeline(spark):
    import corpus_pipeline
    from conftest import SF001
    from pairloom.llm.decontaminate import contaminated
    from pairloom.llm.pii import pseudonymise
    from pairloom.llm.quality_rules import quality_rules

    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"] for r in quality_rules(docs).where("kept").collect()}
    groups = brute_components([(i, texts[i]) for i in sorted(kept)], 5, 80)
    one = {i for i, (n, c) in groups.items() if n == 0 or c == i}
    leaks = {r["doc_id"] for r in contaminated(docs, spark.read.parquet(f"{SF001}/benchmark.parquet")).collect()}
    got = corpus_pipeline.run(spark, SF001)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    ids = {r["doc_id"]: r for r in got.collect()}
    assert set(ids) == one - leaks
    from pairloom.llm.bpe import WordBpe
    import public_tokenizers

    own = WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    for r in pseudonymise(docs).collect():
        if r["doc_id"] in ids:
            assert ids[r["doc_id"]]["ids_sha256"] == hashlib.sha256(own.encode(r["text"])).hexdigest()
