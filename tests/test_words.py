import random

from pyspark.sql import functions as F

from pairloom.functions.text import hash_key, word_edit_distance, words


def lev(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            cur[j] = min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y))
        prev = cur
    return prev[-1]


def test_split_matches_python(spark):
    texts = ["a b", " a b　c ", "x\ty\nz", "", "   ", "p q\u0085r\x1cs", "one", "a​b"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(words("t").alias("w")).collect()
    assert [r.w for r in got] == [t.split() for t in texts]


def test_null_text_gives_null(spark):
    r = spark.createDataFrame([(None,)], "t string").select(words("t").alias("w")).first()
    assert r.w is None


def test_edit_distance_matches_brute_force(spark):
    rnd = random.Random(7)
    vocab = ["a", "b", "c", "d", "é", "中", "x" * 3]
    rows = []
    for _ in range(200):
        s = [rnd.choice(vocab) for _ in range(rnd.randint(0, 12))]
        t = [rnd.choice(vocab) for _ in range(rnd.randint(0, 12))]
        rows.append((s, t))
    df = spark.createDataFrame(rows, "s array<string>, t array<string>")
    got = word_edit_distance(df, "s", "t").collect()
    for r in got:
        assert r.dist == lev(r.s, r.t)
    # symmetric, zero only for equal lists
    back = word_edit_distance(df, "t", "s").collect()
    assert sorted(r.dist for r in got) == sorted(r.dist for r in back)
    assert all((r.dist == 0) == (r.s == r.t) for r in got)


def test_thresholded_distance(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"], ["x", "y", "c", "d"])], "s array<string>, t array<string>")
    assert word_edit_distance(df, "s", "t", threshold=2).first().dist == 2
    assert word_edit_distance(df, "s", "t", threshold=1).first().dist == -1


def test_many_distinct_words(spark):
    # beyond the 35,327 words a BMP encoding could hold
    n = 35328
    s = [f"w{i}" for i in range(n)]
    t = s[:-2] + ["u1", "u2", "u3"]
    df = spark.createDataFrame([(s, t)], "s array<string>, t array<string>")
    assert word_edit_distance(df, "s", "t").first().dist == 3


def test_hash_key_is_md5_prefix(spark):
    import hashlib

    r = spark.range(1).select(hash_key(F.lit(7)).alias("h")).first()
    assert r.h == int(hashlib.md5(b"42:7").hexdigest()[:8], 16)


def test_edit_distance_with_shared_prefix_and_suffix(spark):
    rnd = random.Random(11)
    rows = []
    for _ in range(150):
        core = [rnd.choice("abcde") for _ in range(rnd.randint(0, 6))]
        pre = [rnd.choice("abcde") for _ in range(rnd.randint(0, 5))]
        suf = [rnd.choice("abcde") for _ in range(rnd.randint(0, 5))]
        other = [rnd.choice("abcde") for _ in range(rnd.randint(0, 6))]
        rows.append((pre + core + suf, pre + other + suf))
    rows += [(["a", "a"], ["a"]), (["a"], ["a", "a", "a"]), (["a", "b", "a"], ["a", "a"])]
    df = spark.createDataFrame(rows, "s array<string>, t array<string>")
    for r in word_edit_distance(df, "s", "t").collect():
        assert r.dist == lev(r.s, r.t)
    for r in word_edit_distance(df, "s", "t", threshold=2).collect():
        d = lev(r.s, r.t)
        assert r.dist == (d if d <= 2 else -1)


def test_pair_beyond_the_code_points():
    """A pair that the code points cannot hold gets the same distance, on
    integers."""
    from pairloom.functions.text import _encode_words

    x, y = "a b c d e f g".split(), "a c b d x f g h".split()
    a, b, d = _encode_words(x, y, 1 << 20)
    assert d is None and (len(a), len(b)) == (6, 7)
    assert _encode_words(x, y, 1) == (None, None, 4)
    assert _encode_words([], y, 1)[2] == 8 or _encode_words([], y, 1 << 20)[0] == ""
    assert _encode_words(x, x, 1 << 20) == ("", "", None)
