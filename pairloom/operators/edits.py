"""Edit operations of revisions, and rewriting by rules learned from them.

``edit_ops`` aligns the two sides of a pair at least word-level edit distance
and gives the maximal runs of changed words: delete, replace or insert, with
the word before them.  ``learn_rules`` counts them over training pairs, with
that word as context and without, against the places where the same words
stand in the sources; ``apply_rules`` rewrites texts by the longest rule that
fits at each place.  Where the lexicon of ``rewrite`` can only drop words,
rules replace and insert them too.

Alignment.  Of the alignments of least distance one is fixed: the common
beginning is matched, then the common end of what is left; the rest is traced
back from its end through the table of distances, a match or substitution
before a deletion before an insertion.  The table is never held whole: a
strip of rows is computed from the row before it and traced, and rows between
strips are found by halving (the distances of a row in the middle, first for
the lower half, then for the upper), so memory is linear in the words."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.functions.text import computed_once, words
from pairloom.operators.rewrite import rewrite_keyed

#: cells of the distance table that a task holds at once
CELLS = 1 << 22

#: words in a rule's phrase, and in what it becomes, at most
MAX_PHRASE = 3

#: between a context and its phrase in a rule's key (words hold no blanks)
MARK = "\t"


# ---- alignment -----------------------------------------------------------------

def _next_row(row: np.ndarray, word: int, t: np.ndarray) -> np.ndarray:
    """The distances one source word further."""
    at = np.arange(len(row))
    step = np.minimum(row[1:] + 1, row[:-1] + (t[: len(row) - 1] != word))
    return np.minimum.accumulate(np.concatenate([row[:1] + 1, step]) - at) + at


def _trace(s: np.ndarray, t: np.ndarray, cells: int = CELLS) -> list[tuple[int, int, int, int]]:
    """The fixed alignment of two code arrays as steps (i, j, di, dj), from
    the end: di and dj say whether a source and a target word are taken."""
    out: list = []
    # rows of the table that are known, by source position, from the first down
    known = [(0, np.arange(len(t) + 1))]
    i, j = len(s), len(t)
    while i or j:
        at, row = known[-1]
        if at > i or (at == i and i):
            known.pop()
            continue
        row = row[: j + 1]
        if (i - at) * (j + 1) > cells and i - at > 1:
            for k in range(at, (at + i) // 2):
                row = _next_row(row, s[k], t)
            known.append(((at + i) // 2, row))
            continue
        strip = [row]
        for k in range(at, i):
            strip.append(_next_row(strip[-1], s[k], t))
        while (i > at or not at) and (i or j):
            here = strip[i - at][j]
            if i and j and strip[i - 1 - at][j - 1] + (s[i - 1] != t[j - 1]) == here:
                i, j = i - 1, j - 1
                out.append((i, j, 1, 1))
            elif i and strip[i - 1 - at][j] + 1 == here:
                i -= 1
                out.append((i, j, 1, 0))
            else:
                j -= 1
                out.append((i, j, 0, 1))
    return out


def _changed(x, y) -> list[dict]:
    """The runs of changed words of one pair, in order."""
    code, _ = pd.factorize(np.concatenate([np.asarray(x, dtype=object), np.asarray(y, dtype=object)]))
    p, q = code[: len(x)], code[len(x) :]
    n = min(len(p), len(q))
    differ = np.flatnonzero(p[:n] != q[:n])
    pre = int(differ[0]) if len(differ) else n
    p, q = p[pre:], q[pre:]
    n = min(len(p), len(q))
    differ = np.flatnonzero(p[::-1][:n] != q[::-1][:n])
    suf = int(differ[0]) if len(differ) else n
    p, q = p[: len(p) - suf], q[: len(q) - suf]
    runs, open_ = [], False
    for i, j, di, dj in reversed(_trace(p, q)):
        if di and dj and p[i] == q[j]:
            open_ = False
            continue
        if not open_:
            runs.append([i, i, j, j])
            open_ = True
        runs[-1][1] += di
        runs[-1][3] += dj
    out = []
    for k, (i0, i1, j0, j1) in enumerate(runs):
        src, tgt = list(x[pre + i0 : pre + i1]), list(y[pre + j0 : pre + j1])
        kind = "insert" if not src else "delete" if not tgt else "replace"
        out.append({"idx": k, "pos": pre + i0, "kind": kind, "left": x[pre + i0 - 1] if pre + i0 else "", "src": src, "tgt": tgt})
    return out


_OPS = T.ArrayType(T.StructType([
    T.StructField("idx", T.IntegerType()), T.StructField("pos", T.IntegerType()), T.StructField("kind", T.StringType()),
    T.StructField("left", T.StringType()), T.StructField("src", T.ArrayType(T.StringType())), T.StructField("tgt", T.ArrayType(T.StringType())),
]))


@F.pandas_udf(_OPS)
def _changed_udf(s: pd.Series, t: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _changed(x, y) for x, y in zip(s, t)], dtype=object)


def edit_ops(pairs: DataFrame, keep: Sequence[str] = ("pair_id",), src: str = "src_raw", tgt: str = "tgt_raw") -> DataFrame:
    """(keep..., idx, pos, kind, left, src, tgt): the runs of changed words of
    every pair in order.  ``pos`` is the source word at which the run stands,
    ``left`` the source word before it ('' at the beginning).  A pair with a
    null side, or with equal word lists, has none."""
    x = pairs.select(*keep, words(src).alias("_s"), words(tgt).alias("_t")).where(F.col("_s") != F.col("_t"))
    return x.select(*keep, F.inline(_changed_udf("_s", "_t")))


# ---- rules -----------------------------------------------------------------------

def _phrase(ws) -> F.Column:
    return F.array_join(ws, " ")


def _places(texts: DataFrame, group_cols: Sequence[str], max_phrase: int) -> DataFrame:
    """(group..., left, phrase, n): how often every phrase of up to
    ``max_phrase`` words (none: the place behind ``left``) stands in the texts."""
    left = lambda i: F.when(i == 0, F.lit("")).otherwise(F.get(F.col("_s"), i - 1))
    at = lambda i: F.transform(
        F.sequence(F.lit(0), F.least(F.lit(max_phrase), F.size("_s") - i)),
        lambda k: F.struct(left(i).alias("left"), _phrase(F.slice(F.col("_s"), i + 1, k)).alias("phrase")),
    )
    every = F.flatten(F.transform(F.sequence(F.lit(0), F.size("_s")), at))
    # null groups meet nothing; stated here, so the joins' own conditions add
    # nothing and both of them share one pass
    places = texts.select(*group_cols, F.inline(every))
    for c in (*group_cols, "left", "phrase"):
        places = places.where(F.col(c).isNotNull())
    return places.groupBy(*group_cols, "left", "phrase").agg(F.count(F.lit(1)).alias("n"))


def learn_rules(pairs: DataFrame, group_cols: Sequence[str] = (), min_support: int = 2, min_rate: float = 0.5,
                max_phrase: int = MAX_PHRASE) -> DataFrame:
    """(group..., left, phrase, to, hits, places, rate): what revisions make of
    a phrase behind the word ``left`` ('' at a text's beginning), or anywhere
    (``left`` null).  An empty phrase is an insertion behind ``left``, an empty
    ``to`` a deletion.  ``hits`` counts the most frequent outcome (the smallest
    of several), ``places`` the phrase's places in the sources; kept are rules
    with ``min_support`` hits in ``min_rate`` of the places."""
    g = list(group_cols)
    ops = edit_ops(pairs, g).where((F.size("src") <= max_phrase) & (F.size("tgt") <= max_phrase))
    ops = ops.select(*g, "left", _phrase(F.col("src")).alias("phrase"), _phrase(F.col("tgt")).alias("to"))
    # without context: any place but none in particular, so not for insertions
    contexts = F.explode(F.when(F.col("phrase") == "", F.array("left")).otherwise(F.array(F.col("left"), F.lit(None).cast("string"))))
    counted = ops.select(*g, contexts.alias("left"), "phrase", "to").groupBy(*g, "left", "phrase", "to").agg(F.count(F.lit(1)).alias("hits"))
    best = counted.groupBy(*g, "left", "phrase").agg(F.min(F.struct((-F.col("hits")).alias("h"), "to")).alias("b"))
    best = best.select(*g, "left", "phrase", F.col("b.to").alias("to"), (-F.col("b.h")).alias("hits")).where(F.col("hits") >= min_support)
    x = computed_once(pairs.select(*g, "src_raw"), _s=words("src_raw")).where(F.col("_s").isNotNull()).select(*g, "_s")
    exact = _places(x, g, max_phrase)
    # (no rule without context has an empty phrase)
    anywhere = exact.groupBy(*g, "phrase").agg(F.sum("n").alias("n"))
    found = best.where(F.col("left").isNotNull()).join(exact, [*g, "left", "phrase"]).select(*best.columns, "n")
    free = best.where(F.col("left").isNull()).join(anywhere, [*g, "phrase"]).select(*best.columns, "n")
    rules = found.unionByName(free).withColumn("rate", F.col("hits") / F.col("n"))
    return rules.where(F.col("rate") >= min_rate).select(*g, "left", "phrase", "to", "hits", F.col("n").alias("places"), "rate")


# ---- rewriting ---------------------------------------------------------------------

def _trie(keys, to) -> dict:
    """Rules as a tree of words; below the word None a node holds what its
    phrase becomes, by context (None: any)."""
    root: dict = {}
    for key, value in zip(keys, to):
        left, mark, phrase = key.rpartition(MARK)
        node = root
        for w in phrase.split(" ") if phrase else ():
            node = node.setdefault(w, {})
        node.setdefault(None, {})[left if mark else None] = value
    return root


def rewrite_by(text: str, keys, to) -> str:
    """One text by its rules: at each place the longest phrase that fits, with
    its context before without; then on behind it.  An insertion happens
    where no phrase fits.  Contexts are words of the text as it was."""
    root, ws, out, i = _trie(keys, to), text.split(), [], 0
    while i <= len(ws):
        left = ws[i - 1] if i else ""
        node, best, end = root, None, i
        for k in range(i, len(ws) + 1):
            becomes = node.get(None, {})
            for context in (left, None):
                if context in becomes and (k > i or context is not None):
                    best, end = becomes[context], k
                    break
            if k == len(ws) or ws[k] not in node:
                break
            node = node[ws[k]]
        if best:
            out.append(best)
        if end == i:
            out += ws[i : i + 1]
            end = i + 1
        i = end
    return " ".join(out)


@F.pandas_udf(T.StringType())
def _by_rules(text: pd.Series, keys: pd.Series, to: pd.Series) -> pd.Series:
    out = [t if t is None else rewrite_by(t, () if k is None else k, () if v is None else v) for t, k, v in zip(text, keys, to)]
    return pd.Series(out, dtype=object)


def _hashes(ws: list[str]) -> np.ndarray:
    code, distinct = pd.factorize(np.array(ws, dtype=object))
    return pd.util.hash_array(np.asarray(distinct, dtype=object), categorize=False)[code] if ws else np.zeros(0, np.uint64)


def _further(h, w):
    """Hash of a key one word longer."""
    h = (h ^ w) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _bits(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A key's two places in a map of ``bits`` (a power of two)."""
    return (h & np.uint64(bits - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


#: begins of keys: without context, and a text's beginning as the word before
ANYWHERE, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def _rule_bits(bits: int):
    def run(batches):
        for batch in batches:
            left, phrase = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            h = np.array([ANYWHERE if x is None else BEGIN if x == "" else 0 for x in left], np.uint64)
            words_ = [i for i, x in enumerate(left) if x]
            h[words_] = _hashes([left[i] for i in words_])
            phrases = [p.split(" ") if p else [] for p in phrase]
            for k in range(max(map(len, phrases), default=0)):
                longer = [i for i, p in enumerate(phrases) if len(p) > k]
                h[longer] = _further(h[longer], _hashes([phrases[i][k] for i in longer]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_bits(h, bits)))], names=["bit"])

    return run


def _rule_map(rules: DataFrame) -> np.ndarray:
    """Bits of the rules' keys, 32 or more to a rule: a map that tells nearly
    all keys without a rule.  Beyond 2**30 bits it only tells fewer."""
    bits = 1 << 16
    n = rules.count()
    while bits < min(32 * n, 1 << 30):
        bits *= 2
    places = rules.select("left", "phrase").where(F.col("phrase").isNotNull()).mapInArrow(_rule_bits(bits), "bit long")
    place = F.col("bit") + 1
    held = np.zeros(bits // 8, np.uint8)
    for r in (places.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("b"))
              .collect()):  # the map's bytes at most
        part = np.frombuffer(r["b"], np.uint8)
        at = (r["k"] - 1) * len(part)
        held[at : at + len(part)] = part[: len(held) - at]
    return held


def _candidates(held: bytes, max_phrase: int, chars: int = 1 << 20):
    """Of rows (columns..., text) the columns with each distinct key that may
    have a rule: a phrase of the text behind the word before it, or anywhere."""

    def found(texts: list[str]):
        bits = np.frombuffer(held, np.uint8)
        lists = [t.split() for t in texts]
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        start = np.cumsum(size) - size
        ws = list(chain.from_iterable(lists))
        h = _hashes(ws)
        # places: before every word and at the end of each text
        text = np.repeat(np.arange(len(lists)), size + 1)
        at = np.arange(len(text)) - text
        end = (start + size)[text]
        first = at == start[text]
        behind, anywhere = np.full(len(at), BEGIN), np.full(len(at), ANYWHERE)
        behind[~first] = h[at[~first] - 1]
        for k in range(max_phrase + 1):
            if k:
                fits = at + k <= end
                text, at, end, first, behind, anywhere = (x[fits] for x in (text, at, end, first, behind, anywhere))
                behind, anywhere = _further(behind, h[at + k - 1]), _further(anywhere, h[at + k - 1])
            for keys, context in ((behind, True), (anywhere, False))[: 2 if k else 1]:
                x, y = _bits(keys, 8 * len(bits))
                hit = np.flatnonzero((bits[x >> 3] >> (x & 7).astype(np.uint8)) & (bits[y >> 3] >> (y & 7).astype(np.uint8)) & 1)
                for row, i, begins in zip(text[hit].tolist(), at[hit].tolist(), first[hit].tolist()):
                    phrase = " ".join(ws[i : i + k])
                    yield row, ("" if begins else ws[i - 1]) + MARK + phrase if context else phrase

    def run(batches):
        for batch in batches:
            *names, text = batch.schema.names
            texts, lo = batch[text].to_pylist(), 0
            while lo < len(texts):
                hi, room = lo, chars
                while hi < len(texts) and (hi == lo or room > 0):
                    room -= len(texts[hi] or "")
                    hi += 1
                hits = sorted(set(found([t or "" for t in texts[lo:hi]])))
                rows = batch.select(names).slice(lo, hi - lo).take(pa.array([r for r, _ in hits], pa.int64()))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([k for _, k in hits], pa.string())], names=[*names, "word"])
                lo = hi

    return run


def apply_rules(df: DataFrame, rules: DataFrame, ids, text: str, out: str, match_cols: Sequence[str] = (),
                max_phrase: int = MAX_PHRASE) -> DataFrame:
    """Rewrite ``text`` by ``rules`` (left, phrase, to; ``match_cols`` must
    match too) into ``out``.  A row's distinct phrases, with the word before
    and without, are held against a map of the rules' hashes, and those that
    may have a rule are joined with the rules; only those that exist come back
    to the row, whose task builds a tree of them and goes through the text once.
    A null text stays null, a blank one becomes ''; ``ids`` must be unique."""
    key = F.when(F.col("left").isNull(), F.col("phrase")).otherwise(F.concat("left", F.lit(MARK), "phrase"))
    changes = rules.select(*match_cols, key.alias("word"), "to")
    own = list(dict.fromkeys([*([ids] if isinstance(ids, str) else ids), *match_cols]))
    schema = T.StructType([*df.select(*own).schema.fields, T.StructField("word", T.StringType())])
    texts = df.select(*own, F.col(text).alias("_text"))
    keys = texts.mapInArrow(_candidates(_rule_map(rules).tobytes(), max_phrase), schema)
    return rewrite_keyed(df, ids, keys, changes, {text: out}, _by_rules, match_cols)
