"""Content preservation (U7, A4): greedy-matching similarity F1 (the
published BERTScore definition) over word vectors.

Each word maps to a vector of an embedding table (hash of the word modulo
the table size: a deterministic stand-in, not a semantic space).  For a
candidate c and reference r: P = mean over candidate words of the best
cosine with any reference word, R the mirror, F1 = 2PR / (P + R), and 0
when a side has no vectors or P + R = 0.

Words with one vector share one maximum, so each side is reduced to vectors
and their multiplicities.  Rows are dealt to groups by a hash of their ids and
their texts go with them; a group is joined (as a cogroup) with the vectors that
its words name, each vector once per group and not once per text.  Words are
counted inside the task, and the cosine matrix of a pair is computed there in
tiles, so no (text, word) and no (word, word) rows are ever shuffled and a pair
of any size needs one tile besides its own vectors.  The number of groups
follows the length of the texts.

Only non-null vectors without null elements and other than zero count;
of several vectors with one id the smallest (element by element) does.  A
word whose vector does not count is left out of its text."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import hash_key, words

TILE = 1024
#: words that a group holds on average; the larger, the fewer groups a vector goes to
GROUP_ROWS = 1 << 19
#: that of ``hash_key``
SEED = 42


def usable_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, e): one vector per id, without nulls and not all zero."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    e = embeddings.where(F.col("vec_id").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0))
    return e.groupBy("vec_id").agg(F.min("embedding").alias("e"))


def _units(vectors) -> np.ndarray:
    m = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _best(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best cosine of every row of ``a`` in ``b`` and the mirror, tile by tile."""
    best_a, best_b = np.full(len(a), -np.inf), np.full(len(b), -np.inf)
    for i in range(0, len(a), TILE):
        for j in range(0, len(b), TILE):
            sim = a[i : i + TILE] @ b[j : j + TILE].T
            np.maximum(best_a[i : i + TILE], sim.max(axis=1), out=best_a[i : i + TILE])
            np.maximum(best_b[j : j + TILE], sim.max(axis=0), out=best_b[j : j + TILE])
    return best_a, best_b


def _greedy(a, wa, b, wb) -> tuple[float, float, float]:
    """Scores of one pair from both sides' unit vectors and multiplicities."""
    if len(a) == 0 or len(b) == 0:
        return 0.0, 0.0, 0.0
    best_a, best_b = _best(a, b)
    p = float((wa * best_a).sum() / wa.sum())
    r = float((wb * best_b).sum() / wb.sum())
    return p, r, 2 * p * r / (p + r) if p + r != 0 else 0.0


class _Places(dict):
    """Where the vector of a word stands among a group's vectors, -1 if it has
    none; worked out once per distinct word, as ``hash_key`` does."""

    def __init__(self, known, size: int):
        super().__init__()
        self.at, self.size = {v: i for i, v in enumerate(known)}, size

    def __missing__(self, word: str) -> int:
        digest = hashlib.md5(f"{SEED}:{word}".encode()).digest()
        place = self[word] = self.at.get(int.from_bytes(digest[:4], "big") % self.size, -1)
        return place


def _counted(texts, places: _Places) -> tuple[np.ndarray, np.ndarray]:
    """(places in ascending order, multiplicities) of the vectors of texts."""
    words_ = Counter()
    for t in texts:
        if t is not None:
            words_.update(t.split())  # the word rule of C1
    at = np.fromiter(map(places.__getitem__, words_), np.int64, len(words_))
    k = np.fromiter(words_.values(), float, len(words_))
    at, inverse = np.unique(at[there := at >= 0], return_inverse=True)
    return at, np.bincount(inverse, weights=k[there], minlength=len(at))


def _group_scores(rows: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
    """(_row, p, r, f1) of one group: rows (_row, _cand, _ref, _size) and the
    vectors (_vec, e) that their words name.  Rows of one id are one row."""
    if rows.empty or vectors.empty:
        return pd.DataFrame({"_row": pd.Series(dtype=object), "p": [], "r": [], "f1": []})
    vectors = vectors.sort_values("_vec")
    places, units = _Places(vectors["_vec"].tolist(), int(rows["_size"].iloc[0])), _units(vectors["e"])
    texts: dict[str, list] = {}
    for row, cand, ref in zip(rows["_row"], rows["_cand"], rows["_ref"]):
        texts.setdefault(row, []).append((cand, ref))
    out = []
    for row, sides in texts.items():
        (a, wa), (b, wb) = (_counted(side, places) for side in zip(*sides))
        out.append((row, *_greedy(units[a], wa, units[b], wb)))
    return pd.DataFrame(out, columns=["_row", "p", "r", "f1"])


def content_f1(df: DataFrame, embeddings: DataFrame, id_cols, cand: str, ref: str, group_rows: int = GROUP_ROWS,
               source: DataFrame | None = None) -> DataFrame:
    """Adds p, r, f1 (candidate ``cand`` against reference ``ref``) to
    every row of ``df``, in place of columns of these names; ``id_cols``
    identify a row.  All vectors have one length.  ``source`` has the same ids
    and texts, where ``df`` is a plan with more columns that is not to be run
    again for the words."""
    source = df if source is None else source
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    # the ids as one text, nulls told from any value: the cogroup carries it
    row = F.to_json(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(ids)]))
    size = embeddings.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    # about 5 characters and a blank a word, known without a pass over the words
    length = F.coalesce(F.length(cand), F.lit(0)) + F.coalesce(F.length(ref), F.lit(0))
    groups = source.agg(F.greatest(F.lit(1), F.ceil(F.sum(length.cast("long")) / (6 * group_rows))).alias("g")).select("g").scalar()
    texts = source.select(row.alias("_row"), F.col(cand).alias("_cand"), F.col(ref).alias("_ref"), size.alias("_size"))
    # dealt once, the words of a group are made distinct where they lie
    dealt = texts.select("*", F.pmod(F.xxhash64("_row"), F.coalesce(groups, F.lit(1))).alias("_g")).repartition("_g")
    none = F.array().cast("array<string>")
    both = F.array_distinct(F.concat(F.coalesce(words("_cand"), none), F.coalesce(words("_ref"), none)))
    # (outer, and with the ids asked for, it reads what the cogroup reads: one shuffle for both)
    named = dealt.select("_g", "_size", "_row", F.explode_outer(both).alias("_word"))
    named = named.groupBy("_g", "_size", "_word").agg(F.count("_row").alias("_k")).where(F.col("_k") > 0)
    wanted = named.where(F.col("_word").isNotNull()).select(F.col("_g").alias("_h"), F.pmod(hash_key("_word"), F.col("_size")).alias("_vec")).distinct()
    vecs = wanted.join(usable_vectors(embeddings), F.col("_vec") == F.col("vec_id")).select("_h", "_vec", "e")
    scored = dealt.groupBy("_g").cogroup(vecs.groupBy("_h")).applyInPandas(_group_scores, "_row string, p double, r double, f1 double")
    out = df.drop("p", "r", "f1").withColumn("_row", row).join(scored, "_row", "left").drop("_row")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("p", "r", "f1")})
