"""Toxicity by cumulative-link ordinal regression (operator 6).

P(grade > k) = sigmoid(w . x - t_k): one weight vector shared by all ordered
thresholds t_0 < t_1 < t_2.  x holds log(1 + count) of selected words, each known
by its 64-bit hash; a word is selected if labelled-toxic documents hold it far
more often than chance allows.  The labels say only toxic or not, so training
grades 1 to 3 of toxic documents come from how often selected words occur in
them.  The score is the expected severity, sum over k of P(grade > k)."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.common import WordHashes, map_texts, slim

TRAIN_ROWS = 20_000          # labelled documents the model is fitted on, at most (about)
MAX_WORDS = 1 << 14          # selected words, at most: a feature bound
MIN_DOCS, MIN_Z = 4, 5.0
GRADE_FROM = (3, 6)          # occurrences from which a toxic document has grade 2, 3
GRADES = 3
RIDGE, ROUNDS, RATE = 1e-4, 400, 0.3
TOXIC_FROM = 0.5             # expected severity
_WORDS = re.compile(r"\w+").findall


def counts(known: WordHashes, text: str) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(known.array(_WORDS(text.lower())), return_counts=True)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class OrdinalModel:
    """Word hashes (sorted), their weights, ordered thresholds."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.words, self.weights, self.thresholds = words, weights, thresholds

    def linear(self, words: np.ndarray, n: np.ndarray) -> float:
        if not len(self.words) or not len(words):
            return 0.0
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        hit = self.words[at] == words
        return float((self.weights[at[hit]] * np.log1p(n[hit])).sum())

    def expected(self, z) -> np.ndarray:
        return _sigmoid(np.asarray(z)[:, None] - self.thresholds[None, :]).sum(axis=1)


def fit_ordinal(words: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], grade: np.ndarray) -> OrdinalModel:
    """Full-batch fit on rows of (places in ``words``, log counts); thresholds
    stay ordered because their gaps are exponentials."""
    if not len(rows) or grade.max() == 0:
        return OrdinalModel(words[:0], np.zeros(0), np.full(GRADES, 30.0))
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    at = np.concatenate([r[0] for r in rows]).astype(np.int64)
    x = np.concatenate([r[1] for r in rows])
    above = grade[:, None] > np.arange(GRADES)[None, :]
    weight = np.where(grade > 0, 0.5 / max(1, (grade > 0).sum()), 0.5 / max(1, (grade == 0).sum()))[:, None]
    p = np.concatenate([np.zeros(len(words)), [1.0], np.zeros(GRADES - 1)])
    m, v = np.zeros_like(p), np.zeros_like(p)
    k = len(words)
    for step in range(1, ROUNDS + 1):
        gaps = np.exp(p[k + 1 :])
        t = p[k] + np.concatenate([[0.0], np.cumsum(gaps)])
        z = np.bincount(owner, x * p[at], len(rows))
        error = weight * (_sigmoid(z[:, None] - t[None, :]) - above)
        per = error.sum(axis=0)
        tail = np.cumsum(per[::-1])[::-1]
        g = np.concatenate([np.bincount(at, x * error.sum(axis=1)[owner], k) + RIDGE * p[:k], [-per.sum()], -tail[1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9) / (1 + step / 100)
    gaps = np.exp(p[k + 1 :])
    return OrdinalModel(words, p[:k], p[k] + np.concatenate([[0.0], np.cumsum(gaps)]))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> OrdinalModel:
    """Fit on about ``train_rows`` labelled documents, one per distinct text;
    of several labels of an id or a text the highest counts.  ``labels``:
    doc_id, toxic (0 or 1; null rows are left out)."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = known.count()
    dice = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 20))
    picked = known.where(dice < int((1 << 20) * min(1.0, train_rows / max(1, total))))
    # at most about train_rows rows: the bound is the parameter
    rows = docs.join(F.broadcast(picked), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))

    def spread(batches):
        h = WordHashes()
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w, _ = counts(h, text)
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(np.full(len(w), toxic, np.int32))], names=["w", "toxic"])

    base = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).first()
    n, t = base["n"], base["t"] or 0
    if not n or not t or t == n:
        return OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.full(GRADES, 30.0))
    p = t / n
    z = (F.col("t") - F.col("n") * p) / F.sqrt(F.col("n") * (p * (1 - p)))
    chosen = (rows.mapInArrow(spread, "w long, toxic int").groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t"))
              .where((F.col("n") >= MIN_DOCS) & (z >= MIN_Z)).orderBy(F.desc(z), "w").limit(MAX_WORDS).select("w").collect())
    words = np.sort(np.asarray([r["w"] for r in chosen], np.int64).view(np.uint64))

    def select(batches):
        h = WordHashes()
        for b in batches:
            at, n_, toxic = [], [], []
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w, c = counts(h, text)
                pos = np.minimum(np.searchsorted(words, w), max(0, len(words) - 1))
                hit = words[pos] == w if len(words) else np.zeros(len(w), bool)
                at.append(pos[hit].astype(np.int64))
                n_.append(c[hit].astype(np.int64))
                toxic.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.list_(pa.int64())), pa.array(n_, pa.list_(pa.int64())), pa.array(toxic, pa.int32())],
                                             names=["at", "n", "toxic"])

    got = rows.mapInArrow(select, "at array<long>, n array<long>, toxic int").collect()  # about train_rows rows of selected words
    got = sorted((tuple(r["at"]), tuple(r["n"]), r["toxic"]) for r in got)
    feats = [(np.asarray(a, np.int64), np.log1p(np.asarray(c, np.float64))) for a, c, _ in got]
    many = np.asarray([sum(c) for _, c, _ in got])
    grade = np.where([y > 0 for *_, y in got], 1 + sum((many >= g).astype(int) for g in GRADE_FROM), 0)
    return fit_ordinal(words, feats, grade)


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             toxic_from: float = TOXIC_FROM, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per input row: doc_id, severity (expected grade, 0 to 3),
    grade (the most probable), toxic (severity >= toxic_from).

    Null and empty texts score as texts without any selected word; a null id
    stays null; repeated rows get equal scores; other columns are ignored; an
    empty table gives no rows.  Without labels of both kinds nothing is
    toxic."""
    docs = slim(df, id_col, text_col)
    model = train(docs, labels.select("doc_id", "toxic"), train_rows)

    def make():
        known = WordHashes()

        def fn(ids, texts):
            z = np.asarray([model.linear(*counts(known, t)) for t in texts])
            above = _sigmoid(z[:, None] - model.thresholds[None, :])
            each = np.concatenate([np.ones((len(z), 1)), above], axis=1) - np.concatenate([above, np.zeros((len(z), 1))], axis=1)
            s = above.sum(axis=1)
            return [ids, s, each.argmax(axis=1).astype(np.int32), s >= toxic_from]

        return fn

    return map_texts(docs, make, "doc_id long, severity double, grade int, toxic boolean")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    d = sf_dir.rstrip("/")
    return toxicity(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
