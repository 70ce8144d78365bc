"""Quality classifier from weak labels (operator 2).

Heuristic labellers vote on every document; EM (`weak_labels`) estimates how
far to trust each and gives every document a posterior; a hashed linear scorer
is trained on the posteriors of a bounded sample and scores all documents.
The scorer sees hashed words, endings and shapes, not the heuristics' counts."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.common import CACHE_ENTRIES, map_texts, slim, stored, words_of
from pairloom.llm.weak_labels import LabelModel, fit

DIMS = 1 << 16
TRAIN_ROWS = 8_000           # documents the scorer is fitted on, at most (about)
ROUNDS, RATE, DECAY = 80, 2.0, 1e-6
SCALE = 20.0                 # mean weights of a text are multiplied by this
SYMBOLS = "#*$%&|<>"
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
RULES = ["l_symbols", "l_upper", "l_exclaim", "l_lines", "l_variety", "l_echo", "l_length"]
VOTES = "doc_id long, " + ", ".join(f"{r} int" for r in RULES)


def _low(x: float, bad: float, good: float):
    return 0 if x >= bad else 1 if x <= good else None


def label(text: str) -> list:
    """Votes of the labellers on one text: 1 good, 0 bad, None abstains."""
    w = words_of(text)
    n = len(w)
    if not n:
        return [None] * (len(RULES) - 1) + [0]
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        _low(sum(map(text.count, SYMBOLS)) / n, 0.10, 0.02),
        _low(sum(map(bytes.isupper, w)) / n, 0.40, 0.15),
        _low(text.count("!") / n, 0.30, 0.10),
        _low(1 - len(set(lines)) / len(lines), 0.50, 0.20) if len(lines) > 2 else None,
        _low(1 - len(set(w)) / n, 0.90, 0.60) if n >= 30 else None,
        _low(sum(map(bytes.__eq__, w, w[1:])) / n, 0.20, 0.05),
        0 if n < 20 else None,
    ]


class Features(dict):
    """Row of each word in a table of its hashed features: the word, its
    ending, its shape."""

    def __init__(self):
        super().__init__()
        self.table = np.empty((CACHE_ENTRIES, 3), np.int32)
        self.hashes: dict[tuple, int] = {}

    def __missing__(self, word: bytes) -> int:
        text = word.decode()
        ending, shape = text[-3:], ("A" if word.isupper() else "a") + text.rstrip(LETTERS)[-3:]
        row, hashes = len(self), self.hashes
        for kind, x in enumerate((ending, shape)):
            if (kind, x) not in hashes:
                if len(hashes) >= CACHE_ENTRIES:
                    hashes.clear()
                hashes[kind, x] = xxhash.xxh3_64_intdigest(x, seed=kind + 1) % DIMS
            self.table[row, kind + 1] = hashes[kind, x]
        self.table[row, 0] = xxhash.xxh3_64_intdigest(word) % DIMS
        self[word] = row
        return row

    def of(self, text: str) -> np.ndarray:
        """Feature indices of a text, with multiplicity; a word equal to the
        one before it adds one more of its own kind."""
        w = words_of(text)
        parts = []
        for at in range(0, len(w), CACHE_ENTRIES // 2):
            some = w[at : at + CACHE_ENTRIES // 2]
            if len(self) + len(some) > CACHE_ENTRIES:
                self.clear()
            parts.append(self.table[np.fromiter(map(self.__getitem__, some), np.int64, len(some))].ravel())
        parts.append(np.full(sum(map(bytes.__eq__, w, w[1:])), 7, np.int32))
        return np.concatenate(parts)


def train(rows: list[np.ndarray], target: np.ndarray) -> np.ndarray:
    """Weights (the last is the constant) of a logistic scorer on soft
    targets, by full-batch adaptive gradient steps."""
    if not rows:
        return np.zeros(DIMS + 1)
    flat, owner = [], []
    for i, idx in enumerate(rows):
        u, c = np.unique(idx, return_counts=True)
        flat.append((u, SCALE * c / max(1, len(idx))))
        owner.append(np.full(len(u), i))
    u, x, owner = np.concatenate([f[0] for f in flat]), np.concatenate([f[1] for f in flat]), np.concatenate(owner)
    good = max(1e-6, float(target.sum()))
    weight = np.where(target > 0.5, 0.5 / good, 0.5 / max(1e-6, len(target) - good))  # both sides count alike
    w, total = np.zeros(DIMS + 1), np.full(DIMS + 1, 1e-8)
    for _ in range(ROUNDS):
        z = np.bincount(owner, x * w[u], len(rows)) + w[DIMS]
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target)
        g = np.append(np.bincount(u, x * error[owner], DIMS), error.sum()) + DECAY * w
        total += g * g
        w -= RATE * 0.1 * g / np.sqrt(total)
    return w


def vote(docs: DataFrame) -> DataFrame:
    def make():
        return lambda ids, texts: [ids, *map(list, zip(*map(label, texts)))]

    return map_texts(docs, make, VOTES)


def train_scorer(docs: DataFrame, votes: DataFrame, model: LabelModel, train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Fit on about ``train_rows`` documents, half of them (if there are so
    many) probably bad ones, picked by a hash of the id."""
    soft = votes.where("doc_id is not null").select("doc_id", model.posterior().alias("p"))
    sides = {r["good"]: r["n"] for r in soft.groupBy((F.col("p") >= 0.5).alias("good")).agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {g: min(1.0, train_rows / 2 / n) for g, n in sides.items()}
    dice = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)) / float(1 << 20)
    picked = soft.where(dice < F.when(F.col("p") >= 0.5, share.get(True, 0.0)).otherwise(share.get(False, 0.0))).dropDuplicates(["doc_id"])
    # at most about train_rows ids: the bound is the parameter
    rows = docs.join(F.broadcast(picked), "doc_id").select(F.lit(1).alias("all_"), "text", "p")

    def fit_task(table: pa.Table) -> pa.Table:
        feats = Features()
        w = train([feats.of(t) for t in table["text"].to_pylist()], np.asarray(table["p"]))
        return pa.table({"w": pa.array([w.tobytes()], pa.binary())})

    got = rows.groupBy("all_").applyInArrow(fit_task, "w binary").collect()  # one row of 512 KB
    return np.frombuffer(got[0]["w"]) if got else np.zeros(DIMS + 1)


def quality_classifier(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_from: float = 0.5,
                       train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per input row: doc_id, score (probability of good), kept.

    Null and empty texts have no features and are not kept (score 0); a null
    id stays null (such rows are scored but not trained on); repeated rows get
    equal scores; other columns are ignored; an empty table gives no rows.
    If all posteriors fall on one side the scorer only knows that side."""
    docs = slim(df, id_col, text_col)
    votes = stored(vote(docs), "votes")
    w = train_scorer(docs, votes, fit(votes, RULES), train_rows)

    def make():
        feats = Features()

        def fn(ids, texts):
            idx = [feats.of(t) for t in texts]
            z = np.asarray([SCALE * float(w[i].mean()) + w[DIMS] if len(i) else -np.inf for i in idx])
            with np.errstate(over="ignore"):
                s = 1 / (1 + np.exp(-z))
            return [ids, s, s >= keep_from]

        return fn

    return map_texts(docs, make, "doc_id long, score double, kept boolean")


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return quality_classifier(spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"))
