"""Iterative style judge (U4 with the D2 validation side): logistic
regression on hashed words, trained by full-batch gradient steps.

A text's features are its words, hashed into ``dim`` places and weighted by one
over the number of words.  They are prepared once, row by row, and written.
An epoch is one job: every task adds up the gradient and the losses of its
rows for the current weights, one aggregate sums them, and the driver, which
holds ``dim`` weights and nothing that grows with the data, takes the step.
The same pass scores the validation rows, so the loss and the accuracy of each
epoch come without a further job.

A text without words has only the bias; null labels and texts are left out;
probability one half is class 0 (the tie rule of the other judge)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import hash_key, words
from pairloom.session import materialized

DIM = 1 << 14


def features(df: DataFrame, keep, text: str = "text", dim: int = DIM) -> DataFrame:
    """(keep..., f): the hashed places of the words of each text."""
    f = F.transform(words(text), lambda w: F.pmod(hash_key(w), F.lit(dim)).cast("int"))
    return df.where(F.col(text).isNotNull()).select(*keep, f.alias("f"))


def _margins(column, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per row of a list column: the score without bias; and the places, their
    rows and the words per row."""
    n = np.asarray(column.value_lengths().fill_null(0))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(n)), n)
    total = np.bincount(row, weights[flat], len(n)) if len(flat) else np.zeros(len(n))
    return total / np.maximum(n, 1), flat, row, n


@dataclass
class LinearJudge:
    weights: np.ndarray
    bias: float

    def score(self, df: DataFrame, keep, text: str = "text") -> DataFrame:
        """(keep..., probability, style): class 1 above one half."""
        weights, bias = self.weights, self.bias
        x = features(df, keep, text, len(weights))

        def run(batches):
            for b in batches:
                z = _margins(b.column("f"), weights)[0] + bias
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(1 / (1 + np.exp(-z)))], names=[*keep, "probability"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema.fields[:-1])
        out = x.mapInArrow(run, f"{schema}, probability double")
        return out.withColumn("style", (F.col("probability") > 0.5).cast("int"))


#: sums of a pass besides the gradient, at the places behind it
SUMS = ("bias", "train_rows", "train_loss", "val_rows", "val_loss", "val_right")


def _pass(x: DataFrame, judge: LinearJudge) -> np.ndarray:
    """Gradient and sums over all rows (label, val, f) for one set of weights."""
    weights, bias, dim = judge.weights, judge.bias, len(judge.weights)

    def run(batches):
        total = np.zeros(dim + len(SUMS))
        for b in batches:
            z, flat, row, n = _margins(b.column("f"), weights)
            z = z + bias
            y = np.asarray(b.column("label"), dtype=float)
            val = np.asarray(b.column("val"), dtype=bool)
            loss = np.logaddexp(0, np.where(y == 1, -z, z))
            error = np.where(val, 0.0, 1 / (1 + np.exp(-z)) - y)
            if len(flat):
                total[:dim] += np.bincount(flat, (error / np.maximum(n, 1))[row], dim)
            total[dim:] += [error.sum(), (~val).sum(), loss[~val].sum(), val.sum(), loss[val].sum(), ((z > 0) == (y == 1))[val].sum()]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "part"])

    parts = x.select("label", "val", "f").mapInArrow(run, "at long, part double")
    out = np.zeros(dim + len(SUMS))
    for at, part in parts.groupBy("at").agg(F.sum("part").alias("part")).collect():  # dim rows at most
        out[at] = part
    return out


def train_linear(labelled: DataFrame, val, text: str = "text", label: str = "label", epochs: int = 2, rate: float = 20.0,
                 dim: int = DIM) -> tuple[LinearJudge, list[dict]]:
    """The judge after ``epochs`` steps, and for each epoch (0: before the
    first) the losses of both sides and the accuracy on the validation side,
    which are the rows where the condition ``val`` holds.  A side without rows
    has null figures; without training rows the weights stay zero."""
    rows = labelled.where(F.col(label).isNotNull()).withColumns({"label": F.col(label).cast("int"), "val": F.coalesce(val, F.lit(False))})
    x = materialized(features(rows, ["label", "val"], text, dim), "judge-features")
    judge, history = LinearJudge(np.zeros(dim), 0.0), []
    for epoch in range(epochs + 1):
        sums = _pass(x, judge)
        s = dict(zip(SUMS, sums[dim:].tolist()))
        mean = lambda part, n: s[part] / s[n] if s[n] else None
        history.append({"epoch": epoch, "train_loss": mean("train_loss", "train_rows"), "val_loss": mean("val_loss", "val_rows"),
                        "val_accuracy": mean("val_right", "val_rows")})
        if epoch < epochs and s["train_rows"]:
            judge = LinearJudge(judge.weights - rate * sums[:dim] / s["train_rows"], judge.bias - rate * s["bias"] / s["train_rows"])
    return judge, history
