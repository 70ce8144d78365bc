"""Whitening of embedding vectors (11).

Each task takes its distinct vectors one by one into the eigenpairs of their
centred scatter, by rank-one updates (``spectra``); the tasks' spectra are
combined, sixteen to one, by successive rank-one updates; the combined basis
is refined by Rayleigh-Ritz: the exact covariance, summed over the tasks in
that basis, is diagonalised and turns the basis.

Defined results:
* a row whose vector is null, or holds a null, NaN or infinite entry, is
  left out; an empty vector has no components, hence no rows;
* vectors of different length live in spaces of their own: each length has
  its fit list, components and count;
* repeated vectors count once in the fit; each row gets its own result, rows
  with repeated or null ids included;
* a component without variance (eigenvalue not above the rounding of the
  largest) cannot be whitened and has no rows; fewer than 16 dimensions give
  fewer components; an empty table gives no rows;
* entries beyond +-1.4e17 are clamped there, ``deviation`` is null where it
  exceeds a long;
* equal eigenvalues have no order of their own: any basis of their space is
  right.

State per task and the whole model are d*d doubles for vectors of length d,
whatever the number of rows; nothing else reaches the driver."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom.llm.common import stored
from pairloom.llm.spectra import EPS, Spectrum, orthonormal

#: the fixed-point grid of the entries: x = floor(SCALE * c) + BASE
SCALE, BASE = 64, 1_000_000

#: entries are clamped to +-REACH before they become longs
REACH = 9.0e18

#: spectra that one task combines
FAN_IN = 16

#: passes of Rayleigh-Ritz at most, and the correlation between components
#: (off-diagonal over the diagonals' geometric mean) at which they end
PASSES, SETTLED = 4, 1e-10

#: eigenvalues up to RANK * d * EPS times the largest count as none
RANK = 64

COMPONENTS = 16
INT64 = 1 << 62

_STATE = "dim int, node long, n long, sums array<decimal(38,0)>, mean array<double>, vals array<double>, vecs array<double>"
_ROWS = "vec_id long, component int, n long, deviation long, whitened double, explained double"


def grid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x) of the rows with a whole finite vector."""
    c = F.col("v")
    rows = df.select(df[id_col].cast("long").alias("vec_id"), df[vector_col].cast("array<double>").alias("v"))
    rows = rows.where(c.isNotNull() & (F.size(c) > 0) & ~F.exists(c, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    far = F.lit(REACH)
    x = F.transform(c, lambda e: F.floor(F.least(F.greatest(e * SCALE, -far), far)).cast("long") + F.lit(BASE).cast("long"))
    return rows.select("vec_id", x.alias("x"))


def blocks_of(column: pa.Array):
    """The arrays of one column by length: (length, places, int64 matrix)."""
    lengths = np.asarray(column.value_lengths())
    for dim in np.unique(lengths):
        at = np.flatnonzero(lengths == dim)
        part = column if at.size == len(column) else column.take(pa.array(at))
        yield int(dim), at, part.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def exact_sum(x: np.ndarray) -> list[int]:
    """Column sums as Python integers, without overflow."""
    if x.size and max(abs(int(x.min())), abs(int(x.max()))) >= INT64 // len(x):
        x = x.astype(object)
    return [int(s) for s in x.sum(0)]


def _state(dim, node, n, sums, spectrum):
    return {"dim": dim, "node": node, "n": n, "sums": sums, "mean": spectrum.mean, "vals": spectrum.values, "vecs": spectrum.vectors.ravel()}


def _decimals(sums: list[int]):
    import decimal

    return [decimal.Decimal(s) for s in sums]


def local_spectra(fit: DataFrame) -> DataFrame:
    """One state per task and length: count, exact sums, and the spectrum
    grown by one centred rank-one update per vector."""

    def run(batches):
        from pyspark import TaskContext

        seen, sums = {}, {}
        for batch in batches:
            for dim, _, x in blocks_of(batch.column(0)):
                spectrum = seen.setdefault(dim, Spectrum(dim))
                sums[dim] = [a + b for a, b in zip(sums.get(dim, [0] * dim), exact_sum(x))]
                for row in (x - BASE).astype(float):
                    spectrum.add(row)
        node = TaskContext.get().partitionId()
        if seen:
            yield pd.DataFrame([_state(d, node, s.n, _decimals(sums[d]), s) for d, s in seen.items()])

    def arrow(batches):
        for table in run(batches):
            yield pa.RecordBatch.from_pandas(table, schema=schema, preserve_index=False)

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(fit.sparkSession.createDataFrame([], _STATE).schema)
    return fit.mapInArrow(arrow, _STATE)


def combine(states: DataFrame) -> DataFrame:
    """One state per length: groups of FAN_IN states become one, level by
    level, so no task holds more than FAN_IN of them."""

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        dim, total, sums = int(group["dim"].iloc[0]), None, None
        for row in group.itertuples():
            one = Spectrum(dim, int(row.n), np.array(row.mean), np.array(row.vals), np.array(row.vecs).reshape(dim, dim))
            if total is None:
                total, sums = one, list(row.sums)
            else:
                total.merge(one)
                sums = [a + b for a, b in zip(sums, row.sums)]
        return pd.DataFrame([_state(dim, int(group["node"].iloc[0]) // FAN_IN, total.n, sums, total)])

    states = stored(states, "spectra")
    while (states.agg(F.max("node")).first()[0] or 0) > 0:
        states = stored(states.groupBy("dim", F.expr(f"node div {FAN_IN}").alias("up")).applyInPandas(merged, _STATE), "spectra")
    return states


def centred(x: np.ndarray, n: int, sums: list[int]):
    """x - S/n in doubles, without the loss that large means bring: the whole
    part is taken off as integers, the rest as a fraction below one."""
    whole = [s // n for s in sums]
    rest = np.array([(s - n * w) / n for s, w in zip(sums, whole)])
    if max(map(abs, whole), default=0) >= INT64 or (x.size and int(np.abs(x).max()) >= INT64):
        x = x.astype(object)
        whole = np.array(whole, dtype=object)
    else:
        whole = np.array(whole, dtype=np.int64)
    return (x - whole).astype(float) - rest


def _moments(fit: DataFrame, bases: dict) -> dict:
    """For each length the covariance of the centred vectors in ``bases``
    ({length: (n, sums, matrix)}), summed over the tasks."""

    def run(batches):
        sums = {}
        for batch in batches:
            for dim, _, x in blocks_of(batch.column(0)):
                if dim not in bases:
                    continue
                n, s, a = bases[dim]
                y = centred(x, n, s) @ a
                sums[dim] = sums.get(dim, 0) + y.T @ y
        for dim, m in sums.items():
            at = np.arange(m.size, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, dim, np.int32)), pa.array(at), pa.array(m.ravel())], names=["dim", "at", "part"])

    parts = fit.mapInArrow(run, "dim int, at int, part double").groupBy("dim", "at").agg(F.sum("part").alias("part"))
    found = {dim: np.zeros((a.shape[1], a.shape[1])) for dim, (_, _, a) in bases.items()}
    for dim, at, part in parts.collect():  # one entry of a matrix each
        found[dim].flat[at] = part / bases[dim][0]
    return found


def _refined(fit: DataFrame, model: dict) -> dict:
    """Rayleigh-Ritz in the whole combined basis until the components are
    uncorrelated: {length: (n, sums, eigenvalues falling, vectors)}."""
    out = {}
    for _ in range(PASSES):
        moments = _moments(fit, model)
        for dim, (n, sums, u) in list(model.items()):
            h = (moments[dim] + moments[dim].T) / 2
            size = np.sqrt(np.maximum(np.diag(h), RANK * dim * EPS * max(np.diag(h).max(), 0)))
            size[size == 0] = 1
            left = np.abs(h / np.outer(size, size) - np.diag(np.diag(h) / size**2)).max()
            values, w = np.linalg.eigh(h)
            u = orthonormal(u @ w[:, ::-1])
            u = u * np.where(u[np.abs(u).argmax(0), np.arange(dim)] < 0, -1.0, 1.0)
            out[dim] = (n, sums, values[::-1], u, float(np.trace(h)))
            model[dim] = (n, sums, u)
            if left <= SETTLED:
                del model[dim]
        if not model:
            break
    return out


class Whitening:
    """A fitted whitening: {length: (n, sums, eigenvalues, vectors, trace)}."""

    def __init__(self, spaces: dict, components: int):
        self.projections = {}
        for dim, (n, sums, values, u, trace) in spaces.items():
            keep = min(components, int((values > RANK * dim * EPS * max(values[0], 0)).sum()))
            if keep:
                self.projections[dim] = (n, sums, u[:, :keep] / np.sqrt(values[:keep]), values[:keep] / trace)
        #: largest entry of the whitened covariance minus the identity
        self.identity_error = None

    def check(self, fit: DataFrame) -> float | None:
        bases = {dim: (n, sums, a) for dim, (n, sums, a, _) in self.projections.items()}
        if bases:
            self.identity_error = max(float(np.abs(m - np.eye(len(m))).max()) for m in _moments(fit, bases).values())
        return self.identity_error

    def apply(self, rows: DataFrame) -> DataFrame:
        """One row per (vec_id, x) row and component."""
        spaces = self.projections

        def run(batches):
            for batch in batches:
                for dim, at, x in blocks_of(batch.column(1)):
                    if dim not in spaces:
                        continue
                    n, sums, a, explained = spaces[dim]
                    k = a.shape[1]
                    y = centred(x, n, sums) @ a
                    ids = batch.column(0).take(pa.array(np.repeat(at, k)))
                    far = pa.array(np.repeat(deviation(x, n, sums), k), type=pa.int64(), from_pandas=True)
                    rows = len(at)
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, n)),
                         far, pa.array(y.ravel()), pa.array(np.tile(explained, rows))],
                        names=["vec_id", "component", "n", "deviation", "whitened", "explained"])

        found = rows.select("vec_id", "x").mapInArrow(run, _ROWS)
        return found.withColumn("identity_error", F.lit(self.identity_error).cast("double"))


def deviation(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """The exact sum over the dimensions of (n*x - S)^2 per row, as objects;
    None beyond a long."""
    whole = [s // n for s in sums]
    rest = [s - n * w for s, w in zip(sums, whole)]
    far = max((abs(int(v)) for v in (x.min(0, initial=0), x.max(0, initial=0)) for v in v), default=0) + max(map(abs, whole), default=0)
    most = n * max((max(int(hi) - w, w - int(lo)) for lo, hi, w in zip(x.min(0), x.max(0), whole)), default=0) + n if len(x) else 0
    if far < INT64 and most * most * x.shape[1] < INT64:
        off = (x - np.array(whole, dtype=np.int64)) * n - np.array(rest, dtype=np.int64)
        return (off * off).sum(1).astype(object)
    off = (x.astype(object) - np.array(whole, dtype=object)) * n - np.array(rest, dtype=object)
    found = (off * off).sum(1)
    return np.array([v if v < 1 << 63 else None for v in found], dtype=object)


def fit_whitening(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Fit on each distinct x of (vec_id, x) rows once."""
    fit = stored(rows.select("x").distinct(), "whitening-fit")
    states = combine(local_spectra(fit)).collect()  # one of d*d doubles per length of the vectors
    model = {r["dim"]: (r["n"], [int(s) for s in r["sums"]], orthonormal(np.array(r["vecs"]).reshape(r["dim"], r["dim"]))) for r in states}
    found = Whitening(_refined(fit, model), components)
    found.check(fit)
    return found


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Whitened components of every row with a whole finite vector."""
    rows = grid(df, id_col, vector_col)
    return fit_whitening(rows, components).apply(rows)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"))
