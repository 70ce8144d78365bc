"""Exact, deterministic splits and samples (D1-D4) and dense ids.

Every row gets the sort key (md5-derived 32-bit hash of seed and id, id).
A global rank over that key is computed without a single-partition sort:
rows are grouped by the top ``bits`` of the hash, the per-bucket counts
(at most 2**bits rows, a proven bound, so they are broadcast) give each
bucket's offset, and a window inside each bucket gives the local rank.
The hash of a unique id is uniform, so buckets are evenly filled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.text import hash_key

SEED = 42


def _key_cols(id_cols) -> list[str]:
    return [id_cols] if isinstance(id_cols, str) else list(id_cols)


def _ordered(df: DataFrame, ids: list[str], seed: int, tie_cols) -> tuple[DataFrame, list[str]]:
    """``df`` with its sort key ``_h``, and the columns of the whole order.
    Where ids may repeat or be null, ``tie_cols`` (the content) settle ties
    and spread the rows without an id."""
    if not tie_cols:
        return df.withColumn("_h", hash_key(*ids, seed=seed)), ["_h", *ids]
    x = df.withColumn("_tie", F.xxhash64(*tie_cols))
    no_id = F.coalesce(*[F.col(c).cast("string") for c in ids]).isNull()
    h = F.when(no_id, hash_key("_tie", seed=seed)).otherwise(hash_key(*ids, seed=seed))
    return x.withColumn("_h", h), ["_h", *ids, "_tie"]


def _offsets(h: DataFrame) -> DataFrame:
    """(_hb, _c, _off, _n): the rows of every hash bucket, before it and in all."""
    ordered = Window.orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
    return h.groupBy("_hb").agg(F.count(F.lit(1)).alias("_c")).select(
        "_hb",
        "_c",
        F.coalesce(F.sum("_c").over(ordered), F.lit(0)).alias("_off"),
        F.sum("_c").over(Window.partitionBy()).alias("_n"),
    )


def global_rank(df: DataFrame, id_cols, seed: int = SEED, bits: int = 16, rank_col: str = "_rank",
                tie_cols=()) -> DataFrame:
    """Adds ``rank_col`` (0-based position in (hash, id...) order) and
    ``_n`` (row count).  Exact and distributed: one shuffle by hash bucket
    plus a broadcast of at most 2**bits bucket offsets.  Ids are unique and
    not null, or ``tie_cols`` name the columns that tell the rows apart."""
    x, order = _ordered(df, _key_cols(id_cols), seed, tie_cols)
    h = x.withColumn("_hb", F.shiftright("_h", 32 - bits))
    local = Window.partitionBy("_hb").orderBy(*order)
    ranked = h.withColumn("_rn", F.row_number().over(local)).join(F.broadcast(_offsets(h).drop("_c")), "_hb")
    return ranked.withColumn(rank_col, F.col("_off") + F.col("_rn") - F.lit(1)).drop("_hb", "_rn", "_off", "_tie")


def split_sizes(n: Column) -> tuple[Column, Column, Column]:
    """80/10/10 sizes in integer arithmetic; the test side is rounded up:
    temp = ceil(n/5), test = ceil(temp/2), val = temp - test."""
    temp = F.floor((n + F.lit(4)) / F.lit(5))
    test = F.floor((temp + F.lit(1)) / F.lit(2))
    return n - temp, temp - test, test


def split_80_10_10(df: DataFrame, id_cols, seed: int = SEED, tie_cols=()) -> DataFrame:
    """Disjoint, exhaustive train/val/test of exact sizes."""
    r = global_rank(df, id_cols, seed, tie_cols=tie_cols)
    train, val, _ = split_sizes(F.col("_n"))
    split = (
        F.when(F.col("_rank") < train, F.lit("train"))
        .when(F.col("_rank") < train + val, F.lit("val"))
        .otherwise(F.lit("test"))
    )
    return r.withColumn("split", split).drop("_h", "_n", "_rank")


def split_90_10(df: DataFrame, id_cols, seed: int = SEED, group_cols=(), tie_cols=()) -> DataFrame:
    """Row-level 90/10 split (not stratified, not grouped): the
    validation side has ceil(n/10) rows.  With ``group_cols`` the distinct
    groups are split instead (ceil(groups/10) of them for validation) and
    rows of one group stay together; null is a group."""
    if group_cols:
        g = _key_cols(group_cols)
        side = split_90_10(df.select(*g).distinct(), g, seed, tie_cols=g)
        side = side.select(*[F.col(c).alias(f"_g_{c}") for c in g], "split")
        same = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in g]
        return df.join(side, same).drop(*[f"_g_{c}" for c in g])
    r = global_rank(df, id_cols, seed, tie_cols=tie_cols)
    val = F.floor((F.col("_n") + F.lit(9)) / F.lit(10))
    split = F.when(F.col("_rank") < F.col("_n") - val, F.lit("train")).otherwise(F.lit("val"))
    return r.withColumn("split", split).drop("_h", "_n", "_rank")


def sample_n(df: DataFrame, n: int, id_cols, seed: int = SEED, strict: bool = False) -> DataFrame:
    """D3: n rows without replacement, fixed seed.  A top-n by hash key:
    each partition keeps its n best rows, no full sort.  With fewer than n
    rows all rows are returned, or, with ``strict``, the job fails (as a
    fixed-size sample without replacement does in pandas); the row count
    is a scalar subquery, so no driver round trip."""
    ids = _key_cols(id_cols)
    out = df.withColumn("_h", hash_key(*ids, seed=seed)).orderBy("_h", *ids).limit(n).drop("_h")
    if not strict:
        return out
    total = df.agg(F.count(F.lit(1)).alias("c")).select("c").scalar()
    guard = F.when(total < F.lit(n), F.raise_error(F.lit(f"sample_n: fewer than {n} rows to sample")))
    # a filter cannot be pruned away like an unused column: the guard runs
    return out.where(F.coalesce(guard.cast("boolean"), F.lit(True)))


def sample_frac(df: DataFrame, frac: float, id_cols, seed: int = SEED) -> DataFrame:
    """Exactly round_half_even(frac * N) rows, fixed seed.  (A
    Bernoulli ``DataFrame.sample`` would give an inexact count.)

    The counts of the hash buckets settle all of them but one, in which the
    sample ends: only its rows are dealt out and ranked, the others stay where
    they are."""
    x, order = _ordered(df, _key_cols(id_cols), seed, ())
    h = x.withColumn("_hb", F.shiftright("_h", 16))
    k = F.bround(F.lit(float(frac)) * F.col("_n"), 0)
    # of this bucket's _c rows the first _k are in the sample
    at = h.join(F.broadcast(_offsets(h).select("_hb", "_c", (k - F.col("_off")).alias("_k"))), "_hb")
    whole = at.where(F.col("_k") >= F.col("_c"))
    last = at.where((F.col("_k") > 0) & (F.col("_k") < F.col("_c")))
    rank = F.row_number().over(Window.partitionBy("_hb").orderBy(*order))
    last = last.withColumn("_rn", rank).where(F.col("_rn") <= F.col("_k")).drop("_rn")
    return whole.unionByName(last).select(*df.columns)


def dense_ids(df: DataFrame, id_cols, out: str = "ID", seed: int = SEED) -> DataFrame:
    """Dense 0..n-1 ids in hash-key order, distributed (see global_rank)."""
    return global_rank(df, id_cols, seed, rank_col=out).drop("_h", "_n")
