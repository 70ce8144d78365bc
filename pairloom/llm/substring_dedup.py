"""Suffix-array dedup: removal of repeated 100-byte strings (operator 10).

A byte goes when some 100-byte string that covers it also starts earlier.  The
suffixes of the corpus are dealt into buckets such that equal 100-byte strings
meet, and each bucket is sorted on its own:

1. *Buckets.*  Each 100-byte window is dealt by its anchor, the 32-byte string
   in it with the smallest hash, at most ``RUN`` neighbouring windows sharing
   one.  Equal windows have equal anchors at equal offsets.  An anchor that
   occurs once proves its windows unique, and they are dropped at once.
2. *Equal stretches.*  Of runs with the same bytes all but the first are
   removed whole; tasks do this within their own batches before the shuffle,
   so a passage that a third of all documents holds arrives once per batch.
3. *Difference cover.*  Where runs of one anchor differ, their places are
   joined with the texts for their bytes, and their suffixes sorted one bucket at a time: by the first and
   last 32 bytes, and long ties by ranks of a difference-cover sample.  Of any
   two suffixes i, j some d < 32 puts i + d and j + d both in the sample, and
   equal ranks there (over 68 bytes) close the gap between both ends.  Memory is
   bounded by the bucket, never by the text.
4. An anchor with more than ``HOT`` different runs (one line in very many
   documents) is spread by its windows instead, with a map-side minimum.

Documents are read twice and their text is shuffled once, for the bytes and for
the result."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pairloom.llm.common import mix, stored
from pairloom.session import collect_garbage

LENGTH, GRAM, COVER = 100, 32, 32
RUN = LENGTH - GRAM + 1      # windows that one anchor can serve
TIE = LENGTH - GRAM          # bytes a cover rank compares
BUCKET_RUNS = 20_000         # runs sorted together (about 3 MB)
HOT = 20_000                 # different runs of one anchor beyond which windows are spread
LAST = (1 << 63) - 1         # place of a null id: after all others
M32, M7 = (1 << 32) - 1, (1 << 7) - 1
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def difference_cover(v: int) -> list[int]:
    """A small set of residues whose differences are all residues mod v
    (greedy: each step takes the residue that adds most differences)."""
    cover, seen = [0], {0}
    while len(seen) < v:
        gain = {r: {(r - c) % v for c in cover} | {(c - r) % v for c in cover} for r in range(v) if r not in cover}
        best = max(gain, key=lambda r: (len(gain[r] - seen), -r))
        cover.append(best)
        seen |= gain[best]
    return sorted(cover)


def _deltas(cover: list[int], v: int) -> np.ndarray:
    """delta[a, b]: the smallest d with a + d and b + d both in the cover."""
    inside = np.zeros(v, bool)
    inside[cover] = True
    out = np.zeros((v, v), np.int64)
    for a in range(v):
        for b in range(v):
            out[a, b] = next(d for d in range(v) if inside[(a + d) % v] and inside[(b + d) % v])
    return out


def _eight(b: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one big-endian number (comparable)."""
    x = b.astype(np.uint64)
    for w in (1, 2, 4):
        x = (x[:-w] << np.uint64(8 * w)) | x[w:]
    return x


def _blend(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def runs(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, run hash, first window, windows) of the runs of a text of
    ``LENGTH`` bytes or more: neighbouring windows with the same anchor."""
    b = np.frombuffer(raw, np.uint8)
    h = _eight(b)
    h = _blend(_blend(h[:-8]) + h[8:])
    h = mix(_blend(h[:-16]) + h[16:])  # of 32 bytes from each place on
    n = len(b) - LENGTH + 1
    parts, block = [], 1 << 22
    for at in range(0, n, block):
        g = h[at : min(at + block, n) + RUN - 1]
        m = (g & np.uint64(~((1 << 23) - 1) & (1 << 64) - 1)) | np.arange(len(g), dtype=np.uint64)
        w = 1
        while 2 * w <= RUN:
            m = np.minimum(m[:-w], m[w:])
            w *= 2
        m = np.minimum(m[: len(m) - (RUN - w)], m[RUN - w :])
        parts.append((m & np.uint64((1 << 23) - 1)).astype(np.int64) + at)
    anchor = np.concatenate(parts)
    lo = np.flatnonzero(np.diff(anchor, prepend=-1))
    cnt = np.diff(lo, append=n)
    long = cnt + LENGTH - 1
    ctx = long.astype(np.uint64)
    for k in range(0, RUN + LENGTH, GRAM):
        ctx = mix(ctx + h[lo + np.minimum(k, long - GRAM)])
    return h[anchor[lo]], mix(ctx + (anchor[lo] - lo).astype(np.uint64)), lo, cnt


def _batch_runs(batch: pa.RecordBatch):
    """Runs of a batch's (doc_id, tag, data) rows as int64 arrays key, ctx,
    doc_id, pos, and the batch row; pos packs tag, first window and count."""
    ids, tags = np.asarray(batch.column(0)), np.asarray(batch.column(1))
    data = batch.column(2)
    out = []
    for i in range(batch.num_rows):
        raw = data[i].as_buffer()
        if raw is not None and raw.size >= LENGTH:
            key, ctx, lo, cnt = runs(raw)
            out.append((key.view(np.int64), ctx.view(np.int64), np.full(len(lo), ids[i]),
                        (tags[i] << 44) | (lo << 8) | cnt, np.full(len(lo), i)))
    if not out:
        return [np.zeros(0, np.int64)] * 5
    return [np.concatenate(x) for x in zip(*out)]


def _scan(batches):
    """Runs to be dealt by anchor.  Of equal runs in one batch only the first
    is dealt; the others are marked removed (bit 7 of pos) and spread, neighbours
    of one text as one, with their windows in place of ctx."""
    for batch in batches:
        key, ctx, doc, pos, row = _batch_runs(batch)
        order = np.lexsort((pos, doc, ctx))
        key, ctx, doc, pos, row = key[order], ctx[order], doc[order], pos[order], row[order]
        head = np.flatnonzero(np.diff(ctx, prepend=ctx[:1] ^ 1)) if len(ctx) else np.zeros(0, np.int64)
        first = np.repeat(head, np.diff(head, append=len(ctx)))
        gone = (doc != doc[first]) | (pos != pos[first])
        mine = np.flatnonzero(gone)
        mine = mine[np.lexsort((pos[mine], row[mine]))]
        p, cnt = pos[mine], pos[mine] & M7
        begins = np.ones(len(mine), bool)
        begins[1:] = (row[mine][1:] != row[mine][:-1]) | ((p >> 8)[1:] != (p >> 8)[:-1] + cnt[:-1])
        head = np.flatnonzero(begins)
        p, d = (p[head] & ~M7) | 128, doc[mine][head]
        windows = np.add.reduceat(cnt, head) if len(head) else cnt
        spread = mix((d ^ (p << 5)).view(np.uint64)).view(np.int64)
        key, ctx, doc, pos = (np.concatenate([x, y[~gone]]) for x, y in ((spread, key), (windows, ctx), (d, doc), (p, pos)))
        for at in range(0, len(key), 100_000):
            cut = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(x[cut]) for x in (key, ctx, doc, pos)], names=["key", "ctx", "doc_id", "pos"])


def _fetch(batches):
    """The bytes of each text's open runs."""
    for batch in batches:
        data, wanted = batch.column(1), batch.column(2)
        keys, docs, places, got = [], [], [], []
        for i, doc in enumerate(batch.column(0).to_pylist()):
            raw = data[i].as_py()
            for x in wanted[i].as_py():
                at, cnt = (x["pos"] >> 8) & ((1 << 36) - 1), x["pos"] & M7
                keys.append(x["key"])
                docs.append(doc)
                places.append(x["pos"])
                got.append(raw[at : at + cnt + LENGTH - 1])
        for at in range(0, len(keys), 20_000):
            cut = slice(at, at + 20_000)
            yield pa.RecordBatch.from_arrays([*[pa.array(x[cut], pa.int64()) for x in (keys, docs, places)], pa.array(got[cut], pa.binary())],
                                             names=["key", "doc_id", "pos", "run"])


def repeated(key: np.ndarray, doc: np.ndarray, pos: np.ndarray, data: list[bytes], cover=None) -> list[np.ndarray]:
    """For each run of a bucket, which of its windows start earlier elsewhere
    in the bucket (bool array per run)."""
    cover = cover or difference_cover(COVER)
    delta = _deltas(cover, COVER)
    text = np.frombuffer(b"".join(data) + b"\0" * 8, np.uint8)
    size = np.fromiter(map(len, data), np.int64, len(data))
    start = np.cumsum(size) - size
    eight = _eight(text)
    # ranks of the cover sample, over TIE bytes, precomputed once per bucket
    fits = np.ones(len(text), bool)
    tails = (start + size)[:, None] - np.arange(1, TIE)
    fits[np.maximum(tails, start[:, None]).ravel()] = False
    fits[len(text) - 8 :] = False
    inside = np.zeros(COVER, bool)
    inside[cover] = True
    sample = np.flatnonzero(fits & inside[np.arange(len(text)) % COVER])
    ranks = np.zeros(len(sample), np.uint64)
    for k in (*range(0, TIE - 8, 8), TIE - 8):
        _, word = np.unique(eight[sample + k], return_inverse=True)
        _, ranks = np.unique((ranks.astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64), return_inverse=True)
    rank = np.full(len(text), -1, np.int64)
    rank[sample] = ranks
    # suffixes: one per window
    cnt = size - LENGTH + 1
    run = np.repeat(np.arange(len(data)), cnt)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(cnt) - cnt, cnt)
    at = start[run] + nth
    when = ((pos >> 8) & ((1 << 51) - 1))[run] + nth
    gone = np.zeros(len(run), bool)
    # one suffix bucket at a time: suffixes of neighbouring anchors
    by_key = np.argsort(key[run], kind="stable")
    bounds = np.flatnonzero(np.diff(key[run][by_key], prepend=key[run][by_key[:1]] ^ 1))
    cuts = [0]
    for x in bounds.tolist():
        if x - cuts[-1] >= 100_000:
            cuts.append(x)
    for a, z in zip(cuts, [*cuts[1:], len(by_key)]):
        s = by_key[a:z]
        p = at[s]
        ends = [eight[p + k] for k in (0, 8, 16, 24, LENGTH - 32, LENGTH - 24, LENGTH - 16, LENGTH - 8)]
        order = np.lexsort([when[s], doc[run[s]], *ends[::-1]])
        s, p = s[order], p[order]
        same = np.ones(len(s), bool)
        same[:1] = False
        for e in ends:
            e = e[order]
            same[1:] &= e[1:] == e[:-1]
        group = np.cumsum(~same)
        left = np.arange(len(s))
        while len(left):
            head = np.flatnonzero(np.diff(group[left], prepend=-1))
            first = left[np.repeat(head, np.diff(head, append=len(left)))]
            d = delta[p[left] % COVER, p[first] % COVER]
            tie = rank[p[left] + d] == rank[p[first] + d]
            gone[s[left[tie & (left != first) & ((doc[run[s[left]]] != doc[run[s[first]]]) | (when[s[left]] != when[s[first]]))]]] = True
            left = left[~tie]
    return np.split(gone, np.cumsum(cnt)[:-1])


def _sort_bucket(table: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    key, doc, pos = (np.asarray(table[c]) for c in ("key", "doc_id", "pos"))
    flags = repeated(key, doc, pos, table["run"].to_pylist())
    docs, tags, ss, ee = [], [], [], []
    for i, gone in enumerate(flags):
        if gone.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
            lo = (int(pos[i]) >> 8) & ((1 << 36) - 1)
            for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
                docs.append(int(doc[i]))
                tags.append(int(pos[i]) >> 44)
                ss.append(lo + s)
                ee.append(lo + e + LENGTH - 1)
    return pa.table({"doc_id": pa.array(docs, pa.int64()), "tag": pa.array(tags, pa.int64()),
                     "s": pa.array(ss, pa.int64()), "e": pa.array(ee, pa.int64())})


def _spread(hot_runs: DataFrame) -> DataFrame:
    """Removed windows of anchors with very many different runs: the first
    place of each window by a map-side minimum, all other places go.  Windows
    are known by their MD5, a sixth of their bytes."""
    lo, cnt = F.shiftright("pos", 8), F.col("pos").bitwiseAND(F.lit(M7)).cast("int")
    w = hot_runs.select("doc_id", "pos", lo.alias("when"), F.explode(F.sequence(F.lit(0), cnt - 1)).alias("i"), "run").select(
        "doc_id", (F.col("when") + F.col("i")).alias("when"), F.unhex(F.md5(F.expr(f"substring(run, i + 1, {LENGTH})"))).alias("window"))
    w = stored(w, "hot-windows")
    first = stored(w.groupBy("window").agg(F.min(F.struct("doc_id", "when")).alias("first")), "hot-first")
    gone = w.join(first, "window").where("first.doc_id <> doc_id or first.when <> when")
    s = F.col("when").bitwiseAND(F.lit((1 << 36) - 1))
    return gone.select("doc_id", F.shiftright("when", 36).alias("tag"), s.alias("s"), (s + LENGTH).alias("e"))


def _cut(batches):
    """Remove each row's ranges from its bytes."""
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            raw = batch.column(1)[i].as_py() or b""
            spans = batch.column(2)[i].as_py() or []
            kept, removed, count, end = hashlib.sha256(), 0, 0, 0
            reach = -1
            for x in sorted(spans):
                s, e = x >> 32, x & M32
                if s > reach:
                    kept.update(raw[end:s])
                    count += 1
                    removed += e - s
                    reach = end = e
                elif e > reach:
                    removed += e - reach
                    reach = end = e
            kept.update(raw[end:])
            rows.append((len(raw), removed, count, kept.hexdigest()))
        n, r, c, k = map(list, zip(*rows)) if rows else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(c, pa.int64()),
                                          pa.array(k, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def removed_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tag, s, e): byte ranges to remove, as found; ranges of one
    document may overlap.  ``tag`` tells apart rows that repeat an id with
    another text; a null id is given as the largest number."""
    docs = _tagged(df, id_col, text_col)
    dealt = docs.mapInArrow(_scan, "key long, ctx long, doc_id long, pos long").repartition("key")
    flagged = F.col("pos").bitwiseAND(F.lit(128)) != 0
    same, anchor = Window.partitionBy("key", "ctx").orderBy("doc_id", "pos"), Window.partitionBy("key")
    rows = (dealt.withColumn("first", F.rank().over(same) == 1)
            .withColumn("n_ctx", F.sum(F.col("first").cast("int")).over(anchor))
            .where(flagged | ~F.col("first") | (F.col("n_ctx") > 1)))
    # what is removed by now is a place; only open runs are met by key again
    open_ = ~flagged & F.col("first")
    windows = F.when(flagged, F.col("ctx")).otherwise(F.col("pos").bitwiseAND(F.lit(M7)))
    rows = stored(rows.select(F.when(open_, F.col("key")).alias("key"), "doc_id", "pos", F.when(~open_, windows).alias("windows"),
                              F.when(open_, F.col("n_ctx").cast("int")).alias("n_ctx")), "runs")
    collect_garbage(df.sparkSession)
    lo = F.shiftright("pos", 8).bitwiseAND(F.lit((1 << 36) - 1))
    spans = rows.where(F.col("windows").isNotNull()).select(
        "doc_id", F.shiftright("pos", 44).alias("tag"), lo.alias("s"), (lo + F.col("windows") + (LENGTH - 1)).alias("e"))
    open_ = rows.where(F.col("windows").isNull())
    n_open = open_.count()
    if not n_open:
        return spans
    wanted = open_.groupBy("doc_id", F.shiftright("pos", 44).alias("tag")).agg(F.collect_set(F.struct("key", "pos")).alias("open"))
    # the same shuffle of the texts as that of the result
    fetched = docs.join(wanted, ["doc_id", "tag"]).select("doc_id", "data", "open").mapInArrow(_fetch, "key long, doc_id long, pos long, run binary")
    hot = open_.where(F.col("n_ctx") > HOT).select("key").distinct()
    buckets = max(1, n_open // BUCKET_RUNS)
    if not hot.isEmpty():
        fetched = stored(fetched, "fetched")
        collect_garbage(df.sparkSession)
        spans = spans.unionByName(_spread(fetched.join(hot, "key", "left_semi")))
        fetched = fetched.join(hot, "key", "left_anti")
    sorted_ = (fetched.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
               .groupBy("bucket").applyInArrow(_sort_bucket, "doc_id long, tag long, s long, e long"))
    return spans.unionByName(sorted_)


def _tagged(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(df[text_col], F.lit(""))
    return df.select(F.coalesce(df[id_col].cast("long"), F.lit(LAST)).alias("doc_id"),
                     F.xxhash64(text).bitwiseAND(F.lit((1 << 15) - 1)).alias("tag"), text.cast("binary").alias("data"))


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans (maximal
    removed runs), kept_sha256 (of the bytes that stay).

    Null and empty texts have no bytes; texts under 100 bytes lose nothing.
    Rows that repeat id and text are one document and get equal results; rows
    that repeat an id with another text are ordered by a hash of the text; null
    ids count as later than all others.  Other columns are ignored; an empty
    table gives no rows."""
    spans = removed_spans(df, id_col, text_col)
    # one row per document with runs to cut; a repeated row gives its runs twice
    span = F.shiftleft("s", 32).bitwiseOR(F.col("e"))  # a text has under 2 GB
    per_doc = spans.groupBy("doc_id", "tag").agg(F.collect_list(span).alias("spans"))
    rows = _tagged(df, id_col, text_col).join(per_doc, ["doc_id", "tag"], "left").select("doc_id", "data", "spans")
    out = rows.mapInArrow(_cut, SCHEMA)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != LAST, F.col("doc_id")))


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"))
