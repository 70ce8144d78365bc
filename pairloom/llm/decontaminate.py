"""Benchmark decontamination by CGK embedding and bit sampling (operator 4).

A CGK random walk reads a word sequence with one pointer: each step emits the
word under the pointer, and a random function of step and word decides whether
the pointer moves on.  Sequences at a small edit distance fall back into step
after each edit, so their emissions differ in few places: edit distance has
become Hamming distance, for which sampling places (here whole emitted words)
is a locality-sensitive hash.  Several walks with several tables each reach the
target recall (measured in the tests), and each hit is verified by the exact
edit distance of the item to the best stretch of the document.

Windows start at every ``STRIDE``-th word of a document.  An item is embedded
by windows spread over all of its words (`windows`), each from ``STRIDE``
successive words on, so an aligned one always exists; edits that crowd one end
of the item leave the windows of the other end alone.  Where a window stands in
its item tells where the item begins.  How many steps are sampled follows the
item's size.  Items shorter than ``SHORT`` words are cut into one piece
more than the edits allowed: one of the pieces occurs exactly.

The benchmark is worked through in blocks of a bounded number of words, each
shipped to the tasks; documents are never shuffled."""

from __future__ import annotations

import re
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.common import WordHashes, mix, slim

STRIDE, SHORT = 4, 8
MAX_SHARE = 0.2              # word edits allowed, as a share of the item's words
WALKS = 3
#: (steps walked, places sampled per table, tables per walk); a walk of s
#: steps reads about s / 2 words
CLASSES = ((8, 3, 6), (16, 4, 8), (32, 4, 6), (48, 4, 6))
AGREE = 0.3                 # least share of a walk's steps that emit the same word
BLOCK_WORDS = 2_000_000      # words of items shipped at once
PAD = np.uint64(0x5851F42D4C957F2D)
FILTER = 1 << 20
SCHEMA = "doc_id long, item_id long, distance long, n_item_words long, first_word long, last_word long"

_WORDS = re.compile(r"\w+").findall


def words(text: str) -> list[str]:
    """Lower-case words; punctuation and layout do not count."""
    return _WORDS(text.lower())


#: odd factor of each step of a walk; a table's key is the sum over its places
FACTORS = mix(np.arange(1, 1 + max(s for s, _, _ in CLASSES), dtype=np.uint64)) | np.uint64(1)


def walk(tokens: np.ndarray, starts: np.ndarray, seed: int, steps: int) -> np.ndarray:
    """Emitted words (steps x starts) of one walk from each start, each times
    its step's factor; ``tokens`` must go on for ``steps`` words after the last
    start."""
    coin = mix(tokens ^ mix(np.asarray([seed + 1], np.uint64))[0]).view(np.int64)
    out = np.empty((steps, len(starts)), np.uint64)
    at = starts.astype(np.int64)
    for j in range(steps):
        np.multiply(tokens[at], FACTORS[j], out=out[j])
        at += (coin[at] >> j) & 1
    return out


def places(seed: int) -> list[list[np.ndarray]]:
    """For each class the sampled places of its tables, fixed by the seed."""
    rng = np.random.default_rng(seed)
    return [[np.sort(rng.choice(steps, m, replace=False)) for _ in range(tables)] for steps, m, tables in CLASSES]


def keys(emitted: np.ndarray, where: np.ndarray) -> np.ndarray:
    x = emitted[where[0]].copy()
    for p in where[1:]:
        x += emitted[p]
    return x


def class_of(n: int) -> int:
    """The class with most steps whose walk stays in n words nearly always."""
    return max((c for c, (steps, _, _) in enumerate(CLASSES) if steps <= 1.25 * n), default=0)


def windows(n: int) -> list[tuple[int, int]]:
    """(class, first word) of the windows of an item of n words: one after the
    other over the whole item, the last one read nearly always within it, each
    from STRIDE words on."""
    c = class_of(n)
    steps = CLASSES[c][0]
    last = max(0, n - steps // 2 - isqrt(steps) - STRIDE + 1)
    found = {(class_of(n - o), o) for o in range(STRIDE)}
    for p in (*range(0, last, steps // 2), last):
        found.update((c, p + o) for o in range(STRIDE))
    return sorted(found)


def best_stretch(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """(distance, first, end) of the stretch of ``region`` at the smallest
    edit distance to ``item``."""
    n = len(region)
    idx = np.arange(n + 1)
    row, begin = np.zeros(n + 1, np.int64), idx.copy()
    for i, w in enumerate(item.tolist()):
        sub, dele = row[:-1] + (region != w), row[1:] + 1
        t = np.concatenate([[i + 1], np.minimum(sub, dele)])
        b = np.concatenate([[0], np.where(sub <= dele, begin[:-1], begin[1:])])
        low = np.minimum.accumulate(t - idx)
        src = np.maximum.accumulate(np.where(t - idx == low, idx, 0))
        row, begin = low + idx, b[src]
    end = int(np.argmin(row))
    return int(row[end]), int(begin[end]), end


def matches(key: np.ndarray, mine: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in ``mine``, place in the sorted ``key``) of equal values;
    only the places ``hit`` of ``mine`` are looked up."""
    lo, hi = np.searchsorted(key, mine[hit]), np.searchsorted(key, mine[hit], "right")
    many = hi - lo
    col = np.repeat(hit, many)
    return col, np.repeat(lo, many) + np.arange(len(col)) - np.repeat(np.cumsum(many) - many, many)


class Index:
    """Tables of one block of items."""

    def __init__(self, items: list[tuple[int, np.ndarray]], share: float = MAX_SHARE):
        self.items, self.share = items, share
        self.places = [places(w) for w in range(WALKS)]
        #: (walk, class, table), sorted keys, row of each, filter
        self.tables: list[tuple] = []
        longest = max(s for s, _, _ in CLASSES)
        pieces: dict[int, list] = {}  # of short items: per length, hash, item, first word
        gap, parts, at = np.full(longest, PAD, np.uint64), [], 0
        rows: list[list] = [[] for _ in CLASSES]  # per class: item, first word, place in all
        for k, (_, t) in enumerate(items):
            if len(t) < SHORT:
                cut = int(share * len(t)) + 1  # more than the edits: one piece stays whole
                for a, e in ((len(t) * i // cut, len(t) * (i + 1) // cut) for i in range(cut)):
                    if e > a:
                        pieces.setdefault(e - a, []).append((int(run_hash(t[a:e], e - a)[0]), k, a))
                continue
            for c, p in windows(len(t)):
                rows[c].append((k, p, at + p))
            parts += (t, gap)
            at += len(t) + longest
        tokens = np.concatenate(parts or [gap])
        self.item, self.first, self.embedded = {}, {}, {}
        for c, found in enumerate(rows):
            if not found:
                continue
            self.item[c], self.first[c], starts = np.asarray(found, np.int64).T
            for w in range(WALKS):
                emitted = walk(tokens, starts, w, CLASSES[c][0])
                self.embedded[w, c] = emitted.astype(np.uint8)  # the last byte is enough to count agreement
                for i, where in enumerate(self.places[w][c]):
                    key = keys(emitted, where)
                    order = np.argsort(key, kind="stable").astype(np.int32)
                    seen = np.zeros(FILTER, bool)
                    seen[(key & np.uint64(FILTER - 1)).astype(np.int64)] = True
                    self.tables.append(((w, c, i), key[order], order, seen))
        self.steps = max((CLASSES[c][0] for c in self.item), default=0)
        self.short = {}
        for n, found in pieces.items():
            found.sort()
            self.short[n] = (np.asarray([f[0] for f in found], np.uint64), np.asarray([f[1:] for f in found], np.int64).T)

    def search(self, docs: list[np.ndarray]) -> list[list[tuple]]:
        """Verified matches (item, distance, first, last word) per document."""
        out: list[list[tuple]] = [[] for _ in docs]
        gap = np.full(max(self.steps, 1), PAD, np.uint64)
        tokens = np.concatenate([x for d in docs for x in (d, gap)] or [gap])
        size = np.asarray([len(d) for d in docs], np.int64)
        first = np.cumsum(size + len(gap)) - size - len(gap)
        found: dict[tuple[int, int], set[int]] = {}
        met = []  # document, item, first word of the item there
        if self.tables and len(docs):
            per = (size + STRIDE - 1) // STRIDE
            owner = np.repeat(np.arange(len(docs)), per)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
            starts = first[owner] + STRIDE * nth
            for w in range(WALKS):
                emitted = walk(tokens, starts, w, self.steps)
                for (walk_, c, i), key, rows, seen in self.tables:
                    if walk_ != w:
                        continue
                    mine = keys(emitted, self.places[w][c][i])
                    hit = np.flatnonzero(seen[(mine & np.uint64(FILTER - 1)).astype(np.int64)])
                    col, row = matches(key, mine, hit)
                    row = rows[row]
                    # Hamming distance of the embeddings, then the edit distance
                    steps = CLASSES[c][0]
                    near = (emitted[:steps, col].astype(np.uint8) == self.embedded[w, c][:, row]).sum(axis=0) >= AGREE * steps
                    col, row = col[near], row[near]
                    met.append(np.stack([owner[col], self.item[c][row], STRIDE * nth[col] - self.first[c][row]]))
        for n, (key, (item, a)) in self.short.items():
            if len(tokens) >= n:
                h = run_hash(tokens, n)  # no piece holds a gap
                at, row = matches(key, h, np.flatnonzero(np.isin(h, key)))
                d = np.searchsorted(first, at, "right") - 1
                met.append(np.stack([d, item[row], at - first[d] - a[row]]))
        if met:
            d, k, b = np.concatenate(met, axis=1)
            order = np.lexsort((b, k, d))
            d, k, b = d[order], k[order], b[order]
            new = np.ones(len(d), bool)
            new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1]) | (b[1:] != b[:-1])
            for x, y, z in zip(d[new].tolist(), k[new].tolist(), b[new].tolist()):
                found.setdefault((x, y), set()).add(z)
        for (d, k), begins in sorted(found.items()):
            best = self.verify(docs[d], self.items[k][1], begins)
            if best:
                out[d].append((self.items[k][0], *best))
        return out

    def verify(self, doc: np.ndarray, item: np.ndarray, begins: set[int]):
        n, most = len(item), int(self.share * len(item))
        best, groups = None, []
        for b in sorted(begins):  # begins that lie close are looked at together
            if groups and b - groups[-1][0] <= most:
                groups[-1][1] = b
            else:
                groups.append([b, b])
        for b, last in groups:
            lo, hi = max(0, b - most), min(len(doc), last + n + most)
            region = doc[lo:hi]
            there = set(region.tolist())
            if sum(w in there for w in item.tolist()) < n - most:
                continue
            dist, s, e = best_stretch(item, region)
            if dist <= most and (best is None or dist < best[0]):
                best = (dist, n, lo + s, lo + e - 1)
                if not dist:
                    break
        return best


def run_hash(t: np.ndarray, n: int) -> np.ndarray:
    x = np.full(len(t) - n + 1, n, np.uint64)
    for k in range(n):
        x = mix(x) + t[k : len(t) - n + 1 + k]
    return mix(x)


def _blocks(benchmark: DataFrame, block_words: int):
    """Blocks of (item_id, word hashes), each of a bounded number of words."""
    total = benchmark.agg(F.sum(F.length("text") / 4)).first()[0] or 0
    n = max(1, int(total // block_words))
    known = WordHashes()
    for i in range(n):
        part = benchmark if n == 1 else benchmark.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)) == i)
        yield [(r[0], known.array(words(r[1]))) for r in part.collect()]


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_id_col: str = "item_id", item_text_col: str = "text", share: float = MAX_SHARE,
                 block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document and benchmark item it contains: doc_id, item_id,
    distance (word edits), n_item_words, first_word, last_word of the best
    stretch.  Documents without a match give no row.

    Null and empty texts and items match nothing; null ids stay null; a
    repeated document gives its rows again, a repeated item likewise; ties go
    to the first stretch; other columns are ignored; empty tables give no
    rows.  The benchmark is read in blocks of about ``block_words`` words."""
    docs = slim(df, id_col, text_col)
    items = benchmark.select(benchmark[item_id_col].cast("long").alias("doc_id"),
                             F.coalesce(benchmark[item_text_col], F.lit("")).alias("text"))
    out = None
    for block in _blocks(items, block_words):
        found = docs.mapInArrow(_search(block, share), SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def _search(block, share: float):
    def run(batches):
        index, known = Index(block, share), WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                docs = [known.array(words(t)) for t in part.column(1).to_pylist()]
                ids = part.column(0).to_pylist()
                rows = [(i, *m) for i, ms in zip(ids, index.search(docs)) for m in ms]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in map(list, zip(*rows))],
                                                     names=["doc_id", "item_id", "distance", "n_item_words", "first_word", "last_word"])

    return run


def without_contaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
                         item_text_col: str = "text", share: float = MAX_SHARE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``df`` (all columns) whose text holds no item: the same
    search as `contaminated`, as a filter inside the tasks, without a join."""
    items = benchmark.select(benchmark[item_id_col].cast("long").alias("doc_id"),
                             F.coalesce(benchmark[item_text_col], F.lit("")).alias("text"))
    at = df.columns.index(text_col)
    for block in _blocks(items, block_words):
        df = df.mapInArrow(_clean(block, share, at), df.schema)
    return df


def _clean(block, share: float, column: int):
    def run(batches):
        index, known = Index(block, share), WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                found = index.search([known.array(words(t or "")) for t in part.column(column).to_pylist()])
                yield part.filter(pa.array([not m for m in found], pa.bool_()))

    return run


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    d = sf_dir.rstrip("/")
    return contaminated(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet"))
