"""N-gram Jaccard join by size-banded tiles and bitmap signatures
(operator 8).

Two sets with Jaccard similarity t or more have similar sizes and differ in at
most H elements, H known from the sizes.  Sizes are cut into bands; the tile
of a band compares the sets of that band with each other and with those of the
next band that are small enough.  Within a tile every set is cut, by hash,
into P > H parts: a linked pair agrees on at least P - H parts whole, so
comparing only sets with an equal part loses no link, and a part is several
shingles long, so few others meet.  Empty parts would let strangers meet; a set
with fewer than P - H of them need not present them, since some other part
then agrees too, and P leaves room for that.

Sets are compared once per distinct set (class), not per document.  Of the
classes that share a part, all are first compared with the smallest, which
settles the usual case that all belong together.  Only where the classes met
by one pivot still stand in different components are the remaining pairs across
components compared, in blocks of bounded size.  A pair is settled in three steps: sizes,
then bitmaps (each shingle toggles one bit; the number of bits that differ is
at most the number of elements that differ, which bounds the overlap from above;
a bitmap has about one bit per shingle and folds to half its size), then the exact intersection of the sorted arrays.

Shingles and sets are identified by 64-bit hashes."""

from __future__ import annotations

import math
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from pairloom.llm.common import CACHE_ENTRIES, WordHashes, lower_words_of, map_texts, mix, slim, stored
from pairloom.llm.components import connected_components

SHINGLE, PERCENT = 3, 90
MIN_BITS = 512
BLOCK = 512          # classes a block compares with another block at most, on average
FILTER_BITS = 1 << 23  # 1 MB shipped to the tasks of the second reading
FEATURES = "doc_id long, n_shingles long, cls long, sigs array<long>, bits binary"


class Bands:
    """Size bands, and per band the number of parts its tile cuts sets into."""

    def __init__(self, percent: int):
        self.percent = percent
        self.low = [1]
        while self.low[-1] < 1 << 30:
            self.low.append(max(self.low[-1] + 1, self.low[-1] * 3 // 2))
        self.sized = [self.parts(b) for b in range(len(self.low) - 1)]

    def parts(self, band: int) -> tuple[int, int]:
        """(parts, differing elements allowed) of the band's tile; parts grow
        past the least number until ordinary sets have few empty ones."""
        top = self.low[band + 1] - 1
        most = (top + 100 * top // self.percent) * (100 - self.percent) // (100 + self.percent)
        parts = most + 1
        while parts < 1.4 * most and parts - most <= 1.5 * parts * math.exp(-self.low[band] / parts) + 2:
            parts += max(1, most // 50)
        return parts, most

    def tiles(self, n: int) -> list[tuple[int, int, int]]:
        """(band, parts, most) of the tiles in which a set of size n stands; a
        tile that allows no difference would only find equal sets, which are
        one class."""
        if not n:
            return []
        found = [bisect_right(self.low, n) - 1]
        while found[-1] and n <= 100 * (self.low[found[-1]] - 1) // self.percent:
            found.append(found[-1] - 1)
        return [(b, *self.sized[b]) for b in found if self.sized[b][1]]


def shingle_set(h: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a word-hash sequence;
    a shorter sequence is one shingle, an empty one has none."""
    n = len(h)
    if not n:
        return h
    width = min(size, n)
    x = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        x = mix(x) + h[k : n - width + 1 + k]
    return np.unique(mix(x))


def signatures(s: np.ndarray, bands: Bands) -> np.ndarray:
    out = []
    for band, parts, most in bands.tiles(len(s)):
        part = ((s >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        sums = np.zeros(parts, np.uint64)
        np.add.at(sums, part, mix(s + np.uint64(1)))
        got = mix(sums ^ mix(np.arange(parts, dtype=np.uint64) + np.uint64((band + 1) << 40)))
        held = np.bincount(part, minlength=parts) > 0
        out.append(got if parts - np.count_nonzero(held) >= parts - most else got[held])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def parity_bits(s: np.ndarray) -> bytes:
    m = MIN_BITS
    while m < len(s):
        m *= 2
    odd = np.bincount(((s >> np.uint64(20)) & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    """The bitmap as it would be with ``size`` bytes."""
    while len(bits) > size:
        half = len(bits) // 2
        bits = bits[:half] ^ bits[half:]
    return bits


def features(docs: DataFrame, size: int, percent: int) -> DataFrame:
    def make():
        known, bands, seen = WordHashes(), Bands(percent), set()

        def fn(ids, texts):
            n, cls, sigs, bits = [], [], [], []
            if len(seen) > CACHE_ENTRIES:
                seen.clear()
            for t in texts:
                s = shingle_set(known.array(lower_words_of(t)), size)
                n.append(len(s))
                cls.append(int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64)) if len(s) else None)
                # copies in one task present their parts once
                sigs.append(np.zeros(0, np.int64) if cls[-1] in seen else signatures(s, bands).view(np.int64))
                seen.add(cls[-1])
                bits.append(parity_bits(s))
            return [ids, n, cls, pa.array(sigs, pa.list_(pa.int64())), pa.array(bits, pa.binary())]

        return fn

    return map_texts(docs, make, FEATURES)


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(cls, elements), one row per class, of the documents in ``wanted``
    (rep): ids are looked up in a fixed-size bitmap, so others may come along;
    copies among them are reduced inside the tasks, then by class."""
    pos = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)) + 1
    rows = (wanted.select(pos("rep").alias("pos"))
            .groupBy(F.bitmap_bucket_number("pos").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("pos")).alias("bits"))
            .collect())  # at most FILTER_BITS / 32,768 rows of 4 KB
    held = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows:
        held[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    held = held.tobytes()
    picked = docs.select(pos("doc_id").alias("doc_id"), "text")

    def run(batches):
        known, held_bits, seen = WordHashes(), np.frombuffer(held, np.uint8), set()
        for batch in batches:
            if len(seen) > CACHE_ENTRIES:
                seen.clear()
            p = np.asarray(batch.column(0).fill_null(1)) - 1
            take = np.flatnonzero(held_bits[p >> 3] >> (p & 7).astype(np.uint8) & 1)
            for at in range(0, len(take), 256):
                texts = batch.column(1).take(pa.array(take[at : at + 256])).to_pylist()
                sets = [shingle_set(known.array(lower_words_of(t)), size) for t in texts]
                found = {int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64)): s.tobytes() for s in sets if len(s)}
                new = [c for c in found if c not in seen]
                seen.update(new)
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.int64()), pa.array([found[c] for c in new], pa.binary())],
                                                 names=["cls", "elements"])

    return picked.mapInArrow(run, "cls long, elements binary").dropDuplicates(["cls"])


def _linked(batches, percent: int):
    """Exact intersection of the two sorted arrays of each pair."""
    for batch in batches:
        a, b, sa, sb = (batch.column(i) for i in range(4))
        keep = []
        for i in range(batch.num_rows):
            x, y = np.frombuffer(sa[i].as_buffer(), np.uint64), np.frombuffer(sb[i].as_buffer(), np.uint64)
            if len(x) > len(y):
                x, y = y, x
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            both = int(np.count_nonzero(y[at] == x))
            if 100 * both >= percent * (len(x) + len(y) - both):
                keep.append(i)
        keep = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([a.take(keep), b.take(keep)], names=["a", "b"])


def _may_link(batches, percent: int):
    """Pairs that sizes and bitmaps allow: overlap <= (|x| + |y| - differing bits) / 2."""
    for batch in batches:
        nx, ny = np.asarray(batch.column(4)), np.asarray(batch.column(5))
        keep = np.flatnonzero(100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny))
        bx, by, good = batch.column(6), batch.column(7), []
        for i in keep.tolist():
            x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (bx, by))
            size = min(len(x), len(y))
            differ = int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum(dtype=np.int64))
            if (100 + percent) * (int(nx[i] + ny[i]) - differ) >= 2 * percent * int(nx[i] + ny[i]):
                good.append(i)
        yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(good, pa.int64())) for c in range(4)], names=["a", "b", "repa", "repb"])


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links among candidate pairs (a, b): bitmap bound, then exact."""
    for s in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("cls").alias(s), F.col("n").alias(f"n{s}"), F.col("bits").alias(f"bits{s}"),
                                          F.col("rep").alias(f"rep{s}")), s)
    pairs = pairs.select("a", "b", "repa", "repb", "na", "nb", "bitsa", "bitsb").mapInArrow(
        lambda it: _may_link(it, percent), "a long, b long, repa long, repb long")
    pairs = stored(pairs, "pairs")
    wanted = pairs.select(F.col("repa").alias("rep")).union(pairs.select("repb")).distinct()
    sets = stored(_sets(docs, wanted, size), "sets")
    # the larger class id first: it names few pairs, the smaller one may be the
    # pivot of thousands
    rows = (pairs.select("a", "b").join(sets.select(F.col("cls").alias("b"), F.col("elements").alias("sb")), "b")
            .join(sets.select(F.col("cls").alias("a"), F.col("elements").alias("sa")), "a").select("a", "b", "sa", "sb"))
    return stored(rows.mapInArrow(lambda it: _linked(it, percent), "a long, b long"), "links")


def _across(tiles: DataFrame, classes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes with a common pivot that stand in different
    components: all pairs that share a part, and were not compared yet, are
    among them."""
    comp = tiles.join(labels.select(F.col("v").alias("cls"), "comp"), "cls", "left").select("p", "cls", F.coalesce("comp", "cls").alias("comp"))
    # who is in a company: two independent 64-bit hashes, one by xor, one by
    # exact sums of its halves, which end beyond 2^31 classes
    other = F.xxhash64("cls", F.lit(1))
    open_ = (comp.groupBy("p").agg(F.count(F.lit(1)).alias("cnt"), F.bit_xor(F.xxhash64("cls")).alias("who"),
                                   F.sum(F.shiftright(other, 32)).alias("high"), F.sum(other.bitwiseAND(F.lit((1 << 32) - 1))).alias("low"),
                                   F.min("comp").alias("lo"), F.max("comp").alias("hi"))
             .where((F.col("cnt") > 1) & (F.col("lo") < F.col("hi")))
             .groupBy("cnt", "who", "high", "low").agg(F.min("p").alias("p")))  # the same company twice: once
    open_ = stored(open_.select("p", F.ceil(F.col("cnt") / BLOCK).cast("int").alias("blocks")), "open-tiles")
    rows = (comp.join(open_, "p").join(classes.select("cls", "n", "bits"), "cls")
            .withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("p", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "own", "cls", "comp", "n", "bits"))

    def block(table: pa.Table) -> pa.Table:
        bi, bj = table["bi"][0].as_py(), table["bj"][0].as_py()
        own, cls, comp, n = (np.asarray(table[c]) for c in ("own", "cls", "comp", "n"))
        raw = [np.frombuffer(b, np.uint64) for b in table["bits"].to_pylist()]
        size = min(map(len, raw))
        bits = np.stack([fold(b, size) for b in raw])
        left = np.flatnonzero(own == bi)
        aa, bb = [], []
        for i in left:
            rest = np.flatnonzero((own == bj) & (comp != comp[i]) & (cls != cls[i]))
            if bi == bj:
                rest = rest[rest > i]
            total = n[rest] + n[i]
            ok = 100 * np.minimum(n[rest], n[i]) >= percent * np.maximum(n[rest], n[i])
            rest, total = rest[ok], total[ok]
            differ = np.bitwise_count(bits[rest] ^ bits[i]).sum(axis=1, dtype=np.int64)
            rest = rest[(100 + percent) * (total - differ) >= 2 * percent * total]
            aa.append(np.minimum(cls[rest], cls[i]))
            bb.append(np.maximum(cls[rest], cls[i]))
        return pa.table({"a": pa.array(np.concatenate(aa) if aa else [], pa.int64()),
                         "b": pa.array(np.concatenate(bb) if bb else [], pa.int64())})

    return rows.groupBy("p", "bi", "bj").applyInArrow(block, "a long, b long").distinct()


def jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
                 percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest
    doc_id that links reach, itself included).

    Texts without words (null, empty, blanks) have no shingles and are linked
    with nothing: component_id is their own id.  A row with a null id keeps it;
    it is linked with rows of an equal set only, and its component_id is
    theirs, null if none of them has an id.  Repeated rows are linked with each other; other columns
    are ignored; an empty table gives no rows."""
    docs = slim(df, id_col, text_col)
    feat = stored(features(docs, size, percent), "shingles")
    sets = feat.where("cls is not null")
    reps = stored(sets.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n")), "classes")
    classes = stored(sets.join(reps.select(F.col("rep").alias("doc_id"), "cls"), ["doc_id", "cls"], "left_semi")
                     .select("cls", F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "bits").dropDuplicates(["cls"]), "bitmaps")
    # parts that only one class holds end here, after the one large shuffle;
    # of the others only the smallest class (pivot) and its company are kept
    part = Window.partitionBy("sig")
    tiles = (sets.select("cls", F.explode("sigs").alias("sig")).repartition("sig")
             .withColumn("p", F.min("cls").over(part)).where("p < cls").select("p", "cls").distinct())
    tiles = stored(tiles, "tiles")
    links = _verified(tiles.select(F.col("p").alias("a"), F.col("cls").alias("b")), classes, docs, size, percent)
    labels = connected_components(links)
    more = _verified(_across(tiles, classes, labels, percent), classes, docs, size, percent)
    if not more.isEmpty():
        labels = connected_components(links.union(more))
    named = reps.join(labels.select(F.col("v").alias("cls"), "comp"), "cls", "left").select("cls", "rep", F.coalesce("comp", "cls").alias("comp"))
    first = named.groupBy("comp").agg(F.min("rep").alias("component"))
    names = stored(named.join(first, "comp").select("cls", "component"), "components")
    out = feat.select("doc_id", "n_shingles", "cls").join(names, "cls", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"))
