"""Batch text rewriting.

Shipped methods are classical stand-ins for the reference's neural
translators and neutralisers, with the same inputs and outputs:

* dictionary translation (U1): the rank-k most frequent word of the
  source language maps to the rank-k word of the target language; words
  outside the dictionary pass through.
* lexicon neutraliser (U2): words that revisions remove (present in the
  biased source, absent from the neutral target) in at least ``min_rate``
  of the pairs that contain them, with at least ``min_support`` such
  pairs, are dropped from the text.
* pivot chain (U3): translate to the pivot language, neutralise there,
  translate back.

All three change words one by one and in place (``rewrite_words``): only the
distinct words of a block of texts are joined with the table of changes, the
text itself stays with its row.

``map_text`` runs a caller's own model (for example a neural one) over
Arrow batches with ``mapInPandas``; failures are isolated per batch, then
per row, and never surface as a failed job."""

from __future__ import annotations

import logging
import sys
import types
import uuid
from collections.abc import Callable, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.functions.text import computed_once, hash_key, words
from pairloom.session import materialized

ERROR = "Error"


# ---- top-k per group, exact and skew-safe -----------------------------------

def top_k_per_group(df: DataFrame, group_cols: Sequence[str], order_cols, k: int, key: str, salts: int = 64,
                    rank_col: str = "rank") -> DataFrame:
    """Exact top-k rows per group, ranked 1..k by ``order_cols``.  A
    group may be huge (one language can hold most of the corpus), so the
    first window runs per (group, hash(key) mod salts) and keeps each
    part's k best; the final window sees at most salts*k rows per group."""
    salted = df.withColumn("_salt", F.pmod(hash_key(key), F.lit(salts)))
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*order_cols)
    cand = salted.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k).drop("_r1", "_salt")
    w2 = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return cand.withColumn(rank_col, F.row_number().over(w2)).where(F.col(rank_col) <= k)


# ---- U1: dictionary translation ----------------------------------------------

def dense_rank_rows(df: DataFrame, group_cols: Sequence[str], order_cols, rank_col: str = "rank") -> DataFrame:
    """Rank 1.. of every row of its group by ``order_cols`` (a total order),
    with no group in one task: the rows are cut into sorted ranges of (group,
    order), numbered inside their range and written once.  The first number
    and the count of each group in each range (groups x partitions rows, so
    bounded, and broadcast) turn a row's number into its rank."""
    g = list(group_cols)
    order = [*[F.asc(c) for c in g], *order_cols]
    cut = df.repartitionByRange(*order).sortWithinPartitions(*order)
    cut = materialized(cut.withColumn("_row", F.monotonically_increasing_id()), "ranks")  # range in the upper bits
    part = F.shiftright("_row", 33)
    sizes = cut.groupBy(*g, part.alias("_part")).agg(F.count(F.lit(1)).alias("_c"), F.min("_row").alias("_first"))
    before = Window.partitionBy(*g).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*g, "_part", (F.coalesce(F.sum("_c").over(before), F.lit(0)) - F.col("_first") + 1).alias("_off"))
    ranked = cut.withColumn("_part", part).join(F.broadcast(offsets), [*g, "_part"])
    return ranked.withColumn(rank_col, F.col("_off") + F.col("_row")).drop("_part", "_off", "_row")


def word_ranks(documents: DataFrame, k: int | None = None) -> DataFrame:
    """(lang, word, n, rank): the words of each language by frequency, ties
    broken by the word; all of them, or the first ``k``."""
    counts = (
        documents.where(F.col("lang").isNotNull())
        .select("lang", F.explode(words("text")).alias("word"))
        .groupBy("lang", "word")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    order = [F.desc("n"), F.asc("word")]
    if k is None:
        return dense_rank_rows(counts, ["lang"], order)
    return top_k_per_group(counts, ["lang"], order, k, "word")


def rank_dictionary(documents: DataFrame, pivot: str = "en", k: int | None = None) -> DataFrame:
    """(lang, pivot_word, word): rank-r word of ``pivot`` <-> rank-r word
    of every other language, for every rank that both have (up to ``k``
    where given)."""
    r = word_ranks(documents, k)
    p = r.where(F.col("lang") == pivot).select("rank", F.col("word").alias("pivot_word"))
    o = r.where(F.col("lang") != pivot).select("lang", "rank", "word")
    return o.join(p, "rank").select("lang", "pivot_word", "word")


# ---- rewriting in place -------------------------------------------------------

#: characters of text that a block holds on average
BLOCK_CHARS = 1 << 22


def _distinct_words(texts: Sequence[str]) -> Column:
    return F.array_distinct(F.concat(*[F.coalesce(words(t), F.array().cast("array<string>")) for t in texts]))


def text_words(df: DataFrame, cols: Sequence[str], texts: Sequence[str]) -> DataFrame:
    """(cols..., word): the vocabulary of the texts (for example per language)."""
    return df.select(*cols, F.explode(_distinct_words(texts)).alias("word")).distinct()


def rewrite_keyed(df: DataFrame, ids, keys: DataFrame, changes: DataFrame, texts: dict, rewrite, match_cols: Sequence[str] = ()) -> DataFrame:
    """Look up each row's distinct ``keys`` (ids..., match_cols..., word) in
    ``changes`` (match_cols..., word, to) and hand those found back to the row as two short arrays;
    ``rewrite(text, found, to)`` then makes each output.  The texts stay with
    their row: through the shuffle go keys, and back come the few that match.
    For keys of which few match; ``rewrite_words`` is for those that mostly do."""
    ids = [ids] if isinstance(ids, str) else list(ids)
    # the ids as one value, in which nulls are equal: grouped by it, the hits
    # lie where the join with their rows wants them
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(ids)]).alias("_key")
    found = keys.join(changes.select(*match_cols, "word", "to"), [*match_cols, "word"])
    hits = found.select(key, "word", "to").groupBy("_key").agg(F.collect_list(F.struct("word", "to")).alias("_hits"))
    out = df.withColumn("_key", key).join(hits, "_key", "left")
    keep = [k for k in df.columns if k not in texts.values()]
    return out.select(*keep, *[rewrite(F.col(t), F.col("_hits.word"), F.col("_hits.to")).alias(o) for t, o in texts.items()])


def _replaced(text: str | None, tables: Sequence[dict]) -> list[str | None]:
    """A text by each table, with its changed words replaced (null: dropped),
    in order; ``str.split`` is the word rule of C1."""
    if text is None:
        return [None] * len(tables)
    ws = text.split()
    return [" ".join([w for w in map(to.get, ws, ws) if w is not None] if to else ws) for to in tables]


def _by_block(texts: Sequence[str], match_cols: Sequence[str], variants: int):
    """The pass over one block: its rows and what becomes of its words."""
    texts, match = list(texts), list(match_cols)

    def matched(t: pa.Table, by: Sequence[str]) -> list:
        return list(zip(*[t[c].to_pylist() for c in by])) if by else [()] * t.num_rows

    def run(rows: pa.Table, changes: pa.Table) -> pa.Table:
        tables: list[dict] = []
        for i in range(variants):
            some = changes.filter(pc.is_valid(changes[f"_v{i}"]))
            to = pc.struct_field(some[f"_v{i}"].combine_chunks(), "to").to_pylist() if some.num_rows else []
            table: dict = {}
            for m, word, becomes in zip(matched(some, [f"_m{k}" for k in range(len(match))]), some["word"].to_pylist(), to):
                table.setdefault(m, {})[word] = becomes
            tables.append(table)
        of = matched(rows, match)
        columns = [rows[t].to_pylist() for t in texts]
        out = []
        for m, row in zip(of, zip(*columns)):
            made = [_replaced(text, [t.get(m, {}) for t in tables]) for text in row]
            out.append([{f"o{j}": variant[i] for j, variant in enumerate(made)} for i in range(variants)])
        kind = pa.list_(pa.struct([pa.field(f"o{j}", pa.string()) for j in range(len(texts))]))
        return rows.drop_columns(["_g"]).append_column("_out", pa.array(out, type=kind))

    return run


def rewrite_words(df: DataFrame, ids, texts: dict, changes: DataFrame, match_cols: Sequence[str] = (),
                  variants: dict | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Replace words in place.  ``changes`` is (match_cols..., word, to): words
    that change, each once, ``to`` null where the word is dropped.  ``texts``
    maps columns to outputs; other columns of ``df`` are kept (J3).

    The rows are dealt to blocks, whose number follows the length of the texts.
    Only the distinct words of a block are joined with ``changes``, each once
    and not once per row, and with all variants' changes at once; cogrouped
    with them, one pass over a row's own text replaces those that change in
    order.  No word carries a row or a position through a shuffle, nothing is
    collected per row.  ``variants`` {column: values} gives every row once per
    value, with the changes of that value (a column of ``changes``), after it
    met its words.  ``ids`` deal the rows (null is an id like others); a blank
    text gives '' and a null text stays null."""
    ids = [ids] if isinstance(ids, str) else list(ids)
    [(by, values)] = (variants or {None: [None]}).items()
    on = [*match_cols, "word"]
    if by:
        # one column per variant: null where it keeps the word
        c = changes.groupBy(*on).agg(*[F.max(F.when(F.col(by) == v, F.struct("to"))).alias(f"_v{i}") for i, v in enumerate(values)])
    else:
        c = changes.select(*on, F.struct("to").alias("_v0"))
    of = [f"_v{i}" for i in range(len(values))]
    length = sum([F.coalesce(F.length(t), F.lit(0)).cast("long") for t in texts], F.lit(0).cast("long"))
    blocks = df.agg(F.greatest(F.lit(1), F.ceil(F.sum(length) / block_chars)).alias("n")).select("n").scalar()
    keep = [k for k in df.columns if k not in (by, *texts.values())]
    # the texts too, which spread rows without an id; dealt once, the words of
    # a block are made distinct where they lie
    dealt = df.select(*dict.fromkeys([*keep, *texts, *match_cols]), F.pmod(F.xxhash64(*ids, *texts), F.coalesce(blocks, F.lit(1))).alias("_g"))
    kept_schema = T.StructType([*dealt.drop("_g").schema.fields, T.StructField("_out", T.ArrayType(T.StructType(
        [T.StructField(f"o{j}", T.StringType()) for j in range(len(texts))])))])
    dealt = dealt.repartition("_g")
    x = dealt.select("_g", *match_cols, F.explode(_distinct_words(list(texts))).alias("word")).distinct()
    met = x.join(c, on, "left").select(
        F.col("_g").alias("_h"), *[F.col(m).alias(f"_m{k}") for k, m in enumerate(match_cols)], "word", *of)
    done = dealt.groupBy("_g").cogroup(met.groupBy("_h")).applyInArrow(_by_block(list(texts), match_cols, len(values)), kept_schema)
    if by:
        done = done.select("*", F.inline(F.arrays_zip(F.array(*[F.lit(v) for v in values]).alias("v"), F.col("_out").alias("o"))))
    else:
        done = done.select("*", F.col("_out")[0].alias("o"))
    return done.select(*keep, *([F.col("v").alias(by)] if by else []), *[F.col(f"o.o{j}").alias(o) for j, o in enumerate(texts.values())])


def _mapping(text, out) -> dict:
    return dict(text) if isinstance(text, dict) else {text: out or text}


def dictionary_changes(dictionary: DataFrame, lang: str, to_pivot: bool) -> DataFrame:
    """(lang, word, to): what U1 replaces, out of a (lang, pivot_word, word) dictionary."""
    src, dst = ("word", "pivot_word") if to_pivot else ("pivot_word", "word")
    return dictionary.select(F.col("lang").alias(lang), F.col(src).alias("word"), F.col(dst).alias("to"))


def translate(df: DataFrame, dictionary: DataFrame, ids, text, lang: str, to_pivot: bool,
              out: str | None = None) -> DataFrame:
    """Word-by-word dictionary translation between the pivot language
    and the language in column ``lang`` (to the pivot when ``to_pivot``).
    ``text`` is one column (written to ``out``) or a {column: output}
    mapping, translated together.  Unknown words pass through."""
    return rewrite_words(df, ids, _mapping(text, out), dictionary_changes(dictionary, lang, to_pivot), [lang])


def translate_to(df: DataFrame, dictionary: DataFrame, ids, text: dict, lang: str, targets: Sequence[str]) -> DataFrame:
    """U1 from the pivot language into every language of ``targets``: each
    row once per target (column ``lang``), its words looked up once for all."""
    return rewrite_words(df, ids, text, dictionary_changes(dictionary, lang, False), (), {lang: list(targets)})


# ---- U2: lexicon neutraliser ----------------------------------------------

def learn_lexicon(pairs: DataFrame, group_cols: Sequence[str] = (), min_support: int = 2,
                  min_rate: float = 0.5) -> DataFrame:
    """(group..., word, pairs_with_word, removed, rate) for words that
    revisions remove.  ``array_except`` and ``array_intersect`` are hash
    based, linear per pair; each distinct source word is one row, and each
    side is split once."""
    g = list(group_cols)
    base = computed_once(pairs.select(*g, "src_raw", "tgt_raw"), _s=words("src_raw"), _t=words("tgt_raw"))
    kept = F.coalesce("_t", "_s")  # without a target nothing counts as removed
    parts = F.array(
        F.struct(F.array_intersect("_s", kept).alias("ws"), F.lit(0).alias("r")),
        F.struct(F.array_except("_s", kept).alias("ws"), F.lit(1).alias("r")),
    )
    rows = base.select(*g, F.inline(parts)).select(*g, F.explode("ws").alias("word"), F.col("r").alias("_r"))
    agg = rows.groupBy(*g, "word").agg(F.count(F.lit(1)).alias("pairs_with_word"), F.sum("_r").alias("removed"))
    agg = agg.withColumn("rate", F.col("removed") / F.col("pairs_with_word"))
    return agg.where((F.col("pairs_with_word") >= min_support) & (F.col("rate") >= min_rate))


def lexicon_changes(lexicon: DataFrame, match_cols: Sequence[str] = ()) -> DataFrame:
    """(match_cols..., word, to): what U2 drops (``to`` null)."""
    return lexicon.select(*match_cols, "word").distinct().withColumn("to", F.lit(None).cast("string"))


def neutralize(df: DataFrame, lexicon: DataFrame, ids, text, out: str | None = None,
               match_cols: Sequence[str] = ()) -> DataFrame:
    """U2 apply: drop lexicon words from ``text`` (one column, or a
    {column: output} mapping); ``match_cols`` (e.g. ``lang``) must also
    match between the row and the lexicon entry; ``ids`` must be unique."""
    return rewrite_words(df, ids, _mapping(text, out), lexicon_changes(lexicon, match_cols), match_cols)


# ---- U3: pivot chain --------------------------------------------------------

def pivot_changes(vocabulary: DataFrame, dictionary: DataFrame, lexicon: DataFrame, lang: str = "lang") -> DataFrame:
    """(lang, word, to): translate to the pivot language, drop the lexicon's
    words there, translate back, worked out once per word of the vocabulary
    (lang, word).  Each step is word by word, so the steps compose; no key of
    these joins occurs more than once per language."""
    to = dictionary_changes(dictionary, lang, True).withColumnRenamed("to", "_pivot")
    x = vocabulary.select(lang, "word").join(to, [lang, "word"], "left")
    x = x.select(lang, "word", F.coalesce("_pivot", "word").alias("_pivot"))
    dropped = lexicon.select(F.col("word").alias("_pivot"), F.lit(True).alias("_gone")).distinct()
    back = dictionary_changes(dictionary, lang, False).select(lang, F.col("word").alias("_pivot"), F.col("to").alias("_back"))
    x = x.join(dropped, "_pivot", "left").join(back, [lang, "_pivot"], "left")
    x = x.select(lang, "word", F.when(F.col("_gone"), F.lit(None)).otherwise(F.coalesce("_back", "_pivot")).alias("to"))
    return x.where(~F.col("to").eqNullSafe(F.col("word")))


# ---- U8: callers' models -------------------------------------------------

#: models that a Python worker keeps between its tasks
MODELS_KEPT = 4


def worker_model(key: str, factory: Callable):
    """The model of ``key``, built once per Python worker: workers outlive
    tasks (``spark.python.worker.reuse``).  This package travels by value, so
    its own globals are new in every task; the models are kept in a module of
    the worker process."""
    kept = vars(sys.modules.setdefault("_pairloom_models", types.ModuleType("_pairloom_models")))
    models = kept.setdefault("models", {})
    if key not in models:
        while len(models) >= MODELS_KEPT:
            models.pop(next(iter(models)))
        models[key] = factory()
    return models[key]


def map_text(df: DataFrame, in_col: str, out_col: str, factory: Callable[[], Callable[[list], list]],
             batch_size: int = 128, fail_model: bool = False) -> DataFrame:
    """Run a caller's batch model ``factory()(texts) -> texts`` over
    ``in_col`` in Arrow batches (the model is built once per Python
    worker).  A batch that raises, or gives another number of outputs, is
    retried row by row; a row that still fails becomes "Error", as every row
    does where the model cannot be built; both are logged in the worker.
    With ``fail_model=True`` every row becomes "Error" as
    soon as any row failed (a whole-model rule), through a
    global flag computed in the same job."""
    key = uuid.uuid4().hex
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.StringType())])

    def run(batches):
        log = logging.getLogger("pairloom")
        try:
            model = worker_model(key, factory)
        except Exception:  # model cannot be built: every row fails
            log.exception("model for %s cannot be built", out_col)
            model = None
        failed = 0
        for pdf in batches:
            texts = pdf[in_col].tolist()
            outs: list = []
            for i in range(0, len(texts), batch_size):
                chunk = texts[i : i + batch_size]
                try:
                    if model is None:
                        raise RuntimeError("model unavailable")
                    got = list(model(chunk))
                    if len(got) != len(chunk):
                        raise ValueError(f"model gave {len(got)} outputs for {len(chunk)} texts")
                    got = [str(g) if g is not None else "" for g in got]
                except Exception:
                    got = []
                    for t in chunk:
                        try:
                            if model is None:
                                raise RuntimeError("model unavailable")
                            r = list(model([t]))
                            if len(r) != 1:
                                raise ValueError(f"model gave {len(r)} outputs for one text")
                            got.append(str(r[0]) if r[0] is not None else "")
                        except Exception:
                            failed += 1
                            got.append(ERROR)
                outs.extend(got)
            yield pdf.assign(**{out_col: pd.Series(outs, index=pdf.index, dtype=object)})
        if failed:
            log.warning("model for %s failed on %d rows of a task", out_col, failed)

    mapped = df.mapInPandas(run, schema)
    if not fail_model:
        return mapped
    # the flag and the rows must come from one model run: materialise the
    # outputs once in the shared checkpoint folder
    mapped = materialized(mapped, "model-outputs")
    failed = mapped.agg(F.max((F.col(out_col) == ERROR).cast("int")).alias("_f")).select("_f").scalar()
    return mapped.withColumn(out_col, F.when(failed == 1, F.lit(ERROR)).otherwise(F.col(out_col)))
