"""The evaluation run: stand-in models as branches of one plan, the long
outputs table, one scores table and the reports built from it."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators import content as C
from pairloom.operators import fluency as FL
from pairloom.operators import judge as J
from pairloom.operators import rewrite as R
from pairloom.operators import splits as S
from pairloom.plans.corpus import Corpus, judge_training
from pairloom.session import materialized

log = logging.getLogger("pairloom")

# The four compared systems, in report order.
MODELS = ["pivot", "zero_shot", "synthetic", "few_shot"]
PIVOT = "en"
TARGETS = ["de", "es", "fr"]


class Evaluation:
    def __init__(self, corpus: Corpus, dict_size: int | None = None, few_shot_frac: float = 0.1,
                 custom_models: dict | None = None, with_judge: bool = True,
                 embeddings_table: str = "embeddings", shipped: Sequence[str] = MODELS,
                 examples: DataFrame | None = None, pairs: DataFrame | None = None,
                 judge: J.JudgeModel | None = None, fluency: FL.BigramModel | None = None,
                 vectors: DataFrame | None = None):
        """``custom_models``: {name: fn(examples) -> DataFrame with id and
        prediction}, e.g. a caller's neural model run through
        ``rewrite.map_text``; they join the comparison after the shipped
        ones.  A caller's own tables and models take the place of the derived
        ones: ``examples`` (id, lang, input, gold; unique ids), ``pairs``
        (pair_id, lang, split, src_raw, tgt_raw), ``judge`` and ``fluency``
        (as read by their ``read``), ``vectors`` (vec_id, embedding)."""
        self.c, self.k, self.frac = corpus, dict_size, few_shot_frac
        self.custom = dict(custom_models or {})
        # A2: without a style judge every text counts as biased (accuracy
        # 0.0); A4: an unreadable vector table gives similarity 0.0
        self.with_judge, self.embeddings_table = with_judge, embeddings_table
        self.shipped, self._examples, self._pairs = list(shipped), examples, pairs
        self.judge, self.fluency, self.vectors = judge, fluency, vectors
        self._memo: dict[str, DataFrame] = {}
        self._without_vectors = False

    def prepare(self, scorers: bool = False) -> "Evaluation":
        """Run what the reports share, once: the split pairs, the dictionary's
        ranks, the synthetic pairs, the pivot lexicon and the outputs of every
        model are written; with ``scorers`` the judge and the fluency model are
        trained too.  After it, building ``outputs``, ``scores`` or a report
        runs no job: those are plans over the written tables."""
        if self._examples is None or self.shipped:
            self.split_pairs()
        if set(self.shipped) & {"pivot", "synthetic", "few_shot"}:
            self.dictionary()
        if set(self.shipped) & {"synthetic", "few_shot"}:
            self.synthetic_train()
        if set(self.shipped) & {"pivot", "zero_shot"}:
            self.pivot_lexicon()
        self.outputs()
        if scorers:
            self.scorers()
        return self

    def scorers(self) -> tuple[J.JudgeModel | None, FL.BigramModel]:
        """The judge (none without one) and the fluency model, trained once;
        opens the vector table, if it is readable."""
        if self.fluency is None:
            self.fluency = FL.train_bigram(self.c.documents())
        if self.with_judge and self.judge is None:
            self.judge = J.train_judge(judge_training(self.c))
        if self.vectors is None and not self._without_vectors:
            try:
                self.vectors = self.c.t(self.embeddings_table, "vec_id", "embedding")
            except AnalysisException:
                self._without_vectors = True
        return (self.judge if self.with_judge else None), self.fluency

    def models(self) -> list[str]:
        return self.shipped + [m for m in self.custom if m not in self.shipped]

    def _once(self, key: str, build) -> DataFrame:
        """Tables that several branches read are written once to the
        shared checkpoint folder (and lineage is cut there)."""
        if key not in self._memo:
            self._memo[key] = materialized(build(), key)
        return self._memo[key]

    def split_pairs(self) -> DataFrame:
        return self._pairs if self._pairs is not None else self._once("split_pairs", self.c.split_pairs)

    def train_pairs(self) -> DataFrame:
        return self.split_pairs().where(F.col("split") == "train").drop("split")

    def dictionary(self) -> DataFrame:
        """The ranks behind it are written once; the join by rank is lazy."""
        if "dictionary" not in self._memo:
            self._memo["dictionary"] = R.rank_dictionary(self.c.documents(), PIVOT, self.k)
        return self._memo["dictionary"]

    def synthetic_pairs(self) -> DataFrame:
        return self._once("synthetic", self.synthetic_plan)

    def synthetic_train(self) -> DataFrame:
        """What the lexicons read of the synthetic pairs: the training texts,
        without the originals that each language repeats."""
        if "synthetic" in self._memo:
            train = self._memo["synthetic"].where(F.col("split") == "train")
            return train.select("pair_id", "lang", "src_raw", "tgt_raw")
        return self._once("synthetic_train", lambda: self.synthetic_plan().where(F.col("split") == "train").select(
            "pair_id", "lang", "src_raw", "tgt_raw"))

    def synthetic_plan(self) -> DataFrame:
        """Pivot-language train and val pairs translated into every
        target language (the test split is left out)."""
        en = self.split_pairs().where((F.col("lang") == PIVOT) & F.col("split").isin("train", "val"))
        x = en.select("pair_id", "split", F.col("src_raw").alias("src_en_original"), F.col("tgt_raw").alias("tgt_en_original"))
        texts = {"src_en_original": "src_raw", "tgt_en_original": "tgt_raw"}
        x = R.translate_to(x, self.dictionary(), "pair_id", texts, "lang", TARGETS)
        return x.select("pair_id", "lang", "split", "src_raw", "tgt_raw", "src_en_original", "tgt_en_original")

    def examples(self) -> DataFrame:
        """Held-out target-language pairs: input = biased source, gold =
        neutral target."""
        if self._examples is not None:
            return self._examples.select("id", "lang", "input", "gold")
        t = self.split_pairs().where((F.col("split") == "test") & (F.col("lang") != PIVOT))
        return t.select(F.col("pair_id").alias("id"), "lang", F.col("src_raw").alias("input"), F.col("tgt_raw").alias("gold"))

    def pivot_lexicon(self) -> DataFrame:
        return self._once("lex_pivot", lambda: R.learn_lexicon(self.train_pairs().where(F.col("lang") == PIVOT)))

    # read once each (by their own branch), from the materialised synthetic
    # corpus: no checkpoint of their own
    def synthetic_lexicon(self) -> DataFrame:
        return R.learn_lexicon(self.synthetic_train(), ["lang"])

    def few_shot_lexicon(self) -> DataFrame:
        return R.learn_lexicon(S.sample_frac(self.synthetic_train(), self.frac, ["pair_id", "lang"]), ["lang"])

    def changes(self, models: Sequence[str], vocabulary: DataFrame) -> DataFrame:
        """(model, lang, word, to): what the shipped models change in the
        words (lang, word) of the examples; no word is repeated per model."""
        out = None
        for m in models:
            if m == "zero_shot":  # learned in the pivot language, applied to all
                c = vocabulary.join(R.lexicon_changes(self.pivot_lexicon()), "word").select("lang", "word", "to")
            elif m == "synthetic":
                c = R.lexicon_changes(self.synthetic_lexicon(), ["lang"])
            elif m == "few_shot":
                c = R.lexicon_changes(self.few_shot_lexicon(), ["lang"])
            elif m == "pivot":
                c = R.pivot_changes(vocabulary, self.dictionary(), self.pivot_lexicon())
            else:
                raise ValueError(m)
            c = c.select(F.lit(m).alias("model"), "lang", "word", "to")
            out = c if out is None else out.unionByName(c)
        return out

    def rewritten(self, models: Sequence[str]) -> DataFrame:
        """The examples as the shipped ``models`` rewrite them, all in one
        pass: the words of an example are looked up once for all models."""
        ex = self.examples()
        changes = self.changes(models, R.text_words(ex, ["lang"], ["input"]))
        out = R.rewrite_words(ex, "id", {"input": "prediction"}, changes, ["lang"], {"model": list(models)})
        return out.select("id", "lang", "input", "gold", "model", "prediction")

    def branch(self, model: str) -> DataFrame:
        if model not in self.custom:
            return self.rewritten([model])
        ex = self.examples()
        pred = self.custom[model](ex).select("id", "prediction")
        return ex.join(pred, "id", "left").select("id", "lang", "input", "gold", F.lit(model).alias("model"), "prediction")

    def outputs(self, materialize: bool = True) -> DataFrame:
        """U8: every example x every model, as one long table.  It feeds
        several scorers and reports, so it is written once to the shared
        checkpoint folder (this also cuts the long lineage)."""
        if materialize and getattr(self, "_outputs", None) is not None:
            return self._outputs
        own = [m for m in self.shipped if m not in self.custom]
        out = self.rewritten(own) if own else None
        for m in self.custom:
            try:
                b = self.branch(m)
            except PySparkException:
                raise
            except Exception:
                # the caller's model could not even be built: every row fails
                log.exception("model %s failed", m)
                ex = self.examples()
                b = ex.select("id", "lang", "input", "gold", F.lit(m).alias("model"), F.lit(R.ERROR).alias("prediction"))
            out = b if out is None else out.unionByName(b)
        if materialize:
            out = materialized(out, "outputs")
            self._outputs = out
        return out

    def scores(self, outputs: DataFrame | None = None) -> DataFrame:
        """Style, content and fluency for every (example, model), as a
        plan; write it where several reports read it.  Every scorer reads the
        texts from the outputs, none runs the joins of the one before again."""
        long = self.outputs() if outputs is None else outputs
        ids = ["id", "model"]
        judge, lm = self.scorers()
        if judge is not None:
            s = J.score_judge(long, judge, ids, text="prediction", source=long)
        else:
            s = long.withColumn("style", F.lit(1))
        s = FL.perplexity(s, lm, ids, text="prediction", source=long)  # dealt as the judge's join left it
        if self.vectors is None:
            s = s.select("*", *[F.lit(0.0).alias(c) for c in ("p", "r", "f1")])
        else:
            s = C.content_f1(s, self.vectors, ids, "prediction", "input", source=long)
        return s.select(*[c for c in s.columns if c != "ppl"], "ppl")
