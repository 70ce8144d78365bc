"""URL filters by a character language-model ratio (operator 9, DataFrame
functions only).

Rules decide the urls they fit.  Two variable-order Markov models, one of the
urls that rules allow and one of those that rules block, decide the rest: the
order backs off from ``ORDER`` characters of context to none, each order
smoothed towards the next lower one by its number of distinct continuations
(Witten-Bell), the lowest towards a uniform alphabet.  A url's score is its
mean log-probability ratio per character, and the threshold is calibrated on
the scores of the urls that the rules decided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm.common import stored

ORDER = 4
ALPHABET = 256.0
START = "\u0002"
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #`` or the end, A-Z
    lower-cased; path: from there up to ``? #`` or the end; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_and_verdict(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule (equal lengths: the smaller text) and what it says."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        rhost, _, rpath = text.partition("/")
        fits = ((host == rhost) | host.endswith("." + rhost)) & path.startswith("/" + rpath)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def grams(urls: DataFrame) -> DataFrame:
    """(page, ctx, c) for every character of every url; a url begins after
    ``ORDER`` start marks."""
    padded = F.concat(F.lit(START * ORDER), F.col("url"))
    return (urls.select("page", "said", padded.alias("u"))
            .select("page", "said", "u", F.explode(F.sequence(F.lit(1), F.length("u") - ORDER)).alias("i"))
            .select("page", "said", F.col("u").substr(F.col("i"), F.lit(ORDER)).alias("ctx"),
                    F.col("u").substr(F.col("i") + ORDER, F.lit(1)).alias("c")))


def log_ratios(counted: DataFrame) -> DataFrame:
    """(ctx, c, llr) for each distinct gram of ``counted`` (ctx, c, na, nr)."""
    lower = None
    for k in range(ORDER + 1):
        key = F.right("ctx", F.lit(k)) if k < ORDER else F.col("ctx")
        if k == 0:
            key = F.lit("")
        level = counted.select(key.alias("ctx"), "c", "na", "nr").groupBy("ctx", "c").agg(
            F.sum("na").alias("na"), F.sum("nr").alias("nr"))
        totals = level.groupBy(F.col("ctx").alias("tctx")).agg(
            F.sum("na").alias("sa"), F.sum("nr").alias("sr"),
            F.sum((F.col("na") > 0).cast("long")).alias("ta"), F.sum((F.col("nr") > 0).cast("long")).alias("tr"))
        level = level.join(totals, F.col("ctx") == F.col("tctx")).drop("tctx")
        if lower is None:
            level = level.withColumns({"qa": F.lit(1 / ALPHABET), "qr": F.lit(1 / ALPHABET)})
        else:
            below = lower.select(F.col("ctx").alias("lctx"), F.col("c").alias("lc"),
                                 F.col("pa").alias("qa"), F.col("pr").alias("qr"))
            level = level.join(below, (F.right("ctx", F.lit(k - 1)) if k > 1 else F.lit("")).eqNullSafe(F.col("lctx"))
                               & (F.col("c") == F.col("lc"))).drop("lctx", "lc")

        def smooth(n, s, t, q):
            return F.when(F.col(s) > 0, (F.col(n) + F.col(t) * F.col(q)) / (F.col(s) + F.col(t))).otherwise(F.col(q))

        lower = level.select("ctx", "c", smooth("na", "sa", "ta", "qa").alias("pa"), smooth("nr", "sr", "tr", "qr").alias("pr"))
    return lower.select("ctx", "c", (F.log("pa") - F.log("pr")).alias("llr"))


def url_filter(df: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, score.

    Urls are scored once per distinct text, so copies of a url cost one score.
    An empty or null url without a rule scores 0 and is allowed if 0 reaches
    the threshold.  Without urls of both kinds the threshold is 0 and every
    score is 0 or one-sided; the verdict follows the same comparison.  Null
    ids stay null, repeated rows are judged alike, other columns are ignored,
    no rows give no rows."""
    host, path = host_path(F.col("url"))
    pages = df.select(df[id_col].alias("page_id"), df[url_col].cast("string").alias("url"))
    pages = pages.withColumns({"host": host, "path": path})
    rule, said = rule_and_verdict(F.col("host"), F.col("path"), rules)
    pages = pages.withColumns({"rule": rule, "said": said})
    distinct = pages.where(F.coalesce(F.length("url"), F.lit(0)) > 0).groupBy(F.col("url")).agg(
        F.first("said").alias("said"), F.count(F.lit(1)).alias("copies"))
    urls = distinct.withColumn("page", F.xxhash64("url"))
    occurrences = grams(urls)
    counted = occurrences.groupBy("ctx", "c").agg(
        F.sum((F.col("said") == "allow").cast("long")).alias("na"),
        F.sum((F.col("said") == "block").cast("long")).alias("nr"))
    counted = stored(counted.select("ctx", "c", F.coalesce("na", F.lit(0)).alias("na"), F.coalesce("nr", F.lit(0)).alias("nr")), "url-grams")
    ratios = stored(log_ratios(counted), "url-ratios").select(F.col("ctx").alias("rctx"), F.col("c").alias("rc"), "llr")
    # to plain sums of whole numbers, so that the order of adding does not matter
    scored = (occurrences.join(ratios, (F.col("ctx") == F.col("rctx")) & (F.col("c") == F.col("rc")))
              .groupBy("page", "said").agg((F.sum(F.round(F.col("llr") * 1e6).cast("long")) / F.count(F.lit(1)) / 1e6).alias("score")))
    scored = stored(scored, "url-scores")
    side = scored.where(F.col("said").isNotNull()).groupBy("said").agg(
        F.avg("score").alias("m"), F.coalesce(F.stddev_pop("score"), F.lit(0.0)).alias("s")).collect()  # two rows at most
    threshold = calibrated({r["said"]: (r["m"], r["s"]) for r in side})
    scores = scored.select(F.col("page").alias("spage"), "score")
    out = pages.withColumn("page", F.xxhash64("url")).join(scores, F.col("page") == F.col("spage"), "left")
    score = F.coalesce("score", F.lit(0.0))
    return out.select("page_id", "host", "path", "rule",
                      F.coalesce("said", F.when(score >= threshold, "allow").otherwise("block")).alias("verdict"),
                      score.alias("score"))


def calibrated(sides: dict[str, tuple[float, float]]) -> float:
    """The place between the two mean scores that lies as many standard
    deviations from the one as from the other; 0 unless both sides exist."""
    if set(sides) != {"allow", "block"}:
        return 0.0
    (ma, sa), (mr, sr) = sides["allow"], sides["block"]
    return (ma + mr) / 2 if sa + sr == 0 else (ma * sr + mr * sa) / (sa + sr)


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet")
    return url_filter(pages)
