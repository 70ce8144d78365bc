"""DuckDB SQL oracles, one per registered query (same column names).

Written independently of the Spark code, from the operator definitions."""

from __future__ import annotations

WORDS = "list_filter(string_split_regex({x}, '[\\t-\\r\\x1c-\\x20\\x{{85}}\\p{{Z}}]+'), lambda w: w <> '')"


def words(x: str) -> str:
    return WORDS.format(x=x)


HASH = "('0x' || substr(md5({x}), 1, 8))::BIGINT"


def hkey(*parts: str) -> str:
    return HASH.format(x="'42:' || " + " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts))


PAIRS = f"""
pw AS (SELECT doc_id, lang, text, {words('text')} AS ws FROM documents
       WHERE doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL),
pk AS (SELECT doc_id, lang, text, ws[1:5] AS k5 FROM pw WHERE len(ws) >= 5),
pl AS (SELECT doc_id AS pair_id, lang, text AS tgt_raw,
              lag(text) OVER (PARTITION BY lang, k5 ORDER BY doc_id) AS src_raw FROM pk),
pairs AS (SELECT pair_id, lang, src_raw, tgt_raw FROM pl WHERE src_raw IS NOT NULL)"""

STATS = f"""
stats AS (SELECT *, len(s)::INTEGER AS n_src, len(t)::INTEGER AS n_tgt, greatest(len(s), len(t))::INTEGER AS n_max
          FROM (SELECT *, {words('src_raw')} AS s, {words('tgt_raw')} AS t FROM pairs))"""

# Exact word-level Levenshtein: words -> integer codes, shared prefix and
# suffix trimmed, then an anti-diagonal dynamic program in a recursive CTE
# keyed by pair (each step depends on the two previous diagonals only).
DIST = """
de AS (SELECT pair_id, list_distinct(list_concat(s, t)) AS dic, s, t FROM stats),
dc AS (SELECT pair_id, list_transform(s, lambda x: list_position(dic, x)) AS a,
                       list_transform(t, lambda x: list_position(dic, x)) AS b FROM de),
df AS (SELECT pair_id, a, b, coalesce(list_position(list_transform(range(1, least(len(a), len(b)) + 1),
                 lambda i: a[i] = b[i]), false) - 1, least(len(a), len(b))) AS pre FROM dc),
dg AS (SELECT pair_id, a[pre + 1:] AS a, b[pre + 1:] AS b FROM df),
dh AS (SELECT pair_id, a, b, coalesce(list_position(list_transform(range(1, least(len(a), len(b)) + 1),
                 lambda i: a[len(a) + 1 - i] = b[len(b) + 1 - i]), false) - 1, least(len(a), len(b))) AS suf FROM dg),
dq AS (SELECT pair_id, a[1:len(a) - suf] AS s, b[1:len(b) - suf] AS t FROM dh),
dp(pair_id, d, n, m, s, t, p1, p2) USING KEY (pair_id) AS (
  SELECT pair_id, 1, len(s), len(t), s, t, [1, 1], [0] FROM dq WHERE len(s) > 0 AND len(t) > 0
  UNION
  SELECT pair_id, d + 1, n, m, s, t,
    list_transform(range(greatest(0, d + 1 - m), least(n, d + 1) + 1),
      lambda i: CASE WHEN i = 0 OR i = d + 1 THEN d + 1
        ELSE least(p1[i - greatest(0, d - m)] + 1,
                   p1[i - greatest(0, d - m) + 1] + 1,
                   p2[i - greatest(0, d - 1 - m)] + CASE WHEN s[i] = t[d + 1 - i] THEN 0 ELSE 1 END) END),
    p1
  FROM dp WHERE d < n + m
),
dist AS (SELECT dq.pair_id, coalesce(dp.p1[1], greatest(len(dq.s), len(dq.t)))::INTEGER AS dist
         FROM dq LEFT JOIN dp USING (pair_id)),
ed AS (SELECT stats.*, dist.dist, dist.dist::DOUBLE / nullif(stats.n_max, 0) AS ratio
       FROM stats JOIN dist USING (pair_id))"""

KEPT = """
kept AS (SELECT * FROM ed WHERE n_src > 0 AND n_tgt > 0 AND dist >= 2 AND ratio <= 0.4)"""

SPLIT = f"""
sr AS (SELECT *, row_number() OVER (ORDER BY {hkey('pair_id')}, pair_id) - 1 AS rnk,
              count(*) OVER () AS n FROM pairs),
sz AS (SELECT *, (n + 4) // 5 AS tmp FROM sr),
split AS (SELECT *, CASE WHEN rnk < n - tmp THEN 'train'
                         WHEN rnk < n - tmp + (tmp - (tmp + 1) // 2) THEN 'val' ELSE 'test' END AS split FROM sz),
train AS (SELECT pair_id, lang, src_raw, tgt_raw FROM split WHERE split = 'train')"""

LABELLED = """
lt AS (SELECT pair_id, src_raw AS text, 1 AS label FROM pairs
       UNION ALL SELECT pair_id, tgt_raw AS text, 0 AS label FROM pairs)"""


def w(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join(ctes) + "\n"


ORACLE_SQL: dict[str, str] = {
    "revision_pairs": w(PAIRS) + "SELECT * FROM pairs",
    "word_stats": w(PAIRS, STATS) + "SELECT pair_id, lang, n_src, n_tgt, n_max FROM stats",
    "word_edit_distance": w(PAIRS, STATS, DIST)
    + "SELECT pair_id, n_src, n_tgt, dist, round(ratio, 6) AS ratio FROM ed",
    "structural_filter": w(PAIRS, STATS, DIST, KEPT)
    + "SELECT pair_id, lang, src_raw, tgt_raw, n_src, n_tgt, dist, round(ratio, 6) AS ratio FROM kept",
    "split_80_10_10": w(PAIRS, SPLIT) + "SELECT pair_id, split FROM split",
    "labelled_texts": w(PAIRS, LABELLED) + "SELECT pair_id, text, label FROM lt",
    "judge_split": w(PAIRS, LABELLED)
    + f"""SELECT pair_id, label, CASE WHEN rnk < n - (n + 9) // 10 THEN 'train' ELSE 'val' END AS split
    FROM (SELECT *, row_number() OVER (ORDER BY {hkey('pair_id', 'label')}, pair_id, label) - 1 AS rnk,
                 count(*) OVER () AS n FROM lt)""",
    "judge_split_grouped": w(PAIRS, LABELLED)
    + f"""SELECT pair_id, label, CASE WHEN rnk < n - (n + 9) // 10 THEN 'train' ELSE 'val' END AS split
    FROM lt JOIN (SELECT pair_id, row_number() OVER (ORDER BY {hkey('pair_id')}, pair_id) - 1 AS rnk,
                         count(*) OVER () AS n FROM pairs) USING (pair_id)""",
    "curated_split": w(PAIRS, STATS, DIST, KEPT, SPLIT.replace("FROM pairs", "FROM kept"))
    + "SELECT pair_id, lang, split FROM split",
    "dense_ids": w(PAIRS, SPLIT) + 'SELECT pair_id, rnk AS "ID" FROM split',
    "sample_n": w(PAIRS) + f"SELECT pair_id, lang FROM pairs ORDER BY {hkey('pair_id')}, pair_id LIMIT 100",
    "sample_frac": w(PAIRS, SPLIT)
    + f"""SELECT pair_id, lang FROM (SELECT *, row_number() OVER (ORDER BY {hkey('pair_id')}, pair_id) - 1 AS rnk,
                 count(*) OVER () AS n FROM train) WHERE rnk < round_even(0.1 * n, 0)""",
    "stage_counts": w(PAIRS, STATS, DIST, KEPT, SPLIT)
    + """SELECT 'documents' AS stage, count(*)::BIGINT AS n FROM documents
    UNION ALL SELECT 'pairs', count(*) FROM pairs
    UNION ALL SELECT 'kept', count(*) FROM kept
    UNION ALL SELECT split, count(*) FROM split GROUP BY split""",
    "budget": w(PAIRS, SPLIT)
    + f"""SELECT percent, n, n // 32 AS steps_per_epoch,
           greatest(10, ceil(600 / greatest(1, n // 32)))::BIGINT AS epochs
    FROM (SELECT p AS percent, (SELECT count(*) FROM (SELECT row_number() OVER (ORDER BY {hkey('pair_id')}, pair_id) - 1 AS rnk,
                 count(*) OVER () AS n FROM train) WHERE rnk < round_even(p / 100.0 * n, 0))::BIGINT AS n
          FROM (VALUES (1), (10)) v(p))""",
}

JUDGE = f"""
jt AS (SELECT d.text, l.toxic AS label FROM documents d JOIN labels l USING (doc_id)),
jw AS (SELECT label, unnest({words('text')}) AS word FROM jt),
jc AS (SELECT word, sum(CASE WHEN label = 0 THEN 1 ELSE 0 END)::BIGINT AS c0,
              sum(CASE WHEN label = 1 THEN 1 ELSE 0 END)::BIGINT AS c1 FROM jw GROUP BY word),
jtot AS (SELECT sum(c0) AS t0, sum(c1) AS t1, count(*) AS v FROM jc),
jm AS (SELECT word, c0, c1, ln((c0 + 1) / (t0 + v)) AS lp0, ln((c1 + 1) / (t1 + v)) AS lp1 FROM jc, jtot),
jp AS (SELECT CASE WHEN n0 > 0 THEN ln(n0 / (n0 + n1)) ELSE '-Infinity'::DOUBLE END AS p0,
              CASE WHEN n1 > 0 THEN ln(n1 / (n0 + n1)) ELSE '-Infinity'::DOUBLE END AS p1 FROM
        (SELECT sum(CASE WHEN label = 0 THEN 1 ELSE 0 END)::DOUBLE AS n0,
                sum(CASE WHEN label = 1 THEN 1 ELSE 0 END)::DOUBLE AS n1 FROM jt))"""


def judge_scores(src: str, ids: str, text: str = "text", name: str = "scored") -> str:
    """CTEs scoring ``src`` (with key columns ``ids``) into ``name``."""
    return f"""
{name}_w AS (SELECT {ids}, word, count(*) AS k FROM
        (SELECT {ids}, unnest({words(text)}) AS word FROM {src}) GROUP BY ALL),
{name}_s AS (SELECT {ids}, sum(k * lp0) AS s0, sum(k * lp1) AS s1 FROM {name}_w JOIN jm USING (word) GROUP BY ALL),
{name} AS (SELECT x.*, CASE WHEN jp.p1 + coalesce(s.s1, 0) > jp.p0 + coalesce(s.s0, 0) THEN 1 ELSE 0 END AS style
           FROM {src} x LEFT JOIN {name}_s s USING ({ids}), jp)"""


def bigram_rows(src: str, ids: str, text: str) -> str:
    return f"""(SELECT {ids}{',' if ids else ''} seq[i] AS u, seq[i + 1] AS w FROM
        (SELECT {ids}{',' if ids else ''} seq, unnest(range(1, len(seq))) AS i FROM
          (SELECT {ids}{',' if ids else ''} ['<s>'] || ws || ['</s>'] AS seq FROM
            (SELECT {ids}{',' if ids else ''} {words(text)} AS ws FROM {src}) WHERE len(ws) > 0)))"""


LM = f"""
fc AS (SELECT u, w, count(*) AS c FROM {bigram_rows('documents', '', 'text')} GROUP BY u, w),
fx AS (SELECT u, sum(c) AS cu FROM fc GROUP BY u),
fv AS (SELECT count(DISTINCT w) AS v FROM fc)"""


def ppl_scores(src: str, ids: str, text: str = "text", name: str = "ppl") -> str:
    return f"""
{name}_b AS (SELECT {ids}, u, w, count(*) AS k FROM {bigram_rows(src, ids, text)} GROUP BY ALL),
{name}_s AS (SELECT {ids}, exp(-sum(k * (ln(coalesce(c, 0) + 1) - ln(coalesce(cu, 0) + v))) / sum(k)) AS ppl
             FROM {name}_b LEFT JOIN fc USING (u, w) LEFT JOIN fx USING (u), fv GROUP BY ALL),
{name} AS (SELECT x.*, s.ppl FROM {src} x LEFT JOIN {name}_s s USING ({ids}))"""


EMB = f"""
emb_n AS (SELECT count(*) AS n FROM embeddings),
emb AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u
        FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))"""


EMB_DIRTY = """
dirty AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN NULL WHEN vec_id % 11 = 0
                 THEN list_transform(embedding, lambda x: (x * 0)::FLOAT) ELSE embedding END AS embedding FROM embeddings
          UNION ALL SELECT vec_id, list_reverse(embedding) FROM embeddings WHERE vec_id % 5 = 0),
emb_n AS (SELECT count(*) AS n FROM dirty),
emb_1 AS (SELECT vec_id, e FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM dirty WHERE embedding IS NOT NULL)
          WHERE list_sum(list_transform(e, lambda x: x * x)) > 0
          QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY e) = 1),
emb AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u FROM emb_1)"""


def content_scores(src: str, ids: str, cand: str, ref: str, name: str = "cs") -> str:
    on = " AND ".join(f"a.{i.strip()} = b.{i.strip()}" for i in ids.split(","))
    return f"""
{name}_t AS (SELECT {ids}, side, {HASH.format(x="'42:' || word")} % (SELECT n FROM emb_n) AS vec_id, count(*) AS k FROM
      (SELECT {ids}, 0 AS side, unnest({words(cand)}) AS word FROM {src}
       UNION ALL SELECT {ids}, 1 AS side, unnest({words(ref)}) AS word FROM {src}) GROUP BY ALL),
{name}_v AS (SELECT t.*, emb.u FROM {name}_t t JOIN emb USING (vec_id)),
{name}_m AS (SELECT {', '.join('a.' + i.strip() for i in ids.split(','))}, a.side, a.vec_id, a.k,
                    max(list_dot_product(a.u, b.u)) AS best
             FROM {name}_v a JOIN {name}_v b ON {on} AND a.side <> b.side GROUP BY ALL),
{name}_pr AS (SELECT {ids}, sum(CASE WHEN side = 0 THEN k * best END) / sum(CASE WHEN side = 0 THEN k END) AS p,
                     sum(CASE WHEN side = 1 THEN k * best END) / sum(CASE WHEN side = 1 THEN k END) AS r
              FROM {name}_m GROUP BY ALL),
{name} AS (SELECT x.*, coalesce(pr.p, 0) AS p, coalesce(pr.r, 0) AS r,
                  coalesce(CASE WHEN pr.p + pr.r <> 0 THEN 2 * pr.p * pr.r / (pr.p + pr.r) END, 0) AS f1
           FROM {src} x LEFT JOIN {name}_pr pr USING ({ids}))"""


ORACLE_SQL.update(
    {
        "judge_model": w(JUDGE) + "SELECT word, c0, c1, round(lp0, 6) AS lp0, round(lp1, 6) AS lp1 FROM jm",
        "style_judge": w(JUDGE, judge_scores("conversations", "conv_id, turn"))
        + "SELECT conv_id, turn, style FROM scored",
        "style_accuracy": w(JUDGE, judge_scores("conversations", "conv_id, turn"))
        + "SELECT role, round(avg(CASE WHEN style = 0 THEN 1.0 ELSE 0.0 END), 6) AS style_acc FROM scored GROUP BY role",
        "fluency_ppl": w(LM, ppl_scores("conversations", "conv_id, turn"))
        + "SELECT conv_id, turn, round(ppl, 4) AS ppl FROM ppl",
        "fluency_mean": w(LM, ppl_scores("conversations", "conv_id, turn"))
        + """SELECT role, round(coalesce(avg(CASE WHEN NOT isnan(ppl) THEN ppl END), 'Infinity'::DOUBLE), 4) AS ppl_mean
        FROM ppl GROUP BY role""",
        "content_f1": w(PAIRS, EMB, content_scores("pairs", "pair_id", "tgt_raw", "src_raw"))
        + "SELECT pair_id, round(p, 6) AS p, round(r, 6) AS r, round(f1, 6) AS f1 FROM cs",
        "content_f1_dirty": w(PAIRS, EMB_DIRTY, content_scores("pairs", "pair_id", "tgt_raw", "src_raw"))
        + "SELECT pair_id, round(p, 6) AS p, round(r, 6) AS r, round(f1, 6) AS f1 FROM cs",
        "content_mean": w(PAIRS, EMB, content_scores("pairs", "pair_id", "tgt_raw", "src_raw"))
        + "SELECT lang, round(avg(f1), 6) AS content_mean FROM cs GROUP BY lang",
    }
)

# ---- rewriting and reports ----------------------------------------------

MODELS = ["pivot", "zero_shot", "synthetic", "few_shot"]
TARGETS = ["de", "es", "fr"]

DICT = f"""
wc AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest({words('text')}) AS word FROM documents) GROUP BY ALL),
wr AS MATERIALIZED (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank
                    FROM wc WHERE lang IS NOT NULL),
dict AS MATERIALIZED (SELECT o.lang, p.pivot_word, o.word FROM (SELECT lang, rank, word FROM wr WHERE lang <> 'en') o
         JOIN (SELECT rank, word AS pivot_word FROM wr WHERE lang = 'en') p ON o.rank = p.rank)"""


def _cols(ids):
    return ", ".join(ids)


def translate_sql(name, src, ids, text, out, to_pivot):
    f, t = ("word", "pivot_word") if to_pivot else ("pivot_word", "word")
    on_ids = " AND ".join(f"x.{i} = a.{i}" for i in ids)
    return f"""
{name}_e AS (SELECT {_cols(ids)}, lg, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos
             FROM (SELECT {_cols(ids)}, lang AS lg, {words(text)} AS ws FROM {src})),
{name}_j AS (SELECT {_cols('e.' + i for i in ids)}, e.pos, coalesce(d.{t}, e.word) AS w
             FROM {name}_e e LEFT JOIN dict d ON d.lang = e.lg AND d.{f} = e.word),
{name}_a AS (SELECT {_cols(ids)}, string_agg(w, ' ' ORDER BY pos) AS t FROM {name}_j GROUP BY ALL),
{name} AS (SELECT x.*, CASE WHEN x.{text} IS NULL THEN NULL ELSE coalesce(a.t, '') END AS {out}
           FROM {src} x LEFT JOIN {name}_a a ON {on_ids})"""


def lexicon_sql(name, src, group):
    g = [group] if group else []
    gs = "".join(f"{c}, " for c in g)
    return f"""
{name}_b AS (SELECT {gs}list_distinct(s) AS al, list_filter(list_distinct(s), lambda x: NOT list_contains(t, x)) AS rem
             FROM (SELECT {gs}{words('src_raw')} AS s, {words('tgt_raw')} AS t FROM {src})),
{name}_r AS (SELECT {gs}unnest(al) AS word, 1 AS tt, 0 AS rr FROM {name}_b
             UNION ALL SELECT {gs}unnest(rem) AS word, 0 AS tt, 1 AS rr FROM {name}_b),
{name} AS (SELECT {gs}word, sum(tt)::BIGINT AS pairs_with_word, sum(rr)::BIGINT AS removed, sum(rr) / sum(tt) AS rate
           FROM {name}_r GROUP BY ALL HAVING sum(tt) >= 2 AND sum(rr) / sum(tt) >= 0.5)"""


def neutralize_sql(name, src, lex, ids, text, out, match_lang):
    cond = " AND l.lang = e.lg" if match_lang else ""
    on_ids = " AND ".join(f"x.{i} = a.{i}" for i in ids)
    return f"""
{name}_e AS (SELECT {_cols(ids)}, lg, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos
             FROM (SELECT {_cols(ids)}, lang AS lg, {words(text)} AS ws FROM {src})),
{name}_k AS (SELECT * FROM {name}_e e WHERE NOT EXISTS (SELECT 1 FROM {lex} l WHERE l.word = e.word{cond})),
{name}_a AS (SELECT {_cols(ids)}, string_agg(word, ' ' ORDER BY pos) AS t FROM {name}_k GROUP BY ALL),
{name} AS (SELECT x.*, CASE WHEN x.{text} IS NULL THEN NULL ELSE coalesce(a.t, '') END AS {out}
           FROM {src} x LEFT JOIN {name}_a a ON {on_ids})"""


SYNTH = (
    f"""
sx AS (SELECT s.pair_id, s.split, l.lang, s.src_raw AS src_en_original, s.tgt_raw AS tgt_en_original
       FROM split s, (VALUES {', '.join(f"('{t}')" for t in TARGETS)}) l(lang)
       WHERE s.lang = 'en' AND s.split IN ('train', 'val')),"""
    + translate_sql("sx1", "sx", ["pair_id", "lang"], "src_en_original", "src_raw", False)
    + ","
    + translate_sql("sx2", "sx1", ["pair_id", "lang"], "tgt_en_original", "tgt_raw", False)
    + """,
synth AS (SELECT pair_id, lang, split, src_raw, tgt_raw, src_en_original, tgt_en_original FROM sx2),
synth_train AS (SELECT * FROM synth WHERE split = 'train'),
few AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY """
    + hkey("pair_id", "lang")
    + """, pair_id, lang) - 1 AS rnk,
               count(*) OVER () AS n FROM synth_train) WHERE rnk < round_even(0.1 * n, 0)),
en_train AS (SELECT * FROM train WHERE lang = 'en'),"""
    + lexicon_sql("lex_en", "en_train", None)
    + ","
    + lexicon_sql("lex_syn", "synth_train", "lang")
    + ","
    + lexicon_sql("lex_few", "few", "lang")
)

EXAMPLES = """
ex AS (SELECT pair_id AS id, lang, src_raw AS input, tgt_raw AS gold FROM split WHERE split = 'test' AND lang <> 'en')"""

BRANCHES = (
    neutralize_sql("b_zero", "ex", "lex_en", ["id"], "input", "prediction", False)
    + ","
    + neutralize_sql("b_syn", "ex", "lex_syn", ["id"], "input", "prediction", True)
    + ","
    + neutralize_sql("b_few", "ex", "lex_few", ["id"], "input", "prediction", True)
    + ","
    + translate_sql("bp1", "ex", ["id"], "input", "_en", True)
    + ","
    + neutralize_sql("bp2", "bp1", "lex_en", ["id"], "_en", "_en_n", False)
    + ","
    + translate_sql("b_piv", "bp2", ["id"], "_en_n", "prediction", False)
    + """,
outputs AS (SELECT id, lang, input, gold, 'pivot' AS model, prediction FROM b_piv
  UNION ALL SELECT id, lang, input, gold, 'zero_shot', prediction FROM b_zero
  UNION ALL SELECT id, lang, input, gold, 'synthetic', prediction FROM b_syn
  UNION ALL SELECT id, lang, input, gold, 'few_shot', prediction FROM b_few)"""
)

EVAL = [PAIRS, SPLIT, DICT, SYNTH, EXAMPLES, BRANCHES]
SCORES = EVAL + [
    JUDGE,
    LM,
    EMB,
    judge_scores("outputs", "id, model", text="prediction", name="sj"),
    content_scores("sj", "id, model", "prediction", "input", name="sc"),
    ppl_scores("sc", "id, model", text="prediction", name="scores"),
]

CELLS = """
cells0 AS (SELECT *, (prediction IS NULL OR prediction = '' OR prediction = 'Error') AS failed,
                  coalesce(ppl, 'Infinity'::DOUBLE) AS pv FROM scores),
cells AS (SELECT id, input, gold, model,
    CASE WHEN failed THEN 'Error' ELSE prediction END AS "Output",
    CASE WHEN failed THEN 0 ELSE (style = 0)::INTEGER END AS "Style",
    CASE WHEN failed THEN 0.0 ELSE round(f1, 3) END AS "Content",
    CASE WHEN failed THEN 99999.0 ELSE round(pv, 1) END AS "Fluency",
    CASE WHEN failed THEN NULL
         ELSE round(pow((style = 0)::INTEGER::DOUBLE * f1 * (100.0 / greatest(pv, 1.0)), 1.0 / 3.0), 3) END AS "Composite"
  FROM cells0)"""

_report_cols = ",\n".join(
    f'  max(CASE WHEN model = \'{m}\' THEN "{f}" END) AS "{m}_{f}"'
    for m in MODELS
    for f in ("Output", "Style", "Content", "Fluency", "Composite")
)

ORACLE_SQL.update(
    {
        "translation_dictionary": w(DICT) + "SELECT lang, pivot_word, word FROM dict",
        "translate_pairs": w(PAIRS, SPLIT, DICT, SYNTH) + "SELECT * FROM synth",
        "neutral_lexicon": w(PAIRS, SPLIT, DICT, SYNTH)
        + "SELECT word, pairs_with_word, removed, round(rate, 6) AS rate FROM lex_en",
        "neutralize_zero_shot": w(*EVAL) + "SELECT id, lang, prediction FROM b_zero",
        "neutralize_synthetic": w(*EVAL) + "SELECT id, lang, prediction FROM b_syn",
        "neutralize_few_shot": w(*EVAL) + "SELECT id, lang, prediction FROM b_few",
        "neutralize_pivot": w(*EVAL) + "SELECT id, lang, prediction FROM b_piv",
        "model_outputs": w(*EVAL) + "SELECT id, model, prediction FROM outputs",
        "leaderboard": w(*SCORES)
        + """SELECT model, round(acc, 6) AS style_acc, round(sim, 6) AS content_sim, round(ppl, 4) AS fluency_ppl,
       round(pow(acc * sim * (1.0 / CASE WHEN ppl <= 0 THEN 9999.0 ELSE ppl END), 1.0 / 3.0), 6) AS composite
FROM (SELECT model, arg_min(prediction, id) AS first_pred, avg(CASE WHEN style = 0 THEN 1.0 ELSE 0.0 END) AS acc,
             avg(f1) AS sim, coalesce(avg(CASE WHEN NOT isnan(ppl) THEN ppl END), 'Infinity'::DOUBLE) AS ppl
      FROM scores GROUP BY model)
WHERE first_pred IS NULL OR first_pred <> 'Error'""",
        "inspection_wide": w(*EVAL)
        + f"""SELECT id AS "ID", input AS "Original_Biased", gold AS "Gold_Reference",
{", ".join(f"max(CASE WHEN model = '{m}' THEN p END) AS \"Pred_{m}\"" for m in MODELS)}
FROM (SELECT g.id, g.input, g.gold, g.model, coalesce(o.prediction, '') AS p
      FROM (SELECT id, input, gold, m.model FROM ex, (VALUES {', '.join(f"('{m}')" for m in MODELS)}) m(model)) g
      LEFT JOIN outputs o ON o.id = g.id AND o.model = g.model)
GROUP BY id, input, gold""",
        "granular_report": w(*SCORES, CELLS)
        + f"""SELECT id AS "ID", input AS "Original_Input", gold AS "Gold_Reference",
{_report_cols}
FROM cells GROUP BY id, input, gold""",
        "qualitative_head": w(*EVAL)
        + "SELECT id, input, model, prediction FROM outputs WHERE id IN (SELECT id FROM ex ORDER BY id LIMIT 3)",
        "worst_examples": w(*SCORES, CELLS)
        + """SELECT id, model, "Output", "Style", "Content", "Fluency", "Composite" FROM cells
ORDER BY "Composite" ASC NULLS FIRST, id, model LIMIT 10""",
    }
)

GOLD = (
    f"""
gs AS (SELECT * FROM split WHERE split = 'test' AND lang = 'en' ORDER BY {hkey('pair_id')}, pair_id LIMIT 100),
g0 AS (SELECT row_number() OVER (ORDER BY {hkey('pair_id')}, pair_id) - 1 AS "ID", 'fr' AS lang,
              src_raw AS "English_Ref", src_raw, tgt_raw FROM gs),"""
    + translate_sql("g1", "g0", ['"ID"'], "src_raw", '"Target_Biased"', False)
    + ","
    + translate_sql("g2", "g1", ['"ID"'], "tgt_raw", '"Target_Neutral_Gold"', False)
)

ENCODE = f"""
vt AS (SELECT unnest({words('src_raw')}) AS word FROM train UNION ALL SELECT unnest({words('tgt_raw')}) FROM train),
voc AS (SELECT word, rn + 1 AS id FROM (SELECT word, row_number() OVER (ORDER BY n DESC, word) AS rn
        FROM (SELECT word, count(*) AS n FROM vt GROUP BY word)) WHERE rn <= 8000),
ee AS (SELECT pair_id, side, ws, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM
       (SELECT pair_id, 0 AS side, {words('src_raw')}[1:128] AS ws FROM train
        UNION ALL SELECT pair_id, 1 AS side, {words('tgt_raw')}[1:128] AS ws FROM train)),
ej AS (SELECT ee.*, coalesce(voc.id, 1) AS id FROM ee LEFT JOIN voc USING (word)),
el AS (SELECT pair_id, coalesce(list(id ORDER BY pos) FILTER (WHERE side = 0), []) AS src,
              coalesce(list(id ORDER BY pos) FILTER (WHERE side = 1), []) AS tgt,
              coalesce(list(word ORDER BY pos) FILTER (WHERE side = 0), []) AS sw,
              coalesce(list(word ORDER BY pos) FILTER (WHERE side = 1), []) AS tw FROM ej GROUP BY pair_id),
enc AS (SELECT t.pair_id,
          list_concat(coalesce(src, []), list_transform(range(128 - len(coalesce(src, []))), lambda x: 0)) AS input_ids,
          list_concat(list_transform(coalesce(src, []), lambda x: 1), list_transform(range(128 - len(coalesce(src, []))), lambda x: 0)) AS attention_mask,
          list_transform(list_concat(coalesce(tgt, []), list_transform(range(128 - len(coalesce(tgt, []))), lambda x: 0)),
                         lambda x: CASE WHEN x = 0 THEN -100 ELSE x END) AS labels,
          coalesce(sw, []) AS sw, coalesce(tw, []) AS tw
        FROM train t LEFT JOIN el USING (pair_id))"""

LOSSES = """
tl0 AS (SELECT pair_id, pos, labels[pos + 1] AS label, tw[pos + 1] AS w, sw[pos + 1] AS swd,
               CASE WHEN pos = 0 THEN '<s>' ELSE tw[pos] END AS u
        FROM (SELECT pair_id, labels, sw, tw, unnest(range(128)) AS pos FROM enc)),
tl AS (SELECT pair_id, pos, label,
              CASE WHEN label = -100 THEN 0.0 ELSE -(ln(coalesce(c, 0) + 1) - ln(coalesce(cu, 0) + v)) END AS loss,
              CASE WHEN label = -100 THEN 0.0 WHEN swd IS NOT DISTINCT FROM w THEN 1.0 ELSE 2.0 END AS weight
       FROM tl0 LEFT JOIN fc USING (u, w) LEFT JOIN fx USING (u), fv)"""

EVENTS = """
ev0 AS (SELECT event_id, event_type AS typ, value, json_extract(props, '$.k')::DOUBLE AS k FROM events),
ev AS (SELECT event_id, event_id // 1024 AS doc_id,
              CASE WHEN typ <> 'error' THEN event_id END AS step, k / 100 AS epoch,
              CASE WHEN typ <> 'view' THEN value END AS loss,
              CASE WHEN typ = 'click' THEN value / 1000 END AS learning_rate,
              CASE WHEN typ = 'purchase' THEN k END AS grad_norm,
              CASE WHEN typ = 'view' THEN value END AS eval_loss FROM ev0)"""

ORACLE_SQL.update(
    {
        "map_text": """SELECT conv_id, turn, CASE WHEN text IS NULL OR strlen(text) % 5 = 0 THEN 'Error'
            ELSE strlen(text)::VARCHAR END AS prediction FROM conversations""",
        "gold_set": w(PAIRS, SPLIT, DICT, GOLD)
        + 'SELECT "ID"::INTEGER AS "ID", "English_Ref", "Target_Biased", "Target_Neutral_Gold" FROM g2',
        "encode_fixed": w(PAIRS, SPLIT, ENCODE)
        + "SELECT pair_id, input_ids::INTEGER[] AS input_ids, attention_mask::INTEGER[] AS attention_mask, labels::INTEGER[] AS labels FROM enc",
        "masked_loss": w(PAIRS, SPLIT, ENCODE, LM, LOSSES)
        + "SELECT pair_id, round(avg(CASE WHEN label <> -100 THEN loss END), 6) AS masked_loss FROM tl GROUP BY pair_id",
        "weighted_loss": w(PAIRS, SPLIT, ENCODE, LM, LOSSES)
        + "SELECT pair_id, round(sum(loss * weight) / (sum(weight) + 1e-9), 6) AS weighted_loss FROM tl GROUP BY pair_id",
        "log_explode": w(EVENTS)
        + """SELECT doc_id, idx, step, loss, coalesce(learning_rate, 0.0) AS learning_rate, coalesce(grad_norm, 0.0) AS grad_norm
        FROM (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY event_id) - 1)::INTEGER AS idx FROM ev)
        WHERE loss IS NOT NULL AND step IS NOT NULL""",
        "log_union": w(EVENTS)
        + """SELECT doc_id, step, epoch, loss, learning_rate, grad_norm FROM ev WHERE loss IS NOT NULL
        UNION ALL BY NAME SELECT doc_id, step, epoch, eval_loss, eval_loss * 10 AS eval_runtime FROM ev WHERE eval_loss IS NOT NULL
        UNION ALL BY NAME SELECT doc_id, max(step) AS step, max(epoch) AS epoch, count(*)::DOUBLE AS train_runtime,
                                 round(avg(loss), 6) AS train_loss FROM ev GROUP BY doc_id""",
        "tsv_scan": """SELECT f[1] AS id, f[2] AS src_tok, f[3] AS tgt_tok, f[4] AS src_raw, f[5] AS tgt_raw, f[6] AS pos, f[7] AS parse
        FROM (SELECT string_split(line, chr(9)) AS f FROM
              (SELECT unnest(string_split_regex(text, '\\r\\n|\\n|\\r')) AS line FROM documents) WHERE line <> '')
        WHERE len(f) <= 7""",
    }
)


def _fmt(x: str, spec: str) -> str:
    # Java's formatter spells the special values out
    return f"CASE WHEN isnan({x}) THEN 'NaN' WHEN isinf({x}) THEN CASE WHEN {x} > 0 THEN 'Infinity' ELSE '-Infinity' END ELSE printf('{spec}', {x}) END"


_DISPLAY = "CASE model " + " ".join(
    f"WHEN '{k}' THEN '{v}'"
    for k, v in [
        ("pivot", "Baseline (Pivot)"),
        ("zero_shot", "Model 2 (ZeroShot)"),
        ("synthetic", "Model 3 (Synthetic)"),
        ("few_shot", "Model 4 (FewShot)"),
    ]
) + " ELSE model END"

ORACLE_SQL["leaderboard_display"] = (
    w(*SCORES)
    + f"""SELECT {_DISPLAY} AS "Model",
       {_fmt('acc * 100', '%.2f')} || CASE WHEN isnan(acc) OR isinf(acc) THEN '' ELSE '%' END AS "Style Acc (↑)",
       {_fmt('sim', '%.3f')} AS "Content Sim (↑)", {_fmt('ppl', '%.2f')} AS "Fluency PPL (↓)",
       {_fmt('pow(acc * sim * (1.0 / CASE WHEN ppl <= 0 THEN 9999.0 ELSE ppl END), 1.0 / 3.0)', '%.3f')} AS "Composite Score"
FROM (SELECT model, arg_min(prediction, id) AS first_pred, avg(CASE WHEN style = 0 THEN 1.0 ELSE 0.0 END) AS acc,
             avg(f1) AS sim, coalesce(avg(CASE WHEN NOT isnan(ppl) THEN ppl END), 'Infinity'::DOUBLE) AS ppl
      FROM scores GROUP BY model)
WHERE first_pred IS NULL OR first_pred <> 'Error'"""
)

# ---- edit operations and rules (U2) ------------------------------------------

# A pair whose sides share few words is further apart than F1 allows: the
# distance is at least the longer side less the words in common.
NEAR = """
nw AS (SELECT pair_id, unnest(s) AS word, 1 AS a, 0 AS b FROM stats UNION ALL SELECT pair_id, unnest(t), 0, 1 FROM stats),
nc AS (SELECT pair_id, sum(least(a, b)) AS common FROM (SELECT pair_id, word, sum(a) AS a, sum(b) AS b FROM nw GROUP BY ALL) GROUP BY ALL),
near AS (SELECT stats.* FROM stats JOIN nc USING (pair_id) WHERE 10 * common >= 6 * n_max)"""
# The trimmed word codes of the near pairs, then the whole distance table of
# each, one row per anti-diagonal; its last cell is the distance.
NEAR_DIST = DIST[: DIST.index("dp(pair_id")].replace("FROM stats", "FROM near") + """
es AS MATERIALIZED (SELECT pair_id, s::INTEGER[] AS s, t::INTEGER[] AS t, len(s) AS n, len(t) AS m FROM dq),
ft(pair_id, d, p1, p2) AS (
  SELECT pair_id, 1, [1, 1]::INTEGER[], [0]::INTEGER[] FROM es WHERE n > 0 AND m > 0
  UNION ALL
  SELECT f.pair_id, d + 1,
    list_transform(range(greatest(0, d + 1 - m), least(n, d + 1) + 1),
      lambda i: CASE WHEN i = 0 OR i = d + 1 THEN d + 1
        ELSE least(p1[i - greatest(0, d - m)] + 1,
                   p1[i - greatest(0, d - m) + 1] + 1,
                   p2[i - greatest(0, d - 1 - m)] + CASE WHEN s[i] = t[d + 1 - i] THEN 0 ELSE 1 END) END)::INTEGER[],
    p1
  FROM ft f JOIN es USING (pair_id) WHERE d < n + m
),
dist AS MATERIALIZED (SELECT es.pair_id, coalesce(ft.p1[1], greatest(n, m))::INTEGER AS dist
                      FROM es LEFT JOIN ft ON ft.pair_id = es.pair_id AND ft.d = es.n + es.m),
ed AS (SELECT near.*, dist.dist, dist.dist::DOUBLE / nullif(near.n_max, 0) AS ratio FROM near JOIN dist USING (pair_id))"""

# A letter per cell says where the alignment comes from (match or substitution
# before deletion before insertion), and a fold from the last diagonal to the
# first reads the path.
EDITS = """
eq AS MATERIALIZED (SELECT k.pair_id, k.lang, df.pre, n, m, k.s AS ws, k.t AS wt FROM kept k JOIN df USING (pair_id) JOIN es USING (pair_id)),
fo AS (SELECT a.pair_id, a.d, n, m, array_to_string(list_transform(range(greatest(0, a.d - m), least(n, a.d) + 1),
      lambda i: CASE WHEN i = 0 THEN 'I' WHEN i = a.d THEN 'D'
        WHEN s[i] = t[a.d - i] AND b.p2[i - greatest(0, a.d - 2 - m)] = a.p1[i - greatest(0, a.d - m) + 1] THEN 'M'
        WHEN s[i] <> t[a.d - i] AND b.p2[i - greatest(0, a.d - 2 - m)] + 1 = a.p1[i - greatest(0, a.d - m) + 1] THEN 'S'
        WHEN a.p2[i - greatest(0, a.d - 1 - m)] + 1 = a.p1[i - greatest(0, a.d - m) + 1] THEN 'D' ELSE 'I' END), '') AS ops
    FROM ft a SEMI JOIN kept USING (pair_id) JOIN es USING (pair_id) LEFT JOIN ft b ON b.pair_id = a.pair_id AND b.d = a.d - 1),
fl AS (SELECT pair_id, n, m, list({'i': d::BIGINT, 'j': 0::BIGINT, 'p': ops} ORDER BY d DESC) AS ds FROM fo GROUP BY ALL),
fp AS (SELECT pair_id, list_reduce(ds, lambda acc, x: CASE WHEN acc.i + acc.j <> x.i THEN acc ELSE
          {'i': acc.i - (substr(x.p, (acc.i - greatest(0, x.i - m) + 1)::BIGINT, 1) <> 'I')::BIGINT,
           'j': acc.j - (substr(x.p, (acc.i - greatest(0, x.i - m) + 1)::BIGINT, 1) <> 'D')::BIGINT,
           'p': substr(x.p, (acc.i - greatest(0, x.i - m) + 1)::BIGINT, 1) || acc.p} END,
          {'i': n::BIGINT, 'j': m::BIGINT, 'p': ''}).p AS path FROM fl
       UNION ALL SELECT pair_id, repeat('D', n) || repeat('I', m) FROM eq WHERE n = 0 OR m = 0),
fc AS (SELECT pair_id, unnest(string_split(path, '')) AS c, unnest(range(1, len(path) + 1)) AS k FROM fp),
fr AS (SELECT *, count(*) FILTER (WHERE c <> 'I') OVER w - (c <> 'I')::INTEGER AS i0,
              count(*) FILTER (WHERE c <> 'D') OVER w - (c <> 'D')::INTEGER AS j0,
              count(*) FILTER (WHERE c = 'M') OVER w AS hunk
       FROM fc WINDOW w AS (PARTITION BY pair_id ORDER BY k)),
fh AS (SELECT pair_id, hunk, min(i0) AS i0, min(j0) AS j0, count(*) FILTER (WHERE c <> 'I') AS ns, count(*) FILTER (WHERE c <> 'D') AS nt
       FROM fr WHERE c <> 'M' GROUP BY ALL),
ops AS (SELECT pair_id, lang, (row_number() OVER (PARTITION BY pair_id ORDER BY hunk) - 1)::INTEGER AS idx, (pre + i0)::INTEGER AS pos,
               CASE WHEN ns = 0 THEN 'insert' WHEN nt = 0 THEN 'delete' ELSE 'replace' END AS kind,
               CASE WHEN pre + i0 > 0 THEN ws[pre + i0] ELSE '' END AS "left", ns, nt,
               array_to_string(ws[pre + i0 + 1:pre + i0 + ns], ' ') AS src, array_to_string(wt[pre + j0 + 1:pre + j0 + nt], ' ') AS tgt
        FROM fh JOIN eq USING (pair_id))"""


def places_sql(name: str, src: str, ids: str) -> str:
    """Phrases of up to three words at every place of ``src``.ws, with the word before."""
    return f"""
{name}_i AS (SELECT {ids}, ws, unnest(range(0, len(ws) + 1)) AS i FROM {src}),
{name}_l AS (SELECT *, unnest(range(0, least(3, len(ws) - i) + 1)) AS l FROM {name}_i),
{name} AS (SELECT {ids}, i, l, CASE WHEN i = 0 THEN '' ELSE ws[i] END AS "left", array_to_string(ws[i + 1:i + l], ' ') AS phrase FROM {name}_l)"""


RULES = (
    """
lo AS (SELECT ops.* FROM ops JOIN split USING (pair_id) WHERE split.split = 'train' AND ns <= 3 AND nt <= 3),
lc AS (SELECT lang, "left", src AS phrase, tgt AS "to" FROM lo UNION ALL SELECT lang, NULL, src, tgt FROM lo WHERE src <> ''),
lh AS (SELECT lang, "left", phrase, "to", count(*) AS hits FROM lc GROUP BY ALL),
lb AS (SELECT * FROM lh QUALIFY row_number() OVER (PARTITION BY lang, "left", phrase ORDER BY hits DESC, "to") = 1),
lt0 AS (SELECT lang, kept.s AS ws FROM kept JOIN split USING (pair_id, lang) WHERE split.split = 'train'),"""
    + places_sql("lp", "lt0", "lang")
    + """,
ln AS (SELECT lang, "left", phrase, count(*) AS n FROM lp GROUP BY ALL
       UNION ALL SELECT lang, NULL, phrase, count(*) FROM lp WHERE l > 0 GROUP BY lang, phrase),
rules AS (SELECT lb.lang, lb."left", lb.phrase, lb."to", hits, n AS places, hits / n AS rate
          FROM lb JOIN ln ON lb.lang = ln.lang AND lb."left" IS NOT DISTINCT FROM ln."left" AND lb.phrase = ln.phrase
          WHERE hits >= 1 AND hits / n >= 0.5)"""
)

# At each place the longest phrase that fits, its context before none; places
# inside a chosen phrase are passed over.
RULED = (
    f"""
ru AS (SELECT pair_id, lang, src_raw, {words('src_raw')} AS ws FROM pairs),"""
    + places_sql("rp", "ru", "pair_id, lang")
    + """,
rb AS (SELECT pair_id, i, l, r."to" FROM rp JOIN rules r ON r.lang = rp.lang AND r.phrase = rp.phrase
            AND (r."left" = rp."left" OR (r."left" IS NULL AND l > 0))
       QUALIFY row_number() OVER (PARTITION BY pair_id, i ORDER BY l DESC, r."left" IS NULL) = 1),
rm AS (SELECT * FROM rb WHERE l > 0),
rs(pair_id, i, l) AS (
  SELECT pair_id, min(i), arg_min(l, i) FROM rm GROUP BY pair_id
  UNION ALL
  SELECT rs.pair_id, min(rm.i), arg_min(rm.l, rm.i) FROM rs JOIN rm ON rm.pair_id = rs.pair_id AND rm.i >= rs.i + rs.l
  GROUP BY rs.pair_id
),
rc AS (SELECT pair_id, i + unnest(range(0, l)) AS i FROM rs),
rw AS (SELECT u.pair_id, i, 1 AS part, ws[i + 1] AS w FROM (SELECT pair_id, ws, unnest(range(0, len(ws))) AS i FROM ru) u ANTI JOIN rc USING (pair_id, i)
       UNION ALL SELECT pair_id, i, 0, "to" FROM rb JOIN rs USING (pair_id, i) WHERE rb.l > 0 AND "to" <> ''
       UNION ALL SELECT pair_id, i, 0, "to" FROM rb ANTI JOIN rc USING (pair_id, i) WHERE l = 0),
rt AS (SELECT pair_id, string_agg(w, ' ' ORDER BY i, part) AS t FROM rw GROUP BY pair_id)"""
)

ORACLE_SQL.update(
    {
        "edit_ops": w(PAIRS, STATS, NEAR, NEAR_DIST, KEPT, EDITS) + """SELECT pair_id, idx, pos, kind, "left" AS left_word, src, tgt FROM ops""",
        "edit_rules": w(PAIRS, STATS, NEAR, NEAR_DIST, KEPT, SPLIT, EDITS, RULES)
        + """SELECT lang, "left" AS left_word, phrase, "to" AS becomes, hits, places, round(rate, 6) AS rate FROM rules""",
        "neutralize_rules": w(PAIRS, STATS, NEAR, NEAR_DIST, KEPT, SPLIT, EDITS, RULES, RULED)
        + "SELECT pair_id, lang, CASE WHEN src_raw IS NOT NULL THEN coalesce(t, '') END AS prediction FROM ru LEFT JOIN rt USING (pair_id)",
    }
)

# ---- iterative judge with validation (U4, D2) ----------------------------------

VALIDATION = (
    LABELLED
    + f""",
vs AS (SELECT pair_id, label, text, rnk >= n - (n + 9) // 10 AS val FROM
       (SELECT *, row_number() OVER (ORDER BY {hkey('pair_id', 'label')}, pair_id, label) - 1 AS rnk, count(*) OVER () AS n FROM lt)),
vw AS (SELECT pair_id, label, unnest({words('text')}) AS word FROM vs),
vf AS MATERIALIZED (SELECT pair_id, label, {HASH.format(x="'42:' || word")} % 1024 AS f, count(*) AS k FROM vw GROUP BY ALL),
vx AS MATERIALIZED (SELECT pair_id, label, f, k / sum(k) OVER (PARTITION BY pair_id, label) AS x FROM vf),
w0 AS (SELECT 0::BIGINT AS f, 0.0::DOUBLE AS w), b0 AS (SELECT 0.0::DOUBLE AS b)"""
    + "".join(
        f""",
z{e} AS MATERIALIZED (SELECT vs.pair_id, vs.label, val, b + coalesce(s, 0) AS z FROM vs, b{e} LEFT JOIN
        (SELECT pair_id, label, sum(x * w) AS s FROM vx JOIN w{e} USING (f) GROUP BY ALL) q ON q.pair_id = vs.pair_id AND q.label = vs.label),
e{e} AS (SELECT pair_id, label, 1 / (1 + exp(-z)) - label AS d FROM z{e} WHERE NOT val),
b{e + 1} AS (SELECT b - 20.0 * (SELECT avg(d) FROM e{e}) AS b FROM b{e}),
w{e + 1} AS MATERIALIZED (SELECT f, coalesce(w, 0) - 20.0 * g / (SELECT count(*) FROM e{e}) AS w FROM
        (SELECT f, sum(d * x) AS g FROM e{e} JOIN vx USING (pair_id, label) GROUP BY f) LEFT JOIN w{e} USING (f))"""
        for e in range(4)
    )
)

# ---- Kneser-Ney (U6) --------------------------------------------------------------

KNSQL = f"""
ks AS (SELECT ['<s>', '<s>'] || ws || ['</s>'] AS q FROM (SELECT {words('text')} AS ws FROM documents) WHERE len(ws) > 0),
ki AS (SELECT q, unnest(range(1, len(q) - 1)) AS i FROM ks),
k3 AS MATERIALIZED (SELECT q[i] AS u, q[i + 1] AS v, q[i + 2] AS w, count(*) AS n FROM ki GROUP BY ALL),
k2 AS MATERIALIZED (SELECT v, w, count(*) AS n FROM k3 GROUP BY ALL),
k1 AS MATERIALIZED (SELECT w, count(*) AS n FROM k2 GROUP BY ALL),""" + ",".join(
    f"""
kd{o} AS (SELECT CASE WHEN n1 * n2 > 0 THEN n1 / (n1 + 2 * n2) ELSE 0.5 END AS d FROM
       (SELECT count(*) FILTER (WHERE n = 1) AS n1, count(*) FILTER (WHERE n = 2) AS n2 FROM k{o}))"""
    for o in (1, 2, 3)
) + """,
kp1 AS MATERIALIZED (SELECT w, (n - d) / sum(n) OVER () + d * count(*) OVER () / sum(n) OVER () / (count(*) OVER () + 1) AS p FROM k1, kd1),
ku AS (SELECT any_value(d) * count(*) / sum(n) / (count(*) + 1) AS p FROM k1, kd1),
kg2 AS MATERIALIZED (SELECT v, sum(n) AS t, any_value(d) * count(*) / sum(n) AS g FROM k2, kd2 GROUP BY v),
kp2 AS MATERIALIZED (SELECT v, w, (n - d) / t + g * p AS p FROM k2 JOIN kg2 USING (v) JOIN kp1 USING (w), kd2),
kg3 AS MATERIALIZED (SELECT u, v, sum(n) AS t, any_value(d) * count(*) / sum(n) AS g FROM k3, kd3 GROUP BY u, v),
kp3 AS MATERIALIZED (SELECT u, v, w, (n - d) / t + g * p AS p FROM k3 JOIN kg3 USING (u, v) JOIN kp2 USING (v, w), kd3),
kt AS (SELECT conv_id, turn, ['<s>', '<s>'] || ws || ['</s>'] AS q FROM (SELECT conv_id, turn, """ + words("text") + """ AS ws FROM conversations) WHERE len(ws) > 0),
kj AS (SELECT conv_id, turn, q[i] AS u, q[i + 1] AS v, q[i + 2] AS w FROM (SELECT conv_id, turn, q, unnest(range(1, len(q) - 1)) AS i FROM kt)),
kl AS (SELECT conv_id, turn, coalesce(kp3.p, coalesce(kg3.g, 1) * coalesce(kp2.p, coalesce(kg2.g, 1) * coalesce(kp1.p, ku.p))) AS p
       FROM kj LEFT JOIN kp3 USING (u, v, w) LEFT JOIN kg3 USING (u, v) LEFT JOIN kp2 USING (v, w) LEFT JOIN kg2 USING (v) LEFT JOIN kp1 USING (w), ku),
kn AS (SELECT conv_id, turn, exp(-avg(ln(p))) AS ppl FROM kl GROUP BY ALL)"""

ORACLE_SQL.update(
    {
        "judge_validation": w(PAIRS, VALIDATION)
        + " UNION ALL ".join(
            f"""SELECT {e}::INTEGER AS epoch, round(avg(loss) FILTER (WHERE NOT val), 6) AS train_loss, round(avg(loss) FILTER (WHERE val), 6) AS val_loss,
       round(avg(((z > 0) = (label = 1))::INTEGER) FILTER (WHERE val), 6) AS val_accuracy
FROM (SELECT *, ln(1 + exp(CASE WHEN label = 1 THEN -z ELSE z END)) AS loss FROM z{e})"""
            for e in range(4)
        ),
        "fluency_kn": w(KNSQL) + "SELECT conv_id, turn, round(ppl, 4) AS ppl_kn FROM conversations LEFT JOIN kn USING (conv_id, turn)",
    }
)

ORACLE_SQL.update(
    {
        "csv_round_trip": w(PAIRS)
        + """SELECT pair_id::VARCHAR AS id, NULL::VARCHAR AS src_tok, NULL::VARCHAR AS tgt_tok, ' "' || src_raw || '",' || chr(10) || chr(9) || '"" ' AS src_raw,
       ' "' || tgt_raw || '",' || chr(10) || chr(9) || '"" ' AS tgt_raw, NULL::VARCHAR AS pos, NULL::VARCHAR AS parse FROM pairs""",
        "file_status": w(EVENTS)
        + """SELECT doc_id, CASE doc_id % 7 WHEN 1 THEN 'corrupt' WHEN 2 THEN 'empty' WHEN 3 THEN 'missing' ELSE 'ok' END AS status,
       CASE WHEN doc_id % 7 IN (1, 2, 3) THEN 0 ELSE count(*) END AS entries,
       CASE WHEN doc_id % 7 IN (1, 2, 3) THEN 0 ELSE count(*) FILTER (WHERE loss IS NOT NULL AND step IS NOT NULL) END AS steps
FROM ev GROUP BY doc_id""",
    }
)
