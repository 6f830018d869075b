"""Queries that score one rule set against another, and result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanweave.functions import values as V
from spanweave.operators import detect as D
from spanweave.operators import leaderboard as L
from spanweave.operators import evaluation as E
from spanweave.operators import scoring as C
from spanweave.plans.registry import fixture, query, values
from spanweave.plans.span_queries import SCORE_SQL, docs, found_sql
from spanweave.session import table

TARGETS = ("EMAIL", "ACCOUNT", "PHONE")
NEGATIVES = ("IP", "SECRET")
_GOLD = {k: D.PATTERNS[k] for k in TARGETS}
_NEGS = {k: D.PATTERNS[k] for k in NEGATIVES}
_BOTH = f"""WITH gold AS (SELECT * FROM ({found_sql(_GOLD, 'doc_id, lang')})), negs AS (SELECT * FROM ({found_sql(_NEGS, 'doc_id, lang')})),
 pred AS (SELECT *, {SCORE_SQL} AS score FROM ({found_sql(D.LOOSE, 'doc_id, lang')}))"""
_SETS = "GROUP BY GROUPING SETS ((), (label), (lang), (lang, label))"
_PRF = """tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, (tp + fn)::BIGINT AS support, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall,
 coalesce(2 * coalesce(tp / nullif(tp + fp, 0), 0.0) * coalesce(tp / nullif(tp + fn, 0), 0.0) / nullif(coalesce(tp / nullif(tp + fp, 0), 0.0) + coalesce(tp / nullif(tp + fn, 0), 0.0), 0), 0.0) AS f1"""
_LEVELS = [[], ["label"], ["lang"], ["lang", "label"]]


def _gold(spark, sf_dir):
    return D.rules(docs(spark, sf_dir), _GOLD, ("doc_id", "lang")).drop("value")


def _negs(spark, sf_dir):
    return D.rules(docs(spark, sf_dir), _NEGS, ("doc_id", "lang")).drop("value")


def _pred(spark, sf_dir):
    return D.scored(docs(spark, sf_dir), D.LOOSE, ("doc_id", "lang")).drop("value")


@query(
    f"""{_BOTH}, g AS (SELECT doc_id, lang, "start", "end", label, count(*) AS g FROM gold GROUP BY ALL), p AS (SELECT doc_id, lang, "start", "end", label, count(*) AS p FROM pred GROUP BY ALL),
 e AS (SELECT lang, label, least(coalesce(g, 0), coalesce(p, 0)) AS tp, coalesce(p, 0) - least(coalesce(g, 0), coalesce(p, 0)) AS fp, coalesce(g, 0) - least(coalesce(g, 0), coalesce(p, 0)) AS fn FROM g FULL JOIN p USING (doc_id, lang, "start", "end", label)),
 s AS (SELECT lang, label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM e {_SETS}) SELECT lang, label, {_PRF} FROM s"""
)
def strict_prf(spark, sf_dir):
    """Exact matches at four levels."""
    counts = C.strict_counts(_gold(spark, sf_dir), _pred(spark, sf_dir), ["lang"])
    return C.levelled(counts, _LEVELS, ["lang", "label"])


_LENIENT = """g AS (SELECT doc_id, lang, label, list({'s': "start", 'e': "end"} ORDER BY "start", "end") AS g FROM gold GROUP BY ALL),
 p AS (SELECT doc_id, lang, label, list({'s': "start", 'e': "end"} ORDER BY "start", "end") AS p FROM pred GROUP BY ALL),
 j AS (SELECT doc_id, lang, label, coalesce(g, []) AS g, coalesce(p, []) AS p FROM g FULL JOIN p USING (doc_id, lang, label)),
 m AS (SELECT lang, label, len(g) AS ng, len(p) AS np, CASE WHEN len(p) = 0 THEN 0 ELSE len(list_reduce(list_prepend(CAST([] AS INTEGER[]), list_transform(range(1, len(p) + 1), lambda k: [k::INTEGER])), lambda acc, k:
   list_concat(acc, list_filter(CAST(range(1, len(g) + 1) AS INTEGER[]), lambda n: g[n].s < p[k[1]].e AND p[k[1]].s < g[n].e AND NOT list_contains(acc, n))[1:1]))) END AS tp FROM j)"""


@query(f"{_BOTH}, {_LENIENT}, s AS (SELECT lang, label, sum(tp) AS tp, sum(np - tp) AS fp, sum(ng - tp) AS fn FROM m {_SETS}) SELECT lang, label, {_PRF} FROM s")
def lenient_prf(spark, sf_dir):
    """Greedy overlap matches: each prediction takes the first gold span still free."""
    counts = C.lenient_counts(_gold(spark, sf_dir), _pred(spark, sf_dir), ["lang"])
    return C.levelled(counts, _LEVELS, ["lang", "label"])


_OVER = 'p.doc_id = g.doc_id AND p."start" < g."end" AND g."start" < p."end"'


@query(f"{_BOTH} SELECT lang, label, count(*) AS n, sum(CASE WHEN EXISTS (SELECT 1 FROM pred p WHERE {_OVER}) THEN 1 ELSE 0 END)::BIGINT AS covered FROM gold g {_SETS}")
def coverage(spark, sf_dir):
    """Gold spans that any prediction touches, whatever its label."""
    gold, pred = _gold(spark, sf_dir), _pred(spark, sf_dir)
    marked = gold.withColumn("hit", F.lit(0)).unionByName(C.covered(gold, pred).withColumn("hit", F.lit(1)))
    sets = [[F.col(c) for c in s] for s in _LEVELS]
    return marked.groupingSets(sets, "lang", "label").agg(F.sum(1 - F.col("hit")).alias("n"), F.sum("hit").alias("covered")).select("lang", "label", "n", F.col("covered").cast("long"))


_BEST = """best AS (SELECT g.lang, g.label, g.doc_id, g."start", g."end", max_by(p.label, {'o': least(g."end", p."end") - greatest(g."start", p."start"), 's': -p."start", 'e': -p."end"}) AS pl FROM gold g LEFT JOIN pred p ON """


@query(f"""{_BOTH}, {_BEST}{_OVER} GROUP BY ALL), c AS (SELECT lang, label, coalesce(pl, 'MISS') AS predicted, count(*) AS n FROM best GROUP BY ALL) SELECT *, n / sum(n) OVER (PARTITION BY lang, label) AS share FROM c""")
def best_overlap_confusion(spark, sf_dir):
    """What gold labels are taken for, by largest overlap."""
    return C.confusion(_gold(spark, sf_dir), _pred(spark, sf_dir), ["lang"])


@query(f"""{_BOTH}, f AS (SELECT g.label, g.doc_id, g."start", min_by(p.label, {{'s': p."start", 'e': p."end"}}) AS pl FROM negs g LEFT JOIN pred p ON {_OVER} GROUP BY ALL) SELECT label, coalesce(pl, 'NONE') AS taken_as, count(*) AS n FROM f GROUP BY ALL""")
def lookalike_first(spark, sf_dir):
    """Look-alikes flagged, labelled by the first overlapping prediction."""
    found = C.first_overlap(_negs(spark, sf_dir), _pred(spark, sf_dir))
    return found.groupBy("label", F.coalesce("pred_label", F.lit("NONE")).alias("taken_as")).agg(F.count("*").alias("n"))


@query(f"""{_BOTH}, {_BEST.replace('gold g', 'negs g')}{_OVER} GROUP BY ALL) SELECT lang, label, count(*) AS n, count(pl) AS flagged, count(pl) / count(*) AS rate FROM best GROUP BY lang, label""")
def lookalike_rate(spark, sf_dir):
    """Share of look-alikes that any prediction flags."""
    found = C.best_overlap(_negs(spark, sf_dir), _pred(spark, sf_dir))
    return found.groupBy("lang", "label").agg(F.count("*").alias("n"), F.count("pred_label").alias("flagged"), (F.count("pred_label") / F.count("*")).alias("rate"))


@query(
    f"""{_BOTH}, c AS (SELECT g.*, CASE WHEN g.doc_id % 7 = 0 THEN '?' ELSE lang END AS ctx, EXISTS (SELECT 1 FROM pred p WHERE {_OVER}) AS hit FROM negs g)
SELECT coalesce(ctx, 'ALL') AS ctx, count(*) AS n, count(*) FILTER (hit) AS flagged FROM c GROUP BY GROUPING SETS ((ctx), ())"""
)
def lookalikes_by_context(spark, sf_dir):
    """Look-alikes and those flagged in every context (here the language, unknown for some) and in all."""
    negs = _negs(spark, sf_dir)
    return E.flagged_by(negs.withColumn("ctx", F.when(F.col("doc_id") % 7 != 0, F.col("lang"))), _pred(spark, sf_dir))


@query(f"""{_BOTH} SELECT p.label, count(*) AS n FROM pred p WHERE NOT EXISTS (SELECT 1 FROM negs g WHERE {_OVER}) GROUP BY p.label""")
def predictions_clear_of_ignored(spark, sf_dir):
    """Predictions that overlap no masked zone."""
    return C.clear_of(_pred(spark, sf_dir), _negs(spark, sf_dir)).groupBy("label").agg(F.count("*").alias("n"))


GRID = [round(0.05 + 0.07 * k, 2) for k in range(14)]


@query(
    f"""{_BOTH}, m AS (SELECT label, score, EXISTS (SELECT 1 FROM gold g WHERE g.doc_id = p.doc_id AND g.label = p.label AND g."start" = p."start" AND g."end" = p."end") AS hit FROM pred p),
 w AS (SELECT label, count(*) AS support, unnest({GRID}::DOUBLE[]) AS t FROM gold GROUP BY label),
 c AS (SELECT w.label, w.t, w.support, count(m.label) FILTER (m.hit) AS tp, count(m.label) FILTER (NOT m.hit) AS fp FROM w LEFT JOIN m ON m.label = w.label AND m.score >= w.t GROUP BY ALL),
 f AS (SELECT label, t, coalesce(2 * coalesce(tp / nullif(tp + fp, 0), 0.0) * (tp / support) / nullif(coalesce(tp / nullif(tp + fp, 0), 0.0) + (tp / support), 0), 0.0) AS f1 FROM c)
SELECT label, t AS threshold, f1 FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY f1 DESC, t) AS k FROM f) WHERE k = 1"""
)
def threshold_tune(spark, sf_dir):
    """The best threshold of each label on a grid, the lowest on ties."""
    return C.tuned(_gold(spark, sf_dir), _pred(spark, sf_dir), GRID)


_LIMITS = [("EMAIL", 0.5), ("ACCOUNT", 0.2)]


@query(f"{_BOTH} SELECT p.label, count(*) AS n, min(score) AS least FROM pred p LEFT JOIN {values(_LIMITS, 'label, threshold')} USING (label) WHERE score >= coalesce(threshold, 0) GROUP BY p.label")
def score_threshold(spark, sf_dir):
    """Predictions at or above their label's threshold; labels without one keep all."""
    kept = C.above(_pred(spark, sf_dir), fixture(spark, _LIMITS, "label string, threshold double"))
    return kept.groupBy("label").agg(F.count("*").alias("n"), F.min("score").alias("least"))


IBANS = [(1, "GB82 WEST 1234 5698 7654 32"), (2, "GB82 WEST 1234 5698 7654 33"), (3, "12345"), (4, "DE89370400440532013000"), (5, "fr14-2004-1010-0505-0001-3m02-606"), (6, None), (7, "XX00ABCDEFGHIJKL")]


@query(
    f"""WITH t AS (SELECT id, upper(regexp_replace(v, '[ -]', '', 'g')) AS s FROM {values(IBANS, 'id, v')}),
 d AS (SELECT id, s, array_to_string(list_transform(string_split(substr(s, 5) || substr(s, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE (ascii(c) - 55)::VARCHAR END), '') AS digits FROM t)
SELECT id, CASE WHEN regexp_matches(s, '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{10,30}}$') THEN list_reduce(list_prepend(0, list_transform(string_split(digits, ''), lambda c: ascii(c) - 48)), lambda a, x: (a * 10 + x) % 97) = 1 END AS ok FROM d"""
)
def iban_audit(spark, sf_dir):
    """Checksums of account numbers: true, false, or null where the shape is another."""
    return fixture(spark, IBANS, "id int, v string").select("id", V.mod97_ok(F.col("v")).alias("ok"))


_MENTIONS = f"""SELECT lang, label, source, {SCORE_SQL} AS p_e, round(('0x' || substr(md5(doc_id || '|' || "end" || '|' || label), 1, 4))::INTEGER / 65536.0, 4) AS p_c FROM ({found_sql(D.PATTERNS, 'doc_id, lang, source')})"""
_PVI = "-log2(greatest(prior, 1e-12)) + log2(greatest(p_{}, 1e-12))"


@query(
    f"""WITH m AS ({_MENTIONS}), q AS (SELECT *, count(*) OVER (PARTITION BY label) / count(*) OVER () AS prior FROM m), v AS (SELECT *, {_PVI.format('e')} AS pvi_e, {_PVI.format('c')} AS pvi_c FROM q), c AS (SELECT *, pvi_e - pvi_c AS ceim FROM v)
SELECT label, lang, source, count(*) AS n, round(avg(pvi_e), 6) AS pvi_e, round(avg(pvi_c), 6) AS pvi_c, round(avg(ceim), 6) AS ceim, avg((ceim < -0.5)::INTEGER) AS low, avg((abs(ceim) <= 0.5)::INTEGER) AS near_zero, avg((ceim > 0.5)::INTEGER) AS high
FROM c GROUP BY GROUPING SETS ((), (label), (lang), (lang, label), (source))"""
)
def ceim_summary(spark, sf_dir):
    """Difficulty of mentions at five levels."""
    spans = D.scored(docs(spark, sf_dir), keep=("doc_id", "lang", "source"))
    rows = spans.select("lang", "label", "source", F.col("score").alias("p_e"), D.stable_score(F.col("doc_id"), F.col("end"), F.col("label")).alias("p_c"))
    return L.difficulty_report(rows).withColumns({c: F.round(c, 6) for c in ("pvi_e", "pvi_c", "ceim")})


_MODELS = "SELECT s_suppkey AS tag, s_nationkey AS grp, round(s_acctbal, 0) AS strict, CAST(s_suppkey % 37 AS DOUBLE) AS cpu FROM supplier"


def _models(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tag"), F.col("s_nationkey").alias("grp"), F.round("s_acctbal", 0).alias("strict"), (F.col("s_suppkey") % 37).cast("double").alias("cpu"))


@query(f"WITH m AS ({_MODELS}) SELECT * FROM m c WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.strict >= c.strict AND o.cpu < c.cpu)")
def pareto_models(spark, sf_dir):
    """Rows that none beats in gain at a lower cost."""
    return C.pareto(_models(spark, sf_dir), "strict", "cpu")


@query(
    f"""WITH m AS ({_MODELS}), b AS (SELECT *, max(strict) OVER (PARTITION BY grp) AS best FROM m), n AS (SELECT *, count(*) OVER (PARTITION BY grp) AS rivals, row_number() OVER (PARTITION BY grp ORDER BY strict DESC, tag) AS k FROM b WHERE strict >= best - 2000)
SELECT grp, tag, strict, rivals FROM n WHERE k <= 3"""
)
def near_ties(spark, sf_dir):
    """The three best of each group within a margin, and how many are within it."""
    return C.near_ties(_models(spark, sf_dir), "grp", "strict", "tag", within=2000.0)


@query("SELECT l_suppkey AS tag, avg(l_quantity) AS strict, avg(l_discount) AS coverage FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_returnflag) = 3")
def model_candidates(spark, sf_dir):
    """Means of models that have every set."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("tag"), F.col("l_returnflag").alias("set"), F.col("l_quantity").alias("strict"), F.col("l_discount").alias("coverage"))
    return L.candidates(rows, 3)


@query("SELECT event_type, median(value) AS median_s, min(value) AS min_s, max(value) AS max_s FROM events GROUP BY event_type")
def timing_summary(spark, sf_dir):
    return L.timing(table(spark, sf_dir, "events"), ["event_type"], "value")


PATHS = [
    ("cpu_SPAN-v5data_int8_sample.json", "v5/runs/SPAN-v5data"), ("A-v5data_merge-avg_ml_real.txt", "v5/runs/A-v5data"), ("pilot2_f25_ml_real.json", "v5/pilots/pilot2_f25"), ("sweep_S64_3e-4_val.json", "v5/sweeps/sweep_S64_3e-4"),
    ("v5_postproc.json", "v5/summary"), ("ml_train_coverage.txt", "v4/train_set"), ("B64_ml_real.json", "v4/B64"), ("v2.1_test.txt", "english/v2.1"), ("notes.md", "misc"),
    ("gpu_latency", "v5/latency/gpu_latency"), ("test_metrics_v3.json", "english/misc"), ("latency_A_B.jsonl", "v4/latency"), ("router_eval.txt", "v4/router"), ("difficulty_ml.json", "v5/train_set"),
    ("ml_train_v5_coverage.txt", "v5/train_set"), ("dhsweep_a_b_c_val.json", "v5/sweeps/dhsweep_a_b_c"), ("v5.3_ml_real.txt", "v5/runs/v5.3"), ("X-v5data-ema_val.json", "v5/runs/X-v5data-ema"), ("v4_summary.txt", "misc"), ("A-pilot_x.json", "v4/A-pilot"),
]


@query(f"SELECT name, folder FROM {values(PATHS, 'name, folder')}")
def path_routing(spark, sf_dir):
    """Result files routed to folders by name; the other side states the expected folders."""
    return fixture(spark, PATHS, "name string, want string").select("name", L.group_of(F.col("name")).alias("folder"))


LOGS = [(1, 'loading\n{"model": "a", "chars": 1000, "s": 0.5}\n'), (2, "broken\nTraceback"), (3, '{"model": "b", "chars": 5000, "s": 1.25}')]


@query(f"""WITH t AS (SELECT id, string_split(regexp_replace(log, '\\s+$', ''), chr(10))[-1] AS line FROM {values(LOGS, 'id, log')}) SELECT id, line ->> '$.model' AS model, CAST(line ->> '$.s' AS DOUBLE) AS s FROM t WHERE line LIKE '{{%'""")
def latency_logs(spark, sf_dir):
    """Timings from the last line of each log; broken logs go."""
    rows = fixture(spark, LOGS, "id int, log string").withColumn("j", L.last_json_line(F.col("log"), "model string, chars int, s double"))
    return rows.where("j.model IS NOT NULL").select("id", "j.model", "j.s")


RUNS = [(1, "eval_f1: 0.51\neval_f1: 0.875\nALL 0.9 0.8 0.85"), (2, "'eval_f1': 0.3\nPERSON 1 1 1\nALL  0.5\t0.25"), (3, "nothing")]
_SCRAPED = [(1, 0.875, 0.85), (2, 0.3, 0.25), (3, None, None)]


@query(f"SELECT id, CAST(best AS DOUBLE) AS best, CAST(last AS DOUBLE) AS last FROM {values(_SCRAPED, 'id, best, last')}")
def metric_scrape(spark, sf_dir):
    """Best metric and the ALL row of run logs."""
    rows = fixture(spark, RUNS, "id int, log string")
    return rows.select("id", L.best_logged(F.col("log"), "eval_f1").alias("best"), F.try_element_at(L.all_row(F.col("log")), F.lit(-1)).alias("last"))


@query("SELECT label, count(*) / sum(count(*)) OVER () AS prior FROM (SELECT quality AS label FROM labels) GROUP BY label")
def class_prior(spark, sf_dir):
    """Shares of a label; the total comes from the grouped counts."""
    counts = table(spark, sf_dir, "labels").groupBy(F.col("quality").alias("label")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.withColumn("t", total.scalar()).select("label", (F.col("n") / F.col("t")).alias("prior"))


@query(
    """WITH x AS (SELECT o_orderpriority AS lang, o_orderstatus AS gold, CASE WHEN o_orderkey % 3 = 0 THEN 'O' ELSE o_orderstatus END AS pred FROM orders),
 c AS (SELECT lang, sum((gold = pred AND gold <> 'O')::INTEGER) AS tp, sum((pred <> 'O' AND gold <> pred)::INTEGER) AS fp, sum((gold <> 'O' AND gold <> pred)::INTEGER) AS fn FROM x GROUP BY lang),
 f AS (SELECT lang, 2.0 * tp / nullif(2.0 * tp + fp + fn, 0) AS f1, tp, fp, fn FROM c) SELECT 2.0 * sum(tp) / nullif(2.0 * sum(tp) + sum(fp) + sum(fn), 0) AS micro_f1, avg(f1) AS macro_f1 FROM f"""
)
def micro_macro_f1(spark, sf_dir):
    """Micro F1 over all rows and the mean of per-language F1."""
    gold = F.col("o_orderstatus")
    pred = F.when(F.col("o_orderkey") % 3 == 0, "O").otherwise(gold)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("lang"), gold.alias("g"), pred.alias("p"))
    per = rows.groupBy("lang").agg(
        F.count_if((F.col("g") == F.col("p")) & (F.col("g") != "O")).alias("tp"), F.count_if((F.col("p") != "O") & (F.col("g") != F.col("p"))).alias("fp"), F.count_if((F.col("g") != "O") & (F.col("g") != F.col("p"))).alias("fn")
    )
    f1 = lambda tp, fp, fn: F.lit(2.0) * tp / F.nullif(F.lit(2.0) * tp + fp + fn, F.lit(0.0))
    return per.agg(f1(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("micro_f1"), F.avg(f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("macro_f1"))
