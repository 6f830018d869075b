"""Further queries: outcomes, recall levels, dimensions, edits, word starts."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanweave.functions import values as V
from spanweave.operators import detect as D
from spanweave.operators import scoring as C
from spanweave.operators import spans as S
from spanweave.operators import corpus as K
from spanweave.plans.registry import fixture, query, values
from spanweave.plans.score_queries import _BEST, _BOTH, _OVER, _gold, _pred
from spanweave.plans.span_queries import BROAD, FOLD_SQL, docs, found_sql
from spanweave.session import table

_OUT = f"""{_BOTH}, {_BEST}{_OVER} GROUP BY ALL), o AS (SELECT lang, label, pl IS NOT NULL AS found, EXISTS (SELECT 1 FROM pred p WHERE p.doc_id = best.doc_id AND p."start" = best."start" AND p."end" = best."end" AND p.label = best.label) AS exact, coalesce(pl <> label, false) AS swapped FROM best)"""


@query(f"{_OUT} SELECT label, count(*) AS n, count(*) FILTER (found) AS found, count(*) FILTER (exact) AS exact, count(*) FILTER (swapped) AS swapped FROM o GROUP BY label")
def gold_outcomes(spark, sf_dir):
    """Gold spans found, exact, or taken for another label."""
    rows = C.outcomes(_gold(spark, sf_dir), _pred(spark, sf_dir))
    return rows.groupBy("label").agg(F.count("*").alias("n"), *(F.count_if(F.col(c)).alias(c) for c in ("found", "exact", "swapped")))


@query(f"{_OUT} SELECT lang, label, count(*) AS n, count(*) FILTER (exact) / count(*) AS recall FROM o GROUP BY GROUPING SETS ((lang, label), (lang), (label), ())")
def recall_levels(spark, sf_dir):
    """Exact recall by language and label, each alone, and over all."""
    rows = C.outcomes(_gold(spark, sf_dir), _pred(spark, sf_dir))
    sets = [[F.col("lang"), F.col("label")], [F.col("lang")], [F.col("label")], []]
    return rows.groupingSets(sets, "lang", "label").agg(F.count("*").alias("n"), (F.count_if(F.col("exact")) / F.count("*")).alias("recall"))


@query(
    f"""WITH spans AS (SELECT doc_id, label, "start", "end" FROM ({found_sql(BROAD)})), {FOLD_SQL}, r AS (SELECT source, count(*) AS raw FROM spans JOIN documents USING (doc_id) GROUP BY source), k AS (SELECT source, sum(len(kept))::BIGINT AS kept FROM folded JOIN documents USING (doc_id) GROUP BY source)
SELECT source, raw, kept, raw - kept AS overlap_dropped FROM r JOIN k USING (source)"""
)
def cleanup_counts(spark, sf_dir):
    """Raw spans, those kept after overlap resolution, and those dropped, by source."""
    spans = D.rules(docs(spark, sf_dir), BROAD, keep=("doc_id", "source"))
    grouped = spans.groupBy("doc_id", "source").agg(F.count("*").alias("raw"), F.size(S.resolved(F.collect_list(F.struct("start", "end", "label")))).alias("kept"))
    return grouped.groupBy("source").agg(F.sum("raw").alias("raw"), F.sum("kept").alias("kept"), F.sum(F.col("raw") - F.col("kept")).alias("overlap_dropped"))


@query(
    f"""WITH spans AS (SELECT doc_id, label, "start", "end", value FROM ({found_sql(D.PATTERNS)})), e AS (SELECT *, '<' || label || '>' AS new FROM spans),
 w AS (SELECT *, coalesce(sum(length(new) - ("end" - "start")) OVER (PARTITION BY doc_id ORDER BY "start" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS d FROM e)
SELECT doc_id, label, CAST("start" + d AS INTEGER) AS new_start, CAST("start" + d + length(new) AS INTEGER) AS new_end FROM w"""
)
def edited_spans(spark, sf_dir):
    """Offsets of spans after all of them are replaced: old offsets plus a running sum of changes."""
    rows = D.rules(docs(spark, sf_dir)).withColumn("new", F.concat(F.lit("<"), "label", F.lit(">")))
    return S.edited_offsets(rows).select("doc_id", "label", "new_start", "new_end")


_WORD_TOKENS = [(1, 0, 0, 1, "电"), (1, 1, 1, 2, "话"), (1, 2, 2, 5, "138"), (1, 3, 5, 9, "1234"), (2, 0, 0, 3, "don"), (2, 1, 3, 4, "'"), (2, 2, 4, 5, "t"), (2, 3, 6, 8, "go"), (2, 4, 8, 10, "es")]
_STARTS = [(1, 0, True, True), (1, 1, False, True), (1, 2, False, True), (1, 3, False, False), (2, 0, True, True), (2, 1, True, True), (2, 2, True, True), (2, 3, True, True), (2, 4, False, False)]


@query(f"SELECT doc_id, i, plain, script FROM {values(_STARTS, 'doc_id, i, plain, script')}")
def word_starts(spark, sf_dir):
    """Tokens that begin a word, with and without script boundaries."""
    toks = fixture(spark, _WORD_TOKENS, "doc_id int, i int, s int, e int, tok string")
    plain = S.word_starts(toks).select("doc_id", "i", F.col("first").alias("plain"))
    script = S.word_starts(toks, by_script=True).select("doc_id", "i", F.col("first").alias("script"))
    return plain.join(script, ["doc_id", "i"])


_VALUES = [("PHONE", " +65 6123  4567 ", "+65 6123 4567"), ("PHONE", "n/a", None), ("EMAIL", "a@b.co", "a@b.co"), ("EMAIL", "a b@c", None), ("PERSON", "Jo  Lee", "Jo Lee"), ("PERSON", "R2D2", None), ("OTHER", " x ", "x"), ("OTHER", "  ", None), ("DOB", "[Redacted]", None)]


@query(f"SELECT label, v, clean FROM {values(_VALUES, 'label, v, clean')}")
def clean_values(spark, sf_dir):
    """Values checked by the shape of their label."""
    rows = fixture(spark, _VALUES, "label string, v string, want string")
    return rows.select("label", "v", V.clean_value(F.col("v"), F.col("label")).alias("clean"))


_NAMES = [(1, "Mei Tan|陈美", True, "陈美"), (2, "Mei Tan|陈美", False, "Mei Tan"), (3, "Ana", True, "Ana")]


@query(f"SELECT id, name FROM {values([(i, w) for i, _, _, w in _NAMES], 'id, name')}")
def script_names(spark, sf_dir):
    """Names in the script of their document."""
    rows = fixture(spark, _NAMES, "id int, names string, nonlatin boolean, want string")
    return rows.select("id", V.name_for(F.split("names", r"\|"), F.col("nonlatin")).alias("name"))


@query(
    """WITH l AS (SELECT l_suppkey, avg(l_quantity) FILTER (l_returnflag = 'A') AS a, avg(l_quantity) FILTER (l_returnflag = 'N') AS n, avg(l_quantity) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY l_suppkey)
SELECT s_suppkey, a, n, r FROM supplier LEFT JOIN l ON s_suppkey = l_suppkey"""
)
def model_latency(spark, sf_dir):
    """Every model with its timings pivoted by size, null where none was measured."""
    times = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.avg("l_quantity"))
    times = times.select("l_suppkey", *(F.col(c).alias(c.lower()) for c in "ANR"))
    models = table(spark, sf_dir, "supplier").select("s_suppkey")
    return models.join(times, models.s_suppkey == times.l_suppkey, "left").drop("l_suppkey")


_HELD = [("BRAZIL",), ("CHINA",), ("FRANCE",)]


@query(f"SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE n_name NOT IN (SELECT n FROM {values(_HELD, 'n')})")
def held_out_dimension(spark, sf_dir):
    """Rows joined to a market dimension without its held-out members; the dimensions are small and broadcast by size."""
    held = fixture(spark, _HELD, "n string")
    nation = table(spark, sf_dir, "nation").join(held, F.col("n_name") == F.col("n"), "left_anti")
    both = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return both.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "n_name", "r_name")


@query("SELECT count(*) AS n, avg((pred = gold)::INTEGER) AS accuracy, avg(gold::INTEGER) AS replaced, 2.0 * sum((pred AND gold)::INTEGER) / nullif(sum(pred::INTEGER) + sum(gold::INTEGER), 0) AS f1 FROM (SELECT l_returnflag = 'R' AS gold, l_discount >= 0.05 AS pred FROM lineitem)")
def replaced_token_stats(spark, sf_dir):
    """Accuracy, share and F1 of a binary detector."""
    gold, pred = F.col("l_returnflag") == "R", F.col("l_discount") >= 0.05
    n = lambda c: F.sum(c.cast("int"))
    return table(spark, sf_dir, "lineitem").agg(
        F.count("*").alias("n"), F.avg((gold == pred).cast("int")).alias("accuracy"), F.avg(gold.cast("int")).alias("replaced"), (F.lit(2.0) * n(gold & pred) / F.nullif(n(gold) + n(pred), F.lit(0))).alias("f1")
    )


@query(
    f"""WITH w AS (SELECT n_name AS name, count(*) AS weight FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name NOT IN (SELECT n FROM {values(_HELD, 'n')}) GROUP BY n_name),
 r AS (SELECT name, sum(weight) OVER (ORDER BY name) AS upto, weight, sum(weight) OVER () AS total FROM w)
SELECT c_custkey, name AS market FROM customer JOIN r ON ('0x' || substr(md5('market|' || c_custkey), 1, 8))::BIGINT % total >= upto - weight AND ('0x' || substr(md5('market|' || c_custkey), 1, 8))::BIGINT % total < upto"""
)
def weighted_markets(spark, sf_dir):
    """A market for every customer, drawn by the number of suppliers there; held-out markets are never drawn."""
    held = fixture(spark, _HELD, "n string")
    nation = table(spark, sf_dir, "nation").join(held, F.col("n_name") == F.col("n"), "left_anti")
    weights = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("weight"))
    return K.drawn_by_weight(table(spark, sf_dir, "customer").select("c_custkey"), weights, "c_custkey", "n_name", "weight", "market", "market")
