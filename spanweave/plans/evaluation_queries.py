"""Queries of evaluation reports and of span cleaning, over the whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanweave.functions import text as X
from spanweave.functions.offsets import matches
from spanweave.operators import cleaning as N
from spanweave.operators import corpus as K
from spanweave.operators import detect as D
from spanweave.operators import evaluation as E
from spanweave.operators import leaderboard as L
from spanweave.operators import scoring as C
from spanweave.operators import spans as S
from spanweave.plans.registry import query
from spanweave.plans.score_queries import _GOLD, _OVER, _PRF, _BOTH
from spanweave.plans.span_queries import GOLD_TOKENS, TOKENS_SQL, docs, found_sql
from spanweave.session import table

_COLS = "doc_id, lang, source"
_G = f"gold AS ({found_sql(_GOLD, _COLS)}), pred AS ({found_sql(D.LOOSE, _COLS)})"
_HITS = f"""hits AS (SELECT g.doc_id, g.lang, g.source, g.label, g.value, g."start", g."end", coalesce(bool_or(p.label = g.label), false) AS found, coalesce(bool_or(p.label = g.label AND p."start" = g."start" AND p."end" = g."end"), false) AS exact,
  count(p.label) > 0 AS any_, coalesce(bool_or(p.label = CASE g.label WHEN 'PHONE' THEN 'ACCOUNT' WHEN 'ACCOUNT' THEN 'PHONE' END), false) AS partner FROM gold g LEFT JOIN pred p ON {_OVER} GROUP BY ALL)"""


def _gold(spark, sf_dir):
    return D.rules(docs(spark, sf_dir), _GOLD, ("doc_id", "lang", "source"))


def _pred(spark, sf_dir):
    return D.rules(docs(spark, sf_dir), D.LOOSE, ("doc_id", "lang", "source")).drop("value")


def _hits(spark, sf_dir):
    return E.hits(_gold(spark, sf_dir), _pred(spark, sf_dir), {"PHONE": "ACCOUNT", "ACCOUNT": "PHONE"})


@query(
    f"""WITH {_G}, {_HITS}, k AS (SELECT *, unnest(list_filter([label, CASE WHEN label = 'EMAIL' THEN 'EMAIL/' || CASE WHEN contains(value, chr(10)) THEN 'multi-line' ELSE 'single-line' END END, CASE WHEN label = 'EMAIL' THEN 'EMAIL/' || lang END], lambda x: x IS NOT NULL)) AS key FROM hits)
SELECT key, count(*) AS n, count(*) FILTER (found) AS found, count(*) FILTER (exact) AS exact, count(*) FILTER (partner AND NOT found) AS swap FROM k GROUP BY key"""
)
def gold_hits(spark, sf_dir):
    """Gold found, exact and taken for its counterpart; one label by layout and country too."""
    return E.gold_report(_hits(spark, sf_dir), country=F.col("lang"), address="EMAIL")


_CTX = "CASE doc_id % 4 WHEN 0 THEN 'bracket_anchor' WHEN 1 THEN 'form' WHEN 2 THEN 'prose' ELSE 'table' END"
_MODE = "CASE WHEN doc_id % 2 = 0 THEN 'mono' ELSE 'cs' END"


@query(
    f"""WITH {_G}, {_HITS}, r AS (SELECT *, {_CTX} AS ctx, source AS format, lang || '/' || {_MODE} AS setting, {_MODE} AS mode FROM hits WHERE doc_id % 4 <> 0)
SELECT CASE WHEN grouping(ctx) = 0 AND grouping(label) = 0 THEN 'ctx/label' WHEN grouping(ctx) = 0 THEN 'ctx' WHEN grouping(label) = 0 THEN 'label' WHEN grouping(format) = 0 THEN 'format' WHEN grouping(setting) = 0 THEN 'setting' WHEN grouping(mode) = 0 THEN 'mode' ELSE 'ALL' END AS level,
 concat_ws('|', ctx, label, format, setting, mode) AS key, count(*) AS n, count(*) FILTER (exact) AS strict, count(*) FILTER (found) AS lenient FROM r GROUP BY GROUPING SETS ((ctx, label), (ctx), (label), (format), (setting), (mode), ())"""
)
def grid_recall(spark, sf_dir):
    """Recall of gold at seven levels, anchors left out."""
    found = _hits(spark, sf_dir).withColumns({"ctx": F.expr(_CTX), "format": F.col("source"), "mode": F.expr(_MODE)})
    return E.grid_recall(found)


@query(
    f"""WITH {_G}, {_HITS}, g AS (SELECT doc_id, 'set' || doc_id % 3 AS s, lang, label, "start", "end", count(*) AS g, count(*) FILTER (any_) AS cov FROM hits GROUP BY ALL), p AS (SELECT doc_id, 'set' || doc_id % 3 AS s, lang, label, "start", "end", count(*) AS p FROM pred GROUP BY ALL),
 b AS (SELECT s, lang, label, coalesce(g, 0) AS g, coalesce(p, 0) AS p, least(coalesce(g, 0), coalesce(p, 0)) AS tp, coalesce(cov, 0) AS cov FROM g FULL JOIN p USING (doc_id, s, lang, label, "start", "end")),
 t AS (SELECT CASE WHEN grouping(s) = 1 THEN 'ALLSETS' ELSE s END AS "set", CASE WHEN grouping(label) = 0 THEN 'ent/' || label WHEN grouping(lang) = 0 THEN 'lang/' || lang ELSE 'ALL' END AS key, sum(g) AS n, sum(tp) AS tp, sum(p - tp) AS fp, sum(g - tp) AS fn, sum(cov) AS cov
  FROM b GROUP BY GROUPING SETS ((s), (s, label), (s, lang), (), (label), (lang)))
SELECT "set", key, CASE WHEN n > 0 THEN coalesce(2.0 * tp / nullif(2.0 * tp + fp + fn, 0), 0.0) END AS f1, CASE WHEN n > 0 THEN cov / n END AS coverage, n::BIGINT AS n, coalesce(CASE WHEN n > 0 THEN round(2.0 * tp / nullif(2.0 * tp + fp + fn, 0), 9) END = max(CASE WHEN n > 0 THEN round(2.0 * tp / nullif(2.0 * tp + fp + fn, 0), 9) END) OVER (PARTITION BY key), false) AS best FROM t"""
)
def set_breakdown(spark, sf_dir):
    """F1 and coverage of every set and of all pooled, null where there is no gold, with the best set of each key."""
    name = F.concat(F.lit("set"), (F.col("doc_id") % 3).cast("string"))
    rows = E.breakdown(_hits(spark, sf_dir).withColumn("set", name), _pred(spark, sf_dir).withColumn("set", name))
    return E.best_of(rows.withColumn("r", F.round("f1", 9)), ["key"], "r").drop("r")


@query(
    f"""{_BOTH}, g AS (SELECT doc_id, lang, "start", "end", label, count(*) AS g FROM gold GROUP BY ALL), p AS (SELECT doc_id, lang, "start", "end", label, count(*) AS p FROM pred GROUP BY ALL),
 e AS (SELECT lang, least(coalesce(g, 0), coalesce(p, 0)) AS tp, coalesce(p, 0) - least(coalesce(g, 0), coalesce(p, 0)) AS fp, coalesce(g, 0) - least(coalesce(g, 0), coalesce(p, 0)) AS fn FROM g FULL JOIN p USING (doc_id, lang, "start", "end", label)),
 s AS (SELECT lang, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM e GROUP BY GROUPING SETS ((), (lang))), f AS (SELECT lang, {_PRF} FROM s) SELECT lang, precision, recall, f1, avg(f1) FILTER (lang IS NOT NULL) OVER () AS macro_f1 FROM f"""
)
def entity_f1(spark, sf_dir):
    """Whole entities: micro scores of each language and of all, and the mean over languages."""
    return E.entity_f1(_gold(spark, sf_dir), _pred(spark, sf_dir))


_BEST = """SELECT {0}.lang, {0}.label, {0}.doc_id, {0}."start", {0}."end", max_by(p.label, {{'o': least({0}."end", p."end") - greatest({0}."start", p."start"), 's': -p."start", 'e': -p."end"}}) AS pl FROM {0} LEFT JOIN pred p ON p.doc_id = {0}.doc_id AND p."start" < {0}."end" AND {0}."start" < p."end" GROUP BY ALL"""


@query(
    f"""WITH allgold AS ({found_sql({**_GOLD, "IGNORE": D.PATTERNS["SECRET"]}, _COLS)}), gold AS (SELECT *, CASE WHEN regexp_matches(value, '[^\\x00-\\x7F]') THEN 'x' ELSE 'latin' END AS script FROM allgold WHERE label <> 'IGNORE'),
 negs AS ({found_sql({"IP": D.PATTERNS["IP"]}, _COLS)}), pred AS (SELECT * FROM ({found_sql(D.LOOSE, _COLS)}) p WHERE NOT EXISTS (SELECT 1 FROM allgold z WHERE z.label = 'IGNORE' AND z.doc_id = p.doc_id AND z."start" < p."end" AND p."start" < z."end")),
 hits AS (SELECT g.doc_id, g.lang, g.script, g.label, g."start", g."end", coalesce(bool_or(p.label = g.label), false) AS found, coalesce(bool_or(p.label = g.label AND p."start" = g."start" AND p."end" = g."end"), false) AS exact, count(p.label) > 0 AS any_ FROM gold g LEFT JOIN pred p ON {_OVER} GROUP BY ALL),
 gg AS (SELECT doc_id, lang, "start", "end", label, count(*) AS g FROM gold GROUP BY ALL), pp AS (SELECT doc_id, lang, "start", "end", label, count(*) AS p FROM pred GROUP BY ALL),
 e AS (SELECT lang, label, least(coalesce(g, 0), coalesce(p, 0)) AS tp, coalesce(p, 0) - least(coalesce(g, 0), coalesce(p, 0)) AS fp, coalesce(g, 0) - least(coalesce(g, 0), coalesce(p, 0)) AS fn FROM gg FULL JOIN pp USING (doc_id, lang, "start", "end", label)),
 st AS (SELECT lang, label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM e GROUP BY GROUPING SETS ((), (lang), (lang, label))),
 gl AS (SELECT doc_id, lang, label, list({{'s': "start", 'e': "end"}} ORDER BY "start", "end") AS g FROM gold GROUP BY ALL), pl AS (SELECT doc_id, lang, label, list({{'s': "start", 'e': "end"}} ORDER BY "start", "end") AS p FROM pred GROUP BY ALL),
 j AS (SELECT doc_id, lang, label, coalesce(g, []) AS g, coalesce(p, []) AS p FROM gl FULL JOIN pl USING (doc_id, lang, label)),
 m AS (SELECT lang, label, len(g) AS ng, len(p) AS np, CASE WHEN len(p) = 0 THEN 0 ELSE len(list_reduce(list_prepend(CAST([] AS INTEGER[]), list_transform(range(1, len(p) + 1), lambda k: [k::INTEGER])), lambda acc, k:
   list_concat(acc, list_filter(CAST(range(1, len(g) + 1) AS INTEGER[]), lambda n: g[n].s < p[k[1]].e AND p[k[1]].s < g[n].e AND NOT list_contains(acc, n))[1:1]))) END AS tp FROM j),
 le AS (SELECT lang, label, sum(tp) AS tp, sum(np - tp) AS fp, sum(ng - tp) AS fn FROM m GROUP BY GROUPING SETS ((), (lang), (lang, label))),
 best AS ({_BEST.format("gold")}), nbest AS ({_BEST.format("negs")}), c AS (SELECT lang, label, coalesce(pl, 'MISS') AS predicted, count(*) AS n FROM best GROUP BY ALL)
SELECT 'strict' AS part, lang, label, NULL::VARCHAR AS other, support AS n, f1 AS value FROM (SELECT lang, label, {_PRF} FROM st)
UNION ALL SELECT 'lenient', lang, label, NULL, support, f1 FROM (SELECT lang, label, {_PRF} FROM le)
UNION ALL SELECT 'script', lang, script, unnest(['strict', 'lenient']), count(*), unnest([avg(exact::INTEGER), avg(found::INTEGER)]) FROM hits GROUP BY lang, script
UNION ALL SELECT 'detection', lang, label, NULL, count(*), avg(any_::INTEGER) FROM hits GROUP BY GROUPING SETS ((lang), (lang, label))
UNION ALL SELECT 'confusion', lang, label, predicted, n, n / sum(n) OVER (PARTITION BY lang, label) FROM c
UNION ALL SELECT 'negatives', lang, label, NULL, count(*), avg((pl IS NOT NULL)::INTEGER) FROM nbest GROUP BY lang, label"""
)
def evaluation_bundle(spark, sf_dir):
    """All parts of every language's evaluation; secrets are masked zones, addresses of the network look-alikes."""
    gold = D.rules(docs(spark, sf_dir), {**_GOLD, "IGNORE": D.PATTERNS["SECRET"]}, ("doc_id", "lang", "source"))
    gold = gold.withColumn("script", F.when(F.col("value").rlike(r"[^\x00-\x7F]"), "x").otherwise("latin")).drop("value")
    negs = D.rules(docs(spark, sf_dir), {"IP": D.PATTERNS["IP"]}, ("doc_id", "lang", "source")).drop("value")
    return E.bundle(gold, _pred(spark, sf_dir), negs)


@query(f"""{_BOTH}, best AS ({_BEST.format("gold")}), c AS (SELECT lang, label, coalesce(pl, 'MISS') AS predicted, count(*) AS n FROM best GROUP BY ALL)
SELECT lang, label, predicted, n, n / sum(n) OVER (PARTITION BY lang, label) AS share, row_number() OVER (PARTITION BY lang, label ORDER BY n DESC, predicted)::INTEGER AS rank FROM c QUALIFY rank <= 4""")
def top_confusions(spark, sf_dir):
    """The four labels that each gold label is most often taken for."""
    return E.top_confusions(C.confusion(_gold(spark, sf_dir).drop("value"), _pred(spark, sf_dir), ["lang"]), ["lang"])


@query(
    """WITH k AS (SELECT CASE WHEN grouping(source) = 0 AND grouping(lang) = 0 THEN 'src/' || source || '/' || lang WHEN grouping(source) = 0 THEN 'src/' || source WHEN grouping(lang) = 0 THEN 'ent/' || lang ELSE 'ALL' END AS key, count(*) AS n FROM documents GROUP BY GROUPING SETS ((), (lang), (source), (source, lang)))
SELECT key, n, row_number() OVER (ORDER BY key <> 'ALL', length(key) - length(replace(key, '/', '')), key)::INTEGER AS rank FROM k"""
)
def report_order(spark, sf_dir):
    """Keys of a report in its order."""
    sets = [[F.col(c) for c in s] for s in ([], ["lang"], ["source"], ["source", "lang"])]
    rows = docs(spark, sf_dir).groupingSets(sets, "source", "lang").agg(F.count("*").alias("n"))
    key = F.when(F.col("source").isNotNull(), F.concat_ws("/", F.lit("src"), "source", "lang")).when(F.col("lang").isNotNull(), F.concat(F.lit("ent/"), "lang")).otherwise("ALL")
    return E.ordered_keys(rows.select(key.alias("key"), "n"))


_HASH = "('0x' || substr(md5(doc_id || '|' || first || '|' || win), 1, 2))::INTEGER"


@query(
    f"""WITH s AS (SELECT o_orderkey AS doc_id, (o_orderkey % 700)::INTEGER AS first, (o_orderkey % 700 + o_custkey % 9)::INTEGER AS last, 'X' AS label, 382 + o_orderkey % 900 AS n FROM orders),
 w AS (SELECT *, unnest(range(0, greatest(0, ceil((n - 382) / 286.0))::INTEGER + 1))::INTEGER AS win FROM s), h AS (SELECT *, {_HASH} AS h FROM w WHERE win * 286 <= first AND last < least(win * 286 + 382, n))
SELECT doc_id, first, last, label, avg(h / 256.0) AS score, count(*) AS votes FROM h WHERE h % 7 <> 0 GROUP BY ALL"""
)
def window_span_scores(spark, sf_dir):
    """Candidate spans scored in every window that holds both their words; some pairs have no score."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 700).cast("int").alias("first"), (F.col("o_orderkey") % 700 + F.col("o_custkey") % 9).cast("int").alias("last"), F.lit("X").alias("label"), (382 + F.col("o_orderkey") % 900).alias("n"))
    windows = S.windows(rows.select("doc_id", "n")).select("doc_id", "win", "lo", "hi")
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in ("doc_id", "first", "win"))).cast("binary")), 1, 2), 16, 10).cast("int")
    scores = rows.join(windows.select("doc_id", "win"), "doc_id").select("doc_id", "first", "last", "label", "win", F.when(h % 7 != 0, h / 256.0).alias("score"))
    return E.window_scores(rows.drop("n"), windows, scores)


@query(
    f"""WITH {TOKENS_SQL}, {GOLD_TOKENS}, c AS (SELECT doc_id, count(*) AS n FROM toks GROUP BY doc_id), w AS (SELECT doc_id, n, unnest(range(0, greatest(0, ceil((n - 100) / 60.0))::INTEGER + 1))::INTEGER AS win FROM c),
 t AS (SELECT w.doc_id, w.win, w.win * 60 AS lo, least(w.win * 60 + 100, n) AS hi, CASE WHEN t.i = w.win * 60 AND g.tag LIKE 'I-%' THEN 'B-' || substr(g.tag, 3) ELSE coalesce(g.tag, 'O') END AS tag FROM w JOIN toks t ON t.doc_id = w.doc_id AND t.i >= w.win * 60 AND t.i < w.win * 60 + 100 LEFT JOIN tagged g ON g.doc_id = t.doc_id AND g.i = t.i)
SELECT doc_id, win, lo::INTEGER AS lo, hi::INTEGER AS hi, (count(*) + 2)::INTEGER AS n, (count(*) FILTER (tag LIKE 'B-%'))::INTEGER AS begins, (count(*) FILTER (tag LIKE 'I-%'))::INTEGER AS insides FROM t GROUP BY ALL"""
)
def encoded_windows(spark, sf_dir):
    """Tokens of every document tagged and cut into windows of a hundred, without a shuffle."""
    spans = F.flatten(F.array(*(matches(F.col("text"), p, k) for k, p in D.PATTERNS.items())))
    rows = docs(spark, sf_dir).where(F.col("text").rlike(S.TOKEN)).select("doc_id", F.explode(S.encoded_windows(F.col("text"), spans, 100, 40)).alias("w"))
    tags = lambda kind: F.size(F.filter("w.tags", lambda t: t.startswith(kind)))
    return rows.select("doc_id", "w.win", "w.lo", "w.hi", F.size("w.tags").alias("n"), tags("B-").alias("begins"), tags("I-").alias("insides"))


@query(f"WITH f AS ({found_sql(D.PATTERNS, 'doc_id, source')}), c AS (SELECT source, label, count(*) AS n FROM f GROUP BY ALL) SELECT source, label, n, n / sum(n) OVER (PARTITION BY source) AS share FROM c")
def kind_shares(spark, sf_dir):
    """Share of each kind of span in every source."""
    return K.shares(D.rules(docs(spark, sf_dir), keep=("doc_id", "source")), "source", "label")


# -- cleaning ----------------------------------------------------------------------------------------------------

#: Raw labels of the queries below and what finds them.
RAW = {"email": D.PATTERNS["EMAIL"], "digits": D.PATTERNS["ACCOUNT"], "number": "[0-9]{1,2}", "ip": D.PATTERNS["IP"], "city": "[A-Z][a-z]+", "street_address": "[0-9]+ [A-Za-z]+"}
MAPPING = {"email": "EMAIL", "digits": "ACCOUNT", "number": "DATE_CUE", "city": "ADDRESS", "street_address": "ADDRESS"}
_LINE = """string_split(substr(text, greatest({0} - 40, 0) + 1, {0} - greatest({0} - 40, 0)), chr(10))[-1]"""
_CLEAN = f"""raws AS (SELECT * FROM ({found_sql(RAW, 'doc_id, source, text')})),
 targeted AS (SELECT doc_id, source, text, "start", "end", label AS raw, CASE label WHEN 'email' THEN 'EMAIL' WHEN 'digits' THEN 'ACCOUNT' WHEN 'city' THEN 'ADDRESS' WHEN 'street_address' THEN 'ADDRESS'
   WHEN 'number' THEN CASE WHEN regexp_matches({_LINE.format('"start"')}, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(?:birth|born|dob|d\\.o\\.b)\\.?[^.;|\\t\\n\\p{{Nd}}]{{0,25}}$') THEN 'DOB' END END AS target FROM raws),
 lists AS (SELECT doc_id, any_value(source) AS source, any_value(text) AS text, list({{'s': "start", 'e': "end", 'target': target, 'raw': raw}} ORDER BY "start", "end" DESC) AS l FROM targeted WHERE target IS NOT NULL GROUP BY doc_id),
 folded AS (SELECT doc_id, source, text, len(l) AS n_mapped, list_reduce(list_transform(l, lambda x: [x]), lambda acc, y:
    CASE WHEN y[1].s >= acc[-1].e THEN list_concat(acc, y) WHEN y[1].e - y[1].s > acc[-1].e - acc[-1].s THEN list_concat(acc[1:len(acc) - 1], y) ELSE acc END) AS kept FROM lists),
 one AS (SELECT doc_id, source, text, unnest(kept) AS k FROM folded), flat AS (SELECT doc_id, source, text, k.s AS s, k.e AS e, k.target AS target, k.raw AS raw FROM one),
 broken AS (SELECT *, CASE WHEN target = lag(target) OVER w AND regexp_full_match(substr(text, lag(e) OVER w + 1, s - lag(e) OVER w), CASE WHEN target = 'ADDRESS' THEN '[\\s,]*' ELSE '[ \\t]*' END) THEN 0 ELSE 1 END AS brk FROM flat WINDOW w AS (PARTITION BY doc_id ORDER BY s)),
 numbered AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS isl FROM broken),
 joined AS (SELECT doc_id, any_value(source) AS source, any_value(text) AS text, min(s) AS s, max(e) AS e, any_value(target) AS label, list_sort(list(DISTINCT raw)) AS raws FROM numbered GROUP BY doc_id, isl),
 judged AS (SELECT *, coalesce(lead(s) OVER (PARTITION BY doc_id ORDER BY s), length(text)) AS nxt, label = 'ADDRESS' AND len(list_filter(raws, lambda r: r <> 'city')) = 0
   AND NOT regexp_matches({_LINE.format('s')}, '(?i)(?:address|addr\\.?|city|town|state|province|country|county|post ?code|zip|residen\\w*|located at|domicile)\\W{{0,3}}$') AS place FROM joined),
 tails AS (SELECT *, length(regexp_extract(substr(text, e + 1), '^,[^\\n.;|()]{{1,80}}')) AS tail FROM judged),
 kept_tails AS (SELECT * FROM tails WHERE label = 'ADDRESS' AND raws = ['street_address'] AND NOT place AND tail > 0 AND e + tail <= nxt)"""


def _clean(spark, sf_dir):
    found = F.flatten(F.array(*(matches(F.col("text"), p, k) for k, p in RAW.items())))
    rows = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "source", "text", F.transform(found, lambda s: s.dropFields("value")).alias("spans"))
    return rows.select("id", "source", N.cleaned(F.col("text"), F.col("spans"), MAPPING, {"ip": "number"}, True).alias("c"))


@query(
    f"""WITH {_CLEAN} SELECT doc_id, 'span' AS kind, s AS "start", e AS "end", label FROM judged WHERE NOT place UNION ALL SELECT doc_id, 'span', e, CAST(e + tail AS INTEGER), 'IGNORE' FROM kept_tails
UNION ALL SELECT doc_id, 'neg', s, e, 'place' FROM judged WHERE place UNION ALL SELECT doc_id, 'neg', "start", "end", 'number' FROM raws WHERE label = 'ip'"""
)
def clean_spans(spark, sf_dir):
    """Raw spans of every document to targets, through all rules: what stays, and the look-alikes."""
    rows = _clean(spark, sf_dir)

    def named(kind: str, column: str):
        return F.transform(column, lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("s")))

    both = F.concat(named("span", "c.spans"), named("neg", "c.negs"))
    return rows.select(F.col("id").alias("doc_id"), F.explode(both).alias("x")).select("doc_id", "x.kind", "x.s.start", "x.s.end", "x.s.label")


@query(
    f"""WITH {_CLEAN}, sources AS (SELECT DISTINCT source FROM documents), counts AS (
 SELECT source, 'date_cue_o' AS rule, count(*) AS n FROM targeted WHERE raw = 'number' AND target IS NULL GROUP BY 1 UNION ALL SELECT source, 'date_cue_dob', count(*) FROM targeted WHERE raw = 'number' AND target IS NOT NULL GROUP BY 1
 UNION ALL SELECT source, 'overlap_dropped', sum(n_mapped - len(kept)) FROM folded GROUP BY 1 UNION ALL SELECT source, 'merged', count(*) FROM broken WHERE brk = 0 GROUP BY 1
 UNION ALL SELECT source, 'address_bare_place_to_O', count(*) FROM judged WHERE place GROUP BY 1 UNION ALL SELECT source, 'address_tail_ignored', count(*) FROM kept_tails GROUP BY 1)
SELECT source, rule, coalesce(n, 0)::BIGINT AS n FROM (SELECT * FROM sources CROSS JOIN (SELECT unnest(['date_cue_dob', 'date_cue_o', 'invalid', 'dob_placeholder', 'overlap_dropped', 'merged', 'address_bare_place_to_O', 'address_tail_ignored']) AS rule)) LEFT JOIN counts USING (source, rule)"""
)
def cleanup_rules(spark, sf_dir):
    """What every cleaning rule did in each source."""
    return N.counted(_clean(spark, sf_dir).select("source", "c.stats"))


@query("SELECT doc_id FROM (SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '[0-9]{13,16}') AND NOT regexp_matches(text, 'token = \"[0-9a-f]+\"')) WHERE lang <> 'de'")
def type_filter(spark, sf_dir):
    """Documents that have a label, without those of some types."""
    found = F.flatten(F.array(*(matches(F.col("text"), D.PATTERNS[k], k) for k in ("ACCOUNT", "SECRET"))))
    rows = docs(spark, sf_dir).select("doc_id", "lang", found.alias("spans")).where(N.has_label(F.col("spans"), "ACCOUNT") & N.has_target(F.col("spans")))
    return N.without_types(rows, ["SECRET", "de"], kind="lang").select("doc_id")


# -- shares, packing, fragments ----------------------------------------------------------------------------------


@query(
    """WITH c AS (SELECT source, count(*) AS available, CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) AS pos FROM documents GROUP BY source),
 b AS (SELECT *, 30 + 2 * pos AS cap, least(30 + 2 * pos, available) AS n, available - least(30 + 2 * pos, available) AS room FROM c), t AS (SELECT sum(cap - n)::BIGINT AS short, max(room) AS most FROM b),
 l AS (SELECT level FROM (SELECT level, sum(least(room, level)) AS used FROM b, (SELECT unnest(range(0, most + 1)) AS level FROM t) GROUP BY level), t WHERE used <= short ORDER BY level DESC LIMIT 1),
 o AS (SELECT *, row_number() OVER (ORDER BY pos, source) AS k FROM b, l WHERE room > level), r AS (SELECT short - (SELECT sum(least(room, level)) FROM b, l) AS rest FROM t)
SELECT b.source, (b.n + least(b.room, l.level) + coalesce(CASE WHEN o.k <= r.rest THEN 1 END, 0))::BIGINT AS n FROM b CROSS JOIN l CROSS JOIN r LEFT JOIN o ON o.source = b.source"""
)
def allocated_shares(spark, sf_dir):
    """Rows of each source up to a cap of 30 to 70, what small sources lack spread over the others."""
    counts = docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("available"))
    pos = F.regexp_extract("source", "([0-9]+)", 1).cast("int")
    return K.allocated(counts.withColumn("pos", pos).withColumn("cap", 30 + 2 * F.col("pos")))


@query(
    """WITH p AS (SELECT doc_id, length(text) + 1 AS n, sum(length(text) + 1) OVER (ORDER BY doc_id) - length(text) - 1 AS p0, list_append(list_transform(string_split(text, ''), lambda c: unicode(c) % 997), 1) AS ids FROM documents WHERE length(text) > 0), t AS (SELECT (sum(n) // 510)::BIGINT AS whole FROM p),
 r AS (SELECT *, unnest(range((p0 // 510)::BIGINT, ((p0 + n - 1) // 510)::BIGINT + 1)) AS seq_id FROM p), s AS (SELECT seq_id, p0, ids[(greatest(seq_id * 510 - p0, 0) + 1)::BIGINT:(least((seq_id + 1) * 510 - p0, n))::BIGINT] AS part FROM r, t WHERE seq_id < whole)
SELECT seq_id, len(ids)::INTEGER AS n, md5(array_to_string(ids, ' ')) AS ids_md5 FROM (SELECT seq_id, list_concat([0], flatten(list(part ORDER BY p0)), [1]) AS ids FROM s GROUP BY seq_id)"""
)
def packed_ids(spark, sf_dir):
    """Token ids (code points) of all documents end to end in sequences of 510 between two marks."""
    rows = docs(spark, sf_dir).where(F.length("text") > 0)
    ids = F.transform(F.filter(F.split("text", ""), lambda c: c != ""), lambda c: F.ascii(c) % 997)
    found = K.packed_ids(rows.select("doc_id", ids.alias("ids")), "ids", "doc_id", 510, 0, 1)
    return found.select("seq_id", F.size("ids").alias("n"), F.md5(F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").cast("binary")).alias("ids_md5"))


@query(
    f"""WITH f AS ({found_sql({"EMAIL": D.PATTERNS["EMAIL"], "ACCOUNT": D.PATTERNS["ACCOUNT"]})}), d AS (SELECT doc_id, doc_id // 3 AS grp, text, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id // 3 ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents),
 s AS (SELECT grp, count(*) AS n, sum("start" + before)::BIGINT AS starts FROM f JOIN d USING (doc_id) GROUP BY grp), t AS (SELECT grp, md5(string_agg(text, chr(10) || chr(10) ORDER BY doc_id)) AS text_md5 FROM d GROUP BY grp)
SELECT grp, text_md5, coalesce(n, 0) AS n, coalesce(starts, 0) AS starts FROM t LEFT JOIN s USING (grp)"""
)
def packed_fragments(spark, sf_dir):
    """Three documents as fragments of one, their spans moved."""
    found = F.flatten(F.array(*(matches(F.col("text"), D.PATTERNS[k], k) for k in ("EMAIL", "ACCOUNT"))))
    rows = docs(spark, sf_dir).select(F.floor(F.col("doc_id") / 3).alias("grp"), "doc_id", "text", found.alias("spans"))
    packed = K.fragments_packed(rows, "grp", "doc_id")
    starts = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["start"])
    return packed.select("grp", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.size("spans").cast("long").alias("n"), starts.alias("starts"))


@query("SELECT doc_id, CASE WHEN w = upper(w) AND w <> lower(w) AND length(w) > 1 THEN text ELSE lower(substr(text, 1, 1)) || substr(text, 2) END AS said FROM (SELECT doc_id, substr(text, 1, 200) AS text, regexp_extract(substr(text, 1, 200), '^\\s*(\\S+)', 1) AS w FROM documents)")
def cue_in_sentence(spark, sf_dir):
    """Beginnings of texts as cues inside a sentence."""
    return docs(spark, sf_dir).select("doc_id", X.in_sentence(F.substring("text", 1, 200)).alias("said"))


@query()
def difficulty_cross_fit(spark, sf_dir):
    """Mentions scored by models of the other fold, from the entity and from its context, and summed up."""
    spans = D.rules(docs(spark, sf_dir), keep=("doc_id", "lang", "source", "text"))
    context = F.concat(F.expr("substring(text, greatest(start - 40, 0) + 1, least(start, 40))"), F.lit(" [X] "), F.expr("substring(text, end + 1, 40)"))
    mentions = spans.select("doc_id", "lang", "source", "label", F.col("value").alias("entity"), context.alias("context"))
    return L.difficulty_summary(L.difficulty(L.cross_fitted(mentions)))
