"""Operators of scripts, values and addresses over whole tables, against SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanweave.functions import text as X
from spanweave.functions import values as V
from spanweave.functions.offsets import part
from spanweave.operators import corpus as K
from spanweave.operators import detect as D
from spanweave.operators import spans as S
from spanweave.plans.registry import query
from spanweave.plans.span_queries import docs, found_sql
from spanweave.session import table

_LATIN = "abcdefghijklmnopqrstuvwxyz"
#: Alphabets that stand in for the small Latin letters of a document, by its id; the last replaces vowels alone.
ALPHABETS = [
    _LATIN, "的一是不了人我在有他这中大来上国个到说们为子和你地出"[:26], "あいうえおかきくけこさしすせそたちつてとなにぬねのは", "가나다라마바사아자차카타파하거너더러머버서어저처커터",
    "กขคฆงจฉชซฌญฎฏฐฑฒณดตถทธนบปผ", "ابتثجحخدذرزسشصضطظعغفقكلمنه", "अआइईउऊएऐओऔकखगघङचछजझञटठडढणत", "的bcd一fgh是jklmn不pqrst了vwxyz",
]
_SCRIPTED_SQL = "CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN translate(text, '{_LATIN}', '{a}')" for k, a in enumerate(ALPHABETS)) + " END"


def _scripted(spark, sf_dir):
    """Documents of several scripts."""
    text = F.coalesce(*(F.when(F.col("doc_id") % 8 == k, F.translate("text", _LATIN, a)) for k, a in enumerate(ALPHABETS)))
    return docs(spark, sf_dir).select("doc_id", text.alias("text"))


def _count(script: str) -> str:
    return f"length(regexp_replace(t, '[^{script}]', '', 'g'))"


_COUNTS = f"""counts AS (SELECT doc_id, t, {_count(r'\p{L}')} AS n, {_count(r'\p{Hiragana}\p{Katakana}')} AS kana, {_count(r'\p{Hangul}')} AS hangul, {_count(r'\p{Thai}')} AS thai, {_count(r'\p{Arabic}')} AS arabic,
 {_count(r'\p{Devanagari}')} AS devanagari, {_count(r'\p{Han}')} AS han FROM (SELECT doc_id, {_SCRIPTED_SQL} AS t FROM documents))"""


@query(
    f"""WITH {_COUNTS} SELECT doc_id, CASE WHEN coalesce(n, 0) = 0 THEN NULL WHEN kana >= 2 OR (kana > 0 AND kana >= 0.05 * n) THEN 'ja' WHEN hangul >= 0.2 * n THEN 'ko' WHEN thai >= 0.2 * n THEN 'th' WHEN arabic >= 0.2 * n THEN 'ar'
 WHEN devanagari >= 0.2 * n THEN 'hi' WHEN han >= 0.2 * n THEN 'zh' ELSE 'latin' END AS lang, n::INTEGER AS letters FROM counts"""
)
def route_scripts(spark, sf_dir):
    """The language that each document's script stands for."""
    counts = X.script_counts(F.col("text"))
    return _scripted(spark, sf_dir).select("doc_id", X.script_lang(counts).alias("lang"), counts["letters"].alias("letters"))


@query(f"SELECT doc_id, CASE WHEN regexp_matches(regexp_replace(t, '[0-9]', '', 'g'), '\\p{{Nd}}') OR regexp_matches(regexp_replace(t, '\\p{{Latin}}', '', 'g'), '\\p{{L}}') THEN 'nonlatin' ELSE 'latin' END AS class FROM (SELECT doc_id, {_SCRIPTED_SQL} AS t FROM documents)")
def classes_of_scripts(spark, sf_dir):
    """Whether documents have letters or digits beyond Latin ones."""
    return _scripted(spark, sf_dir).select("doc_id", X.script_class(F.col("text")).alias("class"))


_BLOCKS = "string_split(regexp_replace(replace(text, chr(10), ' '), '([.!?])', '\\1' || chr(10) || chr(10), 'g'), chr(10) || chr(10))"


@query(
    f"""WITH b AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS block FROM (SELECT doc_id, list_filter(list_transform(range(1, len(p) + 1), lambda k: CASE WHEN k < len(p) THEN p[k] || chr(10) || chr(10) ELSE p[k] END), lambda s: s <> '') AS l
  FROM (SELECT doc_id, {_BLOCKS} AS p FROM documents))),
 s AS (SELECT doc_id, i, length(block) AS n, CASE doc_id % 3 WHEN 0 THEN block ELSE translate(block, '{_LATIN}', CASE i % 2 WHEN 0 THEN '{_LATIN}' ELSE '{ALPHABETS[3]}' END) END AS block FROM b),
 k AS (SELECT *, length(regexp_replace(block, '[^\\p{{L}}]', '', 'g')) AS l, length(regexp_replace(block, '[^\\p{{Hangul}}]', '', 'g')) AS h FROM s),
 r AS (SELECT *, CASE WHEN l = 0 THEN NULL WHEN h >= 0.2 * l THEN 'ko' ELSE 'en' END AS lang FROM k),
 f AS (SELECT *, last_value(lang IGNORE NULLS) OVER w AS known, sum(n) OVER w AS stop, coalesce(first_value(lang IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 'en') AS first FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
 g AS (SELECT *, sum(CASE WHEN i = 1 OR (lang IS NOT NULL AND NOT coalesce(lag_known = lang, false)) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS isl FROM (SELECT *, lag(known) OVER (PARTITION BY doc_id ORDER BY i) AS lag_known FROM f))
SELECT doc_id, min(stop - n)::INTEGER AS "start", max(stop)::INTEGER AS "end", coalesce(arg_min(known, i), any_value(first)) AS lang FROM g GROUP BY doc_id, isl"""
)
def route_segments(spark, sf_dir):
    """Sentences of documents as blocks, some in another script: routed and joined."""
    from spanweave.operators.routing import routed_segments

    # A filter on the text that is made would make it twice.
    rows = docs(spark, sf_dir).where("text <> ''")
    blocks = F.filter(X.segments(F.regexp_replace(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), "([.!?])", "$1\n\n")), lambda b: b != "")
    turned = F.transform(blocks, lambda b, i: F.when((F.col("doc_id") % 3 != 0) & (i % 2 == 0), F.translate(b, _LATIN, ALPHABETS[3])).otherwise(b))
    return routed_segments(rows.select("doc_id", F.array_join(turned, "").alias("text")))


_NUMBERS = r"\([0-9]+\)[.,;:]*|[0-9]+[.,;:]*"


@query(
    f"""WITH n AS ({found_sql({"ACCOUNT": _NUMBERS})}) SELECT doc_id, "start" AS at, CASE WHEN regexp_matches(value, '^\\([0-9]+\\)[.,;:]?$') THEN regexp_replace(value, '[^0-9]', '', 'g') WHEN regexp_matches(value, '^[0-9]+[.,;:]$') THEN value[1:length(value) - 1] ELSE value END AS value FROM n"""
)
def trimmed_numbers(spark, sf_dir):
    """Numbers with glued punctuation, trimmed: one stop after a digit or bracket goes, and a pair of brackets."""
    rows = D.rules(docs(spark, sf_dir), {"ACCOUNT": _NUMBERS}, keep=("doc_id", "text"))
    cut = S.trimmed(F.col("text"), F.col("start"), F.col("end"), F.col("label"))
    rows = rows.select("doc_id", "text", F.col("start").alias("at"), cut.alias("c"))
    return rows.select("doc_id", "at", part(F.col("text"), F.col("c.start"), F.col("c.end")).alias("value"))


@query("SELECT o_orderkey, o_orderdate::DATE AS d FROM orders")
def parsed_dates(spark, sf_dir):
    """Order dates written in fourteen formats, with blanks around, and read back; the day is beyond 12 where its place is unclear."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    unclear = F.dayofmonth("d") <= 12
    pick = F.col("o_orderkey") % 14
    safe = F.when(unclear & pick.isin(0, 2, 4), 3).otherwise(pick)
    said = F.concat(F.lit("  \t"), V.rendered_date(F.col("d"), safe), F.lit("\n"))
    return rows.select("o_orderkey", V.parse_date(said).alias("d"))


@query(
    """WITH n AS (SELECT o_orderkey, (o_totalprice * 1000)::BIGINT AS n FROM orders), s AS (SELECT o_orderkey, n, n::VARCHAR AS s FROM n), h AS (SELECT *, CASE WHEN length(s) > 3 THEN s[1:length(s) - 3] END AS head FROM s)
SELECT o_orderkey, CASE WHEN head IS NULL THEN s ELSE array_to_string(list_transform(range(0, ((length(head) + 1) // 2)::BIGINT), lambda k: substr(CASE WHEN length(head) % 2 = 1 THEN ' ' || head ELSE head END, (2 * k + 1)::BIGINT, 2)), ',') || ',' || s[length(s) - 2:] END AS shown FROM h"""
)
def grouped_amounts(spark, sf_dir):
    """Order totals with commas after three digits, then after every two."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", X.indian_grouping((F.col("o_totalprice") * 1000).cast("decimal(20,0)").cast("long")).alias("shown"))
    return rows.select("o_orderkey", F.when(F.length(F.substring_index("shown", ",", 1)) == 1, F.when(F.col("shown").contains(","), F.concat(F.lit(" "), "shown")).otherwise(F.col("shown"))).otherwise(F.col("shown")).alias("shown"))


@query(
    """WITH v AS (SELECT c_custkey, 'GB' || lpad((c_custkey % 97 + 2)::VARCHAR, 2, '0') || 'WEST' || lpad(c_custkey::VARCHAR, 14, '0') AS s FROM customer), d AS (SELECT c_custkey, '32142829' || s[9:] || '1611' || s[3:4] AS digits FROM v)
SELECT c_custkey, (digits::HUGEINT % 97) = 1 AS ok FROM d"""
)
def iban_checks(spark, sf_dir):
    """Account numbers made of customer keys: which check digits hold, by one division of the whole number."""
    key = F.col("c_custkey")
    value = F.concat(F.lit("GB"), F.lpad((key % 97 + 2).cast("string"), 2, "0"), F.lit(" west-"), F.lpad(key.cast("string"), 14, "0"))
    return table(spark, sf_dir, "customer").select("c_custkey", V.mod97_ok(value).alias("ok"))


@query(
    """WITH a AS (SELECT ['us', 'in', 'fr'][(o_orderkey % 3 + 1)::INTEGER] AS country, CASE WHEN o_orderkey % 4 = 0 THEN 'india' ELSE 'osm' END AS source, o_orderkey AS pos, lower((o_custkey % 211) || ' Elm St') AS key FROM orders),
 e AS (SELECT country, min(pos) AS pos, key FROM a WHERE source <> 'india' GROUP BY country, key), er AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY pos) AS k FROM e), early AS (SELECT * FROM er WHERE k <= 60),
 l AS (SELECT country, min(pos) AS pos, key FROM a WHERE source = 'india' AND NOT EXISTS (SELECT 1 FROM early x WHERE x.country = a.country AND x.key = a.key) GROUP BY country, key),
 lr AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY pos) AS k FROM l), h AS (SELECT country, count(*) AS had FROM early GROUP BY country)
SELECT country, pos FROM early UNION ALL SELECT country, pos FROM lr LEFT JOIN h USING (country) WHERE k + coalesce(had, 0) <= 90"""
)
def capped_addresses(spark, sf_dir):
    """Addresses without repeats, by country: sixty of the first sources, then up to ninety with the second."""
    o = table(spark, sf_dir, "orders")
    country = F.element_at(F.array(*map(F.lit, ["us", "in", "fr"])), (F.col("o_orderkey") % 3 + 1).cast("int"))
    lines = F.array(F.concat((F.col("o_custkey") % 211).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, " ELM").otherwise(" Elm")), F.lit("St"))
    rows = o.select(country.alias("country"), F.when(F.col("o_orderkey") % 4 == 0, "india").otherwise("osm").alias("source"), F.col("o_orderkey").alias("pos"), lines.alias("lines"))
    return K.address_capped(rows, 60, 90).select("country", "pos")


@query("SELECT doc_id, lower(trim(regexp_replace(regexp_replace(text, '[0-9]+', '#', 'g'), '\\s+', ' ', 'g'))) AS skeleton FROM documents WHERE NOT regexp_matches(text, '[{}]')")
def text_skeletons(spark, sf_dir):
    """Texts without slots as templates: digits and white space reduced."""
    return docs(spark, sf_dir).where(~F.col("text").rlike("[{}]")).select("doc_id", X.skeleton(F.col("text")).alias("skeleton"))
