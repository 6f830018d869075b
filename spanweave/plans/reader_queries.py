"""Queries of the readers: tagged arrays, renamed spans, regulation texts, addresses, defaults."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanweave.functions import native as N
from spanweave.functions.offsets import matches, part
from spanweave.operators import corpus as K
from spanweave.operators import detect as D
from spanweave.plans.registry import fixture, query, values
from spanweave.plans.span_queries import docs, found_sql
from spanweave.session import table
from spanweave.sources import readers as R


@query(
    """WITH t AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+|[.,]') AS toks FROM documents), s AS (SELECT doc_id, toks, array_to_string(list_transform(range(1, len(toks) + 1), lambda i: CASE WHEN i = 1 OR toks[i] IN ('.', ',') THEN toks[i] ELSE ' ' || toks[i] END), '') AS text,
 list_filter(toks, lambda t: regexp_matches(t, '^[A-Z]')) AS caps FROM t WHERE len(toks) > 0)
SELECT 'docs-' || doc_id AS id, 'docs' AS source, 'xx' AS lang, md5(text) AS text_md5, len(caps)::INTEGER AS n, md5(array_to_string(caps, '|')) AS spans_md5 FROM s"""
)
def tagged_array_reader(spark, sf_dir):
    """Token and tag arrays of every document as text with spans; the spans' texts are read back by their offsets."""
    toks = F.regexp_extract_all("text", F.lit("[A-Za-z]+|[.,]"), F.lit(0))
    rows = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), toks.alias("tokens"))
    rows = rows.withColumn("tags", F.transform("tokens", lambda t: F.when(t.rlike("^[A-Z]"), 1).otherwise(0)))
    found = R.tagged_arrays(rows, "docs", "xx", names=["O", "B-CAP"])
    said = F.transform("spans", lambda s: part(F.col("text"), s["start"], s["end"]))
    return found.select("id", "source", "lang", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.size("spans").alias("n"), F.md5(F.array_join(said, "|").cast("binary")).alias("spans_md5"))


@query(f"SELECT 'mail-' || doc_id AS id, 'mail' AS source, 'xx' AS lang, \"start\", \"end\", label FROM ({found_sql({'EMAIL': D.PATTERNS['EMAIL'], 'IP': D.PATTERNS['IP']})})")
def renamed_span_reader(spark, sf_dir):
    """Spans whose fields a source names otherwise."""
    found = F.flatten(F.array(*(matches(F.col("text"), D.PATTERNS[k], k) for k in ("EMAIL", "IP"))))
    rows = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", F.transform(found, lambda s: F.struct(F.array(s["start"], s["end"]).alias("span"), s["label"].alias("type"))).alias("entities"))
    made = R.span_rows(rows, "mail", "xx", "entities", "span[0]", "span[1]", "type")
    return made.select("id", "source", "lang", F.explode("spans").alias("s")).select("id", "source", "lang", "s.start", "s.end", "s.label")


@query("SELECT l_partkey, l_linenumber, l_linenumber || ' ' || arg_max(l_orderkey || l_returnflag, l_orderkey * 10 + l_suppkey % 10) AS text FROM lineitem GROUP BY l_partkey, l_linenumber")
def last_passages(spark, sf_dir):
    """Each passage of a document once, as last given."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber", F.concat(F.col("l_orderkey").cast("string"), "l_returnflag").alias("said"), (F.col("l_orderkey") * 10 + F.col("l_suppkey") % 10).alias("at"))
    return R.passages(rows, "l_partkey", "l_linenumber", "said", "at")


@query("SELECT conv_id, 'Talk ' || conv_id || chr(10) || string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id")
def grouped_articles(spark, sf_dir):
    """Texts of a group in order below a headline."""
    return R.grouped_texts(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", head=F.concat(F.lit("Talk "), F.col("conv_id").cast("string")))


@query("SELECT trim(o_orderpriority) || chr(10) || trim(o_orderstatus) AS text, count(*) AS n FROM orders GROUP BY 1")
def question_answers(spark, sf_dir):
    """Questions and answers on two lines, counted."""
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit(" \t"), "o_orderpriority").alias("input"), F.concat("o_orderstatus", F.lit("\n ")).alias("output"))
    return R.answers(rows).groupBy("text").agg(F.count("*").alias("n"))


@query("SELECT p_name AS text FROM part UNION SELECT p_brand FROM part")
def unique_passages(spark, sf_dir):
    """Every different text of two columns."""
    return R.unique_texts(table(spark, sf_dir, "part"), ["p_name", "p_brand"])


@query("SELECT c_custkey, CASE WHEN ('0x' || substr(md5('s|' || c_custkey), 1, 8))::BIGINT % 10 < 1 THEN 'validation' ELSE 'train' END AS split FROM customer")
def seeded_split(spark, sf_dir):
    """A tenth of all keys held out by a seeded hash."""
    return R.held_out_split(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", "s")


@query(
    """WITH a AS (SELECT ['us', 'my', 'fr'][(o_orderkey % 3 + 1)::INTEGER] AS country, o_orderkey AS pos, o_custkey AS c FROM orders WHERE o_orderkey % 3 < 2 AND o_orderkey % 5 <> 0), k AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY pos) AS k FROM a)
SELECT country, 'osm' AS source, pos, c || ' Main St|' || CASE WHEN country = 'my' THEN '57700 Town' ELSE 'Town 57700' END AS lines FROM k WHERE k <= 40"""
)
def country_addresses(spark, sf_dir):
    """Street-level Latin addresses of two countries, forty each; other countries, place queries and other scripts go."""
    o = table(spark, sf_dir, "orders")
    country = F.element_at(F.array(*map(F.lit, ["us", "my", "fr"])), (F.col("o_orderkey") % 3 + 1).cast("int"))
    city = F.when(F.col("o_orderkey") % 10 == 0, "北京市朝阳区很长的名字").otherwise("Town")
    tags = F.when(F.col("o_orderkey") % 10 == 5, F.array(*map(F.lit, [2, 5, 5, 14, 11]))).otherwise(F.array(*map(F.lit, [4, 5, 5, 14, 11])))
    rows = o.select(country.alias("country"), F.col("o_orderkey").alias("pos"), F.array(F.col("o_custkey").cast("string"), F.lit("Main"), F.lit("St"), city, F.lit("57700")).alias("tokens"), tags.alias("tags"))
    return R.country_addresses(rows, ["us", "my"], 40, "osm").withColumn("lines", F.array_join("lines", "|"))


_INDIA = [
    ("12 MG Road, Pune , pune, Maharashtra 411001", "12 MG Road|Pune|Maharashtra 411001"), ("A, B, 411001, [REDACTED], -1, Unclassified", "A|B|411001"), ("A, 411001", None), ("A, B, C", None),
    ("a,b,c,d,e,f,g,h,411001", None), ("महाराष्ट्र, पुणे, 411001", None),
]


@query(f"SELECT raw, parts FROM {values(_INDIA, 'raw, parts')}")
def indian_addresses(spark, sf_dir):
    """Indian addresses as written, in parts; the other side states the expected ones."""
    rows = fixture(spark, [r[:1] for r in _INDIA], "raw string")
    return rows.select("raw", F.array_join(N.indian_parts(F.col("raw")), "|").alias("parts"))


_MARKETS = [("en", "XNAS", "USD"), ("de", "XETR", None)]


@query(f"SELECT doc_id, coalesce(market, 'XLON') AS market, coalesce(currency, 'GBP') AS currency FROM documents LEFT JOIN {values(_MARKETS, 'lang, market, currency')} USING (lang)")
def market_defaults(spark, sf_dir):
    """Entries of a small table by language, with defaults."""
    rows = docs(spark, sf_dir).select("doc_id", "lang")
    return K.with_defaults(rows, fixture(spark, _MARKETS, "lang string, market string, currency string"), "lang", {"market": "XLON", "currency": "GBP"}).drop("lang")
