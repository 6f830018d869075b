"""Queries of corpus shaping, text functions, readers and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanweave.functions import text as X
from spanweave.functions import values as V
from spanweave.functions.offsets import matches
from spanweave.operators import corpus as K
from spanweave.operators.cleaning import is_english
from spanweave.operators import routing as R
from spanweave.plans.registry import fixture, query, values
from spanweave.plans.span_queries import docs, found_sql
from spanweave.operators import detect as D
from spanweave.sources import readers as S
from spanweave.session import table

# -- deduplication, contamination, splits ------------------------------------------------------------------------


@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY md5(lower(text)) ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def dedup_md5_lower(spark, sf_dir):
    """First document of each text."""
    return K.deduplicated(docs(spark, sf_dir).select("doc_id", "lang", "text")).select("doc_id", "lang")


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source, md5(lower(text)) ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def dedup_within_source(spark, sf_dir):
    return K.deduplicated(docs(spark, sf_dir).select("doc_id", "source", "text"), within=["source"]).select("doc_id", "source")


@query("SELECT a.doc_id FROM documents a WHERE a.doc_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM documents b WHERE b.doc_id % 2 = 1 AND b.text = a.text)")
def contamination_antijoin(spark, sf_dir):
    """Documents of one half whose text does not occur in the other."""
    rows = docs(spark, sf_dir).select("doc_id", "text")
    return K.without_texts(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1")).select("doc_id")


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def contains_benchmark_passage(spark, sf_dir):
    """Extension: documents that contain a benchmark text as it stands."""
    return K.containing(docs(spark, sf_dir), table(spark, sf_dir, "benchmark"))


_MD5_10 = "(6 * list_sum(list_transform(range(1, 32), lambda i: strpos('0123456789abcdef', substr(md5({0}), i::INTEGER, 1)) - 1)) + strpos('0123456789abcdef', substr(md5({0}), 32, 1)) - 1) % 10"


@query(f"SELECT c_custkey, CASE WHEN {_MD5_10.format('c_name')} = 0 THEN 'stress' ELSE 'main' END AS split FROM customer")
def hash_split(spark, sf_dir):
    """A stable tenth of all keys by their md5."""
    return table(spark, sf_dir, "customer").select("c_custkey", K.stress_split(F.col("c_name")).alias("split"))


# -- budgets, quotas, samples ------------------------------------------------------------------------------------

_CAP, _BUDGET = 60_000, 900_000


@query(
    f"""WITH a AS (SELECT *, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS own FROM documents),
 b AS (SELECT *, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS al FROM a WHERE own < {_CAP}) SELECT doc_id, source, n_chars FROM b WHERE al < {_BUDGET}"""
)
def budget_caps(spark, sf_dir):
    """Documents that fit a cap for each source and a budget for all."""
    return K.budgeted(docs(spark, sf_dir).select("doc_id", "source", "n_chars"), "n_chars", "doc_id", "source", _CAP, _BUDGET)


@query(
    """WITH p AS (SELECT lang, n_chars + 1 AS n, sum(n_chars + 1) OVER (ORDER BY doc_id) - n_chars - 1 AS p0 FROM documents), t AS (SELECT (sum(n_chars + 1) // 510)::BIGINT AS whole FROM documents),
 r AS (SELECT lang, p0, p0 + n AS stop, unnest(range((p0 // 510)::BIGINT, ((p0 + n - 1) // 510)::BIGINT + 1)) AS seq_id FROM p)
SELECT seq_id, lang AS domain, sum(least(stop, (seq_id + 1) * 510) - greatest(p0, seq_id * 510))::BIGINT AS tokens FROM r, t WHERE seq_id < whole GROUP BY seq_id, lang"""
)
def pack_sequences(spark, sf_dir):
    """Documents end to end in sequences of 510, with the tokens of each language."""
    return K.packed(docs(spark, sf_dir).select("doc_id", "lang", "n_chars"), "n_chars", "doc_id", "lang", 510)


@query(
    """WITH a AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS turn FROM documents),
 b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY turn, source)::INTEGER AS rank FROM a) SELECT doc_id, lang, source, rank FROM b WHERE rank <= 50"""
)
def round_robin_quota(spark, sf_dir):
    """Fifty documents of each language, sources taking turns."""
    return K.round_robin(docs(spark, sf_dir).select("doc_id", "lang", "source"), "lang", "source", "doc_id", 50)


@query("SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INTEGER AS turn FROM documents")
def interleave_sources(spark, sf_dir):
    """Sources in turns: the round of each document."""
    return K.interleaved(docs(spark, sf_dir).select("doc_id", "source"), "source", "doc_id").drop("place")


_SEED = "md5('7|' || doc_id)"


@query(f"SELECT lang, source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY {_SEED}, doc_id) AS k FROM documents) WHERE k <= 3")
def stratified_cap(spark, sf_dir):
    """Three documents of each language and source in a seeded order."""
    return K.capped(docs(spark, sf_dir).select("lang", "source", "doc_id"), ["lang", "source"], [K.seeded("7", "doc_id"), "doc_id"], 3)


@query("SELECT lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents) WHERE k <= 10")
def top_per_language(spark, sf_dir):
    return K.capped(docs(spark, sf_dir).select("lang", "doc_id"), ["lang"], ["doc_id"], 10)


@query(f"SELECT doc_id FROM documents ORDER BY {_SEED}, doc_id LIMIT 100")
def seeded_sample(spark, sf_dir):
    """A hundred rows of a seeded shuffle."""
    return docs(spark, sf_dir).select("doc_id").orderBy(K.seeded("7", "doc_id"), "doc_id").limit(100)


@query(
    """WITH p AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY md5('p|' || s_suppkey), s_suppkey) AS rank, 'public' AS kind FROM supplier), f AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY md5('f|' || p_partkey), p_partkey) AS rank, 'frame' AS kind FROM part),
 s AS (SELECT unnest([0, 10, 25, 40]) AS share), n AS (SELECT share, (SELECT count(*) FROM p) AS total, (SELECT count(*) FROM p) * share // 100 AS n FROM s)
SELECT share, kind, id FROM n JOIN p ON rank <= total - n UNION ALL SELECT share, kind, id FROM n JOIN f ON rank <= n"""
)
def nested_pilot(spark, sf_dir):
    """Sets of one size in which frames replace 0, 10, 25 and 40 per cent; ranks follow 60 bits of the seeded md5."""

    def ranked(name: str, key: str, seed: str, kind: str):
        rows = table(spark, sf_dir, name).select(F.col(key).alias("id"))
        rows = rows.withColumn("k", F.conv(F.substring(K.seeded(seed, "id"), 1, 15), 16, 10).cast("long"))
        return K.prefix(rows, F.lit(1), "k", "rank").select("id", (F.col("rank") + 1).alias("rank"), F.lit(kind).alias("kind"))

    sets = K.nested_sets(ranked("supplier", "s_suppkey", "p", "public"), ranked("part", "p_partkey", "f", "frame"), [0, 10, 25, 40])
    return sets.select("share", "kind", "id")


@query(f"WITH spans AS ({found_sql(D.PATTERNS, 'doc_id, lang')}), l AS (SELECT DISTINCT lang FROM spans) SELECT lang, {', '.join(f'''(SELECT count(*) FROM spans s WHERE s.lang = l.lang AND s.label = '{k}') AS "{k}"''' for k in D.PATTERNS)} FROM l")
def coverage_matrix(spark, sf_dir):
    """Spans of each language and label, zeros included."""
    return K.coverage_matrix(D.rules(docs(spark, sf_dir), keep=("doc_id", "lang")), "lang", list(D.PATTERNS))


@query(f"WITH spans AS ({found_sql(D.PATTERNS, 'doc_id, lang')}), c AS (SELECT lang, label FROM (SELECT DISTINCT lang FROM spans), (SELECT unnest({list(D.PATTERNS)}) AS label)) SELECT c.lang, c.label, count(s.doc_id) AS n FROM c LEFT JOIN spans s USING (lang, label) GROUP BY ALL HAVING count(s.doc_id) < 3")
def coverage_gaps(spark, sf_dir):
    """Cells of the matrix below three."""
    return K.gaps(K.coverage_matrix(D.rules(docs(spark, sf_dir), keep=("doc_id", "lang")), "lang", list(D.PATTERNS)), "lang", list(D.PATTERNS), 3)


_FACTORS = ["l_returnflag", "l_linestatus", "l_linenumber"]


@query(
    "\nUNION ALL\n".join(
        f"SELECT '{a}*{b}' AS pair, count(*) AS cells, min(n) AS least, list_sort(list(n))[count(*) // 2 + 1] AS median FROM (SELECT count(*) AS n FROM lineitem GROUP BY {a}, {b})"
        for i, a in enumerate(_FACTORS) for b in _FACTORS[i + 1 :]
    )
)
def grid_coverage(spark, sf_dir):
    """Pairwise coverage of three factors."""
    return K.pair_coverage(table(spark, sf_dir, "lineitem").select(*_FACTORS), _FACTORS)


@query("SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn::VARCHAR, text)) AS text_md5 FROM conversations GROUP BY conv_id")
def chunk_reassembly(spark, sf_dir):
    """Turns of a conversation as one document, in the order of their number's text form."""
    return K.reassembled(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


_SPANS = {k: D.PATTERNS[k] for k in ("EMAIL", "ACCOUNT")}
_MIX = f"""s AS (SELECT d.doc_id, d.text, coalesce(list({{'s': x."start", 'e': x."end", 'label': x.label}} ORDER BY x."start") FILTER (x.label IS NOT NULL), []) AS spans FROM documents d LEFT JOIN ({found_sql(_SPANS)}) x USING (doc_id) GROUP BY ALL)"""


@query(
    f"""WITH {_MIX} SELECT a.doc_id // 2 AS pair, md5(a.text || chr(10) || chr(10) || b.text) AS text_md5, len(a.spans) + len(b.spans) AS n, coalesce(list_sum(list_transform(b.spans, lambda x: x.s + length(a.text) + 2)), 0)::BIGINT AS moved
FROM s a JOIN s b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 2 = 0"""
)
def span_doc_mix(spark, sf_dir):
    """Documents joined in pairs, the second's spans moved."""
    found = F.flatten(F.array(*(matches(F.col("text"), p, k) for k, p in _SPANS.items())))
    rows = docs(spark, sf_dir).select(F.floor(F.col("doc_id") / 2).alias("pair"), (F.col("doc_id") % 2).alias("odd"), "text", found.alias("spans"))
    rows = rows.withColumn("own", F.size("spans"))
    a, b = rows.where("odd = 0"), rows.where("odd = 1")
    both = K.mixed(a, b, "pair").join(a.select("pair", "own"), "pair")
    moved = F.aggregate(F.slice("spans", F.col("own") + 1, F.greatest(F.size("spans") - F.col("own"), F.lit(0))), F.lit(0).cast("long"), lambda t, x: t + x["start"])
    return both.select("pair", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.size("spans").cast("long").alias("n"), moved.alias("moved"))


_ADDR = [("us", "osm", 1, "1 Elm St|Rome"), ("us", "osm", 2, "1 ELM st|rome"), ("us", "osm", 3, "2 Oak Rd|Bonn"), ("us", "osm", 4, "3 Fir Ln|Oslo"), ("in", "osm", 5, "4 Ash|Pune"), ("in", "osm", 6, "5 Yew|Pune"), ("in", "osm", 7, "6 Box|Pune"), ("in", "india", 8, "4 ASH|Pune"), ("in", "india", 9, "7 Bay|Agra"), ("in", "india", 10, "6 box|pune"), ("in", "india", 11, "8 Fig|Agra")]
_ADMITTED = [("us", 1), ("us", 3), ("in", 5), ("in", 6), ("in", 9), ("in", 10)]


@query(f"SELECT country, pos FROM {values(_ADMITTED, 'country, pos')}")
def address_caps(spark, sf_dir):
    """Two-stage caps of addresses on a fixture with its expected rows."""
    rows = fixture(spark, _ADDR, "country string, source string, pos int, line string").withColumn("lines", F.split("line", r"\|"))
    return K.address_capped(rows.drop("line"), 2, 4).select("country", "pos")


@query("SELECT source, count(*) AS docs, sum(n_chars)::BIGINT AS chars, count(DISTINCT lang) AS langs, sum(n_chars) / sum(sum(n_chars)) OVER () AS share FROM documents GROUP BY source")
def corpus_stats(spark, sf_dir):
    """Documents, characters and share of each source."""
    rows = docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.count_distinct("lang").alias("langs"))
    total = rows.agg(F.sum("chars").alias("t"))
    return rows.withColumn("t", total.scalar()).select("source", "docs", "chars", "langs", (F.col("chars") / F.col("t")).alias("share"))


@query("SELECT lang, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM documents GROUP BY lang")
def value_pools(spark, sf_dir):
    """Distinct values of each group, sorted."""
    return docs(spark, sf_dir).groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


@query("SELECT kind, count(*) AS n FROM (SELECT 'doc' AS kind FROM documents UNION ALL SELECT 'item' FROM benchmark UNION ALL SELECT 'doc' FROM documents) GROUP BY kind")
def union_repeat(spark, sf_dir):
    """Tables together, one of them twice."""
    first = docs(spark, sf_dir).select(F.lit("doc").alias("kind"), F.explode(F.array_repeat(F.lit(1), 2)).alias("k")).drop("k")
    both = first.unionByName(table(spark, sf_dir, "benchmark").select(F.lit("item").alias("kind")))
    return both.groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT text FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT DISTINCT text FROM documents WHERE doc_id % 2 = 1")
def split_overlap(spark, sf_dir):
    """Texts in both halves: what a disjointness check must find."""
    rows = docs(spark, sf_dir)
    return rows.where("doc_id % 2 = 0").select("text").intersect(rows.where("doc_id % 2 = 1").select("text"))


_MAP = [("en", "src0", "PERSON"), ("en", "src1", "PLACE"), ("fr", "src0", "IGNORE")]


@query(f"SELECT coalesce(target, 'O') AS target, count(*) AS n FROM documents LEFT JOIN {values(_MAP, 'lang, source, target')} USING (lang, source) GROUP BY 1")
def label_map_join(spark, sf_dir):
    """Raw labels to targets by a small dimension; unlisted ones are outside."""
    dim = F.broadcast(fixture(spark, _MAP, "lang string, source string, target string"))
    return docs(spark, sf_dir).join(dim, ["lang", "source"], "left").groupBy(F.coalesce("target", F.lit("O")).alias("target")).agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE source = 'src3' OR lower(trim(lang)) = 'en' OR lower(trim(lang)) LIKE 'english%'")
def language_filter(spark, sf_dir):
    return docs(spark, sf_dir).where(is_english(F.col("lang"), F.col("source"), ("src3",))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE length(text) >= 200 AND regexp_matches(text, '[^ \\t\\r\\n]')")
def text_length_filter(spark, sf_dir):
    return docs(spark, sf_dir).where((F.length("text") >= 200) & F.col("text").rlike(r"[^ \t\r\n]")).select("doc_id")


@query(
    """WITH l AS (SELECT doc_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS a, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS n FROM documents) SELECT doc_id FROM l WHERE n > 0 AND a > 0.95 * n"""
)
def latin_filter(spark, sf_dir):
    return docs(spark, sf_dir).where(X.is_latin(F.col("text"))).select("doc_id")


# -- text functions ----------------------------------------------------------------------------------------------

_BLOCKS = """blocks AS (SELECT source, string_agg(text, CASE doc_id % 4 WHEN 0 THEN chr(10) || chr(10) WHEN 1 THEN chr(10) || ' ' || chr(10) || chr(10) || chr(10) WHEN 2 THEN '  ' || chr(160) || chr(9) ELSE chr(13) END ORDER BY doc_id) AS text FROM documents GROUP BY source)"""


def _mixed(spark, sf_dir):
    """Documents whose line breaks and commas became separators of several kinds."""
    k = F.col("doc_id") % 4
    sep = F.when(k == 0, "\n\n").when(k == 1, "\n \n\n\n").when(k == 2, "  \u00a0\t").otherwise("\r")
    return docs(spark, sf_dir).select("doc_id", F.replace(F.replace(F.col("text"), F.lit("\n"), sep), F.lit(", "), sep).alias("text"))


_MIXED = """mixed AS (SELECT doc_id, replace(replace(text, chr(10), sep), ', ', sep) AS text FROM (SELECT doc_id, text,
 CASE doc_id % 4 WHEN 0 THEN chr(10) || chr(10) WHEN 1 THEN chr(10) || ' ' || chr(10) || chr(10) || chr(10) WHEN 2 THEN '  ' || chr(160) || chr(9) ELSE chr(13) END AS sep FROM documents))"""
_NORM = r"""regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13), chr(10)), '[ \t' || chr(160) || ']+', ' ', 'g'), '\n\s*\n\s*\n+', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"""


@query(f"WITH {_MIXED} SELECT doc_id, md5(t) AS text_md5, length(t) AS n FROM (SELECT doc_id, {_NORM} AS t FROM mixed)")
def norm_ws(spark, sf_dir):
    """White space normalised in every document."""
    rows = _mixed(spark, sf_dir).select("doc_id", X.norm_ws(F.col("text")).alias("t"))
    return rows.select("doc_id", F.md5(F.col("t").cast("binary")).alias("text_md5"), F.length("t").cast("long").alias("n"))


@query(
    f"""WITH {_MIXED}, n AS (SELECT doc_id, {_NORM} AS text FROM mixed), p AS (SELECT doc_id, text, string_split(text, chr(10) || chr(10)) AS l FROM n),
 f AS (SELECT doc_id, text, list_reduce(list_prepend({{'done': CAST([] AS VARCHAR[]), 'open': CAST([] AS VARCHAR[]), 'size': 0::BIGINT, 'w': ''}}, list_transform(l, lambda w: {{'done': CAST([] AS VARCHAR[]), 'open': CAST([] AS VARCHAR[]), 'size': 0::BIGINT, 'w': w}})), lambda a, x:
   CASE WHEN a.size + length(x.w) > 2000 AND len(a.open) > 0 THEN {{'done': list_append(a.done, array_to_string(a.open, chr(10) || chr(10))), 'open': [substr(x.w, 1, 2000)], 'size': length(x.w) + 2, 'w': ''}}
        ELSE {{'done': a.done, 'open': list_append(a.open, substr(x.w, 1, 2000)), 'size': a.size + length(x.w) + 2, 'w': ''}} END) AS a FROM p)
SELECT doc_id, i, md5(parts[i + 1]) AS part_md5 FROM (SELECT doc_id, parts, unnest(range(0, len(parts)))::INTEGER AS i FROM (SELECT doc_id, CASE WHEN length(text) <= 2000 THEN [text] ELSE list_append(a.done, array_to_string(a.open, chr(10) || chr(10))) END AS parts FROM f))"""
)
def split_long_chunks(spark, sf_dir):
    """Texts beyond 2,000 characters in greedy parts of whole paragraphs."""
    rows = _mixed(spark, sf_dir).select("doc_id", F.posexplode(X.split_long(X.norm_ws(F.col("text")), 2000)).alias("i", "part"))
    return rows.select("doc_id", "i", F.md5(F.col("part").cast("binary")).alias("part_md5"))


SCRIPTS = [(1, "これは日本語です"), (2, "한국어 문장입니다"), (3, "यह हिन्दी है"), (4, "هذا نص عربي"), (5, "นี่คือภาษาไทย"), (6, "这是中文"), (7, "plain English"), (8, "1234 5678"), (9, "Привет мир"), (10, "the 張 one"), (11, "カ and many more latin letters than kana in this line of text"), (12, None)]
_WANT = [(1, "ja"), (2, "ko"), (3, "hi"), (4, "ar"), (5, "th"), (6, "zh"), (7, "latin"), (8, None), (9, "latin"), (10, "latin"), (11, "latin"), (12, None)]


@query(f"SELECT id, lang FROM {values(_WANT, 'id, lang')}")
def script_route(spark, sf_dir):
    """Languages that scripts stand for, against expected rows."""
    rows = fixture(spark, SCRIPTS, "id int, text string")
    return rows.select("id", X.script_lang(X.script_counts(F.col("text"))).alias("lang"))


@query("SELECT doc_id, length(regexp_replace(text, '[^\\p{L}]', '', 'g'))::INTEGER AS letters, length(regexp_replace(text, '[^\\p{Latin}]', '', 'g'))::INTEGER AS latin FROM documents")
def script_histogram(spark, sf_dir):
    """Letters and Latin letters of every document."""
    return docs(spark, sf_dir).select("doc_id", X.script_counts(F.col("text")).alias("c")).select("doc_id", "c.letters", "c.latin")


_CONV = """c AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id)"""


@query(f"""WITH {_CONV}, s AS (SELECT conv_id, string_split(regexp_replace(text, '(\\n\\s*\\n)', '\\1' || chr(1), 'g'), chr(1)) AS l FROM c) SELECT conv_id, len(l) AS blocks, length(l[1]) AS first, length(l[-1]) AS last FROM s""")
def segment_blocks(spark, sf_dir):
    """Blocks of conversations at blank lines."""
    turns = table(spark, sf_dir, "conversations")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), "\n\n")
    rows = turns.groupBy("conv_id").agg(X.segments(text).alias("l"))
    return rows.select("conv_id", F.size("l").cast("long").alias("blocks"), F.length(F.element_at("l", 1)).cast("long").alias("first"), F.length(F.element_at("l", -1)).cast("long").alias("last"))


ROUTES = [(1, "Dear Mr Tan,\nplease see below.\n\n张伟的账户已更新。\n\n12345\n\nRegards"), (2, "123\n\nHello there"), (3, "これは\n\nです\n\nend"), (4, "42")]
_ROUTED = [(1, 0, 32, "en"), (1, 32, 50, "zh"), (1, 50, 57, "en"), (2, 0, 5, "en"), (2, 5, 16, "en"), (3, 0, 9, "ja"), (3, 9, 12, "en"), (4, 0, 2, "en")]


@query(f"""SELECT doc_id, s AS "start", e AS "end", lang FROM {values(_ROUTED, 'doc_id, s, e, lang')}""")
def segments_route(spark, sf_dir):
    """Blocks routed by script and joined, against expected rows."""
    return R.routed_segments(fixture(spark, ROUTES, "doc_id int, text string"))


@query("SELECT doc_id, md5(replace(replace(replace(text, chr(10), ' ¶ '), chr(9), ' | '), chr(13), ' ')) AS text_md5 FROM documents")
def visible_breaks(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(X.visible_breaks(F.col("text")).cast("binary")).alias("text_md5"))


MAILS = [(1, "Hi John,\nPlease see the attached statement.\nThanks\n-----Original Message-----\nFrom: Jane\nOld text"), (2, "Date: today\nTo: me\nbody\n> quoted\nmore"), (3, "plain"), (4, "a\n--- Forwarded by X ---\nb"), (5, "X-Mailer: q\nX: stays")]
_CLEAN = [(1, "Hi John,\nPlease see the attached statement.\nThanks\n"), (2, "\n\nbody\n"), (3, "plain"), (4, "a\n"), (5, "\nX: stays")]


@query(f"SELECT id, body FROM {values(_CLEAN, 'id, body')}")
def clean_email(spark, sf_dir):
    """Mail bodies without quotes and headers, against expected texts."""
    return fixture(spark, MAILS, "id int, body string").select("id", X.clean_email(F.col("body")).alias("body"))


DATES = ["1987-05-22", "1987-05-22T00:00:00", "05/22/1987", "22/05/1987", "22.05.1987", "May 22, 1987", "May 22nd, 1987", "22nd May 1987", "22 May 1987", "22-May-1987", "1987/05/22", "[Redacted]", "MM/DD/YYYY", "2023", "Q1 2023", "31/02/1990", "Foo 3, 1999", "29.02.2023", "Sept 9 2001"]
_PARSED = [(v, "1987-05-22" if i < 11 else "2001-09-09" if v.startswith("Sept") else None) for i, v in enumerate(DATES)]


@query(f"SELECT v, d FROM {values(_PARSED, 'v, d')}")
def parse_date_shapes(spark, sf_dir):
    """Dates of all shapes, and values that are none."""
    return fixture(spark, [(v,) for v in DATES], "v string").select("v", V.parse_date(F.col("v")).cast("string").alias("d"))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 2 THEN strftime(o_orderdate, '%-d/%-m/%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS shown FROM orders"""
)
def render_dates(spark, sf_dir):
    """Dates written in one of four formats by key."""
    rows = table(spark, sf_dir, "orders")
    return rows.select("o_orderkey", V.rendered_date(F.col("o_orderdate"), F.col("o_orderkey") % 4).alias("shown"))


_NUMBERS = [(n, "".join(reversed(",".join([str(n)[::-1][:3], *[str(n)[::-1][3:][i : i + 2] for i in range(0, len(str(n)[3:]), 2)]]))) if len(str(n)) > 3 else str(n)) for n in (0, 7, 999, 1000, 12345, 100000, 1234567, 9876543210)]


@query(f"SELECT CAST(n AS BIGINT) AS n, g FROM {values(_NUMBERS, 'n, g')}")
def indian_grouping(spark, sf_dir):
    return fixture(spark, [(n,) for n, _ in _NUMBERS], "n bigint").select("n", X.indian_grouping(F.col("n")).alias("g"))


@query("SELECT c_custkey, translate(c_custkey::VARCHAR, '0123456789', '०१२३४५६७८९') AS shown FROM customer")
def native_digits(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", X.native_digits(F.col("c_custkey").cast("string"), "०१२३४५६७८९").alias("shown"))


_TOKENS = [
    (1, "Sinabi|ni|Juan|Dela|Cruz|.", "O|O|B-PER|I-PER|I-PER|O"), (2, "(|see|p.|4|)|,|ok|?", "O|O|O|O|O|O|B-X|O"), (3, "one", "I-X"), (4, "「|東京|」|、|大阪|。", "O|B-LOC|O|O|B-LOC|O"),
    (5, "a||b| |c|d", "B-X|O|I-X|I-X|I-X|B-X"), (6, "（|x|）", "O|O|O"), (7, "«|x|»", "O|B-Y|I-Z"),
]
_SAID = [
    (1, "Sinabi ni Juan Dela Cruz.", "10-24:PER"), (2, "(see p. 4), ok?", "12-14:X"), (3, "one", "0-3:X"), (4, "「東京」、 大阪。", "1-3:LOC,6-8:LOC"), (5, "a b   c d", "0-7:X,8-9:X"), (6, "（x）", ""), (7, "« x »", "2-3:Y,4-5:Z"),
]


@query(f"SELECT id, text, spans FROM {values(_SAID, 'id, text, spans')}")
def detokenize(spark, sf_dir):
    """Tagged tokens as text with spans; the other side states the expected rows."""
    rows = fixture(spark, _TOKENS, "id int, toks string, tags string")
    rows = rows.select("id", X.detokenized(F.split("toks", r"\|"), F.split("tags", r"\|")).alias("d"))
    said = F.transform("d.spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"), F.lit(":"), s["label"]))
    return rows.select("id", "d.text", F.array_join(said, ",").alias("spans"))


_TEMPLATES = [(1, "Dear {PERSON:k1},  your  A/C {ACCOUNT} of 12 May\n2024", "dear {person}, your a/c {account} of # may #"), (2, "{A} {A:2}", "{a} {a}")]


@query(f"SELECT id, s FROM {values([(i, w) for i, _, w in _TEMPLATES], 'id, s')}")
def template_skeleton(spark, sf_dir):
    return fixture(spark, _TEMPLATES, "id int, t string, want string").select("id", X.skeleton(F.col("t")).alias("s"))


_PARTS = [(1, "12 Main St,|Rome|rome||IT", "12 Main St, Rome, IT"), (2, "a|A|b", "a, b"), (3, "", "")]


@query(f"SELECT id, a FROM {values([(i, w) for i, _, w in _PARTS], 'id, a')}")
def clean_address(spark, sf_dir):
    """Address parts without repeats, joined without double commas."""
    rows = fixture(spark, _PARTS, "id int, p string, want string")
    return rows.select("id", X.joined_address(X.cleaned_parts(F.split("p", r"\|")), ", ").alias("a"))


_JSON = [(1, '[{"start": 0, "end": 4, "label": "A"}]', 1), (2, "[{'start': 1, 'end': 2, 'label': 'B'}, {'start': 3, 'end': 9, 'label': 'C'}]", 2), (3, "", 0), (4, None, 0)]


@query(f"SELECT id, n FROM {values([(i, n) for i, _, n in _JSON], 'id, n')}")
def parse_spans(spark, sf_dir):
    """Span columns given as JSON, with either quote, empty or null."""
    return fixture(spark, _JSON, "id int, raw string, want int").select("id", F.size(X.parsed_spans(F.col("raw"))).alias("n"))


_CLASSES = [(1, "张伟", "nonlatin"), (2, "Nguyễn Văn An", "latin"), (3, "١٥/٠٨/١٩٨٥", "nonlatin"), (4, "+91 98765 43210", "latin")]


@query(f"SELECT id, c FROM {values([(i, c) for i, _, c in _CLASSES], 'id, c')}")
def script_class(spark, sf_dir):
    return fixture(spark, _CLASSES, "id int, t string, want string").select("id", X.script_class(F.col("t")).alias("c"))


_CARDS = ["####-####-####-####", "AA##XXXX", "[456]###############"]


@query(
    f"""WITH e AS (SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN '{V.pattern_regex(_CARDS[0])}' WHEN 1 THEN '{V.pattern_regex(_CARDS[1])}' ELSE '{V.pattern_regex(_CARDS[2])}' END AS rx FROM customer) SELECT k, rx, true AS ok FROM e"""
)
def account_patterns(spark, sf_dir):
    """Values drawn from account patterns, each matching its compiled expression."""
    k = F.col("c_custkey")
    seed = k.cast("string")
    value = F.when(k % 3 == 0, V.rendered_pattern(_CARDS[0], seed)).when(k % 3 == 1, V.rendered_pattern(_CARDS[1], seed)).otherwise(V.rendered_pattern(_CARDS[2], seed))
    rx = F.when(k % 3 == 0, V.pattern_regex(_CARDS[0])).when(k % 3 == 1, V.pattern_regex(_CARDS[1])).otherwise(V.pattern_regex(_CARDS[2]))
    rows = table(spark, sf_dir, "customer").select(k.alias("k"), value.alias("v"), rx.alias("rx"))
    return rows.select("k", "rx", F.expr("v rlike rx").alias("ok"))


_U = """('0x' || substr(md5(c_custkey::VARCHAR), 1, 4))::INTEGER / 65536.0"""


@query(f"SELECT CASE WHEN u < 1.0 / 1.8 THEN 'verified' WHEN u < 1.4 / 1.8 THEN 'partial' ELSE 'rest' END AS pick, count(*) AS n FROM (SELECT round({_U}, 4) AS u FROM customer) GROUP BY 1")
def weighted_choice(spark, sf_dir):
    """A weighted choice from a key's hash."""
    u = D.stable_score(F.col("c_custkey"))
    rows = table(spark, sf_dir, "customer").select(V.weighted_choice(["verified", "partial", "rest"], [1.0, 0.4, 0.4], u).alias("pick"))
    return rows.groupBy("pick").agg(F.count("*").alias("n"))


# -- readers -----------------------------------------------------------------------------------------------------

_CONLL = [(1, 0, "Ana\tB-PER"), (1, 1, "Li\tI-PER"), (1, 2, ""), (1, 3, "ok\tO"), (2, 0, "no\tO"), (2, 1, ""), (2, 2, ""), (2, 3, "x\tO"), (2, 4, "y\tB-LOC")]
_SENTENCES = [(1, 0, "Ana Li", "B-PER I-PER"), (1, 1, "ok", "O"), (2, 0, "no", "O"), (2, 2, "x y", "O B-LOC")]


@query(f"SELECT file, CAST(sentence AS BIGINT) AS sentence, toks, tags FROM {values(_SENTENCES, 'file, sentence, toks, tags')}")
def conll_reader(spark, sf_dir):
    """Token-tagged lines as sentences."""
    rows = S.tagged_sentences(fixture(spark, _CONLL, "file int, no int, line string"), "file")
    return rows.select("file", "sentence", F.array_join("tokens", " ").alias("toks"), F.array_join("tags", " ").alias("tags"))


_WORDS = [(1, i, t, "O") for i, t in enumerate("Hi . we came home . Then left".split())]
_CUT = [(1, 0, "Hi . we came home ."), (1, 1, "Then left")]


@query(f"SELECT file, sentence, toks FROM {values(_CUT, 'file, sentence, toks')}")
def word_reader(spark, sf_dir):
    """One word a row, cut at final punctuation after enough words."""
    rows = S.word_rows(fixture(spark, _WORDS, "file int, no int, tok string, tag string"), "file")
    return rows.select("file", "sentence", F.array_join("tokens", " ").alias("toks"))


_FRAMES = ["#lang: en", "#cs: mixed", "# a comment", "## register: email", "Dear {PERSON},\\nhello", "", "## slice: hard", "Pay {ACCOUNT}", "#lang: ms", "Akaun {ACCOUNT}"]
_READ = [(4, "en", "mixed", "email", None, "Dear {PERSON},\nhello"), (7, "en", "mixed", "email", "hard", "Pay {ACCOUNT}"), (9, "ms", "mixed", "email", "hard", "Akaun {ACCOUNT}")]


@query(f"SELECT no, lang, cs, register, slice, template FROM {values(_READ, 'no, lang, cs, register, slice, template')}")
def frame_reader(spark, sf_dir):
    """Frame lines with directives carried forward."""
    rows = fixture(spark, [(1, i, t) for i, t in enumerate(_FRAMES)], "path int, no int, line string")
    return S.frames(rows).drop("path")


@query("SELECT c_custkey, section, substr(text, 1, 12) AS text FROM (SELECT c_custkey, unnest(['c_name', 'c_mktsegment']) AS section, unnest([c_name, c_mktsegment]) AS text FROM customer)")
def section_scan(spark, sf_dir):
    """Wide text columns as long rows, cut to a length."""
    return S.sections(table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"], ["c_custkey"], 12)


@query(f"SELECT doc_id FROM (SELECT doc_id, substr({_NORM.replace('text', 'substr(text, 1, 5000)')}, 1, 1500) AS h FROM documents) WHERE regexp_matches(h, '[0-9]{{3}}')")
def header_filter(spark, sf_dir):
    """Documents whose normalised beginning has a three-digit number."""
    return S.headed(docs(spark, sf_dir), "[0-9]{3}").select("doc_id")


@query("SELECT doc_id FROM documents WHERE regexp_matches(string_split(text, chr(10))[1], '(?i)the|und')")
def title_filter(spark, sf_dir):
    return S.titled(docs(spark, sf_dir), ["the", "und"]).select("doc_id")


@query("SELECT event_id, user_id, CAST(props ->> '$.k' AS INTEGER) AS k FROM events WHERE CAST(props ->> '$.k' AS INTEGER) > 50")
def json_props(spark, sf_dir):
    """A typed field of a JSON column."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.from_json("props", "k int").alias("p"))
    return rows.select("event_id", "user_id", "p.k").where("k > 50")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 500")
def prefix_reader(spark, sf_dir):
    """The first rows of a split by an order column."""
    return S.prefix(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey"), "o_orderkey", 500)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_counts(spark, sf_dir):
    """Extension: tumbling counts, the batch form of the streaming query."""
    from spanweave.streaming.scan import counts

    return counts(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


_GRAMS = """w AS (SELECT doc_id, ' ' || unnest(regexp_extract_all(lower(text), '[^ \t\n\x0B\f\r]+')) || ' ' AS w FROM documents),
 n AS (SELECT doc_id, w, unnest(range(1, least(4, length(w)) + 1)) AS n FROM w), g AS (SELECT doc_id, substr(w, i, n) AS gram FROM (SELECT *, unnest(range(1, length(w) - n + 2)) AS i FROM n)),
 c AS (SELECT doc_id, gram, count(*) AS n FROM g GROUP BY ALL)"""


@query(f"WITH {_GRAMS} SELECT gram, count(*) AS df, sum(n)::BIGINT AS total FROM c GROUP BY gram HAVING count(*) >= 3 ORDER BY total DESC, gram LIMIT 300000")
def gram_vocabulary(spark, sf_dir):
    """Character n-grams of all texts with their document frequencies: those in three documents or more, the most frequent."""
    return R.vocabulary(R.gram_sums(docs(spark, sf_dir)))


@query(
    f"""WITH {_GRAMS}, v AS (SELECT gram, count(*) AS df FROM c GROUP BY gram HAVING count(*) >= 3), t AS (SELECT count(*) AS docs FROM documents WHERE text IS NOT NULL),
 x AS (SELECT doc_id, (1 + ln(n)) * (ln((1.0 + docs) / (1.0 + df)) + 1) AS w FROM c JOIN v USING (gram), t), y AS (SELECT doc_id, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM x)
SELECT doc_id, count(*) AS grams, round(sum(w), 6) AS total, round(max(w), 6) AS most FROM y GROUP BY doc_id"""
)
def gram_weights(spark, sf_dir):
    """Sublinear, inverse-frequency weights of every document's grams, of unit length."""
    return R.weight_sums(docs(spark, sf_dir)).select("doc_id", "grams", F.round("total", 6).alias("total"), F.round("most", 6).alias("most"))


@query(
    """WITH s AS (SELECT lang, CASE ('0x' || substr(md5('route|' || doc_id), 1, 4))::INTEGER % 5 WHEN 0 THEN 'fr' WHEN 1 THEN 'de' ELSE lang END AS routed FROM documents),
 c AS (SELECT lang, routed, count(*) AS n FROM s GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, routed) AS k FROM c WHERE lang <> routed)
SELECT lang, sum(n)::BIGINT AS n, sum(CASE WHEN lang = routed THEN n ELSE 0 END) / sum(n) AS accuracy, (SELECT string_agg(routed || ':' || n, ',' ORDER BY k) FROM k WHERE k.lang = c.lang AND k <= 3) AS confused FROM c GROUP BY lang"""
)
def saved_route_accuracy(spark, sf_dir):
    """Accuracy and confusions of saved routes (by the md5 of the id) in every language."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("route|"), F.col("doc_id").cast("string")).cast("binary")), 1, 4), 16, 10).cast("int") % 5
    rows = docs(spark, sf_dir).select("lang", F.when(draw == 0, "fr").when(draw == 1, "de").otherwise(F.col("lang")).alias("routed"))
    return R.accuracy(rows).withColumn("confused", F.array_join("confused", ","))


@query(None)
def router_accuracy(spark, sf_dir):
    """A character n-gram classifier trained on four folds by key and scored on the fifth."""
    rows = docs(spark, sf_dir).select("doc_id", "lang", "text")
    model = R.train_router(rows.where("doc_id % 5 <> 0"))
    return R.accuracy(R.route(rows.where("doc_id % 5 = 0"), model))
