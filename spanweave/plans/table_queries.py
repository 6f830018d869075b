"""Span rules over whole tables that were shown on a few rows before, each against SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanweave.functions import text as X
from spanweave.functions import values as V
from spanweave.functions.offsets import bound, matches
from spanweave.operators import detect as D
from spanweave.operators import leaderboard as B
from spanweave.operators import spans as S
from spanweave.plans.registry import query
from spanweave.plans.span_queries import TOKENS_SQL, docs, found_sql
from spanweave.session import shared_path, table
from spanweave.sources import readers as R


_TAG = "CASE WHEN h[1] IN ('8', '9') THEN 'B-X' WHEN h[1] IN ('a', 'b') THEN 'I-X' WHEN h[1] = 'c' THEN 'B-Y' WHEN h[1] = 'd' THEN 'I-Y' WHEN h[1] > '3' AND h[1] < '8' THEN 'O' END"


@query(
    f"""WITH {TOKENS_SQL}, m AS (SELECT doc_id, i, md5(doc_id || '|' || i) AS h FROM toks), t AS (SELECT doc_id, i, i = 0 OR h[2] < '5' AS first, {_TAG} AS tag FROM m),
 w AS (SELECT *, sum(CASE WHEN first THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS word FROM t),
 x AS (SELECT *, (SELECT min(i) FROM w v WHERE v.doc_id = w.doc_id AND v.word = w.word AND v.tag IS NOT NULL) AS head_at FROM w), y AS (SELECT x.*, h.tag AS head FROM x LEFT JOIN w h ON h.doc_id = x.doc_id AND h.i = x.head_at)
SELECT doc_id, count(filled) AS tagged, count(*) FILTER (filled LIKE 'I-%') AS inside, md5(string_agg(coalesce(filled, '-'), '|' ORDER BY i)) AS said
FROM (SELECT doc_id, i, CASE WHEN head_at IS NULL OR i < head_at THEN NULL WHEN i = head_at THEN tag WHEN head = 'O' THEN 'O' ELSE 'I-' || substr(head, 3) END AS filled FROM y) GROUP BY doc_id"""
)
def filled_words(spark, sf_dir):
    """Tokens of every text in words drawn by md5: what goes on with a word takes its head's tag."""

    def drawn(h, i):
        head = F.substring(h, 1, 1)
        tag = F.when(head.isin("8", "9"), "B-X").when(head.isin("a", "b"), "I-X").when(head == "c", "B-Y").when(head == "d", "I-Y").when((head > "3") & (head < "8"), "O")
        return F.struct(((i == 0) | (F.substring(h, 2, 1) < "5")).alias("first"), tag.alias("tag"))

    # A filter on the tokens would find them twice.
    toks = F.regexp_extract_all("text", F.lit(S.TOKEN), F.lit(0))
    items = F.transform(toks, lambda t, i: bound(F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), i.cast("string")).cast("binary")), lambda h: drawn(h, i)))
    rows = docs(spark, sf_dir).where(F.col("text").rlike(S.TOKEN)).select("doc_id", S.continued_tags(items).alias("filled"))
    number = lambda test: F.size(F.filter("filled", test)).cast("long")
    said = F.array_join(F.transform("filled", lambda t: F.coalesce(t, F.lit("-"))), "|")
    return rows.select("doc_id", number(lambda t: t.isNotNull()).alias("tagged"), number(lambda t: t.startswith("I-")).alias("inside"), F.md5(said.cast("binary")).alias("said"))


#: Runs of letters, runs of digits, and other marks: tokens with and without gaps.
_PIECES = r"[A-Za-zßüöäéèêñóíçÉÀ]{1,3}|[0-9]{1,2}|[^A-Za-zßüöäéèêñóíçÉÀ0-9 \t\r\n]"


@query(
    f"""WITH p AS (SELECT doc_id, "start" AS s, "end" AS e, value AS tok FROM ({found_sql({'T': _PIECES})})), q AS (SELECT *, lag(e) OVER w AS pe, lag(tok) OVER w AS pt FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY s))
SELECT doc_id, count(*) AS n, sum(CASE WHEN first THEN 1 ELSE 0 END)::BIGINT AS words, sum(CASE WHEN first THEN s ELSE 0 END)::BIGINT AS places
FROM (SELECT *, pe IS NULL OR s > pe OR NOT regexp_matches(tok[1], '[\\p{{L}}\\p{{N}}]') OR NOT regexp_matches(pt[-1], '[\\p{{L}}\\p{{N}}]') AS first FROM q) GROUP BY doc_id"""
)
def text_word_starts(spark, sf_dir):
    """Pieces of every text that begin a word: after a gap, at marks and after them."""
    # A filter on the pieces would find them twice.
    rows = docs(spark, sf_dir).where(F.col("text").rlike(_PIECES)).select("doc_id", matches(F.col("text"), _PIECES).alias("toks"))
    at = F.zip_with("toks", S.word_begins(F.col("toks")), lambda t, first: F.when(first, t["start"]))
    rows = rows.select("doc_id", F.size("toks").cast("long").alias("n"), F.filter(at, lambda s: s.isNotNull()).alias("at"))
    return rows.select("doc_id", "n", F.size("at").cast("long").alias("words"), F.aggregate("at", F.lit(0).cast("long"), lambda a, s: a + s).alias("places"))


@query(f"""SELECT doc_id, label, "start", "end" FROM ({found_sql(D.PATTERNS)})""")
def json_spans(spark, sf_dir):
    """Detected spans of every text written as JSON, with either quote, and read back."""
    found = F.flatten(F.array(*(matches(F.col("text"), p, k) for k, p in D.PATTERNS.items())))
    raw = F.to_json(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"))))
    raw = F.when(F.col("doc_id") % 2 == 0, raw).otherwise(F.replace(raw, F.lit('"'), F.lit("'")))
    return docs(spark, sf_dir).select("doc_id", F.explode(X.parsed_spans(raw)).alias("s")).select("doc_id", "s.label", "s.start", "s.end")


_MOVED_START = """CASE WHEN s >= b THEN s + length(n) - (b - a) ELSE s END"""
_MOVED_END = """CASE WHEN s >= b THEN e + length(n) - (b - a) WHEN s = a AND e = b THEN a + length(n) WHEN e > a AND e >= b THEN e + length(n) - (b - a) ELSE e END"""


@query(
    f"""WITH x AS (SELECT doc_id, text, (doc_id * 7 % (length(text) + 1))::BIGINT AS a, repeat('é', (doc_id % 5)::INTEGER) AS n FROM documents), y AS (SELECT *, least(a + doc_id % 11, length(text)) AS b FROM x),
 z AS (SELECT f.doc_id, f.label, f."start" AS s, f."end" AS e, y.a, y.b, y.n, y.text FROM ({found_sql(D.PATTERNS)}) f JOIN y ON y.doc_id = f.doc_id)
SELECT doc_id, label, CAST({_MOVED_START} AS INTEGER) AS "start", CAST({_MOVED_END} AS INTEGER) AS "end", md5(substr(text, 1, a) || n || substr(text, b + 1)) AS said FROM z"""
)
def spliced_texts(spark, sf_dir):
    """Every text with a piece of it replaced, and its spans moved, resized or grown."""
    found = F.flatten(F.array(*(matches(F.col("text"), p, k) for k, p in D.PATTERNS.items())))
    a = (F.col("doc_id") * 7 % (F.length("text") + 1)).cast("int")
    rows = docs(spark, sf_dir).select("doc_id", "text", a.alias("a"), F.repeat(F.lit("é"), (F.col("doc_id") % 5).cast("int")).alias("n"), found.alias("spans"))
    rows = rows.withColumn("b", F.least(F.col("a") + F.col("doc_id") % 11, F.length("text")).cast("int"))
    moved = S.spliced_spans(F.col("spans"), F.col("a"), F.col("b"), F.col("n"))
    out = rows.select("doc_id", F.md5(S.spliced_text(F.col("text"), F.col("a"), F.col("b"), F.col("n")).cast("binary")).alias("said"), F.explode(moved).alias("s"))
    return out.select("doc_id", "s.label", "s.start", "s.end", "said")


@query(
    """WITH v AS (SELECT c_custkey, unnest([('PHONE', CASE c_custkey % 3 WHEN 0 THEN '  +49 30 ' || c_custkey || '0000 ' WHEN 1 THEN 'x' || c_custkey ELSE '(0' || c_custkey || ') 555 ' || c_custkey END), ('ACCOUNT', CASE c_custkey % 2 WHEN 0 THEN 'DE' || c_custkey || ' ' || c_custkey || '77' ELSE 'de' || c_custkey END),
 ('EMAIL', CASE c_custkey % 4 WHEN 0 THEN lower(c_mktsegment) || '@' || c_custkey || '.org' WHEN 1 THEN c_mktsegment || ' @x.de' WHEN 2 THEN 'a@b' ELSE ' ' || c_custkey || '@mail.example.com' || chr(10) END), ('DOB', CASE c_custkey % 2 WHEN 0 THEN c_mktsegment ELSE c_mktsegment || c_custkey END), ('PERSON', CASE c_custkey % 2 WHEN 0 THEN c_mktsegment || chr(9) || c_mktsegment ELSE c_name END), ('BUSINESS', CASE c_custkey % 5 WHEN 0 THEN '  ' ELSE c_name END)]) AS x FROM customer),
 t AS (SELECT c_custkey, x[1] AS label, trim(regexp_replace(x[2], '\\s+', ' ', 'g')) AS v FROM v)
SELECT c_custkey, label, CASE WHEN CASE label WHEN 'PHONE' THEN regexp_matches(v, '^[+(]?[0-9][-0-9 ()./]{5,18}$') WHEN 'ACCOUNT' THEN regexp_matches(v, '^[A-Z0-9][-A-Z0-9 ]{5,33}$') WHEN 'EMAIL' THEN regexp_matches(v, '^[^ @]+@[^ @]+[.][A-Za-z]{2,}$') WHEN 'DOB' THEN regexp_matches(v, '[0-9]') WHEN 'PERSON' THEN regexp_matches(v, '^[^0-9@]{2,60}$') ELSE v <> '' END THEN v END AS value FROM t"""
)
def customer_values(spark, sf_dir):
    """Values made of every customer's columns, kept where they have their label's shape."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey").cast("string")
    mod = lambda n: F.col("c_custkey") % n
    seg, join = F.col("c_mktsegment"), F.concat
    made = {
        "PHONE": F.when(mod(3) == 0, join(F.lit("  +49 30 "), k, F.lit("0000 "))).when(mod(3) == 1, join(F.lit("x"), k)).otherwise(join(F.lit("(0"), k, F.lit(") 555 "), k)),
        "ACCOUNT": F.when(mod(2) == 0, join(F.lit("DE"), k, F.lit(" "), k, F.lit("77"))).otherwise(join(F.lit("de"), k)),
        "EMAIL": F.when(mod(4) == 0, join(F.lower(seg), F.lit("@"), k, F.lit(".org"))).when(mod(4) == 1, join(seg, F.lit(" @x.de"))).when(mod(4) == 2, F.lit("a@b")).otherwise(join(F.lit(" "), k, F.lit("@mail.example.com\n"))),
        "DOB": F.when(mod(2) == 0, seg).otherwise(join(seg, k)),
        "PERSON": F.when(mod(2) == 0, join(seg, F.lit("\t"), seg)).otherwise(F.col("c_name")),
        "BUSINESS": F.when(mod(5) == 0, F.lit("  ")).otherwise(F.col("c_name")),
    }
    rows = c.select("c_custkey", F.explode(F.array(*(F.struct(F.lit(n).alias("label"), v.alias("v")) for n, v in made.items()))).alias("x"))
    return rows.select("c_custkey", F.col("x.label").alias("label"), V.clean_value(F.col("x.v"), F.col("x.label")).alias("value"))


#: Turns of every conversation as mails: some with header lines, some that quote the turn before.
_MAIL = """SELECT conv_id, turn, role, CASE turn % 4 WHEN 0 THEN 'Subject: ' || role || chr(10) || t WHEN 1 THEN t || chr(10) || '> ' || t WHEN 2 THEN t || chr(10) || '-----Original Message-----' || chr(10) || t ELSE t END AS body, t FROM (SELECT conv_id, turn, role, replace(coalesce(text, ''), '>', ')') AS t FROM conversations)"""


@query(f"WITH m AS ({_MAIL}) SELECT conv_id, turn, role, md5(CASE turn % 4 WHEN 0 THEN chr(10) || t WHEN 3 THEN t ELSE t || chr(10) END) AS said FROM m")
def mailed_turns(spark, sf_dir):
    """Turns wrapped as mails with headers and quotes, and unwrapped."""
    said = F.replace(F.coalesce("text", F.lit("")), F.lit(">"), F.lit(")"))
    kind, nl = F.col("turn") % 4, F.lit("\n")
    body = F.when(kind == 0, F.concat(F.lit("Subject: "), "role", nl, said)).when(kind == 1, F.concat(said, nl, F.lit("> "), said)).when(kind == 2, F.concat(said, nl, F.lit("-----Original Message-----"), nl, said)).otherwise(said)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.md5(X.clean_email(body).cast("binary")).alias("said"))


@query("SELECT source, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents WHERE doc_id % 3 = 1 GROUP BY source")
def split_column(spark, sf_dir):
    """One split of a table written with a ``split`` column."""
    path = shared_path(spark, "splits")
    split = F.element_at(F.array(*map(F.lit, ("train", "dev", "test"))), (F.col("doc_id") % 3 + 1).cast("int"))
    docs(spark, sf_dir).select("doc_id", "source", split.alias("split")).write.parquet(path)
    return R.split_of(spark, path, "dev").groupBy("source").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query(
    r"""WITH m AS (SELECT conv_id, turn, role, trim(regexp_replace(regexp_replace(CASE WHEN turn % 2 = 0 THEN 'Subject: ' || role || chr(10) ELSE '' END || coalesce(text, ''), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g')) AS said FROM conversations)
SELECT role, count(*) AS n, sum(length(regexp_replace(said, '\s', '', 'g')))::BIGINT AS chars FROM m GROUP BY role"""
)
def subject_mails(spark, sf_dir):
    """Turns as mails with a subject in every second: letters of the texts that the reader makes."""
    rows = table(spark, sf_dir, "conversations").select("role", F.col("text").alias("body"), F.when(F.col("turn") % 2 == 0, F.col("role")).alias("subject"))
    return R.mails(rows).groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length(F.regexp_replace("text", r"\s", ""))).alias("chars"))


@query(
    r"""WITH p AS (SELECT c_custkey, [c_name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'No. ' || c_nationkey || ', ' END, c_mktsegment] AS l FROM customer)
SELECT c_custkey, list_reduce(list_filter(l, lambda x: x <> ''), lambda a, x: a || CASE WHEN regexp_matches(a, '[,，]\s*$') THEN ' ' ELSE '; ' END || x) AS address FROM p"""
)
def joined_addresses(spark, sf_dir):
    """Parts of every customer's address joined without double commas."""
    c = table(spark, sf_dir, "customer")
    parts = F.array("c_name", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat(F.lit("No. "), F.col("c_nationkey").cast("string"), F.lit(", "))), "c_mktsegment")
    return c.select("c_custkey", X.joined_address(parts, "; ").alias("address"))


@query("SELECT CASE WHEN length(translate(text, 'aeiou', '')) > length(translate(text, 'nrst', '')) THEN 'zh-Hans' WHEN length(translate(text, 'aeiou', '')) < length(translate(text, 'nrst', '')) THEN 'zh-Hant' ELSE 'zh-Hans' END AS variant, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM (SELECT doc_id, left(replace(text, 'u', ''), 200) AS text FROM documents) GROUP BY 1")
def written_variants(spark, sf_dir):
    """Which of two alphabets the first words of every text are written in, with vowels and consonants as their forms."""
    text = F.substring(F.replace("text", F.lit("u"), F.lit("")), 1, 200)
    forms = X.zh_variant(F.translate(text, "nrstaeio", "国语说这國語說這"), "国语说这", "國語說這")
    return docs(spark, sf_dir).groupBy(forms.alias("variant")).agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("SELECT model, chars, count(*) AS n, median(s) AS median_s FROM (SELECT l_returnflag AS model, l_linenumber::INTEGER AS chars, l_quantity::DOUBLE AS s FROM lineitem) GROUP BY ALL")
def latency_table(spark, sf_dir):
    """Timings of every line item as a tab-separated summary with a header, read back by its schema."""
    path = shared_path(spark, "latency")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("chars"), F.lit(1).alias("tokens"), F.lit(1).alias("windows"), *(F.col("l_quantity").alias(n) for n in ("median_s", "min_s", "max_s")))
    rows.write.option("sep", "\t").option("header", True).csv(path)
    return R.latency(spark, path).groupBy("model", "chars").agg(F.count("*").alias("n"), F.percentile("median_s", 0.5).alias("median_s"))


_FILE = """CASE o_orderkey % 6 WHEN 0 THEN 'v1_' || o_custkey || '.txt' WHEN 1 THEN 'gpu_latency/A_' || o_custkey || '.txt' WHEN 2 THEN 'v4/router/router_' || o_custkey || '.txt' WHEN 3 THEN 'router_' || o_custkey || '.txt' WHEN 4 THEN 'gpu_latency/summary.tsv' ELSE 'english/v1/v1_' || o_custkey || '.txt' END"""
_GROUP = """CASE k WHEN 0 THEN 'english/v1/' || path WHEN 1 THEN 'v5/latency/gpu_latency/' || substr(path, 13) WHEN 3 THEN 'v4/router/' || path WHEN 4 THEN NULL ELSE path END"""


def _files(spark, sf_dir):
    """Names of result files made of the orders."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 6
    c = F.concat(F.col("o_custkey").cast("string"), F.lit(".txt"))
    path = F.when(k == 0, F.concat(F.lit("v1_"), c)).when(k == 1, F.concat(F.lit("gpu_latency/A_"), c)).when(k == 2, F.concat(F.lit("v4/router/router_"), c)).when(k == 3, F.concat(F.lit("router_"), c)).when(k == 4, "gpu_latency/summary.tsv").otherwise(F.concat(F.lit("english/v1/v1_"), c))
    return o.select(path.alias("path"), F.col("o_orderkey").alias("modified"), (F.col("o_custkey") % 5).alias("part"))


@query(
    f"""WITH f AS (SELECT {_FILE} AS path, max(o_orderkey) AS modified, min(o_orderkey % 6) AS k FROM orders GROUP BY 1), t AS (SELECT *, {_GROUP} AS target FROM f),
 r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY k IN (0, 1, 3) DESC, modified DESC, path) AS place FROM t WHERE target IS NOT NULL)
SELECT path, CASE WHEN place = 1 THEN target END AS target FROM r"""
)
def organised_results(spark, sf_dir):
    """Where each result file belongs, the newest of a place only."""
    files = _files(spark, sf_dir).groupBy("path").agg(F.max("modified").alias("modified"))
    return B.organised(files)


@query(
    f"""WITH f AS (SELECT DISTINCT {_FILE} AS path FROM orders WHERE o_custkey % 5 < 3), w AS (SELECT DISTINCT unnest(['v1_' || o_custkey || '.txt', 'router/router_' || o_custkey || '.txt']) AS rel FROM orders)
SELECT rel, coalesce((SELECT path FROM f WHERE path = rel OR path = 'english/v1/' || rel OR ends_with(path, rel) ORDER BY path <> rel, path <> 'english/v1/' || rel, path LIMIT 1), rel) AS path FROM w"""
)
def located_results(spark, sf_dir):
    """Short names of result files resolved at the top, in their group or anywhere; some are nowhere."""
    files = _files(spark, sf_dir).where("part < 3").select("path")
    key = F.concat(F.col("o_custkey").cast("string"), F.lit(".txt"))
    wanted = table(spark, sf_dir, "orders").select(F.explode(F.array(F.concat(F.lit("v1_"), key), F.concat(F.lit("router/router_"), key))).alias("rel"))
    return B.located(wanted, files)
