"""Queries that generate labelled documents and check them."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanweave.functions.offsets import part
from spanweave.operators import generate as G
from spanweave.operators.corpus import pair_coverage
from spanweave.operators.grammar import composed
from spanweave.operators.spans import violations
from spanweave.plans.registry import fixture, query, values
from spanweave.session import table

_TEMPLATES = ["Dear {PERSON}, write to {EMAIL}.", "{BUSINESS} of {ADDRESS} pays {PERSON} and {PERSON}", "Call {PHONE} {UNKNOWN}", "no slot"]
_POOLS = {k: G.POOLS[k] for k in ("PERSON", "EMAIL", "BUSINESS", "ADDRESS", "PHONE")}


def _list(items) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


_PICK = "CASE " + " ".join(f"WHEN n = '{k}' THEN {_list(v)}[(('0x' || substr(md5('0|' || id || '|' || n || (i - 1)), 1, 8))::BIGINT % {len(v)}) + 1]" for k, v in _POOLS.items()) + " ELSE '{' || n || '}' END"


@query(
    f"""WITH t AS (SELECT s_suppkey AS id, {_list(_TEMPLATES)}[s_suppkey % 4 + 1] AS template FROM supplier),
 s AS (SELECT id, string_split_regex(template, '\\{{[A-Z]+\\}}') AS p, regexp_extract_all(template, '\\{{[A-Z]+\\}}') AS h FROM t),
 v AS (SELECT id, p, h, unnest(range(1, len(p) + 1)) AS i FROM s), w AS (SELECT *, CASE WHEN i <= len(h) THEN h[i][2:len(h[i]) - 1] END AS n FROM v),
 x AS (SELECT id, i, n, p[i] AS plain, CASE WHEN n IS NULL THEN '' ELSE {_PICK} END AS value FROM w)
SELECT id, string_agg(plain || value, '' ORDER BY i) AS text, count(*) FILTER (n IN {tuple(_POOLS)}) AS n FROM x GROUP BY id"""
)
def frame_fill(spark, sf_dir):
    """Slots of sentence frames filled with hash-drawn values."""
    key = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(key.alias("id"), F.get(F.array(*map(F.lit, _TEMPLATES)), (key % 4).cast("int")).alias("template"))
    return G.filled(rows, _POOLS).select("id", "text", F.size("spans").cast("long").alias("n"))


def _checked(rows, column: str = "spans"):
    """Documents, spans, and spans that break an invariant."""
    spans = rows.select("id", "text", F.explode(column).alias("s")).select("id", "text", "s.start", "s.end", "s.label")
    bad = violations(spans, "id").agg(F.count("*").alias("bad"))
    return rows.agg(F.count("*").alias("docs"), (F.sum(F.size(column)) > 0).alias("some")).withColumn("bad", bad.scalar())


@query("SELECT 5000::BIGINT AS docs, true AS some, 0::BIGINT AS bad")
def form_records(spark, sf_dir):
    """Generated forms without a violated span."""
    return _checked(G.form_records(spark, 5000))


@query("SELECT 5000::BIGINT AS docs, true AS some, 0::BIGINT AS bad")
def address_records(spark, sf_dir):
    return _checked(G.address_records(spark, 5000))


@query("SELECT 5000::BIGINT AS docs, true AS some, 0::BIGINT AS bad")
def lookalike_records(spark, sf_dir):
    return _checked(G.lookalike_records(spark, 5000), "negs")


FACTORS = {"label": ["PERSON", "ADDRESS", "ACCOUNT"], "ctx": ["form", "prose", "table", "chat"], "lang": ["en", "zh", "ar", "th"], "mode": ["plain", "quoted"]}


@query("SELECT 6::BIGINT AS pairs, 62::BIGINT AS cells, true AS covered")
def grid_plan_covers(spark, sf_dir):
    """A covering plan in which every pair of factor values occurs at least three times."""
    names = list(FACTORS)
    plan = G.grid_plan(spark, FACTORS, 3)
    return pair_coverage(plan, names).agg(F.count("*").alias("pairs"), F.sum("cells").alias("cells"), (F.min("least") >= 3).alias("covered"))


# The same records for every customer, with SQL that makes each text anew.


def _pick(seed: str, place: str, options: list[str]) -> str:
    """One of some SQL expressions, by the md5 of the seed, the customer and a place."""
    cases = " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(options))
    return f"CASE ('0x' || substr(md5('{seed}|' || c_custkey || '|{place}'), 1, 8))::BIGINT % {len(options)} {cases} END"


def _number(seed: str, place: str, n: int) -> str:
    return f"(('0x' || substr(md5('{seed}|' || c_custkey || '|{place}'), 1, 8))::BIGINT % {n})"


def _said(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _characters(sets: list[str], seed: str) -> str:
    """Characters of a pattern, each from its set (a set of one stands as it is)."""
    one = lambda k, x: f"'{x}'" if len(x) == 1 else f"substr('{x}', ('0x' || substr(md5({seed} || '|{k}'), 1, 6))::INTEGER % {len(x)} + 1, 1)"
    return "(" + " || ".join(one(k, x) for k, x in enumerate(sets)) + ")"


_D, _A = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _placed(parts: str) -> str:
    """Places of labelled parts: ``parts`` is a query of ``c_custkey, i, value, label``."""
    return f"""WITH parts AS ({parts}), placed AS (SELECT *, sum(length(value)) OVER (PARTITION BY c_custkey ORDER BY i) AS upto, string_agg(value, '') OVER (PARTITION BY c_custkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS text FROM parts)
SELECT c_custkey, md5(text) AS said, label, CAST(upto - length(value) AS INTEGER) AS "start", CAST(upto AS INTEGER) AS "end" FROM placed WHERE label IS NOT NULL"""


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))


def _spans_of(made, column="spans"):
    return made.select(F.col("id").alias("c_custkey"), F.md5(F.col("text").cast("binary")).alias("said"), F.explode(column).alias("s")).select("c_custkey", "said", "s.label", "s.start", "s.end")


_FIELDS_SQL = "\nUNION ALL\n".join(
    f"""SELECT c_custkey, {3 * k} + o AS i, CASE o WHEN 0 THEN '{name}' || {_pick('form', 'style', ["': '", "' - '"])} WHEN 1 THEN {_characters([_D] * 4 + ['-'] + [_D] * 4 + ['-'] + [_D] * 4, "'form|' || c_custkey") if label == 'ACCOUNT' else _pick('form', label, [_said(v) for v in G.POOLS[label]])} ELSE chr(10) END AS value, CASE WHEN o = 1 THEN '{label}' END AS label
 FROM customer, (VALUES (0), (1), (2)) AS v(o) WHERE {_number('form', f'has {name}', 3)} > 0"""
    for k, (name, label) in enumerate([("Name", "PERSON"), ("Company", "BUSINESS"), ("Address", "ADDRESS"), ("E-mail", "EMAIL"), ("Phone", "PHONE"), ("Account", "ACCOUNT")])
)


@query(_placed(_FIELDS_SQL))
def customer_forms(spark, sf_dir):
    """A form for every customer: the digest of its text and the places of its spans."""
    return _spans_of(G.forms(_customers(spark, sf_dir)))


_STREET = _characters(["123456789", _D], "'address' || c_custkey") + " || ' ' || " + _pick("address", "street", ["'Elm St'", "'Oak Road'", "'High Street'", "'Mill Lane'"])
_TOWN, _CODE = _pick("address", "place", ["'Springfield'", "'Leeds'", "'Austin'", "'Cork'"]), _characters([_D] * 5, "'address|code|' || c_custkey")


@query(
    _placed(
        f"""SELECT c_custkey, o AS i, CASE o WHEN 0 THEN {_pick('address', 'lead', [_said('Ship to: '), _said('Registered office' + chr(10)), _said('I live at '), _said('')])}
 WHEN 1 THEN {_pick('address', 'form', [f"{_STREET} || ', ' || {_TOWN} || ' ' || {_CODE}", f"{_STREET} || chr(10) || {_TOWN} || ', ' || {_CODE}", f"{_STREET} || ',' || chr(10) || {_TOWN} || chr(10) || {_CODE}", f"'Unit 4, ' || {_STREET} || ', ' || {_TOWN}"])}
 ELSE {_pick('address', 'end', ["'.'", "chr(10) || 'Thank you'"])} END AS value, CASE WHEN o = 1 THEN 'ADDRESS' END AS label FROM customer, (VALUES (0), (1), (2)) AS v(o)"""
    )
)
def customer_addresses(spark, sf_dir):
    """An address in one of several layouts for every customer."""
    return _spans_of(G.addresses(_customers(spark, sf_dir)))


@query(
    _placed(
        f"""SELECT c_custkey, o AS i, CASE o WHEN 0 THEN {_pick('look', 'kind', ["'Order no. '", "'Total '", "'Due '", "'Ticket '"])}
 WHEN 1 THEN {_pick('look', 'kind', [_characters([_A, _A, '-'] + [_D] * 6, "'look|' || c_custkey"), f"'USD ' || format('{{:,}}', {_number('look', 'amount', 10**7)})", f"strftime(DATE '2020-01-01' + {_number('look', 'day', 2000)}::INTEGER, '%d/%m/%Y')", _characters([_D] * 12, "'look|' || c_custkey")])}
 ELSE ' noted' END AS value, CASE WHEN o = 1 THEN {_pick('look', 'kind', ["'code'", "'amount'", "'date'", "'code'"])} END AS label FROM customer, (VALUES (0), (1), (2)) AS v(o)"""
    )
)
def customer_lookalikes(spark, sf_dir):
    """A code, amount or date that resembles an entity for every customer."""
    return _spans_of(G.lookalikes(_customers(spark, sf_dir)), "negs")


_PART = {"p_brand": 25, "p_type": 6, "p_size": 50}
_LISTS = ", ".join(f"(SELECT list(DISTINCT {c}::VARCHAR ORDER BY {c}::VARCHAR) FROM part) AS {c}s" for c in _PART)


@query(
    f"""WITH v AS (SELECT {_LISTS}), p AS (SELECT *, (SELECT min(q) FROM range(2, 1000) t(q) WHERE q >= greatest(len(p_brands), len(p_types), len(p_sizes)) AND NOT EXISTS (SELECT 1 FROM range(2, 1000) u(d) WHERE d < q AND q % d = 0)) AS p FROM v),
 l AS (SELECT *, unnest(range(0, 2 * p * p)) AS n FROM p), r AS (SELECT *, n // (p * p) AS t, n // p % p AS a, n % p AS b FROM l),
 plan AS (SELECT p_brands[(b + t) % p % len(p_brands) + 1] AS p_brand, p_types[(a + b + t) % p % len(p_types) + 1] AS p_type, p_sizes[(2 * a + b + t) % p % len(p_sizes) + 1] AS p_size FROM r),
 pairs AS (SELECT 'brand/type' AS pair, p_brand AS x, p_type AS y, count(*) AS n FROM plan GROUP BY ALL UNION ALL SELECT 'brand/size', p_brand, p_size, count(*) FROM plan GROUP BY ALL UNION ALL SELECT 'type/size', p_type, p_size, count(*) FROM plan GROUP BY ALL),
 wanted AS (SELECT 'brand/type' AS pair, p_brand AS x, p_type AS y, count(*) AS parts FROM part GROUP BY ALL UNION ALL SELECT 'brand/size', p_brand, p_size::VARCHAR, count(*) FROM part GROUP BY ALL UNION ALL SELECT 'type/size', p_type, p_size::VARCHAR, count(*) FROM part GROUP BY ALL)
SELECT pair, x, y, parts, coalesce(n, 0) AS planned, coalesce(n, 0) >= 2 AS enough FROM wanted LEFT JOIN pairs USING (pair, x, y)"""
)
def covering_plan(spark, sf_dir):
    """A plan over all values of three columns of parts: how often each pair of values that a part has is planned."""
    part = table(spark, sf_dir, "part").select(*(F.col(c).cast("string").alias(c) for c in _PART))
    values_ = {c: [r[0] for r in part.select(c).distinct().orderBy(c).collect()] for c in _PART}  # a row for each value of a factor
    plan = G.grid_plan(spark, values_, 2)

    def pairs(rows, name):
        out = None
        for a, b in (("p_brand", "p_type"), ("p_brand", "p_size"), ("p_type", "p_size")):
            one = rows.groupBy(F.lit(f"{a[2:]}/{b[2:]}").alias("pair"), F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias(name))
            out = one if out is None else out.unionByName(one)
        return out

    found = pairs(part, "parts").join(pairs(plan, "planned"), ["pair", "x", "y"], "left").na.fill(0, ["planned"])
    return found.withColumn("enough", F.col("planned") >= 2)


#: A grammar of three levels over the customers' columns.
GRAMMAR = {
    "DOC": ["{HEAD}. {BODY}", "{BODY} ({HEAD})"],
    "HEAD": ["Holder {@c_name=PERSON}", "{@c_name=PERSON} hält es"],
    "BODY": ["balance {AMOUNT=AMOUNT}", "{AMOUNT=AMOUNT} due in {@c_mktsegment=SEGMENT}", "nothing due"],
    "AMOUNT": ["USD {@balance=NUMBER}", "{@balance=NUMBER} dollars"],
}


def _drawn(place: str, n: int) -> str:
    return f"('0x' || substr(md5('g|' || c_custkey || '|' || {place}), 1, 8))::BIGINT % {n}"


@query(
    f"""WITH c AS (SELECT c_custkey, c_name, c_mktsegment, CAST(CAST(c_acctbal AS DECIMAL(12, 2)) AS VARCHAR) AS balance FROM customer),
 d AS (SELECT *, {_drawn("'0'", 2)} AS doc FROM c),
 p AS (SELECT *, CASE doc WHEN 0 THEN '0.0' ELSE '0.2' END AS head_at, CASE doc WHEN 0 THEN '0.2' ELSE '0.0' END AS body_at FROM d),
 q AS (SELECT *, {_drawn("head_at", 2)} AS head, {_drawn("body_at", 3)} AS body FROM p),
 a AS (SELECT *, CASE WHEN {_drawn("body_at || CASE body WHEN 0 THEN '.2' ELSE '.1' END", 2)} = 0 THEN 'USD ' || balance ELSE balance || ' dollars' END AS amount FROM q),
 s AS (SELECT *, CASE head WHEN 0 THEN 'Holder ' || c_name ELSE c_name || ' hält es' END AS head_said, CASE body WHEN 0 THEN 'balance ' || amount WHEN 1 THEN amount || ' due in ' || c_mktsegment ELSE 'nothing due' END AS body_said FROM a),
 t AS (SELECT *, CASE doc WHEN 0 THEN head_said || '. ' || body_said ELSE body_said || ' (' || head_said || ')' END AS text FROM s),
 v AS (SELECT c_custkey, text, 'PERSON' AS label, c_name AS value FROM t UNION ALL SELECT c_custkey, text, 'AMOUNT', amount FROM t WHERE body < 2 UNION ALL SELECT c_custkey, text, 'NUMBER', balance FROM t WHERE body < 2 UNION ALL SELECT c_custkey, text, 'SEGMENT', c_mktsegment FROM t WHERE body = 1)
SELECT c_custkey, md5(text) AS said, label, CAST(strpos(text, value) - 1 AS INTEGER) AS "start", CAST(strpos(text, value) - 1 + length(value) AS INTEGER) AS "end" FROM v"""
)
def grammar_spans(spark, sf_dir):
    """A document of a nested grammar for every customer: the places of its spans, nested ones too."""
    rows = table(spark, sf_dir, "customer").withColumn("balance", F.col("c_acctbal").cast("decimal(12,2)"))
    made = composed(rows, GRAMMAR, "DOC", "g", "c_custkey")
    return made.select("c_custkey", F.md5(F.col("text").cast("binary")).alias("said"), F.explode("spans").alias("s")).select("c_custkey", "said", "s.label", "s.start", "s.end")


_DATES = [("th", "12/05/2530"), ("zh-Hant", "民國76年5月12日"), ("zh-Hans", "1987年5月12日"), ("ko", "1987년 5월 12일"), ("hi", "१२/०५/१९८७"), ("ar", "١٢/٠٥/١٩٨٧"), ("vi", "ngày 12 tháng 5 năm 1987"), ("en", "12th May 1987"), ("ms", "1987-05-12")]


@query(f"SELECT lang, d FROM {values(_DATES, 'lang, d')}")
def local_dates(spark, sf_dir):
    """One date as nine languages write it."""
    rows = fixture(spark, [(k,) for k, _ in _DATES], "lang string")
    return rows.select("lang", G.local_date(F.lit("1987-05-12").cast("date"), F.col("lang")).alias("d"))


_AMOUNTS = [("en", "1,234,567"), ("hi", "12,34,567"), ("de", "1.234.567")]


@query(f"SELECT lang, a FROM {values(_AMOUNTS, 'lang, a')}")
def local_amounts(spark, sf_dir):
    rows = fixture(spark, [(k,) for k, _ in _AMOUNTS], "lang string")
    return rows.select("lang", G.local_amount(F.lit(1234567).cast("long"), F.col("lang")).alias("a"))


@query("SELECT 1000::BIGINT AS docs, 0::BIGINT AS wrong")
def frame_spans_exact(spark, sf_dir):
    """Every span of filled frames covers a value of its label's pool."""
    rows = spark.range(1000).withColumn("template", F.get(F.array(*map(F.lit, _TEMPLATES)), (F.col("id") % 4).cast("int")))
    made = G.filled(rows, _POOLS)
    spans = made.select("id", "text", F.explode("spans").alias("s"))
    fits = F.lit(False)
    for label, pool in _POOLS.items():
        fits = fits | ((F.col("s.label") == label) & part(F.col("text"), F.col("s.start"), F.col("s.end")).isin(pool))
    wrong = spans.where(~fits).agg(F.count("*").alias("n"))
    return made.agg(F.count("*").alias("docs")).withColumn("wrong", wrong.scalar())


def _draw(place: str, n: int, key: str = "c_custkey") -> str:
    return f"(('0x' || substr(md5('s|' || {key} || '|{place}'), 1, 8))::BIGINT % {n})"


def _pattern(pattern: str, place: str, key: str = "c_custkey") -> str:
    pools = {"#": "0123456789", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "X": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"}
    cells = [
        f"substr('{pools[c]}', (('0x' || substr(md5('s|' || {key} || '|{place}|{k}'), 1, 6))::BIGINT % {len(pools[c])} + 1)::BIGINT, 1)" if c in pools else f"'{c}'" for k, c in enumerate(pattern)
    ]
    return "(" + " || ".join(cells) + ")"


_LANGS = list(G.CURRENCIES)
_SHOWN = "format('{:,}', CASE " + _draw("size", 3) + " WHEN 0 THEN " + _draw("amount0", 9_900) + " + 100 WHEN 1 THEN " + _draw("amount1", 990_000) + " + 10000 ELSE " + _draw("amount2", 99_000_000) + " + 1000000 END)"
_MARK = lambda k: "CASE c_custkey % 12 " + " ".join(f"WHEN {i} THEN '{G.CURRENCIES[n][k]}'" for i, n in enumerate(_LANGS)) + " END"
_WEIGHTS = [w for *_, w in G.INSTITUTIONS]
_INSTITUTION = "CASE " + " ".join(f"WHEN {_draw('institution', 10_000)} / 10000.0 < {sum(_WEIGHTS[: k + 1]) / sum(_WEIGHTS)} THEN {k}" for k in range(len(_WEIGHTS) - 1)) + f" ELSE {len(_WEIGHTS) - 1} END"


def _account(place: str) -> str:
    whens = " ".join(f"WHEN {k} THEN {_list_of([_pattern(p, f'{place}|{k}') for p in patterns])}[{_draw(f'{place}|pattern', len(patterns))} + 1]" for k, (_, _, patterns, _) in enumerate(G.INSTITUTIONS))
    return f"CASE {_INSTITUTION} {whens} END"


def _list_of(cells) -> str:
    return "[" + ", ".join(cells) + "]"


_TICKERS = "CASE " + _draw("company", len(G.COMPANIES)) + " " + " ".join(
    f"WHEN {k} THEN {_list([f'{x}: {c}', c + s if s else n, f'{n} ({x}: {c})', n if c.isdigit() else c, n])}[{_draw('ticker', 5)} + 1]" for k, (n, c, x, s) in enumerate(G.COMPANIES)
) + " END"


@query(
    f"""WITH v AS (SELECT c_custkey, CASE WHEN c_custkey % 12 IN ({', '.join(str(_LANGS.index(n)) for n in G.DOTTED)}) THEN replace({_SHOWN}, ',', '.') ELSE {_SHOWN} END AS shown FROM customer)
SELECT c_custkey, CASE {_draw('form', 2)} WHEN 0 THEN {_MARK(0)} || ' ' || shown ELSE {_MARK(1)} || shown END AS amount, {_list(G.COUNTRY_CODES)}[{_draw('isin', 7)} + 1] || {_pattern('XXXXXXXXX#', 'isin')} AS isin,
 {_pattern('AAAA', 'bank')} || {_list(G.COUNTRY_CODES)}[{_draw('bank', 7)} + 1] || CASE {_draw('branch', 2)} WHEN 0 THEN {_pattern('AX', 'place')} ELSE {_pattern('AXXXX', 'place')} END AS code,
 {_list(['TT', 'REF-', '', 'TXN', 'INV-'])}[{_draw('ref', 5)} + 1] || regexp_replace({_account('ref')}, '[^0-9]', '', 'g') AS ref, {_TICKERS} AS ticker FROM v"""
)
def slot_values(spark, sf_dir):
    """Amounts, securities, bank codes, references and listed companies drawn for every customer."""
    key = F.col("c_custkey")
    lang = F.get(F.array(*map(F.lit, _LANGS)), (key % 12).cast("int"))
    rows = table(spark, sf_dir, "customer")
    return rows.select("c_custkey", G.amount_value("s", key, lang).alias("amount"), G.isin_value("s", key).alias("isin"), G.bank_code("s", key).alias("code"), G.reference_value("s", key).alias("ref"), G.ticker_value("s", key).alias("ticker"))


_CUE = f"CASE WHEN many = 1 THEN {_list(['account', 'A/C no.'])}[{_draw('cue', 2)} + 1] ELSE {_list(['accounts', 'A/C nos.'])}[{_draw('cue', 2)} + 1] END"


@query(
    f"""WITH v AS (SELECT c_custkey, {_draw('many', 3)} + 1 AS many, {_account('account0')} AS a0, {_account('account1')} AS a1, {_account('account2')} AS a2, {_draw('named', 10)} < 4 AS named, {_list([n for n, *_ in G.INSTITUTIONS])}[{_INSTITUTION} + 1] AS name FROM customer)
SELECT c_custkey, {_CUE} || ' ' || a0 || CASE WHEN many > 1 THEN CASE WHEN many = 2 THEN ' and ' ELSE ', ' END || a1 ELSE '' END || CASE WHEN many > 2 THEN ' and ' || a2 ELSE '' END || CASE WHEN named THEN ' (' || name || ')' ELSE '' END AS text,
 a0 || CASE WHEN many > 1 THEN '|' || a1 ELSE '' END || CASE WHEN many > 2 THEN '|' || a2 ELSE '' END || CASE WHEN named THEN '|' || name ELSE '' END AS marked FROM v"""
)
def account_phrases(spark, sf_dir):
    """Phrases with accounts of one institution; the spans' texts are read back by their offsets."""
    made = table(spark, sf_dir, "customer").select("c_custkey", G.account_phrase("s", F.col("c_custkey")).alias("m")).select("c_custkey", "m.text", "m.spans")
    marked = F.array_join(F.transform("spans", lambda s: part(F.col("text"), s["start"], s["end"])), "|")
    return made.select("c_custkey", "text", marked.alias("marked"))
