"""Queries of the rules of single languages; the tables lack such texts, so all but the dates run on fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanweave.functions import native as N
from spanweave.plans.registry import fixture, query, values
from spanweave.session import table

_SHORT = ["%d-%m-%y", "%d/%m/%y", "%m/%d/%y", "%d.%m.%y", "%d-%b-%y", "%m/%y", "%m-%y", "%m/%Y", "%b-%y", "%B/%y", "%B %Y"]
_LONG = ["%d/%m/%Y", "%m/%d/%Y", "%-d/%-m/%Y", "%Y-%m-%d", "%d-%m-%Y", "%d.%m.%Y", "%Y/%m/%d", "%-d %b %Y", "%d %B %Y", "%-d %B %Y", "%B %-d, %Y", "%b %-d, %Y", "%d-%b-%Y"]


def _cases(formats: list[str], count: int) -> str:
    return f"CASE o_orderkey % {count} " + " ".join(f"WHEN {i} THEN strftime(o_orderdate, '{f}')" for i, f in enumerate(formats))


_ORDINAL = "day(o_orderdate) || CASE WHEN day(o_orderdate) IN (11, 12, 13) THEN 'th' WHEN day(o_orderdate) % 10 = 1 THEN 'st' WHEN day(o_orderdate) % 10 = 2 THEN 'nd' WHEN day(o_orderdate) % 10 = 3 THEN 'rd' ELSE 'th' END || strftime(o_orderdate, ' %B %Y')"


@query(f"SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN {_cases(_SHORT, len(_SHORT))} END ELSE {_cases(_LONG, len(_LONG) + 1)} ELSE {_ORDINAL} END END AS shown FROM orders")
def render_dates_any(spark, sf_dir):
    """Dates in all long and short formats."""
    rows = table(spark, sf_dir, "orders")
    return rows.select("o_orderkey", N.rendered_date_any(F.col("o_orderdate"), F.col("o_custkey") % 4 / 4, F.col("o_orderkey")).alias("shown"))


CUES = [
    ("出生日期：1980/01/02", True), ("생년월일은 1980/01/02", True), ("जन्म तिथि: 1980/01/02", True), ("Ngày Sinh: 1980/01/02", True), ("Tarikh lahir 1980/01/02", True),
    ("تاريخ الميلاد: 1980/01/02", True), ("เกิดวันที่ 1980/01/02", True), ("Petsa ng kapanganakan 1980/01/02", True), ("1980/01/02 生まれ", True), ("1980/01/02생", True),
    ("Date of birth: 1980/01/02", True), ("1980/01/02生效", False), ("1980/01/02생산", False), ("出生。登记 1980/01/02", False), ("生日\n1980/01/02", False), ("付款 1980/01/02", False),
]


@query(f"SELECT text, cue FROM {values(CUES, 'text, cue')}")
def native_birth_cues(spark, sf_dir):
    """Dates that a birth cue of any of twelve languages makes dates of birth."""
    rows = fixture(spark, [(t,) for t, _ in CUES], "text string")
    start = F.instr("text", "1980/01/02") - 1
    return rows.select("text", N.native_birth_cue(F.col("text"), start, start + 10).alias("cue"))


NAMES = [
    ("ko", "박호 어머님", "박호"), ("ko", "이ㅁㅁ 대리", "이ㅁㅁ"), ("ko", "김민수 고객님", "김민수"), ("ko", "김민수씨", "김민수"), ("ko", "김민수님 과장 님", "김민수"),
    ("ko", "님", "님"), ("ko", "김 철수씨", "김 철수씨"), ("ko", "김 철수", "김 철수"), ("th", "นายสมชาย ใจดี", "สมชาย ใจดี"), ("th", "ดร. คุณ สมชาย", "สมชาย"), ("th", "นาง", "นาง"), ("th", "สมชาย", "สมชาย"),
]


@query(f"SELECT lang, name, plain FROM {values(NAMES, 'lang, name, plain')}")
def plain_names(spark, sf_dir):
    """Korean and Thai names without titles."""
    rows = fixture(spark, [n[:2] for n in NAMES], "lang string, name string")
    thai = F.substring("name", N.thai_title_length(F.col("name")) + 1, F.length("name"))
    return rows.select("lang", "name", F.when(F.col("lang") == "ko", N.strip_korean_title(F.col("name"))).otherwise(thai).alias("plain"))


DATES = [("생년월일은 1960년 6월 2일이며 만 66세", 6, 17), ("😀 1960. 6. 2 생", 2, 12), ("600602-1", 0, 6), ("600602", None, None), ("만 66세", None, None)]


@query(f"SELECT phrase, start, stop FROM {values(DATES, 'phrase, start, stop')}")
def korean_dates(spark, sf_dir):
    """The date inside a Korean phrase."""
    rows = fixture(spark, [d[:1] for d in DATES], "phrase string").withColumn("d", N.korean_date(F.col("phrase")))
    return rows.select("phrase", F.col("d.start").alias("start"), F.col("d.end").alias("stop"))


ADDRESSES = [
    ("12 Main St Springfield 62701", "4 5 5 14 11", "us", "12 Main St|Springfield 62701"), ("Jalan Satu 57700 Kuala Lumpur", "5 5 11 14 14", "my", "Jalan Satu|57700 Kuala Lumpur"),
    ("cafes near Main St 5", "2 3 5 5 4", "us", None), ("Tower City", "1 14", "us", None), ("Tower Main City", "1 5 14", "us", "Tower|Main|City"),
    ("Main Street", "5 5", "us", None), ("3 B Road Sub Dist Town State Land x", "6 4 5 12 13 14 17 19 0", None, "3 B Road|Sub, Dist|Town|State|Land"),
]


@query(f"SELECT tokens, lines FROM {values([(t, w) for t, _, _, w in ADDRESSES], 'tokens, lines')}")
def address_components(spark, sf_dir):
    """Lines of street-level addresses from tagged tokens."""
    rows = fixture(spark, [a[:3] for a in ADDRESSES], "tokens string, tags string, country string")
    lines = N.address_lines(F.split("tokens", " "), F.split("tags", " ").cast("array<int>"), F.col("country"))
    return rows.select("tokens", F.array_join(lines, "|").alias("lines"))


STREETS = [("address", "北京", "address_place"), ("address", "临江大道389号", "address"), ("address", "阳光花园", "address"), ("name", "北京", "name")]


@query(f"SELECT label, value, kept FROM {values(STREETS, 'label, value, kept')}")
def chinese_street_level(spark, sf_dir):
    """Chinese addresses that are mere places."""
    rows = fixture(spark, [s[:2] for s in STREETS], "label string, value string")
    return rows.select("label", "value", N.street_level_label(F.col("label"), F.col("value")).alias("kept"))


CLEAN = [
    ("PERSON", "zh-Hans", "陈 伟明", "陈伟明"), ("PERSON", "zh-Hans", "Chen", None), ("PERSON", "ko", "김 민수", "김민수"), ("PERSON", "vi", "Nguyễn Văn An", "Nguyễn Văn An"),
    ("PERSON", "vi", "Bertotti An", None), ("PERSON", "vi", "An", None), ("PERSON", "hi", "राम कुमार", "राम कुमार"), ("PERSON", "ms", "Aminah binti Ali", "Aminah binti Ali"),
    ("PERSON", "en", "Entity Smith", None), ("PERSON", "en", "J0hn", None), ("ADDRESS", "en", "[REDACTED] Rd", None), ("ACCOUNT", "en", "XXX1234", None), ("ACCOUNT", "en", "1234", "1234"),
    ("DOB", "en", "1980-01-02T00:00:00Z", "1980-01-02"), ("DOB", "en", "1980-01-02", "1980-01-02"), ("BUSINESS", "en", "OYHE", None), ("BUSINESS", "en", "Acme", "Acme"),
]


@query(f"SELECT label, lang, v, clean FROM {values(CLEAN, 'label, lang, v, clean')}")
def clean_values_by_language(spark, sf_dir):
    """Values checked by the rules of their label and language."""
    rows = fixture(spark, [c[:3] for c in CLEAN], "label string, lang string, v string")
    return rows.select("label", "lang", "v", N.clean_value_in(F.col("v"), F.col("label"), F.col("lang")).alias("clean"))
