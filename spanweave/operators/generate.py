"""Labelled test documents from templates: values drawn by hash, text and exact spans built together.

Draws come from the md5 of a seed, the row's key and the place, so every engine and every run draws alike, and rows
are independent: generation is one map over keys, however many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.functions.offsets import bound
from spanweave.functions.text import indian_grouping, native_digits
from spanweave.functions.values import ordinal, rendered_pattern, weighted_choice

_EMPTY_SPANS = "array<struct<start:int,end:int,label:string>>"


def draw(seed: str, key: Column, place: Column | str, n: int) -> Column:
    """A whole number below ``n`` for a key and place."""
    place = F.lit(place) if isinstance(place, str) else place.cast("string")
    h = F.md5(F.concat_ws("|", F.lit(seed), key.cast("string"), place).cast("binary"))
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % n).cast("int")


def joined(parts: Column) -> Column:
    """``text`` and ``spans`` of an array of ``value, label``; parts without label are plain text."""
    start = F.struct(F.lit("").alias("text"), F.array().cast(_EMPTY_SPANS).alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        at = F.length(acc["text"])
        span = F.struct(at.alias("start"), (at + F.length(p["value"])).alias("end"), p["label"].alias("label"))
        spans = F.when(p["label"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(span)))
        return F.struct(F.concat(acc["text"], p["value"]).alias("text"), spans.alias("spans"))

    return F.aggregate(parts, start, step)


_SLOT = r"\{[A-Z]+\}"


def filled(frames: DataFrame, pools: dict[str, list[str]], seed: str = "0", key: str = "id", template: str = "template") -> DataFrame:
    """``frames`` with ``text`` and ``spans``: each slot ``{LABEL}`` becomes a value of its pool, and a span.

    Slots of labels without a pool stay as they stand. Null templates give null.
    """
    plain, slots = F.split(F.col(template), _SLOT, -1), F.regexp_extract_all(F.col(template), F.lit(_SLOT), F.lit(0))

    def value(slot: Column, k: Column) -> Column:
        name = F.substring(slot, F.lit(2), F.length(slot) - 2)
        out = F.struct(slot.alias("value"), F.lit(None).cast("string").alias("label"))
        for label, pool in pools.items():
            pick = F.get(F.array(*map(F.lit, pool)), draw(seed, F.col(key), F.concat(name, k.cast("string")), len(pool)))
            out = F.when(name == label, F.struct(pick.alias("value"), name.alias("label"))).otherwise(out)
        return out

    none = F.lit(None).cast("string")
    parts = F.flatten(F.transform(plain, lambda p, k: F.when(k < F.size(slots), F.array(F.struct(p.alias("value"), none.alias("label")), value(F.get(slots, k), k))).otherwise(F.array(F.struct(p.alias("value"), none.alias("label"))))))
    return frames.withColumn("__made__", joined(parts)).select("*", "__made__.text", "__made__.spans").drop("__made__")


def _keys(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n)


#: Small pools of invented values.
POOLS = {
    "PERSON": ["Ana Ruiz", "Jo Lee", "Mei Tan", "Omar Aziz", "Lena Vogt", "Nguyễn An", "Priya Nair"],
    "BUSINESS": ["Harbour Capital Pte. Ltd.", "Norden Werke GmbH", "Sol y Mar S.A.", "Blue Fir LLC"],
    "ADDRESS": ["12 Main St, Springfield", "8 Elm Road, #04-11, Singapore 049315", "Lindenweg 7, 50667 Köln"],
    "EMAIL": ["ana@example.com", "j.lee@example.org", "office@example.net"],
    "PHONE": ["+1 (555) 010-0199", "+65 6123 4567", "+49 30 901820"],
}
_FIELDS = [("Name", "PERSON"), ("Company", "BUSINESS"), ("Address", "ADDRESS"), ("E-mail", "EMAIL"), ("Phone", "PHONE"), ("Account", "ACCOUNT")]
_STYLES = [": ", " - ", " = ", ":\n"]


def _part(value: Column | str, label: str | None = None) -> Column:
    value = F.lit(value) if isinstance(value, str) else value
    return F.struct(value.alias("value"), F.lit(label).cast("string").alias("label"))


def _pooled(label: str, seed: str, key: Column) -> Column:
    if label == "ACCOUNT":
        return rendered_pattern("####-####-####", F.concat(F.lit(f"{seed}|"), key.cast("string")))
    pool = POOLS[label]
    return F.get(F.array(*map(F.lit, pool)), draw(seed, key, label, len(pool)))


def forms(keys: DataFrame, seed: str = "form", held_out: bool = False) -> DataFrame:
    """``id, text, spans`` for every ``id``: forms of fields on lines. Held-out forms use separators that the others never do."""
    key, styles = F.col("id"), _STYLES[2:] if held_out else _STYLES[:2]
    style = F.get(F.array(*map(F.lit, styles)), draw(seed, key, "style", len(styles)))
    parts = []
    for name, label in _FIELDS:
        line = F.array(_part(F.concat(F.lit(name), style)), _part(_pooled(label, seed, key), label), _part("\n"))
        parts.append(F.when(draw(seed, key, f"has {name}", 3) > 0, line).otherwise(F.array().cast("array<struct<value:string,label:string>>")))
    made = joined(F.flatten(F.array(*parts)))
    return keys.withColumn("m", made).select("id", "m.text", "m.spans")


def form_records(spark: SparkSession, n: int, seed: str = "form", held_out: bool = False) -> DataFrame:
    """:func:`forms` of the first ``n`` numbers."""
    return forms(_keys(spark, n), seed, held_out)


def addresses(keys: DataFrame, seed: str = "address") -> DataFrame:
    """``id, text, spans`` for every ``id``: one address in one of several layouts, street, place and postcode drawn apart."""
    key = F.col("id")
    street = F.concat(rendered_pattern("[123456789]#", F.concat(F.lit(seed), key.cast("string"))), F.lit(" "), F.get(F.array(*map(F.lit, ["Elm St", "Oak Road", "High Street", "Mill Lane"])), draw(seed, key, "street", 4)))
    place = F.get(F.array(*map(F.lit, ["Springfield", "Leeds", "Austin", "Cork"])), draw(seed, key, "place", 4))
    code = rendered_pattern("#####", F.concat(F.lit(f"{seed}|code|"), key.cast("string")))
    forms = [
        F.concat(street, F.lit(", "), place, F.lit(" "), code), F.concat(street, F.lit("\n"), place, F.lit(", "), code), F.concat(street, F.lit(",\n"), place, F.lit("\n"), code), F.concat(F.lit("Unit 4, "), street, F.lit(", "), place),
    ]
    lead = F.get(F.array(*map(F.lit, ["Ship to: ", "Registered office\n", "I live at ", ""])), draw(seed, key, "lead", 4))
    value = F.get(F.array(*forms), draw(seed, key, "form", len(forms)))
    made = joined(F.array(_part(lead), _part(value, "ADDRESS"), _part(F.when(draw(seed, key, "end", 2) == 0, ".").otherwise("\nThank you"))))
    return keys.withColumn("m", made).select("id", "m.text", "m.spans")


def address_records(spark: SparkSession, n: int, seed: str = "address") -> DataFrame:
    """:func:`addresses` of the first ``n`` numbers."""
    return addresses(_keys(spark, n), seed)


def lookalikes(keys: DataFrame, seed: str = "look") -> DataFrame:
    """``id, text, spans, negs`` for every ``id``: codes, amounts and dates that resemble entities; all spans are negatives."""
    key = F.col("id")
    k = F.concat(F.lit(f"{seed}|"), key.cast("string"))
    amount = F.concat(F.lit("USD "), F.format_number(draw(seed, key, "amount", 10**7), 0))
    kinds = [("Order no. ", rendered_pattern("AA-######", k), "code"), ("Total ", amount, "amount"), ("Due ", F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), draw(seed, key, "day", 2000)), "dd/MM/yyyy"), "date"), ("Ticket ", rendered_pattern("############", k), "code")]
    made = [joined(F.array(_part(cue), _part(value, label), _part(" noted"))) for cue, value, label in kinds]
    rows = keys.withColumn("m", F.get(F.array(*made), draw(seed, key, "kind", len(made))))
    return rows.select("id", "m.text", F.array().cast(_EMPTY_SPANS).alias("spans"), F.col("m.spans").alias("negs"))


def lookalike_records(spark: SparkSession, n: int, seed: str = "look") -> DataFrame:
    """:func:`lookalikes` of the first ``n`` numbers."""
    return lookalikes(_keys(spark, n), seed)


def _prime_from(n: int) -> int:
    while n < 2 or any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def grid_plan(spark: SparkSession, factors: dict[str, list[str]], least: int) -> DataFrame:
    """``row`` and a column for each factor: rows of values such that every pair of values of two factors occurs ``least``
    times at least.

    The rows are an orthogonal array over a prime p not below the most values of a factor and the factors less one: row
    number p a + b has the level a k + b (mod p) in column k, and a in column p, so two columns have each pair of levels
    once. Levels beyond a factor's values are folded onto them, from another value on in each round. A row follows from
    its number alone: no state, no loop, any number of tasks.
    """
    if not factors or any(not v for v in factors.values()):
        raise ValueError("every factor needs a value")
    p = _prime_from(max(max(map(len, factors.values())), len(factors) - 1))
    n = F.col("row")
    turn, a, b = F.floor(n / (p * p)), F.floor(n / p) % p, n % p
    rows = spark.range(least * p * p).withColumnRenamed("id", "row")
    levels = {name: a if k == p else (a * k + b) % p for k, name in enumerate(factors)}
    # In each round the levels are moved by one, so that folding doubles others.
    return rows.select("row", *(F.get(F.array(*map(F.lit, factors[name])), ((level + turn) % p % len(factors[name])).cast("int")).alias(name) for name, level in levels.items()))


def local_date(d: Column, lang: Column) -> Column:
    """A date as a language writes it: Buddhist years in Thai, Minguo years in traditional Chinese, native digits in Hindi and Arabic."""
    y, m, day = F.year(d), F.month(d), F.dayofmonth(d)
    iso, slash = F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "dd/MM/yyyy")
    said = lambda *p: F.concat(*(x.cast("string") if isinstance(x, Column) else F.lit(x) for x in p))
    return (
        F.when(lang == "th", said(F.date_format(d, "dd/MM/"), y + 543))
        .when(lang == "zh-Hant", said("民國", y - 1911, "年", m, "月", day, "日"))
        .when(lang.isin("zh-Hans", "ja"), said(y, "年", m, "月", day, "日"))
        .when(lang == "ko", said(y, "년 ", m, "월 ", day, "일"))
        .when(lang == "hi", native_digits(slash, "०१२३४५६७८९"))
        .when(lang == "ar", native_digits(slash, "٠١٢٣٤٥٦٧٨٩"))
        .when(lang == "vi", said("ngày ", day, " tháng ", m, " năm ", y))
        .when(lang == "en", said(ordinal(day), " ", F.date_format(d, "MMMM yyyy")))
        .otherwise(iso)
    )


def local_amount(n: Column, lang: Column) -> Column:
    """A whole amount grouped as a language groups it."""
    return F.when(lang == "hi", indian_grouping(n)).when(lang.isin("de", "id", "vi"), F.replace(F.format_number(n, 0), F.lit(","), F.lit("."))).otherwise(F.format_number(n, 0))


#: Currency marks by language: a code and a sign; languages that group by dots.
CURRENCIES = {
    "en": ("USD", "$"), "zh-Hans": ("CNY", "¥"), "zh-Hant": ("TWD", "NT$"), "ja": ("JPY", "¥"), "ko": ("KRW", "₩"), "hi": ("INR", "₹"),
    "ar": ("AED", "د.إ"), "th": ("THB", "฿"), "vi": ("VND", "₫"), "ms": ("MYR", "RM"), "id": ("IDR", "Rp"), "tl": ("PHP", "₱"),
}
DOTTED = ("id", "vi")
#: Made-up companies: name, code, exchange, suffix; and institutions: name, jurisdiction, patterns of accounts, weight.
COMPANIES = [("Alder Marine", "ALDR", "XSES", ".SI"), ("Birch Foods", "7411", "XTKS", ".T"), ("Cedar Optics", "CDO", "XNAS", ""), ("Dune Rail", "0912", "XHKG", ".HK")]
INSTITUTIONS = [("Harbour Bank", "SG", ["###-#####-#", "##########"], 3.0), ("Lotus Bank", "VN", ["##############"], 1.0), ("Crane Trust", "JP", ["#######", "###-#######"], 2.0)]
COUNTRY_CODES = ["SG", "HK", "GB", "US", "CH", "MY", "IN"]


def _one(options: list[str], seed: str, key: Column, place: str) -> Column:
    return F.get(F.array(*map(F.lit, options)), draw(seed, key, place, len(options)))


def _seed(seed: str, key: Column, place: str) -> Column:
    return F.concat_ws("|", F.lit(seed), key.cast("string"), F.lit(place))


def amount_value(seed: str, key: Column, lang: Column) -> Column:
    """An amount of three to eight digits in a language's currency, after its code or sign."""
    sizes = [(100, 9_900), (10_000, 990_000), (1_000_000, 99_000_000)]
    n = F.get(F.array(*(draw(seed, key, f"amount{k}", span) + low for k, (low, span) in enumerate(sizes))), draw(seed, key, "size", len(sizes)))
    shown = F.format_number(n, 0)
    shown = F.when(lang.isin(*DOTTED), F.replace(shown, F.lit(","), F.lit("."))).otherwise(shown)
    table = lambda k: F.coalesce(*(F.when(lang == name, F.lit(marks[k])) for name, marks in CURRENCIES.items()), F.lit(CURRENCIES["en"][k]))
    return F.when(draw(seed, key, "form", 2) == 0, F.concat(table(0), F.lit(" "), shown)).otherwise(F.concat(table(1), shown))


def isin_value(seed: str, key: Column) -> Column:
    """A securities number: country, nine letters or digits, a digit."""
    return F.concat(_one(COUNTRY_CODES, seed, key, "isin"), rendered_pattern("XXXXXXXXX#", _seed(seed, key, "isin")))


def bank_code(seed: str, key: Column) -> Column:
    """A bank identifier: four letters, country, place, and at times a branch."""
    place = F.when(draw(seed, key, "branch", 2) == 0, rendered_pattern("AX", _seed(seed, key, "place"))).otherwise(rendered_pattern("AXXXX", _seed(seed, key, "place")))
    return F.concat(rendered_pattern("AAAA", _seed(seed, key, "bank")), _one(COUNTRY_CODES, seed, key, "bank"), place)


def account_value(seed: str, key: Column, place: str, institution: Column) -> Column:
    """An account number by one of an institution's patterns."""
    out = None
    for k, (_, _, patterns, _) in enumerate(INSTITUTIONS):
        # Only the pattern that is drawn is rendered.
        pick, value = draw(seed, key, f"{place}|pattern", len(patterns)), None
        for i, p in enumerate(patterns):
            made = rendered_pattern(p, _seed(seed, key, f"{place}|{k}"))
            value = F.when(pick == i, made) if value is None else value.when(pick == i, made)
        out = F.when(institution == k, value) if out is None else out.when(institution == k, value)
    return out


def institution_of(seed: str, key: Column, jurisdiction: str | None = None) -> Column:
    """The number of an institution drawn by weight; those of a jurisdiction count threefold."""
    weights = [w * (3 if j == jurisdiction else 1) for _, j, _, w in INSTITUTIONS]
    return weighted_choice([str(k) for k in range(len(weights))], weights, draw(seed, key, "institution", 10_000) / F.lit(10_000.0)).cast("int")


def reference_value(seed: str, key: Column) -> Column:
    """A reference number with as many digits as an account has."""
    digits = F.regexp_replace(account_value(seed, key, "ref", institution_of(seed, key)), "[^0-9]", "")
    return F.concat(_one(["TT", "REF-", "", "TXN", "INV-"], seed, key, "ref"), digits)


def ticker_value(seed: str, key: Column) -> Column:
    """A listed company: exchange and code, code and suffix, name with both, a code of letters alone, or the name."""
    form, out = draw(seed, key, "ticker", 5), None
    pick = draw(seed, key, "company", len(COMPANIES))
    for k, (name, code, exchange, suffix) in enumerate(COMPANIES):
        forms = [f"{exchange}: {code}", f"{code}{suffix}" if suffix else name, f"{name} ({exchange}: {code})", name if code.isdigit() else code, name]
        value = F.get(F.array(*map(F.lit, forms)), form)
        out = F.when(pick == k, value) if out is None else out.when(pick == k, value)
    return out


def account_phrase(seed: str, key: Column, most: int = 3, jurisdiction: str | None = None) -> Column:
    """Struct ``text, spans``: a cue, one to ``most`` accounts of one institution, and its name at times."""
    known = F.struct(institution_of(seed, key, jurisdiction).alias("institution"), (draw(seed, key, "many", most) + 1).alias("many"))
    return bound(known, lambda k: _phrase(seed, key, most, k["institution"], k["many"]))


def _phrase(seed: str, key: Column, most: int, institution: Column, many: Column) -> Column:
    cue = F.when(many == 1, _one(["account", "A/C no."], seed, key, "cue")).otherwise(_one(["accounts", "A/C nos."], seed, key, "cue"))
    name = F.get(F.array(*(F.lit(n) for n, *_ in INSTITUTIONS)), institution)
    named = draw(seed, key, "named", 10) < 4
    none = F.array().cast("array<struct<value:string,label:string>>")
    parts = [F.array(_part(F.concat(cue, F.lit(" "))))]
    for k in range(most):
        link = F.when(many == k + 1, F.lit(" and ")).otherwise(F.lit(", "))
        value = _part(account_value(seed, key, f"account{k}", institution), "ACCOUNT")
        own = F.array(value) if k == 0 else F.array(_part(link), value)
        parts.append(F.when(many > k, own).otherwise(none))
    tail = F.array(_part(" ("), _part(name, "BUSINESS"), _part(")"))
    parts.append(F.when(named, tail).otherwise(none))
    return joined(F.concat(*parts))
