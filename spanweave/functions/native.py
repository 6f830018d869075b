"""Rules of single languages as column expressions: birth cues, titles, dates, names, addresses (fixed rules)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanweave.functions import values as V
from spanweave.functions.text import cleaned_parts, is_latin

#: White space as Python's ``\\s`` has it; the whole text's end.
_S = r"[\s\x{1C}-\x{1F}\x{85}\p{Z}]"
_NOT_S = r"[^\s\x{1C}-\x{1F}\x{85}\p{Z}]"

BIRTH_BEFORE = (
    r"(?iu)(出生|生日|生于|生於|生年月日|誕生日|생년월일|생일|출생|जन्म|ngày sinh|sinh ngày|sinh năm|lahir|"
    r"kapanganakan|ipinanganak|kaarawan|الميلاد|ولد|مواليد|เกิด)[^.;|\t\n\p{Nd}。]{0,25}\z"
)
BIRTH_AFTER = rf"^{_S}*(生まれ|出生|生(?!效|产|產|成)|에 태어|년생|생(?![가-힣]))"


def native_birth_cue(text: Column, start: Column, end: Column) -> Column:
    """Whether a birth cue of English or a native one is before a date on its line, or a native one right after it."""
    from spanweave.operators.spans import line_before

    before = line_before(text, start)
    return before.rlike(V.BIRTH_CUE) | before.rlike(BIRTH_BEFORE) | F.substring(text, end + 1, F.lit(8)).rlike(BIRTH_AFTER)


_KO_TITLES = "고객|사장|선생|대표|팀장|과장|부장|차장|대리|주임|사원|이사|상무|전무|실장|본부장|지점장|어머|아버|할머|할아버|배우자|씨"


def strip_korean_title(name: Column) -> Column:
    """A Korean name without the titles and honorifics after it, however many; the first word always stays."""
    words = F.regexp_replace(name, rf"(?s)^({_NOT_S}.*?)(?:{_S}+(?:(?:{_KO_TITLES})님?|{_NOT_S}*님))+\z", "$1")
    return F.regexp_replace(words, rf"^({_NOT_S}+?)[님씨]+\z", "$1")


_TH_TITLE = rf"^((?:(?:รองศาสตราจารย์|ผู้ช่วยศาสตราจารย์|ศาสตราจารย์|ด็อกเตอร์|ดร\.|นางสาว|นาง|นาย|คุณ|พล\.?[ตอท]\.?{_NOT_S}*){_S}*)+)"


def thai_title_length(name: Column) -> Column:
    """By how much a Thai name's start moves past its titles; 0 if nothing else would be left."""
    size = F.length(F.regexp_extract(name, _TH_TITLE, 1))
    return F.when(size < F.length(name), size).otherwise(0)


_KO_DATE = rf"\p{{Nd}}{{4}}{_S}*년{_S}*\p{{Nd}}{{1,2}}{_S}*월{_S}*\p{{Nd}}{{1,2}}{_S}*일|\p{{Nd}}{{4}}[-./]{_S}?\p{{Nd}}{{1,2}}[-./]{_S}?\p{{Nd}}{{1,2}}|\p{{Nd}}{{6}}(?=-)"


def korean_date(phrase: Column) -> Column:
    """Struct ``start, end`` of the first date inside a phrase, in code points; null without one."""
    pattern = rf"(?s)^(.*?)({_KO_DATE})"
    start = F.length(F.regexp_extract(phrase, pattern, 1))
    end = start + F.length(F.regexp_extract(phrase, pattern, 2))
    return F.when(phrase.rlike(_KO_DATE), F.struct(start.alias("start"), end.alias("end")))


#: Tags of address tokens by number from 1; countries that write the postcode before the city.
ADDRESS_TAGS = [
    "house", "category", "near", "house_number", "road", "unit", "level", "staircase", "entrance", "po_box", "postcode", "suburb", "city_district", "city",
    "island", "state_district", "state", "country_region", "country", "world_region",
]
POSTCODE_FIRST = ["my", "vn", "de", "fr", "kr", "tw", "jp"]


def address_lines(tokens: Column, tags: Column, country: Column) -> Column:
    """Lines of a street-level address from tagged tokens; null for queries of places and for all that is coarser.

    ``tags`` are numbers into :data:`ADDRESS_TAGS`; other numbers have no part.
    """

    def has(name: str) -> Column:
        return F.array_contains(tags, ADDRESS_TAGS.index(name) + 1)

    def words(name: str) -> Column:
        kept = F.filter(tokens, lambda t, i: F.get(tags, i) == ADDRESS_TAGS.index(name) + 1)
        return F.when(has(name), F.array_join(kept, " "))

    def line(separator: str, *parts: Column) -> Column:
        return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), separator)

    specific = has("house_number") | has("postcode") | has("po_box") | has("unit") | has("level")
    street_level = (has("road") & specific) | (has("house") & has("road") & has("city"))
    city, code = words("city"), words("postcode")
    place = F.when(F.coalesce(country.isin(POSTCODE_FIRST), F.lit(False)), line(" ", code, city)).otherwise(line(" ", city, code))
    made = F.array(
        words("house"),
        F.nullif(line(" ", words("unit"), words("level"), words("house_number"), words("road")), F.lit("")),
        F.nullif(line(", ", words("suburb"), words("city_district")), F.lit("")),
        F.when((city != "") | (code != ""), place),
        words("state_district"), words("state"), words("country"),
    )
    return F.when(~has("category") & ~has("near") & street_level, F.array_compact(made))


#: Fixed pattern of what a register writes where it has nothing to say.
_JUNK = r"(?i)\[REDACTED\]|(?<=,)[\s\p{Z}]*-1[\s\p{Z}]*(?=,)|\bUnclassified\b"


def indian_parts(raw: Column) -> Column:
    """Parts of an Indian address as written, each once (case ignored); null unless it has three to eight, is Latin and has a PIN."""
    text = F.regexp_replace(F.regexp_replace(raw, _JUNK, ""), rf"{_S}+", " ")
    parts = F.transform(F.split(text, ","), lambda p: F.regexp_replace(p, r"^[ ,]+|[ ,]+\z", ""))
    kept = cleaned_parts(parts)
    return F.when(F.size(kept).between(3, 8) & is_latin(text) & text.rlike(r"\p{Nd}{6}"), kept)


ZH_STREET = r"[0-9０-９]|[路街道巷弄号號室楼樓栋棟层層幢座村镇鎮乡鄉]|大厦|大廈|小区|小區|花园|花園"


def street_level_label(label: Column, value: Column) -> Column:
    """``address`` becomes ``address_place`` where a Chinese address is no more than a place."""
    return F.when((label == "address") & ~value.rlike(ZH_STREET), "address_place").otherwise(label)


_NAMES = {
    "zh-Hans": r"[\x{4e00}-\x{9fff}·]{2,5}", "zh-Hant": r"[\x{4e00}-\x{9fff}·]{2,5}", "ja": r"[\x{3040}-\x{30ff}\x{4e00}-\x{9fff}・]{2,8}",
    "ko": r"[가-힣]{2,5}", "th": r"[\x{0e00}-\x{0e7f} ]{3,40}", "ar": r"[\x{0600}-\x{06ff} ]{3,40}", "hi": r"[\x{0900}-\x{097f} ]{3,40}",
}
_LATIN_NAME = r"[A-Za-zÀ-ÿĀ-žƠ-ưẠ-ỹ'.\- ]{3,40}"
_VI_VOWELS = "aàáảãạăằắẳẵặâầấẩẫậeèéẻẽẹêềếểễệiìíỉĩịoòóỏõọôồốổỗộơờớởỡợuùúủũụưừứửữựyỳýỷỹỵ"
_VI_SYLLABLE = rf"(?iu)^(ngh|ng|nh|ch|gh|gi|kh|ph|qu|th|tr|[bcdđghklmnpqrstvx])?[{_VI_VOWELS}]{{1,3}}(ch|ng|nh|[cmnpt])?\z"


def clean_value_in(value: Column, label: Column, lang: Column) -> Column:
    """A value for reuse in documents of a language, or null where it looks like noise of its source.

    Placeholders go; a person must be written in the language's script (Vietnamese: two to four syllables, Chinese,
    Japanese and Korean: without blanks); dates lose a time of day; a business of bare capitals goes.
    """
    dense = F.when(lang.isin("zh-Hans", "zh-Hant", "ja", "ko"), F.replace(value, F.lit(" "), F.lit(""))).otherwise(value)
    tokens = F.filter(F.split(value, rf"{_S}+"), lambda t: t != "")
    syllables = F.size(tokens).between(2, 4) & F.forall(tokens, lambda t: t.rlike(_VI_SYLLABLE))
    named = dense.rlike(rf"^{_LATIN_NAME}\z")
    for key, shape in _NAMES.items():
        named = F.when(lang == key, dense.rlike(rf"^{shape}\z")).otherwise(named)
    person = F.when(named & ((F.coalesce(lang, F.lit("")) != "vi") | syllables), dense)
    dated = F.regexp_replace(value, r"T\p{Nd}{2}:\p{Nd}{2}(:\p{Nd}{2})?(Z|[+-]\p{Nd}{2}:?\p{Nd}{2})?(?=\n?\z)", "")
    kept = F.when(label == "PERSON", person).when(label == "DOB", dated)
    kept = kept.when((label == "BUSINESS") & value.rlike(r"^[A-Z]{2,5}\z"), F.lit(None)).otherwise(value)
    return F.when(~value.rlike(r"(?U)[\[\]{}<>*#_]|\bEntity\b|\bXXX"), kept)


#: Formats with two-digit years or without a day, and their share.
SHORT_FORMATS = ["dd-MM-yy", "dd/MM/yy", "MM/dd/yy", "dd.MM.yy", "dd-MMM-yy", "MM/yy", "MM-yy", "MM/yyyy", "MMM-yy", "MMMM/yy", "MMMM yyyy"]
SHORT_SHARE = 0.25


def rendered_date_any(d: Column, chance: Column, pick: Column) -> Column:
    """A date in a short format where ``chance``, uniform in [0, 1), is below a quarter, else in a long one."""
    short = F.get(F.array(*(F.date_format(d, f) for f in SHORT_FORMATS)), F.pmod(pick, F.lit(len(SHORT_FORMATS))).cast("int"))
    return F.when(chance < SHORT_SHARE, short).otherwise(V.rendered_date(d, pick))
