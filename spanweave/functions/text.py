"""Text functions as column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanweave.functions.offsets import bound

#: White space of every script, inside a character class.
SPACE = r"\s\x{1C}-\x{1F}\x{85}\p{Z}"

#: Fixed ranges: letters of each script, in the order in which a letter is tested.
SCRIPTS = {
    "hangul": r"\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3130}-\x{318F}",
    "kana": r"\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{FF66}-\x{FF9F}",
    "han": r"\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}",
    "devanagari": r"\x{0900}-\x{097F}",
    "arabic": r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{FB50}-\x{FEFF}",
    "thai": r"\x{0E00}-\x{0E7F}",
    "latin": r"\p{IsLatin}",
}
_ALL = "".join(SCRIPTS.values())


def norm_ws(text: Column) -> Column:
    """CR becomes LF, blanks and no-break spaces one space, three and more line breaks two; ends are stripped."""
    one = F.regexp_replace(F.replace(text, F.lit("\r"), F.lit("\n")), "[ \\t\u00a0]+", " ")
    two = F.regexp_replace(one, r"\n\s*\n\s*\n+", "\n\n")
    return F.regexp_replace(two, r"^\s+|\s+$", "")


def split_long(text: Column, limit: int = 20000) -> Column:
    """Parts of a text, packed greedily from paragraphs.

    A text within the limit stays whole. A paragraph is cut to the limit, but counts by its full length and two.
    """
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("done"), empty.alias("open"), F.lit(0).alias("size"))

    def step(acc: Column, para: Column) -> Column:
        full = (acc["size"] + F.length(para) > limit) & (F.size(acc["open"]) > 0)
        done = F.when(full, F.concat(acc["done"], F.array(F.array_join(acc["open"], "\n\n")))).otherwise(acc["done"])
        opened = F.concat(F.when(full, empty).otherwise(acc["open"]), F.array(F.substring(para, 1, limit)))
        size = F.when(full, F.lit(0)).otherwise(acc["size"]) + F.length(para) + 2
        return F.struct(done.alias("done"), opened.alias("open"), size.alias("size"))

    parts = F.aggregate(F.split(text, "\n\n"), start, step, lambda a: F.concat(a["done"], F.array(F.array_join(a["open"], "\n\n"))))
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(parts)


#: Fixed patterns of mail: what begins quoted text, and header fields.
_QUOTE = r"(?is)(?:-{3,}\s*Original Message\s*-{3,}|-{3,}\s*Forwarded by|(?m:^>)|(?m:^)From:[^\n]*\nSent:).*"
_HEADER = r"(?im)^(?:Message-ID|Date|From|To|Cc|Bcc|Subject|Mime-Version|Content-Type|Content-Transfer-Encoding|X-[A-Za-z0-9_-]+):[^\n]*$"


def clean_email(body: Column) -> Column:
    """A mail's own text: cut at the first quote, without header lines."""
    return F.regexp_replace(F.regexp_replace(body, _QUOTE, ""), _HEADER, "")


def script_counts(text: Column) -> Column:
    """Struct of letters by script; ``other`` has those of no listed one."""
    letters = F.regexp_replace(text, r"[^\p{L}]", "")
    fields = [(F.length(letters) - F.length(F.regexp_replace(letters, f"[{r}]", ""))).alias(k) for k, r in SCRIPTS.items()]
    return F.struct(*fields, F.length(F.regexp_replace(letters, f"[{_ALL}]", "")).alias("other"), F.length(letters).alias("letters"))


def script_lang(counts: Column) -> Column:
    """The language that a script stands for; ``latin`` and ``zh`` need more; null without letters."""
    n = counts["letters"]
    out = F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(None)).when((counts["kana"] >= 2) | ((counts["kana"] > 0) & (counts["kana"] >= 0.05 * n)), "ja")
    for script, lang in (("hangul", "ko"), ("thai", "th"), ("arabic", "ar"), ("devanagari", "hi"), ("han", "zh")):
        out = out.when(counts[script] >= 0.2 * n, lang)
    return out.otherwise("latin")


def block_lang(text: Column) -> Column:
    """:func:`script_lang` of a text; one whose letters are all of ASCII is not counted script by script."""

    def of(letters: Column) -> Column:
        counts = {k: F.length(letters) - F.length(F.regexp_replace(letters, f"[{r}]", "")) for k, r in SCRIPTS.items()}
        told = script_lang({**counts, "letters": F.length(letters)})
        return F.when(letters == "", F.lit(None).cast("string")).when(~letters.rlike("[^A-Za-z]"), F.lit("latin")).otherwise(told)

    return bound(F.regexp_replace(text, r"[^\p{L}]", ""), of)


def is_latin(text: Column) -> Column:
    """Whether more than 95 % of the letters are ASCII; false without letters."""
    ascii_, all_ = F.length(F.regexp_replace(text, "[^A-Za-z]", "")), F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return (all_ > 0) & (ascii_ > 0.95 * all_)


def script_class(text: Column) -> Column:
    """``nonlatin`` if a letter is not Latin or a digit not ASCII."""
    return F.when(text.rlike(r"[\p{Nd}&&[^0-9]]|[\p{L}&&[^\p{IsLatin}]]"), "nonlatin").otherwise("latin")


def script_of(c: Column) -> Column:
    """Coarse script class of one character."""
    out = F.when(c.rlike(r"\p{Nd}"), "digit")
    for name in ("han", "kana", "hangul", "thai"):
        out = out.when(c.rlike(f"[{SCRIPTS[name]}]"), name)
    return out.otherwise("other")


def segments(text: Column) -> Column:
    """Blocks at blank lines, each with the blank lines that follow it; together they are the text."""
    gap = r"\n\s*\n"
    blocks = F.zip_with(F.split(text, gap, -1), F.regexp_extract_all(text, F.lit(gap), F.lit(0)), lambda block, blank: F.concat(block, F.coalesce(blank, F.lit(""))))
    return F.when(text == "", F.array(F.lit(""))).otherwise(F.filter(blocks, lambda b: b != ""))


def visible_breaks(text: Column) -> Column:
    """Line breaks and tabs as visible marks, CR as a space."""
    return F.replace(F.replace(F.replace(text, F.lit("\n"), F.lit(" ¶ ")), F.lit("\t"), F.lit(" | ")), F.lit("\r"), F.lit(" "))


def visible_back_map(text: Column) -> Column:
    """For every character of :func:`visible_breaks` the place it came from."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.flatten(F.transform(chars, lambda c, i: F.array_repeat(i, F.when(c.isin("\n", "\t"), 3).otherwise(1))))


def skeleton(template: Column) -> Column:
    """A template with slots reduced to their type, digits to ``#`` and white space to one space, in lower case."""
    typed = F.regexp_replace(template, r"\{([A-Za-z_]+)[^}]*\}", "{$1}")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(typed, "[0-9]+", "#"), r"\s+", " ")))


#: Marks that take no joiner before them, and marks that take none after.
_CLOSERS, _OPENERS = ".,!?;:%)]}」』）、。，！？；：", "([{「『（"


def detokenized(tokens: Column, tags: Column | None = None, joiner: str = " ") -> Column:
    """Struct ``text, spans`` of tokens with tags: the text joined, and the spans ``start, end, label`` of the tags.

    Empty tokens are skipped. No joiner stands before closing marks or after opening ones. An inside tag goes on with
    an open span of its label, any other begins one; a blank token with an inside tag keeps the span open.
    """
    tags = F.transform(tokens, lambda t: F.lit("O")) if tags is None else tags
    pairs = F.filter(F.arrays_zip(tokens.alias("tok"), tags.alias("tag")), lambda p: p["tok"] != "")
    blank = lambda p: ~p["tok"].rlike(rf"[^{SPACE}]")

    def piece(p: Column) -> Column:
        named, inside = p["tag"].rlike("^[BI]-"), F.coalesce(p["tag"].startswith("I-"), F.lit(False))
        return F.struct(
            p["tok"].alias("tok"), (F.instr(F.lit(_CLOSERS), F.substring(p["tok"], 1, 1)) > 0).alias("closes"), (F.instr(F.lit(_OPENERS), F.substring(p["tok"], -1, 1)) > 0).alias("opens"),
            F.when(named & ~blank(p), F.substring(p["tag"], 3, 1 << 30)).alias("label"), inside.alias("inside"), (inside & blank(p)).alias("open"),
        )

    none = F.array().cast("array<struct<tok:string,closes:boolean,opens:boolean,label:string,inside:boolean,open:boolean>>")
    return _told(F.coalesce(F.transform(pairs, piece), none), F.lit(joiner))


_SPANS = T.ArrayType(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()).add("label", T.StringType()))


@F.arrow_udf(T.StructType().add("text", T.StringType()).add("spans", _SPANS))
def _told(pieces: pa.Array, joiner: pa.Array) -> pa.Array:
    """Texts of tokens and their spans: a running sum over a whole batch, and runs of labelled tokens that go on."""
    sizes = pc.list_value_length(pieces).to_numpy(zero_copy_only=False)
    flat = pieces.flatten()
    rows = np.concatenate([[0], np.cumsum(sizes)])
    row = np.repeat(np.arange(len(sizes)), sizes)
    tok, label = flat.field("tok"), flat.field("label")
    closes, opens, inside, kept = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("closes", "opens", "inside", "open"))
    begins = np.zeros(len(flat), bool)
    begins[rows[:-1][sizes > 0]] = True
    glued = begins | closes | np.concatenate([[True], opens])[:-1].astype(bool)
    said = pc.binary_join_element_wise(pc.if_else(pa.array(glued), "", joiner.take(pa.array(row))), tok, "")
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(rows, pa.int32()), said), "")
    upto = np.concatenate([[0], np.cumsum(pc.utf8_length(said).to_numpy(zero_copy_only=False).astype(np.int64))])
    end = upto[1:] - upto[rows[:-1]][row]
    start = end - pc.utf8_length(tok).to_numpy(zero_copy_only=False)
    code = pc.fill_null(label.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    # The last piece before each that does not merely keep a span open says which is open.
    place = np.arange(len(code))
    last = np.concatenate([[-1], np.maximum.accumulate(np.where(kept, -1, place))])[:-1] if len(code) else place
    known = np.maximum(last, 0)
    on = inside & (code >= 0) & (last >= 0) & (row[known] == row) & (code[known] == code)
    named = np.flatnonzero(code >= 0)
    first = np.flatnonzero(~on[named])
    begin, close = named[first], named[np.append(first, len(named))[1:] - 1]
    cuts = np.concatenate([[0], np.cumsum(np.bincount(row[begin], minlength=len(sizes)))])
    spans = pa.StructArray.from_arrays([pa.array(start[begin], pa.int32()), pa.array(end[close], pa.int32()), label.take(pa.array(begin))], ["start", "end", "label"])
    return pa.StructArray.from_arrays([text, pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), spans)], ["text", "spans"])


def zh_variant(text: Column, simple: str, traditional: str) -> Column:
    """``zh-Hant`` if more characters are traditional forms than simple ones, else ``zh-Hans``.

    The table of forms is not public offline, so it is given: two strings of the same length, character by character.
    """
    if len(simple) != len(traditional):
        raise ValueError("both strings need a character for each form")
    size = F.length(text)
    old = size - F.length(F.translate(text, traditional, ""))
    new = size - F.length(F.translate(text, simple, ""))
    return F.when(old > new, "zh-Hant").otherwise("zh-Hans")


def native_digits(text: Column, digits: str) -> Column:
    """ASCII digits as those of another script (``digits`` from zero to nine)."""
    return F.translate(text, "0123456789", digits)


def indian_grouping(n: Column) -> Column:
    """A whole number with commas after three digits, then after every two."""
    s = n.cast("string")
    head, tail = F.substring(s, F.lit(1), F.greatest(F.length(s) - 3, F.lit(0))), F.right(s, F.lit(3))
    pairs = F.reverse(F.regexp_replace(F.reverse(head), r"([0-9]{2})(?=[0-9])", "$1,"))
    return F.when(F.length(s) <= 3, s).otherwise(F.concat(pairs, F.lit(","), tail))


def joined_address(parts: Column, separator: str) -> Column:
    """Address parts with a separator, which is not doubled where a part already ends with a comma."""

    def step(acc: Column, p: Column) -> Column:
        sep = F.when(acc.rlike(r"[,，]\s*$"), F.lit(" ")).otherwise(F.lit(separator))
        return F.when(acc == "", p).when(p == "", acc).otherwise(F.concat(acc, sep, p))

    return F.aggregate(parts, F.lit(""), step)


def cleaned_parts(parts: Column) -> Column:
    """Address parts without repeats (case ignored, the first stays) and blanks."""
    lowered = F.transform(parts, lambda p: F.lower(F.trim(p)))
    return F.filter(parts, lambda p, i: (F.trim(p) != "") & (F.array_position(lowered, F.lower(F.trim(p))) == i + 1))


def parsed_spans(raw: Column) -> Column:
    """Spans given as JSON text, also with single quotes; null and blank text give none."""
    kind = "array<struct<start:int,end:int,label:string>>"
    found = F.from_json(raw, kind, {"allowSingleQuotes": "true"})
    return F.coalesce(found, F.array().cast(kind))


def in_sentence(cue: Column) -> Column:
    """A form's cue as it stands inside a sentence: its first letter small, unless the first word is in capitals."""
    first = F.regexp_extract(cue, rf"^[{SPACE}]*([^{SPACE}]+)", 1)
    short = (F.length(first) > 1) & (first == F.upper(first)) & (first != F.lower(first))
    return F.when(short, cue).otherwise(F.concat(F.lower(F.substring(cue, 1, 1)), F.substring(cue, 2, 1 << 30)))


def capitalised(text: Column, spans: Column) -> Column:
    """``text`` with a capital first letter, unless a span begins there; the length must not change."""
    big = F.upper(F.substring(text, 1, 1))
    keep = F.exists(spans, lambda s: s["start"] == 0) | (F.length(big) != 1)
    return F.when(keep, text).otherwise(F.concat(big, F.substring(text, 2, 1 << 30)))
