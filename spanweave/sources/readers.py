"""Readers: JSON lines, Arrow-era Parquet, token-tagged text, frame files, mail, regulations, results; and sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanweave.functions.native import address_lines
from spanweave.functions.offsets import bound
from spanweave.functions.text import SPACE, clean_email, detokenized, is_latin, norm_ws
from spanweave.operators.corpus import capped
from spanweave.schema import LATENCY
from spanweave.sources.numbering import cut_after, cut_arrays, file_lines, headed_lines, held, running_total
from spanweave.sources.staged import arrays, xz_lines
from spanweave.sources.typed import leaves, loaded, read_configuration


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines by an explicit schema; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    df.write.partitionBy(*(by or [])).parquet(path)


def split_of(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split of a Parquet table that has a ``split`` column."""
    return spark.read.parquet(path).where(F.col("split") == split)


def prefix(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` rows by an order column (files have no order of their own)."""
    return rows.orderBy(order).limit(n)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, no, line``: text lines with their number, counted within each file; files are read by splits."""
    return file_lines(spark, path)


def tagged_sentences(rows: DataFrame, by: str = "path") -> DataFrame:
    """``by, sentence, tokens, tags`` from lines ``token<TAB>tag`` with blank lines between sentences."""
    marked = running_total(rows, by, (F.trim("line") == "").cast("int"), "sentence")
    cells = F.split("line", "\t")
    marked = marked.where("trim(line) <> ''").select(by, "sentence", F.struct("no", F.get(cells, F.lit(0)).alias("tok"), F.element_at(cells, -1).alias("tag")).alias("w"))
    grouped = marked.groupBy(by, "sentence").agg(F.array_sort(F.collect_list("w")).alias("w"))
    return grouped.select(by, "sentence", F.transform("w", lambda w: w["tok"]).alias("tokens"), F.transform("w", lambda w: w["tag"]).alias("tags"))


def sentence_arrays(lines: Column) -> Column:
    """:func:`tagged_sentences` of the array of a text's own lines, in order: ``sentence, tokens, tags``, without a shuffle."""

    def told(held: Column, breaks: Column, k: Column) -> Column:
        begin = F.coalesce(F.get(breaks, k - 1) + 1, F.lit(0))
        cells = F.transform(F.slice(held, begin + 1, F.coalesce(F.get(breaks, k), F.size(held)) - begin), lambda x: F.split(x, "\t"))
        return F.struct(k.cast("long").alias("sentence"), F.transform(cells, lambda c: F.get(c, F.lit(0))).alias("tokens"), F.transform(cells, lambda c: F.element_at(c, -1)).alias("tags"))

    def cut(held: Column) -> Column:
        blanks = F.filter(F.transform(held, lambda x, i: F.when(F.trim(x) == "", i)), lambda i: i.isNotNull())
        found = bound(blanks, lambda breaks: F.transform(F.sequence(F.lit(0), F.size(breaks)), lambda k: told(held, breaks, k)))
        return F.filter(found, lambda s: F.size(s["tokens"]) > 0)

    return bound(lines, cut)


def word_rows(rows: DataFrame, by: str = "path", least: int = 4) -> DataFrame:
    """``by, sentence, tokens, tags`` from one word a row: cut after final punctuation once a sentence has ``least`` words.

    Sentences are numbered by :func:`numbering.cut_after`, so a long document is cut by many tasks; documents stay apart.
    """
    numbered = cut_after(rows, by, F.col("tok").isin(*FINAL), least, "sentence")
    grouped = numbered.groupBy(by, "sentence").agg(F.array_sort(F.collect_list(F.struct("no", "tok", "tag"))).alias("w"))
    return grouped.select(by, "sentence", F.transform("w", lambda w: w["tok"]).alias("tokens"), F.transform("w", lambda w: w["tag"]).alias("tags"))


#: Words that end a sentence.
FINAL = (".", "!", "?", "؟")


def word_arrays(words: Column, least: int = 4) -> Column:
    """The words of a text as one array for each sentence, by the rule of :func:`word_rows`."""
    return cut_arrays(words, lambda w: w.isin(*FINAL), least)


def frames(rows: DataFrame, by: str = "path") -> DataFrame:
    """Sentence frames from lines: directives hold for the lines after them; comments and blank lines go.

    ``by, no, lang, cs, register, slice, template``; a written ``\\n`` in a template is a line break.
    """
    marks = {"lang": "#lang:", "cs": "#cs:", "register": "## register:", "slice": "## slice:"}
    said = {n: F.when(F.col("line").startswith(m), F.trim(F.substring("line", len(m) + 1, 1000))) for n, m in marks.items()}
    kept = held(rows, by, said).where(~F.col("line").startswith("#") & (F.trim("line") != ""))
    return kept.select(by, "no", "lang", "cs", "register", "slice", F.replace("line", F.lit("\\n"), F.lit("\n")).alias("template"))


def mails(rows: DataFrame, candidates: tuple[str, ...] = ("body", "text", "content", "message"), subject: str | None = "subject") -> DataFrame:
    """``text``: the first of some columns that exists, cleaned, after a line with the subject if there is one.

    A null body counts as empty. Without any of the columns a ``ValueError`` names them.
    """
    there = next((c for c in candidates if c in rows.columns), None)
    if there is None:
        raise ValueError(f"a mail table has one of the columns {', '.join(candidates)}")
    body = clean_email(F.coalesce(F.col(there), F.lit("")))
    if subject and subject in rows.columns:
        body = F.concat(F.when(F.coalesce(F.col(subject), F.lit("")) != "", F.concat(F.lit("Subject: "), F.col(subject), F.lit("\n"))).otherwise(F.lit("")), body)
    return rows.withColumn("text", norm_ws(body))


def tagged_arrays(rows: DataFrame, source: str, lang: str, tokens: str = "tokens", tags: str = "tags", names: list[str] | None = None, joiner: str = " ", key: str = "id") -> DataFrame:
    """``id, source, lang, text, spans`` of rows with token and tag arrays (tags as text, or as numbers into ``names``).

    Rows whose text is blank go. Languages without spaces take an empty ``joiner``.
    """
    said = F.col(tags)
    if names is not None:
        table = F.array(*map(F.lit, names))
        said = F.transform(tags, lambda t: F.get(table, t.cast("int")))
    seen = rf"[^{SPACE}]"
    # A filter on the text would build it twice; a blank joiner leaves it to the tokens whether the text is blank.
    plain = not joiner.strip()
    given = rows.where(F.exists(tokens, lambda t: t.rlike(seen))) if plain else rows
    made = given.select(F.concat_ws("-", F.lit(source), F.col(key).cast("string")).alias("id"), detokenized(F.col(tokens), said, joiner).alias("d"))
    made = made.select("id", F.lit(source).alias("source"), F.lit(lang).alias("lang"), "d.text", "d.spans")
    return made if plain else made.where(F.col("text").rlike(seen))


def span_rows(rows: DataFrame, source: str, lang: str, spans: str, start: str = "start", end: str = "end", label: str = "label", key: str = "id", text: str = "text") -> DataFrame:
    """``id, source, lang, text, spans`` of rows whose span structs name their fields otherwise (``a.b`` and ``a[0]`` reach inside).

    Null span arrays are empty.
    """

    def field(s: Column, path: str) -> Column:
        for step in path.replace("]", "").replace("[", ".").split("."):
            s = s[int(step)] if step.isdigit() else s[step]
        return s

    renamed = F.transform(spans, lambda s: F.struct(field(s, start).cast("int").alias("start"), field(s, end).cast("int").alias("end"), field(s, label).alias("label")))
    none = F.array().cast("array<struct<start:int,end:int,label:string>>")
    return rows.select(F.concat_ws("-", F.lit(source), F.col(key).cast("string")).alias("id"), F.lit(source).alias("source"), F.lit(lang).alias("lang"), F.col(text).alias("text"), F.coalesce(renamed, none).alias("spans"))


def held_out_split(rows: DataFrame, key: str = "id", seed: str = "0", tenths: int = 1) -> DataFrame:
    """``rows`` with ``split``: ``validation`` for so many tenths of the keys by their seeded md5, else ``train``."""
    digit = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % 10
    return rows.withColumn("split", F.when(digit < tenths, "validation").otherwise("train"))


def answers(rows: DataFrame, question: str = "input", answer: str = "output") -> DataFrame:
    """``text``: a question and its answer on two lines, each without white space at its ends; nulls count as empty."""
    strip = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), rf"^[{SPACE}]+|[{SPACE}]+\z", "")
    return rows.select(F.concat(strip(question), F.lit("\n"), strip(answer)).alias("text"))


def passages(rows: DataFrame, doc: str, number: str, text: str, order: str) -> DataFrame:
    """``doc, number, text``: each passage once; of repeats the last in ``order`` counts. The text begins with the number."""
    last = rows.groupBy(doc, number).agg(F.max_by(text, order).alias("text"))
    return last.select(doc, number, F.concat_ws(" ", F.col(number).cast("string"), "text").alias("text"))


def unique_texts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``text``: every different text of some columns, once; nulls go."""
    return rows.select(F.explode(F.array(*columns)).alias("text")).where("text IS NOT NULL").distinct()


def grouped_texts(rows: DataFrame, by: list[str], order: str, text: str = "text", joiner: str = "\n", head: Column | None = None) -> DataFrame:
    """``by, text``: the texts of a group in order, joined, after a headline of the group if given (articles, statements of a year)."""
    piece = F.struct(F.col(order).alias("k"), F.col(text).alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["t"]), joiner)
    found = rows.groupBy(*by).agg(joined.alias("text"))
    return found if head is None else found.withColumn("text", F.concat(head, F.lit("\n"), "text"))


def country_addresses(rows: DataFrame, countries: list[str], most: int, source: str, order: str = "pos") -> DataFrame:
    """``country, source, pos, lines`` of tagged address tokens ``country, tokens, tags, pos``: Latin street-level ones, at most so many a country."""
    latin = rows.where(F.col("country").isin(*countries)).where(is_latin(F.array_join("tokens", " ")))
    found = latin.select("country", F.lit(source).alias("source"), F.col(order).alias("pos"), address_lines(F.col("tokens"), F.col("tags"), F.col("country")).alias("lines"))
    return capped(found.where(F.size("lines") > 0), ["country"], ["pos"], most)


def configuration(spark: SparkSession, entries: dict | str) -> DataFrame:
    """``path, value``: the leaves of a nested configuration (or of the JSON file of that path), values as JSON; mappings
    under ``<<`` give defaults."""
    return leaves(spark, read_configuration(spark, entries) if isinstance(entries, str) else entries)


def write_packed(seqs: DataFrame, path: str, meta: dict) -> None:
    """Packed sequences as Parquet, and beside them one JSON line of settings and totals."""
    import json

    seqs.write.parquet(f"{path}/sequences")
    said = {**meta, "sequences": seqs.sparkSession.read.parquet(f"{path}/sequences").count()}
    seqs.sparkSession.createDataFrame([(json.dumps(said, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/meta")


def headed(rows: DataFrame, pattern: str, text: str = "text", look: int = 5000, head: int = 1500) -> DataFrame:
    """Rows whose normalised beginning matches a pattern."""
    return rows.where(F.substring(norm_ws(F.substring(text, 1, look)), 1, head).rlike(pattern))


def titled(rows: DataFrame, words: list[str], text: str = "text") -> DataFrame:
    """Rows whose first line has one of some words."""
    return rows.where(F.substring_index(text, "\n", 1).rlike("(?i)" + "|".join(words)))


def sections(rows: DataFrame, columns: list[str], keep: list[str], most: int) -> DataFrame:
    """One row for each section column that has text, cut to ``most`` characters."""
    long = rows.unpivot(keep, columns, "section", "text")
    return long.where("text IS NOT NULL AND text <> ''").withColumn("text", F.substring("text", 1, most))


def latency(spark: SparkSession, path: str) -> DataFrame:
    """A latency summary as tab-separated text with a header."""
    return spark.read.csv(path, sep="\t", header=True, schema=LATENCY)


class Registry:
    """Readers by name."""

    def __init__(self) -> None:
        self._readers: dict[str, Callable[..., DataFrame]] = {}

    def add(self, name: str, reader: Callable[..., DataFrame]) -> None:
        if name in self._readers:
            raise ValueError(f"a reader is already called {name}")
        self._readers[name] = reader

    def read(self, name: str, spark: SparkSession, **options) -> DataFrame:
        if name not in self._readers:
            raise KeyError(f"no reader is called {name}; there are {sorted(self._readers)}")
        return self._readers[name](spark, **options)

    def names(self) -> list[str]:
        return sorted(self._readers)


READERS = Registry()
READERS.add("jsonl", jsonl)
READERS.add("parquet", lambda spark, path: spark.read.parquet(path))
READERS.add("parquet_split", split_of)
READERS.add("lines", lines)
READERS.add("conll", lambda spark, path: tagged_sentences(lines(spark, path)))
READERS.add("frames", lambda spark, path: frames(lines(spark, path)))
READERS.add("latency", latency)
READERS.add("xz_lines", xz_lines)
READERS.add("arrays", arrays)
READERS.add("typed_split", loaded)


def _stored(shape: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A reader of a stored table (``path``, ``format``) that a function of rows brings into shape."""

    def read(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
        return shape(spark.read.format(format).load(path), **options)

    return read


for _name, _shape in {
    "tagged_arrays": tagged_arrays, "spans": span_rows, "mails": mails, "answers": answers, "passages": passages, "texts": unique_texts, "groups": grouped_texts,
    "addresses": country_addresses, "headed": headed, "titled": titled, "sections": sections, "held_out": held_out_split, "prefix": prefix,
}.items():
    READERS.add(_name, _stored(_shape))
READERS.add("words", lambda spark, path, least=4: word_rows(lines(spark, path).select("path", "no", F.get(F.split("line", "\t"), F.lit(0)).alias("tok"), F.element_at(F.split("line", "\t"), -1).alias("tag")).where("tok <> ''"), least=least))
