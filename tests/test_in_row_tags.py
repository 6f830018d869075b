"""Tags and words of a text's own tokens, against the same rules over rows, and without a shuffle."""

import random

import pytest
from pyspark.sql import functions as F

from spanweave.functions.offsets import matches
from spanweave.operators import spans as S
from spanweave.plans.all_queries import QUERIES
from spanweave.sources import readers as R

TEXTS = ["", "  ", "Ab1, c\tdé (東京 タワー)ไทย x", "a" * 3, "12:30 . . b-c", " ".join(f"w{i}" for i in range(200))]


def tokens(spark):
    rng = random.Random(3)
    rows = []
    for k, text in enumerate(TEXTS):
        n = len([t for t in text.replace("\t", " ").split(" ") if t])
        rows.append((k, text, [rng.choice([None, "O", "B-X", "I-X", "I-Y", "B-Y"]) for _ in range(n)], [rng.choice([True, False, False, None]) for _ in range(n)]))
    return spark.createDataFrame(rows, "doc_id long, text string, tags array<string>, firsts array<boolean>").withColumn("toks", matches(F.col("text"), S.TOKEN))


def same(left, right):
    assert sorted(map(repr, (tuple(r) for r in left.collect()))) == sorted(map(repr, (tuple(r) for r in right.collect())))


def test_arrays_give_what_rows_give(spark):
    held = tokens(spark)
    rows = held.select("doc_id", F.posexplode(F.arrays_zip("toks", "tags", "firsts")).alias("i", "x"))
    rows = rows.select("doc_id", "i", F.col("x.toks.start").alias("s"), F.col("x.toks.end").alias("e"), F.col("x.toks.value").alias("tok"), F.col("x.tags").alias("tag"), F.col("x.firsts").alias("first"))
    spans = held.select("doc_id", F.explode(S.bio_spans(F.col("toks"), F.col("tags"))).alias("x")).select("doc_id", "x.start", "x.end", "x.label")
    same(spans, S.bio_decoded(rows).select("doc_id", "start", "end", "label"))
    items = F.zip_with("firsts", "tags", lambda first, tag: F.struct(first.alias("first"), tag.alias("tag")))
    same(held.select("doc_id", F.posexplode(S.continued_tags(items)).alias("i", "filled")), S.continued(rows))
    pieces = held.select("doc_id", matches(F.col("text"), r"\p{L}{1,2}|\p{N}|[^\p{L}\p{N}\s]").alias("toks"))
    apart = S.tokens(held, pattern=r"\p{L}{1,2}|\p{N}|[^\p{L}\p{N}\s]")
    for by_script in (False, True):
        begins = pieces.select("doc_id", F.posexplode(S.word_begins(F.col("toks"), by_script)).alias("i", "first"))
        same(begins, S.word_starts(apart, by_script=by_script).select("doc_id", "i", "first"))


def test_sentence_arrays_equal_rows(spark):
    texts = [["", "a\tO", "b\tB-X", "", " ", "c\tO"], [""], ["x"], ["", ""], [f"w{i}\tO" if i % 7 else "" for i in range(100)]]
    held = spark.createDataFrame(list(enumerate(texts)), "doc_id long, lines array<string>")
    rows = held.select("doc_id", F.posexplode("lines").alias("no", "line"))
    found = held.select("doc_id", F.explode(R.sentence_arrays(F.col("lines"))).alias("s")).select("doc_id", "s.sentence", "s.tokens", "s.tags")
    same(found, R.tagged_sentences(rows, "doc_id"))


@pytest.mark.parametrize("name", ["text_word_starts", "bio_decode", "filled_words", "tagged_lines"])
def test_no_shuffle(spark, sf_dir, name, capsys):
    QUERIES[name](spark, sf_dir).explain()
    assert "Exchange" not in capsys.readouterr().out
