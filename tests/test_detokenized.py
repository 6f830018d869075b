"""Tokens joined to texts with spans, against a loop."""

import random

from pyspark.sql import functions as F

from spanweave.functions import text as X
from spanweave.sources import readers as R


def plan(df, capsys):
    df.explain()
    return capsys.readouterr().out


def test_detokenized_against_a_loop(spark, capsys):
    rng = random.Random(3)
    rows = [(k, [rng.choice(["a", "bé", " ", "", ".", "(", "東", None]) for _ in range(n)], [rng.choice(["O", "B-X", "I-X", "I-Y", None]) for _ in range(n)]) for k, n in enumerate((0, 1, 5, 40, 40, 200))]
    rows.append((99, None, None))
    df = spark.createDataFrame(rows, "id int, tokens array<string>, tags array<string>").coalesce(1)
    told = {r.id: r.d for r in df.select("id", X.detokenized(F.col("tokens"), F.col("tags")).alias("d")).collect()}
    for k, tokens, tags in rows:
        text, spans, last, open_ = "", [], None, None
        for tok, tag in zip(tokens or [], tags or []):
            if not tok:
                continue
            text += "" if last is None or tok[0] in X._CLOSERS or last[-1] in X._OPENERS else " "
            begin, blank = len(text), not tok.strip()
            text, last, label = text + tok, tok, tag[2:] if tag and tag != "O" and not blank else None
            if label and tag[0] == "I" and open_ == label:
                spans[-1] = (spans[-1][0], len(text), label)
            elif label:
                spans.append((begin, len(text), label))
            if not (blank and tag and tag[0] == "I"):
                open_ = label
        assert (told[k].text, [tuple(s) for s in told[k].spans]) == (text, spans), k
    # The text is made once: no filter makes it again.
    assert plan(R.tagged_arrays(df, "s", "x"), capsys).count("ArrowEvalPython [") == 1
    assert {r.id for r in R.tagged_arrays(df, "s", "x").collect()} == {f"s-{k}" for k, *_ in rows if told[k].text.strip()}


def test_detokenized_batches_without_a_label(spark):
    """Batches of no labelled token, of none but empty tokens, and of no token."""
    for tokens, tags, text in ((["(", "see", ")"], ["O", "O", "O"], "(see)"), (["a", " "], [None, "B-X"], "a  "), (["", ""], ["B-X", "I-X"], ""), ([], [], ""), (None, None, "")):
        df = spark.createDataFrame([(tokens, tags)], "tokens array<string>, tags array<string>").coalesce(1)
        told = df.select(X.detokenized(F.col("tokens"), F.col("tags")).alias("d")).first().d
        assert (told.text, told.spans) == (text, []), tokens
