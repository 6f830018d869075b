"""Small cases that tables of queries do not reach: nulls, empty tables, files, streams, the registry."""

import pytest
from pyspark.sql import functions as F

from spanweave.functions import text as X
from spanweave.functions import values as V
from spanweave.labels import bio_labels
from spanweave.operators import corpus as K
from spanweave.operators import detect as D
from spanweave.operators import generate as G
from spanweave.operators import leaderboard as L
from spanweave.operators import scoring as C
from spanweave.operators import spans as S
from spanweave.schema import DOCUMENT
from spanweave.sources import readers as R


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("v")).first().v


def test_bio_labels():
    assert len(bio_labels()) == 17 and bio_labels()[:3] == ["O", "B-PERSON", "I-PERSON"]


@pytest.mark.parametrize("text", [None, "", " ", "no match", "a😀b +1 (743) 555-3824 x"])
def test_detect_offsets(spark, text):
    rows = D.rules(spark.createDataFrame([(1, text)], "doc_id int, text string"), keep=("doc_id", "text")).collect()
    assert all(r.text[r.start : r.end] == r.value for r in rows)
    assert len(rows) == (1 if text and "+1" in text else 0)


def test_overlap_chain_keeps_ends(spark):
    spans = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit("X").alias("label")) for a, b in ((0, 6), (4, 9), (8, 12))))
    assert [(s.start, s.end) for s in one(spark, S.resolved(spans))] == [(0, 6), (8, 12)]


def test_lenient_is_greedy(spark):
    gold = spark.createDataFrame([(1, 0, 4, "A"), (1, 6, 9, "A")], "doc_id int, start int, end int, label string")
    pred = spark.createDataFrame([(1, 2, 7, "A", 0), (1, 0, 4, "A", 1)], "doc_id int, start int, end int, label string, k int")
    r = C.lenient_counts(gold, pred, [], F.col("k")).first()
    assert (r.tp, r.fp, r.fn) == (1, 1, 1)


@pytest.mark.parametrize("n, want", [(0, 1), (382, 1), (383, 2), (36769, 129)])
def test_window_counts(spark, n, want):
    assert S.windows(spark.createDataFrame([(n,)], "n int")).count() == want


def test_zero_support(spark):
    values = C.prf(F.lit(0), F.lit(0), F.lit(0))
    assert [one(spark, v) for v in values.values()] == [0.0, 0.0, 0.0]


def test_hash_digit_is_md5_modulo_ten(spark):
    import hashlib

    keys = [f"key {i}" for i in range(200)]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", V.hash_digit(F.col("k")).alias("d")).collect()
    assert all(r.d == int(hashlib.md5(r.k.encode()).hexdigest(), 16) % 10 for r in got)


@pytest.mark.parametrize("text", ["Dear A\n\n123\n \nb\n\n\n\nend\n\n", "", "\n\n", "x"])
def test_segments_cover_the_text(spark, text):
    assert "".join(one(spark, X.segments(F.lit(text)))) == text


def test_back_map(spark):
    assert one(spark, X.visible_back_map(F.lit("a\nb\tc"))) == [0, 1, 1, 1, 2, 3, 3, 3, 4]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string, lang string, n_chars long")
    spans = spark.createDataFrame([], "doc_id long, text string, start int, end int, label string, score double")
    assert K.budgeted(docs, "n_chars", "doc_id", "source", 10, 10).collect() == []
    assert K.packed(docs, "n_chars", "doc_id", "lang", 8).collect() == []
    assert K.containing(docs, docs.selectExpr("doc_id AS item_id", "text")).collect() == []
    for f in (S.overlap_rows, S.merged_adjacent, S.merged_addresses, S.violations):
        assert f(spans).collect() == []
    assert C.tuned(spans, spans, [0.1, 0.5]).collect() == [] and C.confusion(spans, spans, []).collect() == []
    assert C.pareto(spans, "score", "start").collect() == []


def test_prefix_sum_equals_a_loop(spark, monkeypatch):
    monkeypatch.setattr(K, "RANGE_ROWS", 20)
    rows = [(i * 7 % 101, i % 13) for i in range(101)]
    got = K.prefix_sum(spark.createDataFrame(rows, "k int, n int"), "n", "k", "before").collect()
    total, want = 0, {}
    for k, n in sorted(rows):
        want[k] = total
        total += n
    assert {r.k: r.before for r in got} == want


def test_packed_over_ranges(spark, monkeypatch):
    """The sum's own name beside the helpers of several ranges."""
    monkeypatch.setattr(K, "RANGE_ROWS", 4)
    docs = spark.createDataFrame([(i, "ab"[i % 2], 3) for i in range(20)], "k int, d string, n int")
    got = {(r.seq_id, r.domain): r.tokens for r in K.packed(docs, "n", "k", "d", 8).collect()}
    assert got == {(s, d): 4 for s in range(10) for d in "ab"}


def test_packed_ids_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(K, "RANGE_ROWS", 4)
    monkeypatch.setattr(K, "RANGE_DOCS", 3, raising=False)
    docs = spark.createDataFrame([(i, [10 * i, 10 * i + 1]) for i in range(1, 12)], "k int, ids array<int>")
    got = {r.seq_id: r.ids for r in K.packed_ids(docs, "ids", "k", 6, 0, 7).collect()}
    flat = [x for i in range(1, 12) for x in (10 * i, 10 * i + 1, 7)]
    assert got == {k: [0, *flat[6 * k : 6 * k + 6], 7] for k in range(5)}


def test_array_shards_over_ranges(spark, sf_dir, monkeypatch):
    """Ranges do not change the shards' numbers."""
    from spanweave.plans.all_queries import QUERIES

    rows = lambda: sorted(map(tuple, QUERIES["array_shards"](spark, sf_dir).collect()))
    whole = rows()
    monkeypatch.setattr(K, "RANGE_ROWS", 1000)
    monkeypatch.setattr(K, "RANGE_DOCS", 1000, raising=False)
    assert whole and rows() == whole


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "text": "é", "spans": [{"start": 0, "end": 1, "label": "A"}]}\n\n{"id": "2"}\n')
    rows = R.READERS.read("jsonl", spark, path=str(tmp_path / "a.jsonl"), schema=DOCUMENT).collect()
    assert [(r.id, r.text) for r in rows] == [("1", "é"), ("2", None)] and rows[0].spans[0].end == 1
    R.write_jsonl(spark.createDataFrame([("1", "x\ny")], "id string, text string"), str(tmp_path / "out"))
    assert R.jsonl(spark, str(tmp_path / "out"), "id string, text string").first().text == "x\ny"
    (tmp_path / "c.tsv").write_text("model\tchars\ttokens\twindows\tmedian_s\tmin_s\tmax_s\nm\t1000\t296\t1\t0.06\t0.05\t0.1\n")
    assert R.latency(spark, str(tmp_path / "c.tsv")).first().median_s == 0.06
    (tmp_path / "f.txt").write_text("#lang: en\nHi {PERSON}\n\n# no\nBye\n")
    assert [r.template for r in R.READERS.read("frames", spark, path=str(tmp_path / "f.txt")).collect()] == ["Hi {PERSON}", "Bye"]
    (tmp_path / "n.tsv").write_text("a\tO\n\nb\tB-X\n")
    assert R.READERS.read("conll", spark, path=str(tmp_path / "n.tsv")).count() == 2
    with pytest.raises(KeyError):
        R.READERS.read("none", spark)


def test_mails(spark):
    rows = spark.createDataFrame([("s", None, "b\n> q"), (None, "x", "y"), ("", "a", None)], "subject string, body string, content string")
    assert [r.text for r in R.mails(rows).collect()] == ["Subject: s", "x", "a"]
    assert [r.text for r in R.mails(rows.drop("body")).collect()] == ["Subject: s\nb", "y", ""]
    with pytest.raises(ValueError):
        R.mails(rows.select("subject"))


def test_stream_equals_batch(spark, tmp_path):
    from spanweave.streaming import scan

    texts = ["mail a@b.example.com", "nothing", "card 1234567890123"]
    for i, t in enumerate(texts):
        spark.createDataFrame([(i, t)], "doc_id int, text string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    found = scan.detect(scan.documents(spark, str(tmp_path / "in"), "doc_id int, text string", files=1))
    q = found.writeStream.format("memory").queryName("found").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert sorted((r.doc_id, r.label) for r in spark.table("found").collect()) == [(0, "EMAIL"), (2, "ACCOUNT")]


def test_scorers(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id int, text string")
    assert D.plugged(docs, lambda t: [(0, len(t), "X", 0.5)] if t else []).collect()[0].end == 2
    assert D.saved(spark.createDataFrame([(1, 0, 1, "X", None)], "doc_id int, start int, end int, label string, score double")).first().score == 1.0


def test_marked_block():
    first = L.marked_block("# Title", "t", "a")
    assert L.marked_block(first, "t", "b").count("t:begin") == 1 and "\nb\n" in L.marked_block(first, "t", "b")


def test_form_styles_are_disjoint(spark):
    a = {r.text.split("\n")[0][:12] for r in G.form_records(spark, 40).collect()}
    b = {r.text.split("\n")[0][:12] for r in G.form_records(spark, 40, held_out=True).collect()}
    assert a and b and not a & b - {""}


def test_partial_masks(spark):
    docs = spark.createDataFrame([(1, "born 1999 ok")], "doc_id int, text string")
    none = spark.createDataFrame([], "doc_id int, start int, end int, label string")
    tags = {p: [r.tag for r in S.bio_encoded(S.tokens(docs), none, partial=F.lit(p)).orderBy("i").collect()] for p in ("", "all", "digits", "letters")}
    assert tags == {"": ["O"] * 3, "all": [None] * 3, "digits": ["O", None, "O"], "letters": [None, "O", None]}


ENTRY = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"


def _entry(tmp_path, code, *more, ignore=()):
    import os
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(here, "spanweave"), tmp_path / "spanweave", ignore=shutil.ignore_patterns("__pycache__", *ignore))
    for name in ("__spark_entry__.py", *more):
        shutil.copy(os.path.join(here, name), tmp_path)
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0 and int(done.stdout.split()[0]) > 90, done.stderr


def test_entry_works_without_the_llm_part(tmp_path):
    _entry(tmp_path, ENTRY, ignore=("llm",))


def test_entry_works_without_an_optional_library(tmp_path):
    """Where a library of the training-data part is missing, the other queries stay."""
    _entry(tmp_path, "import sys; sys.modules['regex'] = None; sys.modules['public_tokenizers'] = None; " + ENTRY)


# -- offsets and prefixes ----------------------------------------------------------------------------------------


def test_matches_equal_another_engine(spark):
    import random
    import re

    from spanweave.functions.offsets import matches

    rng = random.Random(3)
    texts = ["".join(rng.choices("ab1 😀é\n", k=rng.randint(0, 400))) for _ in range(60)] + ["", "a", "1" * 700, "a1" * 600]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: [(s.start, s.end, s.value) for s in r.m] for r in rows.select("i", matches(F.col("t"), "[0-9]+|a", "X").alias("m")).collect()}
    assert got == {i: [(m.start(), m.end(), m.group()) for m in re.finditer("[0-9]+|a", t)] for i, t in enumerate(texts)}


def test_matches_are_linear(spark):
    import time

    from spanweave.functions.offsets import matches

    def took(n):
        df = spark.range(1).select(F.repeat(F.lit("ab 12 "), n).alias("t")).select(F.size(matches(F.col("t"), "[0-9]+")).alias("n"))
        began = time.time()
        assert df.first().n == n
        return time.time() - began

    took(100)
    assert took(20_000) < 6 and took(80_000) < 20


@pytest.mark.parametrize("how", ["sum", "max"])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_prefix(spark, monkeypatch, how, by):
    """Running sums and maxima over many ranges, an outlier, ties of groups, a null order."""
    import random

    monkeypatch.setattr(K, "RANGE_ROWS", 16)
    rng = random.Random(7)
    orders = rng.sample(range(1000), 150) + [10**15, -(10**15), None]
    rows = [(rng.choice("xyz"), o, rng.randint(0, 9), k) for k, o in enumerate(orders)]
    df = spark.createDataFrame(rows, "g string, o long, v int, part int")
    got = {r.part: r.upto for r in K.prefix(df, "v", "o", "upto", by, how).collect()}
    for g, o, v, k in rows:
        before = [x[2] for x in rows if (not by or x[0] == g) and (x[1] if x[1] is not None else float("-inf")) < (o if o is not None else float("-inf"))]
        assert got[k] == (sum(before) if how == "sum" else max(before, default=None))
    assert K.prefix(df.limit(0), "v", "o", "upto", by, how).collect() == []


def test_containing(spark):
    docs = [(1, "the quick brown fox jumps"), (2, "Quick brown fox"), (3, None), (4, ""), (5, "a b\n\nc d"), (6, "xfoxy")]
    items = [(1, "quick brown fox"), (2, "fox"), (3, "b\n\nc"), (4, None), (5, ""), (6, "brown fox jumps over"), (7, "e quick brown fox j")]
    got = K.containing(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == sorted((d, i) for d, t in docs for i, p in items if t and p and p in t)


def test_allocated_equals_the_loop(spark):
    import random

    rng = random.Random(11)
    for turn in range(16):
        n = rng.randint(1, 6) if turn % 2 else rng.randint(8, 40)
        cap, room = [rng.randint(0, 40) for _ in range(n)], [rng.randint(0, 60) for _ in range(n)]
        share = [min(c, r) for c, r in zip(cap, room)]
        short = sum(cap) - sum(share)
        while short > 0 and any(r > s for s, r in zip(share, room)):
            open_ = [k for k in range(n) if room[k] > share[k]]
            each = max(1, short // len(open_))
            for k in open_:
                more = min(each, room[k] - share[k], short)
                share[k] += more
                short -= more
        df = spark.createDataFrame([(f"s{k}", cap[k], room[k], k) for k in range(n)], "source string, cap int, available int, pos int")
        assert {r.source: r.n for r in K.allocated(df).collect()} == {f"s{k}": share[k] for k in range(n)}


def test_mixed_moves_all_arrays(spark):
    kind = "k int, text string, spans array<struct<start:int,end:int,label:string>>, negs array<struct<start:int,end:int,label:string>>"
    a, b = spark.createDataFrame([(1, "ab", [(0, 1, "X")], [])], kind), spark.createDataFrame([(1, "cd", [(1, 2, "Y")], [(0, 1, "n")])], kind)
    r = K.mixed(a, b, "k", moved=("spans", "negs")).first()
    assert r.text == "ab\n\ncd" and [tuple(s) for s in r.spans] == [(0, 1, "X"), (5, 6, "Y")] and [tuple(s) for s in r.negs] == [(4, 5, "n")]


def test_text_helpers(spark):
    assert one(spark, X.zh_variant(F.lit("國语語"), "国语", "國語")) == "zh-Hant"
    assert one(spark, X.zh_variant(F.lit("国語语"), "国语", "國語")) == "zh-Hans"
    spans = F.array(F.struct(F.lit(0).alias("start"), F.lit(2).alias("end")))
    assert one(spark, X.capitalised(F.lit("élan vital"), F.slice(spans, 1, 0))) == "Élan vital"
    assert one(spark, X.capitalised(F.lit("élan"), spans)) == "élan"
    assert [one(spark, X.in_sentence(F.lit(c))) for c in ("Date of birth", "DOB", "A note")] == ["date of birth", "DOB", "a note"]


# -- cleaning ----------------------------------------------------------------------------------------------------

TARGETS = {"name": "PERSON", "first": "PERSON", "street_address": "ADDRESS", "city": "ADDRESS", "state": "ADDRESS", "postcode": "ADDRESS", "date": "DATE_CUE", "dob": "DOB", "mail": "EMAIL"}


def _cleaned(spark, text, spans, **more):
    from spanweave.operators.cleaning import cleaned

    kind = "text string, spans array<struct<start:int,end:int,label:string>>"
    r = spark.createDataFrame([(text, spans)], kind).select(cleaned(F.col("text"), F.col("spans"), TARGETS, {"amount": "money"}, **more).alias("c")).first().c
    said = lambda part: [(text[s.start : s.end], s.label) for s in part]
    return said(r.spans), said(r.negs), r.stats.asDict()


def _at(text, *parts):
    out, upto = [], 0
    for value, label in parts:
        upto = text.index(value, upto)
        out.append((upto, upto + len(value), label))
        upto += len(value)
    return out


def test_cleaning_rules(spark):
    text = "DOB: 10/02/1965. Payment received 03/04/2023.\nborn\n12/12/2000"
    spans, negs, stats = _cleaned(spark, text, _at(text, ("10/02/1965", "date"), ("03/04/2023", "date"), ("12/12/2000", "date")))
    assert spans == [("10/02/1965", "DOB")] and (stats["date_cue_dob"], stats["date_cue_o"]) == (1, 2)
    text = "John Smith lives at 12 Main St,\nSpringfield, IL 62701"
    spans, _, stats = _cleaned(spark, text, _at(text, ("John", "first"), ("Smith", "name"), ("12 Main St", "street_address"), ("Springfield", "city"), ("IL", "state"), ("62701", "postcode")))
    assert spans == [("John Smith", "PERSON"), ("12 Main St,\nSpringfield, IL 62701", "ADDRESS")] and stats["merged"] == 4
    text = "expanded into France last year.\nCity: Boston\nTel: 555 0100\n12 Main St, Springfield"
    spans, negs, stats = _cleaned(spark, text, _at(text, ("France", "city"), ("Boston", "city"), ("12 Main St", "street_address"), ("Springfield", "city")))
    assert spans == [("Boston", "ADDRESS"), ("12 Main St, Springfield", "ADDRESS")] and negs == [("France", "place")] and stats["address_bare_place_to_O"] == 1
    text = "Send it to 0567 Drake Road, Manchester, M12 4BE, UK. Thanks"
    spans, _, stats = _cleaned(spark, text, _at(text, ("0567 Drake Road", "street_address")), street_tails=True)
    assert spans == [("0567 Drake Road", "ADDRESS"), (", Manchester, M12 4BE, UK", "IGNORE")] and stats["address_tail_ignored"] == 1
    assert _cleaned(spark, text, _at(text, ("0567 Drake Road", "street_address")))[0] == [("0567 Drake Road", "ADDRESS")]
    text = "x [Redacted] \u00a0 Ann\u2003 and 5 USD  "
    given = _at(text, ("[Redacted]", "dob"), ("\u00a0 Ann\u2003", "name"), ("5 USD", "amount"), ("  ", "name"))
    spans, negs, stats = _cleaned(spark, text, [*given, (-1, 3, "name"), (2, 900, "mail"), (5, 5, "mail"), (0, 1, "other")])
    assert spans == [("[Redacted]", "IGNORE"), ("Ann", "PERSON")] and negs == [("5 USD", "money")]
    assert (stats["invalid"], stats["dob_placeholder"]) == (4, 1)
    text = "abcdefghijkl"
    spans, _, stats = _cleaned(spark, text, [(0, 6, "name"), (4, 9, "mail"), (8, 12, "name"), (8, 12, "mail")])
    assert spans == [("abcdef", "PERSON"), ("ijkl", "PERSON")] and stats["overlap_dropped"] == 2
    assert _cleaned(spark, "abc", [])[0] == [] and _cleaned(spark, "", None)[2]["invalid"] == 0


def test_normalized(spark):
    from spanweave.operators.cleaning import normalized

    rows = spark.createDataFrame(
        [("a", 1, "en", "Ann here", [(0, 3, "name")]), ("a", 2, "fr", "Ann ici", [(0, 3, "name")]), ("a", 3, "en", " \u00a0", []), ("a", 4, "en", None, None), ("b", None, "en", "x", None)],
        "source string, id int, lang string, text string, spans array<struct<start:int,end:int,label:string>>",
    )
    got = normalized(rows, TARGETS, language=lambda r: r.lang == "en", tail_sources=("a",)).collect()
    assert sorted((r.id, len(r.spans)) for r in got) == [("a-1", 1), ("b", 0)]


def test_cross_fit_keeps_documents_apart(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spans = D.rules(docs, keep=("doc_id", "lang", "source"))
    mentions = spans.select("doc_id", "label", F.col("value").alias("entity"), F.lit("x").alias("context"))
    got = L.cross_fitted(mentions, rounds=5).collect()
    assert len(got) == mentions.count() and all(0 <= r.p_e <= 1 and 0 <= r.p_c <= 1 for r in got)
    assert sum(r.p_e for r in got) / len(got) > 0.6


def test_configuration_and_sinks(spark, tmp_path):
    base = {"a": 1, "b": {"c": [1, 2]}}
    got = {r.path: r.value for r in R.configuration(spark, {"x": {"<<": base, "a": 2}, "y": None}).collect()}
    assert got == {"x.a": "2", "x.b.c": "[1, 2]", "y": "null"}
    R.write_packed(spark.createDataFrame([(0, [0, 5, 1])], "seq_id long, ids array<int>"), str(tmp_path / "p"), {"body": 1})
    assert spark.read.text(str(tmp_path / "p" / "meta")).first().value == '{"body": 1, "sequences": 1}'
    assert spark.read.parquet(str(tmp_path / "p" / "sequences")).count() == 1


def test_value_pools_are_kept(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", None)], "g string, v string")
    path = f"file://{tmp_path}/pool"
    assert sorted(map(tuple, K.value_pools(rows, "g", "v", path).collect())) == [("a", "x"), ("b", None)]
    assert K.value_pools(rows.limit(0), "g", "v", path).count() == 2


@pytest.mark.parametrize("label_all", [False, True])
def test_encoded_windows_of_word_pieces(spark, label_all):
    """Pieces of words: the first takes the tag, the others none or the inside tag; nulls stand at both ends."""
    spans = F.array(F.struct(F.lit(0).alias("start"), F.lit(4).alias("end"), F.lit("X").alias("label")), F.struct(F.lit(5).alias("start"), F.lit(7).alias("end"), F.lit("IGNORE").alias("label")))
    first = lambda toks: F.transform(toks, lambda t: (t["start"] == 0) | (F.substring(F.lit("abcd efgh"), t["start"], 1) == " "))
    made = S.encoded_windows(F.lit("abcd efgh"), spans, 3, 1, "[a-z]{2}", first, label_all)
    got = [(w.lo, w.hi, w.tags) for w in one(spark, made)]
    inner = "I-X" if label_all else None
    assert got == [(0, 3, [None, "B-X", inner, None, None]), (2, 4, [None, None, None, None])]


def test_split_and_addresses(spark, tmp_path):
    spark.createDataFrame([("train", 1), ("test", 2), (None, 3)], "split string, k int").write.parquet(str(tmp_path / "t"))
    assert [r.k for r in R.READERS.read("parquet_split", spark, path=str(tmp_path / "t"), split="test").collect()] == [2]
    parts = F.array(*map(F.lit, ["1 Elm St,", "Rome", "", "Italy"]))
    assert one(spark, X.joined_address(parts, ", ")) == "1 Elm St, Rome, Italy"


def test_per_source_caps(spark):
    rows = [(k, "abc"[k % 3], 10) for k in range(30)]
    got = K.budgeted(spark.createDataFrame(rows, "k int, g string, n int"), "n", "k", "g", {"a": 20, "b": 50}, 140)
    want, own, total = [], {}, 0
    for k, g, n in rows:
        if total >= 140:
            break
        if own.get(g, 0) >= {"a": 20, "b": 50}.get(g, 10**9):
            continue
        own[g], total = own.get(g, 0) + n, total + n
        want.append(k)
    assert sorted(r.k for r in got.collect()) == want
