"""Training samples: every label, and one text for each id whatever repeats."""

from spanweave.llm import language, quality


def test_every_language_is_learned(spark, monkeypatch):
    seen, train = {}, language.train

    def spy(texts, labels, **how):
        seen.update(labels=set(labels), **how)
        return train([], [])

    monkeypatch.setattr(language, "train", spy)
    rows = [(k * 10 + i, f"text {k} {i}", f"l{k:03}") for k in range(70) for i in range(8)]
    language.detect_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert seen["labels"] == {f"l{k:03}" for k in range(70)} and seen["windows"] == 70 * 1024


def test_copies_do_not_crowd_out(spark, monkeypatch):
    rows = [(1, f"copy {i % 2} of one document", "en") for i in range(200)] + [(i, f"other text {i}", "en") for i in range(2, 22)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda parts, target: seen.append(len(parts)))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 22)], "doc_id long, quality int, toxic int")
    quality.train(docs, labels, sample_rows=21)
    assert seen == [21, 21]
    how = {"languages": 64} if "languages" in language.sample.__code__.co_varnames else {}
    texts, _ = language.sample(docs, "doc_id", "text", "lang", 300, **how)
    usable = docs.where(~language.held_out("doc_id")).select("doc_id").distinct().count()
    assert len(texts) == usable == len(set(texts))


def test_keep_good_keeps_clashing_columns(spark):
    """Columns named like the operator's own stay as they are; ties, nulls and repeated rows are judged alike."""
    from spanweave.llm import quality

    words = ["plain", "words", "about", "rivers", "and", "stones"]
    rows = [(k, " ".join(words[k % 3 :] * 5), None if k % 4 == 0 else "s", "en", k / 2, f"h{k}", None) for k in range(12)] * 2 + [(None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, low_evidence double, site_host string, site_low_rate int")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(12)], "doc_id long, quality int, toxic int")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    left = [tuple(r) for r in kept.collect()]
    assert all(r in rows for r in left) and all(left.count(r) == rows.count(r) for r in left)
    assert quality.keep_good(docs.limit(0), labels).collect() == []
