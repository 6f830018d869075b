"""Result tables: difficulty summaries, model candidates, path routing, latency and metric parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanweave.functions.values import pvi


def difficulty(mentions: DataFrame) -> DataFrame:
    """Mentions with the class prior, the information of entity and context alone, and ``ceim``, by how much the entity has more.

    Rows have ``label, p_e, p_c``: the true label's probability from the entity and from its context. The total is
    taken over the labels' counts, so the window has one row a label.
    """
    counts = mentions.groupBy("label").agg(F.count("*").alias("n"))
    prior = counts.select("label", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("prior"))
    rows = mentions.join(prior, "label")
    rows = rows.withColumn("pvi_e", pvi(F.col("prior"), F.col("p_e"))).withColumn("pvi_c", pvi(F.col("prior"), F.col("p_c")))
    return rows.withColumn("ceim", F.col("pvi_e") - F.col("pvi_c"))


def cross_fitted(mentions: DataFrame, doc: str = "doc_id", label: str = "label", entity: str = "entity", context: str = "context", features: int = 1 << 14, rounds: int = 20) -> DataFrame:
    """Mentions with ``p_e`` and ``p_c``: the true label's probability from the entity alone and from its context.

    Two folds by the hash of the document, so no document is on both sides; each is scored by a logistic model of
    hashed character n-grams fitted on the other. (The neural classifier that the method names needs weights that are
    not public offline; this is its stand-in.) Mentions whose label the other fold lacks have probability 0.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, StringIndexer
    from pyspark.ml.functions import vector_to_array

    from spanweave.operators.routing import char_grams

    rows = mentions.withColumn("fold", F.pmod(F.xxhash64(doc), F.lit(2)))
    for field, name in ((entity, "p_e"), (context, "p_c")):
        parts = None
        for k in (0, 1):
            known = rows.where(F.col("fold") != k).select(char_grams(F.col(field)).alias("grams"), F.col(label).alias("name"))
            stages = [HashingTF(inputCol="grams", outputCol="features", numFeatures=features), StringIndexer(inputCol="name", outputCol="label", stringOrderType="alphabetAsc"), LogisticRegression(maxIter=rounds, regParam=1e-4)]
            model = Pipeline(stages=stages).fit(known)
            names = model.stages[1].labels
            given = rows.where(F.col("fold") == k).withColumn("grams", char_grams(F.col(field)))
            scored = model.stages[2].transform(model.stages[0].transform(given))
            p = vector_to_array("probability")
            own = F.coalesce(*(F.when(F.col(label) == n, F.get(p, F.lit(i))) for i, n in enumerate(names)), F.lit(0.0))
            part = scored.select(*rows.columns, own.alias(name))
            parts = part if parts is None else parts.unionByName(part)
        rows = parts
    return rows.drop("fold")


def difficulty_summary(rows: DataFrame, near: float = 0.5) -> DataFrame:
    """Means at the levels all, label, language, language and label, source, and the shares below, within and above a margin of zero."""
    sets = [[], [F.col("label")], [F.col("lang")], [F.col("lang"), F.col("label")], [F.col("source")]]
    grouped = rows.groupingSets(sets, "label", "lang", "source")
    return grouped.agg(
        F.count("*").alias("n"), F.avg("pvi_e").alias("pvi_e"), F.avg("pvi_c").alias("pvi_c"), F.avg("ceim").alias("ceim"),
        F.avg((F.col("ceim") < -near).cast("int")).alias("low"), F.avg((F.abs("ceim") <= near).cast("int")).alias("near_zero"), F.avg((F.col("ceim") > near).cast("int")).alias("high"),
    )


def difficulty_report(mentions: DataFrame, near: float = 0.5) -> DataFrame:
    """:func:`difficulty_summary` of :func:`difficulty` in one pass over the mentions.

    The class prior adds the same term to both informations of every mention of a label, so logarithms and counts are
    summed by label, language and source first, and the prior's term joins those few rows.
    """
    log = lambda p: F.log2(F.greatest(F.col(p), F.lit(1e-12)))
    more = log("p_e") - log("p_c")
    cells = mentions.groupBy("label", "lang", "source").agg(
        F.count("*").alias("n"), F.sum(log("p_e")).alias("e"), F.sum(log("p_c")).alias("c"), F.count_if(more < -near).alias("low"), F.count_if(F.abs(more) <= near).alias("near_zero"), F.count_if(more > near).alias("high")
    )
    counts = cells.groupBy("label").agg(F.sum("n").alias("m"))
    prior = counts.select("label", (-F.log2(F.greatest(F.col("m") / F.sum("m").over(Window.partitionBy()), F.lit(1e-12)))).alias("bits"))
    rows = cells.join(prior, "label").withColumn("bits", F.col("bits") * F.col("n"))
    sets = [[], [F.col("label")], [F.col("lang")], [F.col("lang"), F.col("label")], [F.col("source")]]
    n = F.sum("n")
    return rows.groupingSets(sets, "label", "lang", "source").agg(
        n.alias("n"), ((F.sum("bits") + F.sum("e")) / n).alias("pvi_e"), ((F.sum("bits") + F.sum("c")) / n).alias("pvi_c"), ((F.sum("e") - F.sum("c")) / n).alias("ceim"),
        (F.sum("low") / n).alias("low"), (F.sum("near_zero") / n).alias("near_zero"), (F.sum("high") / n).alias("high"),
    )


def candidates(scores: DataFrame, sets: int) -> DataFrame:
    """``tag, strict, coverage``: means over all sets; models that lack one are left out."""
    return scores.groupBy("tag").agg(F.avg("strict").alias("strict"), F.avg("coverage").alias("coverage"), F.count_distinct("set").alias("n")).where(F.col("n") == sets).drop("n")


def timing(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Exact median, least and greatest time."""
    return rows.groupBy(*by).agg(F.percentile(value, 0.5).alias("median_s"), F.min(value).alias("min_s"), F.max(value).alias("max_s"))


def group_of(name: Column) -> Column:
    """The folder that a result file or latency folder belongs to; the first rule that fits decides, else ``misc``."""
    head = F.substring_index(name, "_", 1)

    def named(folder: str, pattern: str) -> tuple[Column, Column]:
        return name.rlike(pattern), F.concat(F.lit(folder), F.regexp_extract(name, pattern, 1))

    # Fixed rules of names, in order.
    rules = [
        named("v5/latency/", r"^([gc]pu_latency)$"),
        (head.isin("v1", "v2", "v2.1", "v3"), F.concat(F.lit("english/"), head)),
        (name.startswith("test_metrics"), F.lit("english/misc")),
        (head.isin("A", "B64", "A-minilm", "A-pilot"), F.concat(F.lit("v4/"), head)),
        (name.startswith("latency_"), F.lit("v4/latency")),
        (name.startswith("router_"), F.lit("v4/router")),
        (name.startswith("ml_train_v5") | (head == "difficulty"), F.lit("v5/train_set")),
        (name.startswith("ml_train"), F.lit("v4/train_set")),
        named("v5/pilots/", r"^(pilot2?_f\d+)"),
        named("v5/sweeps/", r"^(sweep(?:_[^_]+){2}|dhsweep(?:_[^_]+){3})_"),
        named("v5/runs/", r"^cpu_(.+?-v5data)_(?:fp32|int8)"),
        (head == "v5", F.lit("v5/summary")),
        (head.endswith("-v5data") | head.contains("-v5data-") | head.startswith("v5."), F.concat(F.lit("v5/runs/"), head)),
    ]
    return F.coalesce(*(F.when(fits, folder) for fits, folder in rules), F.lit("misc"))


def last_json_line(text: Column, schema: str) -> Column:
    """The last line of a log as JSON; null if it is none."""
    lines = F.split(F.regexp_replace(text, r"\s+$", ""), "\n")
    return F.from_json(F.element_at(lines, -1), schema)


def best_logged(text: Column, metric: str) -> Column:
    """The greatest value that a log gives for a metric, as ``metric: 0.123`` or ``'metric': 0.123``."""
    found = F.regexp_extract_all(text, F.lit(rf"{metric}'?\s*[:=]\s*([0-9.]+)"), F.lit(1))
    return F.array_max(F.transform(found, lambda v: v.try_cast("double")))


def all_row(text: Column) -> Column:
    """Numbers of the line that begins with ALL in a result table."""
    line = F.regexp_extract(text, r"(?m)^ALL\s+(.*)$", 1)
    return F.transform(F.filter(F.split(F.trim(line), r"\s+"), lambda v: v != ""), lambda v: v.try_cast("double"))


def marked_block(document: str, name: str, body: str) -> str:
    """``document`` with the text between its begin and end marks replaced (marks are appended if absent)."""
    begin, end = f"<!-- {name}:begin -->", f"<!-- {name}:end -->"
    if begin not in document:
        return f"{document.rstrip()}\n\n{begin}\n{body}\n{end}\n"
    head, _, rest = document.partition(begin)
    return f"{head}{begin}\n{body}\n{end}{rest.partition(end)[2]}"


def _name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def organised(files: DataFrame, path: str = "path", modified: str = "modified") -> DataFrame:
    """``path, target``: where files that lie at the top of the results belong, and, under it, those of the two latency
    folders; others stay. Of several that belong at one place only the newest counts: ``target`` is null for the rest,
    which it replaces. A file at the top is newer than a grouped one of its name. Summaries of latency folders are made anew, so they go nowhere.
    """
    parts, p = F.split(F.col(path), "/"), F.col(path)
    latency = (F.size(parts) == 2) & F.get(parts, F.lit(0)).isin("gpu_latency", "cpu_latency")
    target = F.when(F.size(parts) == 1, F.concat(group_of(p), F.lit("/"), p)).when(latency, F.when(_name(p) != "summary.tsv", F.concat(group_of(F.get(parts, F.lit(0))), F.lit("/"), _name(p)))).otherwise(p)
    flat = F.size(parts) == 1
    rows = files.withColumn("target", target).withColumn("__flat__", flat | latency)
    newest = Window.partitionBy("target").orderBy(F.desc("__flat__"), F.desc(modified), path)
    first = F.row_number().over(newest) == 1
    return rows.where("target IS NOT NULL").select(path, F.when(first, F.col("target")).alias("target"))


def located(wanted: DataFrame, files: DataFrame, name: str = "rel", path: str = "path") -> DataFrame:
    """``rel, path``: the file that a short relative name means: at the top, else in its group's folder, else the first
    anywhere that ends so; the name itself where there is none."""
    ask, there = wanted.select(F.col(name).alias("rel")).distinct(), files.select(F.col(path).alias("path")).distinct()
    head, rest = F.substring_index("rel", "/", 1), F.expr("substring(rel, instr(rel, '/') + 1)")
    grouped = F.when(F.col("rel").contains("/"), F.concat(group_of(head), F.lit("/"), rest)).otherwise(F.concat(group_of(F.col("rel")), F.lit("/"), "rel"))
    both = ask.withColumn("grouped", grouped).join(there, _name(ask.rel) == _name(there.path), "left").where(F.col("path").isNull() | (F.col("path") == F.col("rel")) | (F.col("path") == F.col("grouped")) | F.col("path").endswith(F.col("rel")))
    rank = F.when(F.col("path") == F.col("rel"), 0).when(F.col("path") == F.col("grouped"), 1).otherwise(2)
    best = both.groupBy("rel").agg(F.min_by("path", F.when(F.col("path").isNotNull(), F.struct(rank, "path"))).alias("path"))
    return ask.join(best, "rel", "left").select("rel", F.coalesce("path", "rel").alias("path"))
