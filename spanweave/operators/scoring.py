"""Span scoring: matches of predictions with gold, counted at several levels at once.

Rows of both sides are ``doc_id, start, end, label`` and any columns that levels group by; predictions may have
``score``. Interval joins go by bins of positions (``intervals``), so they hash by document and bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanweave.labels import IGNORE
from spanweave.operators import intervals as I

KEY = "doc_id"


def clear_of(pred: DataFrame, zones: DataFrame) -> DataFrame:
    """Predictions that overlap no zone (gold labelled IGNORE)."""
    return I.without_overlap(pred, zones, KEY).select(*pred.columns)


def covered(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Gold spans that any prediction overlaps."""
    return I.with_overlap(gold, pred, KEY).select(*gold.columns)


def strict_counts(gold: DataFrame, pred: DataFrame, levels: list[str]) -> DataFrame:
    """``levels, label, tp, fp, fn`` of exact matches: equal bounds and label, one to one."""
    keys = [KEY, *levels, "start", "end", "label"]
    g, p = gold.groupBy(*keys).agg(F.count("*").alias("g")), pred.groupBy(*keys).agg(F.count("*").alias("p"))
    both = g.join(p, keys, "full").na.fill(0, ["g", "p"])
    hit = F.least("g", "p")
    return both.groupBy(*levels, "label").agg(F.sum(hit).alias("tp"), F.sum(F.col("p") - hit).alias("fp"), F.sum(F.col("g") - hit).alias("fn"))


def lenient_matches(gold: Column, pred: Column) -> Column:
    """Number of predictions that take a gold span: in order, each the first unused one that it overlaps."""
    start = F.struct(F.transform(gold, lambda g: F.lit(False)).alias("used"), F.lit(0).alias("tp"))

    def step(acc: Column, p: Column) -> Column:
        open_ = F.zip_with(gold, acc["used"], lambda g, u: ~u & (g["start"] < p["end"]) & (p["start"] < g["end"]))
        k = F.array_position(open_, F.lit(True)).cast("int")
        used = F.transform(acc["used"], lambda u, i: u | (i + 1 == k))
        return F.when(k > 0, F.struct(used.alias("used"), (acc["tp"] + 1).alias("tp"))).otherwise(acc)

    return F.aggregate(pred, start, step, lambda acc: acc["tp"])


def lenient_counts(gold: DataFrame, pred: DataFrame, levels: list[str], order: Column | None = None) -> DataFrame:
    """``levels, label, tp, fp, fn`` of greedy overlap matches within a document and label.

    Both sides are read by start and end, or predictions by ``order`` (an ascending key).
    """
    keys = [KEY, *levels, "label"]
    g = gold.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("g"))
    rank = order if order is not None else F.col("start")
    p = pred.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(rank.alias("k"), "start", "end"))).alias("p"))
    both = g.join(p, keys, "full")
    g_, p_ = F.coalesce("g", F.array().cast("array<struct<start:int,end:int>>")), F.coalesce("p", F.array().cast(p.schema["p"].dataType))
    both = both.withColumn("tp", lenient_matches(g_, p_)).withColumn("ng", F.size(g_)).withColumn("np", F.size(p_))
    return both.groupBy(*levels, "label").agg(F.sum("tp").alias("tp"), F.sum(F.col("np") - F.col("tp")).alias("fp"), F.sum(F.col("ng") - F.col("tp")).alias("fn"))


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall and F1; zero where nothing was predicted, wanted or matched."""
    p = F.coalesce(tp / F.nullif(tp + fp, F.lit(0)), F.lit(0.0))
    r = F.coalesce(tp / F.nullif(tp + fn, F.lit(0)), F.lit(0.0))
    f = F.coalesce(F.lit(2.0) * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))
    return {"precision": p, "recall": r, "f1": f}


def levelled(counts: DataFrame, sets: list[list[str]], names: list[str]) -> DataFrame:
    """Counts summed at every level of ``sets`` (grouping sets), absent level columns null; with precision, recall, F1, support."""
    spec = [[F.col(c) for c in s] for s in sets]
    grouped = counts.groupingSets(spec, *[F.col(c) for c in names]).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    values = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return grouped.select(*names, "tp", "fp", "fn", (F.col("tp") + F.col("fn")).alias("support"), *(v.alias(k) for k, v in values.items()))


def best_overlap(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Every gold row with ``pred_label`` of the prediction that overlaps it most, null if none; ties to the earlier."""
    joined = I.beside(gold, pred, KEY)
    size = F.least("g.end", "p.end") - F.greatest("g.start", "p.start")
    key = F.when(F.col("p.start").isNotNull(), F.struct(size, -F.col("p.start"), -F.col("p.end")))
    return joined.groupBy(*(F.col(f"g.{c}").alias(c) for c in gold.columns)).agg(F.max_by("p.label", key).alias("pred_label"))


def first_overlap(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Every gold row with ``pred_label`` of the first prediction (by start, end) that overlaps it, null if none."""
    joined = I.beside(gold, pred, KEY)
    return joined.groupBy(*(F.col(f"g.{c}").alias(c) for c in gold.columns)).agg(F.min_by("p.label", F.when(F.col("p.start").isNotNull(), F.struct("p.start", "p.end"))).alias("pred_label"))


def confusion(gold: DataFrame, pred: DataFrame, levels: list[str]) -> DataFrame:
    """``levels, label, predicted, n, share``: what gold labels were taken for, MISS where nothing overlaps."""
    found = best_overlap(gold, pred).withColumn("predicted", F.coalesce("pred_label", F.lit("MISS")))
    counts = found.groupBy(*levels, "label", "predicted").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*levels, "label")))


def tuned(gold: DataFrame, pred: DataFrame, grid: list[float]) -> DataFrame:
    """``label, threshold, f1``: the threshold of greatest strict F1 for each label, the lowest on ties.

    A prediction without score counts as 1. One join settles the exact matches and the support; a threshold only filters.
    """
    keys = [KEY, "start", "end", "label"]
    wanted = gold.groupBy(*keys).agg(F.count("*").alias("g"))
    given = pred.groupBy(*keys, F.coalesce("score", F.lit(1.0)).alias("score")).agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("score"))
    both = given.join(wanted, keys, "full").withColumn("g_", F.when(first == 1, F.col("g")))
    per = both.groupBy("label", "score", F.col("g").isNotNull().alias("hit")).agg(F.sum("n").alias("n"), F.sum("g_").alias("support"))
    per = per.withColumn("support", F.sum("support").over(Window.partitionBy("label"))).where("support > 0")
    at = per.select("label", "support", "hit", "score", "n", F.explode(F.array(*map(F.lit, grid))).alias("threshold"))
    kept = F.when(F.col("score") >= F.col("threshold"), F.col("n")).otherwise(0)
    counts = at.groupBy("label", "threshold").agg(F.first("support").alias("support"), F.sum(F.when(F.col("hit"), kept).otherwise(0)).alias("tp"), F.sum(F.when(F.col("hit"), 0).otherwise(kept)).alias("fp"))
    both = counts
    both = both.withColumn("f1", prf(F.col("tp"), F.col("fp"), F.col("support") - F.col("tp"))["f1"])
    best = Window.partitionBy("label").orderBy(F.desc("f1"), "threshold")
    return both.withColumn("k", F.row_number().over(best)).where("k = 1").select("label", "threshold", "f1")


def above(pred: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Predictions at or above their label's threshold; no threshold keeps all, no score counts as 1."""
    limits = thresholds.select(F.col("label").alias("__l"), F.col("threshold").alias("__t"))
    return pred.join(limits, pred.label == F.col("__l"), "left").where(F.coalesce("score", F.lit(1.0)) >= F.coalesce("__t", F.lit(0.0))).drop("__l", "__t")


def without_ignored(spans: DataFrame, also_outside: bool = False) -> DataFrame:
    """Spans that count as gold: never IGNORE, and not ``O`` for the scorers that leave it out."""
    labels = [IGNORE, "O"] if also_outside else [IGNORE]
    return spans.where(~F.col("label").isin(*labels))


def pareto(rows: DataFrame, gain: str, cost: str) -> DataFrame:
    """Rows that no other beats: none has at least the gain at a strictly lower cost. Ties of cost survive.

    A running maximum over costs, by ranges of them; costs are first reduced to their best gain.
    """
    from spanweave.operators.corpus import prefix

    best = rows.groupBy(F.col(cost).alias("__at")).agg(F.max(gain).alias("__best"))
    best = prefix(best, "__best", "__at", "__bar", how="max").select("__at", "__bar")
    return rows.join(best, F.col(cost) == F.col("__at")).where(F.col("__bar").isNull() | (F.col("__bar") < F.col(gain))).select(*rows.columns)


def near_ties(rows: DataFrame, group: str, value: str, name: str, within: float = 0.005, top: int = 3) -> DataFrame:
    """``group, name, value, rivals``: up to ``top`` rows of a group within a margin of its best, and how many there are."""
    best = F.max(value).over(Window.partitionBy(group))
    near = rows.withColumn("best", best).where(F.col(value) >= F.col("best") - within)
    near = near.withColumn("rivals", F.count("*").over(Window.partitionBy(group)))
    order = Window.partitionBy(group).orderBy(F.desc(value), name)
    return near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= top).select(group, name, value, "rivals")


def outcomes(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Gold rows with ``found`` (any overlap), ``exact`` (bounds and label) and ``swapped`` (best overlap of another label)."""
    best = best_overlap(gold, pred)
    same = pred.select(KEY, "start", "end", "label").distinct().withColumn("hit", F.lit(True))
    both = best.join(same, [KEY, "start", "end", "label"], "left")
    return both.select(
        *gold.columns, F.col("pred_label").isNotNull().alias("found"), F.coalesce("hit", F.lit(False)).alias("exact"), F.coalesce(F.col("pred_label") != F.col("label"), F.lit(False)).alias("swapped")
    )
