"""Retrieval, pair, classification and regression metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.operators.ordering import running_total


def success_at(rows: DataFrame, query: str, rank: str, flag: str, cutoffs: list[int]) -> DataFrame:
    """(k, queries, complete, successes, hits, success_rate) for each cutoff, from one scan.

    Per query the hits with rank <= k are counted first; complete queries reach rank k, successes have a hit.
    """
    aggs = [F.max(rank).alias("_max")]
    aggs += [F.sum(F.when((F.col(rank) <= k) & F.col(flag), 1).otherwise(0)).alias(f"_h{k}") for k in cutoffs]
    per = rows.groupBy(query).agg(*aggs)
    parts = [
        F.struct(
            F.lit(k).alias("k"), F.count(F.lit(1)).alias("queries"), F.sum(F.when(F.col("_max") >= k, 1).otherwise(0)).alias("complete"),
            F.sum(F.when(F.col(f"_h{k}") > 0, 1).otherwise(0)).alias("successes"), F.coalesce(F.sum(f"_h{k}"), F.lit(0)).alias("hits"),
        )
        for k in cutoffs
    ]
    out = per.agg(F.array(*parts).alias("a")).select(F.inline("a"))
    return out.withColumn("success_rate", F.when(F.col("queries") > 0, F.round(F.col("successes") / F.col("queries"), 6)))


def average_precision(ranked: DataFrame, query: str, rank: str, relevant: str, total: str | None = None, k: int | None = None) -> DataFrame:
    """(query, ap, first_hit): sum of precision at the hits over all relevant items (total), or over the hits.

    With k only ranks up to k count in the sum, total stays what it is. Queries without relevant items are left out.
    """
    w = Window.partitionBy(query).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    hit = F.col(relevant).cast("int")
    rows = ranked.withColumn("_p", F.sum(hit).over(w) / F.col(rank)).withColumn("_in", hit == 1)
    if k is not None:
        rows = rows.withColumn("_in", F.col("_in") & (F.col(rank) <= k))
    per = rows.groupBy(query).agg(
        F.sum(F.when(F.col("_in"), F.col("_p")).otherwise(0.0)).alias("_s"), F.min(F.when(hit == 1, F.col(rank))).alias("first_hit"),
        (F.max(total) if total else F.sum(hit)).alias("_n"),
    )
    return per.filter("_n > 0").select(query, (F.col("_s") / F.col("_n")).alias("ap"), "first_hit")


def separation(pairs: DataFrame, score: str, same: Column) -> DataFrame:
    """(metric, value): n, mean, population deviation, median, p10, p90 of same and different pairs, and the gap of means."""
    rows = pairs.filter(F.col(score).isNotNull() & ~F.isnan(score)).withColumn("_k", F.when(same, "same").otherwise("different"))
    per = rows.groupBy("_k").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"),
        F.percentile(score, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("p"),
    )
    long = per.select("_k", F.explode(F.create_map(F.lit("n"), "n", F.lit("mean"), "mean", F.lit("std"), "std", F.lit("p10"), F.col("p")[0], F.lit("median"), F.col("p")[1], F.lit("p90"), F.col("p")[2])))
    gap = per.agg((F.max(F.when(F.col("_k") == "same", F.col("mean"))) - F.max(F.when(F.col("_k") == "different", F.col("mean")))).alias("value"))
    return long.select(F.concat_ws("_", "_k", "key").alias("metric"), "value").unionByName(gap.select(F.lit("mean_gap").alias("metric"), "value"))


def histogram(pairs: DataFrame, score: str, by: Column, bins: int = 40, low: float = -1.0, high: float = 1.0) -> DataFrame:
    """(kind, bin, n, density) on equal bins; the right edge belongs to the last bin, scores outside are left out."""
    rows = pairs.filter(F.col(score).between(low, high)).select(by.alias("kind"), F.least(F.floor((F.col(score) - low) * (bins / (high - low))), F.lit(bins - 1)).cast("int").alias("bin"))
    counts = rows.groupBy("kind", "bin").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("kind"))
    return counts.withColumn("density", F.col("n") / total / ((high - low) / bins))


def _by_score(rows: DataFrame, score: str, positive: Column) -> DataFrame:
    """Counts per distinct score and, by descending score, those at and above it: (s, p, n, tp, fp, all_p, all_n).

    The running sums go over score ranges first, so that no task holds all scores: a partial sum for each of 1,024
    ranges (as many rows), then inside each range.
    """
    per = rows.filter(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(F.col(score).alias("s")).agg(F.sum(positive.cast("int")).alias("p"), F.sum((~positive).cast("int")).alias("n"))
    ends = per.agg(F.min("s"), F.max("s")).first()
    low, high = (ends[0] or 0.0), (ends[1] or 0.0)
    width = (high - low) or 1.0
    per = per.withColumn("r", F.least(F.floor((F.col("s") - low) / width * 1024), F.lit(1023)).cast("int"))
    sums = per.groupBy("r").agg(F.sum("p").alias("rp"), F.sum("n").alias("rn"))
    above = Window.orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = sums.select("r", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias("a" + c) for c in ("rp", "rn")], F.sum("rp").over(whole).alias("all_p"), F.sum("rn").over(whole).alias("all_n"))
    inside = Window.partitionBy("r").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    out = per.join(F.broadcast(sums), "r")
    return out.select("s", "p", "n", (F.col("arp") + F.sum("p").over(inside)).alias("tp"), (F.col("arn") + F.sum("n").over(inside)).alias("fp"), "all_p", "all_n")


def roc_auc(rows: DataFrame, score: str, positive: Column) -> DataFrame:
    """(roc_auc, pr_auc): Mann-Whitney with ties counted half, and step average precision with ties grouped."""
    c = _by_score(rows, score, positive)
    return c.agg(
        (F.sum(F.col("p") * (F.col("all_n") - F.col("fp") + F.col("n") / 2)) / F.max(F.col("all_p") * F.col("all_n"))).alias("roc_auc"),
        (F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.max("all_p")).alias("pr_auc"),
    )


def average_precision_per_row(rows: DataFrame, score: str, row_id: str, positive: Column) -> DataFrame:
    """(ap): average precision where every row is a step, by descending score and then row_id.

    Null and NaN scores are left out. Running sums go over score ranges first, then inside each range.
    """
    per = rows.filter(F.col(score).isNotNull() & ~F.isnan(score)).select(F.col(score).alias("s"), F.col(row_id).alias("i"), positive.cast("int").alias("p"))
    ends = per.agg(F.min("s"), F.max("s")).first()
    low, high = (ends[0] or 0.0), (ends[1] or 0.0)
    per = per.withColumn("r", F.least(F.floor((F.col("s") - low) / ((high - low) or 1.0) * 1024), F.lit(1023)).cast("int"))
    above = Window.orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, -1)
    sums = per.groupBy("r").agg(F.sum("p").alias("rp"), F.count(F.lit(1)).alias("rn"))
    sums = sums.select("r", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias("a" + c) for c in ("rp", "rn")])
    inside = Window.partitionBy("r").orderBy(F.desc("s"), "i").rowsBetween(Window.unboundedPreceding, 0)
    out = per.join(F.broadcast(sums), "r").select("p", (F.col("arp") + F.sum("p").over(inside)).alias("hits"), (F.col("arn") + F.count(F.lit(1)).over(inside)).alias("k"))
    return out.agg((F.sum(F.col("p") * F.col("hits") / F.col("k")) / F.sum("p")).alias("ap"))


def best_f1(rows: DataFrame, score: str, positive: Column) -> DataFrame:
    """The threshold of the highest F1, the lowest on a tie: threshold, f1, precision, recall, accuracy."""
    c = _by_score(rows, score, positive)
    c = c.withColumns({"precision": F.col("tp") / (F.col("tp") + F.col("fp")), "recall": F.col("tp") / F.col("all_p"), "accuracy": (F.col("tp") + F.col("all_n") - F.col("fp")) / (F.col("all_p") + F.col("all_n"))})
    c = c.withColumn("f1", 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("all_p")))
    return c.orderBy(F.desc("f1"), "s").limit(1).select(F.col("s").alias("threshold"), "f1", "precision", "recall", "accuracy")


def binary_metrics(rows: DataFrame, label: str, probability: str, threshold: float = 0.5) -> DataFrame:
    """accuracy, balanced_accuracy, macro_f1, sensitivity, specificity, log_loss of 0/1 labels."""
    y, p = F.col(label), F.col(probability)
    hit = (p >= threshold).cast("int")
    n = lambda a, b: F.sum(F.when((y == a) & (hit == b), 1).otherwise(0))
    clip = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), p))
    c = rows.agg(n(1, 1).alias("tp"), n(0, 0).alias("tn"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), F.avg(-F.when(y == 1, F.log(clip)).otherwise(F.log(1 - clip))).alias("log_loss"))
    tp, tn, fp, fn = (F.col(x).cast("double") for x in ("tp", "tn", "fp", "fn"))
    sens, spec = tp / (tp + fn), tn / (tn + fp)
    return c.select(((tp + tn) / (tp + tn + fp + fn)).alias("accuracy"), ((sens + spec) / 2).alias("balanced_accuracy"), ((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2).alias("macro_f1"), sens.alias("sensitivity"), spec.alias("specificity"), "log_loss")


def multiclass_metrics(rows: DataFrame, label: str, probabilities: str, labels: int) -> DataFrame:
    """top1, top3, macro_f1 over the labels that occur, log_loss, and mean confidence of right and wrong rows."""
    p, y = F.col(probabilities), F.col(label)
    own = F.get(p, y)
    better = F.size(F.filter(F.transform(p, lambda x, i: (x > own) | ((x == own) & (i < y))), lambda b: b))
    guess = (F.array_position(p, F.array_max(p)) - 1).cast("int")
    r = rows.select(y.alias("y"), guess.alias("g"), better.alias("b"), F.array_max(p).alias("c"), F.greatest(own, F.lit(1e-15)).alias("own"))
    top = r.agg(F.avg((F.col("b") < 1).cast("int")).alias("top1"), F.avg((F.col("b") < 3).cast("int")).alias("top3"), F.avg(-F.log("own")).alias("log_loss"), F.avg(F.when(F.col("g") == F.col("y"), F.col("c"))).alias("confidence_right"), F.avg(F.when(F.col("g") != F.col("y"), F.col("c"))).alias("confidence_wrong"))
    cell = r.select(F.explode(F.array(F.struct(F.col("y").alias("k"), F.lit(1).alias("real"), (F.col("g") == F.col("y")).cast("int").alias("hit"), F.lit(0).alias("said")), F.struct(F.col("g").alias("k"), F.lit(0).alias("real"), F.lit(0).alias("hit"), F.lit(1).alias("said")))).alias("x")).select("x.*")
    f1 = cell.groupBy("k").agg(F.sum("real").alias("real"), F.sum("hit").alias("hit"), F.sum("said").alias("said")).filter("real > 0").agg(F.avg(2 * F.col("hit") / (F.col("real") + F.col("said")))).first()[0]
    return top.withColumn("macro_f1", F.lit(f1).cast("double"))


def calibration_error(rows: DataFrame, confidence: str, right: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over bins (low, high]; confidence 0 falls in none."""
    b = F.ceil(F.col(confidence) * bins)
    per = rows.filter(F.col(confidence) > 0).groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("c"), F.avg(F.col(right).cast("int")).alias("a"))
    return per.agg((F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n")).alias("ece"))


def regression_metrics(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """mae, rmse, r2, within_25, within_50, within_100; r2 is null for a constant truth."""
    e = F.col(predicted) - F.col(truth)
    a = rows.agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sum(e * e).alias("_e"), F.var_pop(truth).alias("_v"), F.count(F.lit(1)).alias("_n"),
        *[F.avg((F.abs(e) <= k).cast("int")).alias(f"within_{k}") for k in (25, 50, 100)],
    )
    return a.withColumn("r2", F.when(F.col("_v") > 0, 1 - F.col("_e") / (F.col("_v") * F.col("_n")))).drop("_e", "_v", "_n")


def mid_ranks(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Rows with the mean rank of equal values, from counts per distinct value."""
    per = rows.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    per = running_total(per, [F.col(value)], "_n", "_upto")
    per = per.withColumn(name, F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2).drop("_n", "_upto")
    return rows.join(per, value)


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(spearman): correlation of mid-ranks; null for a constant side."""
    r = mid_ranks(mid_ranks(rows.select(a, b), a, "_ra"), b, "_rb")
    return r.agg(F.corr("_ra", "_rb").alias("spearman"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; 0 and 0 where n is 0."""
    p, zz = hits / n, z * z
    centre, spread = (p + zz / (2 * n)) / (1 + zz / n), z / (1 + zz / n) * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    return F.when(n > 0, centre - spread).otherwise(0.0), F.when(n > 0, centre + spread).otherwise(0.0)
