"""Profiles, summaries and data-quality contracts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, rows, non_null, zeros, min, max, mean, median) for those of the columns that exist."""
    have = [c for c in columns if c in rows.columns]
    if not have:
        raise ValueError("none of the columns exists")
    parts = []
    for c in have:
        x = F.col(c).cast("double")
        parts.append(F.struct(
            F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"), F.count(x).alias("non_null"), F.count_if(x == 0).alias("zeros"),
            F.min(x).alias("min"), F.max(x).alias("max"), F.round(F.avg(x), 2).alias("mean"), F.percentile(x, 0.5).alias("median"),
        ))
    return rows.agg(F.array(*parts).alias("p")).select(F.inline("p"))


def coverage(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """(wanted, found, missing, fraction) of the different keys."""
    k = keys.select(key).filter(F.col(key).isNotNull()).distinct()
    have = rows.select(key).distinct().withColumn("_in", F.lit(1))
    a = k.join(have, key, "left").agg(F.count(F.lit(1)).alias("wanted"), F.count("_in").alias("found"))
    return a.withColumn("missing", F.col("wanted") - F.col("found")).withColumn("fraction", F.when(F.col("wanted") > 0, F.round(F.col("found") / F.col("wanted"), 6)))


def summary(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """n, mean, sample deviation (0 up to one value), p5, p50, p95 of the finite values."""
    v = F.col(value)
    r = rows.filter(v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v) < F.lit(float("inf"))))
    p = F.percentile(value, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    out = r.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), p.alias("_p"))
    return out.select(*group, "n", "mean", "std", F.col("_p")[0].alias("p5"), F.col("_p")[1].alias("p50"), F.col("_p")[2].alias("p95"))


def mean_vector(rows: DataFrame, group: str, vector: str, deviation: bool = False) -> DataFrame:
    """(group, n, vec): element-wise mean of the vectors, with deviation followed by the population deviations."""
    flat = rows.filter(F.col(vector).isNotNull()).select(F.col(group).alias("_g"), F.posexplode(F.col(vector).cast("array<double>")).alias("_p", "_x"))
    aggs = [F.avg("_x").alias("_m"), F.stddev_pop("_x").alias("_s"), F.count(F.lit(1)).alias("n")]
    per = flat.groupBy("_g", "_p").agg(*aggs).groupBy("_g").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("_p", "_m", "_s"))).alias("_a"))
    mean = F.transform("_a", lambda x: x["_m"])
    return per.select(F.col("_g").alias(group), "n", (F.concat(mean, F.transform("_a", lambda x: x["_s"])) if deviation else mean).alias("vec"))


def require_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return rows


def member_faults(rows: DataFrame, item: str, path: str, cluster: str) -> DataFrame:
    """(fault, n) for blank values, repeated ids and paths, and clusters of one."""
    blank = reduce(lambda a, b: a | b, [F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "") for c in (item, path, cluster)])
    count = lambda c, cond: rows.filter(F.col(c).isNotNull()).groupBy(c).count().filter(cond).agg(F.count(F.lit(1)).alias("n"))
    parts = [
        rows.filter(blank).agg(F.count(F.lit(1)).alias("n")).withColumn("fault", F.lit("blank")),
        count(item, "count > 1").withColumn("fault", F.lit("repeated id")),
        count(path, "count > 1").withColumn("fault", F.lit("repeated path")),
        count(cluster, "count = 1").withColumn("fault", F.lit("single member")),
    ]
    return reduce(DataFrame.unionByName, parts).select("fault", "n")


def require_members(rows: DataFrame, item: str, path: str, cluster: str, expected_rows: int | None = None, expected_clusters: int | None = None) -> DataFrame:
    found = {r.fault: r.n for r in member_faults(rows, item, path, cluster).collect() if r.n}
    if expected_rows is not None and rows.count() != expected_rows:
        found["rows"] = rows.count()
    if expected_clusters is not None and (n := rows.select(cluster).distinct().count()) != expected_clusters:
        found["clusters"] = n
    if found:
        raise ValueError(f"member table: {found}")
    return rows


def require_same_dimension(rows: DataFrame, vector: str) -> int:
    """The one length of the vectors; other lengths are an error."""
    sizes = [r[0] for r in rows.filter(F.col(vector).isNotNull()).select(F.size(vector)).distinct().limit(3).collect()]
    if len(sizes) != 1:
        raise ValueError(f"vector lengths: {sizes}")
    return sizes[0]


def require_disjoint(rows: DataFrame, key: str, split: str) -> DataFrame:
    if rows.groupBy(key).agg(F.countDistinct(split).alias("n")).filter("n > 1").limit(1).count():
        raise ValueError(f"{key} stands in more than one split")
    return rows


def require_splits(rows: DataFrame, split: str, needed: tuple[str, ...] = ("train", "val")) -> DataFrame:
    have = {r[0] for r in rows.select(split).distinct().limit(100).collect()}
    if not set(needed) <= have:
        raise ValueError(f"splits found: {sorted(map(str, have))}")
    return rows


def require_one_label(rows: DataFrame, group: str, label: str) -> DataFrame:
    """Every group has one label, null counting as a label of its own."""
    n = F.countDistinct(label) + F.max(F.col(label).isNull().cast("int"))
    if rows.groupBy(group).agg(n.alias("n")).filter("n <> 1").limit(1).count():
        raise ValueError(f"{group} with several values of {label}")
    return rows


def require_label_map(labels: DataFrame, mapping: DataFrame, label: str, index: str) -> DataFrame:
    """The mapping covers all labels, and its indexes run from 0 without a gap."""
    if labels.select(label).distinct().join(mapping.select(label), label, "left_anti").limit(1).count():
        raise ValueError("labels without an index")
    top, n = mapping.agg(F.max(index), F.countDistinct(index)).first()
    if top is not None and top + 1 != n:
        raise ValueError("indexes with gaps")
    return mapping


def require_finite(metrics: dict[str, float], allowed: set[str]) -> dict[str, float]:
    """Exactly the allowed keys, all values finite."""
    if set(metrics) != allowed:
        raise ValueError(f"metric keys: {sorted(set(metrics) ^ allowed)}")
    bad = [k for k, v in metrics.items() if v is None or v != v or abs(v) == float("inf")]
    if bad:
        raise ValueError(f"not finite: {bad}")
    return metrics


def require_prefix(found: DataFrame, expected: DataFrame, item: str, position: str) -> DataFrame:
    """The found ids are the expected ones up to the last found position, in order."""
    j = found.select(position, F.col(item).alias("_f")).join(expected.select(position, F.col(item).alias("_e")), position, "left")
    if j.filter(~F.col("_f").eqNullSafe(F.col("_e"))).limit(1).count():
        raise ValueError("ids differ from the expected prefix")
    return found


def no_missing(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    if rows.select(key).join(existing.select(key), key, "left_anti").limit(1).count():
        raise ValueError(f"rows without a result by {key}")
    return rows


def label_counts(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def majority(rows: DataFrame, label: str) -> DataFrame:
    """(label, accuracy) of the most frequent label, the smallest on a tie."""
    c = label_counts(rows.filter(F.col(label).isNotNull()), label)
    a = c.agg(F.max_by(F.struct(F.col(label), "n"), F.struct("n")).alias("m"), F.sum("n").alias("t"), F.max("n").alias("top"))
    total, top = a.select("t", "top").first() or (0, 0)
    return c.filter(F.col("n") == F.lit(top)).agg(F.min(label).alias(label)).withColumn("accuracy", F.lit((top or 0) / total if total else None).cast("double"))


def bucket(c: str, bounds: list[tuple[str, float]]) -> Column:
    """Name of the first bound the value does not exceed; null stays null, above the last it is that one's name plus '+'."""
    x = F.col(c)
    out = None
    for name, top in bounds:
        out = F.when(x <= top, name) if out is None else out.when(x <= top, name)
    return F.when(x.isNotNull(), out.otherwise(bounds[-1][0] + "+"))
