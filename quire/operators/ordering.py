"""Looking at the next and the previous row of an order without bringing a key's rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.session import cut


def with_neighbours(rows: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """rows with next_<v> and prev_<v> of each value, by order within key; null at the ends of a key.

    Rows are divided by ranges of (key, order), so a hot key spans many partitions; inside one a window looks
    around, and at its borders the first and last row of the partitions beside it do, of which there is one each.
    Rows with equal order come in any order among themselves. Null keys are a key of their own.
    """
    s = rows.repartitionByRange(F.col(key), *order).withColumn("_pid", F.spark_partition_id())
    s = cut(s, "ranges")
    w = Window.partitionBy("_pid", key).orderBy(*order)
    s = s.withColumns({f"next_{v}": F.lead(v).over(w) for v in values} | {f"prev_{v}": F.lag(v).over(w) for v in values})
    s = s.withColumns({"_last": F.lead(F.lit(1)).over(w).isNull(), "_first": F.lag(F.lit(1)).over(w).isNull()})
    at = F.struct(F.col(key), *order)
    row = F.struct(F.col(key).alias("k"), *values)
    found = sorted(s.groupBy("_pid").agg(F.min_by(row, at).alias("a"), F.max_by(row, at).alias("b")).collect(), key=lambda r: r["_pid"])  # a row for each partition
    beside = []
    for i, r in enumerate(found):
        after = found[i + 1]["a"] if i + 1 < len(found) else None
        before = found[i - 1]["b"] if i else None
        beside.append((r["_pid"], tuple(after) if after else None, tuple(before) if before else None))
    kinds = "struct<" + ", ".join(f"{n}:{rows.schema[c].dataType.simpleString()}" for n, c in [("k", key), *((v, v) for v in values)]) + ">"
    if not beside:
        return s.drop("_pid", "_last", "_first")
    small = rows.sparkSession.createDataFrame(beside, f"_pid int, _after {kinds}, _before {kinds}")
    s = s.join(F.broadcast(small), "_pid")
    for v in values:
        s = s.withColumn(f"next_{v}", F.when(F.col("_last") & F.col("_after.k").eqNullSafe(F.col(key)), F.col(f"_after.{v}")).otherwise(F.col(f"next_{v}")))
        s = s.withColumn(f"prev_{v}", F.when(F.col("_first") & F.col("_before.k").eqNullSafe(F.col(key)), F.col(f"_before.{v}")).otherwise(F.col(f"prev_{v}")))
    return s.drop("_pid", "_last", "_first", "_after", "_before")


def running_total(rows: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """rows with the sum of value over all rows up to each one in a total order, itself included; no task holds all rows.

    Rows are divided by ranges of the order; the sums of the ranges, one row for each partition, are added up on the driver.
    A null value adds nothing; rows of equal order come in any order among themselves.
    """
    s = cut(rows.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()), "ranges")
    before, total = [], 0
    for r in sorted(s.groupBy("_pid").agg(F.sum(value).alias("n")).collect(), key=lambda r: r["_pid"]):
        before.append((r["_pid"], total))
        total += r["n"] or 0
    if not before:
        return s.drop("_pid").withColumn(name, F.lit(None).cast(rows.select(F.sum(value).alias("n")).schema["n"].dataType))
    small = rows.sparkSession.createDataFrame(before, f"_pid int, _before {rows.select(F.sum(value).alias('n')).schema['n'].dataType.simpleString()}")
    inside = F.sum(value).over(Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return s.join(F.broadcast(small), "_pid").withColumn(name, F.col("_before") + F.coalesce(inside, F.lit(0))).drop("_pid", "_before")
