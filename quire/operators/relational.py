"""Filters, joins, set operations and keyed reads over DataFrames."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.functions.text import blank_to_null, normal_path

_IDENT = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def identifier(name: str) -> str:
    """The name if it is a plain identifier, else an error; for the few places where SQL text is built."""
    if not _IDENT.fullmatch(name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def ordered_children(rows: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """One row per key with its child rows as an array in order."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("children"))


def with_defaults(rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Nulls replaced column by column."""
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def by_path(rows: DataFrame, keys: DataFrame, path: str = "image_path", key_path: str = "image_path") -> DataFrame:
    """Rows whose path, in normal form, is among the keys' paths."""
    k = keys.select(normal_path(key_path).alias("_p")).distinct()
    return rows.withColumn("_p", normal_path(path)).join(k, "_p", "left_semi").drop("_p")


def where_all(rows: DataFrame, predicates: list[Column]) -> DataFrame:
    """Rows that meet every predicate; no predicates keep all."""
    return rows.filter(reduce(lambda a, b: a & b, predicates)) if predicates else rows


def present_predicates(rows: DataFrame, wanted: dict[str, object]) -> list[Column]:
    """Equality predicates for the wanted columns that the rows have."""
    return [F.col(identifier(c)) == F.lit(v) for c, v in wanted.items() if c in rows.columns]


def boolean(c: str | Column) -> Column:
    """Null stays null; true, t, 1 and yes in any case are true, all else is false."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNull(), None).otherwise(F.lower(F.trim(c.cast("string"))).isin("true", "t", "1", "yes"))


def derived_path(base: str, manuscript: str = "manuscript_id", parent: str = "parent_directory", picture: str = "picture_id", path: str = "image_path") -> Column:
    """The stored path, else base/manuscript/parent/picture."""
    return F.coalesce(F.col(path), F.concat_ws("/", F.lit(base), blank_to_null(manuscript), F.col(parent), F.col(picture)))


def without_existing(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the existing ones (an anti join)."""
    return rows.join(existing.select(key), key, "left_anti")


def many_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that fails if a key occurs twice on the right."""
    if right.groupBy(key).count().filter("count > 1").limit(1).count():
        raise ValueError(f"{key} is not unique on the right side")
    return left.join(right, key)


def suffixed_pairs(rows: DataFrame, index: str, on: list[str] | None = None) -> DataFrame:
    """Unordered pairs (index_1 < index_2) within equal `on` columns, every column suffixed _1 and _2."""
    a = rows.select(*[F.col(c).alias(c + "_1") for c in rows.columns])
    b = rows.select(*[F.col(c).alias(c + "_2") for c in rows.columns])
    cond = F.col(index + "_1") < F.col(index + "_2")
    for c in on or []:
        cond = cond & (F.col(c + "_1") == F.col(c + "_2"))
    return a.join(b, cond)


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; ties must be settled by the order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], version: str, keep: list[str] | None = None) -> DataFrame:
    """Target with updates applied: the highest version of each key wins, an update over the target on a tie.

    keep: columns that an update does not set; they stay as the target has them, null for new keys.
    """
    keep = keep or []
    u = updates.withColumn("_side", F.lit(1))
    t = target.withColumn("_side", F.lit(0))
    both = first_per_key(t.unionByName(u), keys, [F.desc(version), F.desc("_side")]).drop("_side")
    if not keep:
        return both
    held = target.select(*keys, *[F.col(c).alias("_" + c) for c in keep])
    return both.drop(*keep).join(held, keys, "left").select(*[F.col("_" + c).alias(c) if c in keep else F.col(c) for c in target.columns])


def dense_index(rows: DataFrame, column: str) -> DataFrame:
    """(value, index): the different non-null values in order, numbered from 0."""
    v = rows.select(F.col(column).alias("value")).filter("value IS NOT NULL").distinct()
    return v.withColumn("index", F.row_number().over(Window.orderBy("value")) - 1)


def overlap_counts(rows: DataFrame, key: str, split: str) -> DataFrame:
    """(key, splits): keys that stand in more than one split."""
    return rows.groupBy(key).agg(F.countDistinct(split).alias("splits")).filter("splits > 1")


def page_number(c: str = "page_number") -> Column:
    """The first run of digits as a number, 0 without one."""
    return F.coalesce(F.expr(f"try_cast(regexp_extract({identifier(c)}, '([0-9]+)', 1) AS int)"), F.lit(0))
