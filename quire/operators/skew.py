"""Per-key results when a few keys hold most rows.

Both operators aggregate eagerly: each input is reduced to compact states per join key before the join, the
states are joined and combined algebraically, and the rows themselves are never grouped by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from quire.session import cut, release

#: Bins each key's range is divided into per round; a window over one key's states sees at most this many rows.
BINS = 1024
#: Rounds go on until no key's wanted bin holds more rows than this; only then are rows ordered.
FINAL_ROWS = 4096
#: A bin with more than one row in HOT_SHARE is hot: there are fewer than HOT_SHARE of them, so they may be broadcast.
HOT_SHARE = 1024


def key_states(rows: DataFrame, key: str | Column, rollup: list[str], **aggregates: Column) -> DataFrame:
    """One state per key (and rollup columns) of an input of a join: _k, rollup, aggregates; combined before the shuffle."""
    return rows.groupBy((F.col(key) if isinstance(key, str) else key).alias("_k"), *[F.col(c) for c in rollup]).agg(*[v.alias(k) for k, v in aggregates.items()])


def join_states(left: DataFrame, right: DataFrame) -> DataFrame:
    """Compact states of two inputs joined by key; equal nulls meet."""
    return left.join(right.withColumnRenamed("_k", "_rk"), F.col("_k").eqNullSafe(F.col("_rk"))).drop("_rk")


def eager_join_aggregate(
    left: DataFrame, right: DataFrame, key: str, rollup: list[str], left_value: str, right_value: str
) -> DataFrame:
    """Aggregates over left JOIN right ON key, grouped by rollup columns of the left, without forming the join.

    Result: rollup columns, pairs (rows of the join), left_sum and right_sum (sums of the two values over the
    join). Either side shrinks to one state per key (and rollup value) with a map-side combine; the join then
    meets states only: pairs = n_l * n_r, left_sum = s_l * n_r, right_sum = n_l * s_r.

    Null keys join nothing. A null value adds nothing to its sum; a sum without values is 0. Rollup values may be
    null and group together. Empty inputs give no rows. Other columns of either side are ignored.
    """
    total = lambda c: F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0))
    l_state = key_states(left.filter(F.col(key).isNotNull()), key, rollup, _nl=F.count(F.lit(1)), _sl=total(left_value))
    r_state = key_states(right.filter(F.col(key).isNotNull()), key, [], _nr=F.count(F.lit(1)), _sr=total(right_value))
    return (
        join_states(l_state, r_state)
        .groupBy(*rollup)
        .agg(
            F.sum(F.col("_nl") * F.col("_nr")).alias("pairs"),
            F.sum(F.col("_sl") * F.col("_nr")).alias("left_sum"),
            F.sum(F.col("_nl") * F.col("_sr")).alias("right_sum"),
        )
    )


def _bin(value: str, low: str, high: str):
    """Bin of a value in [low, high], never decreasing with the value; both ends fall inside."""
    half = lambda c: F.col(c).cast("double") / 2
    share = (half(value) - half(low)) / (half(high) - half(low))
    return F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(share * BINS).cast("int")))


def _ends() -> dict[str, Column]:
    return {"_v0": F.min("_v"), "_v1": F.max("_v"), "_i0": F.min("_i"), "_i1": F.max("_i")}


def _meet(rows: DataFrame, bins: DataFrame, hot_rows: int) -> DataFrame:
    """Rows joined with the wanted bins (_wk, _wb, _n, ...) on key and bin; hot bins, few by their share, are broadcast."""
    on = F.col("_k").eqNullSafe(F.col("_wk")) & (F.col("_b") == F.col("_wb"))
    hot = rows.join(F.broadcast(bins.filter(F.col("_n") >= hot_rows)), on)
    cold = rows.join(bins.filter(F.col("_n") < hot_rows), on)
    return hot.unionByName(cold).drop("_wk", "_wb", "_b", "_n")


def middle_rows(rows: DataFrame, key: str, value: str, row_id: str, final_rows: int = FINAL_ROWS) -> DataFrame:
    """For each key the row number ceil(n/2) in the order (value, row_id): columns key and row_id.

    value is a number, row_id an integer; repeated rows count as rows. The median is an aggregate over a join: each
    row joins the total of its key, and a row is the middle one if the rows up to it make half of that total. Neither
    input is joined as rows. One side is reduced to a state per (key, bin of the value): count and ends; the other to a
    state per key: its count, hence the rank still wanted. The states are joined, their counts add up to ranks, and the
    roll-up leaves for each key the one bin that holds the wanted rank. Only rows of that bin go on, to be divided
    finer, ties of the value by row_id; when every wanted bin is small, its rows are ordered. Rows meet the wanted
    bins by (key, bin); bins with a large share of all rows meet them by broadcast, so a hot key is never one task.

    The null key is a key of its own; rows with a null or NaN value or a null row_id are dropped, infinite values
    count as the largest finite ones. No rows, no result. Other columns are ignored.
    """
    most = 1.7976931348623157e308
    v = F.col(value).cast("double")
    left = rows.select(F.col(key).alias("_k"), v.alias("_v"), F.col(row_id).cast("bigint").alias("_i"))
    left = left.filter(F.col("_v").isNotNull() & ~F.isnan("_v") & F.col("_i").isNotNull())
    left = left.withColumn("_v", F.greatest(F.least("_v", F.lit(most)), F.lit(-most)))
    ends = left.agg(F.count(F.lit(1)).alias("_n"), *[c.alias(k) for k, c in _ends().items()]).first()
    hot_rows = max(final_rows, -(-ends["_n"] // HOT_SHARE))
    left = left.withColumns({c: F.lit(ends[c]).cast("double" if c[1] == "v" else "bigint") for c in _ends()})
    by_key, ranks, found, narrowed = Window.partitionBy("_k"), None, None, None
    while True:
        finer = F.when(F.col("_v1") > F.col("_v0"), _bin("_v", "_v0", "_v1")).when(F.col("_i1") > F.col("_i0"), _bin("_i", "_i0", "_i1"))
        binned = left.select("_k", "_v", "_i", F.coalesce(finer, F.lit(0)).alias("_b"))
        states = key_states(binned, "_k", ["_b"], _n=F.count(F.lit(1)), **_ends())
        if ranks is None:
            ranks = key_states(states, "_k", [], _rank=F.ceil(F.sum("_n") / 2).cast("bigint"))
        upto = F.sum("_n").over(by_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
        below = F.col("_to") - F.col("_n")
        chosen = join_states(states, ranks).withColumn("_to", upto).filter((F.col("_to") >= F.col("_rank")) & (below < F.col("_rank")))
        wanted = cut(chosen.withColumn("_rank", F.col("_rank") - below).drop("_to"), "wanted")
        open_ = (F.col("_v1") > F.col("_v0")) | (F.col("_i1") > F.col("_i0"))
        settled = wanted.filter(~open_).select(F.col("_k").alias(key), F.col("_i0").alias(row_id))
        settled = settled if found is None else found.unionByName(settled)
        largest = wanted.filter(open_).agg(F.max("_n")).first()[0] or 0
        bins = wanted.filter(open_).select(F.col("_k").alias("_wk"), F.col("_b").alias("_wb"), "_n", "_rank", *_ends())
        left = _meet(binned, bins, hot_rows)
        if largest <= final_rows:
            at = left.withColumn("_at", F.row_number().over(by_key.orderBy("_v", "_i"))).filter(F.col("_at") == F.col("_rank"))
            out = cut(at.select(F.col("_k").alias(key), F.col("_i").alias(row_id)).unionByName(settled), "middle")
        else:
            left, out = cut(left, "narrowed"), cut(settled, "settled")
        for old in (wanted, narrowed, found):
            if old is not None:
                release(old)
        if largest <= final_rows:
            return out
        found, narrowed = out, left
        ranks = left.groupBy("_k").agg(F.first("_rank").alias("_rank"))
