"""Deterministic splits, samples and weights. Every random choice is the order of md5(id || seed)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.operators.ordering import running_total


def hash_key(c: str | Column, seed: int | str = 42) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.md5(F.concat(c.cast("string"), F.lit(str(seed))))


def hash_order(c: str, seed: int | str = 42) -> list[Column]:
    """Order by hash, then by the id, so that it is total."""
    return [hash_key(c, seed), F.col(c)]


def positional_split(rows: DataFrame, group: str, order: list[Column], train: float, val: float) -> DataFrame:
    """Per group the first floor(n * train) rows are train, the next up to floor(n * (train + val)) val, the rest test."""
    w = Window.partitionBy(group)
    i, n = F.row_number().over(w.orderBy(*order)) - 1, F.count(F.lit(1)).over(w)
    return rows.withColumn("split", F.when(i < F.floor(n * train), "train").when(i < F.floor(n * (train + val)), "val").otherwise("test"))


def clamped_split(rows: DataFrame, group: str, order: list[Column], fraction: float) -> DataFrame:
    """Per group max(1, min(n - 1, round(n * fraction))) rows are train, the rest val; single rows are train.

    Halves round to the even number.
    """
    w = Window.partitionBy(group)
    i, n = F.row_number().over(w.orderBy(*order)), F.count(F.lit(1)).over(w)
    cut = F.greatest(F.lit(1), F.least(n - 1, F.bround(n * F.lit(fraction)).cast("bigint")))
    return rows.withColumn("split", F.when((n == 1) | (i <= cut), "train").otherwise("val"))


def disjoint_split(rows: DataFrame, group: str, train: float, val: float, seed: int = 42) -> DataFrame:
    """Whole groups in hash order: the first floor(g * train) groups are train, and so on; column split.

    The position of a group comes from counts per hash range (256 of them), so no task orders all groups.
    """
    groups = rows.select(group).filter(F.col(group).isNotNull()).distinct().withColumn("_h", hash_key(group, seed))
    groups = groups.withColumn("_r", F.conv(F.substring("_h", 1, 2), 16, 10).cast("int"))
    counts = {r["_r"]: r["count"] for r in groups.groupBy("_r").count().collect()}
    total, before, upto = sum(counts.values()), {}, 0
    for r in sorted(counts):
        before[r], upto = upto, upto + counts[r]
    start = F.create_map(*[F.lit(x) for p in before.items() for x in p]) if before else F.create_map(F.lit(0), F.lit(0))
    at = F.row_number().over(Window.partitionBy("_r").orderBy("_h", group)) - 1 + start[F.col("_r")]
    split = F.when(at < int(total * train), "train").when(at < int(total * (train + val)), "val").otherwise("test")
    return rows.join(groups.withColumn("split", split).select(group, "split"), group)


def stratified_outer(items: DataFrame, item: str, label: str, test: float, least: int, seed: int = 42) -> DataFrame:
    """(item, label, split): per class round(n * test) items in hash order are test; classes below `least` are excluded."""
    w = Window.partitionBy(label)
    n, i = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(*hash_order(item, seed)))
    split = F.when(n < least, "excluded").when(i <= F.bround(n * F.lit(test)), "test").otherwise("train")
    return items.withColumn("split", split)


def folds(items: DataFrame, item: str, label: str, split: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Fold 0..k-1 of train items, dealt per class in hash order; -1 outside train."""
    i = F.row_number().over(Window.partitionBy(split, label).orderBy(*hash_order(item, seed))) - 1
    return items.withColumn("fold", F.when(F.col(split) == "train", i % k).otherwise(-1).cast("int"))


def fraction_sample(rows: DataFrame, group: str, item: str, fraction: float, seed: int = 42, rounding=F.bround) -> DataFrame:
    """round(fraction * n) rows of each group in hash order (a stratified sample)."""
    w = Window.partitionBy(group)
    i, n = F.row_number().over(w.orderBy(*hash_order(item, seed))), F.count(F.lit(1)).over(w)
    return rows.withColumn("_i", i).withColumn("_n", n).filter(F.col("_i") <= rounding(F.col("_n") * F.lit(fraction))).drop("_i", "_n")


def first_of_groups(rows: DataFrame, group: str, item: str, groups: int, per_group: int, seed: int = 42) -> DataFrame:
    """`groups` groups in hash order and of each the first `per_group` rows in hash order."""
    chosen = rows.select(group).filter(F.col(group).isNotNull()).distinct().orderBy(*hash_order(group, seed)).limit(groups)
    w = Window.partitionBy(group).orderBy(*hash_order(item, seed))
    return rows.join(chosen, group, "left_semi").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= per_group).drop("_n")


def fill_slots(rows: DataFrame, group: str, item: str, usable: Column, slots: int, seed: int = 42) -> DataFrame:
    """status of each row in hash order: rejected (not usable), accepted until the group's slots are full, else reserve."""
    w = Window.partitionBy(group).orderBy(*hash_order(item, seed)).rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum(usable.cast("int")).over(w)
    return rows.withColumn("status", F.when(~usable, "rejected").when(n <= slots, "accepted").otherwise("reserve"))


def pk_batches(rows: DataFrame, label: str, item: str, batch: int, k: int, batches: int, seed: int = 42) -> DataFrame:
    """(batch, label, slot, item): batch / k labels and k items of each; short classes repeat items.

    Labels and items are taken cyclically in hash order per round, so every label gets its turn.
    """
    if batch % k:
        raise ValueError("batch must be divisible by K")
    p = batch // k
    labels = rows.select(label).filter(F.col(label).isNotNull()).distinct().withColumn("_l", F.row_number().over(Window.orderBy(*hash_order(label, seed))) - 1)
    count = labels.count()
    if count < p:
        raise ValueError("too few labels")
    items = rows.join(labels, label).withColumn("_i", F.row_number().over(Window.partitionBy(label).orderBy(*hash_order(item, seed))) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(label)))
    plan = rows.sparkSession.range(batches * p).select((F.col("id") / p).cast("bigint").alias("batch"), (F.col("id") % count).alias("_l"), F.floor(F.col("id") / count).cast("bigint").alias("_turn"))
    plan = plan.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    plan = plan.join(items.groupBy("_l").agg(F.first("_n").alias("_n")), "_l").withColumn("_i", (F.col("_turn") * k + F.col("slot")) % F.col("_n"))
    return plan.join(items.select("_l", "_i", label, item), ["_l", "_i"]).select("batch", label, "slot", item)


def pair_sample(rows: DataFrame, item: str, label: str, n: int, seed: int = 42) -> DataFrame:
    """(item_1, item_2, kind): per kind up to n pairs without reuse: same label, and different labels.

    Rows in hash order are paired two by two inside a label for 'same'. For 'cross' they are dealt in rounds, of every label the
    first row, then of every label the second, so that rows beside one another differ in label while there are others.
    """
    w = Window.partitionBy(label).orderBy(*hash_order(item, seed))
    same = rows.withColumn("_i", F.row_number().over(w) - 1).withColumns({"_p": F.floor(F.col("_i") / 2), "_s": F.col("_i") % 2})
    same = same.groupBy(F.col(label), "_p").agg(F.max(F.when(F.col("_s") == 0, F.col(item))).alias("item_1"), F.max(F.when(F.col("_s") == 1, F.col(item))).alias("item_2")).filter("item_2 IS NOT NULL").select("item_1", "item_2", F.lit("same").alias("kind"))
    dealt = rows.filter(F.col(label).isNotNull()).select(F.col(item).alias("_item"), F.col(label).alias("_label"), F.row_number().over(w).alias("_round"), F.lit(1).cast("bigint").alias("_one"))
    order = [F.col("_round"), F.md5(F.concat_ws("|", F.col("_label").cast("string"), F.lit(str(seed)))), F.col("_label"), F.col("_item")]
    dealt = running_total(dealt, order, "_one", "_i").withColumns({"_p": F.floor((F.col("_i") - 1) / 2), "_s": (F.col("_i") - 1) % 2})
    one = lambda s, c: F.max(F.when(F.col("_s") == s, F.col(c)))
    cross = dealt.groupBy("_p").agg(one(0, "_item").alias("item_1"), one(1, "_item").alias("item_2"), one(0, "_label").alias("l1"), one(1, "_label").alias("l2")).filter("l1 <> l2").select("item_1", "item_2", F.lit("cross").alias("kind"))
    pick = lambda x: x.orderBy(F.md5(F.concat_ws("|", F.col("item_1").cast("string"), F.col("item_2").cast("string"), F.lit(str(seed)))), "item_1").limit(n)
    return pick(same).unionByName(pick(cross))


def cyclic_pick(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """One row per group and round, groups by their first row, until n rows are picked."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("_round", F.row_number().over(w)).orderBy("_round", group).limit(n).drop("_round")


def evenly_spaced(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """n rows at positions floor(i * (N - 1) / (n - 1)) of the whole order; all rows if there are no more than n.

    The position in the whole order comes from sums over its ranges, not from one task that holds all rows.
    """
    total = rows.count()
    if total <= n:
        return rows
    wanted = sorted({int(i * (total - 1) / max(1, n - 1)) for i in range(n)})
    s = running_total(rows.withColumn("_one", F.lit(1).cast("bigint")), order, "_one", "_at")
    return s.filter((F.col("_at") - 1).isin(wanted)).drop("_one", "_at")


def contiguous_shards(ids: DataFrame, item: str, shards: int) -> DataFrame:
    """(item, shard): the ids in order, in `shards` ranges of nearly equal size; more shards than ids leave some empty."""
    n = ids.count()
    s = running_total(ids.select(item, F.lit(1).cast("bigint").alias("_one")), [F.asc_nulls_first(item)], "_one", "_at")
    return s.select(item, F.floor((F.col("_at") - 1) * shards / max(n, 1)).cast("int").alias("shard"))


def page_weights(rows: DataFrame, group: str) -> DataFrame:
    """weight = 1 / rows of the group, scaled to a mean of 1."""
    r = rows.withColumn("_w", 1 / F.count(F.lit(1)).over(Window.partitionBy(group)))
    mean = r.agg(F.avg("_w")).first()[0]
    return r.withColumn("weight", F.col("_w") / F.lit(mean)).drop("_w")


def balanced_weights(rows: DataFrame, label: str, group: str) -> DataFrame:
    """weight = 1 / (groups of the label * rows of the group in it), scaled to a mean of 1: classes and groups weigh alike."""
    per = rows.groupBy(label, group).agg(F.count(F.lit(1)).alias("_n"))
    per = per.withColumn("_g", F.count(F.lit(1)).over(Window.partitionBy(label))).withColumn("_w", 1 / (F.col("_g") * F.col("_n")))
    total = per.agg(F.sum(F.col("_w") * F.col("_n")) / F.sum("_n")).first()[0]
    return rows.join(per.select(label, group, (F.col("_w") / F.lit(total)).alias("weight")), [label, group])


def round_robin(rows: DataFrame, owner: str, group: str, best: list[Column], group_order: list[Column], most: int) -> DataFrame:
    """Per owner up to `most` rows: one of each group in turn, the best rows of a group first, groups in group_order."""
    r = rows.withColumn("_round", F.row_number().over(Window.partitionBy(owner, group).orderBy(*best)))
    r = r.withColumn("_n", F.row_number().over(Window.partitionBy(owner).orderBy("_round", *group_order)))
    return r.filter(F.col("_n") <= most).drop("_round", "_n")


def line_budget(words: pd.DataFrame, budget: int) -> pd.DataFrame:
    """Of one page's words (line, place, confidence): whole lines by mean confidence while they fit, else a prefix of the best.

    For applyInPandas per page.
    """
    mean = words.groupby("line")["confidence"].agg(["mean", "size"]).reset_index().sort_values(["mean", "line"], ascending=[False, True], kind="stable")
    left, chosen = budget, []
    for row in mean.itertuples():
        if row.size <= left:
            chosen.append(row.line)
            left -= row.size
    if chosen or not len(mean):
        return words[words["line"].isin(chosen)]
    best = words[words["line"] == mean.iloc[0]["line"]].sort_values("place", kind="stable")
    return best.head(budget)
