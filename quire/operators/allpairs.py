"""All-pairs similarity in blocks: exact neighbours under exclusions, and pair tables.

The pairs of blocks form a grid; a task holds two blocks of at most `block` rows, whatever the number of rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.functions.vectors import unit, valid
from quire.session import cut

BLOCK = 4096


def normalised(rows: DataFrame, item: str, vector: str, **extra: str | Column) -> DataFrame:
    """(item, vec, extras) of the rows with a valid vector; vec has length 1 in double."""
    cols = [(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in extra.items()]
    return rows.filter(valid(vector)).select(F.col(item).alias("item"), unit(vector).alias("vec"), *cols)


def _grid(rows: DataFrame, block: int, triangle: bool) -> DataFrame:
    n = max(1, -(-rows.count() // block))
    b = F.pmod(F.xxhash64("item"), F.lit(n)).cast("int")
    every = F.sequence(F.lit(0), F.lit(n - 1))
    rows = rows.withColumn("_b", b)
    cells = F.filter(every, lambda x: x >= F.col("_b")) if triangle else every
    left = rows.select("*", F.explode(cells).alias("_c")).withColumns({"_q": F.col("_b"), "_t": F.col("_c"), "_side": F.lit(0)})
    cells = F.filter(every, lambda x: x <= F.col("_b")) if triangle else every
    right = rows.select("*", F.explode(cells).alias("_c")).withColumns({"_q": F.col("_c"), "_t": F.col("_b"), "_side": F.lit(1)})
    return left.unionByName(right).drop("_b", "_c")


def _matrix(v: pd.Series) -> np.ndarray:
    return np.array(v.tolist(), dtype=np.float64)


def knn(rows: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """Neighbours of every row in both editions: query, neighbor, similarity_score, edition, neighbor_rank, same_group, same_family.

    rows: item (bigint), vec (see normalised()), grp and fam (string, null for unknown). Edition 'overall' leaves
    out the row itself, 'joins' also rows of the same group and rows of the same family; an unknown family matches
    nothing. Excluded rows never appear, so there may be fewer than k. Order: similarity descending, item ascending.
    One matrix product per block serves both editions. No rows: no result.
    """
    schema = "query bigint, neighbor bigint, similarity_score double, edition string, same_group boolean, same_family boolean"

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        q, t = pdf[pdf["_side"] == 0].reset_index(drop=True), pdf[pdf["_side"] == 1].sort_values("item", ignore_index=True)
        if not len(q) or not len(t):
            return pd.DataFrame({"query": [], "neighbor": [], "similarity_score": [], "edition": [], "same_group": [], "same_family": []})
        tv, out = _matrix(t["vec"]), []
        for a in range(0, len(q), 1024):
            part = q.iloc[a : a + 1024]
            s = _matrix(part["vec"]) @ tv.T
            same = part["item"].to_numpy()[:, None] == t["item"].to_numpy()[None, :]
            grp = (part["grp"].to_numpy()[:, None] == t["grp"].to_numpy()[None, :]) & part["grp"].notna().to_numpy()[:, None]
            fam = (part["fam"].to_numpy()[:, None] == t["fam"].to_numpy()[None, :]) & part["fam"].notna().to_numpy()[:, None]
            for edition, out_of in (("overall", same), ("joins", same | grp | fam)):
                scored = np.where(out_of, -np.inf, s)
                top = np.argsort(-scored, axis=1, kind="stable")[:, :k]
                i = np.repeat(np.arange(len(part)), top.shape[1])
                j = top.ravel()
                keep = np.isfinite(scored[i, j])
                i, j = i[keep], j[keep]
                out.append(pd.DataFrame({"query": part["item"].to_numpy()[i], "neighbor": t["item"].to_numpy()[j], "similarity_score": s[i, j], "edition": edition, "same_group": grp[i, j], "same_family": fam[i, j]}))
        return pd.concat(out)

    best = _grid(rows.select("item", "vec", "grp", "fam"), block, False).groupBy("_q", "_t").applyInPandas(work, schema)
    rank = F.row_number().over(Window.partitionBy("edition", "query").orderBy(F.desc("similarity_score"), "neighbor"))
    return best.withColumn("neighbor_rank", rank).filter(F.col("neighbor_rank") <= k)


def pair_table(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Unordered pairs (id_1 < id_2) with their cosine and the label of either: the pair table itself is the result."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        q, t = (pdf[pdf["_side"] == i].sort_values("item", ignore_index=True) for i in (0, 1))
        same = int(pdf["_q"].iloc[0]) == int(pdf["_t"].iloc[0])
        out = [pd.DataFrame({"id_1": [], "id_2": [], "label_1": [], "label_2": [], "similarity": []})]
        if len(q) and len(t):
            tv = _matrix(t["vec"])
            for a in range(0, len(q), 256):
                part = q.iloc[a : a + 256]
                s = _matrix(part["vec"]) @ tv.T
                x, y = part["item"].to_numpy(), t["item"].to_numpy()
                i, j = np.nonzero(x[:, None] < y[None, :]) if same else np.nonzero(np.ones_like(s, dtype=bool))
                swap = x[i] > y[j]
                l1, l2 = part["label"].to_numpy()[i], t["label"].to_numpy()[j]
                out.append(pd.DataFrame({"id_1": np.where(swap, y[j], x[i]), "id_2": np.where(swap, x[i], y[j]), "label_1": np.where(swap, l2, l1), "label_2": np.where(swap, l1, l2), "similarity": s[i, j]}))
        return pd.concat(out)

    grid = _grid(rows.select("item", "vec", F.col("label").cast("bigint").alias("label")), block, True)
    return grid.groupBy("_q", "_t").applyInPandas(work, "id_1 bigint, id_2 bigint, label_1 bigint, label_2 bigint, similarity double")


def ranks_of_relevant(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(query, relevant, score, rank): the rank of every item of the query's label among all other items.

    The direct form without a pair table: each block counts, for the scores of a query's relevant items, the items
    that come before (higher score, or the same and a smaller id); the counts are added over the blocks.
    """

    def same_label(pdf: pd.DataFrame) -> pd.DataFrame:
        q, t = pdf[pdf["_side"] == 0], pdf[pdf["_side"] == 1]
        if not len(q) or not len(t):
            return pd.DataFrame({"item": [], "r_item": [], "score": []})
        a, b = q["item"].to_numpy(), t["item"].to_numpy()
        i, j = np.nonzero((q["label"].to_numpy()[:, None] == t["label"].to_numpy()[None, :]) & (a[:, None] != b[None, :]))
        return pd.DataFrame({"item": a[i], "r_item": b[j], "score": np.einsum("ij,ij->i", _matrix(q["vec"])[i], _matrix(t["vec"])[j])})

    pairs = _grid(rows.select("item", "vec", "label"), block, False).groupBy("_q", "_t").applyInPandas(same_label, "item bigint, r_item bigint, score double")
    n = max(1, -(-rows.count() // block))
    cells = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_t")
    wanted = cut(pairs, "wanted").select("*", F.pmod(F.xxhash64("item"), F.lit(n)).cast("int").alias("_q"), cells)  # rows of ids and scores meet the blocks, no lists
    grid = _grid(rows.select("item", "vec"), block, False)

    def work(pdf: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        q, t = pdf[pdf["_side"] == 0], pdf[pdf["_side"] == 1].sort_values("item")
        out = [pd.DataFrame({"query": [], "relevant": [], "score": [], "ahead": []})]
        if len(q) and len(t) and len(asked):
            ids, places = t["item"].to_numpy(), {x: i for i, x in enumerate(q["item"].to_numpy())}
            tv, qv = _matrix(t["vec"]), _matrix(q["vec"])
            for item, part in asked.groupby("item", sort=False):
                row, score, rel = np.round(qv[places[item]] @ tv.T, 12), np.round(part["score"].to_numpy(), 12), part["r_item"].to_numpy()
                order = np.argsort(-row, kind="stable")
                low, by_id = -row[order], ids[order]
                first, last = np.searchsorted(low, -score, "left"), np.searchsorted(low, -score, "right")
                ahead = first.copy()
                for i in np.flatnonzero(last > first):
                    ahead[i] += np.searchsorted(by_id[first[i] : last[i]], rel[i], "left")
                me = np.flatnonzero(ids == item)
                if len(me):
                    ahead -= (row[me[0]] > score) | ((row[me[0]] == score) & (item < rel))
                out.append(pd.DataFrame({"query": item, "relevant": rel, "score": score, "ahead": ahead}))
        return pd.concat(out)

    counted = grid.groupBy("_q", "_t").cogroup(wanted.groupBy("_q", "_t")).applyInPandas(work, "query bigint, relevant bigint, score double, ahead bigint")
    return counted.groupBy("query", "relevant").agg(F.first("score").alias("score"), (F.sum("ahead") + 1).alias("rank"))
