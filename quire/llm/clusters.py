"""Grouping records into similarity clusters by density peaks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from quire.llm.components import hash_to_min
from quire.llm.neighbours import _VALID
from quire.llm.vectors import BLOCK_ROWS, Block, block_join, fit_index, met_before, post, unit, valid_vectors
from quire.session import cut, release, table

#: Rows per list here; lists a vector is stored in and searches at most, and how far beyond the nearest they may be.
PEAK_LIST_ROWS = 32
REPLICAS, PROBES, REPLICA_RATIO, PROBE_RATIO = 5, 5, 1.2, 1.3


def _marks(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """Three numbers below 2^26 for each vector: sums of them tell sets of vectors apart."""
    with np.errstate(over="ignore"):
        x = (k1.astype(np.uint64) ^ (k2.astype(np.int64).astype(np.uint64) << np.uint64(17))) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return np.stack([x & np.uint64(0x3FFFFF), (x >> np.uint64(21)) & np.uint64(0x3FFFFF), (x >> np.uint64(42)) & np.uint64(0x3FFFFF)], axis=1).astype(np.float64)


def _reached(q: Block, t: Block, near: float) -> tuple[np.ndarray, np.ndarray]:
    """Similarities and where they reach near, settled in double where single precision leaves doubt."""
    s = q.u32 @ t.u32.T
    hit = s >= near
    for i, j in zip(*np.nonzero(np.abs(s - near) < 2e-6)):
        hit[i, j] = float(q.u64[i] @ t.u64[j]) >= near
    return s, hit


def _joined(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and each column of hit the number of a column: equal where hits connect them, directly or not. -1: no hit."""
    rows = np.where(hit.any(axis=1), hit.argmax(axis=1), -1)
    cols = np.where(hit.any(axis=0), rows[hit.argmax(axis=0)], -1)
    while True:
        at, to = np.nonzero(hit & (rows[:, None] != cols[None, :]))
        if not len(at):
            return rows, cols
        np.minimum.at(rows, at, cols[to])
        np.minimum.at(cols, to, rows[at])


def _in_groups(rows: DataFrame, near: float, block_rows: int) -> DataFrame:
    """(k1, k2, all_n, all_total) of rows in groups that may hold only rows near one another: each compared with its whole group.

    rows: (k1, k2, w, grp, head, parts, vec), head telling the member that stands for the group. A group with a
    member that is not near its head is left out, so what is compared lies around one vector. Groups are divided into
    parts of up to block_rows vectors; a task holds two of them.
    """

    def near_head(batches):
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            if batch.num_rows:
                a, b = (unit(get(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)) for c in ("vec", "head_vec"))
                yield pa.RecordBatch.from_arrays([get("grp"), pa.array(np.einsum("ij,ij->i", a, b) >= near)], names=["grp", "fits"])

    def cell(part: pa.Table) -> pa.Table:
        get = lambda c: part.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        u = unit(part.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1))
        own, w, low, high = get("own"), get("w").astype(np.float64), part.column("low")[0].as_py(), part.column("high")[0].as_py()
        here, there = np.flatnonzero(own == low), np.flatnonzero(own == high)
        n, total = np.zeros(len(own)), np.zeros(len(own))
        for i in range(0, len(here), 512):
            q = here[i : i + 512]
            s = u[q] @ u[there].T
            hit = s >= near
            s = np.where(hit, s, 0)
            n[q] += hit @ w[there]
            total[q] += s @ w[there]
            if low != high:
                n[there] += w[q] @ hit
                total[there] += w[q] @ s
        return pa.table({"k1": get("k1"), "k2": pa.array(get("k2"), pa.int32()), "all_n": n.astype(np.int64), "all_total": total})

    heads = rows.filter("head").select("grp", F.col("vec").alias("head_vec"))
    fits = rows.select("grp", "vec").join(heads, "grp").mapInArrow(near_head, "grp bigint, fits boolean")
    kept = fits.groupBy("grp").agg(F.min("fits").alias("fits")).filter("fits").select("grp")
    own = F.pmod(F.xxhash64("k2", "k1"), F.col("parts")).cast("int")
    placed = rows.join(kept, "grp").withColumn("own", own).select("grp", "k1", "k2", "w", "vec", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    placed = placed.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
    cells = placed.groupBy("grp", "low", "high").applyInArrow(cell, "k1 bigint, k2 int, all_n bigint, all_total double")
    return cells.groupBy("k1", "k2").agg(F.sum("all_n").alias("all_n"), F.sum("all_total").alias("all_total"))


def density_peaks(base: DataFrame, near: float, list_rows: int = PEAK_LIST_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, cluster_id, size, closed, closeness): the cluster of each row of base that has 2 or more rows near it.

    base: result of valid_vectors(). density is the number of other rows with a cosine of at least near (equal
    vectors are weighed, not compared). Every vector points to its most similar denser one among those near it (of
    equal density the one with the smaller id is denser); one without is a peak. The pointers are followed to the
    peak, which makes the label; cluster_id is the smallest id of the cluster, size its rows. closed tells whether
    every two rows of it are near one another and none is near a row outside. closeness is the mean similarity to the
    rows near. No rows, no result.

    Lists may miss a pair. Labels between which a pair was met make one group, so no met pair leaves a group. Each member's
    density and the sum of marks of what is near it are held against the whole group; where they do not fit, the
    group's rows are compared with one another directly. So a missed pair costs nothing as long as other pairs
    connect its rows.
    """
    index = fit_index(base, near, False, list_rows, block_rows)
    arrow = pa.schema([("k1", pa.int64()), ("k2", pa.int32()), ("w", pa.int64()), ("rep", pa.int64()), ("n", pa.int64()), *[(f"f{i}", pa.int64()) for i in range(3)], ("total", pa.float64())])

    def count(t: Block, q: Block, lst: int) -> list[np.ndarray] | None:
        s, hit = _reached(q, t, near)
        late = np.flatnonzero((q.lists[:, 0] != lst) & hit.any(axis=1))  # for these an earlier list may have counted the pair
        if len(late):
            at, to = np.nonzero(hit[late])
            again = met_before(q, t, late[at], to, lst)
            hit[late[at[again]], to[again]] = False
        some = np.flatnonzero(hit.any(axis=1))
        if not len(some):
            return None
        known = np.concatenate([t.w[:, None].astype(np.float64), _marks(t.k1, t.k2)], axis=1)
        sums = hit[some].astype(np.float64) @ known
        total = np.where(hit[some], s[some], 0).astype(np.float64) @ known[:, 0]
        own = q.lists[some, 0] == lst
        rep = np.array([q.ids[i][0] for i in some])
        return [q.k1[some], q.k2[some], np.where(own, q.w[some], 0), np.where(own, rep, np.iinfo(np.int64).max), *sums.astype(np.int64).T, total]

    counted = block_join(post(base, index, REPLICAS, PROBES, REPLICA_RATIO, PROBE_RATIO), count, "k1 bigint, k2 int, w bigint, rep bigint, n bigint, f0 bigint, f1 bigint, f2 bigint, total double", arrow)
    sums = [F.sum(c).alias(c) for c in ("n", "f0", "f1", "f2", "total")]
    stats = counted.groupBy("k1", "k2").agg(F.max("w").alias("w"), F.min("rep").alias("rep"), *sums).filter("n > w OR n >= 3")
    stats = cut(stats, "density")
    again = base.join(stats.select("k1", "k2", "rep", F.struct("n", "rep").alias("d")), ["k1", "k2"])
    point_arrow = pa.schema([("rep", pa.int64()), ("to_rep", pa.int64()), ("s", pa.float64())])

    def point(t: Block, q: Block, lst: int) -> list[np.ndarray] | None:
        _, hit = _reached(q, t, near)
        t_rep, q_rep = (np.array([x[0] for x in b.ids]) for b in (t, q))
        order = np.lexsort((t_rep, -t.x1))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        denser = (t.x1[None, :] > q.x1[:, None]) | ((t.x1[None, :] == q.x1[:, None]) & (t_rep[None, :] < q_rep[:, None]))
        s = np.where(hit & denser, q.u64 @ t.u64.T, -2.0)[:, order]
        best = s.argmax(axis=1)
        some = np.flatnonzero(s[np.arange(len(s)), best] > -2)
        q_to, t_to = _joined(hit)
        q_on, t_on = (np.flatnonzero((to >= 0) & (t_rep[to] != rep)) for to, rep in ((q_to, q_rep), (t_to, t_rep)))
        t_on = t_on[~np.isin(t_rep[t_on], q_rep)]
        if not len(some) and not len(q_on) and not len(t_on):
            return None
        linked = len(q_on) + len(t_on)
        return [np.concatenate([q_rep[some], q_rep[q_on], t_rep[t_on]]), np.concatenate([t_rep[order[best[some]]], t_rep[q_to[q_on]], t_rep[t_to[t_on]]]), np.concatenate([s[some, best[some]], np.full(linked, -2.0)])]

    seconds = again.select(F.col("rep").alias("id"), "vec", "k1", "k2", F.col("d.n").alias("n"))
    pointed = block_join(post(seconds, index, REPLICAS, PROBES, REPLICA_RATIO, PROBE_RATIO, "n"), point, "rep bigint, to_rep bigint, s double", point_arrow)
    best = F.max(F.when(F.col("s") > -2, F.struct("s", (-F.col("to_rep")).alias("minus"))))
    pointed = cut(pointed.groupBy("rep").agg((-best["minus"]).alias("to_rep"), F.collect_set(F.when(F.col("s") == -2, F.col("to_rep"))).alias("links")), "pointed")
    labels = cut(stats.join(pointed.select("rep", "to_rep"), "rep", "left").select("rep", F.coalesce("to_rep", "rep").alias("label")), "labels")
    while True:
        above = labels.select(F.col("rep").alias("label"), F.col("label").alias("above"))
        followed = cut(labels.join(above, "label", "left").select("rep", "label", F.coalesce("above", "label").alias("above")), "labels", drop=labels)
        moved = followed.filter("above <> label").limit(1).count()
        labels = followed.select("rep", F.col("above").alias("label"))
        labels._quire_uri = followed._quire_uri
        if not moved:
            break
    met = pointed.select("rep", F.explode("links").alias("other")).join(labels.select("rep", F.col("label").alias("a")), "rep")
    met = met.join(labels.select(F.col("rep").alias("other"), F.col("label").alias("b")), "other").filter("a <> b")
    met = cut(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "met", drop=pointed)
    known = stats.join(labels, "rep")
    if met.isEmpty():
        known = known.withColumn("grp", F.col("label"))
    else:
        groups = hash_to_min(met, "a", "b").select(F.col("node").alias("label"), F.col("component").alias("grp"))
        known = known.join(groups, "label", "left").withColumn("grp", F.coalesce("grp", "label"))
    marked = known.select("k1", "k2", "w", "rep", "n", "f0", "f1", "f2", "total", "label", "grp").mapInArrow(_with_marks, "k1 bigint, k2 int, w bigint, rep bigint, n bigint, f0 bigint, f1 bigint, f2 bigint, total double, label bigint, grp bigint, m0 bigint, m1 bigint, m2 bigint")
    whole = marked.groupBy("grp").agg(F.sum("w").alias("rows"), F.count(F.lit(1)).alias("different"), F.min("rep").alias("first"), *[F.sum(f"m{i}").alias(f"m{i}") for i in range(3)])
    fits = (F.col("n") == F.col("rows")) & (F.col("f0") == F.col("m0")) & (F.col("f1") == F.col("m1")) & (F.col("f2") == F.col("m2"))
    members = marked.drop("m0", "m1", "m2").join(whole, "grp").withColumn("fits", fits)
    members = cut(members.select("k1", "k2", "w", "rep", "label", "grp", "n", "total", "rows", "different", "first", "fits"), "members", drop=labels)
    release(stats)
    release(met)
    members = members.join(members.groupBy("grp").agg(F.min("fits").alias("closed")), "grp")
    doubt = members.filter("NOT closed AND rows >= 3")
    if not doubt.isEmpty():
        vecs = base.join(doubt.select("k1", "k2"), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("vec").alias("vec"))
        parts = F.ceil(F.col("different") / F.lit(block_rows)).cast("int")
        again = doubt.join(vecs, ["k1", "k2"]).select("k1", "k2", "w", "grp", (F.col("rep") == F.col("first")).alias("head"), parts.alias("parts"), "vec")
        members = members.join(_in_groups(cut(again, "doubt"), near, block_rows), ["k1", "k2"], "left")
        whole = F.min(F.coalesce(F.col("all_n") == F.col("rows"), F.lit(False)))
        closed = members.groupBy("grp").agg((F.max("closed") | whole).alias("now"))
        members = members.join(closed, "grp").select("k1", "k2", "w", "rep", "label", "grp", F.coalesce("all_n", "n").alias("n"), F.coalesce("all_total", "total").alias("total"), F.col("now").alias("closed"))
    members = members.filter("n >= 3").withColumn("own", F.when(F.col("closed"), F.col("grp")).otherwise(F.col("label")))
    whole = members.groupBy("own").agg(F.sum("w").alias("size"), F.min("rep").alias("cluster_id"))
    members = members.join(whole, "own").select("k1", "k2", "cluster_id", "size", "closed", (F.col("total") / F.col("n")).alias("closeness"))
    return base.select("id", "k1", "k2").join(members, ["k1", "k2"]).select("id", "cluster_id", "size", "closed", "closeness")


def _with_marks(batches):
    for batch in batches:
        m = _marks(batch.column(batch.schema.get_field_index("k1")).to_numpy(), batch.column(batch.schema.get_field_index("k2")).to_numpy()).astype(np.int64)
        names = ["k1", "k2", "w", "rep", "n", "f0", "f1", "f2", "total", "label", "grp"]
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in names] + [pa.array(m[:, i]) for i in range(3)], names=[*names, "m0", "m1", "m2"])


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density_peaks(valid_vectors(table(spark, sf_dir, "geniza_image_latents"), "id", "latent_vector", 64), 0.85)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).filter("closed AND size >= 3").select("cluster_id", "id")


def p2_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cluster of three or more pages: its size, whether it is closed, and its three most typical pages."""
    typical = F.slice(F.array_sort(F.collect_list(F.struct((-F.round("closeness", 6)).alias("minus"), "id"))), 1, 3)
    rows = _pages(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc(F.round("closeness", 6)), "id"))
    best = rows.withColumn("place", place).filter("place <= 3")
    return best.groupBy("cluster_id", "size", "closed").agg(F.transform(typical, lambda x: x["id"]).alias("typical_ids"))


QUERIES = {"p2_found": p2_found, "p2_clusters": p2_clusters}

SQL = {
    "p2_found": f"""
WITH {_VALID},
p AS (SELECT a, b FROM s WHERE c >= 0.85 UNION ALL SELECT id, id FROM v),
g AS (SELECT a, list_sort(list(b)) AS l FROM p GROUP BY a)
SELECT l[1] AS cluster_id, unnest(l) AS id FROM (SELECT l, count(*) AS n FROM g GROUP BY l) WHERE n = len(l) AND n >= 3""",
}
