"""Most similar vectors for every vector, over balanced posting lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quire.llm.vectors import BLOCK_ROWS, LIST_ROWS, Block, block_join, fit_index, post, unit, valid_vectors
from quire.session import table

#: Lists a vector is stored in and searches at most, and how far beyond the nearest centroid they may be.
REPLICAS, PROBES, REPLICA_RATIO, PROBE_RATIO = 4, 4, 1.15, 1.3
#: Different vectors in a block of the exact grid.
GRID_ROWS = 32_768


def nearest(base: DataFrame, k: int, min_similarity: float, list_rows: int = LIST_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, neighbours): for each row of base its k most similar other rows as an array of (similarity, id).

    base: result of valid_vectors(). similarity is the cosine in double, rounded to 6 decimals; order: similarity
    descending, id ascending; rows below min_similarity are no neighbours, so arrays may be shorter than k (rows
    without any are left out). Equal vectors are searched for once and every row of them
    gets its own neighbours. No rows, no result.

    Lists are balanced (a full list gets further centroids, then shards), vectors near a border are stored in
    several, and a query searches the lists that a ratio to its nearest centroid leaves. In a block every target
    whose similarity may reach the k-th is compared again in double, so only lists not searched cost accuracy.
    """
    want = k + 1
    index = fit_index(base, max(min_similarity, 0.5), True, list_rows, block_rows)
    posted = post(base, index, REPLICAS, PROBES, REPLICA_RATIO, PROBE_RATIO, held_ids=want)
    arrow = pa.schema([("k1", pa.int64()), ("k2", pa.int32()), ("score", pa.float64()), ("n", pa.int64())])

    def work(t: Block, q: Block, lst: int) -> list[np.ndarray] | None:
        s = q.u32 @ t.u32.T
        if s.shape[1] > want:
            floor = np.maximum(np.partition(s, -want, axis=1)[:, -want] - 2e-6, min_similarity - 1e-6)
        else:
            floor = np.full(len(s), min_similarity - 1e-6)
        at, to = np.nonzero(s >= floor[:, None])
        exact = np.einsum("ij,ij->i", q.u64[at], t.u64[to])
        good = exact >= min_similarity
        at, to, score = at[good], to[good], np.round(exact[good], 6)
        if not len(at):
            return None
        held = np.array([len(t.ids[j]) for j in to])
        ids = np.concatenate([t.ids[j] for j in to])
        at, score = np.repeat(at, held), np.repeat(score, held)
        order = np.lexsort((ids, -score, at))
        at, ids, score = at[order], ids[order], score[order]
        starts = np.flatnonzero(np.append(True, np.diff(at) != 0))
        place = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
        keep = place < want
        at, ids, score = at[keep], ids[keep], score[keep]
        return [q.k1[at], q.k2[at], score, ids]

    hits = block_join(posted, work, "k1 bigint, k2 int, score double, n bigint", arrow, want)
    return _of_rows(base, hits, k)


def _of_rows(base: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """The k best hits (k1, k2, score, n) of every row of base, itself left out."""
    best = hits.groupBy("k1", "k2").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("minus"), "n"))), 1, k + 1).alias("best"))
    rows = base.select("id", "k1", "k2").join(best, ["k1", "k2"])
    others = F.slice(F.filter("best", lambda x: x["n"] != F.col("id")), 1, k)
    return rows.select("id", F.transform(others, lambda x: F.struct((-x["minus"]).alias("similarity"), x["n"].alias("id"))).alias("neighbours")).filter(F.size("neighbours") > 0)


def _best_hits(at: np.ndarray, ids: np.ndarray, score: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `want` best (score descending, id ascending) of each value of at."""
    order = np.lexsort((ids, -score, at))
    at, ids, score = at[order], ids[order], score[order]
    starts = np.flatnonzero(np.append(True, np.diff(at) != 0)) if len(at) else np.zeros(0, dtype=np.int64)
    keep = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at)))) < want
    return at[keep], ids[keep], score[keep]


def _reached(s: np.ndarray, want: int) -> np.ndarray:
    """For each row a value that at least `want` of its columns reach: the want-th of the maxima of groups of columns."""
    if s.shape[1] <= want:
        return np.full(len(s), -2, dtype=np.float32)
    step = min(128, max(1, s.shape[1] // (8 * want)))
    groups = s.shape[1] // step
    top = s[:, : groups * step].reshape(len(s), groups, step).max(axis=2)
    return np.partition(top, -want, axis=1)[:, -want] - 3e-6


def nearest_of_all(base: DataFrame, k: int, block: int = GRID_ROWS) -> DataFrame:
    """nearest() without a floor, exact: every row is compared with every other, so each has k neighbours if there are k others.

    Where no other row is near, the nearest ones are scattered over most lists, so lists do not prune. Different
    vectors are divided into blocks; a task holds two of them and one product serves the rows of both, in single
    precision first and in double for what may be among the best. Quadratic in the number of different vectors.
    """
    want = k + 1
    place = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("id"))
    held = base.withColumn("place", place).filter(F.col("place") <= want).groupBy("k1", "k2").agg(F.first("vec").alias("vec"), F.collect_list("id").alias("ids"))
    n = max(1, -(-base.count() // block))
    own = F.pmod(F.xxhash64("k2", "k1"), F.lit(n)).cast("int")
    placed = held.withColumn("own", own).select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other"))
    placed = placed.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})

    def work(cell: pa.Table) -> pa.Table:
        get = lambda c: cell.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        raw = cell.column("vec").combine_chunks()
        u64 = unit(raw.flatten().to_numpy(zero_copy_only=False).reshape(len(raw), -1))
        u32, own, low, high = u64.astype(np.float32), get("own"), cell.column("low")[0].as_py(), cell.column("high")[0].as_py()
        ids = cell.column("ids").combine_chunks()
        many, ids = ids.value_lengths().to_numpy(zero_copy_only=False), ids.flatten().to_numpy(zero_copy_only=False)
        first = np.cumsum(many) - many
        here, there = np.flatnonzero(own == low), np.flatnonzero(own == high)

        def hits(q: np.ndarray, t: np.ndarray, near: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
            for i in range(0, len(near[0]), 200_000):
                a, b = q[near[0][i : i + 200_000]], t[near[1][i : i + 200_000]]
                score = np.round(np.einsum("ij,ij->i", u64[a], u64[b]), 6)
                at, copies = np.repeat(a, many[b]), np.arange(many[b].sum()) - np.repeat(np.cumsum(many[b]) - many[b], many[b])
                found.append(_best_hits(at, ids[np.repeat(first[b], many[b]) + copies], np.repeat(score, many[b]), want))
            return _best_hits(*(np.concatenate(x) for x in zip(*found)), want)

        kept, most = [], np.full((want, len(there)), -2, dtype=np.float32)  # most: the largest of groups of rows, for each column
        for i in range(0, len(here), 512):
            q = here[i : i + 512]
            s = u32[q] @ u32[there].T
            kept.append(hits(q, there, np.nonzero(s >= _reached(s, want)[:, None])))
            if low != high:
                top = np.maximum.reduceat(s, np.arange(0, len(q), min(32, max(1, len(q) // want))), axis=0)
                most = np.partition(np.concatenate([most, top]), -want, axis=0)[-want:]
                at, to = np.nonzero(s >= most[0] - 3e-6)
                kept.append(hits(there, q, (to, at)))
        at, n_id, score = _best_hits(*(np.concatenate(x) for x in zip(*kept)), want)
        return pa.table({"k1": get("k1")[at], "k2": pa.array(get("k2")[at], pa.int32()), "score": score, "n": n_id})

    cells = placed.groupBy("low", "high").applyInArrow(work, "k1 bigint, k2 int, score double, n bigint")
    return _of_rows(base, cells, k)


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each valid page its five most similar pages, however similar they are."""
    base = valid_vectors(table(spark, sf_dir, "geniza_image_latents"), "id", "latent_vector", 64)
    out = nearest_of_all(base, 5).select("id", F.posexplode("neighbours").alias("p", "x"))
    return out.select("id", (F.col("p") + 1).alias("neighbor_rank"), F.col("x.id").alias("neighbor_id"), F.col("x.similarity").alias("similarity"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = valid_vectors(table(spark, sf_dir, "geniza_image_latents"), "id", "latent_vector", 64)
    pairs = nearest(base, 5, 0.85).filter(F.size("neighbours") == 5).select("id", F.explode("neighbours.id").alias("n"))
    return pairs.select(F.least("id", "n").alias("id_1"), F.greatest("id", "n").alias("id_2")).distinct()


QUERIES = {"p4_found": p4_found, "p4_neighbours": p4_neighbours}

_VALID = """
v AS (SELECT id, CAST(latent_vector AS DOUBLE[]) AS x FROM geniza_image_latents
      WHERE len(latent_vector) = 64 AND len(list_filter(latent_vector, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0
        AND len(list_filter(latent_vector, lambda e: e <> 0)) > 0),
u AS (SELECT id, x, sqrt(list_inner_product(x, x)) AS n FROM v),
s AS (SELECT a.id AS a, b.id AS b, list_inner_product(a.x, b.x) / (a.n * b.n) AS c FROM u a JOIN u b ON a.id <> b.id)"""

SQL = {
    "p4_found": f"""
WITH {_VALID},
r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY round(c, 6) DESC, b) AS k, count(*) OVER (PARTITION BY a) AS n FROM s WHERE c >= 0.85)
SELECT DISTINCT least(a, b) AS id_1, greatest(a, b) AS id_2 FROM r WHERE n >= 5 AND k <= 5""",
    "p4_neighbours": f"""
WITH {_VALID},
r AS (SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY round(c, 6) DESC, b) AS k FROM s)
SELECT a AS id, k AS neighbor_rank, b AS neighbor_id, round(c, 6) AS similarity FROM r WHERE k <= 5""",
}
