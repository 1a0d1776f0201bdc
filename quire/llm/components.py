"""Consolidating pairwise matches into groups by hash-to-min."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.functions.text import blank_to_null
from quire.session import cut, table

#: Vertices with more than this share of all (vertex, member) rows are joined by broadcast; fewer than 1 / share exist.
HOT_SHARE = 0.001
#: The least number of rows that makes a vertex hot.
HOT_ROWS = 10_000


def hash_to_min(links: DataFrame, a: str, b: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Connected components: one row (node, component) for every node that stands in a link of two different nodes.

    component is the smallest node of the component. Links with a null end and links of a node to itself are
    ignored, repeated and reversed links count once; other columns are ignored. No links, no result.

    Every vertex holds a cluster set, at first itself and its neighbours. In each round it sends the set to the
    set's minimum and that minimum to all others, until nothing changes. A set is kept as rows (vertex, member), so
    that of a large component is never one value or one task: minima come from a map-side combine, and a vertex
    whose set is large meets its minimum by a broadcast of such vertices, of which HOT_SHARE bounds the number.
    """
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u")), F.struct(F.col("a").alias("v"), F.col("a").alias("u")), F.struct(F.col("b").alias("v"), F.col("b").alias("u")))
    sets = cut(pairs.select(F.inline(both)).distinct(), "sets")
    seen = None
    while True:
        mark = sets.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        least = sets.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("n"))
        if mark[0] == 0 or seen == tuple(mark):
            return least.select(F.col("v").alias("node"), F.col("m").alias("component"))
        seen = tuple(mark)
        least = cut(least, "least")
        limit = max(hot_rows, int(mark[0] * HOT_SHARE))
        hot = least.filter(F.col("n") > limit).select("v", "m")  # at most mark[0] / limit rows
        cold_min = least.filter(F.col("n") <= limit).select("v", "m")
        cold = sets.join(F.broadcast(hot.select("v")), "v", "left_anti").join(cold_min, "v")
        met = cold.unionByName(sets.join(F.broadcast(hot), "v"))
        sent = F.array(F.struct(F.col("m").alias("v"), F.col("u").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))
        sets = cut(met.select(F.inline(sent)).distinct(), "sets", drop=sets)


def match_links(rows: DataFrame, least_score: float) -> DataFrame:
    """Links (a, b) of rows with a score of at least least_score; null and NaN scores link nothing."""
    score = F.coalesce(F.when(~F.isnan("similarity_score"), F.col("similarity_score")), F.lit(float("-inf")))
    return rows.filter(score >= least_score).select(
        blank_to_null("query_manuscript_id").alias("a"), blank_to_null("neighbor_manuscript_id").alias("b")
    )


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = match_links(table(spark, sf_dir, "geniza_knn_results"), 0.90)
    groups = hash_to_min(links, "a", "b")
    return groups.select(F.col("component").alias("group_id"), F.col("node").alias("manuscript_id"))


QUERIES = {"p7_found": p7_found}

SQL = {
    "p7_found": r"""
WITH RECURSIVE l AS (
  SELECT DISTINCT a, b FROM (
    SELECT regexp_replace(query_manuscript_id, '^\s+|\s+$', '', 'g') AS a,
           regexp_replace(neighbor_manuscript_id, '^\s+|\s+$', '', 'g') AS b
    FROM geniza_knn_results WHERE similarity_score >= 0.90 AND NOT isnan(similarity_score)) WHERE a <> b),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS v, a AS u FROM e UNION SELECT r.v, e.b FROM r JOIN e ON r.u = e.a)
SELECT min(u) AS group_id, v AS manuscript_id FROM r GROUP BY v""",
}
