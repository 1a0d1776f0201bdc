"""Neighbour search, success and precision reports, pair tables and their metrics (J13-J16, A, M, V groups)."""

from __future__ import annotations

from pyspark.sql import SparkSession, functions as F, Window

from quire.functions import vectors as V
from quire.functions.text import blank_to_null, trimmed
from quire.operators import metrics as M
from quire.operators.allpairs import knn, normalised, pair_table, ranks_of_relevant
from quire.session import table as t

QUERIES, SQL = {}, {}
TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_E = """
e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS (SELECT id, label, CASE WHEN label % 3 <> 0 OR label % 2 = 1 THEN CAST(label % 3 AS VARCHAR) END AS fam, list_transform(x, lambda y: y / greatest(sqrt(list_inner_product(x, x)), 1e-12)) AS x FROM e)"""


def _items(spark, d):
    label = F.col("label")
    fam = F.when((label % 3 != 0) | (label % 2 == 1), (label % 3).cast("string"))
    return normalised(t(spark, d, "embeddings"), "vec_id", "embedding", grp=label.cast("string"), fam=fam, label=label)


def _neighbours(spark, d, k=10):
    return knn(_items(spark, d).select("item", "vec", "grp", "fam"), k)


@query(f"""
WITH {_E}, s AS (SELECT a.id AS query_id, b.id AS neighbor_id, list_inner_product(a.x, b.x) AS sim, a.label = b.label AS same_group, coalesce(a.fam = b.fam, false) AS same_family FROM u a JOIN u b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, neighbor_id) AS neighbor_rank FROM s)
SELECT query_id, neighbor_id, neighbor_rank, round(sim, 6) AS similarity_score, round(1 - sim, 6) AS distance_score, same_group, same_family FROM r WHERE neighbor_rank <= 10""")
def j13_knn_overall(spark: SparkSession, d: str):
    """Ten nearest of every vector, leaving out only itself."""
    r = _neighbours(spark, d).filter("edition = 'overall'")
    return r.select(F.col("query").alias("query_id"), F.col("neighbor").alias("neighbor_id"), F.col("neighbor_rank").cast("bigint").alias("neighbor_rank"), F.round("similarity_score", 6).alias("similarity_score"), F.round(1 - F.col("similarity_score"), 6).alias("distance_score"), "same_group", "same_family")


@query(f"""
WITH {_E}, s AS (SELECT a.id AS query_id, b.id AS neighbor_id, list_inner_product(a.x, b.x) AS sim FROM u a JOIN u b ON a.label <> b.label AND NOT coalesce(a.fam = b.fam, false)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, neighbor_id) AS neighbor_rank FROM s)
SELECT query_id, neighbor_id, neighbor_rank, round(sim, 6) AS similarity_score FROM r WHERE neighbor_rank <= 10""")
def j14_knn_joins(spark, d):
    """Ten nearest outside the own group and family."""
    r = _neighbours(spark, d).filter("edition = 'joins'")
    return r.select(F.col("query").alias("query_id"), F.col("neighbor").alias("neighbor_id"), F.col("neighbor_rank").cast("bigint").alias("neighbor_rank"), F.round("similarity_score", 6).alias("similarity_score"))


@query("""
SELECT query_image_path, id, r AS neighbor_rank FROM (SELECT query_image_path, id, row_number() OVER (PARTITION BY query_image_path ORDER BY similarity_score DESC, id) AS r
FROM geniza_knn_results WHERE similarity_score IS NOT NULL AND NOT isnan(similarity_score)) WHERE r <= 10""")
def w2_top_k(spark, d):
    rows = t(spark, d, "geniza_knn_results").filter(F.col("similarity_score").isNotNull() & ~F.isnan("similarity_score")).select("query_image_path", "id", "similarity_score")
    w = Window.partitionBy("query_image_path").orderBy(F.desc("similarity_score"), "id")
    return rows.withColumn("neighbor_rank", F.row_number().over(w)).filter("neighbor_rank <= 10").select("query_image_path", "id", F.col("neighbor_rank").cast("bigint").alias("neighbor_rank"))


@query(f"SELECT {TRIM.format('manuscript_id')} AS manuscript_id, count(*) AS images FROM geniza_image_latents GROUP BY 1")
def a1_count_per_manuscript(spark, d):
    return t(spark, d, "geniza_image_latents").groupBy(trimmed("manuscript_id").alias("manuscript_id")).agg(F.count(F.lit(1)).alias("images"))


@query(f"""
SELECT lib || '||' || root AS shelfmark, count(*) AS rows_n FROM (SELECT {TRIM.format('normalized_library')} AS lib, {TRIM.format('shelfmark_root')} AS root FROM geniza_manuscript_shelfmark)
WHERE lib <> '' AND root <> '' GROUP BY 1""")
def a2_count_per_shelfmark(spark, d):
    key = F.concat_ws("||", blank_to_null("normalized_library"), blank_to_null("shelfmark_root"))
    rows = t(spark, d, "geniza_manuscript_shelfmark").filter(blank_to_null("normalized_library").isNotNull() & blank_to_null("shelfmark_root").isNotNull())
    return rows.groupBy(key.alias("shelfmark")).agg(F.count(F.lit(1)).alias("rows_n"))


_K = [1, 5, 10]


@query("""
WITH p AS (SELECT query_image_path, max(neighbor_rank) AS m, count(*) FILTER (neighbor_rank <= 1 AND same_manuscript) AS h1, count(*) FILTER (neighbor_rank <= 5 AND same_manuscript) AS h5, count(*) FILTER (neighbor_rank <= 10 AND same_manuscript) AS h10 FROM geniza_knn_results GROUP BY 1),
a AS (SELECT 1 AS k, count(*) AS queries, count(*) FILTER (m >= 1) AS complete, count(*) FILTER (h1 > 0) AS successes, CAST(sum(h1) AS BIGINT) AS hits FROM p
UNION ALL SELECT 5, count(*), count(*) FILTER (m >= 5), count(*) FILTER (h5 > 0), CAST(sum(h5) AS BIGINT) FROM p
UNION ALL SELECT 10, count(*), count(*) FILTER (m >= 10), count(*) FILTER (h10 > 0), CAST(sum(h10) AS BIGINT) FROM p)
SELECT *, round(successes / queries, 6) AS success_rate FROM a""")
def a3_success_at_k(spark, d):
    return M.success_at(t(spark, d, "geniza_knn_results"), "query_image_path", "neighbor_rank", "same_manuscript", _K)


@query("""
WITH p AS (SELECT query_image_path, max(neighbor_rank) AS m, count(*) AS n, count(*) FILTER (same_manuscript) AS s, count(*) FILTER (same_manuscript AND neighbor_rank = 1) AS s1 FROM geniza_knn_results GROUP BY 1)
SELECT max(m) AS k_max, count(*) AS queries, count(*) FILTER (s1 > 0) AS rank1_same, count(*) FILTER (s > 0) AS any_same, CAST(sum(s) AS BIGINT) AS same_rows, CAST(sum(n - s) AS BIGINT) AS different_rows, CAST(sum(n) AS BIGINT) AS total_rows FROM p""")
def a4_scalar_report(spark, d):
    same = F.col("same_manuscript")
    p = t(spark, d, "geniza_knn_results").groupBy("query_image_path").agg(F.max("neighbor_rank").alias("m"), F.count(F.lit(1)).alias("n"), F.count_if(same).alias("s"), F.count_if(same & (F.col("neighbor_rank") == 1)).alias("s1"))
    return p.agg(F.max("m").alias("k_max"), F.count(F.lit(1)).alias("queries"), F.count_if(F.col("s1") > 0).alias("rank1_same"), F.count_if(F.col("s") > 0).alias("any_same"), F.sum("s").alias("same_rows"), F.sum(F.col("n") - F.col("s")).alias("different_rows"), F.sum("n").alias("total_rows"))


@query("""
SELECT coalesce(sum(CASE WHEN same_manuscript THEN 1 ELSE 0 END), 0)::BIGINT AS same_rows, coalesce(sum(CASE WHEN NOT same_manuscript THEN 1 ELSE 0 END), 0)::BIGINT AS different_rows,
coalesce(sum(query_num_words), 0)::BIGINT AS words FROM geniza_knn_results""")
def a5_sum_case(spark, d):
    s = F.col("same_manuscript")
    return t(spark, d, "geniza_knn_results").agg(F.coalesce(F.sum(F.when(s, 1).otherwise(0)), F.lit(0)).alias("same_rows"), F.coalesce(F.sum(F.when(~s, 1).otherwise(0)), F.lit(0)).alias("different_rows"), F.coalesce(F.sum("query_num_words"), F.lit(0)).alias("words"))


@query(f"""
WITH s AS (SELECT {TRIM.format('manuscript_id')} AS m, max(nullif({TRIM.format('normalized_library')}, '') || '||' || nullif({TRIM.format('shelfmark_root')}, '')) AS k FROM geniza_manuscript_shelfmark GROUP BY 1)
SELECT count(*) AS n, count(*) FILTER (coalesce(a.k = b.k, false)) AS same_shelfmark, count(*) FILTER (r.same_manuscript) AS same_manuscript, count(*) FILTER (coalesce(a.k = b.k, false) AND NOT r.same_manuscript) AS only_shelfmark
FROM geniza_knn_results r LEFT JOIN s a ON {TRIM.format('r.query_manuscript_id')} = a.m LEFT JOIN s b ON {TRIM.format('r.neighbor_manuscript_id')} = b.m""")
def a6_shelfmark_totals(spark, d):
    """Unknown shelfmarks never match, not even one another."""
    key = F.when(blank_to_null("normalized_library").isNotNull() & blank_to_null("shelfmark_root").isNotNull(), F.concat_ws("||", trimmed("normalized_library"), trimmed("shelfmark_root")))
    s = t(spark, d, "geniza_manuscript_shelfmark").groupBy(trimmed("manuscript_id").alias("m")).agg(F.max(key).alias("k"))
    r = t(spark, d, "geniza_knn_results").groupBy(trimmed("query_manuscript_id").alias("q"), trimmed("neighbor_manuscript_id").alias("n"), "same_manuscript").agg(F.count(F.lit(1)).alias("c"))
    r = r.join(s.select(F.col("m").alias("q"), F.col("k").alias("a")), "q", "left").join(s.select(F.col("m").alias("n"), F.col("k").alias("b")), "n", "left")
    eq, same = F.coalesce(F.col("a") == F.col("b"), F.lit(False)), F.col("same_manuscript")
    add = lambda c: F.coalesce(F.sum(F.when(c, F.col("c"))), F.lit(0))
    return r.agg(F.sum("c").alias("n"), add(eq).alias("same_shelfmark"), add(same).alias("same_manuscript"), add(eq & ~same).alias("only_shelfmark"))


@query(f"""
WITH n AS (SELECT {TRIM.format('manuscript_id')} AS m, count(*) - 1 AS relevant FROM geniza_image_latents GROUP BY 1),
r AS (SELECT query_image_path AS q, {TRIM.format('query_manuscript_id')} AS m, {TRIM.format('query_manuscript_id')} = {TRIM.format('neighbor_manuscript_id')} AS rel,
  row_number() OVER (PARTITION BY query_image_path ORDER BY similarity_score DESC, neighbor_rank, id) AS k FROM geniza_knn_results WHERE similarity_score IS NOT NULL AND NOT isnan(similarity_score)),
p AS (SELECT *, sum(rel::INT) OVER (PARTITION BY q ORDER BY k ROWS UNBOUNDED PRECEDING) / k AS prec FROM r)
SELECT q AS query_image_path, round(sum(CASE WHEN rel AND k <= 10 THEN prec ELSE 0 END) / max(relevant), 6) AS ap, min(CASE WHEN rel THEN k END) AS first_hit FROM p JOIN n USING (m) WHERE relevant > 0 GROUP BY q""")
def m1_average_precision(spark, d):
    """AP@10 over all relevant items of the corpus, and the first positive rank."""
    n = t(spark, d, "geniza_image_latents").groupBy(trimmed("manuscript_id").alias("m")).agg((F.count(F.lit(1)) - 1).alias("relevant"))
    rows = t(spark, d, "geniza_knn_results").filter(F.col("similarity_score").isNotNull() & ~F.isnan("similarity_score"))
    w = Window.partitionBy("query_image_path").orderBy(F.desc("similarity_score"), "neighbor_rank", "id")
    rows = rows.select("query_image_path", trimmed("query_manuscript_id").alias("m"), (trimmed("query_manuscript_id") == trimmed("neighbor_manuscript_id")).alias("rel"), F.row_number().over(w).cast("bigint").alias("k")).join(n, "m")
    return M.average_precision(rows, "query_image_path", "k", "rel", "relevant", 10).select("query_image_path", F.round("ap", 6).alias("ap"), "first_hit")


@query("""
WITH p AS (SELECT query_image_path, bool_or(same_manuscript AND neighbor_rank = 1) AS a1, bool_or(same_manuscript AND neighbor_rank <= 5) AS a5, bool_or(same_manuscript AND neighbor_rank <= 10) AS a10, avg(same_manuscript::INT) AS share FROM geniza_knn_results GROUP BY 1)
SELECT count(*) AS queries, round(avg(a1::INT), 6) AS rank1, round(avg(a5::INT), 6) AS any5, round(avg(a10::INT), 6) AS any10, round(avg(share), 6) AS hit_share FROM p""")
def m2_network_report(spark, d):
    s, k = F.col("same_manuscript"), F.col("neighbor_rank")
    p = t(spark, d, "geniza_knn_results").groupBy("query_image_path").agg(*[F.bool_or(s & (k <= n) & (k >= (1 if n == 1 else -(10**9)))).alias(f"a{n}") for n in _K], F.avg(s.cast("int")).alias("share"))
    return p.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg(F.col("a1").cast("int")), 6).alias("rank1"), F.round(F.avg(F.col("a5").cast("int")), 6).alias("any5"), F.round(F.avg(F.col("a10").cast("int")), 6).alias("any10"), F.round(F.avg("share"), 6).alias("hit_share"))


_PAIRS = f"{_E}, pr AS (SELECT a.id AS id_1, b.id AS id_2, a.label AS l1, b.label AS l2, list_inner_product(a.x, b.x) AS s FROM u a JOIN u b ON a.id < b.id)"


def _pairs(spark, d):
    return pair_table(_items(spark, d))


@query(f"WITH {_PAIRS} SELECT id_1, id_2, l1 = l2 AS same_label, round(s, 6) AS similarity FROM pr")
def j15_pair_table(spark, d):
    return _pairs(spark, d).select("id_1", "id_2", (F.col("label_1") == F.col("label_2")).alias("same_label"), F.round("similarity", 6).alias("similarity"))


@query(f"""
WITH {_PAIRS}, r AS (SELECT id_1 AS q, l1 = l2 AS rel, s, id_2 AS n FROM pr UNION ALL SELECT id_2, l1 = l2, s, id_1 FROM pr),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(s, 12) DESC, n) AS k FROM r),
p AS (SELECT *, sum(rel::INT) OVER (PARTITION BY q ORDER BY k ROWS UNBOUNDED PRECEDING) / k AS prec FROM k),
a AS (SELECT q, sum(CASE WHEN rel THEN prec ELSE 0 END) / sum(rel::INT) AS ap, min(CASE WHEN rel THEN k END) AS f FROM p GROUP BY q HAVING sum(rel::INT) > 0)
SELECT count(*) AS queries, round(avg(ap), 6) AS map, round(avg((f <= 1)::INT), 6) AS knn1, round(avg((f <= 5)::INT), 6) AS knn5, round(avg((f <= 10)::INT), 6) AS knn10, round(avg(f), 4) AS mean_first_rank FROM a""")
def m3_retrieval_metrics(spark, d):
    r = ranks_of_relevant(_items(spark, d).select("item", "vec", "label"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("rank"))
    per = r.withColumn("p", place / F.col("rank")).groupBy("query").agg(F.avg("p").alias("ap"), F.min("rank").alias("f"))
    return per.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("ap"), 6).alias("map"), *[F.round(F.avg((F.col("f") <= n).cast("int")), 6).alias(f"knn{n}") for n in _K], F.round(F.avg("f"), 4).alias("mean_first_rank"))


@query(f"""
WITH {_PAIRS}, r AS (SELECT id_1 AS q, id_2 AS n, l1 = l2 AS rel, s FROM pr UNION ALL SELECT id_2, id_1, l1 = l2, s FROM pr),
k AS (SELECT q, rel, row_number() OVER (PARTITION BY q ORDER BY s DESC, n) AS k FROM r), t AS (SELECT q, sum(rel::INT) AS n FROM r GROUP BY q HAVING n > 0),
a AS (SELECT q, sum((rel AND k <= 5)::INT) AS h5, sum((rel AND k <= 10)::INT) AS h10 FROM k GROUP BY q)
SELECT round(avg(h5 / n), 6) AS recall5, round(avg(h10 / n), 6) AS recall10, round(avg((h5 > 0)::INT), 6) AS hit5, round(avg((h10 > 0)::INT), 6) AS hit10 FROM a JOIN t USING (q)""")
def m5_recall_from_pairs(spark, d):
    p, rel = _pairs(spark, d), F.col("label_1") == F.col("label_2")
    both = p.select(F.inline(F.array(F.struct(F.col("id_1").alias("q"), F.col("id_2").alias("n"), rel.alias("rel"), F.col("similarity").alias("s")), F.struct(F.col("id_2").alias("q"), F.col("id_1").alias("n"), rel.alias("rel"), F.col("similarity").alias("s")))))
    total = both.groupBy("q").agg(F.sum(F.col("rel").cast("int")).alias("total")).filter("total > 0")
    top = both.withColumn("k", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "n"))).filter("k <= 10")
    per = top.groupBy("q").agg(F.count_if(F.col("rel") & (F.col("k") <= 5)).alias("h5"), F.count_if(F.col("rel")).alias("h10")).join(total, "q")
    out = [F.round(F.avg(F.col(f"h{k}") / F.col("total")), 6).alias(f"recall{k}") for k in (5, 10)] + [F.round(F.avg((F.col(f"h{k}") > 0).cast("int")), 6).alias(f"hit{k}") for k in (5, 10)]
    return per.agg(*out)


@query(f"""
WITH {_PAIRS}, k AS (SELECT *, l1 % 2 AS lib FROM pr), r AS (SELECT id_1 AS q, id_2 AS n, s, l1 % 5 = l2 % 5 AS rel FROM pr WHERE l1 % 2 <> l2 % 2 UNION ALL SELECT id_2, id_1, s, l1 % 5 = l2 % 5 FROM pr WHERE l1 % 2 <> l2 % 2),
o AS (SELECT q, rel, row_number() OVER (PARTITION BY q ORDER BY s DESC, n) AS k FROM r), p AS (SELECT *, sum(rel::INT) OVER (PARTITION BY q ORDER BY k ROWS UNBOUNDED PRECEDING) / k AS prec FROM o),
a AS (SELECT q, sum(CASE WHEN rel THEN prec ELSE 0 END) / sum(rel::INT) AS ap FROM p GROUP BY q HAVING sum(rel::INT) > 0)
SELECT count(*) AS cross_library_valid_queries, round(avg(ap), 6) AS cross_library_map FROM a""")
def m9_cross_library(spark, d):
    p = _pairs(spark, d).filter(F.col("label_1") % 2 != F.col("label_2") % 2)
    rel = (F.col("label_1") % 5 == F.col("label_2") % 5).alias("rel")
    both = p.select(F.inline(F.array(F.struct(F.col("id_1").alias("q"), F.col("id_2").alias("n"), rel, F.col("similarity").alias("s")), F.struct(F.col("id_2").alias("q"), F.col("id_1").alias("n"), rel, F.col("similarity").alias("s")))))
    ranked = both.withColumn("k", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "n")))
    return M.average_precision(ranked, "q", "k", "rel").agg(F.count(F.lit(1)).alias("cross_library_valid_queries"), F.round(F.avg("ap"), 6).alias("cross_library_map"))


@query(f"""
WITH {_PAIRS}, g AS (SELECT CASE WHEN l1 = l2 THEN 'same' ELSE 'different' END AS k, s FROM pr),
a AS (SELECT k, count(*)::DOUBLE AS n, avg(s) AS mean, stddev_pop(s) AS std, quantile_cont(s, 0.1) AS p10, quantile_cont(s, 0.5) AS median, quantile_cont(s, 0.9) AS p90 FROM g GROUP BY k),
l AS (SELECT k || '_' || name AS metric, value FROM a UNPIVOT (value FOR name IN (n, mean, std, p10, median, p90)))
SELECT metric, round(value, 6) AS value FROM l UNION ALL SELECT 'mean_gap', round(max(mean) FILTER (k = 'same') - max(mean) FILTER (k = 'different'), 6) FROM a""")
def a20_separation(spark, d):
    return M.separation(_pairs(spark, d), "similarity", F.col("label_1") == F.col("label_2")).select("metric", F.round("value", 6).alias("value"))


@query(f"""
WITH {_PAIRS}, q AS (SELECT quantile_cont(s, 0.25) AS p25 FROM pr WHERE l1 = l2)
SELECT round(p25, 6) AS same_p25, round((SELECT avg((s < p25)::INT) FROM pr WHERE l1 <> l2), 6) AS cross_below FROM q""")
def a22_cross_below(spark, d):
    p = _pairs(spark, d).withColumn("same", F.col("label_1") == F.col("label_2"))
    p25 = p.filter("same").agg(F.percentile("similarity", 0.25)).first()[0]
    return p.filter("NOT same").agg(F.round(F.lit(p25), 6).alias("same_p25"), F.round(F.avg((F.col("similarity") < F.lit(p25)).cast("int")), 6).alias("cross_below"))


@query(f"""
WITH {_PAIRS}, g AS (SELECT CASE WHEN l1 = l2 THEN 'same' ELSE 'different' END AS kind, least(floor((s + 1) * 20), 39)::INT AS bin FROM pr WHERE s BETWEEN -1 AND 1),
c AS (SELECT kind, bin, count(*) AS n FROM g GROUP BY 1, 2) SELECT kind, bin, n, round(n / sum(n) OVER (PARTITION BY kind) / 0.05, 6) AS density FROM c""")
def a23_histogram(spark, d):
    return M.histogram(_pairs(spark, d), "similarity", F.when(F.col("label_1") == F.col("label_2"), "same").otherwise("different")).withColumn("density", F.round("density", 6))


@query("""
WITH r AS (SELECT similarity_score AS s, same_manuscript AS y FROM geniza_knn_results WHERE similarity_score IS NOT NULL AND NOT isnan(similarity_score)),
k AS (SELECT s, sum(y::INT) AS p, sum((NOT y)::INT) AS n FROM r GROUP BY s),
c AS (SELECT *, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS fp, sum(p) OVER () AS ap, sum(n) OVER () AS an FROM k)
SELECT round(sum(p * (an - fp + n / 2)) / max(ap * an), 6) AS roc_auc, round(sum(p * tp / (tp + fp)) / max(ap), 6) AS pr_auc FROM c""")
def m7_roc_pr_auc(spark, d):
    return M.roc_auc(t(spark, d, "geniza_knn_results"), "similarity_score", F.col("same_manuscript")).select(F.round("roc_auc", 6).alias("roc_auc"), F.round("pr_auc", 6).alias("pr_auc"))


@query("""
WITH r AS (SELECT similarity_score AS s, same_manuscript AS y FROM geniza_knn_results WHERE similarity_score IS NOT NULL AND NOT isnan(similarity_score)),
k AS (SELECT s, sum(y::INT) AS p, sum((NOT y)::INT) AS n FROM r GROUP BY s),
c AS (SELECT *, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS fp, sum(p) OVER () AS ap, sum(n) OVER () AS an FROM k)
SELECT s AS threshold, round(2 * tp / (tp + fp + ap), 6) AS f1, round(tp / (tp + fp), 6) AS "precision", round(tp / ap, 6) AS recall, round((tp + an - fp) / (ap + an), 6) AS accuracy FROM c ORDER BY 2 * tp / (tp + fp + ap) DESC, s LIMIT 1""")
def m10_best_f1(spark, d):
    r = M.best_f1(t(spark, d, "geniza_knn_results"), "similarity_score", F.col("same_manuscript"))
    return r.select("threshold", *[F.round(c, 6).alias(c) for c in ("f1", "precision", "recall", "accuracy")])


@query("""
WITH s AS (SELECT id, similarity_score AS a, CASE WHEN query_num_glyphs > 0 THEN distance_score END AS b, CASE WHEN query_num_words > 0 THEN query_num_words / 100.0 END AS c FROM geniza_knn_results),
f AS (SELECT id, CASE WHEN a IS NOT NULL AND NOT isnan(a) AND NOT isinf(a) THEN a END AS a, CASE WHEN b IS NOT NULL AND NOT isnan(b) AND NOT isinf(b) THEN b END AS b, c::DOUBLE AS c FROM s)
SELECT id, round((coalesce(0.5 * a, 0) + coalesce(0.3 * b, 0) + coalesce(0.2 * c, 0)) / nullif((a IS NOT NULL)::INT * 0.5::DOUBLE + (b IS NOT NULL)::INT * 0.3::DOUBLE + (c IS NOT NULL)::INT * 0.2::DOUBLE, 0), 9) AS fused FROM f""")
def v8_late_fusion(spark, d):
    a, b, c = F.col("similarity_score"), F.when(F.col("query_num_glyphs") > 0, F.col("distance_score")), F.when(F.col("query_num_words") > 0, F.col("query_num_words") / 100.0)
    return t(spark, d, "geniza_knn_results").select("id", F.round(V.fuse([(a, 0.5), (b, 0.3), (c, 0.2)]), 9).alias("fused"))


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, (l_returnflag = 'R')::INT AS y, least(greatest(l_discount * 8 + l_tax * 2, 0.01), 0.99) AS p FROM lineitem),
c AS (SELECT sum((y = 1 AND p >= 0.5)::INT) AS tp, sum((y = 0 AND p < 0.5)::INT) AS tn, sum((y = 0 AND p >= 0.5)::INT) AS fp, sum((y = 1 AND p < 0.5)::INT) AS fn, avg(CASE WHEN y = 1 THEN -ln(p) ELSE -ln(1 - p) END) AS l FROM r)
SELECT round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2, 6) AS macro_f1,
round(tp / (tp + fn), 6) AS sensitivity, round(tn / (tn + fp), 6) AS specificity, round(l, 6) AS log_loss FROM c""")
def m14_binary_metrics(spark, d):
    p = F.least(F.greatest(F.col("l_discount") * 8 + F.col("l_tax") * 2, F.lit(0.01)), F.lit(0.99))
    r = M.binary_metrics(t(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), p.alias("p")), "y", "p")
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


@query("""
WITH r AS (SELECT vec_id, label % 4 AS y, list_transform([embedding[1], embedding[2], embedding[3], embedding[4]], lambda x: exp(x::DOUBLE)) AS e FROM embeddings),
p AS (SELECT y::INT AS y, list_transform(e, lambda x: x / list_sum(e)) AS p FROM r), q AS (SELECT y, p, list_position(p, list_max(p)) - 1 AS g, p[y + 1] AS own, list_max(p) AS c FROM p),
b AS (SELECT *, (p[1] > own OR (p[1] = own AND 0 < y))::INT + (p[2] > own OR (p[2] = own AND 1 < y))::INT + (p[3] > own OR (p[3] = own AND 2 < y))::INT + (p[4] > own OR (p[4] = own AND 3 < y))::INT AS ahead FROM q),
f AS (SELECT k, sum(real) AS r, sum(hit) AS h, sum(said) AS s FROM (SELECT y AS k, 1 AS real, (g = y)::INT AS hit, 0 AS said FROM q UNION ALL SELECT g, 0, 0, 1 FROM q) GROUP BY k HAVING sum(real) > 0)
SELECT round(avg((ahead < 1)::INT), 6) AS top1, round(avg((ahead < 3)::INT), 6) AS top3, round(avg(-ln(own)), 6) AS log_loss, round(avg(c) FILTER (g = y), 6) AS confidence_right, round(avg(c) FILTER (g <> y), 6) AS confidence_wrong,
(SELECT round(avg(2 * h / (r + s)), 6) FROM f) AS macro_f1 FROM b""")
def m15_multiclass_metrics(spark, d):
    rows = t(spark, d, "embeddings").select((F.col("label") % 4).cast("int").alias("y"), V.softmax(F.slice("embedding", 1, 4)).alias("p"))
    r = M.multiclass_metrics(rows, "y", "p", 4)
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


@query("""
WITH r AS (SELECT l_discount * 10 AS c, l_returnflag = 'R' AS y FROM lineitem), b AS (SELECT ceil(c * 10) AS b, count(*) AS n, avg(c) AS c, avg(y::INT) AS a FROM r WHERE c > 0 GROUP BY 1)
SELECT round(sum(n * abs(c - a)) / sum(n), 6) AS ece FROM b""")
def m16_calibration_error(spark, d):
    rows = t(spark, d, "lineitem").select((F.col("l_discount") * 10).alias("c"), (F.col("l_returnflag") == "R").alias("y"))
    return M.calibration_error(rows, "c", "y").select(F.round("ece", 6).alias("ece"))


@query("""
WITH r AS (SELECT p_retailprice AS y, 900 + p_size * 10.0 AS p FROM part), e AS (SELECT y, p, p - y AS e FROM r)
SELECT round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(avg((abs(e) <= 25)::INT), 6) AS within_25, round(avg((abs(e) <= 50)::INT), 6) AS within_50, round(avg((abs(e) <= 100)::INT), 6) AS within_100,
round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) AS r2 FROM e""")
def m17_regression_metrics(spark, d):
    r = M.regression_metrics(t(spark, d, "part").select(F.col("p_retailprice").alias("y"), (900 + F.col("p_size") * 10.0).alias("p")), "y", "p")
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


@query("""
WITH r AS (SELECT p_retailprice AS a, p_size AS b FROM part), k AS (SELECT (rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2) AS ra, (rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2) AS rb FROM r)
SELECT round(corr(ra, rb), 6) AS spearman FROM k""")
def m17_spearman(spark, d):
    return M.spearman(t(spark, d, "part").select("p_retailprice", "p_size"), "p_retailprice", "p_size").select(F.round("spearman", 6).alias("spearman"))


@query("SELECT vec_id, list_position([1200.0, 1250.0, 1300.0], nearest) - 1 AS bucket FROM (SELECT vec_id, list_sort(list_transform([1200.0, 1250.0, 1300.0], lambda b: {'d': abs(1200 + vec_id % 120 - b), 'b': b}))[1].b AS nearest FROM embeddings)")
def v13_nearest_bucket(spark, d):
    b = V.nearest_bucket(F.lit(1200) + F.col("vec_id") % 120, [1200, 1250, 1300])
    return t(spark, d, "embeddings").select("vec_id", F.when(b == 1200, 0).when(b == 1250, 1).otherwise(2).cast("bigint").alias("bucket"))
