"""Listings, lookups, contracts as reports, pooled vectors and branch metrics (S, K, J, L, A, V, M, D groups)."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window, functions as F

from quire.functions import vectors as V
from quire.functions.text import blank_to_null, trimmed
from quire.operators import metrics as M, profile as P, relational as R
from quire.operators.allpairs import normalised, ranks_of_relevant
from quire.session import cut, table as t

QUERIES, SQL = {}, {}
TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_M = TRIM.format("manuscript_id")
_SPLIT = f"CASE WHEN lower({TRIM.format('split')}) = 'validation' THEN 'val' ELSE lower({TRIM.format('split')}) END"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _split():
    s = F.lower(trimmed("split"))
    return F.when(s == "validation", "val").otherwise(s)


@query(f"SELECT id, {TRIM.format('query_manuscript_id')} AS query_manuscript, {TRIM.format('neighbor_manuscript_id')} AS neighbor_manuscript, similarity_score FROM geniza_knn_results")
def s5_cursor_scan(spark: SparkSession, d: str):
    """A full scan of few columns; fetching in pieces is left to the reader of the result."""
    return t(spark, d, "geniza_knn_results").select("id", trimmed("query_manuscript_id").alias("query_manuscript"), trimmed("neighbor_manuscript_id").alias("neighbor_manuscript"), "similarity_score")


@query("""
WITH m AS (SELECT CAST(id AS VARCHAR) AS i, image_path AS p, manuscript_id AS c FROM image_metadata)
SELECT 'blank' AS fault, count(*) AS n FROM m WHERE i IS NULL OR p IS NULL OR c IS NULL OR trim(i) = '' OR trim(p) = '' OR trim(c) = ''
UNION ALL SELECT 'repeated id', count(*) FROM (SELECT i FROM m WHERE i IS NOT NULL GROUP BY i HAVING count(*) > 1)
UNION ALL SELECT 'repeated path', count(*) FROM (SELECT p FROM m WHERE p IS NOT NULL GROUP BY p HAVING count(*) > 1)
UNION ALL SELECT 'single member', count(*) FROM (SELECT c FROM m WHERE c IS NOT NULL GROUP BY c HAVING count(*) = 1)""")
def s10_member_faults(spark, d):
    return P.member_faults(t(spark, d, "image_metadata"), "id", "image_path", "manuscript_id")


@query("SELECT column_name FROM (DESCRIBE geniza_image_latents)")
def s21_column_names(spark, d):
    """The columns of a table, without reading a row."""
    return spark.createDataFrame([(c,) for c in t(spark, d, "geniza_image_latents").columns], "column_name string")


@query(f"""
WITH s AS (SELECT DISTINCT image_path, nullif({TRIM.format('label')}, '') AS l FROM split_labels WHERE {_SPLIT} = 'test'),
p AS (SELECT image_path, min({_M}) AS m, count(*) AS versions FROM image_metadata GROUP BY image_path)
SELECT s.image_path, coalesce(s.l, p.m) AS cluster, p.versions FROM s LEFT JOIN p USING (image_path)""")
def s23_rebuilt_members(spark, d):
    """The members of the stored test split, their cluster from the label or else from the metadata."""
    s = t(spark, d, "split_labels").filter(_split() == "test").select("image_path", blank_to_null("label").alias("l")).distinct()
    p = t(spark, d, "image_metadata").groupBy("image_path").agg(F.min(trimmed("manuscript_id")).alias("m"), F.count(F.lit(1)).alias("versions"))
    return s.join(p, "image_path", "left").select("image_path", F.coalesce("l", "m").alias("cluster"), "versions")


@query(f"""
SELECT m, image_path, id, num_patches FROM (SELECT *, {_M} AS m, row_number() OVER (PARTITION BY {_M}, image_path ORDER BY updated_at DESC NULLS LAST, id DESC) AS k FROM image_metadata) WHERE k = 1""")
def k4_upsert_two_keys(spark, d):
    """Rows written once, then every row again as an update, by (manuscript, image path): the latest version stays."""
    rows = t(spark, d, "image_metadata").select(trimmed("manuscript_id").alias("m"), "image_path", "id", "num_patches", F.struct(F.coalesce("updated_at", F.timestamp_seconds(F.lit(-(10**10)))).alias("u"), "id").alias("version"))
    first = rows.groupBy("m", "image_path").agg(F.min_by(F.struct("id", "num_patches", "version"), "id").alias("x")).select("m", "image_path", "x.*")
    return R.upsert(first, rows, ["m", "image_path"], "version").drop("version")


@query(f"""
SELECT a.id, {TRIM.format('a.manuscript_id')} AS m, a.page_number, i.id AS metadata_id, i.num_patches FROM geniza_image_latents a JOIN image_metadata i
ON {TRIM.format('a.manuscript_id')} = {TRIM.format('i.manuscript_id')} AND a.image_path = i.image_path""")
def j4_listing(spark, d):
    """All pages with their metadata rows, by manuscript and path."""
    a = t(spark, d, "geniza_image_latents").select("id", trimmed("manuscript_id").alias("m"), "image_path", "page_number")
    i = t(spark, d, "image_metadata").select(trimmed("manuscript_id").alias("m"), "image_path", F.col("id").alias("metadata_id"), "num_patches")
    return a.join(i, ["m", "image_path"]).select("id", "m", "page_number", "metadata_id", "num_patches")


@query(f"""
WITH s AS (SELECT {_M} AS m, min(nullif({TRIM.format('normalized_library')}, '')) AS lib FROM geniza_manuscript_shelfmark GROUP BY 1)
SELECT a.id, a.num_glyphs, s.lib FROM geniza_image_latents a LEFT JOIN s ON {TRIM.format('a.manuscript_id')} = s.m""")
def j6_pages_with_library(spark, d):
    s = t(spark, d, "geniza_manuscript_shelfmark").groupBy(trimmed("manuscript_id").alias("m")).agg(F.min(blank_to_null("normalized_library")).alias("lib"))
    return t(spark, d, "geniza_image_latents").select("id", "num_glyphs", trimmed("manuscript_id").alias("m")).join(s, "m", "left").select("id", "num_glyphs", "lib")


@query("""
WITH o AS (SELECT o_custkey AS custkey, count(*) AS orders FROM orders GROUP BY 1), c AS (SELECT c_custkey AS custkey, c_nationkey AS nationkey FROM customer),
n AS (SELECT n_nationkey AS nationkey, n_name FROM nation), j AS (SELECT * FROM o JOIN c USING (custkey) JOIN n USING (nationkey))
SELECT n_name, sum(orders)::BIGINT AS orders, count(*) AS customers FROM j GROUP BY n_name""")
def j8_using_chain(spark, d):
    o = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.count(F.lit(1)).alias("orders"))
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_nationkey").alias("nationkey"))
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("nationkey"), "n_name")
    return o.join(c, "custkey").join(n, "nationkey").groupBy("n_name").agg(F.sum("orders").alias("orders"), F.count(F.lit(1)).alias("customers"))


@query(f"""
WITH k AS (SELECT DISTINCT {_M} AS m FROM geniza_image_latents), s AS (SELECT {TRIM.format('label')} AS m, min({_SPLIT}) AS split FROM split_labels WHERE nullif({TRIM.format('label')}, '') IS NOT NULL GROUP BY 1)
SELECT k.m, s.split, s.split IS NULL AS unknown FROM k LEFT JOIN s USING (m)""")
def j18_split_lookup(spark, d):
    """The stored split of every manuscript with pages; unknown ones are flagged, not dropped."""
    k = t(spark, d, "geniza_image_latents").select(trimmed("manuscript_id").alias("m")).distinct()
    s = t(spark, d, "split_labels").select(blank_to_null("label").alias("m"), _split().alias("split")).filter("m IS NOT NULL").groupBy("m").agg(F.min("split").alias("split"))
    return k.join(s, "m", "left").withColumn("unknown", F.col("split").isNull())


@query("""
SELECT label, i - 1 AS dim, round(avg(x), 4) AS mean, round(stddev_pop(x), 4) AS std, round(max(x), 4) AS top
FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL""")
def a19_descriptor_statistics(spark, d):
    flat = t(spark, d, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "x"))
    return flat.groupBy("label", F.col("dim").cast("bigint").alias("dim")).agg(F.round(F.avg("x"), 4).alias("mean"), F.round(F.stddev_pop("x"), 4).alias("std"), F.round(F.max("x"), 4).alias("top"))


@query(f"""
SELECT {TRIM.format('query_manuscript_id')} AS m, count(*) AS n, round(avg(similarity_score) + 1e-9, 5) AS mean, round(CASE WHEN count(*) > 1 THEN stddev_samp(similarity_score) ELSE 0 END + 1e-9, 5) AS std,
round(quantile_cont(similarity_score, 0.05) + 1e-9, 5) AS p5, round(quantile_cont(similarity_score, 0.5) + 1e-9, 5) AS p50, round(quantile_cont(similarity_score, 0.95) + 1e-9, 5) AS p95
FROM geniza_knn_results WHERE similarity_score IS NOT NULL AND isfinite(similarity_score) GROUP BY 1""")
def a21_score_summary(spark, d):
    """Mean, sample deviation (0 for one value) and percentiles; a billionth is added so that halves round alike everywhere."""
    rows = t(spark, d, "geniza_knn_results").select(trimmed("query_manuscript_id").alias("m"), "similarity_score")
    out = P.summary(rows, ["m"], "similarity_score")
    return out.select("m", "n", *[F.round(F.col(c) + 1e-9, 5).alias(c) for c in ("mean", "std", "p5", "p50", "p95")])


_POOLED = f"""
p AS (SELECT m, i, avg(x) AS x, count(*) AS n FROM (SELECT {_M} AS m, unnest(CAST(latent_vector_search AS DOUBLE[])) AS x, generate_subscripts(latent_vector_search, 1) AS i
      FROM geniza_image_latents WHERE num_words IS NOT NULL AND len(latent_vector_search) = 16 AND len(list_filter(latent_vector_search, lambda e: e IS NULL OR NOT isfinite(e))) = 0) GROUP BY m, i)"""


def _masked(spark, d):
    """Pages that count (a mask: words are known) with a whole search vector."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = t(spark, d, "geniza_image_latents").filter("num_words IS NOT NULL").select(trimmed("manuscript_id").alias("m"), F.col("latent_vector_search").cast("array<double>").alias("v"))
    return P.mean_vector(rows.filter((F.size("v") == 16) & F.coalesce(fine, F.lit(False))), "m", "v")


@query(f"WITH {_POOLED} SELECT m, n, i - 1 AS dim, round(x, 4) AS x FROM p")
def a32_masked_mean(spark, d):
    """Mean of the vectors of the pages that count; manuscripts without such a page are absent."""
    return _masked(spark, d).select("m", "n", F.posexplode("vec").alias("dim", "x")).select("m", "n", F.col("dim").cast("bigint").alias("dim"), F.round("x", 4).alias("x"))


@query(f"WITH {_POOLED}, l AS (SELECT m, sqrt(sum(x * x)) AS l FROM p GROUP BY m) SELECT m, n, i - 1 AS dim, round(x / greatest(l, 1e-12), 4) AS x FROM p JOIN l USING (m)")
def a33_pooled_unit(spark, d):
    """The same means with length 1."""
    length = F.greatest(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-12))
    rows = _masked(spark, d).withColumn("l", length).select("m", "n", "l", F.posexplode("vec").alias("dim", "x"))
    return rows.select("m", "n", F.col("dim").cast("bigint").alias("dim"), F.round(F.col("x") / F.col("l"), 4).alias("x"))


@query(f"""
WITH e AS (SELECT least({TRIM.format('query_manuscript_id')}, {TRIM.format('neighbor_manuscript_id')}) AS a, greatest({TRIM.format('query_manuscript_id')}, {TRIM.format('neighbor_manuscript_id')}) AS b, similarity_score AS s
FROM geniza_knn_results WHERE similarity_score IS NOT NULL AND NOT isnan(similarity_score)), u AS (SELECT a, b, max(s) AS s FROM e WHERE a <> b GROUP BY a, b)
SELECT a, b, s FROM u ORDER BY s DESC, a, b LIMIT 500""")
def l5_first_distinct_edges(spark, d):
    """The 500 best different edges: repeated rows of an edge count once before the cut."""
    q, n = trimmed("query_manuscript_id"), trimmed("neighbor_manuscript_id")
    rows = t(spark, d, "geniza_knn_results").filter(F.col("similarity_score").isNotNull() & ~F.isnan("similarity_score")).select(F.least(q, n).alias("a"), F.greatest(q, n).alias("b"), F.col("similarity_score").alias("s")).filter("a <> b")
    return rows.groupBy("a", "b").agg(F.max("s").alias("s")).orderBy(F.desc("s"), "a", "b").limit(500)


@query("""
SELECT split, image_path FROM (SELECT 'train' AS split, image_path FROM geniza_image_latents UNION ALL SELECT 'val', image_path FROM image_metadata)""")
def u3_merged_splits(spark, d):
    """Two split tables as one; neither is changed, rows of both stay."""
    a = t(spark, d, "geniza_image_latents").select(F.lit("train").alias("split"), "image_path")
    return a.unionByName(t(spark, d, "image_metadata").select("image_path", F.lit("val").alias("split")))


@query(f"""
SELECT {_M} AS m, CASE WHEN nullif({TRIM.format('shelfmark_running_index')}, '') IS NOT NULL THEN {TRIM.format('shelfmark_root')} || ' (' || {TRIM.format('shelfmark_running_index')} || ')' ELSE {TRIM.format('shelfmark_root')} END AS shown FROM geniza_manuscript_shelfmark""")
def t16_indexed_label(spark, d):
    root, i = trimmed("shelfmark_root"), blank_to_null("shelfmark_running_index")
    return t(spark, d, "geniza_manuscript_shelfmark").select(trimmed("manuscript_id").alias("m"), F.when(i.isNotNull(), F.concat(root, F.lit(" ("), i, F.lit(")"))).otherwise(root).alias("shown"))


_VALID = """
v AS (SELECT id, image_path, CAST(latent_vector AS DOUBLE[]) AS x FROM geniza_image_latents WHERE len(latent_vector) = 64
      AND len(list_filter(latent_vector, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(latent_vector, lambda e: e <> 0)) > 0)"""


def _valid(spark, d):
    fine = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = t(spark, d, "geniza_image_latents").select("id", "image_path", F.col("latent_vector").cast("array<double>").alias("x"))
    return rows.filter((F.size("x") == 64) & F.coalesce(fine, F.lit(False)) & F.exists("x", lambda e: e != 0))


@query(f"WITH {_VALID} SELECT id FROM v")
def f10_valid_vectors(spark, d):
    return _valid(spark, d).select("id")


@query(f"""
WITH {_VALID}, n AS (SELECT id, x, lag(x) OVER (PARTITION BY image_path ORDER BY id) AS y FROM v)
SELECT id, round(1 - list_inner_product(x, y) / sqrt(list_inner_product(x, x)) / sqrt(list_inner_product(y, y)), 5) + 0.0 AS drift FROM n WHERE y IS NOT NULL""")
def v22_drift(spark, d):
    """How far a page moved between two projections: 1 - cosine with the one before."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    rows = _valid(spark, d).withColumn("y", F.lag("x").over(Window.partitionBy("image_path").orderBy("id"))).filter("y IS NOT NULL")
    return rows.select("id", (F.round(1 - dot("x", "y") / F.sqrt(dot("x", "x")) / F.sqrt(dot("y", "y")), 5) + 0.0).alias("drift"))


@query("""
SELECT line_id, CASE WHEN line_idx IS NOT NULL THEN 'i' || line_idx WHEN line_id IS NOT NULL THEN 'l' || line_id ELSE 'y' || CAST(round(polygon[1].y) AS INT) END AS key FROM alto_text_lines""")
def x9_line_key(spark, d):
    """The key a line is found by: its index, else its id, else its rounded height."""
    y = F.concat(F.lit("y"), F.round(F.col("polygon")[0]["y"]).cast("int").cast("string"))
    key = F.coalesce(F.concat(F.lit("i"), F.col("line_idx").cast("string")), F.concat(F.lit("l"), F.col("line_id").cast("string")), y)
    return t(spark, d, "alto_text_lines").select("line_id", key.alias("key"))


_PLACES = f"""
r AS (SELECT query_image_path AS q, {TRIM.format('query_manuscript_id')} = {TRIM.format('neighbor_manuscript_id')} AS rel, row_number() OVER (PARTITION BY query_image_path ORDER BY similarity_score DESC, neighbor_rank, id) AS k
FROM geniza_knn_results WHERE similarity_score IS NOT NULL AND NOT isnan(similarity_score))"""


def _places(spark, d):
    rows = t(spark, d, "geniza_knn_results").filter(F.col("similarity_score").isNotNull() & ~F.isnan("similarity_score"))
    k = F.row_number().over(Window.partitionBy("query_image_path").orderBy(F.desc("similarity_score"), "neighbor_rank", "id"))
    return rows.select(F.col("query_image_path").alias("q"), (trimmed("query_manuscript_id") == trimmed("neighbor_manuscript_id")).alias("rel"), k.alias("k"))


@query(f"WITH {_PLACES} SELECT q, k, round(sum(rel::INT) OVER (PARTITION BY q ORDER BY k ROWS UNBOUNDED PRECEDING) / k, 6) AS precision FROM r QUALIFY rel")
def w4_precision_at_hits(spark, d):
    w = Window.partitionBy("q").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return _places(spark, d).withColumn("precision", F.round(F.sum(F.col("rel").cast("int")).over(w) / F.col("k"), 6)).filter("rel").select("q", F.col("k").cast("bigint").alias("k"), "precision")


@query(f"WITH {_PLACES} SELECT q, min(k) AS first_hit FROM r WHERE rel GROUP BY q")
def w5_first_hit(spark, d):
    return _places(spark, d).filter("rel").groupBy("q").agg(F.min("k").cast("bigint").alias("first_hit"))


@query(f"""
WITH {_PLACES}, p AS (SELECT *, sum(rel::INT) OVER (PARTITION BY q ORDER BY k ROWS UNBOUNDED PRECEDING) / k AS prec FROM r),
a AS (SELECT q, sum(rel::INT) AS n, sum(CASE WHEN rel THEN prec ELSE 0 END) AS s, sum((rel AND k <= 5)::INT) AS h5, sum((rel AND k <= 10)::INT) AS h10 FROM p GROUP BY q HAVING n > 0)
SELECT count(*) AS queries, round(avg(s / n), 6) AS map, round(avg(h5 / n), 6) AS recall5, round(avg(h10 / n), 6) AS recall10, round(avg((h5 > 0)::INT), 6) AS hit5, round(avg((h10 > 0)::INT), 6) AS hit10 FROM a""")
def m4_image_level(spark, d):
    """mAP, recall and hits of the queries that have a relevant row, over the neighbour rows."""
    w = Window.partitionBy("q").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.col("rel").cast("int")
    rows = _places(spark, d).withColumn("prec", F.sum(hit).over(w) / F.col("k"))
    per = rows.groupBy("q").agg(F.sum(hit).alias("n"), F.sum(F.when(F.col("rel"), F.col("prec")).otherwise(0.0)).alias("s"), *[F.count_if(F.col("rel") & (F.col("k") <= n)).alias(f"h{n}") for n in (5, 10)]).filter("n > 0")
    share = [F.round(F.avg(F.col(f"h{n}") / F.col("n")), 6).alias(f"recall{n}") for n in (5, 10)] + [F.round(F.avg((F.col(f"h{n}") > 0).cast("int")), 6).alias(f"hit{n}") for n in (5, 10)]
    return per.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg(F.col("s") / F.col("n")), 6).alias("map"), *share)


@query("""
WITH r AS (SELECT same_manuscript AS rel, row_number() OVER (ORDER BY similarity_score DESC, id) AS k FROM geniza_knn_results WHERE similarity_score IS NOT NULL AND NOT isnan(similarity_score) AND same_manuscript IS NOT NULL),
p AS (SELECT rel, sum(rel::INT) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) / k AS prec FROM r)
SELECT round(sum(CASE WHEN rel THEN prec ELSE 0 END) / sum(rel::INT), 6) AS ap FROM p""")
def m8_average_precision_per_row(spark, d):
    """Average precision where every row is a step of its own, ties in the order of the ids."""
    rows = t(spark, d, "geniza_knn_results").filter("same_manuscript IS NOT NULL")
    return M.average_precision_per_row(rows, "similarity_score", "id", F.col("same_manuscript")).select(F.round("ap", 6).alias("ap"))


_BRANCHES = {"fusion": (1, 64), "tile": (1, 16), "glyph": (17, 16), "word": (33, 32)}


def _branch_sql(name: str) -> str:
    first, n = _BRANCHES[name]
    return f"""SELECT '{name}' AS branch, * FROM (
WITH e AS (SELECT vec_id AS id, label, CAST(embedding[{first}:{first + n - 1}] AS DOUBLE[]) AS x FROM embeddings),
u AS (SELECT id, label, list_transform(x, lambda y: y / greatest(sqrt(list_inner_product(x, x)), 1e-12)) AS x FROM e),
s AS (SELECT a.id AS q, b.id AS n, round(list_inner_product(a.x, b.x), 12) AS s, a.label = b.label AS rel FROM u a JOIN u b ON a.id <> b.id),
k AS (SELECT q, rel, row_number() OVER (PARTITION BY q ORDER BY s DESC, n) AS k FROM s), h AS (SELECT q, k, row_number() OVER (PARTITION BY q ORDER BY k) / k AS p FROM k WHERE rel),
a AS (SELECT q, avg(p) AS ap, min(k) AS f FROM h GROUP BY q)
SELECT (SELECT count(*) FROM u) AS items, count(*) AS num_queries, round(avg(ap), 6) AS map, round(avg((f <= 1)::INT), 6) AS knn_at_1, round(avg((f <= 5)::INT), 6) AS knn_at_5, round(avg((f <= 10)::INT), 6) AS knn_at_10 FROM a)"""


def branch_metrics(spark: SparkSession, rows, first: int, size: int):
    """items, num_queries, map and knn_at_k of the items with a vector, on a part of it; items without that branch are left out."""
    part = rows.select("vec_id", "label", F.slice("embedding", first, size).alias("part")).filter(F.size("part") == size)
    ranks = ranks_of_relevant(normalised(part, "vec_id", "part", label=F.col("label")).select("item", "vec", "label"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("rank"))
    per = ranks.withColumn("p", place / F.col("rank")).groupBy("query").agg(F.avg("p").alias("ap"), F.min("rank").alias("f"))
    out = per.agg(F.count(F.lit(1)).alias("num_queries"), F.round(F.avg("ap"), 6).alias("map"), *[F.round(F.avg((F.col("f") <= k).cast("int")), 6).alias(f"knn_at_{k}") for k in (1, 5, 10)])
    return out.withColumn("items", F.lit(part.count()))


@query(" UNION ALL ".join(_branch_sql(b) for b in _BRANCHES))
def m12_branch_metrics(spark, d):
    """mAP and neighbours' hits for each branch of the vector."""
    rows, out = t(spark, d, "embeddings"), None
    for name, (first, size) in _BRANCHES.items():
        one = branch_metrics(spark, rows, first, size).select(F.lit(name).alias("branch"), "items", "num_queries", "map", "knn_at_1", "knn_at_5", "knn_at_10")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""
WITH s AS (SELECT {_SPLIT} AS split, image_path FROM split_labels), k AS (SELECT image_path, count(*) AS n, count(DISTINCT split) AS splits FROM s GROUP BY image_path)
SELECT count_if(n > 1) AS repeated, count_if(splits > 1) AS overlapping, (SELECT round(avg((split = 'test')::INT), 6) FROM s) AS test_fraction,
       (SELECT avg((split = 'test')::INT) BETWEEN 0.25 AND 0.35 FROM s) AS fraction_fits FROM k""")
def m20_split_integrity(spark, d):
    """What a split must keep: paths once, in one split, and the share of the test split between 0.25 and 0.35."""
    s = t(spark, d, "split_labels").select(_split().alias("split"), "image_path")
    k = s.groupBy("image_path").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("split").alias("splits"), F.count_if(F.col("split") == "test").alias("tests"))
    k = k.agg(F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("splits") > 1).alias("overlapping"), (F.sum("tests") / F.sum("n")).alias("f"))
    return k.select("repeated", "overlapping", F.round("f", 6).alias("test_fraction"), F.col("f").between(0.25, 0.35).alias("fraction_fits"))


@query(f"""
WITH s AS (SELECT {_SPLIT} AS split, image_path, nullif({TRIM.format('label')}, '') AS l FROM split_labels)
SELECT 'image_path' AS kind, count(*) AS overlapping FROM (SELECT image_path FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'manuscript', count(*) FROM (SELECT l FROM s WHERE l IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1)""")
def d3_split_overlaps(spark, d):
    s = t(spark, d, "split_labels").select(_split().alias("split"), "image_path", blank_to_null("label").alias("l"))
    one = lambda c, kind: R.overlap_counts(s.filter(F.col(c).isNotNull()), c, "split").agg(F.count(F.lit(1)).alias("overlapping")).select(F.lit(kind).alias("kind"), "overlapping")
    return one("image_path", "image_path").unionByName(one("l", "manuscript"))


@query(f"""
WITH l AS (SELECT DISTINCT nullif({TRIM.format('label')}, '') AS v FROM split_labels WHERE {_SPLIT} = 'train'), m AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM l WHERE v IS NOT NULL),
o AS (SELECT DISTINCT nullif({TRIM.format('label')}, '') AS v FROM split_labels)
SELECT (SELECT count(*) FROM m) AS mapped, (SELECT max(i) + 1 = count(DISTINCT i) FROM m) AS without_gaps, (SELECT count(*) FROM o WHERE v IS NOT NULL AND v NOT IN (SELECT v FROM m)) AS uncovered""")
def d9_label_map(spark, d):
    """A map of the training labels: its size, whether its indexes run without gaps, and the labels of all splits it lacks."""
    rows = t(spark, d, "split_labels").select(_split().alias("split"), blank_to_null("label").alias("value"))
    m = cut(R.dense_index(rows.filter("split = 'train'"), "value"), "labels")
    uncovered = rows.select("value").filter("value IS NOT NULL").distinct().join(m, "value", "left_anti").count()
    return m.agg(F.count(F.lit(1)).alias("mapped"), (F.max("index") + 1 == F.countDistinct("index")).alias("without_gaps")).withColumn("uncovered", F.lit(uncovered))


@query(f"""
SELECT {_SPLIT} AS split, count(*) AS n, count(*) - count(DISTINCT image_path) AS repeated FROM split_labels WHERE {_SPLIT} IN ('train', 'val') AND image_path IS NOT NULL GROUP BY 1""")
def d10_split_rows(spark, d):
    """Rows and repeated paths of the splits that must not be empty."""
    s = t(spark, d, "split_labels").select(_split().alias("split"), "image_path").filter(F.col("split").isin("train", "val") & F.col("image_path").isNotNull())
    return s.groupBy("split", "image_path").agg(F.count(F.lit(1)).alias("k")).groupBy("split").agg(F.sum("k").alias("n"), (F.sum("k") - F.count(F.lit(1))).alias("repeated"))


@query(f"""
WITH f AS (SELECT {_SPLIT} AS split, pos, image_path FROM split_labels WHERE {_SPLIT} = 'train'), e AS (SELECT pos, min(image_path) AS expected FROM f GROUP BY pos)
SELECT count(*) AS rows_found, count_if(image_path IS DISTINCT FROM expected) AS differing FROM f LEFT JOIN e USING (pos)""")
def d11_expected_order(spark, d):
    """Found paths against the expected one at their position."""
    f = t(spark, d, "split_labels").filter(_split() == "train").select("pos", "image_path")
    e = f.groupBy("pos").agg(F.min("image_path").alias("expected"))
    return f.join(e, "pos", "left").agg(F.count(F.lit(1)).alias("rows_found"), F.count_if(~F.col("image_path").eqNullSafe(F.col("expected"))).alias("differing"))


@query(f"""
SELECT id, {TRIM.format('query_manuscript_id')} || ' / ' || {TRIM.format('neighbor_manuscript_id')} AS pair, round(1 - similarity_score, 6) AS distance FROM geniza_knn_results WHERE similarity_score IS NOT NULL AND NOT isnan(similarity_score)""")
def v6_distance(spark, d):
    rows = t(spark, d, "geniza_knn_results").filter(F.col("similarity_score").isNotNull() & ~F.isnan("similarity_score"))
    return rows.select("id", F.concat(trimmed("query_manuscript_id"), F.lit(" / "), trimmed("neighbor_manuscript_id")).alias("pair"), F.round(1 - F.col("similarity_score"), 6).alias("distance"))


@query("""
WITH c AS (SELECT label, count(*) AS n, count_if(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0 AND vec_id % 3 = 0) AS k FROM embeddings GROUP BY label)
SELECT label, n, k, round((k / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS low,
       round((k / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS high FROM c""")
def v12_wilson_interval(spark, d):
    """The interval of a share, here of the rows of a label whose id three divides."""
    c = t(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % 3 == 0).alias("k"))
    p, n, z = F.col("k") / F.col("n"), F.col("n"), 1.96
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))
    return c.select("label", "n", "k", *[F.round(x / (1 + z * z / n), 6).alias(c) for c, x in (("low", mid - half), ("high", mid + half))])
