"""Scans, filters, joins, set operations, upserts (S, F, J, U, K groups)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quire.functions.text import blank_to_null, normal_path, trimmed
from quire.operators import relational as R
from quire.session import table as t

TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
NORM = r"regexp_replace(regexp_replace(trim({0}), '/(\./)+', '/', 'g'), '/+', '/', 'g')"
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s1_scan(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS place, l_partkey FROM lineitem")
def s3_ordered_children(spark, d):
    rows = R.ordered_children(t(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey")
    return rows.select("l_orderkey", F.posexplode("children").alias("place", "c")).select("l_orderkey", F.col("place").cast("bigint").alias("place"), "c.l_partkey")


@query("SELECT id, coalesce(page_split_x, 0.5) AS page_split_x, coalesce(rotation_angle, 0) AS rotation_angle, coalesce(is_two_page, false) AS is_two_page FROM image_metadata")
def s4_lookup_defaults(spark, d):
    rows = t(spark, d, "image_metadata").select("id", F.when(~F.isnan("page_split_x"), F.col("page_split_x")).alias("page_split_x"), "rotation_angle", "is_two_page")
    return R.with_defaults(rows, {"page_split_x": 0.5, "rotation_angle": 0, "is_two_page": False}).withColumn("page_split_x", F.col("page_split_x").cast("float"))


@query(f"SELECT id, image_path FROM image_metadata WHERE {NORM.format('image_path')} IN (SELECT {NORM.format('image_path')} FROM split_labels)")
def s6_multi_key_scan(spark, d):
    return R.by_path(t(spark, d, "image_metadata"), t(spark, d, "split_labels")).select("id", "image_path")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def s7_membership(spark, d):
    return t(spark, d, "orders").filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderpriority")


@query("SELECT column_name FROM (DESCRIBE SELECT * FROM geniza_knn_results)")
def s20_schema_probe(spark, d):
    return spark.createDataFrame([(c,) for c in t(spark, d, "geniza_knn_results").columns], "column_name string")


@query(f"""
WITH q AS (SELECT pos, image_path, {TRIM.format('label')} AS m, regexp_extract(image_path, '[^/]*$') AS pic FROM split_labels),
a AS (SELECT {TRIM.format('manuscript_id')} AS m, picture_id, min(id) AS id FROM geniza_image_latents GROUP BY 1, 2),
b AS (SELECT image_path, min(id) AS id FROM geniza_image_latents GROUP BY 1)
SELECT q.pos, q.image_path, coalesce(a.id, b.id) AS id FROM q LEFT JOIN a ON q.m = a.m AND q.pic = a.picture_id LEFT JOIN b ON q.image_path = b.image_path""")
def s22_two_step_lookup(spark, d):
    q = t(spark, d, "split_labels").select("pos", "image_path", trimmed("label").alias("m"), F.regexp_extract("image_path", "([^/]*)$", 1).alias("pic"))
    v = t(spark, d, "geniza_image_latents").select(trimmed("manuscript_id").alias("m"), F.col("picture_id").alias("pic"), "image_path", "id")
    a = v.groupBy("m", "pic").agg(F.min("id").alias("a"))
    b = v.groupBy("image_path").agg(F.min("id").alias("b"))
    return q.join(a, ["m", "pic"], "left").join(b, "image_path", "left").select("pos", "image_path", F.coalesce("a", "b").alias("id"))


@query("""
SELECT id FROM geniza_knn_results WHERE similarity_score >= 0.7 AND NOT isnan(similarity_score) AND coalesce(query_num_visual_patches, 0) >= 1
AND coalesce(query_num_glyphs, 0) >= 1 AND coalesce(neighbor_num_visual_patches, 0) >= 1 AND coalesce(neighbor_num_glyphs, 0) >= 1""")
def f1_evidence(spark, d):
    counts = [F.coalesce(F.col(f"{s}_num_{c}"), F.lit(0)) >= 1 for s in ("query", "neighbor") for c in ("visual_patches", "glyphs")]
    return R.where_all(t(spark, d, "geniza_knn_results"), [F.col("similarity_score") >= 0.7, ~F.isnan("similarity_score"), *counts]).select("id")


@query("SELECT id FROM geniza_image_latents WHERE is_color = true AND parent_directory = 'IE90000'")
def f2_dynamic_predicates(spark, d):
    rows = t(spark, d, "geniza_image_latents")
    return R.where_all(rows, R.present_predicates(rows, {"is_color": True, "parent_directory": "IE90000", "collection": "x"})).select("id")


@query(f"SELECT id, {TRIM.format('manuscript_id')} AS m FROM geniza_image_latents WHERE {TRIM.format('manuscript_id')} BETWEEN '7000000204' AND '7100000050'")
def f5_text_range(spark, d):
    return t(spark, d, "geniza_image_latents").select("id", trimmed("manuscript_id").alias("m")).filter(F.col("m").between("7000000204", "7100000050"))


@query(f"SELECT id FROM geniza_image_latents WHERE NOT ({TRIM.format('manuscript_id')} IN ('7000000117', '7000000204'))")
def f6_not_in(spark, d):
    return t(spark, d, "geniza_image_latents").filter(~trimmed("manuscript_id").isin("7000000117", "7000000204")).select("id")


@query(f"SELECT pos, lower({TRIM.format('split')}) AS split FROM split_labels WHERE lower({TRIM.format('split')}) IN ('train', 'val')")
def f7_split_filter(spark, d):
    return t(spark, d, "split_labels").select("pos", F.lower(trimmed("split")).alias("split")).filter(F.col("split").isin("train", "val"))


@query(f"SELECT id, coalesce(CASE WHEN id % 2 = 0 THEN image_path END, concat_ws('/', '/base', {TRIM.format('manuscript_id')}, parent_directory, picture_id)) AS path FROM geniza_image_latents")
def f8_derived_path(spark, d):
    rows = t(spark, d, "geniza_image_latents").withColumn("image_path", F.when(F.col("id") % 2 == 0, F.col("image_path")))
    return rows.select("id", R.derived_path("/base").alias("path"))


@query(f"""
SELECT m, arg_min(b, id) AS is_color FROM (SELECT {TRIM.format('manuscript_id')} AS m, id, CASE WHEN is_color IS NULL THEN NULL ELSE lower(CAST(is_color AS VARCHAR)) IN ('true', 't', '1', 'yes') END AS b
FROM geniza_image_latents) WHERE b IS NOT NULL GROUP BY m""")
def f9_boolean(spark, d):
    rows = t(spark, d, "geniza_image_latents").select(trimmed("manuscript_id").alias("m"), "id", R.boolean("is_color").alias("is_color")).filter("is_color IS NOT NULL")
    return R.first_per_key(rows, ["m"], [F.col("id")]).drop("id")


@query("""
SELECT CASE WHEN latent_vector IS NULL THEN 'null' WHEN len(latent_vector) <> 64 THEN 'length'
  WHEN len(list_filter(latent_vector, lambda e: e IS NULL OR isnan(e) OR isinf(e))) > 0 THEN 'not finite'
  WHEN sqrt(list_inner_product(CAST(latent_vector AS DOUBLE[]), CAST(latent_vector AS DOUBLE[]))) < 1e-8 THEN 'norm' ELSE 'valid' END AS reason, count(*) AS n
FROM geniza_image_latents GROUP BY 1""")
def f11_rejections(spark, d):
    from quire.functions.vectors import rejection

    return t(spark, d, "geniza_image_latents").groupBy(rejection("latent_vector", 64).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT id, num_visual_patches > 0 AS tile, coalesce(num_glyphs, 0) > 0 AS glyph, coalesce(num_words, 0) > 0 AS word,
  coalesce(num_visual_patches, 0) > 0 OR coalesce(num_glyphs, 0) > 0 OR coalesce(num_words, 0) > 0 AS fusion FROM geniza_image_latents""")
def f12_modality_gates(spark, d):
    has = {c: F.coalesce(F.col(f"num_{n}"), F.lit(0)) > 0 for c, n in (("tile", "visual_patches"), ("glyph", "glyphs"), ("word", "words"))}
    rows = t(spark, d, "geniza_image_latents")
    return rows.select("id", F.when(F.col("num_visual_patches").isNotNull(), has["tile"]).alias("tile"), has["glyph"].alias("glyph"), has["word"].alias("word"), (has["tile"] | has["glyph"] | has["word"]).alias("fusion"))


@query("SELECT a.s_suppkey AS s_suppkey_1, b.s_suppkey AS s_suppkey_2, a.s_nationkey AS s_nationkey_1, b.s_nationkey AS s_nationkey_2 FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def f21_suffixed_pairs(spark, d):
    return R.suffixed_pairs(t(spark, d, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey", ["s_nationkey"])


@query("SELECT m.image_path, m.id FROM image_metadata m WHERE NOT EXISTS (SELECT 1 FROM geniza_image_latents l WHERE l.image_path = m.image_path)")
def j1_anti_join(spark, d):
    return R.without_existing(t(spark, d, "image_metadata"), t(spark, d, "geniza_image_latents"), "image_path").select("image_path", "id")


@query("SELECT l.id, m.id AS meta_id FROM geniza_image_latents l JOIN image_metadata m USING (image_path) WHERE coalesce(l.num_glyphs, 0) >= 20 AND m.num_patches >= 10")
def j2_join_thresholds(spark, d):
    a = t(spark, d, "geniza_image_latents").filter(F.coalesce("num_glyphs", F.lit(0)) >= 20).select("id", "image_path")
    b = t(spark, d, "image_metadata").filter("num_patches >= 10").select(F.col("id").alias("meta_id"), "image_path")
    return a.join(b, "image_path").select("id", "meta_id")


@query("SELECT l_orderkey, l_linenumber, o_orderdate, c_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey")
def j3_multi_key_join(spark, d):
    """Every order line with its order's date and customer, met on two keys."""
    lines = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    o = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    named = lines.distinct().join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_orderdate", "c_name")
    return lines.join(named, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "o_orderdate", "c_name")


@query(f"""
SELECT l.id, {TRIM.format('s.normalized_library')} AS library FROM geniza_image_latents l LEFT JOIN
(SELECT {TRIM.format('manuscript_id')} AS m, min(normalized_library) AS normalized_library FROM geniza_manuscript_shelfmark GROUP BY 1) s
ON {TRIM.format('l.manuscript_id')} = s.m""")
def j5_left_join_cast(spark, d):
    s = t(spark, d, "geniza_manuscript_shelfmark").groupBy(trimmed("manuscript_id").cast("string").alias("m")).agg(F.min("normalized_library").alias("lib"))
    return t(spark, d, "geniza_image_latents").withColumn("m", trimmed("manuscript_id").cast("string")).join(s, "m", "left").select("id", trimmed("lib").alias("library"))


@query(f"""
WITH r AS (SELECT id, query_image_path AS p, {TRIM.format('query_manuscript_id')} AS m FROM geniza_knn_results WHERE neighbor_rank = 1)
SELECT a.id AS id_1, b.id AS id_2 FROM r a JOIN r b ON a.p = b.p AND a.m <> b.m""")
def j7_literal(spark, d):
    r = t(spark, d, "geniza_knn_results").filter("neighbor_rank = 1").select("id", F.col("query_image_path").alias("p"), trimmed("query_manuscript_id").alias("m"))
    return r.alias("a").join(r.alias("b"), (F.col("a.p") == F.col("b.p")) & (F.col("a.m") != F.col("b.m"))).select(F.col("a.id").alias("id_1"), F.col("b.id").alias("id_2"))


@query(f"""
WITH r AS (SELECT id, query_image_path AS q, neighbor_image_path AS n, {TRIM.format('query_manuscript_id')} AS m, {TRIM.format('neighbor_manuscript_id')} AS nm FROM geniza_knn_results WHERE neighbor_rank = 1)
SELECT a.id AS id_1, b.id AS id_2 FROM r a JOIN r b ON a.n = b.q AND b.n = a.q AND a.m <> b.m WHERE a.id < b.id""")
def j7_intended(spark, d):
    """Mutual first neighbours of different manuscripts."""
    r = t(spark, d, "geniza_knn_results").filter("neighbor_rank = 1").select("id", F.col("query_image_path").alias("q"), F.col("neighbor_image_path").alias("n"), trimmed("query_manuscript_id").alias("m"))
    on = (F.col("a.n") == F.col("b.q")) & (F.col("b.n") == F.col("a.q")) & (F.col("a.m") != F.col("b.m")) & (F.col("a.id") < F.col("b.id"))
    return r.alias("a").join(r.alias("b"), on).select(F.col("a.id").alias("id_1"), F.col("b.id").alias("id_2"))


@query(f"""
WITH l AS (SELECT {TRIM.format('query_manuscript_id')} AS a, {TRIM.format('neighbor_manuscript_id')} AS b FROM geniza_knn_results WHERE similarity_score >= 0.9 AND NOT isnan(similarity_score)),
u AS (SELECT a AS m FROM l UNION SELECT b FROM l)
SELECT id FROM geniza_image_latents WHERE {TRIM.format('manuscript_id')} IN (SELECT m FROM u)""")
def j9_union_semi_join(spark, d):
    l = t(spark, d, "geniza_knn_results").filter((F.col("similarity_score") >= 0.9) & ~F.isnan("similarity_score"))
    u = l.select(trimmed("query_manuscript_id").alias("m")).union(l.select(trimmed("neighbor_manuscript_id"))).distinct()
    return t(spark, d, "geniza_image_latents").select("id", trimmed("manuscript_id").alias("m")).join(u, "m", "left_semi").select("id")


@query("SELECT c_custkey, n_name, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
def j10_many_to_one(spark, d):
    n = t(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return R.many_to_one(t(spark, d, "customer"), n, "c_nationkey").select("c_custkey", "n_name", "n_regionkey")


@query(f"""
SELECT l.id, coalesce(s.lib, '') AS library, coalesce(s.root, '') AS shelfmark FROM geniza_image_latents l LEFT JOIN (
SELECT {TRIM.format('manuscript_id')} AS m, max({TRIM.format('normalized_library')}) AS lib, max({TRIM.format('shelfmark_root')}) AS root FROM geniza_manuscript_shelfmark GROUP BY 1) s
ON {TRIM.format('l.manuscript_id')} = s.m""")
def j11_map_join(spark, d):
    s = t(spark, d, "geniza_manuscript_shelfmark").groupBy(trimmed("manuscript_id").alias("m")).agg(F.max(trimmed("normalized_library")).alias("lib"), F.max(trimmed("shelfmark_root")).alias("root"))
    rows = t(spark, d, "geniza_image_latents").select("id", trimmed("manuscript_id").alias("m")).join(s, "m", "left")
    return rows.select("id", F.coalesce("lib", F.lit("")).alias("library"), F.coalesce("root", F.lit("")).alias("shelfmark"))


@query(f"SELECT s.pos, s.split, m.id FROM split_labels s JOIN image_metadata m ON {NORM.format('s.image_path')} = {NORM.format('m.image_path')}")
def j17_path_join(spark, d):
    m = t(spark, d, "image_metadata").select(normal_path("image_path").alias("p"), "id")
    return t(spark, d, "split_labels").select("pos", "split", normal_path("image_path").alias("p")).join(m, "p").select("pos", "split", "id")


@query(f"""
SELECT p AS image_path, count(DISTINCT s) AS splits FROM (SELECT {NORM.format('image_path')} AS p, CASE lower({TRIM.format('split')}) WHEN 'validation' THEN 'val' ELSE lower({TRIM.format('split')}) END AS s FROM split_labels)
WHERE p IS NOT NULL GROUP BY p HAVING count(DISTINCT s) > 1""")
def j19_split_overlap(spark, d):
    s = F.lower(trimmed("split"))
    rows = t(spark, d, "split_labels").select(normal_path("image_path").alias("image_path"), F.when(s == "validation", "val").otherwise(s).alias("split")).filter("image_path IS NOT NULL")
    return R.overlap_counts(rows, "image_path", "split")


@query("SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
def u1_union_distinct(spark, d):
    return t(spark, d, "orders").select(F.col("o_custkey").alias("k")).union(t(spark, d, "customer").select("c_custkey")).distinct()


@query("SELECT o_custkey AS k, 'o' AS side FROM orders UNION ALL SELECT c_custkey, 'c' FROM customer")
def u2_union_all(spark, d):
    return t(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.lit("o").alias("side")).unionByName(t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit("c").alias("side")))


@query("(SELECT c_custkey AS k, 'without' AS kind FROM customer EXCEPT SELECT o_custkey, 'without' FROM orders) UNION ALL (SELECT c_custkey, 'with' FROM customer INTERSECT SELECT o_custkey, 'with' FROM orders)")
def u4_intersect_difference(spark, d):
    c, o = t(spark, d, "customer").select(F.col("c_custkey").alias("k")), t(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return c.subtract(o).withColumn("kind", F.lit("without")).union(c.intersect(o).withColumn("kind", F.lit("with")))


@query("SELECT image_path, arg_min(id, id) AS id FROM geniza_image_latents GROUP BY image_path")
def u5_first_occurrence(spark, d):
    return R.first_per_key(t(spark, d, "geniza_image_latents").select("image_path", "id"), ["image_path"], [F.col("id")])


@query(f"SELECT {NORM.format('image_path')} AS image_path, arg_max(label, pos) AS label FROM split_labels WHERE label IS NOT NULL AND lower({TRIM.format('split')}) = 'train' GROUP BY 1")
def u6_last_pair(spark, d):
    rows = t(spark, d, "split_labels").filter((F.lower(trimmed("split")) == "train") & F.col("label").isNotNull()).select(normal_path("image_path").alias("image_path"), "label", "pos")
    return rows.groupBy("image_path").agg(F.max_by("label", "pos").alias("label"))


@query("SELECT value, row_number() OVER (ORDER BY value) - 1 AS index FROM (SELECT DISTINCT c_mktsegment AS value FROM customer WHERE c_mktsegment IS NOT NULL)")
def u7_dense_index(spark, d):
    return R.dense_index(t(spark, d, "customer"), "c_mktsegment").withColumn("index", F.col("index").cast("bigint"))


@query("SELECT unnest(['tile', 'glyph', 'word', 'tile+glyph', 'tile+word', 'glyph+word', 'tile+glyph+word']) AS modalities")
def u8_powerset(spark, d):
    from itertools import combinations

    names = ("tile", "glyph", "word")
    return spark.createDataFrame([("+".join(c),) for n in (1, 2, 3) for c in combinations(names, n)], "modalities string")


@query("""
SELECT image_path, id FROM (SELECT *, row_number() OVER (PARTITION BY image_path ORDER BY updated_at DESC NULLS LAST, id DESC) AS n FROM image_metadata) WHERE n = 1""")
def k3_upsert(spark, d):
    """The metadata rows in halves: the later half is upserted over the earlier by image path and update time."""
    rows = t(spark, d, "image_metadata").select("image_path", "id", "updated_at", F.struct(F.coalesce("updated_at", F.timestamp_seconds(F.lit(-1e10))), "id").alias("version"))
    return R.upsert(rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1"), ["image_path"], "version").select("image_path", "id")


@query("""
WITH l AS (SELECT image_path, max(id) AS id, min(id) AS first FROM geniza_image_latents GROUP BY image_path)
SELECT l.image_path, n.num_words AS num_words, o.num_glyphs AS num_glyphs FROM l JOIN geniza_image_latents n ON n.id = l.id JOIN geniza_image_latents o ON o.id = l.first""")
def k3_stale_column(spark, d):
    """An upsert that leaves one column as it was: the later row's words, the earlier row's glyphs."""
    rows = t(spark, d, "geniza_image_latents").select("image_path", "id", "num_words", "num_glyphs")
    first = R.first_per_key(rows, ["image_path"], [F.col("id")])
    out = R.upsert(first, R.first_per_key(rows, ["image_path"], [F.desc("id")]), ["image_path"], "id", keep=["num_glyphs"])
    return out.select("image_path", "num_words", "num_glyphs")


@query("SELECT l.id, CASE WHEN m.v IS NULL THEN l.num_words ELSE m.v END AS num_words FROM geniza_image_latents l LEFT JOIN (SELECT image_path, max(num_patches) AS v FROM image_metadata GROUP BY 1) m USING (image_path)")
def k5_keyed_update(spark, d):
    m = t(spark, d, "image_metadata").groupBy("image_path").agg(F.max("num_patches").alias("v"))
    return t(spark, d, "geniza_image_latents").select("id", "image_path", "num_words").join(m, "image_path", "left").select("id", F.coalesce("v", "num_words").alias("num_words"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def l1_limit_offset(spark, d):
    return t(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(100).limit(50)
