"""Graph queries over the neighbour table (A10-A12, F18-F20, G group)."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window, functions as F

from quire.functions.text import blank_to_null, trimmed
from quire.operators import graph as G
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


def _links(spark, d):
    return t(spark, d, "geniza_knn_results").select("id", blank_to_null("query_manuscript_id").alias("a"), blank_to_null("neighbor_manuscript_id").alias("b"), "similarity_score", "total_images_in_query_manuscripts", "query_image_path", "neighbor_image_path")


def _edges(spark, d):
    return G.edges(_links(spark, d), "a", "b", "similarity_score", "id")


_L = f"""l AS (SELECT id, nullif({TRIM.format('query_manuscript_id')}, '') AS a, nullif({TRIM.format('neighbor_manuscript_id')}, '') AS b, CASE WHEN similarity_score IS NULL OR isnan(similarity_score) THEN 0 ELSE similarity_score END AS s, total_images_in_query_manuscripts AS n FROM geniza_knn_results),
p AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, s, id FROM l WHERE a <> b),
e AS (SELECT src, dst, count(*) AS weight, greatest(max(s), 0.0) AS max_similarity FROM p GROUP BY 1, 2),
te AS (SELECT * FROM e)"""


@query(f"""
WITH {_L}, r AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY s DESC, id) AS k FROM p),
x AS (SELECT src, dst, max(id) FILTER (k = 1) AS best_row, list(id ORDER BY k) FILTER (k <= 100) AS ids FROM r GROUP BY 1, 2)
SELECT e.src, e.dst, weight, max_similarity, best_row, array_to_string(ids, ',') AS example_rows FROM e JOIN x USING (src, dst)""")
def a10_edges(spark: SparkSession, d: str):
    return _edges(spark, d).withColumn("example_rows", F.array_join(F.transform("example_rows", lambda x: x.cast("string")), ","))


@query(f"""
WITH {_L}, q AS (SELECT a AS node, max(n) AS total_images FROM l WHERE a IS NOT NULL GROUP BY 1), v AS (SELECT src AS node FROM e UNION SELECT dst FROM e)
SELECT v.node, q.total_images FROM v LEFT JOIN q USING (node)""")
def a11_nodes(spark, d):
    q = _links(spark, d).groupBy(F.col("a").alias("node")).agg(F.max("total_images_in_query_manuscripts").alias("total_images"))
    return G.ends(_edges(spark, d)).select("node").distinct().join(q, "node", "left")


@query("""
WITH r AS (SELECT id, least(query_image_path, neighbor_image_path) AS src, greatest(query_image_path, neighbor_image_path) AS dst, similarity_score AS s FROM geniza_knn_results
WHERE query_image_path <> neighbor_image_path AND similarity_score IS NOT NULL AND NOT isnan(similarity_score))
SELECT src, dst, id FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY s DESC, id) AS k FROM r) WHERE k = 1""")
def a12_image_edges(spark, d):
    return G.best_edges(t(spark, d, "geniza_knn_results"), "query_image_path", "neighbor_image_path", "similarity_score", "id").select("src", "dst", "id")


@query(f"""
WITH r AS (SELECT id, least(query_image_path, neighbor_image_path) AS src, greatest(query_image_path, neighbor_image_path) AS dst, similarity_score AS s, {TRIM.format('query_manuscript_id')} = {TRIM.format('neighbor_manuscript_id')} AS same
FROM geniza_knn_results WHERE query_image_path <> neighbor_image_path AND similarity_score IS NOT NULL AND NOT isnan(similarity_score))
SELECT src, dst, s AS similarity, same AS same_manuscript FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY s DESC, id) AS k FROM r) WHERE k = 1 ORDER BY s DESC, src, dst LIMIT 200""")
def g2_image_graph(spark, d):
    """The image graph's best 200 edges; same_manuscript is made from the ids, the stored flag is ignored."""
    e = G.best_edges(t(spark, d, "geniza_knn_results"), "query_image_path", "neighbor_image_path", "similarity_score", "id")
    same = trimmed("query_manuscript_id") == trimmed("neighbor_manuscript_id")
    return e.select("src", "dst", F.col("similarity_score").alias("similarity"), same.alias("same_manuscript")).orderBy(F.desc("similarity"), "src", "dst").limit(200)


_LIB = f"lib AS (SELECT {TRIM.format('manuscript_id')} AS m, coalesce(max({TRIM.format('normalized_library')}), '') AS lib, coalesce(max({TRIM.format('shelfmark_root')}), '') AS root FROM geniza_manuscript_shelfmark GROUP BY 1)"


def _libraries(spark, d):
    return t(spark, d, "geniza_manuscript_shelfmark").groupBy(trimmed("manuscript_id").alias("m")).agg(F.coalesce(F.max(trimmed("normalized_library")), F.lit("")).alias("lib"), F.coalesce(F.max(trimmed("shelfmark_root")), F.lit("")).alias("root"))


def _with_libraries(e, lib):
    a = lib.select(F.col("m").alias("src"), F.col("lib").alias("src_lib"))
    b = lib.select(F.col("m").alias("dst"), F.col("lib").alias("dst_lib"))
    return e.join(a, "src", "left").join(b, "dst", "left")


@query(f"""
WITH {_L}, {_LIB} SELECT e.src, e.dst, weight, x.lib AS src_lib, y.lib AS dst_lib FROM e JOIN lib x ON e.src = x.m JOIN lib y ON e.dst = y.m WHERE x.lib <> '' AND y.lib <> '' AND x.lib <> y.lib""")
def g9_inter_library(spark, d):
    e = _with_libraries(_edges(spark, d), _libraries(spark, d))
    return e.filter("src_lib <> '' AND dst_lib <> '' AND src_lib <> dst_lib").select("src", "dst", "weight", "src_lib", "dst_lib")


@query(f"""
WITH {_L}, {_LIB} SELECT e.src, e.dst, weight FROM e LEFT JOIN lib x ON e.src = x.m LEFT JOIN lib y ON e.dst = y.m
WHERE weight BETWEEN 2 AND 500 AND max_similarity >= 0.75 AND ((x.lib LIKE '%Archive' AND y.lib LIKE '%Collection') OR (y.lib LIKE '%Archive' AND x.lib LIKE '%Collection'))""")
def f19_interactive_filter(spark, d):
    e = _with_libraries(_edges(spark, d), _libraries(spark, d)).filter(F.col("weight").between(2, 500) & (F.col("max_similarity") >= 0.75))
    one, two = (F.col("src_lib").endswith("Archive") & F.col("dst_lib").endswith("Collection")), (F.col("dst_lib").endswith("Archive") & F.col("src_lib").endswith("Collection"))
    return e.filter(one | two).select("src", "dst", "weight")




@query(f"""
WITH {_L}, s AS (SELECT src, dst, weight, substr(src, 1, 2) = substr(dst, 1, 2) AS same FROM te), b AS (SELECT src AS node, same FROM s UNION ALL SELECT dst, same FROM s),
k AS (SELECT node FROM b GROUP BY node HAVING bool_or(same) AND bool_or(NOT same)) SELECT src, dst, weight FROM s WHERE src IN (SELECT node FROM k) AND dst IN (SELECT node FROM k)""")
def f20_bridges(spark, d):
    return G.bridges(_edges(spark, d), F.substring("src", 1, 2) == F.substring("dst", 1, 2)).select("src", "dst", "weight")


@query(f"WITH {_L} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node")
def g11_degree(spark, d):
    return G.degrees(_edges(spark, d))


@query(f"""
WITH {_L}, b AS (SELECT src AS v, dst AS u FROM te UNION SELECT dst, src FROM te), start AS (SELECT max(m) AS m FROM (SELECT v AS m, count(*) AS c FROM b GROUP BY v ORDER BY c DESC, v DESC LIMIT 1)),
h0 AS (SELECT m AS node FROM start), h1 AS (SELECT DISTINCT u AS node FROM b JOIN h0 ON b.v = h0.node WHERE u NOT IN (SELECT node FROM h0)),
h2 AS (SELECT DISTINCT u AS node FROM b JOIN h1 ON b.v = h1.node WHERE u NOT IN (SELECT node FROM h0 UNION SELECT node FROM h1))
SELECT node, hop, (SELECT count(*) FROM b WHERE b.v = node) AS degree FROM (SELECT node, 0 AS hop FROM h0 UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2)""")
def g4_ego_nodes(spark, d):
    """Two hops around the manuscript of most links."""
    e = _edges(spark, d)
    top = G.degrees(e).orderBy(F.desc("degree"), F.desc("node")).limit(1).collect()
    return G.ego(e, [r.node for r in top], 2)[0]


@query(f"""
WITH {_L}, b AS (SELECT src AS v, dst AS u FROM te UNION SELECT dst, src FROM te), start AS (SELECT v AS m FROM (SELECT v, count(*) AS c FROM b GROUP BY v ORDER BY c DESC, v DESC LIMIT 1)),
h0 AS (SELECT m AS node FROM start), h1 AS (SELECT DISTINCT u AS node FROM b JOIN h0 ON b.v = h0.node WHERE u NOT IN (SELECT node FROM h0)),
h2 AS (SELECT DISTINCT u AS node FROM b JOIN h1 ON b.v = h1.node WHERE u NOT IN (SELECT node FROM h0 UNION SELECT node FROM h1)),
n AS (SELECT node FROM (SELECT node, hop, (SELECT count(*) FROM b WHERE b.v = node) AS degree FROM (SELECT node, 0 AS hop FROM h0 UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2)) ORDER BY hop, degree DESC, node LIMIT 20)
SELECT src, dst, weight FROM te WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n)""")
def g5_ego_edges(spark, d):
    """The edges among the first 20 nodes around the manuscript of most links."""
    e = _edges(spark, d)
    top = G.degrees(e).orderBy(F.desc("degree"), F.desc("node")).limit(1).collect()
    return G.ego(e, [r.node for r in top], 2, most=20)[1].select("src", "dst", "weight")


@query(f"WITH {_L} SELECT x.src AS a, x.dst AS b, y.dst AS c FROM te x JOIN te y ON x.dst = y.src JOIN te z ON z.src = x.src AND z.dst = y.dst")
def g6_triangles(spark, d):
    return G.triangles(_edges(spark, d))


@query(f"""
WITH {_L}, k AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM te x JOIN te y ON x.dst = y.src JOIN te z ON z.src = x.src AND z.dst = y.dst),
pr AS (SELECT a AS src, b AS dst FROM k UNION SELECT a, c FROM k UNION SELECT b, c FROM k) SELECT src, dst, weight FROM te JOIN pr USING (src, dst)""")
def g7_clique_edges(spark, d):
    return G.clique_edges(_edges(spark, d), 3).select("src", "dst", "weight")


@query(f"""
WITH {_L}, k AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM te x JOIN te y ON x.dst = y.src JOIN te z ON z.src = x.src AND z.dst = y.dst)
SELECT a || ',' || b || ',' || c || ',' || w.dst AS members FROM k JOIN te w ON w.src = k.c JOIN te v ON v.src = k.a AND v.dst = w.dst JOIN te u ON u.src = k.b AND u.dst = w.dst""")
def g6_four_cliques(spark, d):
    return G.k_cliques(_edges(spark, d), 4).select(F.array_join("c", ",").alias("members"))


@query()
def g6_maximal_cliques(spark, d):
    """All maximal cliques of three manuscripts and more."""
    return G.maximal_cliques(_edges(spark, d), 3).select(F.array_join("c", ",").alias("members"), F.size("c").cast("bigint").alias("size"))


@query(f"""
WITH r AS (SELECT id, least(query_image_path, neighbor_image_path) AS src, greatest(query_image_path, neighbor_image_path) AS dst, CASE WHEN similarity_score IS NULL OR isnan(similarity_score) THEN 0 ELSE similarity_score END AS s FROM geniza_knn_results
WHERE query_image_path <> neighbor_image_path)
SELECT src, dst, count(*) AS weight, round(greatest(max(s), 0.0), 6) AS max_similarity FROM r GROUP BY src, dst""")
def g3_image_graph(spark, d):
    """The graph of images: one edge for two images, with the rows that link them and the best score."""
    rows = t(spark, d, "geniza_knn_results").select("id", F.col("query_image_path").alias("a"), F.col("neighbor_image_path").alias("b"), "similarity_score")
    return G.edges(rows, "a", "b", "similarity_score", "id").select("src", "dst", "weight", F.round("max_similarity", 6).alias("max_similarity"))


@query()
def g8_communities(spark, d):
    return G.communities(_edges(spark, d), "weight")


@query()
def g10_circle_layout(spark, d):
    c = G.communities(_edges(spark, d), "weight")
    return G.circle_layout(c, "community", "node").select("node", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(f"""SELECT id, regexp_extract(v, '"nodes":\\[([^\\]]*)\\]', 1) AS nodes FROM (SELECT id, '<script>var data = {{"nodes":["' || query_image_name || '","' || neighbor_image_name || '"]}};</script>' AS v FROM geniza_knn_results)""")
def g12_graph_from_html(spark, d):
    """A graph read back from the script of an exported page."""
    html = F.concat(F.lit('<script>var data = {"nodes":["'), F.col("query_image_name"), F.lit('","'), F.col("neighbor_image_name"), F.lit('"]};</script>'))
    doc = F.from_json(F.regexp_extract(html, r"var data = (\{.*?\});", 1), "nodes array<string>")
    return t(spark, d, "geniza_knn_results").select("id", F.array_join(F.transform(doc["nodes"], lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ",").alias("nodes"))


@query(f"WITH {_LIB} SELECT m AS manuscript_id, lib AS library, CASE WHEN root <> '' THEN root ELSE m END AS label FROM lib")
def j12_node_labels(spark, d):
    return _libraries(spark, d).select(F.col("m").alias("manuscript_id"), F.col("lib").alias("library"), F.when(F.col("root") != "", F.col("root")).otherwise(F.col("m")).alias("label"))
