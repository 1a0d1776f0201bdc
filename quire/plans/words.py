"""Word and glyph filters, and operators that are one expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quire.functions import hebrew as H, vectors as V
from quire.functions.text import trimmed
from quire.operators import sampling as S
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


def good_word(word: str, confidence: str, least: float) -> Column:
    """Longer than one letter, Hebrew, and confident; without a confidence it fails."""
    return (F.length(word) > 1) & H.is_hebrew(word) & F.coalesce(F.col(confidence) >= least, F.lit(False))


def glyph_quality(area: Column, side: Column, aspect: Column, confidence: Column, least_area: float, least_side: float, most_aspect: float, least: float) -> Column:
    return (area >= least_area) & (side >= least_side) & (aspect <= most_aspect) & (F.coalesce(confidence, F.lit(0.0)) >= least)


def _words(spark: SparkSession, d: str) -> DataFrame:
    l = t(spark, d, "alto_text_lines").dropDuplicates(["line_id"]).select("line_id", F.when(~F.isnan("confidence"), F.col("confidence")).alias("conf"), F.coalesce("words", F.split("text", " ")).alias("w"))
    return l.select("line_id", "conf", F.posexplode("w").alias("place", "word"))


_W = """l AS (SELECT line_id, any_value(CASE WHEN NOT isnan(confidence) THEN confidence END) AS conf, coalesce(any_value(words), string_split(any_value(text), ' ')) AS w FROM alto_text_lines GROUP BY line_id),
w AS (SELECT line_id, conf, unnest(range(0, len(w))) AS place, unnest(w) AS word FROM l)"""
_HE = r"regexp_matches(word, '[\x{0590}-\x{05FF}]')"


@query(f"WITH {_W} SELECT line_id, place, word FROM w WHERE length(word) > 1 AND {_HE} AND conf >= 0.96 AND word IN (SELECT word FROM word_list)")
def f13_word_filter(spark: SparkSession, d: str):
    rows = _words(spark, d).filter(good_word("word", "conf", 0.96))
    return rows.join(t(spark, d, "word_list").select("word").distinct(), "word", "left_semi").select("line_id", F.col("place").cast("bigint").alias("place"), "word")


@query(f"""
WITH {_W}, g AS (SELECT line_id, place, length(word) AS n, unnest(range(0, length(word))) AS i, word FROM w WHERE length(word) > 1 AND {_HE} AND conf >= 0.96)
SELECT line_id, place, i, substr(word, i + 1, 1) AS char FROM g WHERE i > 0 AND i < n - 1""")
def f14_glyphs_of_words(spark, d):
    """Letters inside the words that pass, edges left out."""
    g = _words(spark, d).filter(good_word("word", "conf", 0.96)).select("line_id", "place", F.posexplode(F.split("word", "")).alias("i", "char"), F.length("word").alias("n"))
    return g.filter((F.col("i") > 0) & (F.col("i") < F.col("n") - 1)).select("line_id", F.col("place").cast("bigint").alias("place"), F.col("i").cast("bigint").alias("i"), "char")


@query(f"WITH {_W} SELECT line_id, place, word FROM w WHERE length(word) > 1 AND {_HE} AND NOT coalesce(conf >= 0.96, false) AND conf >= 0.92")
def f15_fallback_pool(spark, d):
    """Words below the word threshold whose letters are still above the glyph threshold."""
    rows = _words(spark, d).filter((F.length("word") > 1) & H.is_hebrew("word") & ~F.coalesce(F.col("conf") >= 0.96, F.lit(False)) & (F.col("conf") >= 0.92))
    return rows.select("line_id", F.col("place").cast("bigint").alias("place"), "word")


@query("""
WITH b AS (SELECT line_id, any_value(CASE WHEN NOT isnan(confidence) THEN confidence END) AS c, any_value(polygon) AS p FROM alto_text_lines WHERE polygon IS NOT NULL GROUP BY line_id),
s AS (SELECT line_id, c, (list_max(list_transform(p, lambda q: q.x)) - list_min(list_transform(p, lambda q: q.x)))::DOUBLE AS w, (list_max(list_transform(p, lambda q: q.y)) - list_min(list_transform(p, lambda q: q.y)))::DOUBLE AS h FROM b)
SELECT line_id FROM s WHERE w * h >= 4000 AND least(w, h) >= 10 AND greatest(w / h, h / w) <= 20 AND coalesce(c, 0) >= 0.92""")
def f16_box_quality(spark, d):
    p = t(spark, d, "alto_text_lines").filter("polygon IS NOT NULL").dropDuplicates(["line_id"])
    w, h = ((F.array_max(f"polygon.{c}") - F.array_min(f"polygon.{c}")).cast("double") for c in "xy")
    p = p.select("line_id", F.when(~F.isnan("confidence"), F.col("confidence")).alias("c"), w.alias("w"), h.alias("h"))
    ok = glyph_quality(F.col("w") * F.col("h"), F.least("w", "h"), F.greatest(F.col("w") / F.col("h"), F.col("h") / F.col("w")), F.col("c"), 4000, 10, 20, 0.92)
    return p.filter(ok).select("line_id")


@query(rf"WITH {_W} SELECT line_id, place FROM w WHERE trim(word) <> '' AND conf >= 0.95 AND NOT regexp_matches(word, '^[^\p{{L}}\p{{N}}]+$')")
def f17_word_quality(spark, d):
    rows = _words(spark, d).filter((F.trim("word") != "") & (F.col("conf") >= 0.95) & ~H.only_punctuation("word"))
    return rows.select("line_id", F.col("place").cast("bigint").alias("place"))


@query(f"""
WITH r AS (SELECT id, {TRIM.format('manuscript_id')} AS m FROM geniza_image_latents), g AS (SELECT m FROM r WHERE m IS NOT NULL GROUP BY m ORDER BY md5(m || '7'), m LIMIT 12),
k AS (SELECT id, m, row_number() OVER (PARTITION BY m ORDER BY md5(id::VARCHAR || '7'), id) AS k FROM r WHERE m IN (SELECT m FROM g)) SELECT id, m FROM k WHERE k <= 2""")
def l9_demo_sample(spark, d):
    rows = t(spark, d, "geniza_image_latents").select("id", trimmed("manuscript_id").alias("m"))
    return S.first_of_groups(rows, "m", "id", 12, 2, seed=7)


@query("WITH k AS (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer) SELECT c_custkey FROM k WHERE i IN (SELECT j * (n - 1) // 49 FROM range(50) x(j))")
def l20_bounded_quantiles(spark, d):
    """Fifty evenly spaced rows of an order, for quantiles of bounded cost."""
    return S.evenly_spaced(t(spark, d, "customer").select("c_custkey", "c_acctbal"), [F.col("c_acctbal"), F.col("c_custkey")], 50).select("c_custkey")


@query("""
WITH r AS (SELECT query_image_path AS q, id, similarity_score AS s, same_manuscript AS own FROM geniza_knn_results WHERE similarity_score IS NOT NULL AND NOT isnan(similarity_score)),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, id) AS k FROM r)
SELECT q, min(k) FILTER (own) AS self_rank, coalesce(min(k) FILTER (own) = 1, false) AS top1, max(s) FILTER (NOT own) AS best_other, round(max(s) FILTER (own) - max(s) FILTER (NOT own), 6) AS margin FROM k GROUP BY q""")
def w17_self_rank(spark, d):
    r = t(spark, d, "geniza_knn_results").filter(F.col("similarity_score").isNotNull() & ~F.isnan("similarity_score")).select(F.col("query_image_path").alias("q"), "id", F.col("similarity_score").alias("s"), F.col("same_manuscript").alias("own"))
    k = r.withColumn("k", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "id")).cast("bigint"))
    own = lambda c: F.when(F.col("own"), F.col(c))
    other = F.max(F.when(~F.col("own"), F.col("s")))
    return k.groupBy("q").agg(F.min(own("k")).alias("self_rank"), F.coalesce(F.min(own("k")) == 1, F.lit(False)).alias("top1"), other.alias("best_other"), F.round(F.max(own("s")) - other, 6).alias("margin"))


@query("""
WITH p AS (SELECT query_image_path AS q, avg(same_manuscript::INT) AS map, avg(similarity_score) FILTER (same_manuscript AND NOT isnan(similarity_score)) AS a, avg(similarity_score) FILTER (NOT same_manuscript AND NOT isnan(similarity_score)) AS b FROM geniza_knn_results GROUP BY 1)
SELECT q, round(map + 0.05 * coalesce(a - b, 0) - 0.02 * coalesce(b, 0), 6) AS score FROM p""")
def m13_checkpoint_score(spark, d):
    s = F.when(~F.isnan("similarity_score"), F.col("similarity_score"))
    same = F.col("same_manuscript")
    p = t(spark, d, "geniza_knn_results").groupBy(F.col("query_image_path").alias("q")).agg(F.avg(same.cast("int")).alias("map"), F.avg(F.when(same, s)).alias("a"), F.avg(F.when(~same, s)).alias("b"))
    return p.select("q", F.round(F.col("map") + 0.05 * F.coalesce(F.col("a") - F.col("b"), F.lit(0)) - 0.02 * F.coalesce("b", F.lit(0)), 6).alias("score"))


@query("SELECT count(*) AS rows_n, count(*) FILTER (similarity_score IS NULL OR isnan(similarity_score)) AS no_score, count(*) FILTER (query_num_words IS NULL OR neighbor_num_words IS NULL) AS no_words, count(*) FILTER (query_num_glyphs IS NULL OR neighbor_num_glyphs IS NULL) AS no_glyphs FROM geniza_knn_results")
def m21_missing_summary(spark, d):
    none = lambda *cs: F.count_if(F.array_contains(F.array(*[F.col(c).isNull() for c in cs]), True))
    r = t(spark, d, "geniza_knn_results")
    return r.agg(F.count(F.lit(1)).alias("rows_n"), F.count_if(F.col("similarity_score").isNull() | F.isnan("similarity_score")).alias("no_score"), none("query_num_words", "neighbor_num_words").alias("no_words"), none("query_num_glyphs", "neighbor_num_glyphs").alias("no_glyphs"))


@query("SELECT id, greatest(0.0, least(1.0, coalesce(TRY_CAST(nullif(regexp_extract(page_number, '([0-9]+)', 1), '') AS DOUBLE), 0) / 50)) AS c FROM geniza_image_latents")
def v16_clamp(spark, d):
    """A number in a text, 0 if there is none, in [0, 1]."""
    x = F.coalesce(F.expr("try_cast(regexp_extract(page_number, '([0-9]+)', 1) AS double)"), F.lit(0.0)) / 50
    return t(spark, d, "geniza_image_latents").select("id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)).alias("c"))


@query("SELECT id, round(greatest(image_width / image_height, image_height / image_width), 6) AS aspect FROM image_metadata WHERE image_width > 0 AND image_height > 0")
def v17_aspect(spark, d):
    a, b = F.col("image_width"), F.col("image_height")
    return t(spark, d, "image_metadata").filter((a > 0) & (b > 0)).select("id", F.round(F.greatest(a / b, b / a), 6).alias("aspect"))


@query("""
WITH x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), p AS (SELECT a.vec_id, list_transform(list_zip(a.x, b.x), lambda z: z[1] / sqrt(list_inner_product(a.x, a.x)) + z[2] / sqrt(list_inner_product(b.x, b.x))) AS v, a.x AS a FROM x a JOIN x b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(v[1] / sqrt(list_inner_product(v, v)), 6) AS mean_first, round(a[1] / sqrt(list_inner_product(a, a)) / sqrt(2.0::DOUBLE), 6) AS concat_first FROM p""")
def v21_fused_vectors(spark, d):
    """Two unit vectors fused: their mean at unit length, and one behind the other over the root of two."""
    e = t(spark, d, "embeddings").select("vec_id", V.unit("embedding").alias("a"))
    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    both = F.transform(F.concat("a", "b"), lambda x: x / F.sqrt(F.lit(2.0)))
    return j.select("vec_id", F.round(V.unit(V.add("a", "b"))[0], 6).alias("mean_first"), F.round(both[0], 6).alias("concat_first"))
