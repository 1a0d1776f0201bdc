"""Queries on keys of which a few hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.functions.text import trimmed
from quire.operators.skew import eager_join_aggregate, middle_rows
from quire.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both fields in one run: a key is the field's name and the value."""
    rows = lambda name, field, key, value: table(spark, sf_dir, name).select(
        F.struct(F.lit(field).alias("field_name"), key.alias("key_value")).alias("key"), F.col(value).cast("double").alias("v"), F.col("id").alias("row_id")
    )
    pages = rows("geniza_image_latents", "manuscript_id", trimmed("manuscript_id"), "num_words")
    links = rows("geniza_knn_results", "total_images_in_query_manuscripts", F.col("total_images_in_query_manuscripts").cast("string"), "similarity_score")
    out = middle_rows(pages.unionByName(links), "key", "v", "row_id")
    return out.filter(F.col("key.key_value").isNotNull()).select("key.field_name", "key.key_value", "row_id")


def p1_join_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages joined with neighbour rows on the manuscript: rows of the join, words and scores over it."""
    pages = table(spark, sf_dir, "geniza_image_latents").select(trimmed("manuscript_id").alias("manuscript"), "num_words")
    links = table(spark, sf_dir, "geniza_knn_results").select(
        trimmed("query_manuscript_id").alias("manuscript"), F.when(~F.isnan("similarity_score"), F.col("similarity_score")).alias("score")
    )
    pages = pages.withColumn("group_key", F.col("manuscript"))
    out = eager_join_aggregate(pages, links, "manuscript", ["group_key"], "num_words", "score")
    return out.select(
        F.col("group_key").alias("manuscript_id"), F.col("pairs").alias("joined_rows"), F.col("left_sum").alias("words"), F.round("right_sum", 3).alias("scores")
    )


QUERIES = {"p1_found": p1_found, "p1_join_totals": p1_join_totals}

SQL = {
    "p1_found": r"""
WITH r AS (
  SELECT 'manuscript_id' AS field_name, regexp_replace(manuscript_id, '^\s+|\s+$', '', 'g') AS key_value,
         CAST(num_words AS DOUBLE) AS v, id
  FROM geniza_image_latents WHERE num_words IS NOT NULL
  UNION ALL
  SELECT 'total_images_in_query_manuscripts', CAST(total_images_in_query_manuscripts AS VARCHAR), similarity_score, id
  FROM geniza_knn_results WHERE similarity_score IS NOT NULL AND NOT isnan(similarity_score)),
o AS (SELECT *, row_number() OVER (PARTITION BY field_name, key_value ORDER BY v, id) AS rn,
             count(*) OVER (PARTITION BY field_name, key_value) AS n FROM r WHERE key_value IS NOT NULL)
SELECT field_name, key_value, id AS row_id FROM o WHERE rn = (n + 1) // 2""",
    "p1_join_totals": r"""
SELECT p.m AS manuscript_id, count(*) AS joined_rows, coalesce(sum(CAST(p.num_words AS DOUBLE)), 0.0) AS words,
       round(coalesce(sum(k.s), 0.0), 3) AS scores
FROM (SELECT regexp_replace(manuscript_id, '^\s+|\s+$', '', 'g') AS m, num_words FROM geniza_image_latents) p
JOIN (SELECT regexp_replace(query_manuscript_id, '^\s+|\s+$', '', 'g') AS m,
             CASE WHEN NOT isnan(similarity_score) THEN similarity_score END AS s FROM geniza_knn_results) k ON p.m = k.m
GROUP BY p.m""",
}
