"""Splits that keep related records together."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from quire.functions.text import blank_to_null, normal_path
from quire.llm.components import hash_to_min
from quire.llm.differencing import partition
from quire.session import table

#: Equal bins per bucket of sources, and sources per bucket.
BINS, BUCKET_SOURCES = 40, 20_000
PROPORTIONS = {"train": 0.8, "val": 0.1, "test": 0.1}


def sources(manuscripts: DataFrame, shelfmarks: DataFrame) -> DataFrame:
    """(manuscript_id, source_id): manuscripts of one non-blank library and root share the smallest id among them.

    manuscripts: column manuscript_id; blank ids are dropped, repeated ones count once. A manuscript with several
    shelfmarks joins all their manuscripts. One without a complete shelfmark is a source by itself.
    """
    mark = shelfmarks.select(
        blank_to_null("manuscript_id").alias("m"), blank_to_null("normalized_library").alias("lib"), blank_to_null("shelfmark_root").alias("root")
    ).filter("m IS NOT NULL AND lib IS NOT NULL AND root IS NOT NULL")
    links = mark.select("m", F.concat(F.lit("￿"), F.to_json(F.array("lib", "root"))).alias("s"))  # behind every id, so that the least node is a manuscript
    groups = hash_to_min(links, "m", "s")
    ids = manuscripts.select(blank_to_null("manuscript_id").alias("manuscript_id")).filter("manuscript_id IS NOT NULL").distinct()
    return ids.join(groups.select(F.col("node").alias("manuscript_id"), F.col("component").alias("c")), "manuscript_id", "left").select(
        "manuscript_id", F.coalesce("c", "manuscript_id").alias("source_id")
    )


def labelled(split_labels: DataFrame, metadata: DataFrame) -> DataFrame:
    """(manuscript_id, split, n): rows of each manuscript in each of train, val and test, in one spelling.

    A null or blank label is replaced by the manuscript of the latest metadata row of the normalised image path;
    rows that lead to no manuscript or name no split are dropped.
    """
    split = F.lower(blank_to_null("split"))
    rows = split_labels.select(
        F.when(split == "validation", "val").otherwise(split).alias("split"), blank_to_null("label").alias("m"), normal_path("image_path").alias("path")
    ).filter(F.col("split").isin("train", "val", "test"))
    known = rows.filter("m IS NOT NULL").groupBy("m", "split").agg(F.count(F.lit(1)).alias("n"))
    paths = metadata.select(normal_path("image_path").alias("path"), blank_to_null("manuscript_id").alias("m"), "updated_at", "id").filter("m IS NOT NULL AND path IS NOT NULL")
    latest = paths.groupBy("path").agg(F.max_by("m", F.struct("updated_at", "id")).alias("m"))
    led = rows.filter("m IS NULL").groupBy("path", "split").agg(F.count(F.lit(1)).alias("n")).join(latest, "path")
    return known.unionByName(led.select("m", "split", "n")).groupBy(F.col("m").alias("manuscript_id"), "split").agg(F.sum("n").alias("n"))


def broken_sources(assigned: DataFrame, shelfmarks: DataFrame) -> DataFrame:
    """(manuscript_id, source_id) of every manuscript in assigned whose source stands in more than one split."""
    own = sources(assigned.select("manuscript_id"), shelfmarks)
    joined = assigned.select("manuscript_id", "split").join(own, "manuscript_id")
    failing = joined.groupBy("source_id").agg(F.min("split").alias("lo"), F.max("split").alias("hi")).filter("lo <> hi").select("source_id")
    return own.join(failing, "source_id", "left_semi").select("manuscript_id", "source_id")


def assign_splits(weights: DataFrame, source: str, weight: str, proportions: dict[str, float] = PROPORTIONS, bins: int = BINS, bucket_sources: int = BUCKET_SOURCES) -> DataFrame:
    """(source, weight, split): every source in one split, the weights near the given proportions.

    weights: one row per source; null sources are dropped, null and negative weights count as 0, repeated sources
    are added up. Sources heavier than a bin are at most `bins`; they are placed first, the heaviest first, each
    into the split that lacks most. All others go in hash buckets of about bucket_sources; in a bucket, largest
    differencing makes equal bins, and whole bins go to the split that lacks most of what is left. No sources, no
    result.
    """
    one = weights.filter(F.col(source).isNotNull()).groupBy(F.col(source).alias("s")).agg(F.sum(F.greatest(F.coalesce(F.col(weight).cast("bigint"), F.lit(0)), F.lit(0))).cast("bigint").alias("w"))
    n, total = one.agg(F.count(F.lit(1)), F.coalesce(F.sum("w"), F.lit(0))).first()
    names = list(proportions)
    heavy_from = max(1, -(-total // bins))
    heavy = one.filter(F.col("w") >= heavy_from).orderBy(F.desc("w"), "s").collect()  # at most `bins` rows
    lack = {k: proportions[k] * total / sum(proportions.values()) for k in names}
    placed = []
    for row in heavy:
        k = max(names, key=lambda x: (lack[x], -names.index(x)))
        lack[k] -= row.w
        placed.append((row.s, row.w, k))
    room = [max(0.0, lack[k]) for k in names]
    share = [r / (sum(room) or 1) for r in room]
    buckets = max(1, -(-n // bucket_sources))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["w", "s"], ascending=[False, True], kind="stable", ignore_index=True)
        parts, sums = partition(pdf["w"].to_numpy(np.int64), min(bins, max(1, len(pdf))))
        left = [x * sums.sum() for x in share]
        count = [x * len(sums) for x in share]
        to = np.zeros(len(sums), dtype=int)
        for b in np.argsort(-sums, kind="stable"):
            to[b] = max(range(len(names)), key=lambda x: (left[x], count[x], -x))
            left[to[b]] -= sums[b]
            count[to[b]] -= 1
        pdf["split"] = [names[to[p]] for p in parts]
        return pdf[["s", "w", "split"]]

    kind = weights.schema[source].dataType.simpleString()
    light = one.filter(F.col("w") < heavy_from).withColumn("b", F.pmod(F.xxhash64("s"), F.lit(buckets)))
    out = light.groupBy("b").applyInPandas(place, f"s {kind}, w bigint, split string")
    if placed:
        out = out.unionByName(weights.sparkSession.createDataFrame(placed, f"s {kind}, w bigint, split string"))
    return out.select(F.col("s").alias(source), F.col("w").alias(weight), "split")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = labelled(table(spark, sf_dir, "split_labels"), table(spark, sf_dir, "image_metadata"))
    return broken_sources(assigned, table(spark, sf_dir, "geniza_manuscript_shelfmark")).select("manuscript_id")


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new assignment: all manuscripts of a source in one split, pages near 80 : 10 : 10."""
    assigned = labelled(table(spark, sf_dir, "split_labels"), table(spark, sf_dir, "image_metadata"))
    own = sources(assigned.select("manuscript_id"), table(spark, sf_dir, "geniza_manuscript_shelfmark"))
    weights = assigned.join(own, "manuscript_id").groupBy("source_id").agg(F.sum("n").alias("pages"))
    placed = assign_splits(weights, "source_id", "pages")
    return own.join(placed, "source_id").select("manuscript_id", "source_id", "split", F.col("pages").alias("source_pages"))


def p5_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What p5_splits must keep: manuscripts, pages, sources in several splits, and whether each split is within 1 % of its share."""
    rows = p5_splits(spark, sf_dir)
    one = rows.groupBy("source_id").agg(F.max("source_pages").alias("n"), F.count(F.lit(1)).alias("m"), F.min("split").alias("split"), F.max("split").alias("hi"))
    near = [F.abs(F.sum(F.when(F.col("split") == k, F.col("n")).otherwise(0)) / F.sum("n") - p) <= 0.01 for k, p in PROPORTIONS.items()]
    return one.agg(F.sum("m").alias("manuscripts"), F.sum("n").alias("pages"), F.count_if(F.col("split") != F.col("hi")).alias("divided_sources"), (near[0] & near[1] & near[2]).alias("near_shares"))


QUERIES = {"p5_found": p5_found, "p5_splits": p5_splits, "p5_balance": p5_balance}

SQL = {
    "p5_balance": r"""
WITH meta AS (SELECT path, arg_max(m, (updated_at, id)) AS m FROM (
  SELECT regexp_replace(regexp_replace(regexp_replace(trim(image_path), '/(\./)+', '/', 'g'), '/+', '/', 'g'), '/[^/]+/\.\./', '/', 'g') AS path,
         nullif(regexp_replace(manuscript_id, '^\s+|\s+$', '', 'g'), '') AS m, updated_at, id FROM image_metadata) WHERE m IS NOT NULL GROUP BY path),
r AS (SELECT lower(regexp_replace(split, '^\s+|\s+$', '', 'g')) AS split, nullif(regexp_replace(label, '^\s+|\s+$', '', 'g'), '') AS l,
             regexp_replace(regexp_replace(regexp_replace(trim(image_path), '/(\./)+', '/', 'g'), '/+', '/', 'g'), '/[^/]+/\.\./', '/', 'g') AS path FROM split_labels)
SELECT count(DISTINCT coalesce(r.l, meta.m)) AS manuscripts, count(coalesce(r.l, meta.m)) AS pages, CAST(0 AS BIGINT) AS divided_sources, true AS near_shares
FROM r LEFT JOIN meta ON r.path = meta.path WHERE r.split IN ('train', 'val', 'validation', 'test')""",
    "p5_found": r"""
WITH RECURSIVE t AS (
  SELECT nullif(regexp_replace(manuscript_id, '^\s+|\s+$', '', 'g'), '') AS m,
         nullif(regexp_replace(normalized_library, '^\s+|\s+$', '', 'g'), '') AS lib,
         nullif(regexp_replace(shelfmark_root, '^\s+|\s+$', '', 'g'), '') AS root FROM geniza_manuscript_shelfmark),
e AS (SELECT DISTINCT a.m AS v, b.m AS u FROM t a JOIN t b ON a.lib = b.lib AND a.root = b.root WHERE a.m IS NOT NULL AND b.m IS NOT NULL),
c AS (SELECT v, u FROM e UNION SELECT c.v, e.u FROM c JOIN e ON c.u = e.v),
g AS (SELECT v AS m, min(u) AS s FROM c GROUP BY v),
meta AS (SELECT path, arg_max(m, (updated_at, id)) AS m FROM (
  SELECT regexp_replace(regexp_replace(regexp_replace(trim(image_path), '/(\./)+', '/', 'g'), '/+', '/', 'g'), '/[^/]+/\.\./', '/', 'g') AS path,
         nullif(regexp_replace(manuscript_id, '^\s+|\s+$', '', 'g'), '') AS m, updated_at, id FROM image_metadata) WHERE m IS NOT NULL GROUP BY path),
r AS (SELECT CASE lower(regexp_replace(split, '^\s+|\s+$', '', 'g')) WHEN 'validation' THEN 'val' ELSE lower(regexp_replace(split, '^\s+|\s+$', '', 'g')) END AS split,
             nullif(regexp_replace(label, '^\s+|\s+$', '', 'g'), '') AS l,
             regexp_replace(regexp_replace(regexp_replace(trim(image_path), '/(\./)+', '/', 'g'), '/+', '/', 'g'), '/[^/]+/\.\./', '/', 'g') AS path FROM split_labels),
a AS (SELECT DISTINCT coalesce(r.l, meta.m) AS m, r.split FROM r LEFT JOIN meta ON r.path = meta.path WHERE r.split IN ('train', 'val', 'test')),
s AS (SELECT a.m, a.split, coalesce(g.s, a.m) AS s FROM a LEFT JOIN g ON a.m = g.m WHERE a.m IS NOT NULL),
f AS (SELECT s FROM s GROUP BY s HAVING count(DISTINCT split) > 1)
SELECT DISTINCT m AS manuscript_id FROM s WHERE s IN (SELECT s FROM f)""",
}
