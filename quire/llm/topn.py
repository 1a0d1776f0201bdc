"""Top N items of every group by statistics-guided skipping of row groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from quire.session import new_path, table

#: Bytes of a row group in the clustered table: small, so that its statistics are narrow and skipping it saves work.
ROW_GROUP_BYTES = 512 * 1024


def best_rows(rows: pd.DataFrame, n: int) -> pd.DataFrame:
    """Of rows (g, item, score, rank, id): one row per (g, item), then n per g, by score desc, rank, id."""
    rows = rows.sort_values(["g", "score", "rank", "id"], ascending=[True, False, True, True], na_position="last", kind="stable")
    rows = rows.drop_duplicates(["g", "item"])
    return rows[rows.groupby("g", sort=False).cumcount().to_numpy() < n]


def scan_file(uri: str, n: int) -> tuple[pd.DataFrame, int, int]:
    """The best rows of one clustered file, the row groups read and those skipped.

    Row groups are read in descending maximum score. One that holds a single group is skipped if its maximum lies
    strictly below that group's current n-th score. The file is sorted by group and score, so a row group that spans
    several groups holds the first rows of all but the first of them and can never lie below their n-th scores.
    """
    fs, path = FileSystem.from_uri(uri)
    with fs.open_input_file(path) as handle:
        file = pq.ParquetFile(handle)
        names = file.schema_arrow.names
        infos = []
        for i in range(file.metadata.num_row_groups):
            group = file.metadata.row_group(i)
            g, score = (group.column(names.index(c)).statistics for c in ("g", "score"))
            only = g.min if g is not None and g.has_min_max and g.min == g.max else None
            infos.append((score.max if score is not None and score.has_min_max else float("inf"), i, only))
        held: pd.DataFrame | None = None
        floor: dict[str, float] = {}
        skipped = 0
        for top, i, only in sorted(infos, key=lambda x: (-x[0], x[1])):
            if only is not None and top < floor.get(only, -float("inf")):
                skipped += 1
                continue
            read = best_rows(file.read_row_group(i).to_pandas(), n)
            if held is not None:
                again = held["g"].isin(read["g"].unique()).to_numpy()
                read = best_rows(pd.concat([held[again], read]), n)
                held = pd.concat([held[~again], read])
            else:
                held = read
            size = read.groupby("g", sort=False)["score"].agg(["size", "min"])
            floor.update(size.loc[size["size"] >= n, "min"].to_dict())
    return (held if held is not None else pd.DataFrame(columns=["g", "item", "score", "rank", "id"])), len(infos) - skipped, skipped


def top_n_per_group(rows: DataFrame, group: str, item: str, score: str, rank: str, row_id: str, n: int, row_group_bytes: int = ROW_GROUP_BYTES) -> DataFrame:
    """The n best rows of every group: columns group, item, score, rank, row_id and position (1..n).

    Order: score descending, rank ascending (null last), row_id ascending; of the rows with the same group and item
    only the first counts. Rows with a null or NaN score or a null group are dropped; null items count as one item.
    Groups with fewer rows come out whole. Other columns are ignored; no rows, no result.

    The rows are written clustered by (group, score descending) into the shared folder; a range partitioning on both
    divides a group of millions over many files. Each file is read row group by row group in descending maximum
    score, skipping what lies strictly below the n-th score of the group it holds. Of every file at most n rows per
    group remain, which one small ranking merges.
    """
    spark = rows.sparkSession
    c = rows.select(
        F.col(group).alias("g"), F.col(item).alias("item"), F.col(score).cast("double").alias("score"),
        F.col(rank).cast("bigint").alias("rank"), F.col(row_id).cast("bigint").alias("id"),
    ).filter(F.col("g").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    uri = new_path(spark, "clustered")
    order = [F.col("g"), F.desc("score"), F.asc_nulls_last("rank"), F.col("id")]
    (
        c.repartitionByRange(F.col("g"), F.desc("score"), F.col("id")).sortWithinPartitions(*order)
        .write.option("parquet.block.size", str(row_group_bytes)).option("parquet.page.size", str(row_group_bytes // 4)).parquet(uri)
    )
    files = spark.read.schema(c.schema).parquet(uri).inputFiles()
    schema = pa.schema([("g", pa.string()), ("item", pa.string()), ("score", pa.float64()), ("rank", pa.int64()), ("id", pa.int64())])

    def scan(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                best, _, _ = scan_file(i, n)
                if len(best):
                    best = best.astype({"rank": "Int64"})
                    yield pa.RecordBatch.from_pandas(best[schema.names], schema=schema, preserve_index=False)

    if not files:
        return c.limit(0).select(F.col("g").alias(group), F.col("item").alias(item), F.col("score").alias(score), F.col("rank").alias(rank), F.col("id").alias(row_id), F.lit(0).alias("position"))
    best = spark.createDataFrame([(x,) for x in files], "uri string").repartition(len(files)).mapInArrow(scan, "g string, item string, score double, rank bigint, id bigint")
    by = [F.desc("score"), F.asc_nulls_last("rank"), F.col("id")]
    one = best.withColumn("_first", F.row_number().over(Window.partitionBy("g", "item").orderBy(*by))).filter("_first = 1")
    out = one.withColumn("position", F.row_number().over(Window.partitionBy("g").orderBy(*by))).filter(F.col("position") <= n)
    return out.select(F.col("g").alias(group), F.col("item").alias(item), F.col("score").alias(score), F.col("rank").alias(rank), F.col("id").alias(row_id), "position")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "geniza_knn_results")
    out = top_n_per_group(rows, "query_image_path", "neighbor_image_path", "similarity_score", "neighbor_rank", "id", 5)
    return out.select("query_image_path", "id")


QUERIES = {"p3_found": p3_found}

SQL = {
    "p3_found": """
WITH d AS (
  SELECT *, row_number() OVER (PARTITION BY query_image_path, neighbor_image_path
                               ORDER BY similarity_score DESC, neighbor_rank ASC NULLS LAST, id) AS f
  FROM geniza_knn_results WHERE similarity_score IS NOT NULL AND NOT isnan(similarity_score) AND query_image_path IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY query_image_path
                                   ORDER BY similarity_score DESC, neighbor_rank ASC NULLS LAST, id) AS p FROM d WHERE f = 1)
SELECT query_image_path, id FROM t WHERE p <= 5""",
}
