"""Sources, sinks and streams as round trips (S8-S24, K groups, and the streaming extension)."""

from __future__ import annotations

from pyspark.sql import SparkSession, functions as F

from quire.functions.text import trimmed
from quire.operators import metrics as M, profile as P, reduction as N, relational as R, sampling as S
from quire.session import new_path, table as t
from quire.sources import files
from quire.streaming import incremental as I

QUERIES, SQL = {}, {}
TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def s8_csv_round_trip(spark: SparkSession, d: str):
    p = new_path(spark, "csv")
    t(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey").write.option("header", "true").csv(p)
    return files.read_csv(spark, p, ["s_suppkey", "s_name"], "s_suppkey bigint, s_name string, s_nationkey int")


@query("SELECT image_path, regexp_replace(image_path, '\\.[^./]*$', '.xml') AS xml_path, manuscript_id AS cluster_id FROM geniza_image_latents WHERE len(string_split(regexp_replace(image_path, '^/data/geniza/', ''), '/')) >= 3")
def s9_member_layout(spark, d):
    """The second member layout: paths made from a relative path below a base."""
    rows = t(spark, d, "geniza_image_latents").select(F.regexp_replace("image_path", "^/data/geniza/", "").alias("relative_path"), F.col("manuscript_id").alias("cluster_id"))
    return files.members(rows, "/data/geniza")


@query(f"SELECT DISTINCT {TRIM.format('manuscript_id')} AS id FROM geniza_manuscript_shelfmark WHERE {TRIM.format('manuscript_id')} <> ''")
def s19_id_list(spark, d):
    p = new_path(spark, "ids")
    t(spark, d, "geniza_manuscript_shelfmark").select(F.coalesce("manuscript_id", F.lit(""))).write.text(p)
    return files.id_list(spark, p)


@query("SELECT n_nationkey, n_name FROM nation")
def s24_listing(spark, d):
    """Files found in a folder and read by the names the listing gives."""
    p = new_path(spark, "json")
    t(spark, d, "nation").select("n_nationkey", "n_name").repartition(3).write.json(p)
    found = [r.path for r in files.listing(spark, p, "*.json").collect()]
    return spark.read.schema("n_nationkey int, n_name string").json(found)


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def k2_overwrite(spark, d):
    p = new_path(spark, "table")
    rows = t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    files.overwrite(rows.limit(10), p)
    files.overwrite(rows, p, by=["o_orderstatus"])
    return spark.read.parquet(p).select("o_orderkey", F.col("o_orderstatus").cast("string").alias("o_orderstatus"))


@query("SELECT s_suppkey, s_name, NULL::DOUBLE AS rating FROM supplier")
def k1_evolve(spark, d):
    return files.evolve(t(spark, d, "supplier").select("s_suppkey", "s_name"), {"rating": "double", "s_name": "string"})


@query("SELECT o_orderkey, count(*) AS lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def k6_parent_child(spark, d):
    p = new_path(spark, "pair")
    files.write_parent_child(t(spark, d, "orders").select("o_orderkey"), t(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), p)
    a, b = spark.read.parquet(p + "/parent"), spark.read.parquet(p + "/child")
    return a.join(b, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("lines"))


@query("SELECT image_path FROM image_metadata EXCEPT SELECT image_path FROM geniza_image_latents")
def k8_not_yet_there(spark, d):
    return R.without_existing(t(spark, d, "image_metadata"), t(spark, d, "geniza_image_latents"), "image_path").select("image_path").distinct()


@query("SELECT l_returnflag AS metric, round(avg(l_quantity), 6) AS value FROM lineitem GROUP BY 1")
def k10_metrics_json(spark, d):
    m = t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("metric")).agg(F.round(F.avg("l_quantity"), 6).alias("value"))
    text = files.metrics_json(m, "metric", "value")
    return spark.createDataFrame([(text,)], "j string").select(F.explode(F.from_json("j", "map<string,double>")).alias("metric", "value"))


@query("SELECT l_returnflag AS flag, count(*) AS stats_n, max(l_quantity) AS stats_top FROM lineitem GROUP BY 1")
def k14_flatten(spark, d):
    s = t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.struct(F.count(F.lit(1)).alias("n"), F.max("l_quantity").alias("top")).alias("stats"))
    return files.flatten(s, "stats")


@query("SELECT event_type, date_trunc('hour', ts) AS window_start, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windowed_counts(spark, d):
    """Tumbling windows; the same operator runs on a stream with a watermark (tests run it so)."""
    return I.windowed_counts(t(spark, d, "events"), "ts", "event_type")


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def stream_upserts(spark, d):
    """The events as a stream of files: each user's latest event, upserted batch by batch."""
    src, target = new_path(spark, "events"), new_path(spark, "target")
    e = t(spark, d, "events").select("user_id", "event_id")
    e.repartition(4).write.parquet(src)
    I.start_upserts(I.read_new_files(spark, src, e.schema, 2), target, ["user_id"], "event_id", new_path(spark, "state")).awaitTermination()
    return I.current(spark, target)


@query(f"SELECT DISTINCT {TRIM.format('label')} AS label FROM split_labels WHERE lower({TRIM.format('split')}) = 'train' AND {TRIM.format('label')} <> ''")
def d4_train_labels(spark, d):
    s = F.lower(trimmed("split"))
    rows = t(spark, d, "split_labels").select(F.when(s == "validation", "val").otherwise(s).alias("split"), trimmed("label").alias("label"))
    P.require_splits(rows, "split")
    return rows.filter("split = 'train' AND label <> ''").select("label").distinct()


def _folded(spark, d):
    return S.folds(t(spark, d, "embeddings").withColumn("split", F.lit("train")), "vec_id", "label", "split")


@query()
def m22_ridge(spark, d):
    """Label from the vector by ridge regression: alpha by the error of five folds, and the error out of fold."""
    alpha, rows = N.ridge_by_folds(_folded(spark, d), "embedding", "label", "fold", 64, [0.1, 1.0, 10.0, 100.0])
    out = M.regression_metrics(rows.select(F.col("label").cast("double").alias("y"), F.col("_p").alias("p")), "y", "p")
    return out.withColumn("alpha", F.lit(alpha))


@query()
def m23_logistic(spark, d):
    """Even against odd labels from the vector by logistic regression: C by the ROC-AUC of five folds, and that AUC."""
    c, auc = N.logistic_by_folds(_folded(spark, d).withColumn("y", F.col("label") % 2), "embedding", "y", "fold", [0.01, 1.0, 100.0])
    return spark.createDataFrame([(float(c), float(auc))], "c double, roc_auc double")


@query()
def m24_temperature(spark, d):
    rows = t(spark, d, "embeddings").select(F.slice("embedding", 1, 10).alias("z"), "label")
    return spark.createDataFrame([(N.temperature(rows, "z", "label"),)], "temperature double")


@query()
def w13_explained_variance(spark, d):
    """Share of variance by component, and the cumulative share."""
    return N.explained(t(spark, d, "embeddings"), "embedding", 64)
