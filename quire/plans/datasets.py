"""Splits, samples, weights, windows, profiles and checks (W, L, A, D groups)."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window, functions as F

from quire.functions.text import blank_to_null, trimmed
from quire.operators import metrics as M, ordering as O, profile as P, relational as R, sampling as S
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


def _pages(spark, d):
    return t(spark, d, "geniza_image_latents").select("id", trimmed("manuscript_id").alias("m"), "parent_directory", "picture_id", "page_number", "num_words", "num_glyphs", "num_visual_patches", "is_color")


_M = f"{TRIM.format('manuscript_id')} AS m"


@query(f"SELECT m, id FROM (SELECT id, {_M}, row_number() OVER (PARTITION BY {TRIM.format('manuscript_id')} ORDER BY md5(id::VARCHAR || '42'), id) AS k FROM geniza_image_latents) WHERE k <= 3")
def w1_hash_window(spark: SparkSession, d: str):
    w = Window.partitionBy("m").orderBy(*S.hash_order("id"))
    return _pages(spark, d).withColumn("k", F.row_number().over(w)).filter("k <= 3").select("m", "id")


@query("SELECT c_custkey, rank() OVER (ORDER BY c_acctbal DESC) AS by_balance, rank() OVER (ORDER BY c_nationkey DESC) AS by_nation FROM customer")
def w3_ranks(spark, d):
    """Ranks among all customers, from counts of the different values."""
    rows = t(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    for c, name in (("c_acctbal", "by_balance"), ("c_nationkey", "by_nation")):
        per = O.running_total(rows.groupBy(c).agg(F.count(F.lit(1)).alias("n")), [F.desc_nulls_last(c)], "n", "upto")
        rows = rows.join(per.select(F.col(c).alias("_v"), (F.col("upto") - F.col("n") + 1).alias(name)), F.col(c).eqNullSafe(F.col("_v"))).drop("_v")
    return rows.drop("c_acctbal", "c_nationkey")


@query(f"""
WITH r AS (SELECT id, {_M} FROM geniza_image_latents), k AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY m) AS n FROM r)
SELECT id, CASE WHEN i < floor(n * 0.7::DOUBLE) THEN 'train' WHEN i < floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM k""")
def w6_positional_split(spark, d):
    return S.positional_split(_pages(spark, d).select("id", "m"), "m", [F.col("id")], 0.7, 0.15).select("id", "split")


@query(f"""
WITH r AS (SELECT id, {_M} FROM geniza_image_latents), k AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY id) AS i, count(*) OVER (PARTITION BY m) AS n FROM r)
SELECT id, CASE WHEN n = 1 OR i <= greatest(1, least(n - 1, round_even(n * 0.8::DOUBLE, 0))) THEN 'train' ELSE 'val' END AS split FROM k""")
def w7_clamped_split(spark, d):
    return S.clamped_split(_pages(spark, d).select("id", "m"), "m", [F.col("id")], 0.8).select("id", "split")


@query(f"""
SELECT id, row_number() OVER (PARTITION BY m, parent_directory ORDER BY coalesce(TRY_CAST(nullif(regexp_extract(page_number, '([0-9]+)', 1), '') AS INT), 0), picture_id, id) AS page FROM (SELECT *, {_M} FROM (SELECT * EXCLUDE (manuscript_id), manuscript_id FROM geniza_image_latents))""")
def w8_page_order(spark, d):
    w = Window.partitionBy("m", "parent_directory").orderBy(R.page_number(), "picture_id", "id")
    return _pages(spark, d).select("id", F.row_number().over(w).cast("bigint").alias("page"))


@query("""
WITH g AS (SELECT l_suppkey, l_shipdate, l_orderkey, l_linenumber, lead(epoch(l_shipdate)) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) - epoch(l_shipdate) AS gap FROM lineitem)
SELECT l_suppkey, CAST(max(gap) AS BIGINT) AS largest_gap FROM g GROUP BY l_suppkey""")
def w12_largest_gap(spark, d):
    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    s = F.unix_timestamp("l_shipdate")
    return t(spark, d, "lineitem").select("l_suppkey", (F.lead(s).over(w) - s).alias("gap")).groupBy("l_suppkey").agg(F.max("gap").alias("largest_gap"))


@query("""
WITH v AS (SELECT p_brand, sum(p_retailprice) AS s FROM part GROUP BY 1), o AS (SELECT *, sum(s) OVER (ORDER BY s DESC, p_brand ROWS UNBOUNDED PRECEDING) / sum(s) OVER () AS cum, lag(s) OVER (ORDER BY s DESC, p_brand) - s AS gain FROM v)
SELECT p_brand, round(cum, 6) AS cum, round(gain - lag(gain) OVER (ORDER BY s DESC, p_brand), 4) AS second_difference, cum >= 0.8 AS past FROM o""")
def w13_cumulative_share(spark, d):
    v = t(spark, d, "part").groupBy("p_brand").agg(F.sum("p_retailprice").alias("s"))
    w = Window.orderBy(F.desc("s"), "p_brand")
    o = v.withColumns({"cum": F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("s").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "gain": F.lag("s").over(w) - F.col("s")})
    return o.select("p_brand", F.round("cum", 6).alias("cum"), F.round(F.col("gain") - F.lag("gain").over(w), 4).alias("second_difference"), (F.col("cum") >= 0.8).alias("past"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY abs(c_acctbal) DESC, c_custkey) AS place FROM customer")
def w14_absolute_rank(spark, d):
    rows = t(spark, d, "customer").select("c_custkey", F.abs("c_acctbal").alias("_s"), F.lit(1).cast("bigint").alias("_one"))
    return O.running_total(rows, [F.desc_nulls_last("_s"), F.col("c_custkey")], "_one", "place").select("c_custkey", "place")


@query("""
WITH r AS (SELECT l_orderkey AS o, l_returnflag AS g, l_linenumber AS i, l_quantity AS q FROM lineitem), a AS (SELECT *, row_number() OVER (PARTITION BY o, g ORDER BY q DESC, i) AS rd FROM r),
b AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY rd, g) AS n FROM a) SELECT o, i FROM b WHERE n <= 3""")
def w15_round_robin(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_returnflag").alias("g"), F.col("l_linenumber").alias("i"), F.col("l_quantity").alias("q"))
    return S.round_robin(rows, "o", "g", [F.desc("q"), F.col("i")], [F.col("g")], 3).select("o", "i")


@query("""
WITH r AS (SELECT l_suppkey AS s, l_returnflag AS g, l_orderkey AS o, l_linenumber AS i, l_quantity AS q, (l_linestatus <> 'O')::INT AS pool FROM lineitem),
a AS (SELECT *, row_number() OVER (PARTITION BY s, g ORDER BY pool, q DESC, o, i) AS k FROM r), b AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY pool, q DESC, o, i) AS n FROM a WHERE k <= 5) SELECT s, o, i FROM b WHERE n <= 12""")
def w16_class_cap(spark, d):
    """At most five rows of a class, first from the primary pool, then twelve in all."""
    pool = (F.col("l_linestatus") != "O").cast("int")
    rows = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("g"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("i"), F.col("l_quantity").alias("q"), pool.alias("pool"))
    order = ["pool", F.desc("q"), "o", "i"]
    a = rows.withColumn("k", F.row_number().over(Window.partitionBy("s", "g").orderBy(*order))).filter("k <= 5")
    return a.withColumn("n", F.row_number().over(Window.partitionBy("s").orderBy(*order))).filter("n <= 12").select("s", "o", "i")


@query("SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey::VARCHAR || '7'), o_orderkey LIMIT 1")
def l2_random_row(spark, d):
    return t(spark, d, "orders").select("o_orderkey").orderBy(*S.hash_order("o_orderkey", 7)).limit(1)


@query("SELECT c_custkey FROM customer ORDER BY (c_mktsegment = 'NOSUCH') DESC, (c_acctbal > 9000) DESC, c_custkey LIMIT 1")
def l3_pick_or_fallback(spark, d):
    return t(spark, d, "customer").orderBy((F.col("c_mktsegment") == "NOSUCH").desc(), (F.col("c_acctbal") > 9000).desc(), "c_custkey").limit(1).select("c_custkey")


@query(f"""
WITH r AS (SELECT id, {_M} FROM geniza_image_latents), g AS (SELECT m FROM r GROUP BY m ORDER BY md5(m || '42'), m LIMIT 20), k AS (SELECT id, m, row_number() OVER (PARTITION BY m ORDER BY md5(id::VARCHAR || '42'), id) AS k FROM r WHERE m IN (SELECT m FROM g)) SELECT id, m FROM k WHERE k <= 4""")
def l6_group_sample(spark, d):
    return S.first_of_groups(_pages(spark, d).select("id", "m"), "m", "id", 20, 4)


@query(f"""
WITH r AS (SELECT id, {_M}, coalesce(num_words, 0) > 10 AS u FROM geniza_image_latents), k AS (SELECT *, sum(u::INT) OVER (PARTITION BY m ORDER BY md5(id::VARCHAR || '42'), id ROWS UNBOUNDED PRECEDING) AS n FROM r)
SELECT id, CASE WHEN NOT u THEN 'rejected' WHEN n <= 2 THEN 'accepted' ELSE 'reserve' END AS status FROM k""")
def l7_fill_slots(spark, d):
    return S.fill_slots(_pages(spark, d), "m", "id", F.coalesce("num_words", F.lit(0)) > 10, 2).select("id", "status")


@query(f"""
WITH r AS (SELECT id, {_M} FROM geniza_image_latents), k AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY md5(id::VARCHAR || '42'), id) AS i, count(*) OVER (PARTITION BY m) AS n FROM r) SELECT id FROM k WHERE i <= round_even(n * 0.3::DOUBLE, 0)""")
def l8_fraction_sample(spark, d):
    return S.fraction_sample(_pages(spark, d).select("id", "m"), "m", "id", 0.3).select("id")


@query(f"""
WITH r AS (SELECT id, {_M} FROM geniza_image_latents), k AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY md5(id::VARCHAR || '42'), id) AS i, count(*) OVER (PARTITION BY m) AS n FROM r) SELECT id FROM k WHERE i <= ceil(n * 0.1::DOUBLE)""")
def l10_fraction_at_least_one(spark, d):
    return S.fraction_sample(_pages(spark, d).select("id", "m"), "m", "id", 0.1, rounding=F.ceil).select("id")


@query(f"""
WITH g AS (SELECT DISTINCT {_M} FROM geniza_image_latents), k AS (SELECT m, row_number() OVER (ORDER BY md5(m || '42'), m) - 1 AS i, count(*) OVER () AS n FROM g WHERE m IS NOT NULL)
SELECT l.id, CASE WHEN i < floor(n * 0.7::DOUBLE) THEN 'train' WHEN i < floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM geniza_image_latents l JOIN k ON {TRIM.format('l.manuscript_id')} = k.m""")
def l11_disjoint_split(spark, d):
    return S.disjoint_split(_pages(spark, d).select("id", "m"), "m", 0.7, 0.15).select("id", "split")


_OUTER = "o AS (SELECT c_custkey AS id, c_nationkey AS y, CASE WHEN count(*) OVER (PARTITION BY c_nationkey) < 55 THEN 'excluded' WHEN row_number() OVER (PARTITION BY c_nationkey ORDER BY md5(c_custkey::VARCHAR || '42'), c_custkey) <= round_even(count(*) OVER (PARTITION BY c_nationkey) * 0.3::DOUBLE, 0) THEN 'test' ELSE 'train' END AS split FROM customer)"


def _outer(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("y"))
    return S.stratified_outer(c, "id", "y", 0.3, 55)


@query(f"WITH {_OUTER} SELECT id, y, split FROM o")
def l12_stratified_outer(spark, d):
    return _outer(spark, d)


@query(f"WITH {_OUTER} SELECT id, CASE WHEN split = 'train' THEN (row_number() OVER (PARTITION BY split, y ORDER BY md5(id::VARCHAR || '42'), id) - 1) % 5 ELSE -1 END::INT AS fold FROM o")
def l13_folds(spark, d):
    return S.folds(_outer(spark, d), "id", "y", "split").select("id", "fold")


@query()
def l14_pk_batches(spark, d):
    return S.pk_batches(t(spark, d, "customer"), "c_nationkey", "c_custkey", 32, 4, 50)


@query()
def l15_pair_sample(spark, d):
    return S.pair_sample(t(spark, d, "embeddings").select("vec_id", "label"), "vec_id", "label", 100)


@query("""
WITH k AS (SELECT l_orderkey AS o, l_linenumber AS i, l_suppkey AS s, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS rd FROM lineitem)
SELECT o, i FROM k ORDER BY rd, s LIMIT 250""")
def l23_cyclic_pick(spark, d):
    return S.cyclic_pick(t(spark, d, "lineitem"), "l_suppkey", [F.col("l_orderkey"), F.col("l_linenumber")], 250).select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("i"))


@query("WITH k AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) SELECT o_orderkey FROM k WHERE i IN (SELECT floor(j * (n - 1) / 24) FROM range(25) x(j))")
def l22_evenly_spaced(spark, d):
    return S.evenly_spaced(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice"), F.col("o_orderkey")], 25).select("o_orderkey")


@query("SELECT s_suppkey, floor((row_number() OVER (ORDER BY s_suppkey) - 1) * 7 / count(*) OVER ())::INT AS shard FROM supplier")
def l21_shards(spark, d):
    return S.contiguous_shards(t(spark, d, "supplier"), "s_suppkey", 7)


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_acctbal < 0 ORDER BY c_acctbal, c_custkey LIMIT 100")
def l24_worst_rows(spark, d):
    return t(spark, d, "customer").filter("c_acctbal < 0").select("c_custkey", "c_nationkey", "c_acctbal").orderBy("c_acctbal", "c_custkey").limit(100)


@query(f"WITH r AS (SELECT id, {_M} FROM geniza_image_latents), w AS (SELECT id, 1.0::DOUBLE / count(*) OVER (PARTITION BY m) AS w FROM r) SELECT id, round(w / (SELECT avg(w) FROM w), 6) AS weight FROM w")
def m18_page_weights(spark, d):
    return S.page_weights(_pages(spark, d).select("id", "m"), "m").select("id", F.round("weight", 6).alias("weight"))


@query("""
WITH p AS (SELECT c_mktsegment AS y, c_nationkey AS g, count(*) AS n FROM customer GROUP BY 1, 2), w AS (SELECT *, 1.0::DOUBLE / (count(*) OVER (PARTITION BY y) * n) AS w FROM p), m AS (SELECT sum(w * n) / sum(n) AS mean FROM w)
SELECT c_custkey, round(w / mean, 6) AS weight FROM customer JOIN w ON c_mktsegment = y AND c_nationkey = g JOIN m ON true""")
def m19_balanced_weights(spark, d):
    rows = t(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return S.balanced_weights(rows, "c_mktsegment", "c_nationkey").select("c_custkey", F.round("weight", 6).alias("weight"))


_COUNTS = ["num_visual_patches", "num_glyphs", "num_words", "num_letters"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count({c}) AS non_null, count(*) FILTER ({c} = 0) AS zeros, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 2) AS mean, quantile_cont({c}::DOUBLE, 0.5) AS median FROM geniza_image_latents" for c in _COUNTS[:3]))
def a7_profile(spark, d):
    """A profile of those of the wanted columns that exist."""
    return P.profile(t(spark, d, "geniza_image_latents"), _COUNTS)


@query("""
WITH k AS (SELECT DISTINCT image_path FROM image_metadata WHERE image_path IS NOT NULL), h AS (SELECT DISTINCT image_path FROM geniza_image_latents)
SELECT count(*) AS wanted, count(h.image_path) AS found, count(*) - count(h.image_path) AS missing, round(count(h.image_path) / count(*), 6) AS fraction FROM k LEFT JOIN h USING (image_path)""")
def a8_coverage(spark, d):
    return P.coverage(t(spark, d, "geniza_image_latents"), t(spark, d, "image_metadata"), "image_path")


@query(f"SELECT DISTINCT {_M} FROM geniza_image_latents ORDER BY 1")
def a9_distinct(spark, d):
    return _pages(spark, d).select("m").distinct().orderBy("m")


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _letters(spark, d):
    lines = t(spark, d, "alto_text_lines").dropDuplicates(["line_id"])
    c = F.explode(F.split(F.lower(F.coalesce("text", F.array_join("words", " "))), "")).alias("letter")
    return lines.select("line_id", trimmed("manuscript_id").alias("m"), F.when(~F.isnan("confidence"), F.col("confidence")).alias("conf"), c).filter(F.col("letter").between("a", "z"))


_LT = f"""li AS (SELECT line_id, any_value({TRIM.format('manuscript_id')}) AS m, any_value(CASE WHEN NOT isnan(confidence) THEN confidence END) AS conf, any_value(coalesce(text, array_to_string(words, ' '))) AS txt FROM alto_text_lines GROUP BY line_id),
le AS (SELECT line_id, m, conf, unnest(string_split(lower(txt), '')) AS letter FROM li), l AS (SELECT * FROM le WHERE letter BETWEEN 'a' AND 'z' AND length(letter) = 1)"""


@query(f"""
WITH {_LT}, a AS (SELECT chr((96 + i)::INT) AS letter FROM range(1, 27) x(i)), s AS (SELECT letter, count(*) AS n, avg(conf) AS mean, var_pop(conf) AS var FROM l GROUP BY letter)
SELECT letter, coalesce(n, 0) AS n, round(coalesce(mean, 0), 6) AS mean, round(coalesce(var, 0), 6) AS var FROM a LEFT JOIN s USING (letter)""")
def a13_letter_features(spark, d):
    s = _letters(spark, d).groupBy("letter").agg(F.count(F.lit(1)).alias("n"), F.avg("conf").alias("mean"), F.var_pop("conf").alias("var"))
    a = spark.createDataFrame([(x,) for x in _LETTERS], "letter string")
    return a.join(s, "letter", "left").select("letter", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("mean", F.lit(0.0)), 6).alias("mean"), F.round(F.coalesce("var", F.lit(0.0)), 6).alias("var"))


@query(f"""
WITH {_LT}, s AS (SELECT letter, count(*) AS n, count(DISTINCT m) AS pages, quantile_cont(conf, 0.5) AS med, stddev_samp(conf) AS std FROM l GROUP BY letter), o AS (SELECT *, sum(n) OVER () AS t FROM s)
SELECT letter, n, pages, round(n / t, 6) AS share, round(med, 6) AS median, round(std, 6) AS std, rank() OVER (ORDER BY n DESC) AS by_count, rank() OVER (ORDER BY pages DESC) AS by_pages,
round((n / t + 1.96 * 1.96 / (2 * t)) / (1 + 1.96 * 1.96 / t) - 1.96 / (1 + 1.96 * 1.96 / t) * sqrt(n / t * (1 - n / t) / t + 1.96 * 1.96 / (4 * t * t)), 6) AS low FROM o""")
def a14_letter_summary(spark, d):
    s = _letters(spark, d).groupBy("letter").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("m").alias("pages"), F.percentile("conf", 0.5).alias("med"), F.stddev_samp("conf").alias("std"))
    o = s.withColumn("t", F.sum("n").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rank = lambda c: F.rank().over(Window.orderBy(F.desc(c))).cast("bigint")
    return o.select("letter", "n", "pages", F.round(F.col("n") / F.col("t"), 6).alias("share"), F.round("med", 6).alias("median"), F.round("std", 6).alias("std"), rank("n").alias("by_count"), rank("pages").alias("by_pages"), F.round(M.wilson(F.col("n"), F.col("t"))[0], 6).alias("low"))


@query(f"WITH {_LT} SELECT m, count(*) FILTER (letter = 'a') AS a, count(*) FILTER (letter = 'e') AS e, count(*) FILTER (letter = 'i') AS i, count(*) FILTER (letter = 'o') AS o, count(*) FILTER (letter = 'u') AS u FROM l WHERE letter IN ('a', 'e', 'i', 'o', 'u') GROUP BY m")
def a15_pivot(spark, d):
    v = list("aeiou")
    return _letters(spark, d).filter(F.col("letter").isin(v)).groupBy("m").pivot("letter", v).agg(F.count(F.lit(1))).na.fill(0, v)


@query("""
WITH x AS (SELECT label, unnest(range(1, 65)) AS p, embedding FROM embeddings), m AS (SELECT label, p, avg(embedding[p]::DOUBLE) AS v, count(*) AS n FROM x GROUP BY 1, 2)
SELECT label, max(n) AS n, round(sum(v * v), 6) AS norm2, round(sum(v) FILTER (p = 1), 6) AS first FROM m GROUP BY label""")
def a16_mean_pool(spark, d):
    p = P.mean_vector(t(spark, d, "embeddings"), "label", "embedding")
    return p.select("label", "n", F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm2"), F.round(F.col("vec")[0], 6).alias("first"))


@query("""
WITH p AS (SELECT l_suppkey AS s, avg((l_returnflag = 'A')::INT) AS a, avg((l_returnflag = 'N')::INT) AS n, avg((l_returnflag = 'R')::INT) AS r FROM lineitem GROUP BY 1)
SELECT s, list_position([a, n, r], greatest(a, n, r)) - 1 AS guess, round(greatest(a, n, r), 6) AS confidence FROM p""")
def a17_probability_mean(spark, d):
    f = lambda x: F.avg((F.col("l_returnflag") == x).cast("int")).alias(x.lower())
    p = t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s")).agg(f("A"), f("N"), f("R"))
    best = F.greatest("a", "n", "r")
    return p.select("s", (F.array_position(F.array("a", "n", "r"), best) - 1).alias("guess"), F.round(best, 6).alias("confidence"))


@query("""
WITH x AS (SELECT label, unnest(range(1, 65)) AS p, embedding FROM embeddings), m AS (SELECT label, p, avg(embedding[p]::DOUBLE) AS v, stddev_pop(embedding[p]::DOUBLE) AS s FROM x GROUP BY 1, 2)
SELECT label, round(sum(v) / sqrt(sum(v * v) + sum(s * s)), 5) AS mean_part, round(sum(s) / sqrt(sum(v * v) + sum(s * s)), 5) AS std_part FROM m GROUP BY label""")
def a18_mean_std_pool(spark, d):
    from quire.functions.vectors import unit

    p = P.mean_vector(t(spark, d, "embeddings"), "label", "embedding", deviation=True).select("label", unit("vec").alias("v"))
    add = lambda a: F.round(F.aggregate(F.slice("v", a, 64), F.lit(0.0), lambda s, x: s + x), 5)
    return p.select("label", add(1).alias("mean_part"), add(65).alias("std_part"))


@query("""
SELECT l_returnflag AS g, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(coalesce(stddev_samp(l_quantity), 0), 6) AS std, quantile_cont(l_quantity, 0.05) AS p5, quantile_cont(l_quantity, 0.5) AS p50, quantile_cont(l_quantity, 0.95) AS p95 FROM lineitem GROUP BY 1""")
def a34_summary(spark, d):
    s = P.summary(t(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), "l_quantity"), ["g"], "l_quantity")
    return s.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("""
SELECT CASE WHEN num_glyphs IS NULL THEN NULL WHEN num_glyphs <= 0 THEN '0' WHEN num_glyphs <= 10 THEN '1-10' WHEN num_glyphs <= 30 THEN '11-30' ELSE '31+' END AS bucket, count(*) AS n, min(num_glyphs) AS lo, max(num_glyphs) AS hi, quantile_cont(num_glyphs, 0.5) AS med FROM geniza_image_latents GROUP BY 1""")
def a24_glyph_buckets(spark, d):
    b = F.when(F.col("num_glyphs") > 30, "31+").otherwise(P.bucket("num_glyphs", [("0", 0), ("1-10", 10), ("11-30", 30)]))
    return t(spark, d, "geniza_image_latents").groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("num_glyphs").alias("lo"), F.max("num_glyphs").alias("hi"), F.percentile("num_glyphs", 0.5).alias("med"))


@query("SELECT floor(vec_id / 32)::BIGINT AS batch, count(DISTINCT label) AS labels, round(count(DISTINCT label) / count(*), 6) AS share, count(DISTINCT label) = 1 AS homogeneous, count(DISTINCT label) / count(*) < 0.3 AS low FROM embeddings GROUP BY 1")
def a25_batch_diversity(spark, d):
    n = F.countDistinct("label")
    return t(spark, d, "embeddings").groupBy(F.floor(F.col("vec_id") / 32).alias("batch")).agg(n.alias("labels"), F.round(n / F.count(F.lit(1)), 6).alias("share"), (n == 1).alias("homogeneous"), (n / F.count(F.lit(1)) < 0.3).alias("low"))


@query(f"SELECT count(*) AS n, count(*) FILTER (xml_path IS NULL) AS missing, count(*) FILTER ({TRIM.format('xml_path')} = '') AS empty FROM geniza_image_latents")
def a26_missing_xml(spark, d):
    return t(spark, d, "geniza_image_latents").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("xml_path").isNull()).alias("missing"), F.count_if(trimmed("xml_path") == "").alias("empty"))


@query("WITH c AS (SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1) SELECT min(c_mktsegment) AS c_mktsegment, (SELECT max(n) / sum(n) FROM c) AS accuracy FROM c WHERE n = (SELECT max(n) FROM c)")
def a27_majority(spark, d):
    return P.majority(t(spark, d, "customer"), "c_mktsegment")


@query(f"""
SELECT m, count(DISTINCT is_color) + max((is_color IS NULL)::INT) AS kinds FROM (SELECT {_M}, is_color FROM geniza_image_latents) GROUP BY m""")
def a28_distinct_per_group(spark, d):
    return _pages(spark, d).groupBy("m").agg((F.countDistinct("is_color") + F.max(F.col("is_color").isNull().cast("int"))).alias("kinds"))


@query(f"""
WITH c AS (SELECT {TRIM.format('normalized_library')} AS lib, count(*) AS n, count(DISTINCT shelfmark_root) AS v FROM geniza_manuscript_shelfmark WHERE {TRIM.format('normalized_library')} <> '' GROUP BY 1)
SELECT lib, round(greatest(pow(n + 5, 0.5) / v, 1e-8), 6) AS weight FROM c""")
def a29_library_weights(spark, d):
    c = t(spark, d, "geniza_manuscript_shelfmark").select(blank_to_null("normalized_library").alias("lib"), "shelfmark_root").filter("lib IS NOT NULL")
    c = c.groupBy("lib").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("shelfmark_root").alias("v"))
    return c.select("lib", F.round(F.greatest(F.pow(F.col("n") + 5, F.lit(0.5)) / F.col("v"), F.lit(1e-8)), 6).alias("weight"))


@query("""
WITH b AS (SELECT line_id, list_transform(any_value(polygon), lambda p: p.x) AS x, list_transform(any_value(polygon), lambda p: p.y) AS y FROM alto_text_lines WHERE polygon IS NOT NULL GROUP BY line_id)
SELECT line_id, list_min(x) AS x0, list_max(x) AS x1, list_min(y) AS y0, list_max(y) AS y1 FROM b""")
def a30_bounds(spark, d):
    p = t(spark, d, "alto_text_lines").filter("polygon IS NOT NULL").dropDuplicates(["line_id"])
    return p.select("line_id", F.array_min("polygon.x").alias("x0"), F.array_max("polygon.x").alias("x1"), F.array_min("polygon.y").alias("y0"), F.array_max("polygon.y").alias("y1"))


@query("""
SELECT l_returnflag, l_linestatus, round(avg(l_discount), 6) AS mean_self, round(avg((l_linenumber = 1)::INT), 6) AS top1_rate, round(avg(l_tax - l_discount), 6) AS mean_margin FROM lineitem WHERE l_discount > 0 GROUP BY 1, 2""")
def a31_grouped_means(spark, d):
    return t(spark, d, "lineitem").filter("l_discount > 0").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.avg("l_discount"), 6).alias("mean_self"), F.round(F.avg((F.col("l_linenumber") == 1).cast("int")), 6).alias("top1_rate"), F.round(F.avg(F.col("l_tax") - F.col("l_discount")), 6).alias("mean_margin"))


@query(f"""
SELECT 'blank' AS fault, count(*) AS n FROM geniza_image_latents WHERE id IS NULL OR image_path IS NULL OR trim(image_path) = '' OR manuscript_id IS NULL OR trim(manuscript_id) = ''
UNION ALL SELECT 'repeated id', count(*) FROM (SELECT id FROM geniza_image_latents GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT 'repeated path', count(*) FROM (SELECT image_path FROM geniza_image_latents WHERE image_path IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'single member', count(*) FROM (SELECT manuscript_id FROM geniza_image_latents WHERE manuscript_id IS NOT NULL GROUP BY 1 HAVING count(*) = 1)""")
def d2_member_faults(spark, d):
    return P.member_faults(t(spark, d, "geniza_image_latents"), "id", "image_path", "manuscript_id")


@query("SELECT len(latent_vector) AS dim, count(*) AS n FROM geniza_image_latents WHERE latent_vector IS NOT NULL GROUP BY 1")
def d5_vector_dimensions(spark, d):
    return t(spark, d, "geniza_image_latents").filter("latent_vector IS NOT NULL").groupBy(F.size("latent_vector").cast("bigint").alias("dim")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT image_path FROM image_metadata WHERE image_path NOT IN (SELECT image_path FROM geniza_image_latents WHERE latent_vector IS NOT NULL AND image_path IS NOT NULL)")
def d6_missing_latents(spark, d):
    have = t(spark, d, "geniza_image_latents").filter("latent_vector IS NOT NULL")
    return R.without_existing(t(spark, d, "image_metadata"), have, "image_path").select("image_path")
