"""OCR lines as pages: reading order, budgets, geometry and nested XML."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession, Window, functions as F

from quire.operators import layout as Y, sampling as S
from quire.session import table as t
from quire.sources import alto

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _words(spark, d):
    """Words as boxes: an order's line items, placed on a page of 1000 by 1000."""
    l = t(spark, d, "lineitem")
    return l.select(
        F.col("l_orderkey").alias("page"), (F.col("l_linenumber") % 3).cast("int").alias("line"), F.col("l_linenumber").cast("int").alias("word"),
        (F.col("l_partkey") % 997).cast("double").alias("x"), (F.col("l_suppkey") % 89 * 11).cast("double").alias("y"), (1 - F.col("l_discount")).alias("conf"),
    )


_W = "w AS (SELECT l_orderkey AS page, (l_linenumber % 3)::INT AS line, l_linenumber::INT AS word, (l_partkey % 997)::DOUBLE AS x, (l_suppkey % 89 * 11)::DOUBLE AS y, 1 - l_discount AS conf FROM lineitem)"


@query(f"""
WITH {_W}, g AS (SELECT *, CASE WHEN x >= 500 THEN 0 ELSE 1 END AS seg FROM w), l AS (SELECT page, line, row_number() OVER (PARTITION BY page ORDER BY round_even(avg(seg), 0), avg(y), line) - 1 AS line_idx FROM g GROUP BY page, line)
SELECT g.page, g.word, line_idx, row_number() OVER (PARTITION BY g.page, g.line ORDER BY x DESC, word) - 1 AS word_in_line_idx FROM g JOIN l USING (page, line)""")
def w9_word_order(spark: SparkSession, d: str):
    g = _words(spark, d).withColumn("seg", Y.page_segment("x", F.lit(500.0)))
    # equal x are told apart by the word's number
    g = g.withColumn("x", F.col("x") - F.col("word") / 1000)
    o = Y.word_order(g, "page", "line", "x", "y", "seg")
    return o.select("page", "word", F.col("line_idx").cast("bigint").alias("line_idx"), F.col("word_in_line_idx").cast("bigint").alias("word_in_line_idx"))


@query()
def w11_text_rows(spark, d):
    """Rows of text lines whose running mean height moves as lines join."""
    lines = t(spark, d, "alto_text_lines").filter("polygon IS NOT NULL").dropDuplicates(["line_id"])
    lines = lines.select("manuscript_id", "page_number", "line_id", ((F.array_min("polygon.y") + F.array_max("polygon.y")) / 2).cast("double").alias("center_y"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf["row"] = Y.text_rows(pdf, 20.0)
        return pdf[["line_id", "row"]]

    return lines.groupBy("manuscript_id", "page_number").applyInPandas(work, "line_id bigint, row int")


@query("""
WITH RECURSIVE l AS (SELECT line_id, any_value(image_path) AS page, avg(CASE WHEN confidence IS NULL OR isnan(confidence) THEN 0 ELSE confidence END) AS c, coalesce(any_value(words), string_split(any_value(text), ' ')) AS words FROM alto_text_lines GROUP BY line_id),
s AS (SELECT page, line_id, len(words) AS n, row_number() OVER (PARTITION BY page ORDER BY c DESC, line_id) AS k FROM l WHERE len(words) > 0),
r AS (SELECT page, line_id, k, n <= 64 AS taken, CASE WHEN n <= 64 THEN 64 - n ELSE 64 END AS room FROM s WHERE k = 1
      UNION ALL SELECT s.page, s.line_id, s.k, s.n <= r.room, CASE WHEN s.n <= r.room THEN r.room - s.n ELSE r.room END FROM r JOIN s ON s.page = r.page AND s.k = r.k + 1),
t AS (SELECT line_id FROM r WHERE taken UNION ALL SELECT line_id FROM s WHERE k = 1 AND page NOT IN (SELECT page FROM r WHERE taken))
SELECT line_id AS line, i::INT AS place FROM (SELECT line_id, unnest(range(0, least(len(words), 64))) AS i FROM l JOIN t USING (line_id))""")
def l17_line_budget(spark, d):
    """Of each page the whole lines of highest confidence that fit into 64 words."""
    l = t(spark, d, "alto_text_lines").dropDuplicates(["line_id"]).select("image_path", "line_id", F.when(~F.isnan("confidence"), F.col("confidence")).alias("c"), F.coalesce("words", F.split("text", " ")).alias("words"))
    w = l.select("image_path", F.col("line_id").alias("line"), F.coalesce("c", F.lit(0.0)).alias("confidence"), F.posexplode("words").alias("place", "word"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        return S.line_budget(pdf, 64)[["line", "place"]]

    return w.groupBy("image_path").applyInPandas(work, "line bigint, place int")


@query(f"""
WITH {_W}, k AS (SELECT *, row_number() OVER (PARTITION BY page, line ORDER BY word) AS dep FROM w), n AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY dep, line) AS n FROM k WHERE dep <= 2) SELECT page, word FROM n WHERE n <= 5""")
def l18_line_round_robin(spark, d):
    k = _words(spark, d).withColumn("dep", F.row_number().over(Window.partitionBy("page", "line").orderBy("word"))).filter("dep <= 2")
    return S.round_robin(k, "page", "line", [F.col("word")], [F.col("line")], 5).select("page", "word")


@query(f"WITH {_W} SELECT page, word, coalesce(CASE WHEN word % 2 = 0 THEN line::VARCHAR END, 'y_cluster_' || round_even(y / 40, 0)::INT) AS key FROM w")
def x8_line_keys(spark, d):
    w = _words(spark, d).withColumn("line", F.when(F.col("word") % 2 == 0, F.col("line").cast("string")))
    return w.select("page", "word", Y.line_key("line", "y", 1000.0).alias("key"))


@query()
def x10_two_pages(spark, d):
    """Scans that show two pages, by the columns of their lines' centres."""
    l = t(spark, d, "alto_text_lines").filter("polygon IS NOT NULL").dropDuplicates(["line_id"])
    mid = lambda c: ((F.array_min(f"polygon.{c}") + F.array_max(f"polygon.{c}")) / 2).cast("double")
    l = l.select("image_path", mid("x").alias("center_x"), mid("y").alias("center_y"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        split = Y.two_page_split(pdf, 900.0, 1200.0)
        return pd.DataFrame({"image_path": [pdf["image_path"].iloc[0]], "is_two_page": [split is not None], "split_x": [split]})

    return l.groupBy("image_path").applyInPandas(work, "image_path string, is_two_page boolean, split_x double")


@query(f"WITH {_W} SELECT page, word, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN x >= 500 THEN 0 ELSE 1 END, y, x DESC, word) - 1 AS tile_idx FROM w")
def x11_tile_order(spark, d):
    w = _words(spark, d).withColumn("seg", Y.page_segment("x", F.lit(500.0))).withColumn("x", F.col("x") - F.col("word") / 1000)
    return Y.tile_order(w, "page", "seg", "x", "y").select("page", "word", F.col("tile_idx").cast("bigint").alias("tile_idx"))


@query(f"WITH {_W} SELECT page, word, CASE WHEN x >= 500 THEN 0 ELSE 1 END AS rtl, CASE WHEN x >= 500 THEN 1 ELSE 0 END AS ltr FROM w")
def x12_page_segment(spark, d):
    return _words(spark, d).select("page", "word", Y.page_segment("x", F.lit(500.0)).alias("rtl"), Y.page_segment("x", F.lit(500.0), rtl=False).alias("ltr"))


@query("""
WITH g AS (SELECT word, lang, unnest(range(0, length(word)))::INT AS i FROM word_list WHERE length(word) > 0)
SELECT word, lang, i AS index, substr(word, i + 1, 1) AS char, (length(word) - 1 - i)::INT AS from_end, i = 0 OR i = length(word) - 1 AS at_edge, i > 0 AND i < length(word) - 1 AS in_middle FROM g""")
def x14_glyph_context(spark, d):
    return t(spark, d, "word_list").filter(F.length("word") > 0).select("word", "lang", F.inline(Y.glyph_context("word")))


@query("""
WITH k AS (SELECT l_suppkey AS s, (l_partkey % 5)::INT AS c, l_orderkey AS o, l_linenumber AS i, row_number() OVER (PARTITION BY l_suppkey, l_partkey % 5 ORDER BY l_quantity DESC, l_orderkey, l_linenumber) - 1 AS a FROM lineitem)
SELECT s, o, i, c * 4 + a AS slot FROM k WHERE a < 4""")
def x15_slots(spark, d):
    l = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), (F.col("l_partkey") % 5).cast("int").alias("c"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("i"), "l_quantity")
    return Y.slots(l, "s", "c", [F.desc("l_quantity"), F.col("o"), F.col("i")], 4).select("s", "o", "i", F.col("slot").cast("bigint").alias("slot"))


def _pages(spark, d):
    return t(spark, d, "image_metadata").filter("image_width IS NOT NULL AND image_height IS NOT NULL").groupBy("image_path").agg(F.max("image_width").alias("w"), F.max("image_height").alias("h"))


_P = "pg AS (SELECT image_path AS page, max(image_width) AS w, max(image_height) AS h FROM image_metadata WHERE image_width IS NOT NULL AND image_height IS NOT NULL GROUP BY 1)"
_T = "tl AS (SELECT DISTINCT page, least(a * 1024, greatest(h - 1024, 0)) AS top, least(b * 1024, greatest(w - 1024, 0)) AS \"left\" FROM pg, range(0, 12) x(a), range(0, 12) y(b) WHERE (a * 1024 <= greatest(h - 1024, 0) OR a = 11) AND (b * 1024 <= greatest(w - 1024, 0) OR b = 11))"


@query(f"WITH {_P}, {_T} SELECT page, top, \"left\" FROM tl")
def x13_tile_grid(spark, d):
    return Y.tile_grid(_pages(spark, d).withColumnRenamed("image_path", "page"), "page", "w", "h", 1024, 1024).select("page", F.col("top").cast("bigint").alias("top"), F.col("left").cast("bigint").alias("left"))


def _regions(spark, d):
    p = _pages(spark, d).withColumnRenamed("image_path", "page")
    k = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((100, 700), (900, 1800), (1900, 3100))])).alias("k")
    return p.select("page", "w", k).select("page", (F.col("w") / 8).cast("double").alias("left"), F.col("k.a").cast("double").alias("top"), (F.col("w") / 8 * 6).cast("double").alias("right"), F.col("k.b").cast("double").alias("bottom"))


_R = "rg AS (SELECT page, w / 8 AS l, a AS t, w / 8 * 6 AS r, b FROM pg, (VALUES (100.0::DOUBLE, 700.0::DOUBLE), (900.0, 1800.0), (1900.0, 3100.0)) v(a, b))"


@query(f"""
WITH {_P}, {_T}, {_R}, o AS (SELECT tl.page, top, "left", sum(greatest(least("left" + 1024, r) - greatest("left", l), 0) * greatest(least(top + 1024, b) - greatest(top, t), 0)) AS a FROM tl JOIN rg USING (page) GROUP BY 1, 2, 3)
SELECT page, top, "left", round(least(a / 1048576.0::DOUBLE, 1.0), 6) AS share FROM o""")
def j20_overlap(spark, d):
    """Share of each tile that lies in the text regions of its page."""
    out = Y.overlap_share(x13_tile_grid(spark, d), _regions(spark, d), "page", 1024)
    return out.withColumn("share", F.round("share", 6))


@query(f"""
WITH {_P}, {_T}, {_R} SELECT tl.page, top, "left", round(min(pow(("left" + 512 - (l + r) / 2) / w, 2) + pow((top + 512 - (t + b) / 2) / h, 2)), 6) AS distance FROM tl JOIN rg USING (page) JOIN pg USING (page) GROUP BY 1, 2, 3""")
def j21_nearest_region(spark, d):
    tiles = x13_tile_grid(spark, d).join(_pages(spark, d).withColumnRenamed("image_path", "page"), "page")
    return Y.nearest_region(tiles, _regions(spark, d), "page", 1024, "w", "h").withColumn("distance", F.round("distance", 6))


@query()
def l19_choose_tiles(spark, d):
    """Four tiles per page, nearest to its text, that do not overlap."""
    tiles = x13_tile_grid(spark, d).join(_pages(spark, d).withColumnRenamed("image_path", "page"), "page")
    near = Y.nearest_region(tiles, _regions(spark, d), "page", 1024, "w", "h")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        return Y.choose_tiles(pdf, 1024, 1024, 4)[["page", "top", "left"]]

    return near.groupBy("page").applyInPandas(work, "page string, top bigint, left bigint")


@query("""
SELECT id, CASE rotation_angle WHEN 90 THEN image_height - 10 WHEN 270 THEN 20 WHEN 180 THEN image_width - 10 ELSE 10 END AS x, CASE rotation_angle WHEN 90 THEN 10 WHEN 270 THEN image_width - 10 WHEN 180 THEN image_height - 20 ELSE 20 END AS y FROM image_metadata""".replace("WHEN 90 THEN image_height - 10", "WHEN 90 THEN image_height - 20"))
def v19_rotate_point(spark, d):
    x, y = Y.rotate_point(F.lit(10), F.lit(20), F.col("rotation_angle"), F.col("image_width"), F.col("image_height"))
    return t(spark, d, "image_metadata").select("id", x.alias("x"), y.alias("y"))


@query("""
WITH l AS (SELECT any_value(image_path) AS image_path, list_max(list_transform(any_value(polygon), lambda p: p.x)) - list_min(list_transform(any_value(polygon), lambda p: p.x)) AS w,
list_max(list_transform(any_value(polygon), lambda p: p.y)) - list_min(list_transform(any_value(polygon), lambda p: p.y)) AS h FROM alto_text_lines WHERE polygon IS NOT NULL GROUP BY line_id)
SELECT image_path, CASE WHEN count(*) FILTER (w > 0 AND h > 0) >= 3 AND count(*) FILTER (w > 0 AND h > 0 AND w / h < 0.8) > 0.6 * count(*) FILTER (w > 0 AND h > 0) THEN 270 ELSE 0 END::INT AS angle FROM l GROUP BY image_path""")
def v20_rotation_vote(spark, d):
    """Rotation of each page by the boxes of its lines."""
    l = t(spark, d, "alto_text_lines").filter("polygon IS NOT NULL").dropDuplicates(["line_id"])
    x0, x1, y0, y1 = F.array_min("polygon.x"), F.array_max("polygon.x"), F.array_min("polygon.y"), F.array_max("polygon.y")
    none = F.lit(None).cast("double")
    l = l.select("image_path", (x1 - x0).cast("double").alias("width"), (y1 - y0).cast("double").alias("height"), ((x0 + x1) / 2).cast("double").alias("center_x"), ((y0 + y1) / 2).cast("double").alias("center_y"), *[none.alias(c) for c in ("x1", "y1", "x2", "y2")])

    return Y.rotation_votes(l, "image_path", 900.0, 1200.0)


def _xml(spark, d):
    """The OCR lines written as one XML document per page: a round trip through the nested source."""
    l = t(spark, d, "alto_text_lines").dropDuplicates(["line_id"]).select("image_path", "line_id", "line_idx", F.coalesce("words", F.split("text", " ")).alias("words"))
    clean = lambda x: F.regexp_replace(x, "[^\\p{L}\\p{N}]", "")
    word = lambda w: F.concat(F.lit('<String CONTENT="'), clean(w), F.lit('" WC="0.97" HPOS="1" VPOS="2" WIDTH="3" HEIGHT="4"><Glyph CONTENT="'), F.substring(clean(w), 1, 1), F.lit('" GC="0.95" HPOS="0" VPOS="0" WIDTH="10" HEIGHT="20"/></String>'))
    line = F.concat(F.lit('<TextLine ID="'), F.col("line_id").cast("string"), F.lit('" HPOS="10" VPOS="20" WIDTH="300" HEIGHT="30">'), F.array_join(F.transform("words", word), ""), F.lit("</TextLine>"))
    page = l.select("image_path", "line_idx", "line_id", line.alias("x")).groupBy("image_path").agg(F.array_sort(F.collect_list(F.struct("line_idx", "line_id", "x"))).alias("a"))
    body = F.array_join(F.transform("a", lambda s: s["x"]), "")
    return page.select(F.col("image_path").alias("path"), F.concat(F.lit('<alto><Layout><Page WIDTH="1000" HEIGHT="1000"><PrintSpace>'), body, F.lit("</PrintSpace></Page></Layout></alto>")).alias("xml"))


_AL = """al AS (SELECT line_id, any_value(image_path) AS path, any_value(line_idx) AS i, coalesce(any_value(words), string_split(any_value(text), ' ')) AS words FROM alto_text_lines GROUP BY line_id),
aw AS (SELECT path, line_id, unnest(list_transform(words, lambda w: regexp_replace(w, '[^\\p{L}\\p{N}]', '', 'g'))) AS word FROM al)"""


@query(f"WITH {_AL} SELECT line_id::VARCHAR AS line_id, count(*) AS words, count(*) FILTER (word <> '') AS letters FROM aw GROUP BY line_id")
def s12_xml_strings(spark, d):
    s = alto.strings(alto.lines(_xml(spark, d)))
    return s.groupBy("line_id").agg(F.count(F.lit(1)).alias("words"), F.count_if(F.size(F.filter("glyphs", lambda g: g["char"] != "")) > 0).alias("letters"))


@query(f"WITH {_AL} SELECT path, line_id::VARCHAR AS line_id, 300.0::DOUBLE AS width FROM al")
def s13_xml_line_boxes(spark, d):
    return alto.line_boxes(alto.lines(_xml(spark, d))).select("path", "line_id", "width")


@query(f"WITH {_AL} SELECT path, count(*) AS glyphs FROM aw GROUP BY path")
def s14_xml_glyphs(spark, d):
    g = alto.good_glyphs(alto.strings(alto.lines(_xml(spark, d))), 0.92)
    return g.groupBy("path").agg(F.count(F.lit(1)).alias("glyphs"))


@query(f"""
WITH {_AL}, lw AS (SELECT path, line_id, i, array_to_string(list_transform(words, lambda w: regexp_replace(w, '[^\\p{{L}}\\p{{N}}]', '', 'g')), ' ') AS t FROM al)
SELECT path, 10.0::DOUBLE AS left, 20.0::DOUBLE AS top, 310.0::DOUBLE AS right, 50.0::DOUBLE AS bottom, string_agg(t, chr(10) ORDER BY i, line_id) AS text FROM lw WHERE t <> '' GROUP BY path""")
def s15_xml_page_text(spark, d):
    return alto.page_text(alto.lines(_xml(spark, d)))
