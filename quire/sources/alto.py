"""ALTO OCR files: nested Page / TextLine / String / Glyph as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_BOX = "_HPOS: double, _VPOS: double, _WIDTH: double, _HEIGHT: double"
_SHAPE = "Shape: struct<Polygon: struct<_POINTS: string>>"
_GLYPH = f"struct<_CONTENT: string, _GC: double, {_BOX}, {_SHAPE}>"
_STRING = f"struct<_CONTENT: string, _WC: double, {_BOX}, {_SHAPE}, Glyph: array<{_GLYPH}>>"
_LINE = f"struct<_ID: string, _BASELINE: string, {_BOX}, {_SHAPE}, String: array<{_STRING}>>"
_BLOCK = f"struct<TextLine: array<{_LINE}>>"
SCHEMA = f"Layout struct<Page: array<struct<_WIDTH: double, _HEIGHT: double, PrintSpace: struct<TextBlock: array<{_BLOCK}>, TextLine: array<{_LINE}>>>>>"


def read(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, xml) of whole files, found recursively; unreadable documents give no lines later."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").load(paths)
    return files.select("path", F.decode("content", "UTF-8").alias("xml"))


def lines(files: DataFrame) -> DataFrame:
    """(path, page_width, page_height, line_no, line): every TextLine, in a block or not, of every page."""
    plain = F.regexp_replace("xml", r"(</?)\w+:", "$1")
    doc = files.select("path", F.from_xml(plain, SCHEMA, {"mode": "PERMISSIVE"}).alias("d"))
    page = doc.select("path", F.explode("d.Layout.Page").alias("p"))
    blocks = F.coalesce(F.flatten(F.transform(F.coalesce("p.PrintSpace.TextBlock", F.array().cast(f"array<{_BLOCK}>")), lambda b: F.coalesce(b["TextLine"], F.array().cast(f"array<{_LINE}>")))), F.array().cast(f"array<{_LINE}>"))
    every = F.concat(blocks, F.coalesce("p.PrintSpace.TextLine", F.array().cast(f"array<{_LINE}>")))
    return page.select("path", F.col("p._WIDTH").alias("page_width"), F.col("p._HEIGHT").alias("page_height"), F.posexplode(every).alias("line_no", "line"))


def points(text: Column) -> Column:
    """'x,y x,y' or 'x y x y' as an array of (x, y)."""
    n = F.filter(F.split(F.trim(text), r"[\s,]+"), lambda x: x != "")
    return F.when(text.isNotNull(), F.transform(F.sequence(F.lit(1), F.greatest(F.floor(F.size(n) / 2), F.lit(1)).cast("int")), lambda i: F.struct(F.get(n, 2 * i - 2).cast("double").alias("x"), F.get(n, 2 * i - 1).cast("double").alias("y"))))


def strings(found: DataFrame) -> DataFrame:
    """One row per String that has glyphs: word, confidence, box, its line's id and polygon, and the glyphs."""
    s = found.select("path", "line_no", F.col("line._ID").alias("line_id"), points(F.col("line.Shape.Polygon._POINTS")).alias("line_polygon"), F.posexplode("line.String").alias("string_no", "s"))
    s = s.filter(F.size("s.Glyph") > 0)
    glyph = F.transform("s.Glyph", lambda g: F.struct(g["_CONTENT"].alias("char"), g["_GC"].alias("gc"), g["_HPOS"].alias("hpos"), g["_VPOS"].alias("vpos"), g["_WIDTH"].alias("width"), g["_HEIGHT"].alias("height")))
    return s.select("path", "line_no", "line_id", "line_polygon", "string_no", F.col("s._CONTENT").alias("word"), F.col("s._WC").alias("wc"), F.col("s._HPOS").alias("hpos"), F.col("s._VPOS").alias("vpos"), F.col("s._WIDTH").alias("width"), F.col("s._HEIGHT").alias("height"), glyph.alias("glyphs"))


def line_boxes(found: DataFrame) -> DataFrame:
    """Lines with a box of positive size, and the first and last point of their baseline."""
    b = points(F.col("line._BASELINE"))
    rows = found.select("path", "page_width", "page_height", "line_no", F.col("line._ID").alias("line_id"), F.col("line._HPOS").alias("hpos"), F.col("line._VPOS").alias("vpos"), F.col("line._WIDTH").alias("width"), F.col("line._HEIGHT").alias("height"), F.get(b, F.lit(0)).alias("base_first"), F.try_element_at(b, F.lit(-1)).alias("base_last"))
    return rows.filter("hpos IS NOT NULL AND vpos IS NOT NULL AND width > 0 AND height > 0")


def good_glyphs(words: DataFrame, least: float, aspect: float = 4.0) -> DataFrame:
    """Glyphs with gc >= least whose word, if it has a confidence, has as much; too oblong ones are left out if their size is known."""
    g = words.filter(F.col("wc").isNull() | (F.col("wc") >= least)).select("path", "line_id", "word", F.explode("glyphs").alias("g")).select("path", "line_id", "word", "g.*")
    ratio = F.greatest(F.col("width") / F.col("height"), F.col("height") / F.col("width"))
    known = (F.col("width") > 0) & (F.col("height") > 0)
    return g.filter((F.col("gc") >= least) & (~F.coalesce(known, F.lit(False)) | (ratio <= aspect)))


def page_text(found: DataFrame) -> DataFrame:
    """(path, left, top, right, bottom, text): union of the line boxes and all words in order; pages without text are left out."""
    box = line_boxes(found).groupBy("path").agg(F.min("hpos").alias("left"), F.min("vpos").alias("top"), F.max(F.col("hpos") + F.col("width")).alias("right"), F.max(F.col("vpos") + F.col("height")).alias("bottom"))
    words = found.select("path", "line_no", F.array_join(F.transform("line.String", lambda s: s["_CONTENT"]), " ").alias("t")).filter("t <> ''")
    text = words.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "t"))), lambda x: x["t"]), "\n").alias("text"))
    return box.join(text, "path")


def line_text(found: DataFrame, least_length: int = 1) -> DataFrame:
    """(path, line_id, text, confidence): words of a line joined, and their mean confidence."""
    w = F.col("line.String")
    conf = F.filter(F.transform(w, lambda s: s["_WC"]), lambda x: x.isNotNull())
    mean = F.when(F.size(conf) > 0, F.aggregate(conf, F.lit(0.0), lambda a, x: a + x) / F.size(conf))
    out = found.select("path", F.col("line._ID").alias("line_id"), F.trim(F.array_join(F.transform(w, lambda s: s["_CONTENT"]), " ")).alias("text"), mean.alias("confidence"))
    return out.filter(F.length("text") >= least_length)
