"""Reading order and page geometry."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def page_segment(x: str, split: str | Column, rtl: bool = True) -> Column:
    """0 for the half read first, 1 for the other; 0 without a split."""
    right = F.col(x) >= (F.col(split) if isinstance(split, str) else split)
    return F.coalesce(F.when(right, 0 if rtl else 1).otherwise(1 if rtl else 0), F.lit(0))


def word_order(rows: DataFrame, page: str, line: str, x: str, y: str, segment: str, rtl: bool = True) -> DataFrame:
    """Rows with line_idx (lines of a page by rounded mean segment, mean y) and word_in_line_idx (by x), both from 0."""
    per = rows.groupBy(page, line).agg(F.bround(F.avg(segment)).alias("_s"), F.avg(y).alias("_y"))
    per = per.withColumn("line_idx", F.row_number().over(Window.partitionBy(page).orderBy("_s", "_y", line)) - 1).drop("_s", "_y")
    w = Window.partitionBy(page, line).orderBy(F.desc(x) if rtl else F.asc(x))
    return rows.join(per, [page, line]).withColumn("word_in_line_idx", F.row_number().over(w) - 1)


def line_key(line: str, y: str, height: float | None = None) -> Column:
    """The line's own id, else a cluster of its height: twentieths of the page, or 40 pixels."""
    at = F.col(y) * 20 if height is None else F.col(y) / 40
    return F.coalesce(F.col(line).cast("string"), F.concat(F.lit("y_cluster_"), F.bround(at).cast("int").cast("string")))


def tile_order(rows: DataFrame, page: str, segment: str, x: str, y: str) -> DataFrame:
    w = Window.partitionBy(page).orderBy(segment, y, F.desc(x))
    return rows.withColumn("tile_idx", F.row_number().over(w) - 1)


def glyph_context(chars: str) -> Column:
    """One struct per letter of a word: char, index, from_end, at_edge, in_middle."""
    c = F.split(F.col(chars), "")
    n = F.size(c)
    return F.transform(c, lambda x, i: F.struct(x.alias("char"), i.alias("index"), (n - 1 - i).alias("from_end"), ((i == 0) | (i == n - 1)).alias("at_edge"), ((i > 0) & (i < n - 1)).alias("in_middle")))


def slots(rows: DataFrame, owner: str, class_index: str, order: list[Column], per_class: int) -> DataFrame:
    """Rows with slot = class * per_class + place in the class; rows beyond per_class are dropped by definition of the slots."""
    at = F.row_number().over(Window.partitionBy(owner, class_index).orderBy(*order)) - 1
    return rows.withColumn("_at", at).filter(F.col("_at") < per_class).withColumn("slot", F.col(class_index) * per_class + F.col("_at")).drop("_at")


def rotate_point(x: Column, y: Column, angle: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """The point after the page is turned by 90 (counter-clockwise), 180 or 270 degrees."""
    rx = F.when(angle == 90, height - y).when(angle == 270, y).when(angle == 180, width - x).otherwise(x)
    ry = F.when(angle == 90, x).when(angle == 270, width - x).when(angle == 180, height - y).otherwise(y)
    return rx, ry


def text_rows(lines: pd.DataFrame, tolerance: float) -> np.ndarray:
    """Row number of each line of a page by center_y: a line joins the row whose running mean is within tolerance."""
    order = np.argsort(lines["center_y"].to_numpy(), kind="stable")
    y = lines["center_y"].to_numpy()[order]
    out, row, total, n = np.empty(len(y), dtype=np.int64), 0, 0.0, 0
    for i, v in enumerate(y):
        if n and abs(v - total / n) > tolerance:
            row, total, n = row + 1, 0.0, 0
        out[order[i]] = row
        total, n = total + v, n + 1
    return out


def two_page_split(lines: pd.DataFrame, width: float, height: float) -> float | None:
    """The x at which a scan of two pages divides, or None. lines: center_x, center_y.

    Rows with a gap of over 15 % of the width vote for the middle of their largest gap; votes within 5 % of a
    cluster's mean join it. The largest cluster needs two votes and 30 % of the rows, and text over more than 15 % of
    the height on both sides of its mean, which must lie over 10 % of the width from either edge.
    """
    if len(lines) < 2:
        return None
    lines = lines.assign(row=text_rows(lines, height * 0.02))
    votes = []
    for _, row in lines.groupby("row"):
        x = np.sort(row["center_x"].to_numpy())
        gaps = np.diff(x)
        if len(gaps) and gaps.max() > width * 0.15:
            at = int(gaps.argmax())
            votes.append((x[at] + x[at + 1]) / 2)
    clusters: list[list[float]] = []
    for v in votes:
        near = next((c for c in clusters if abs(v - sum(c) / len(c)) <= width * 0.05), None)
        if near is None:
            clusters.append([v])
        else:
            near.append(v)
    best = max(clusters, key=len, default=[])
    if lines["row"].nunique() < 2 or len(best) < max(2, int(lines["row"].nunique() * 0.3)):
        return None
    split = sum(best) / len(best)
    sides = [lines[lines["center_x"] < split]["center_y"], lines[lines["center_x"] >= split]["center_y"]]
    spread = all(len(s) >= 2 and s.max() - s.min() > height * 0.15 for s in sides)
    return float(split) if spread and width * 0.1 < split < width * 0.9 else None


def rotation_votes(lines: DataFrame, page: str, width: float, height: float) -> DataFrame:
    """(page, angle): degrees by which each page must be turned, from counts over its lines.

    lines: page, width, height, center_x, center_y and a baseline x1, y1, x2, y2 (null or NaN where unknown). With three
    baselines and more their direction decides if over 60 % lie within 30 degrees of one axis: across it, a page is upside down if
    over 70 % of the wide ones (30 % of the page) run backwards; along it, the commoner sense tells. Else the boxes decide in the
    same way, tall ones and flat ones by the side of the page they lie on. Fewer than three lines, or a page without extent: 0.
    """
    col, share = F.col, lambda a, n: a / F.greatest(n, F.lit(1))
    dx, dy = col("x2") - col("x1"), col("y2") - col("y1")
    turn = F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(360.0))
    known = F.coalesce(~F.isnan(turn), F.lit(False))
    toward = lambda a: F.count_if(known & (F.least(F.pmod(turn - a, F.lit(360.0)), F.pmod(a - turn, F.lit(360.0))) < 30))
    box, ratio = (col("width") > 0) & (col("height") > 0), col("width") / col("height")
    wide = known & (col("width") >= width * 0.3)
    c = lines.groupBy(page).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(known).alias("bases"), *[toward(a).alias(f"to{a}") for a in (0, 90, 180, 270)],
        F.count_if(wide & (dx < 0)).alias("back"), F.count_if(wide & (dx > 0)).alias("ahead"), F.count_if(box).alias("boxes"),
        F.count_if(box & (ratio < 0.8)).alias("tall"), F.count_if(box & (ratio > 1.2)).alias("flat"), F.avg("center_x").alias("cx"), F.avg("center_y").alias("cy"),
    )
    shape = width / height if height > 0 else 0.0
    by_base = col("bases") >= 3
    level, upright = by_base & (share(col("to0") + col("to180"), col("bases")) > 0.6), by_base & (share(col("to90") + col("to270"), col("bases")) > 0.6)
    reversed_ = (col("back") + col("ahead") >= 3) & (share(col("back"), col("back") + col("ahead")) > 0.7)
    tall, flat = share(col("tall"), col("boxes")) > 0.6, share(col("flat"), col("boxes")) > 0.6
    left = F.lit(shape <= 1.2) & (F.lit(shape < 0.8) | (col("cx") > width * 0.6))
    angle = (
        F.when((col("n") < 3) | F.lit(width <= 0 or height <= 0), 0)
        .when(level, F.when(reversed_, 180).otherwise(0)).when(upright, F.when(col("to90") > col("to270"), 270).otherwise(90))
        .when(col("boxes") < 3, 0).when(tall, F.when(left, 270).otherwise(90))
        .when(flat & (col("cy") > height * 0.6) & F.lit(shape < 0.7), 180).otherwise(0)
    )
    return c.select(page, angle.cast("int").alias("angle"))


def overlap_share(tiles: DataFrame, regions: DataFrame, page: str, size: int) -> DataFrame:
    """(page, top, left, share): share of a tile that lies in text regions (left, top, right, bottom), at most 1.

    Regions of the same page only; both sides are divided into cells of the tile size, so that a tile meets only the
    regions near it.
    """
    cell = lambda c: F.floor(F.col(c) / size).cast("int")
    t = tiles.select(page, "top", "left").withColumns({"_cx": F.explode(F.array(cell("left"), cell("left") + 1))}).withColumn("_cy", F.explode(F.array(cell("top"), cell("top") + 1)))
    r = regions.select(page, F.col("left").alias("rl"), F.col("top").alias("rt"), F.col("right").alias("rr"), F.col("bottom").alias("rb"))
    r = r.withColumn("_cx", F.explode(F.sequence(cell("rl"), cell("rr")))).withColumn("_cy", F.explode(F.sequence(cell("rt"), cell("rb"))))
    near = t.join(r, [page, "_cx", "_cy"]).select(page, "top", "left", "rl", "rt", "rr", "rb").distinct()
    w = F.least(F.col("left") + size, "rr") - F.greatest("left", "rl")
    h = F.least(F.col("top") + size, "rb") - F.greatest("top", "rt")
    area = near.filter((w > 0) & (h > 0)).groupBy(page, "top", "left").agg(F.sum(w * h).alias("a"))
    share = F.least(F.coalesce(F.col("a"), F.lit(0.0)) / (size * size), F.lit(1.0))
    return tiles.select(page, "top", "left").join(area, [page, "top", "left"], "left").select(page, "top", "left", share.alias("share"))


def tile_grid(pages: DataFrame, page: str, width: str, height: str, size: int, stride: int) -> DataFrame:
    """(page, top, left): tiles of size at every stride, and at the far edge."""
    steps = lambda c: F.array_union(F.sequence(F.lit(0), F.greatest(F.col(c) - size, F.lit(0)), F.lit(stride)), F.array(F.greatest(F.col(c) - size, F.lit(0))))
    return pages.select(page, F.explode(steps(height)).alias("top"), width).select(page, "top", F.explode(steps(width)).alias("left"))


def nearest_region(tiles: DataFrame, regions: DataFrame, page: str, size: int, width: str, height: str) -> DataFrame:
    """(page, top, left, distance): least squared distance of a tile's centre to a region's, in shares of the page."""
    r = regions.select(page, ((F.col("left") + F.col("right")) / 2).alias("_x"), ((F.col("top") + F.col("bottom")) / 2).alias("_y"))
    per = r.groupBy(page).agg(F.collect_list(F.struct("_x", "_y")).alias("_r"))
    dx = lambda p: (F.col("left") + size / 2 - p["_x"]) / F.col(width)
    dy = lambda p: (F.col("top") + size / 2 - p["_y"]) / F.col(height)
    return tiles.join(per, page).select(page, "top", "left", F.array_min(F.transform("_r", lambda p: dx(p) * dx(p) + dy(p) * dy(p))).alias("distance"))


def choose_tiles(tiles: pd.DataFrame, size: int, stride: int, most: int, overlap: float = 0.1, relaxed: tuple[float, ...] = (0.25, 0.5)) -> pd.DataFrame:
    """Of a page's tiles (top, left, distance) up to `most`, nearest first, that do not overlap; then with relaxed limits.

    For applyInPandas per page. A tile is taken if its centre is far enough from all taken and it shares no more than
    the limit of its area with any; what is still free is filled in order.
    """
    tiles = tiles.sort_values(["distance", "top", "left"], kind="stable", ignore_index=True)
    top, left = tiles["top"].to_numpy(float), tiles["left"].to_numpy(float)
    taken: list[int] = []
    free = list(range(len(tiles)))
    rules = [(max(stride * 0.8, size * 0.5), overlap)] + [(max(stride * 0.5, size * 0.3), r) for r in relaxed]
    for n, (apart, limit) in enumerate(rules):
        held = np.array(taken, dtype=int)
        for i in list(free):
            if len(taken) >= most:
                break
            against = np.array(taken, dtype=int) if n == 0 else held
            dy, dx = np.abs(top[against] - top[i]), np.abs(left[against] - left[i])
            shared = np.clip(size - dy, 0, None) * np.clip(size - dx, 0, None) / (size * size)
            if not ((np.hypot(dx, dy) < apart) | (shared > limit)).any():
                taken.append(i)
                free.remove(i)
    taken += free[: max(0, most - len(taken))]
    return tiles.iloc[taken]
