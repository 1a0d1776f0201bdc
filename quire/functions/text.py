"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: str | Column) -> Column:
    """Without white space (blanks, tabs, line ends) at either end; null stays null."""
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


def blank_to_null(c: str | Column) -> Column:
    """Trimmed; null, empty and blank all become null."""
    return F.nullif(trimmed(c), F.lit(""))


def normal_path(c: str | Column) -> Column:
    """Path in normal form: no '.', '..' or repeated '/'; a leading '/' stays. Null stays null, '' becomes '.'."""
    c = trimmed(c)
    parts = F.aggregate(
        F.split(c, "/"),
        F.array().cast("array<string>"),
        lambda done, x: F.when(x.isin("", "."), done)
        .when((x == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .when((x == "..") & c.startswith("/"), done)
        .otherwise(F.concat(done, F.array(x))),
    )
    joined = F.array_join(parts, "/")
    return F.when(c.startswith("/"), F.concat(F.lit("/"), joined)).when(joined == "", F.lit(".")).otherwise(joined)
