"""Files and databases as sources and sinks."""

from __future__ import annotations

import configparser
import json
import os

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quire.functions.text import blank_to_null
from quire.operators.profile import require_columns


def jdbc_options(ini: str, section: str = "postgresql", fallback: str = "database") -> dict[str, str]:
    """Options for spark.read.format('jdbc') from an INI file's section."""
    parser = configparser.ConfigParser()
    if not parser.read(ini):
        raise FileNotFoundError(ini)
    name = section if parser.has_section(section) else fallback
    c = dict(parser[name])
    return {"url": f"jdbc:postgresql://{c.get('host', 'localhost')}:{c.get('port', '5432')}/{c.get('database') or c.get('dbname')}", "user": c.get("user", ""), "password": c.get("password", "")}


def read_jdbc(spark: SparkSession, ini: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 16) -> DataFrame:
    """A database table; with a numeric key and its bounds it is read in as many ranges at once."""
    reader = spark.read.format("jdbc").options(**jdbc_options(ini)).option("dbtable", table).option("fetchsize", "10000")
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
    return reader.load()


def read_csv(spark: SparkSession, path: str, required: list[str], schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"')
    return require_columns((reader.schema(schema) if schema else reader).csv(path), required)


def read_sheet(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """An XLSX sheet by pandas (where openpyxl is installed), else a CSV file."""
    if path.lower().endswith((".xlsx", ".xls")):
        import pandas as pd

        return require_columns(spark.createDataFrame(pd.read_excel(path, dtype=str)), required)
    return read_csv(spark, path, required)


def members(rows: DataFrame, base: str) -> DataFrame:
    """(image_path, xml_path, cluster_id) of a member table in either layout: paths given, or relative_path below base."""
    if {"image_path", "cluster_id"} <= set(rows.columns):
        xml = F.col("xml_path") if "xml_path" in rows.columns else F.lit(None).cast("string")
        return rows.select("image_path", xml.alias("xml_path"), "cluster_id")
    require_columns(rows, ["relative_path", "cluster_id"])
    p = F.regexp_replace(F.regexp_replace("relative_path", "^" + base.rstrip("/") + "/", ""), "^/+", "")
    parts = F.split(p, "/")
    path = F.concat(F.lit(base.rstrip("/") + "/"), p)
    return rows.filter(F.size(parts) >= 3).select(path.alias("image_path"), F.regexp_replace(path, r"\.[^./]*$", ".xml").alias("xml_path"), "cluster_id")


def id_list(spark: SparkSession, path: str, column: str | None = None, more: list[str] | None = None) -> DataFrame:
    """(id): trimmed, different, sorted ids of a text file's lines or a CSV column, with more ids added."""
    rows = spark.read.option("header", "true").csv(path).select(F.col(column).alias("id")) if column else spark.read.text(path).select(F.col("value").alias("id"))
    if more:
        rows = rows.unionByName(spark.createDataFrame([(x,) for x in more], "id string"))
    return rows.select(blank_to_null("id").alias("id")).filter("id IS NOT NULL").distinct().orderBy("id")


def listing(spark: SparkSession, paths: str | list[str], pattern: str = "*") -> DataFrame:
    """(path, length) of the files in folders, recursively."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(paths).select("path", "length")


def resolve_xml(rows: DataFrame, found: DataFrame, image: str = "image_path", folders: tuple[str, ...] = ("alto", "page")) -> DataFrame:
    """rows with xml_path: the first that exists of the image's own path, its stem in each folder beside, its folder's names.

    found: column path of existing files.
    """
    stem = F.regexp_replace(image, r"\.[^./]*$", "")
    parent, name = F.regexp_extract(image, r"^(.*)/[^/]*$", 1), F.regexp_extract(stem, r"([^/]*)$", 1)
    tried = F.array(F.concat(stem, F.lit(".xml")), *[F.concat_ws("/", parent, F.lit(f), F.concat(name, F.lit(".xml"))) for f in folders], F.concat(F.col(image), F.lit(".xml")))
    c = rows.select(image, F.posexplode(tried).alias("i", "path")).join(found.select(F.regexp_replace("path", "^file:/+", "/").alias("path")), "path", "left_semi")
    return rows.join(c.groupBy(image).agg(F.min_by("path", "i").alias("xml_path")), image, "left")


def load_arrays(spark: SparkSession, path: str, expected: list | None = None) -> DataFrame:
    """(position, id, vec) of an NPZ file with ids and matrix; expected ids must be met in order."""
    with np.load(path, allow_pickle=False) as z:
        ids, matrix = z["ids"].tolist(), z["matrix"]
    if expected is not None and ids != list(expected)[: len(ids)]:
        raise ValueError("ids differ from the expected ones")
    return spark.createDataFrame([(i, str(k), [float(v) for v in row]) for i, (k, row) in enumerate(zip(ids, matrix))], "position int, id string, vec array<double>")


def save_arrays(rows: DataFrame, path: str, most: int = 1_000_000) -> None:
    """ids and matrix of (id, vec) as one NPZ file on the driver; for tables known to be small, else write parquet."""
    if rows.count() > most:
        raise ValueError("too many rows for one file; write parquet")
    data = rows.orderBy("id").collect()
    np.savez(path, ids=np.array([str(r["id"]) for r in data]), matrix=np.array([r["vec"] for r in data]))


def word_sets(spark: SparkSession, path: str) -> dict:
    """A dictionary file's checked header: idf_kind must be books, N positive."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    if data.get("idf_kind") != "books" or not data.get("N", 0) > 0:
        raise ValueError("not a dictionary with book counts")
    return data


def evolve(target: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Target with the columns it lacks, null, in the given types (additive evolution)."""
    return target.withColumns({c: F.lit(None).cast(k) for c, k in columns.items() if c not in target.columns}) if columns else target


def overwrite(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Truncate and load."""
    w = rows.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_parent_child(parent: DataFrame, child: DataFrame, path: str) -> None:
    """Two tables; the child is written last, so that a reader that waits for its _SUCCESS sees both."""
    overwrite(parent, os.path.join(path, "parent"))
    overwrite(child, os.path.join(path, "child"))


def metrics_json(rows: DataFrame, name: str, value: str) -> Column | str:
    """One compact JSON object of name and value; values that are not finite are an error."""
    bad = rows.filter(F.col(value).isNull() | F.isnan(value) | (F.abs(value) == float("inf"))).limit(1).count()
    if bad:
        raise ValueError("a metric is not finite")
    return rows.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(name, value))))).alias("j")).first()["j"]


def graph_json(nodes: DataFrame, edges: DataFrame, path: str, inline_nodes: int = 3000, inline_edges: int = 15000) -> str:
    """Small graphs as one JSON text; larger ones as two folders of JSON lines below path, and their names as JSON."""
    if nodes.count() <= inline_nodes and edges.count() <= inline_edges:
        j = lambda d: [json.loads(x) for x in d.toJSON().collect()]
        return json.dumps({"nodes": j(nodes), "edges": j(edges)}, ensure_ascii=False)
    nodes.write.mode("overwrite").json(path + "/nodes")
    edges.write.mode("overwrite").json(path + "/edges")
    return json.dumps({"nodes": path + "/nodes", "edges": path + "/edges"})


def append_manifest(row: dict[str, object], path: str) -> None:
    """One line to a CSV file of the driver, with a header if the file is new, forced to disk."""
    import csv

    new = not os.path.exists(path)
    with open(path, "a", newline="", encoding="utf-8") as f:
        w = csv.DictWriter(f, fieldnames=list(row))
        if new:
            w.writeheader()
        w.writerow(row)
        f.flush()
        os.fsync(f.fileno())


def flatten(rows: DataFrame, *structs: str) -> DataFrame:
    """Struct columns replaced by their fields, named struct_field."""
    cols = []
    for f in rows.schema.fields:
        cols += [F.col(f"{f.name}.{g.name}").alias(f"{f.name}_{g.name}") for g in f.dataType.fields] if f.name in structs else [F.col(f.name)]
    return rows.select(*cols)
