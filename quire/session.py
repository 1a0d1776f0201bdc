"""Session, table access and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def local_session(cores: int = 8, app: str = "quire", **conf: str) -> SparkSession:
    """A session for tests and benches on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, which the cluster sets.

    Where it is unset a folder of this machine is used, but only by a session that runs on this machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext.getCheckpointDir()
        if held:
            return held
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quire-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def _path(spark: SparkSession, uri: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is still there when the application ends is deleted then."""
    uri = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    path, fs = _path(spark, uri)
    fs.deleteOnExit(path)
    return uri


def remove(spark: SparkSession, uri: str) -> None:
    path, fs = _path(spark, uri)
    fs.delete(path, True)


def cut(df: DataFrame, name: str = "cut", drop: DataFrame | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and a lost executor loses nothing.

    drop: an earlier result of cut() that nothing needs any more; its files go after the write.
    """
    spark = df.sparkSession
    uri = new_path(spark, name)
    df.write.parquet(uri)
    out = spark.read.schema(df.schema).parquet(uri)
    if drop is not None:
        release(drop)
    out._quire_uri = uri
    return out


def hashed_share(columns: list[str], share: float) -> Column:
    """Whether a row falls into a share (0 to 1) of all rows by the 64-bit hash of columns; any share is met, however small."""
    return F.xxhash64(*columns) <= F.lit(min(2**63 - 1, int(share * 2.0**64) - 2**63))


def release(df: DataFrame) -> None:
    """Delete the files of a result of cut() that nothing needs any more."""
    uri = getattr(df, "_quire_uri", None)
    if uri:
        remove(df.sparkSession, uri)
