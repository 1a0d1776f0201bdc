"""Filling fixed-capacity containers with items."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quire.llm.differencing import pack
from quire.session import cut, table

CAPACITY = 2048
#: Items that are packed together in one task; more items make more shards, each with its own containers.
SHARD_ITEMS = 2048
#: The word-and-punctuation tokenizer \w+|[^\w\s]+ with letters, digits and white space of all scripts.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{85}\x{1c}-\x{1f}]+"


def token_count(text: str | Column) -> Column:
    """Tokens of a text; null and blank texts have 0."""
    return F.coalesce(F.regexp_count(text if isinstance(text, Column) else F.col(text), F.lit(TOKEN)), F.lit(0)).cast("bigint")


def pack_items(items: DataFrame, item_id: str, size: str, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Place items in containers of capacity: item_id, copy, size, pieces, piece, first, length, container_id.

    Items up to capacity stay whole (pieces = 1). A larger item is split into full pieces, each a container of its
    own, and a rest that is packed like an item; first is the piece's offset in the item. Null, zero and negative
    sizes take no room and get no row. Rows of the same item_id and size are told apart by copy, counted
    from 0. Other columns are ignored. Container ids follow from ids, sizes and copies, so they are the same on every run.

    Only ids and sizes are shuffled, in shards of about shard_items by a hash of id, size and copy. In a shard,
    multiway differencing makes near-equal windows, and more windows whenever one exceeds the capacity. A shard
    leaves at most about one window unfilled, so the loss does not grow with the data.
    """
    sized = items.select(F.col(item_id).alias("item"), F.col(size).cast("bigint").alias("size")).filter("size > 0")
    sized = sized.groupBy("item", "size").agg(F.count(F.lit(1)).alias("copies"))
    sized = cut(sized.select("item", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("copy")), "sizes")  # counted once, whatever counts the tokens
    full = F.floor(F.col("size") / capacity).cast("bigint")
    rest = F.col("size") % capacity
    sized = sized.withColumn("pieces", full + F.when(rest > 0, 1).otherwise(0))
    kept = ["item", "copy", "size", "pieces"]
    whole = (
        sized.filter(F.col("size") >= capacity)
        .select(*kept, F.explode(F.sequence(F.lit(0).cast("bigint"), full - 1)).alias("piece"))
        .select(*kept, "piece", (F.col("piece") * capacity).alias("first"), F.lit(capacity).cast("bigint").alias("length"))
        .withColumn("container_id", F.concat_ws("-", F.lit("full"), F.col("item").cast("string"), F.col("size").cast("string"), F.col("copy").cast("string"), F.col("piece").cast("string")))
    )
    rests = sized.filter(rest > 0).select(*kept, full.alias("piece"), (full * capacity).alias("first"), rest.alias("length"))
    shards = max(1, -(-rests.count() // shard_items))
    rests = rests.withColumn("shard", F.pmod(F.xxhash64("item", "size", "copy"), F.lit(shards)))

    def place(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["length", "item", "copy"], ascending=[False, True, True], kind="stable", ignore_index=True)
        windows = pack(shard["length"].to_numpy(np.int64), capacity)
        shard["container_id"] = ["rest-%d-%d" % x for x in zip(shard.pop("shard"), windows)]
        return shard

    kind = items.schema[item_id].dataType.simpleString()
    tasks = min(shards, max(200, 16 * items.sparkSession.sparkContext.defaultParallelism))  # by shards, not by bytes: the work is in the shards
    placed = rests.repartition(tasks, "shard").groupBy("shard").applyInPandas(place, f"item {kind}, copy bigint, size bigint, pieces bigint, piece bigint, first bigint, length bigint, container_id string")
    return whole.unionByName(placed).withColumnsRenamed({"item": item_id, "size": size})


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their containers of 2,048 tokens."""
    texts = table(spark, sf_dir, "documents").select("doc_id", token_count("text").alias("n_tokens"))
    return pack_items(texts, "doc_id", "n_tokens").drop("copy")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the placement divides over several containers."""
    return p8_packed(spark, sf_dir).groupBy("doc_id").agg(F.min("container_id").alias("lo"), F.max("container_id").alias("hi")).filter("lo <> hi").select("doc_id")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the placement must keep: tokens placed, documents, documents divided without need, containers over capacity, whether 97 % are filled."""
    placed = p8_packed(spark, sf_dir)
    used = placed.groupBy("container_id").agg(F.sum("length").alias("n")).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("tokens"), F.count_if(F.col("n") > CAPACITY).alias("over"))
    docs = placed.groupBy("doc_id").agg(F.max("pieces").alias("p"), F.max("n_tokens").alias("n")).agg(F.count(F.lit(1)).alias("documents"), F.count_if((F.col("p") > 1) & (F.col("n") <= CAPACITY)).alias("divided"))
    one = used.unionByName(docs, allowMissingColumns=True).agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("tokens", "documents", "divided", "over", "k")])
    return one.select("tokens", "documents", F.col("divided").alias("divided_without_need"), F.col("over").alias("containers_over"), (F.col("tokens") >= F.col("k") * CAPACITY * 0.97).alias("well_filled"))


QUERIES = {"p8_found": p8_found, "p8_packed": p8_packed, "p8_fill": p8_fill}

_TOKENS = r"len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{85}\x{1c}-\x{1f}\x0b]+'))"

SQL = {
    "p8_found": f"SELECT doc_id FROM documents WHERE {_TOKENS} > 2048",
    "p8_fill": f"""
SELECT CAST(sum(n) AS BIGINT) AS tokens, count(*) AS documents, CAST(0 AS BIGINT) AS divided_without_need, CAST(0 AS BIGINT) AS containers_over, true AS well_filled
FROM (SELECT {_TOKENS} AS n FROM documents) WHERE n > 0""",
}
