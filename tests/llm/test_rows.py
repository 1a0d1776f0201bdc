"""Top N, components, packing, leaks and splits against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import differencing, leaks, packing, splits, topn
from quire.llm.components import hash_to_min, match_links
from quire.session import new_path


def best(rows, n):
    by = defaultdict(dict)
    for g, item, s, r, i in rows:
        if g is None or s is None or s != s:
            continue
        key = (-s, r is None, r or 0, i)
        if item not in by[g] or key < by[g][item]:
            by[g][item] = key
    return {(g, k[3]) for g, x in by.items() for k in sorted(x.values())[:n]}


def test_top_n(spark):
    r = random.Random(5)
    rows = [("hot", f"n{r.randrange(900)}", r.choice([0.5, 0.6, 0.61, r.random()]), r.choice([None, 0, 1, 2]), i) for i in range(6000)]
    rows += [(f"g{r.randrange(60)}", f"n{r.randrange(6)}", round(r.random(), 1), r.randrange(3), 9000 + i) for i in range(900)]
    rows += [("few", "a", 0.1, 1, 1), ("few", "a", 0.1, 1, 2), ("few", None, 0.2, 1, 3), (None, "a", 1.0, 1, 4), ("none", "a", None, 1, 5), ("none", "a", float("nan"), 1, 6)]
    df = spark.createDataFrame(rows, "q string, n string, s double, r int, id bigint").withColumns({"g": F.lit(1), "item": F.lit(2), "score": F.lit(3)})
    got = {(x.q, x.id) for x in topn.top_n_per_group(df, "q", "n", "s", "r", "id", 5, row_group_bytes=2000).collect()}
    assert got == best(rows, 5)
    assert topn.top_n_per_group(df.limit(0), "q", "n", "s", "r", "id", 5).count() == 0


def test_top_n_skips_row_groups(spark):
    df = spark.range(40_000).select(F.lit("hot").alias("g"), F.col("id").cast("string").alias("item"), (F.col("id") / 40_000).alias("score"), F.lit(1).cast("bigint").alias("rank"), "id")
    uri = new_path(spark, "one")
    df.orderBy(F.desc("score")).coalesce(1).write.option("parquet.block.size", "20000").parquet(uri)
    files = spark.read.parquet(uri).inputFiles()
    rows, read, skipped = topn.scan_file(files[0], 5)
    assert sorted(rows["id"]) == [39995, 39996, 39997, 39998, 39999] and read == 1 and skipped > 3


def union_find(pairs):
    p = {}

    def f(x):
        p.setdefault(x, x)
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = f(a), f(b)
            p[max(x, y)] = min(x, y)
    return {(x, f(x)) for x in list(p)}


@pytest.mark.parametrize("hot", [3, 10_000])
def test_hash_to_min(spark, hot):
    r = random.Random(2)
    pairs = [(f"{r.randrange(300):03d}", f"{r.randrange(300):03d}") for _ in range(180)] + [("500", f"{i}") for i in range(501, 640)]
    pairs += [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(40)] + [("x", "x"), (None, "a"), ("a", None), ("b", "a"), ("a", "b"), ("a", "b")]
    df = spark.createDataFrame(pairs, "p string, q string").withColumn("v", F.lit(0))
    assert {(x.node, x.component) for x in hash_to_min(df, "p", "q", hot).collect()} == union_find(pairs)
    assert hash_to_min(df.limit(0), "p", "q").count() == 0


def test_match_links(spark):
    df = spark.createDataFrame([("a ", "b", 0.9), ("a", "c", 0.89), ("a", "d", None), ("a", "e", float("nan")), ("\tf", " ", 0.95)], "query_manuscript_id string, neighbor_manuscript_id string, similarity_score double")
    assert [tuple(x) for x in hash_to_min(match_links(df, 0.9), "a", "b").orderBy("node").collect()] == [("a", "a"), ("b", "a")]


def test_differencing():
    rng = np.random.default_rng(0)
    w = rng.integers(1, 1000, 500)
    parts, sums = differencing.partition(w, 12)
    assert np.array_equal(np.bincount(parts, weights=w, minlength=12).astype(int), sums) and sums.max() - sums.min() < 20
    assert differencing.partition(np.array([], dtype=int), 3)[0].size == 0
    p = differencing.pack(w, 2048)
    used = np.bincount(p, weights=w)
    assert used.max() <= 2048 and len(used) <= -(-w.sum() // 2048) + 2
    with pytest.raises(ValueError):
        differencing.pack(np.array([5]), 4)


def test_packing(spark):
    r = random.Random(0)
    sizes = [(i, r.choice([5, 60, 700, 1500, 2047, 2048, 2049, 5000])) for i in range(900)] + [(1000, None), (1001, 0), (1002, -3), (1003, 4096), (5, 60)]
    df = spark.createDataFrame([*sizes, (3, sizes[3][1]), (3, sizes[3][1])], "doc bigint, n int").withColumns({"item": F.lit("x"), "copy": F.lit(7)})
    again = packing.pack_items(df.repartition(5), "doc", "n", shard_items=200)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, packing.pack_items(df, "doc", "n", shard_items=200).collect()))  # the same on every run
    assert again.filter("doc = 3 AND piece = 0").select("copy").distinct().count() == 3
    df = spark.createDataFrame(sizes, "doc bigint, n int").withColumn("item", F.lit("x"))
    out = packing.pack_items(df, "doc", "n", shard_items=200).collect()
    by, whole = defaultdict(int), defaultdict(int)
    for x in out:
        by[x.container_id] += x.length
        whole[x.doc, x.n] += x.length
        assert x.pieces == -(-x.n // 2048)
    assert max(by.values()) <= 2048
    assert {k: v for k, v in whole.items() if k[0] != 5} == {(d, n): n for d, n in sizes if n and n > 0 and d != 5}
    assert packing.pack_items(df.limit(0), "doc", "n").count() == 0
    small = [(i, r.randrange(1, 700)) for i in range(800)]
    c = packing.pack_items(spark.createDataFrame(small, "doc bigint, n int"), "doc", "n").select("container_id").distinct().count()
    assert c <= sum(n for _, n in small) / 2048 / 0.98 + 1
    texts = spark.createDataFrame([("a b, c!!  ש׳ ٣",), ("",), (None,), (" \n",), ("a_1-é ",)], "t string")
    assert [x[0] for x in texts.select(packing.token_count("t")).collect()] == [8, 0, 0, 0, 3]


def test_leaks(spark):
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randrange(5, 40)))) for i in range(12)] + [(90, None), (91, ""), (5, "one two")]
    docs = []
    for i in range(150):
        w = [r.choice(vocab) for _ in range(60)]
        if i % 3 == 0:
            it = r.choice(items[:12])[1].split()
            k = r.randrange(8, 20)
            w[20:20] = it[:k]
        docs.append((i, " ".join(w)))
    docs += [(900, None), (901, ""), (902, "W1 ‫w2‬, w-\n3")]

    def grams(t, n=12):
        w = leaks.words_of(t)
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    want = {(d, i) for d, t in docs for i, s in items if grams(t) & grams(s)}
    dd = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("i", F.lit(1))
    di = spark.createDataFrame(items, "item_id bigint, text string")
    got = [(x.doc_id, x.item_id) for x in leaks.find_leaks(dd, "doc_id", "text", di, "item_id", "text").collect()]
    assert set(got) == want and len(got) == len(want) and want
    assert leaks.find_leaks(dd, "doc_id", "text", di.limit(0), "item_id", "text").count() == 0
    text = leaks.find_leaks(dd.select("doc_id", "text"), "doc_id", "text", di.withColumn("item_id", F.concat(F.lit("item "), "item_id")), "item_id", "text")
    assert {(x.doc_id, int(x.item_id[5:])) for x in text.collect()} == want
    assert leaks.words_of("Ca­fé W-\n3 ab-\ncd ‎x_y") == ["café", "w", "3", "abcd", "x", "y"]


def test_splits(spark):
    marks = spark.createDataFrame([("m1 ", "L", "R"), ("m2", " L", "R\t"), ("m2", "L", "R"), ("m3", "", "R"), ("m4", None, "R"), ("m5", "L", " "), ("m6", "K", "Q"), ("m2", "K", "Q")], "manuscript_id string, normalized_library string, shelfmark_root string")
    ms = spark.createDataFrame([(f"m{i}",) for i in range(1, 8)] + [("m1\t",), (" ",), (None,)], "manuscript_id string")
    got = {x.manuscript_id: x.source_id for x in splits.sources(ms, marks).collect()}
    assert got == {"m1": "m1", "m2": "m1", "m6": "m1", "m3": "m3", "m4": "m4", "m5": "m5", "m7": "m7"}
    lab = spark.createDataFrame([(" Train", "m1", "/x"), ("VALIDATION", "m2", "/y"), ("test", " ", "/a//b"), ("train", None, "/a/./b"), ("what", "m3", "/z"), (None, "m3", "/z"), ("train", None, None), ("test", "m5", "/q")], "split string, label string, image_path string")
    meta = spark.createDataFrame([(1, "/a/b", "old", 1), (2, "/a/b", " m7 ", 2)], "id bigint, image_path string, manuscript_id string, updated_at int").withColumn("updated_at", F.timestamp_seconds("updated_at"))
    a = splits.labelled(lab, meta)
    assert {tuple(x) for x in a.collect()} == {("m1", "train", 1), ("m2", "val", 1), ("m7", "test", 1), ("m7", "train", 1), ("m5", "test", 1)}
    assert {x.manuscript_id for x in splits.broken_sources(a, marks).collect()} == {"m1", "m2", "m7"}
    assert splits.broken_sources(a.limit(0), marks.limit(0)).count() == 0


def test_assign_splits(spark):
    r = random.Random(1)
    w = [(f"s{i}", r.randrange(1, 60)) for i in range(3000)] + [("big", 30000), ("zero", None), ("neg", -4), (None, 9), ("s1", 3)]
    df = spark.createDataFrame(w, "s string, w int").withColumn("b", F.lit(0))
    out = splits.assign_splits(df, "s", "w", bucket_sources=700).collect()
    assert len(out) == len({x.s for x in out}) == 3003
    total = sum(x.w for x in out)
    for k, p in splits.PROPORTIONS.items():
        assert abs(sum(x.w for x in out if x.split == k) / total - p) < 0.02
    assert splits.assign_splits(df.limit(0), "s", "w").count() == 0
