import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quire.operators.ordering import with_neighbours
from quire.operators.skew import eager_join_aggregate, middle_rows
from quire.session import hashed_share


def brute(rows):
    by = defaultdict(list)
    for k, v, i in rows:
        if v is not None and v == v and i is not None:
            by[k].append((v, i))
    return {(k, sorted(x)[(len(x) + 1) // 2 - 1][1]) for k, x in by.items()}


@pytest.mark.parametrize("final_rows", [1, 5, 4096])
def test_middle_rows_equals_brute_force(spark, final_rows):
    r = random.Random(3)
    rows = [("hot", r.choice([0.1, 0.5, 0.5, 0.9, float("inf")]), i) for i in range(3000)]
    rows += [(f"k{r.randrange(40)}", r.random() * 1e-3, 5000 + i) for i in range(1500)]
    rows += [("ties", 7.0, 9000 + i) for i in range(400)] + [("one", -1.5, 1), (None, 2.0, 2), (None, 3.0, 3)]
    rows += [("hot", None, 4), ("hot", float("nan"), 5), ("nothing", None, 6), ("twice", 1.0, 8), ("twice", 1.0, 8)]
    df = spark.createDataFrame(rows, "k string, v double, id bigint").withColumn("_k", F.lit("clash")).repartition(5)
    got = {(x.k, x.id) for x in middle_rows(df, "k", "v", "id", final_rows).collect()}
    assert got == brute(rows)


def test_outlier_and_hot_bins(spark):
    r = random.Random(5)
    rows = [("hot", r.random(), i) for i in range(20000)] + [(f"k{i % 50}", r.random(), 30000 + i) for i in range(3000)] + [("far", 1e300, 1)]
    got = {(x.k, x.id) for x in middle_rows(spark.createDataFrame(rows, "k string, v double, id bigint"), "k", "v", "id", 16).collect()}
    assert got == brute(rows)


def test_hashed_share_is_met_however_small(spark):
    rows = spark.range(200_000)
    assert 150 <= rows.filter(hashed_share(["id"], 1e-3)).count() <= 250
    assert rows.filter(hashed_share(["id"], 1.0)).count() == 200_000 and rows.filter(hashed_share(["id"], 0.0)).count() == 0
    import pyspark.sql.functions as fn

    low = rows.agg(fn.min(fn.xxhash64("id"))).first()[0]
    assert rows.filter(hashed_share(["id"], (low + 2**63 + 2**12) / 2.0**64)).count() >= 1  # far below one in 1e5 can still be asked for


def test_middle_rows_empty(spark):
    df = spark.createDataFrame([], "k string, v int, id bigint")
    assert middle_rows(df, "k", "v", "id").count() == 0


def test_eager_join_equals_join(spark):
    r = random.Random(1)
    a = [(r.choice(["x", "x", "x", "y", None]), r.choice(["g1", "g2", None]), r.choice([1.0, 2.5, None])) for _ in range(200)]
    b = [(r.choice(["x", "x", "y", "z", None]), r.choice([1.0, 4.0, None])) for _ in range(150)]
    da, db = spark.createDataFrame(a, "k string, g string, v double"), spark.createDataFrame(b, "k string, u double")
    want = da.join(db, "k").groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("a"), F.coalesce(F.sum("u"), F.lit(0.0)).alias("b"))
    got = eager_join_aggregate(da, db, "k", ["g"], "v", "u")
    assert sorted(map(str, got.collect())) == sorted(str(x).replace("n=", "pairs=").replace("a=", "left_sum=").replace(" b=", " right_sum=") for x in want.collect())
    assert eager_join_aggregate(da.limit(0), db, "k", ["g"], "v", "u").count() == 0


def test_neighbours_across_partitions(spark):
    rows = [("hot", i, f"t{i}") for i in range(300)] + [("a", 1, "x"), ("z", 5, "y"), ("z", 9, "w")]
    got = {(x.k, x.i): (x.prev_t, x.next_t) for x in with_neighbours(spark.createDataFrame(rows, "k string, i int, t string"), "k", ["i"], ["t"]).collect()}
    assert len(got) == len(rows)
    for i in range(300):
        assert got["hot", i] == (f"t{i - 1}" if i else None, f"t{i + 1}" if i < 299 else None)
    assert got["a", 1] == (None, None) and got["z", 5] == (None, "w")
    assert with_neighbours(spark.createDataFrame([], "k string, i int, t string"), "k", ["i"], ["t"]).count() == 0
