import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.functions import hebrew as H, vectors as V
from quire.functions.text import blank_to_null, normal_path, trimmed
from quire.operators import allpairs, graph as G, layout as Y, lexicon as L, metrics as M, profile as P, reduction as N, relational as R, sampling as S
from quire.operators.ordering import running_total
from quire.plans import graphs, relational
from quire.sources import alto, files


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_text(spark):
    r = one(spark, trimmed(F.lit(" \ta ")), blank_to_null(F.lit(" \t")), normal_path(F.lit("/a//b/./c/../d")), normal_path(F.lit("../x/..")), normal_path(F.lit("")), normal_path(F.lit(None).cast("string")))
    assert list(r) == ["a", None, "/a/b/d", "..", ".", None]
    assert one(spark, H.clean_word(F.lit("‫(שלום!)‬")))[0] == "שלום"
    assert one(spark, H.strip_prefix(F.lit("ובית")), H.strip_prefix(F.lit("בי")))[:] == ("ית", "בי")


def test_vectors(spark):
    r = one(spark, V.parse_vector(F.lit("[3,4]")), V.parse_vector(F.lit("none")), V.unit(F.array(F.lit(3.0), F.lit(4.0))), V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))), V.fuse([(F.lit(0.5), 1.0), (F.lit(float("nan")), 3.0)]), V.nearest_bucket(F.lit(1225), [1200, 1250]), V.valid(F.array(F.lit(float("inf")))))
    assert list(r) == [[3.0, 4.0], None, [0.6, 0.8], None, 0.5, 1200.0, False]


def test_retrieval_fixture(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.0, 1.0], 2), (3, [0.1, 0.9], 2)], "item bigint, vec array<double>, label int")
    items = allpairs.normalised(rows, "item", "vec", label="label", grp=F.col("label").cast("string"), fam=F.lit(None).cast("string"))
    r = allpairs.ranks_of_relevant(items.select("item", "vec", "label"), block=2).collect()
    assert len(r) == 4 and all(x["rank"] == 1 for x in r)
    s = {x.metric: x.value for x in M.separation(allpairs.pair_table(items, block=2), "similarity", F.col("label_1") == F.col("label_2")).collect()}
    assert s["same_mean"] > s["different_mean"] and s["mean_gap"] > 0 and s["same_n"] == 2 and s["different_n"] == 4
    k = allpairs.knn(items.select("item", "vec", "grp", "fam"), 10, block=2)
    assert k.filter("edition = 'overall'").count() == 12  # excluded rows never appear, though k exceeds the rest
    assert k.filter("edition = 'joins'").filter("same_group").count() == 0 and k.filter("edition = 'joins'").count() == 8
    assert allpairs.knn(items.select("item", "vec", "grp", "fam").limit(0), 3).count() == 0


def test_classification_metrics(spark):
    rows = [(0.9, 1), (0.8, 1), (0.8, 0), (0.3, 0), (0.2, 1), (None, 1)]
    df = spark.createDataFrame(rows, "s double, y int")
    r = M.roc_auc(df, "s", F.col("y") == 1).first()
    pos, neg = [0.9, 0.8, 0.2], [0.8, 0.3]
    assert math.isclose(r.roc_auc, np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]))
    b = M.best_f1(df, "s", F.col("y") == 1).first()
    assert b.threshold == 0.2 and math.isclose(b.f1, 0.75)
    assert M.spearman(spark.createDataFrame([(1, 3), (2, 2), (3, 1)], "a int, b int"), "a", "b").first()[0] == pytest.approx(-1)
    d = spark.createDataFrame([(1210.0, 1200.0), (1240.0, 1250.0)], "p double, y double")
    assert M.regression_metrics(d, "y", "p").first().mae == 10.0


def test_splits(spark):
    pages = spark.createDataFrame([(m, f"{m}-{i}") for m in ("g_train", "g_val") for i in range(5)] + [("single", "s")], "m string, p string")
    c = S.clamped_split(pages, "m", [F.col("p")], 0.8).groupBy("m", "split").count().collect()
    assert {(x.m, x.split): x["count"] for x in c} == {("g_train", "train"): 4, ("g_train", "val"): 1, ("g_val", "train"): 4, ("g_val", "val"): 1, ("single", "train"): 1}
    ms = spark.createDataFrame([(f"{y}-{i}", y) for y, n in ((1200, 20), (1250, 20), (1300, 20), (1100, 5)) for i in range(n)], "id string, y int")
    o = S.folds(S.stratified_outer(ms, "id", "y", 0.3, 10), "id", "y", "split").collect()
    assert sum(x.split == "test" for x in o) == 18 and {x.fold for x in o if x.split == "train"} == {0, 1, 2, 3, 4}
    assert all(x.fold == -1 for x in o if x.y == 1100) and all(x.split == "excluded" for x in o if x.y == 1100)
    w = {x.id: x.weight for x in S.page_weights(spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4)], "g string, id int"), "g").collect()}
    assert math.isclose(w[1] + w[2] + w[3], w[4])
    b = S.balanced_weights(spark.createDataFrame([("n", "many", 1), ("n", "many", 2), ("n", "other", 3), ("p", "pos", 4)], "y string, g string, id int"), "y", "g").collect()
    b = {x.id: x.weight for x in b}
    assert math.isclose(b[1] + b[2], b[3]) and math.isclose(b[1] + b[2] + b[3], b[4])
    with pytest.raises(ValueError):
        S.pk_batches(ms, "y", "id", 4, 3, 1)
    k = S.pk_batches(ms, "y", "id", 4, 2, 3).collect()
    assert len(k) == 12 and all(len({x.y for x in k if x.batch == n}) == 2 for n in range(3))
    e = S.evenly_spaced(spark.range(11), [F.col("id")], 4).collect()
    assert sorted(x.id for x in e) == [0, 3, 6, 10]


def test_round_robin_and_budget(spark):
    rows = [("o", "A", i, 0.9) for i in range(100)] + [("o", "B", 200 + i, 0.8) for i in range(2)] + [("o", "C", 300 + i, 0.8) for i in range(2)]
    r = S.round_robin(spark.createDataFrame(rows, "o string, g string, i int, c double"), "o", "g", [F.desc("c"), F.col("i")], [F.col("g")], 6).groupBy("g").count().collect()
    assert {x.g: x["count"] for x in r} == {"A": 2, "B": 2, "C": 2}
    words = pd.DataFrame([(l, p, 0.99 - l / 100) for l in range(4) for p in range(3)], columns=["line", "place", "confidence"])
    assert sorted(set(S.line_budget(words, 7)["line"])) == [0, 1] and len(S.line_budget(words, 7)) == 6
    two = pd.DataFrame([(l, p, 0.9 - l / 10) for l in range(2) for p in range(6)], columns=["line", "place", "confidence"])
    assert S.line_budget(two, 4)["place"].tolist() == [0, 1, 2, 3]


def test_contracts(spark):
    rows = spark.createDataFrame([("1", "p1", "a"), ("2", "p2", "a"), ("3", "p3", "b"), ("4", "p4", "b")], "id string, path string, c string")
    assert P.require_members(rows, "id", "path", "c", 4, 2).count() == 4
    with pytest.raises(ValueError):
        P.require_members(rows.filter("id <> '4'"), "id", "path", "c")
    with pytest.raises(ValueError):
        P.require_columns(rows, ["x"])
    with pytest.raises(ValueError):
        R.many_to_one(rows, rows.withColumn("c", F.lit("a")), "c")
    with pytest.raises(ValueError):
        P.require_disjoint(spark.createDataFrame([("a", "train"), ("a", "val")], "k string, s string"), "k", "s")
    with pytest.raises(ValueError):
        P.require_same_dimension(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "v array<double>"), "v")
    with pytest.raises(ValueError):
        P.require_finite({"a": float("nan")}, {"a"})
    with pytest.raises(ValueError):
        P.require_one_label(spark.createDataFrame([("g", 1), ("g", None)], "g string, y int"), "g", "y")
    with pytest.raises(ValueError):
        P.require_label_map(spark.createDataFrame([("a",)], "l string"), spark.createDataFrame([("a", 1)], "l string, i int"), "l", "i")
    with pytest.raises(ValueError):
        P.require_prefix(spark.createDataFrame([(0, "b")], "position int, id string"), spark.createDataFrame([(0, "a")], "position int, id string"), "id", "position")
    with pytest.raises(ValueError):
        R.identifier("a; drop")


def test_graph(spark):
    rows = spark.createDataFrame([("a", "b", 0.9, 1), ("b", "a", 0.95, 2), ("b", "c", 0.5, 3), ("a", "c", None, 4), ("c", "d", float("nan"), 5), ("d", "d", 1.0, 6), (None, "a", 1.0, 7)], "x string, y string, s double, id bigint")
    e = G.edges(rows, "x", "y", "s", "id")
    got = {(r.src, r.dst): (r.weight, r.max_similarity, r.best_row, r.example_rows) for r in e.collect()}
    assert got == {("a", "b"): (2, 0.95, 2, [2, 1]), ("b", "c"): (1, 0.5, 3, [3]), ("a", "c"): (1, 0.0, 4, [4]), ("c", "d"): (1, 0.0, 5, [5])}
    assert [tuple(x) for x in G.triangles(e).collect()] == [("a", "b", "c")]
    nodes, inner = G.ego(e, ["d"], 1)
    assert {(r.node, r.hop) for r in nodes.collect()} == {("d", 0), ("c", 1)} and inner.count() == 1
    assert G.clique_edges(e, 3).count() == 3
    pdf = pd.DataFrame({"src": ["a", "a", "b", "c"], "dst": ["b", "c", "c", "d"]})
    assert G.maximal_cliques_local(pdf) == [["a", "b", "c"], ["c", "d"]]
    comm = G.communities(e, "weight").collect()
    assert {r.node for r in comm} == {"a", "b", "c", "d"}


def test_communities_settle(spark):
    n = 60  # a path takes more than ten rounds
    rows = [(f"{i:03}", f"{i + 1:03}", n - i) for i in range(n)]
    e = spark.createDataFrame(rows, "src string, dst string, weight bigint")
    got = {r.node: r.community for r in G.communities(e, "weight", rounds=2).collect()}
    assert len(got) == n + 1
    for v in got:
        votes = {}
        for a, b, w in rows:
            if v in (a, b):
                c = got[b if v == a else a]
                votes[c] = votes.get(c, 0) + w
        assert votes.get(got[v], 0) == max(votes.values()), v  # no node would move


def test_graph_queries_take_all_links(spark, tmp_path):
    row = lambda i, a, b, s: (i, a, b, f"q{a}", f"n{b}", s, 1)
    rows = [row(1, "11a", "11b", 0.3), row(2, "11b", "22c", 0.9), row(3, "11a", "22c", 0.2), row(4, "11a", "33d", None), row(5, "11b", "33d", 0.5), row(6, "22c", "33d", 0.1)]
    spark.createDataFrame(rows, "id bigint, query_manuscript_id string, neighbor_manuscript_id string, query_image_path string, neighbor_image_path string, similarity_score double, total_images_in_query_manuscripts int").write.parquet(str(tmp_path / "geniza_knn_results.parquet"))
    count = lambda f: f(spark, str(tmp_path)).count()
    assert [count(f) for f in (graphs.g4_ego_nodes, graphs.g5_ego_edges, graphs.g6_triangles, graphs.g6_four_cliques, graphs.g7_clique_edges, graphs.g8_communities, graphs.g10_circle_layout, graphs.f20_bridges)] == [4, 6, 4, 1, 6, 4, 4, 1]


def test_multi_key_join_takes_all_customers(spark, tmp_path):
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    put("customer", [(7, "a"), (21, "b"), (900, "c")], "c_custkey bigint, c_name string")
    put("orders", [(1, 7, "d1"), (2, 21, "d2"), (3, 900, "d3"), (4, 5, "d4")], "o_orderkey bigint, o_custkey bigint, o_orderdate string")
    put("lineitem", [(1, 1), (1, 2), (2, 1), (2, 1), (3, 5), (4, 1), (9, 1)], "l_orderkey bigint, l_linenumber int")
    got = sorted(map(tuple, relational.j3_multi_key_join(spark, str(tmp_path)).collect()))
    assert got == [(1, 1, "d1", "a"), (1, 2, "d1", "a"), (2, 1, "d2", "b"), (2, 1, "d2", "b"), (3, 5, "d3", "c")]


def test_upsert(spark):
    t = spark.createDataFrame([("a", 1, "old", "s"), ("b", 5, "keep", "s")], "k string, v int, x string, stale string")
    u = spark.createDataFrame([("a", 2, "new", "n"), ("b", 4, "late", "n"), ("c", 1, "add", "n")], "k string, v int, x string, stale string")
    got = {r.k: (r.v, r.x, r.stale) for r in R.upsert(t, u, ["k"], "v", keep=["stale"]).collect()}
    assert got == {"a": (2, "new", "s"), "b": (5, "keep", "s"), "c": (1, "add", None)}


def test_lexicon(spark):
    w = spark.createDataFrame([(1, 0, "בבית"), (1, 1, "בית"), (2, 0, "ובית"), (2, 1, "בית"), (3, 0, "יאמר")], "doc int, place int, word string")
    f = L.frequencies(w)
    base = {r.word: r.base for r in L.base_forms(f).collect()}
    assert base["בית"] == "בית" and base["ובית"] == "בית" and base["בבית"] == "בית"
    v = spark.createDataFrame([("בבית", 3.5), ("בית", 1.1), ("יאמר", 1.7)], "word string, value double")
    got = {r.w: r.value for r in L.lookup(spark.createDataFrame([("בבית",), ("ויאמר",), ("xyz",)], "w string"), "w", v).collect()}
    assert got == {"בבית": 3.5, "ויאמר": 1.7, "xyz": None}
    idf = spark.createDataFrame([("נדיר", 3.0)], "word string, idf double")
    lw = L.line_weights(spark.createDataFrame([(1, "נדיר"), (1, "unknown")], "line int, word string"), ["line"], idf)
    assert {r.word: round(r.weight, 4) for r in lw.collect()} == {"נדיר": 1.0, "unknown": 0.3333}


def test_layout(spark):
    r = spark.createDataFrame([(750.0,), (250.0,)], "x double").select(Y.page_segment("x", F.lit(500.0)).alias("a"), Y.page_segment("x", F.lit(500.0), rtl=False).alias("b"), Y.page_segment("x", F.lit(None).cast("double")).alias("c"))
    assert [tuple(x)[:2] for x in r.collect()] == [(0, 1), (1, 0)]
    lines = pd.DataFrame({"center_y": [10.0, 12.0, 13.5, 40.0]})
    assert Y.text_rows(lines, 3.0).tolist() == [0, 0, 0, 1]
    two = pd.DataFrame([(x, y) for y in range(100, 900, 50) for x in (200, 800)], columns=["center_x", "center_y"]).astype(float)
    assert Y.two_page_split(two, 1000, 1000) == 500.0
    assert Y.two_page_split(two.assign(center_x=300.0), 1000, 1000) is None
    box = "page int, width double, height double, center_x double, center_y double, x1 double, y1 double, x2 double, y2 double"
    none = (None,) * 4
    line = lambda p, x0, y0, x1, y1, w=700.0: (p, w, 20.0, 1.0, 1.0, x0, y0, x1, y1)
    rows = [(1, 10.0, 100.0, 1.0, 1.0, *none)] * 4 + [(2, 10.0, 100.0, 1.0, 1.0, *none)] * 2 + [line(3, 900.0, 5.0, 100.0, 9.0)] * 4 + [line(4, 100.0, 5.0, 900.0, 9.0)] * 4
    rows += [line(5, 5.0, 10.0, 9.0, 800.0)] * 3 + [line(5, 5.0, 800.0, 9.0, 10.0)] * 2 + [line(6, 5.0, 800.0, 9.0, 10.0)] * 3 + [(7, 0.0, 0.0, None, None, float("nan"), 1.0, 2.0, 3.0)] * 5
    assert {tuple(x) for x in Y.rotation_votes(spark.createDataFrame(rows, box), "page", 2000.0, 1000.0).collect()} == {(1, 90), (2, 0), (3, 180), (4, 0), (5, 270), (6, 90), (7, 0)}
    assert Y.rotation_votes(spark.createDataFrame(rows[:4], box), "page", 700.0, 1000.0).first().angle == 270
    assert Y.rotation_votes(spark.createDataFrame([], box), "page", 1.0, 1.0).count() == 0
    tiles = pd.DataFrame({"top": [0, 0, 10, 300], "left": [0, 10, 0, 0], "distance": [0.0, 0.1, 0.2, 0.3]})
    assert Y.choose_tiles(tiles, 100, 100, 2)["top"].tolist() == [0, 300]


def test_alto(spark):
    xml = """<a:alto xmlns:a="u"><a:Layout><a:Page WIDTH="1000" HEIGHT="1000"><a:PrintSpace><a:TextLine ID="line-0" HPOS="1" VPOS="2" WIDTH="30" HEIGHT="9" BASELINE="1,2 31,2">
<a:String CONTENT="שלום0" WC="0.99" HPOS="800" VPOS="100" WIDTH="80" HEIGHT="30"><a:Glyph CONTENT="ש" GC="0.99" HPOS="0" VPOS="0" WIDTH="10" HEIGHT="20"/></a:String>
<a:String CONTENT="x" WC="0.5" HPOS="1" VPOS="1" WIDTH="1" HEIGHT="1"/></a:TextLine><a:TextLine ID="bad" HPOS="1" VPOS="2" WIDTH="0" HEIGHT="9"/></a:PrintSpace></a:Page></a:Layout></a:alto>"""
    found = alto.lines(spark.createDataFrame([("p", xml), ("broken", "<alto"), ("none", None)], "path string, xml string"))
    s = alto.strings(found).collect()
    assert [(r.word, r.wc, r.line_id) for r in s] == [("שלום0", 0.99, "line-0")]
    box = alto.line_boxes(found).collect()
    assert len(box) == 1 and box[0].base_last.x == 31.0
    assert [r.char for r in alto.good_glyphs(alto.strings(found), 0.9).collect()] == ["ש"]
    assert alto.page_text(found).first().text == "שלום0 x"


def test_files(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("m2\n\n m1\nm2\n")
    assert [r.id for r in files.id_list(spark, str(tmp_path / "ids.txt"), more=["m0", "m2"]).collect()] == ["m0", "m1", "m2"]
    files.append_manifest({"a": 1}, str(tmp_path / "m.csv"))
    files.append_manifest({"a": 2}, str(tmp_path / "m.csv"))
    assert (tmp_path / "m.csv").read_text().split() == ["a", "1", "2"]
    files.save_arrays(spark.createDataFrame([("x", [1.0, 2.0])], "id string, vec array<double>"), str(tmp_path / "v.npz"))
    assert files.load_arrays(spark, str(tmp_path / "v.npz"), ["x"]).first().vec == [1.0, 2.0]
    with pytest.raises(ValueError):
        files.load_arrays(spark, str(tmp_path / "v.npz"), ["y"])
    (tmp_path / "db.ini").write_text("[database]\nhost=h\nport=1\ndbname=d\nuser=u\n")
    assert files.jdbc_options(str(tmp_path / "db.ini"))["url"] == "jdbc:postgresql://h:1/d"
    with pytest.raises(ValueError):
        files.metrics_json(spark.createDataFrame([("a", float("nan"))], "n string, v double"), "n", "v")
    e = spark.createDataFrame([("a", "b")], "src string, dst string")
    assert '"nodes": [{"node": "a"}]' in files.graph_json(spark.createDataFrame([("a",)], "node string"), e, str(tmp_path))


def test_reduction(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 4)) * [5, 2, 1, 0.1]
    rows = spark.createDataFrame([(i, v.tolist(), float(v[0] * 2 + 1)) for i, v in enumerate(x)], "id int, v array<double>, y double")
    p = N.pca(rows, "id", "v", 2, width=3).collect()
    assert len(p) == 200 and all(len(r.vec) == 3 and math.isclose(np.linalg.norm(r.vec), 1) for r in p)
    share = [r.share for r in N.explained(rows, "v", 4).collect()]
    assert share[0] > 0.7 and math.isclose(sum(share), 1)
    coef, intercept = N.ridge(rows, "v", "y", 4, 1e-9)
    assert math.isclose(intercept, 1, abs_tol=1e-6) and abs(coef[1]) < 1e-6


def test_stream(spark, tmp_path):
    from quire.streaming import incremental as I

    ev = spark.range(100).select(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 120).alias("ts"), (F.col("id") % 2).alias("kind"))
    ev.repartition(3).write.parquet(str(tmp_path / "e"))
    s = I.windowed_counts(I.read_new_files(spark, str(tmp_path / "e"), ev.schema), "ts", "kind", late="10 hours")
    assert s.isStreaming and I.drain(s, "windows").columns == ["window_start", "kind", "n"]
    assert I.current(spark, str(tmp_path / "nothing")) is None


def test_maximal_cliques(spark):
    r = random.Random(7)
    for n, m in ((14, 50), (30, 70), (6, 15)):
        e = sorted({tuple(sorted(r.sample([f"n{i:02d}" for i in range(n)], 2))) for _ in range(m)})
        df = spark.createDataFrame([*e, *[(b, a) for a, b in e[:5]], e[0]], "src string, dst string").withColumn("v", F.lit(1))
        want = G.maximal_cliques_local(pd.DataFrame(e, columns=["src", "dst"]))
        assert sorted(x.c for x in G.maximal_cliques(df, 2).collect()) == want
        assert sorted(x.c for x in G.maximal_cliques(df, 3).collect()) == [c for c in want if len(c) > 2]
    assert G.maximal_cliques(df.limit(0)).count() == 0


def test_ridge_by_folds(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 4)) * [1, 3, 0.5, 2] + 1
    y = x @ [1.0, -0.5, 2.0, 0.0] + rng.normal(size=120)
    rows = [(i, v.tolist(), float(t), i % 5) for i, (v, t) in enumerate(zip(x, y))] + [(900, None, 1.0, 0), (901, x[0].tolist(), None, 1), (902, x[0].tolist(), 1.0, None)]
    df = spark.createDataFrame(rows, "i int, v array<double>, y double, fold int")
    alpha, out = N.ridge_by_folds(df, "v", "y", "fold", 4, [100.0, 0.1, 1000.0])
    f, errors = np.arange(120) % 5, {}
    for a in (0.1, 100.0, 1000.0):
        p = np.empty(120)
        for k in range(5):
            tx, ty = x[f != k], y[f != k]
            m, s = tx.mean(axis=0), tx.std(axis=0)
            z = (tx - m) / s
            w = np.linalg.solve(z.T @ z + a * np.eye(4), z.T @ (ty - ty.mean()))
            p[f == k] = ((x[f == k] - m) / s) @ w + ty.mean()
        errors[a] = (np.abs(p - y).mean(), p)
    assert alpha == min(errors, key=lambda a: errors[a][0])
    got = {r.i: r._p for r in out.collect()}
    assert len(got) == 120 and np.allclose([got[i] for i in range(120)], errors[alpha][1])


def test_running_total(spark):
    r = random.Random(2)
    rows = [(i, r.choice([None, 1, 2, 5]), r.randrange(50)) for i in range(500)]
    got = {x.i: x.total for x in running_total(spark.createDataFrame(rows, "i int, n int, o int"), [F.col("o"), F.col("i")], "n", "total").collect()}
    want, total = {}, 0
    for i, n, o in sorted(rows, key=lambda x: (x[2], x[0])):
        total += n or 0
        want[i] = total
    assert got == want
    assert running_total(spark.createDataFrame([], "i int, n int"), [F.col("i")], "n", "total").count() == 0


def test_cross_pairs_differ_in_label(spark):
    rows = [(i, "abc"[i % 3] if i < 60 else "d") for i in range(120)] + [(500, None)]
    got = S.pair_sample(spark.createDataFrame(rows, "i int, l string"), "i", "l", 1000).collect()
    label = dict(rows)
    for kind in ("same", "cross"):
        pairs = [(x.item_1, x.item_2) for x in got if x.kind == kind]
        used = [i for p in pairs for i in p]
        assert len(used) == len(set(used)) and all((label[a] == label[b]) == (kind == "same") for a, b in pairs)
        assert len(pairs) >= (55 if kind == "same" else 38)  # 20 rounds of four labels give 40 pairs across, the rest is of one label
    assert S.pair_sample(spark.createDataFrame([], "i int, l string"), "i", "l", 5).count() == 0


def test_contiguous_shards(spark):
    got = {r.id: r.shard for r in S.contiguous_shards(spark.range(10), "id", 4).collect()}
    assert got == {i: i * 4 // 10 for i in range(10)}
