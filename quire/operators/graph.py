"""Undirected graphs from neighbour rows: edges, nodes, ego graphs, bridges, triangles and cliques, communities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.session import cut, release


def edges(rows: DataFrame, a: str, b: str, score: str, row_id: str, examples: int = 100, least_weight: int = 1) -> DataFrame:
    """One row per unordered pair of different nodes: src, dst, weight, max_similarity, best_row, example_rows.

    weight counts rows; max_similarity is at least 0; example_rows are the best rows' ids, at most `examples`. Null
    ends and pairs of a node with itself are skipped, null and NaN scores count as 0.
    """
    s = F.coalesce(F.when(~F.isnan(score), F.col(score)), F.lit(0.0))
    rows = rows.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), s.alias("s"), F.col(row_id).alias("r"), F.col(a).alias("_a"), F.col(b).alias("_b"))
    rows = rows.filter("_a IS NOT NULL AND _b IS NOT NULL AND _a <> _b")
    whole = rows.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"), F.greatest(F.max("s"), F.lit(0.0)).alias("max_similarity"), F.max_by("r", F.struct("s", -F.col("r"))).alias("best_row"))
    top = rows.withColumn("p", F.row_number().over(Window.partitionBy("src", "dst").orderBy(F.desc("s"), "r"))).filter(F.col("p") <= examples)
    few = top.groupBy("src", "dst").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "r"))), lambda x: x["r"]).alias("example_rows"))
    return whole.filter(F.col("weight") >= least_weight).join(few, ["src", "dst"])


def best_edges(rows: DataFrame, a: str, b: str, score: str, row_id: str) -> DataFrame:
    """The row of the highest score per unordered pair; of equal ones the first by row_id."""
    rows = rows.filter(F.col(score).isNotNull() & ~F.isnan(score) & (F.col(a) != F.col(b)))
    rows = rows.withColumns({"src": F.least(a, b), "dst": F.greatest(a, b)})
    w = Window.partitionBy("src", "dst").orderBy(F.desc(score), row_id)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def ends(e: DataFrame, *columns: str) -> DataFrame:
    """Both directions of every edge: node, other and columns."""
    one = F.struct(F.col("src").alias("node"), F.col("dst").alias("other"), *columns)
    two = F.struct(F.col("dst").alias("node"), F.col("src").alias("other"), *columns)
    return e.select(F.inline(F.array(one, two)))


def degrees(e: DataFrame) -> DataFrame:
    return ends(e).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def ego(e: DataFrame, start: list, hops: int, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, hop, degree) within `hops` of the start nodes and the edges among them.

    most keeps the nodes first by (hop, degree descending, node). One frontier join per hop.
    """
    spark = e.sparkSession
    kind = e.schema["src"].dataType.simpleString()
    reached = spark.createDataFrame([(x, 0) for x in start], f"node {kind}, hop int")
    reached = reached.join(ends(e).select("node").distinct(), "node", "left_semi")
    step = ends(e).select("node", "other")
    for h in range(1, hops + 1):
        frontier = reached.filter(F.col("hop") == h - 1).select("node")
        new = step.join(frontier, "node").select(F.col("other").alias("node")).distinct().join(reached.select("node"), "node", "left_anti")
        reached = cut(reached.unionByName(new.withColumn("hop", F.lit(h))), "ego")
    nodes = reached.join(degrees(e), "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    if most is not None:
        nodes = cut(nodes.orderBy("hop", F.desc("degree"), "node").limit(most), "ego")
    return nodes, induced(e, nodes)


def induced(e: DataFrame, nodes: DataFrame) -> DataFrame:
    n = nodes.select("node")
    return e.join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "dst"), "dst", "left_semi")


def bridges(e: DataFrame, same: Column) -> DataFrame:
    """Edges both of whose ends touch an edge that is `same` and one that is not."""
    e = e.withColumn("_same", same)
    kinds = ends(e, "_same").groupBy("node").agg(F.bool_or("_same").alias("a"), F.bool_or(~F.col("_same")).alias("b"))
    return induced(e, kinds.filter("a AND b")).drop("_same")


def triangles(e: DataFrame) -> DataFrame:
    """(a, b, c) with a < b < c, all three linked.

    Edges point from the end of lower degree to the other, so that no node opens more wedges than the root of the
    number of edges.
    """
    d = degrees(e)
    x = e.select("src", "dst").join(d.select(F.col("node").alias("src"), F.col("degree").alias("ds")), "src").join(d.select(F.col("node").alias("dst"), F.col("degree").alias("dd")), "dst")
    low = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
    out = x.select(F.when(low, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(low, F.col("dst")).otherwise(F.col("src")).alias("v"))
    wedge = out.select("u", F.col("v").alias("v1")).join(out.select("u", F.col("v").alias("v2")), "u").filter("v1 < v2")
    closed = wedge.join(e.select(F.col("src").alias("v1"), F.col("dst").alias("v2")), ["v1", "v2"])
    s = F.array_sort(F.array("u", "v1", "v2"))
    return closed.select(s[0].alias("a"), s[1].alias("b"), s[2].alias("c"))


def clique_edges(e: DataFrame, size: int = 3) -> DataFrame:
    """Edges that lie in some maximal clique of at least `size` nodes; 3 is answered by triangles, more by k_cliques()."""
    if size <= 2:
        return e
    found = triangles(e).select(F.array("a", "b", "c").alias("c")) if size == 3 else k_cliques(e, size)
    pairs = found.select(F.explode("c").alias("src"), "c").select("src", F.explode("c").alias("dst")).filter("src < dst").distinct()
    return e.join(pairs, ["src", "dst"], "left_semi")


def k_cliques(e: DataFrame, size: int) -> DataFrame:
    """(c): sorted arrays of `size` nodes all linked with one another, grown from triangles one node at a time."""
    found = triangles(e).select(F.array("a", "b", "c").alias("c"))
    step = e.select(F.col("src").alias("last"), F.col("dst").alias("new"))
    for n in range(3, size):
        grown = found.withColumn("last", F.element_at("c", -1)).join(step, "last").drop("last")
        others = grown.withColumn("k", F.monotonically_increasing_id()).select("k", "c", "new", F.explode(F.slice("c", 1, n - 1)).alias("src"))
        linked = others.join(e.select("src", F.col("dst").alias("new")), ["src", "new"]).groupBy("c", "new").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") == n - 1)
        found = linked.select(F.concat("c", F.array("new")).alias("c"))
    return found


def maximal_cliques(e: DataFrame, size: int = 3) -> DataFrame:
    """(c): sorted arrays of the nodes of every maximal clique of at least `size` nodes.

    Nodes are ordered by degree. A clique is found at its first node: a search with pivots over that node's later
    neighbours, where an earlier neighbour linked with all of a clique shows that it is not maximal. So a node's task holds the
    links among its neighbours of which one end comes later, and by the order few of these come later even at a node of
    many links (at most the square root of twice the number of edges). Repeated and reversed edges count once.
    """
    one = e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a <> b").distinct()
    one = cut(one, "links")
    degree = cut(ends(one.select(F.col("a").alias("src"), F.col("b").alias("dst"))).groupBy("node").agg(F.count(F.lit(1)).alias("n")), "degrees")
    at = lambda c: degree.select(F.col("node").alias(c), F.struct(F.col("n"), F.col("node").alias("v")).alias("o" + c))
    placed = one.join(at("a"), "a").join(at("b"), "b")
    up = placed.select(F.least("oa", "ob").alias("x"), F.greatest("oa", "ob").alias("y"))  # x comes before y
    up = cut(up.select(F.col("x.v").alias("lo"), F.col("y.v").alias("hi"), F.col("x").alias("xo"), F.col("y").alias("yo")), "order", drop=one)
    # triangles lo < mid < hi; at each of the three nodes the link between the other two is needed if one of these comes later
    first = up.select(F.col("lo").alias("p"), F.col("hi").alias("q"))
    second = up.select(F.col("lo").alias("q"), F.col("hi").alias("r"))
    third = up.select(F.col("lo").alias("p"), F.col("hi").alias("r"))
    tri = first.join(second, "q").join(third, ["p", "r"])
    local = tri.select(F.inline(F.array(
        F.struct(F.col("p").alias("v"), F.col("q").alias("s"), F.lit(True).alias("s_later"), F.col("r").alias("d"), F.lit(True).alias("d_later")),
        F.struct(F.col("q").alias("v"), F.col("p").alias("s"), F.lit(False).alias("s_later"), F.col("r").alias("d"), F.lit(True).alias("d_later")),
    )))
    kind = e.schema["src"].dataType.simpleString()

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        v, near, later = pdf["v"].iloc[0], {}, set()
        for a, al, b, bl in zip(pdf["s"], pdf["s_later"], pdf["d"], pdf["d_later"]):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
            later |= ({a} if al else set()) | ({b} if bl else set())
        out, todo = [], [([v], later, set(near) - later)]
        while todo:
            r, p, x = todo.pop()
            if not p:
                if not x and len(r) >= size:
                    out.append(sorted(r))
                continue
            pivot = max(p | x, key=lambda u: (len(near[u] & p), str(u)))
            for u in sorted(p - near[pivot], key=str):
                todo.append((r + [u], p & near[u], x & near[u]))
                p = p - {u}
                x = x | {u}
        return pd.DataFrame({"c": pd.Series(out, dtype=object)})

    found = local.groupBy("v").applyInPandas(search, f"c array<{kind}>")
    if size > 2:
        return found
    # links in no triangle are cliques of two
    inside = tri.select(F.explode(F.array(F.array_sort(F.array("p", "q")), F.array_sort(F.array("p", "r")), F.array_sort(F.array("q", "r")))).alias("c")).distinct()
    return found.unionByName(up.select(F.array_sort(F.array("lo", "hi")).alias("c")).join(inside, "c", "left_anti"))


def communities(e: DataFrame, weight: str | None = None, rounds: int = 10) -> DataFrame:
    """(node, community) by label propagation: every node takes the label of most weight among its neighbours.

    A node keeps its label while none has more weight; ties of others go to the smallest label. Rounds go on until no
    node would move. In the first `rounds` half of the nodes move (by a hash that changes with the round), so that
    labels do not swing; then of linked nodes only the one of the smallest hash moves, so that every round raises the
    weight inside communities and the loop ends.
    This is not greedy modularity: that is sequential over the whole graph and has no distributed form.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    both = cut(ends(e.withColumn("_w", w), "_w"), "both")
    labels = cut(both.select("node").distinct().withColumn("label", F.col("node")), "labels")
    i = 0
    while True:
        votes = both.join(labels.withColumnsRenamed({"node": "other", "label": "vote"}), "other").groupBy("node", "vote").agg(F.sum("_w").alias("n"))
        best = votes.join(labels, "node").groupBy("node").agg(F.max(F.when(F.col("vote") == F.col("label"), F.col("n"))).alias("own"), F.max("n").alias("top"), F.min_by("vote", F.struct(-F.col("n"), "vote")).alias("best"))
        want = cut(best.filter("top > coalesce(own, 0)").select("node", "best", F.xxhash64("node", F.lit(i)).alias("turn")), "want")
        if want.isEmpty():
            break
        if i < rounds:
            moves = want.filter(F.pmod("turn", F.lit(2)) == 0)
        else:
            pairs = both.join(want.select("node", "turn"), "node").join(want.select(F.col("node").alias("other"), F.col("turn").alias("before")), "other")
            moves = want.join(pairs.filter((F.col("before") < F.col("turn")) | ((F.col("before") == F.col("turn")) & (F.col("other") < F.col("node")))).select("node"), "node", "left_anti")
        labels = cut(labels.join(moves, "node", "left").select("node", F.coalesce("best", "label").alias("label")), "labels", labels)
        release(want)
        i += 1
    least = labels.groupBy("label").agg(F.min("node").alias("community"))
    return labels.join(least, "label").select("node", "community")


def circle_layout(nodes: DataFrame, community: str, node: str) -> DataFrame:
    """(node, x, y): communities on a large circle by their order, members on a small one around it."""
    order = nodes.select(community).distinct().withColumn("_c", F.row_number().over(Window.orderBy(community)) - 1)
    n = max(1, order.count())
    w = Window.partitionBy(community)
    at = F.row_number().over(w.orderBy(node)) - 1
    size = F.count(F.lit(1)).over(w)
    turn = 2 * np.pi
    r = nodes.join(order, community).withColumns({"_a": F.col("_c") * (turn / n), "_b": at / size * turn, "_s": F.sqrt(size) / 4})
    return r.select(node, (F.cos("_a") * 10 + F.cos("_b") * F.col("_s")).alias("x"), (F.sin("_a") * 10 + F.sin("_b") * F.col("_s")).alias("y"))


def maximal_cliques_local(pdf: pd.DataFrame) -> list[list]:
    """Maximal cliques of one small edge list (src, dst), by Bron-Kerbosch with pivots; for components and tests."""
    near: dict = {}
    for a, b in zip(pdf["src"], pdf["dst"]):
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out, todo = [], [([], set(near), set())]
    while todo:
        r, p, x = todo.pop()
        if not p and not x:
            out.append(sorted(r))
            continue
        pivot = max(p | x, key=lambda v: (len(near[v] & p), str(v)))
        for v in sorted(p - near[pivot], key=str):
            todo.append((r + [v], p & near[v], x & near[v]))
            p = p - {v}
            x = x | {v}
    return sorted(out)
