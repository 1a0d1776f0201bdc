"""Nearest vectors and density-peak clusters against brute force."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import clusters, neighbours, vectors


def data(seed=0, groups=14, singles=150):
    rng = np.random.default_rng(seed)
    u = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    rows, i = [], 0
    for g in range(groups):
        m = u(rng.normal(size=64))
        for _ in range([60, 3, 4, 2, 9][g % 5]):
            rows.append((i := i + 1, (u(m + 0.03 * rng.normal(size=64)) * rng.choice([1, 3])).astype("f4").tolist()))
    a, b = u(rng.normal(size=64)), u(rng.normal(size=64))
    b = u(b - (a @ b) * a)
    for t in np.linspace(0, 1.0, 12):  # a chain: linked, but not every two near
        rows.append((i := i + 1, (np.cos(t) * a + np.sin(t) * b).astype("f4").tolist()))
    copy = u(rng.normal(size=64)).astype("f4").tolist()
    rows += [((i := i + 1), copy) for _ in range(120)]
    rows += [((i := i + 1), u(rng.normal(size=64)).astype("f4").tolist()) for _ in range(singles)]
    bad = [None, [0.0] * 64, [1.0] * 63, [float("nan")] + [1.0] * 63, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63]
    return rows, [((i := i + 1), v) for v in bad] + [(None, copy)]


def brute(rows):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype="f8")
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T
    near, closed = {}, set()
    hoods = defaultdict(list)
    for i in range(len(ids)):
        c = [j for j in np.flatnonzero(s[i] >= 0.85) if j != i]
        near[ids[i]] = [ids[j] for j in sorted(c, key=lambda j: (-round(s[i, j], 6), ids[j]))[:5]]
        hoods[tuple(sorted([i, *c]))].append(i)
    for h, m in hoods.items():
        if len(h) >= 3 and len(m) == len(h):
            closed |= {(int(ids[h[0]]), int(ids[k])) for k in h}
    return near, closed


@pytest.mark.parametrize("block", [40, 4096])
def test_nearest_and_clusters(spark, block):
    good, bad = data()
    near, closed = brute(good)
    df = spark.createDataFrame(good + bad, "id bigint, v array<float>").withColumns({"vec": F.lit(1), "k1": F.lit(2)}).repartition(3)
    base = vectors.valid_vectors(df, "id", "v", 64)
    assert base.count() == len(good)
    got = {r.id: [n.id for n in r.neighbours] for r in neighbours.nearest(base, 5, 0.85, block_rows=block).collect()}
    want = {k: v for k, v in near.items() if v}
    hit = sum(len(set(got.get(k, [])) & set(v)) for k, v in want.items())
    assert hit >= (0.95 if block == 40 else 0.99) * sum(map(len, want.values()))  # small blocks split a set of look-alikes
    assert all(k not in v for k, v in got.items())
    out = clusters.density_peaks(base, 0.85, block_rows=block).collect()
    assert {(r.cluster_id, r.id) for r in out if r.closed and r.size >= 3} == closed
    assert len({r.id for r in out}) == len(out)


def test_any_k_and_copies(spark):
    good, bad = data(groups=5, singles=60)
    base = vectors.valid_vectors(spark.createDataFrame(good + bad, "id bigint, v array<float>").repartition(3), "id", "v", 64)
    ids, x = np.array([r[0] for r in good]), np.array([r[1] for r in good], dtype="f8")
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = np.round(x @ x.T, 6)
    want = {}
    for i, me in enumerate(ids):
        want[me] = [ids[j] for j in sorted((j for j in range(len(ids)) if j != i and s[i, j] >= 0.85), key=lambda j: (-s[i, j], ids[j]))[:20]]
    got = {r.id: [n.id for n in r.neighbours] for r in neighbours.nearest(base, 20, 0.85).collect()}
    assert sum(len(set(got.get(k, [])) & set(v)) for k, v in want.items()) >= 0.99 * sum(map(len, want.values()))
    assert all(len(v) == 20 for v in neighbours.nearest_of_all(base, 20).select("neighbours.id").toPandas()["id"])


def test_sample_of_any_size(spark):
    """An index told of so many rows that one in five million is sampled still gets a sample, and lists enough."""
    rows = 1_400_000_000_000
    share = vectors.MOST_SAMPLE / rows
    assert 2 <= spark.range(50_000_000).filter(vectors.hashed_share(["id"], share)).count() <= 25
    x = np.random.default_rng(8).normal(size=(9000, 64)).astype("f4")
    index = vectors.fit(x, rows, 0.85, False, most_lists=4096)
    assert len(index.points) == 4096 and len(index.parts) == vectors.MOST_PARTS and index.more() == 6


def test_second_level_of_lists():
    rng = np.random.default_rng(2)
    u = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    centre = u(rng.normal(size=(30, 64)))
    mean = u(centre[rng.integers(0, 30, 1500)] + 0.06 * rng.normal(size=(1500, 64)))
    x = u(np.concatenate([mean + 0.02 * rng.normal(size=mean.shape) for _ in range(4)])).astype("f4")
    index = vectors.fit(x, len(x), 0.85, False, list_rows=20, block_rows=20, most_lists=24)
    assert len(index.points) == 24 and len(index.parts) >= 10
    near, sims = index.lists(vectors.unit(x), 4)
    assert near.max() < 24 * len(index.parts) and (np.diff(sims, axis=1) <= 1e-6).all()
    lists = [set(r) for r in near]
    same = [len(lists[i] & lists[i + 1500]) > 0 for i in range(1500)]
    assert np.mean(same) > 0.95  # look-alikes share a list
    assert np.bincount(near[:, 0]).max() < 600


@pytest.mark.parametrize("rows", [5, 200, 9000])
def test_search_finds_the_nearest_lists(rows):
    """Scattered centroids: the lists of a vector are those of the most similar ones, not of those that a walk comes upon."""
    x = vectors.unit(np.random.default_rng(6).normal(size=(rows, 64))).astype("f4")
    index = vectors.fit(x, rows, 0.85, False, list_rows=1)
    q = vectors.unit(np.random.default_rng(7).normal(size=(300, 64)))
    near, sims = index.search(q, 5)
    s = q.astype("f4") @ index.points.T
    best = np.sort(s, axis=1)[:, ::-1][:, :5]
    assert near.shape == (300, 5) and np.allclose(sims, best, atol=1e-6)
    assert np.allclose(np.take_along_axis(s, near, 1), sims, atol=1e-6)


@pytest.mark.parametrize("block", [2, 4096])
def test_clusters_across_lists(spark, monkeypatch, block):
    """Two lists; the outer members of a cluster stand in one of them each, so their pair is met in none."""
    way = lambda degrees: np.cos(np.radians(degrees)) * np.eye(64)[0] + np.sin(np.radians(degrees)) * np.eye(64)[1]
    fitted = vectors.fit(np.stack([way(0), way(60)]), 2, 0.85, False)
    monkeypatch.setattr(clusters, "fit_index", lambda *a: fitted)
    monkeypatch.setattr(clusters, "post", lambda base, index, r, p, *a: vectors.post(base, index, 2, 2, *a))
    found = lambda rows: clusters.density_peaks(vectors.valid_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in rows], "id bigint, v array<float>"), "id", "v", 64), 0.85, block_rows=block).collect()
    whole = [(7, way(18)), (2, way(30)), (5, way(42)), (9, way(42)), (4, way(17)), (8, way(-60))]
    out = found(whole)
    assert {(r.cluster_id, r.id) for r in out if r.closed and r.size == 5} == {(2, i) for i in (2, 4, 5, 7, 9)} and len(out) == 5
    s = np.stack([v for _, v in whole[:5]]) @ np.stack([v for _, v in whole[:5]]).T
    assert np.allclose([r.closeness for r in sorted(out, key=lambda r: r.id)], s.mean(axis=1)[[1, 4, 2, 0, 3]], atol=1e-6)
    out = found([*whole, (1, way(5))])  # near some of them only
    assert not any(r.closed for r in out) and {r.id for r in out} == {1, 2, 4, 5, 7, 9}


def test_empty(spark):
    base = vectors.valid_vectors(spark.createDataFrame([(1, None)], "id bigint, v array<float>"), "id", "v", 64)
    assert neighbours.nearest(base, 5, 0.85).count() == 0
    assert clusters.density_peaks(base, 0.85).count() == 0


def test_recall_without_threshold(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(40, 64))
    x = (centre[rng.integers(0, 40, 3000)] + 0.6 * rng.normal(size=(3000, 64))).astype("f4")
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    base = vectors.valid_vectors(spark.createDataFrame(rows, "id bigint, v array<float>"), "id", "v", 64)
    got = {r.id: {n.id for n in r.neighbours} for r in neighbours.nearest(base, 5, -1.0).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    true = np.argsort(-s, axis=1)[:, :5]
    assert np.mean([len(got.get(i, set()) & set(true[i].tolist())) / 5 for i in range(3000)]) >= 0.9


@pytest.mark.parametrize("block", [60, 32_768])
def test_nearest_of_all_is_exact(spark, block):
    good, bad = data()
    df = spark.createDataFrame(good + bad, "id bigint, v array<float>").repartition(3)
    base = vectors.valid_vectors(df, "id", "v", 64)
    got = {r.id: [(x.id, x.similarity) for x in r.neighbours] for r in neighbours.nearest_of_all(base, 5, block).collect()}
    ids, x = np.array([r[0] for r in good]), np.array([r[1] for r in good], dtype="f8")
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = np.round(x @ x.T, 6)
    assert len(got) == len(good)
    for i, me in enumerate(ids):
        best = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[i, j], ids[j]))[:5]
        assert [n for n, _ in got[me]] == [ids[j] for j in best]
    assert neighbours.nearest_of_all(base.limit(0), 5).count() == 0


def test_p4_neighbours_of_scattered_pages(spark, tmp_path):
    good, _ = data(groups=0)
    spark.createDataFrame(good, "id bigint, latent_vector array<float>").write.parquet(str(tmp_path / "geniza_image_latents.parquet"))
    rows = neighbours.p4_neighbours(spark, str(tmp_path)).groupBy("id").count().collect()
    assert len(rows) == len(good) and all(r["count"] == 5 for r in rows)
