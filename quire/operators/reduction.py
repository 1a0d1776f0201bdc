"""Principal components, correlation, and linear models over vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from quire.functions.vectors import unit, valid


def moments(rows: DataFrame, vector: str, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, sum and sum of outer products of the vectors: partial sums per batch, one small total (dim x dim)."""
    import pyarrow as pa

    v = rows.filter(valid(vector)).select(F.col(vector).cast("array<double>").alias("v")).filter(F.size("v") == dim)

    def part(batches):
        n, s, o = 0, np.zeros(dim), np.zeros((dim, dim))
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            n, s, o = n + len(x), s + x.sum(axis=0), o + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()]), pa.array([o.ravel().tolist()])], names=["n", "s", "o"])

    parts = v.mapInArrow(part, "n bigint, s array<double>, o array<double>")
    flat = parts.select("n", F.posexplode(F.concat("s", "o")).alias("p", "x")).groupBy("p").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()
    total = np.zeros(dim + dim * dim)
    for r in flat:
        total[r["p"]] = r["x"]
    return (int(flat[0]["n"]) if flat else 0), total[:dim], total[dim:].reshape(dim, dim)


def pca(rows: DataFrame, item: str, vector: str, components: int, width: int | None = None) -> DataFrame:
    """(item, vec): coordinates on the first components, centred, not whitened, at unit length, padded with zeros to width.

    The covariance comes from partial sums; its eigenvectors (dim x components) are all that is sent to the tasks.
    Each component's largest entry is positive. Rows with an invalid vector are left out.
    """
    dim = rows.filter(valid(vector)).select(F.size(vector)).first()[0]
    n, s, o = moments(rows, vector, dim)
    mean = s / n
    values, vectors = np.linalg.eigh(o / n - np.outer(mean, mean))
    axes = vectors[:, np.argsort(-values)[:components]]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    import pyarrow as pa

    good = rows.filter(valid(vector)).select(F.col(item).alias("item"), F.col(vector).cast("array<double>").alias("v")).filter(F.size("v") == dim)

    def project(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(((x - mean) @ axes).tolist(), pa.list_(pa.float64()))], names=["item", "vec"])

    kind = rows.schema[item].dataType.simpleString()
    out = good.mapInArrow(project, f"item {kind}, vec array<double>").select(F.col("item").alias(item), unit("vec").alias("vec"))
    pad = (width or components) - components
    return out.withColumn("vec", F.concat("vec", F.array_repeat(F.lit(0.0), pad))) if pad > 0 else out


def explained(rows: DataFrame, vector: str, dim: int) -> DataFrame:
    """(component, share, cumulative) of the variance."""
    n, s, o = moments(rows, vector, dim)
    values = np.sort(np.linalg.eigvalsh(o / n - np.outer(s / n, s / n)))[::-1]
    share = values / values.sum()
    return rows.sparkSession.createDataFrame([(i + 1, float(a), float(b)) for i, (a, b) in enumerate(zip(share, share.cumsum()))], "component int, share double, cumulative double")


def correlation(rows: DataFrame, vector: str, dims: int) -> DataFrame:
    """(i, j, r) of the first dims dimensions, counted from 1."""
    n, s, o = moments(rows.withColumn("_v", F.slice(F.col(vector).cast("array<double>"), 1, dims)), "_v", dims)
    cov = o / n - np.outer(s / n, s / n)
    d = np.sqrt(np.diag(cov))
    r = cov / np.outer(d, d)
    return rows.sparkSession.createDataFrame([(i + 1, j + 1, float(r[i, j])) for i in range(dims) for j in range(dims)], "i bigint, j bigint, r double")


def ridge(rows: DataFrame, vector: str, target: str, dim: int, alpha: float, weight: str | None = None) -> tuple[np.ndarray, float]:
    """Coefficients on standardised features and the intercept, from moments of (features, target) alone."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    z = rows.filter(F.col(target).isNotNull()).select(F.transform(F.concat(F.col(vector).cast("array<double>"), F.array(F.col(target).cast("double"), F.lit(1.0))), lambda x: x * F.sqrt(w)).alias("_z"))
    coef, scale, intercept = _ridge_from(moments(z, "_z", dim + 2)[2], dim, alpha)
    return coef, intercept


def _ridge_from(o: np.ndarray, dim: int, alpha: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients on standardised features, the features' scales and the intercept from second moments of (features, target, 1)."""
    total = o[-1, -1]
    mean = o[:-1, -1] / total
    cov = o[:-1, :-1] - total * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov)[:dim] / total, 1e-24))
    a = cov[:dim, :dim] / np.outer(scale, scale) + alpha * np.eye(dim)
    coef = np.linalg.solve(a, cov[:dim, dim] / scale)
    return coef, scale, float(mean[dim] - (coef / scale * mean[:dim]).sum())


def ridge_by_folds(rows: DataFrame, vector: str, target: str, fold: str, dim: int, alphas: list[float]) -> tuple[float, DataFrame]:
    """The alpha of the least mean absolute error out of fold (the smaller on a tie), and rows with its predictions out of fold (_p).

    One set of moments per fold; what a fold is predicted with comes from the moments of the others. fold: 0, 1, ...; rows
    without a fold or a target are left out.
    """
    rows = rows.filter(F.col(fold).isNotNull() & F.col(target).isNotNull() & valid(vector))
    z = rows.withColumn("_z", F.concat(F.col(vector).cast("array<double>"), F.array(F.col(target).cast("double"), F.lit(1.0))))
    names = sorted(r[0] for r in rows.select(fold).distinct().collect())
    parts = {f: moments(z.filter(F.col(fold) == f), "_z", dim + 2)[2] for f in names}
    x = F.col(vector).cast("array<double>")

    def predicted(alpha: float):
        out = None
        for f in names:
            coef, scale, intercept = _ridge_from(sum(parts[g] for g in names if g != f), dim, alpha)
            w = F.array(*[F.lit(float(c)) for c in coef / scale])
            p = F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(intercept), lambda a, b: a + b)
            out = F.when(F.col(fold) == f, p) if out is None else out.when(F.col(fold) == f, p)
        return out

    errors = rows.agg(*[F.avg(F.abs(predicted(a) - F.col(target))).alias(f"e{i}") for i, a in enumerate(alphas)]).first()
    best = min(sorted(range(len(alphas)), key=lambda i: alphas[i]), key=lambda i: errors[i])
    return alphas[best], rows.withColumn("_p", predicted(alphas[best]))


def logistic_by_folds(rows: DataFrame, vector: str, label: str, fold: str, choices: list[float]) -> tuple[float, float]:
    """The C of the highest ROC-AUC out of fold (the smaller on a tie) and that AUC."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from quire.operators.metrics import roc_auc

    names = sorted(r[0] for r in rows.filter(F.col(fold).isNotNull()).select(fold).distinct().collect())
    found = []
    for c in sorted(choices):
        out = None
        for f in names:
            model = logistic(rows.filter(F.col(fold) != f), vector, label, c=c)
            held = rows.filter(F.col(fold) == f).select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col(label).alias("y"))
            one = model.transform(held).select("y", vector_to_array("probability")[1].alias("s"))
            out = one if out is None else out.unionByName(one)
        found.append((c, roc_auc(out, "s", F.col("y") == 1).first()[0]))
    return max(found, key=lambda x: (round(x[1], 12), -x[0]))


def logistic(rows: DataFrame, vector: str, label: str, weight: str | None = None, c: float = 1.0):
    """A fitted Spark ML logistic regression (L2, regularisation 1 / c per row) on standardised features."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    data = rows.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"), (F.col(weight) if weight else F.lit(1.0)).alias("w"))
    return LogisticRegression(regParam=1.0 / (c * max(1, data.count())), weightCol="w", standardization=True).fit(data)


def temperature(rows: DataFrame, logits: str, label: str, low: float = 0.05, high: float = 10.0, steps: int = 60) -> float:
    """The temperature of the least log loss: one scan evaluates a grid of them, a second one a finer grid around the best."""
    for _ in range(2):
        grid = [float(x) for x in np.geomspace(low, high, steps)]
        v = F.col(logits).cast("array<double>")
        top = F.array_max(v)
        loss = lambda t: F.avg(F.log(F.aggregate(F.transform(v, lambda x: F.exp((x - top) / t)), F.lit(0.0), lambda s, x: s + x)) - (F.get(v, F.col(label)) - top) / t)
        found = rows.agg(*[loss(t).alias(f"t{i}") for i, t in enumerate(grid)]).first()
        best = min(range(steps), key=lambda i: found[i])
        low, high = grid[max(0, best - 1)], grid[min(steps - 1, best + 1)]
    return (low * high) ** 0.5
