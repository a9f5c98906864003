import numpy as np
from pyspark.sql import functions as F

from evistrata.operators import models


def data(spark, n=400):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((n, 3)) * [1, 2, 0.5] + [0, 1, 3]
    o = rng.standard_normal(n) * 0.3
    y = (rng.random(n) < 1 / (1 + np.exp(-(o + x @ [0.8, -0.5, 0.2])))).astype(int)
    rows = [(i, *map(float, r), float(a), int(b)) for i, (r, a, b) in enumerate(zip(x, o, y, strict=True))]
    return spark.createDataFrame(rows, "i long, a double, b double, c double, o double, y int"), x, o, y


def test_balanced_logistic_meets_newton(spark):
    df, x, _, y = data(spark)
    coef, intercept = models.balanced_logistic(df, ["a", "b", "c"], "y", c=0.5)
    z = np.c_[np.ones(len(x)), (x - x.mean(0)) / x.std(0)]
    sw = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    w = np.zeros(4)
    pen = np.array([0, 1, 1, 1]) / 0.5
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ (z * (sw * p * (1 - p))[:, None]) + np.diag(pen), z.T @ (sw * (p - y)) + pen * w)
    assert np.allclose(coef, w[1:] / x.std(0), atol=1e-4) and np.isclose(intercept, w[0] - (w[1:] * x.mean(0) / x.std(0)).sum(), atol=1e-4)
    assert models.balanced_logistic(df.where("y = 1"), ["a"], "y") is None


def test_offset_logistic_meets_newton(spark):
    df, x, o, y = data(spark)
    w = models.offset_logistic(df.withColumn("x", F.array("a", "b", "c")), "x", "o", "y", l2=0.1, iterations=400, tolerance=1e-8)
    v = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(o + x @ v)))
        v -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) / len(y) + 0.1 * np.eye(3), x.T @ (p - y) / len(y) + 0.1 * v)
    assert np.allclose(w, v, atol=1e-4)


def test_principal_components_rebuild_the_covariance(spark):
    df, x, _, _ = data(spark)
    mean, scale, comps, var = models.principal_components(df.select(F.array("a", "b", "c").alias("v")), "v", 3)
    z = (x - x.mean(0)) / x.std(0)
    assert np.allclose(mean, x.mean(0)) and np.allclose(scale, x.std(0))
    assert np.allclose(comps.T @ np.diag(var) @ comps, np.cov(z.T), atol=1e-8)
    out = np.array([r["pcs"] for r in models.project(df.select("i", F.array("a", "b", "c").alias("v")), "v", (mean, scale, comps, var)).orderBy("i").collect()])
    assert np.allclose(out, z @ comps.T, atol=1e-8)


def test_bootstrap_spread(spark):
    df = spark.range(500).select("id", (F.col("id") % 2).alias("v"))
    got = [r["statistic"] for r in models.bootstrap(df, "id", 300, F.sum(F.col("w") * F.col("v")) / F.sum("w")).collect()]
    assert len(got) == 300 and abs(np.mean(got) - 0.5) < 0.01 and abs(np.std(got) - 0.5 / 500**0.5) < 0.004


def test_running_sums_and_row_numbers(spark):
    from evistrata.operators import ranking

    rng = np.random.default_rng(3)
    v = rng.integers(0, 5000, 20_000)
    d = spark.createDataFrame([(i, int(x)) for i, x in enumerate(v)], "id long, v long").repartition(7)
    rows = ranking.distributed_row_number(d, [F.desc("v"), F.asc("id")], "r").orderBy("r").collect()
    want = np.lexsort((np.arange(len(v)), -v))
    assert [r["r"] for r in rows] == list(range(1, len(v) + 1)) and [r["id"] for r in rows] == want.tolist()
    got = {r["id"]: r["avg_rank"] for r in ranking.distributed_average_rank(d, "v").collect()}
    values, counts = np.unique(v, return_counts=True)
    mean = dict(zip(values.tolist(), np.cumsum(counts) - (counts - 1) / 2, strict=True))
    assert all(got[i] == mean[int(x)] for i, x in enumerate(v))
    assert ranking.distributed_row_number(d.limit(0), [F.asc("v")], "r").count() == 0 == ranking.distributed_average_rank(d.limit(0), "v").count()


def test_fold_logistics_match_the_library(spark):
    """Newton's fits of all folds against Spark's own solver, fold by fold, with rows that have no fold."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2)) * [1, 50] + [0, 1000]
    y = (x[:, 0] + (x[:, 1] - 1000) / 80 + rng.normal(size=400) > 1.2).astype(int)
    df = spark.createDataFrame([(float(a), float(b), 7.0, int(t), None if i % 50 == 0 else i % 4) for i, ((a, b), t) in enumerate(zip(x, y, strict=True))], "a double, b double, same double, y int, f int")
    found = models.fold_logistics(df, "f", 3, ["a", "b", "same"], "y", 0.5)
    f = np.array([-9 if i % 50 == 0 else i % 4 for i in range(400)])
    for k, (coef, intercept) in enumerate(found):
        on = (f != k) & (f >= 0)
        n, p, mean, scale = on.sum(), y[on].sum(), x[on].mean(0), x[on].std(0)
        z = (x[on] - mean) / scale
        rows = [(float(a), float(b), float(t), float(n / (2 * p) if t else n / (2 * (n - p)))) for (a, b), t in zip(z, y[on], strict=True)]
        table = VectorAssembler(inputCols=["a", "b"], outputCol="v").transform(spark.createDataFrame(rows, "a double, b double, label double, w double"))
        fit = LogisticRegression(featuresCol="v", weightCol="w", regParam=1 / (0.5 * n), standardization=False, maxIter=200, tol=1e-12).fit(table)
        want = fit.coefficients.toArray() / scale
        assert np.allclose(coef[:2], want, rtol=1e-4) and coef[2] == 0
        assert np.isclose(intercept, fit.intercept - want @ mean, rtol=1e-3)
    assert models.fold_logistics(df.where("y = 1"), "f", 2, ["a"], "y") == [None, None]
    assert models.fold_logistics(df.limit(0), "f", 1, ["a"], "y") == [None]
