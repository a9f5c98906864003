"""Leakage-free folds, fixed linear models and principal components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def holdout_folds(rows: DataFrame, locus: str, gene: str) -> DataFrame:
    """One row per locus held out: test rows, train rows left once rows sharing a test gene are excluded, and excluded.

    A training row is lost to a fold when its gene occurs in the held-out locus; counting those per (locus, gene) avoids
    pairing every row with every fold.
    """
    per = rows.groupBy(locus, gene).agg(F.count("*").alias("n"))
    genes = per.groupBy(gene).agg(F.sum("n").alias("everywhere"))
    fold = per.join(genes, gene).groupBy(locus).agg(F.sum("n").alias("test"), F.sum(F.col("everywhere") - F.col("n")).alias("excluded"))
    total = rows.agg(F.count("*").alias("total"))
    return fold.join(F.broadcast(total)).select(locus, "test", "excluded", (F.col("total") - F.col("test") - F.col("excluded")).alias("train"))


def linear_score(terms: dict[str, tuple[Column, float, float, float]], intercept: float) -> tuple[dict[str, Column], Column]:
    """name -> (value, mean, scale, coefficient): each contribution z * coefficient, and their sum with the intercept."""
    parts = {n: ((F.coalesce(v, F.lit(0.0)) - m) / s * c if s else F.lit(0.0)) for n, (v, m, s, c) in terms.items()}
    return parts, sum(parts.values(), F.lit(intercept))


def principal_components(vectors: DataFrame, column: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mean, population scale, components (k x d) and explained variance of standardised vectors.

    One aggregation of d * d moments, whose size is fixed by the dimension; signs make each component's largest entry
    positive.
    """
    d = vectors.select(F.max(F.size(column))).first()[0] or 0
    v = vectors.where(F.size(column) == d).select(column)

    def moments(batches):
        import pyarrow as pa

        n, s, q = 0, np.zeros(d), np.zeros((d, d))
        for b in batches:
            x = np.asarray(b[0].flatten(), dtype=float).reshape(-1, d)
            n, s, q = n + len(x), s + x.sum(0), q + x.T @ x
        yield pa.RecordBatch.from_pydict({"n": [n], "s": [s.tolist()], "q": [q.ravel().tolist()]})

    rows = v.mapInArrow(moments, "n long, s array<double>, q array<double>").collect()
    n = sum(r["n"] for r in rows)
    mean = np.sum([r["s"] for r in rows], axis=0) / n
    cov = np.sum([r["q"] for r in rows], axis=0).reshape(d, d) / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov), 0))
    safe = np.where(scale > 0, scale, 1.0)
    value, vector = np.linalg.eigh(cov / np.outer(safe, safe))
    top = np.argsort(-value)[:k]
    components = vector[:, top].T
    components *= np.sign(components[np.arange(len(top)), np.abs(components).argmax(1)])[:, None]
    return mean, safe, components, value[top] * n / max(1, n - 1)


def project(vectors: DataFrame, column: str, model: tuple, name: str = "pcs") -> DataFrame:
    mean, scale, components, _ = model
    weights = components / scale
    shift = weights @ mean
    parts = [F.aggregate(F.zip_with(column, F.array(*[F.lit(float(w)) for w in row]), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x) - float(s) for row, s in zip(weights, shift, strict=True)]
    return vectors.withColumn(name, F.array(*parts))


def balanced_logistic(train: DataFrame, features: list[str], label: str, c: float = 1.0, l1_share: float = 0.0) -> tuple[np.ndarray, float] | None:
    """Coefficients and intercept on raw features of a class-balanced logistic regression in the 1 / C form, fitted on
    features standardised with population deviations; null without both classes."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    stats = train.agg(F.count("*").alias("n"), F.sum(label).alias("p"), *[f(x).alias(f"{k}_{x}") for x in features for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    n, p = stats["n"], stats["p"] or 0
    if not 0 < p < n:
        return None
    mean = np.array([stats[f"m_{x}"] for x in features])
    scale = np.array([stats[f"s_{x}"] or 1.0 for x in features])
    z = train.select(F.col(label).cast("double").alias("label"), F.when(F.col(label) == 1, n / (2 * p)).otherwise(n / (2 * (n - p))).alias("w"), *[((F.col(x) - float(m)) / float(s)).alias(x) for x, m, s in zip(features, mean, scale, strict=True)])
    fit = LogisticRegression(weightCol="w", regParam=1 / (c * n), elasticNetParam=l1_share, standardization=False, maxIter=200, tol=1e-10).fit(VectorAssembler(inputCols=features, outputCol="features").transform(z))
    coef = fit.coefficients.toArray() / scale
    return coef, float(fit.intercept - coef @ mean)


def fold_logistics(df: DataFrame, fold: str, folds: int, features: list[str], label: str, c: float = 1.0) -> list[tuple[np.ndarray, float] | None]:
    """balanced_logistic without an L1 part for every fold held out in turn, all folds together: Newton's method, whose every
    step is one pass over the rows, with (folds * d * d) sums added up before the driver sees them. Rows with a null fold
    train no model; a null or NaN feature or label is an error; folds whose training rows lack a class are None."""
    d = len(features)
    part = F.when(F.col(fold).between(0, folds - 1), F.col(fold)).otherwise(-1).cast("int")
    rows = df.where(F.col(fold).isNotNull()).select(part.alias("f"), F.col(label).cast("double").alias("y"), *[F.col(x).cast("double").alias(f"x{i}") for i, x in enumerate(features)]).persist()
    try:
        names = [f"x{i}" for i in range(d)]
        bad = F.lit(False)
        for x in ["y", *names]:
            bad = bad | F.col(x).isNull() | F.isnan(x)
        per = rows.groupBy("f").agg(F.count("*").alias("n"), F.sum((F.col("y") == 1).cast("long")).alias("p"), F.count_if(bad).alias("bad"), F.array(*map(F.avg, names)).alias("m"), F.array(*map(F.var_pop, names)).alias("v")).collect()
        if any(r["bad"] for r in per):
            raise ValueError("features and labels must not be null or NaN")
        shape, at, found = {}, {}, [None] * folds
        for k in range(folds):
            own = [r for r in per if r["f"] != k]
            n, p = sum(r["n"] for r in own), sum(r["p"] for r in own)
            if 0 < p < n:
                mean = sum(r["n"] * np.array(r["m"], dtype=float) for r in own) / n
                scale = np.sqrt(sum(r["n"] * (np.array(r["v"], dtype=float) + (np.array(r["m"], dtype=float) - mean) ** 2) for r in own) / n)
                shape[k] = n, p, mean, np.where(scale > 1e-12 * np.abs(mean), scale, np.inf)  # a constant feature weighs nothing
                at[k] = np.zeros(d + 1), None, np.inf, 1.0  # last accepted point, direction, value there, step length
        for _ in range(100):
            trial = {k: w if move is None else w + t * move for k, (w, move, _, t) in at.items()}
            if not trial:
                break

            def sums(batches, trial=trial):
                import pyarrow as pa

                total = {k: np.zeros(1 + (d + 1) * (d + 2)) for k in trial}
                for b in batches:
                    f, y = np.asarray(b["f"]), np.asarray(b["y"])
                    x = np.stack([np.asarray(b[c]) for c in names], axis=1) if d else np.zeros((b.num_rows, 0))
                    for k, w in trial.items():
                        n, p, mean, scale = shape[k]
                        on = f != k
                        one = y[on] == 1
                        z = np.column_stack([(x[on] - mean) / scale, np.ones(on.sum())])
                        weight = np.where(one, n / (2 * p), n / (2 * (n - p))) / n
                        eta = z @ w
                        prob = 1 / (1 + np.exp(-np.clip(eta, -500, 500)))
                        curve = z.T @ (z * (weight * prob * (1 - prob))[:, None])
                        total[k] += np.concatenate([[weight @ (np.logaddexp(0, eta) - eta * one)], z.T @ (weight * (prob - one)), curve.ravel()])
                for k, v in total.items():
                    yield pa.RecordBatch.from_pydict({"k": pa.array(np.full(len(v), k), pa.int32()), "i": pa.array(np.arange(len(v)), pa.int32()), "v": v})

            got = {k: np.zeros(1 + (d + 1) * (d + 2)) for k in trial}
            for r in rows.mapInArrow(sums, "k int, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).collect():
                got[r["k"]][r["i"]] = r["v"]
            for k, w in trial.items():
                ridge = np.append(np.full(d, 1 / (c * shape[k][0])), 0.0)
                value = got[k][0] + ridge @ (w * w) / 2
                before, move, least, t = at[k]
                if value > least + 1e-12 and t > 1e-6:
                    at[k] = before, move, least, t / 2
                    continue
                slope = got[k][1 : d + 2] + ridge * w
                move = -np.linalg.lstsq(got[k][d + 2 :].reshape(d + 1, d + 1) + np.diag(ridge), slope, rcond=None)[0]
                at[k] = w, move, value, 1.0
                if np.abs(move).max() < 1e-9 or -(slope @ move) < 1e-16:
                    coef = w[:d] / shape[k][3]
                    found[k] = coef, float(w[d] - coef @ shape[k][2])
                    del at[k]
        for k, (w, *_) in at.items():  # not settled within the rounds: the best point so far
            coef = w[:d] / shape[k][3]
            found[k] = coef, float(w[d] - coef @ shape[k][2])
        return found
    finally:
        rows.unpersist()


def cross_validated_scores(df: DataFrame, fold: str, folds: int, features: list[str], label: str, c: float = 1.0, l1_share: float = 0.0) -> DataFrame:
    """Every row scored by the model of the other folds; folds whose training rows lack a class are skipped."""
    df = df.withColumn("fold__", F.col(fold))
    score = F.lit(None).cast("double")
    if l1_share:
        found = [balanced_logistic(df.where(F.col("fold__") != k), features, label, c, l1_share) for k in range(folds)]
    else:
        found = fold_logistics(df, "fold__", folds, features, label, c)
    for k, model in enumerate(found):
        if model is not None:
            score = F.when(F.col("fold__") == k, linear(model, features)).otherwise(score)
    return df.withColumn("linear_score", score).drop("fold__")


def offset_logistic(df: DataFrame, vector: str, offset: str, label: str, l1: float = 0.0, l2: float = 0.0, iterations: int = 100, tolerance: float = 1e-7) -> np.ndarray:
    """Weights w of sigmoid(offset + x.w) by proximal gradient, without intercept. Rows without a vector add nothing.

    Every iteration is one pass that sends a gradient of the vector's length from each task.
    """
    rows = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("x"), F.col(offset).cast("double").alias("o"), F.col(label).cast("double").alias("y")).persist()
    try:
        size = rows.agg(F.max(F.size("x")), F.count("*"), F.sum(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))).first()
        d, n = size[0] or 0, size[1]
        w = np.zeros(d)
        if not n:
            return w
        step = 1 / (size[2] / (4 * n) + l2)  # the trace bounds the largest eigenvalue
        for _ in range(iterations):

            def gradient(batches, w=w):
                import pyarrow as pa

                g = np.zeros(d)
                for b in batches:
                    x = np.asarray(b["x"].flatten(), dtype=float).reshape(-1, d)
                    p = 1 / (1 + np.exp(-np.clip(np.asarray(b["o"]) + x @ w, -50, 50)))
                    g += x.T @ (p - np.asarray(b["y"]))
                yield pa.RecordBatch.from_pydict({"g": [g.tolist()]})

            g = np.sum([r["g"] for r in rows.mapInArrow(gradient, "g array<double>").collect()], axis=0) / n + l2 * w
            moved = w - step * g
            moved = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0)
            if np.abs(moved - w).max() < tolerance:
                return moved
            w = moved
        return w
    finally:
        rows.unpersist()


def sparsest_within(bench: DataFrame, metric: str, sparsity: str, tolerance: float, ties: list) -> DataFrame:
    """The row with the fewest non-zero coefficients among those within `tolerance` of the best metric."""
    best = bench.agg(F.max(metric).alias("best__"))
    return bench.join(F.broadcast(best)).where(F.col(metric) >= F.col("best__") - tolerance).drop("best__").orderBy(sparsity, *ties).limit(1)


def bootstrap(df: DataFrame, key: str, resamples: int, statistic, seed: int = 42) -> DataFrame:
    """One row per resample of statistic (an aggregate of the weight column `w`): Poisson(1) weights by hash of the key,
    so no resample is ever gathered in one place."""
    u = (F.pmod(F.xxhash64(F.col(key), "resample", F.lit(seed)), F.lit(1 << 30)) + 0.5) / (1 << 30)
    cuts, total, p = [], 0.0, float(np.exp(-1))
    for k in range(8):
        total += p
        p /= k + 1
        cuts.append(total)
    w = sum(((u > c).cast("int") for c in cuts), F.lit(0))
    return df.withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("w", w).groupBy("resample").agg(statistic.alias("statistic"))


def saved_model_scores(df: DataFrame, model: DataFrame, intercept: float, key: str) -> DataFrame:
    """df with `linear_score` of a saved model(feature, coefficient, mean, scale). Features that df lacks count as 0 before
    scaling; a zero or missing scale leaves its feature out. The model has one row a feature and is read by the driver."""
    terms = {}
    for r in model.collect():
        value = F.col(r["feature"]).cast("double") if r["feature"] in df.columns else F.lit(0.0)
        terms[r["feature"]] = (value, r["mean"], r["scale"], r["coefficient"])
    return df.withColumn("linear_score", linear_score(terms, intercept)[1])


def top_contributions(parts: dict[str, Column], k: int) -> Column:
    """The k largest contributions by absolute value, ties by name, as "name=value; ..." with 4 digits."""
    items = F.array(*[F.struct((-F.abs(v)).alias("a"), F.lit(n).alias("n"), v.alias("v")) for n, v in parts.items()])
    return F.array_join(F.transform(F.slice(F.array_sort(items), 1, k), lambda x: F.concat(x["n"], F.lit("="), F.format_string("%.4f", x["v"]))), "; ")


def feature_group(feature: Column, groups: dict[str, list[str]], other: str = "other") -> Column:
    """The first group any of whose prefixes starts the feature's name."""
    out = F.lit(other)
    for name, prefixes in reversed(groups.items()):
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | feature.startswith(p)
        out = F.when(hit, name).otherwise(out)
    return out


def fold_statuses(df: DataFrame, fold: str, label: str, excluded: Column | None = None) -> DataFrame:
    """Per fold: train and test rows, positives of both, and its status: ok, or why it is skipped."""
    folds = df.select(F.col(fold).alias("f")).distinct()
    per = df.groupBy(F.col(fold).alias("f")).agg(F.count("*").alias("n_test"), F.sum(label).alias("test_positives"))
    total = per.agg(F.sum("n_test").alias("n"), F.sum("test_positives").alias("p"))
    d = folds.join(per, "f").join(F.broadcast(total)).select("f", "n_test", "test_positives", (F.col("n") - F.col("n_test")).alias("n_train"), (F.col("p") - F.col("test_positives")).alias("train_positives"))
    one = lambda p, n: (F.col(p) == 0) | (F.col(p) == F.col(n))
    status = F.when(F.col("n_train") == 0, "skipped_empty_train").when(one("train_positives", "n_train"), "skipped_single_class_train").when(one("test_positives", "n_test"), "ok_single_class_test").otherwise("ok")
    return d.select(F.col("f").alias(fold), "n_train", "n_test", "train_positives", "test_positives", status.alias("status"))


def stacked_scores(df: DataFrame, fold: str, folds: int, base: list[str], second: list[str], label: str, **options) -> DataFrame:
    """Two stages: out-of-fold scores of `base`, then a model of that score and `second`, each fold scored by the others."""
    first = cross_validated_scores(df, fold, folds, base, label, **options).withColumnRenamed("linear_score", "baseline_score").where("baseline_score is not null")
    return cross_validated_scores(first, fold, folds, ["baseline_score", *second], label, **options)


def parse_c_grid(text: str) -> list[float]:
    """Distinct positive numbers of a comma-separated list, ascending."""
    out = sorted({float(x) for x in text.split(",") if x.strip()})
    if not out or out[0] <= 0:
        raise ValueError("C values must be positive")
    return out


def c_sweep(df: DataFrame, fold: str, folds: int, features: list[str], label: str, grid: list[float], l1_share: float = 1.0) -> DataFrame:
    """C, fold, selected (non-zero coefficients) of each fold's model."""
    rows = []
    for c in grid:
        for f in range(folds):
            m = balanced_logistic(df.where(F.col(fold) != f), features, label, c, l1_share)
            if m is not None:
                rows.append((c, f, int((np.abs(m[0]) > 1e-8).sum())))
    return df.sparkSession.createDataFrame(rows, "c double, fold int, selected int")


def learning_curve(df: DataFrame, key: str, fold: str, held: int, features: list[str], label: str, steps: int = 10, seed: int = 42) -> DataFrame:
    """train_rows and the mean log-loss on fold `held` of models of growing nested shares of the other folds."""
    from .statistics import shuffled

    part = F.conv(F.substring(shuffled(F.col(key), F.lit(seed)), 1, 8), 16, 10).cast("double") / (1 << 32)
    train, test, rows = df.where(F.col(fold) != held).withColumn("part__", part), df.where(F.col(fold) == held), []
    for i in range(1, steps + 1):
        some = train.where(F.col("part__") < i / steps)
        m = balanced_logistic(some, features, label)
        if m is not None:
            z = sum((F.col(x) * float(w) for x, w in zip(features, m[0], strict=True)), F.lit(m[1]))
            loss = F.log1p(F.exp(-F.when(F.col(label) == 1, z).otherwise(-z)))
            rows.append((i / steps, some.count(), test.agg(F.avg(loss)).first()[0]))
    return df.sparkSession.createDataFrame(rows, "share double, train_rows long, loss double")


def split_views(vector: Column, dim: int) -> tuple[Column, Column]:
    """The halves of a concatenated vector."""
    if dim % 2:
        raise ValueError("the dimension is odd")
    return F.slice(vector, 1, dim // 2), F.slice(vector, dim // 2 + 1, dim // 2)


def has_embedding(vector: Column, eps: float = 1e-12) -> Column:
    """Whether any component differs from 0."""
    return F.coalesce(F.exists(vector, lambda x: F.abs(x) > eps), F.lit(False))


def reliable_negatives(bags: DataFrame, key: str, size: str, excluded: DataFrame, needed: int, most: int) -> DataFrame:
    """`needed` keys of small bags (at most `most`) that aren't excluded, drawn by a seeded order."""
    from .statistics import shuffled

    out = bags.where((F.col(size) > 0) & (F.col(size) <= most)).join(excluded.select(key).distinct(), key, "left_anti")
    return out.orderBy(shuffled(F.col(key), F.lit(42)), key).limit(needed)


def attention_pool(instances: DataFrame, bag: str, score: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """Softmax of the scores within each bag, without ever holding a bag: its maximum, then its normaliser, then the
    weights. Returns instances with `attention`, and (bag, vector), the weighted mean."""
    top = instances.groupBy(bag).agg(F.max(score).alias("top__"))
    shifted = instances.join(top, bag).withColumn("e__", F.exp(F.col(score) - F.col("top__")))
    total = shifted.groupBy(bag).agg(F.sum("e__").alias("total__"))
    weighted = shifted.join(total, bag).withColumn("attention", F.col("e__") / F.col("total__")).drop("e__", "top__", "total__")
    parts = weighted.select(bag, "attention", F.posexplode(vector).alias("i", "x")).groupBy(bag, "i").agg(F.sum(F.col("attention") * F.col("x")).alias("x"))
    return weighted, parts.groupBy(bag).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))


def gated_score(vector: str, v: np.ndarray, u: np.ndarray, w: np.ndarray) -> Column:
    """w . (tanh(V x) * sigmoid(U x)), the attention score of one instance."""
    dot = lambda row: F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(c)) for c in row]), lambda x, c: x * c), F.lit(0.0), lambda a, x: a + x)
    return sum((F.lit(float(c)) * F.tanh(dot(a)) / (1 + F.exp(-dot(b))) for a, b, c in zip(v, u, w, strict=True)), F.lit(0.0))


def attention_mass(weighted: DataFrame, bag: str, tops: tuple[int, ...] = (1, 10, 50), eps: float = 1e-6) -> DataFrame:
    """Per bag: the attention held by its top instances, and the share of instances with next to none."""
    from pyspark.sql import Window

    r = weighted.withColumn("r__", F.row_number().over(Window.partitionBy(bag).orderBy(F.desc("attention"))))
    return r.groupBy(bag).agg(F.count("*").alias("n"), *[F.sum(F.when(F.col("r__") <= k, F.col("attention")).otherwise(0.0)).alias(f"top_{k}") for k in tops], F.avg((F.col("attention") < eps).cast("double")).alias("near_zero"))


def word_vectors(docs: DataFrame, tokens: str, dim: int = 200, window: int = 5, least: int = 5, rounds: int = 15, seed: int = 42) -> DataFrame:
    """(word, vector) by skip-gram (with hierarchical softmax, Spark's form of it). The model, like its vocabulary, is held
    by the driver; `least` bounds the vocabulary."""
    from pyspark.ml.feature import Word2Vec

    model = Word2Vec(vectorSize=dim, windowSize=window, minCount=least, maxIter=rounds, seed=seed, stepSize=0.05, inputCol=tokens, outputCol="v__").fit(docs.select(tokens))
    from pyspark.ml.functions import vector_to_array

    return model.getVectors().select("word", vector_to_array("vector").alias("vector"))


def document_vectors(docs: DataFrame, key: str, tokens: str, vectors: DataFrame) -> DataFrame:
    """(key, n, vector): the mean vector of a document's known words, every occurrence counted."""
    words = docs.select(F.col(key), F.explode(tokens).alias("word")).groupBy(key, "word").agg(F.count("*").alias("c"))
    hit = words.join(vectors, "word").select(key, "c", F.posexplode("vector").alias("i", "x"))
    parts = hit.groupBy(key, "i").agg(F.sum("c").alias("n"), (F.sum(F.col("c") * F.col("x")) / F.sum("c")).alias("x"))
    return parts.groupBy(key).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))


def with_components(df: DataFrame, vector: str, dim: int, prefix: str = "e") -> tuple[DataFrame, list[str]]:
    """df with a column for each component of a vector, and their names."""
    names = [f"{prefix}{i}" for i in range(dim)]
    return df.withColumns({n: F.get(vector, F.lit(i)).cast("double") for i, n in enumerate(names)}), names


def linear(model: tuple[np.ndarray, float], features: list[str]) -> Column:
    return sum((F.col(x) * float(w) for x, w in zip(features, model[0], strict=True)), F.lit(model[1]))


def scored_universe(df: DataFrame, key: str, fold: str, folds: int, features: list[str], label: str, **options) -> DataFrame:
    """df (fold and label null off the gold set) with `linear_score` and `rank`: gold rows scored by the other folds' model,
    all others by the model of the whole gold set."""
    from .ranking import distributed_row_number

    gold = df.where(F.col(label).isNotNull())
    inside = cross_validated_scores(gold, fold, folds, features, label, **options)
    full = balanced_logistic(gold, features, label, **options)
    if full is None:
        raise ValueError("the gold set has one class only")
    outside = df.where(F.col(label).isNull()).withColumn("linear_score", linear(full, features))
    both = inside.union(outside.select(*inside.columns))
    return distributed_row_number(both, [F.desc_nulls_last("linear_score"), F.asc(key)], "rank")


def survivors(df: DataFrame, features: list[str], label: str, c: float = 0.1) -> list[str]:
    """Features with a non-zero coefficient under an L1 penalty."""
    m = balanced_logistic(df, features, label, c, 1.0)
    return [] if m is None else [f for f, w in zip(features, m[0], strict=True) if abs(w) > 1e-8]


def coefficient_table(df: DataFrame, features: list[str], label: str, **options) -> DataFrame:
    """feature, coefficient (on the raw feature) and the intercept as a row of its own: a refit on all rows, to be saved."""
    m = balanced_logistic(df, features, label, **options)
    if m is None:
        raise ValueError("one class only")
    return df.sparkSession.createDataFrame([*zip(features, map(float, m[0]), strict=True), ("intercept", m[1])], "feature string, coefficient double")


def compared(df: DataFrame, fold: str, folds: int, sets: dict[str, list[str]], label: str, universes: dict[str, Column], **options) -> DataFrame:
    """universe, model, n, positives, roc_auc, average_precision: each feature set cross-validated on each universe."""
    from .metrics import auc_by

    out = None
    for u, on in universes.items():
        for name, features in sets.items():
            scores = cross_validated_scores(df.where(on), fold, folds, features, label, **options).where("linear_score is not null")
            row = auc_by(scores.withColumn("g__", F.lit(1)), "g__", "linear_score", label).drop("g__").select(F.lit(u).alias("universe"), F.lit(name).alias("model"), "*")
            out = row if out is None else out.union(row)
    return out
