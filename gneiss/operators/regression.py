"""Linear models from one pass of sums, exhaustive search over feature subsets, and diagnostics.

A Gram matrix of all columns is p x p whatever the number of rows, so every subset's fit, and every fold's by difference, comes from
it without reading the data again.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gneiss.functions.distributions import chi2_cdf, f_cdf, t_cdf, t_quantile
from gneiss.operators.features import about, complete, gram, moments
from gneiss.operators.ranks import dealt_places
from gneiss.storage import durable

RIDGE = 1e-5


def solve(n: int, mean: np.ndarray, p: np.ndarray, own: list[int], y: int, ridge: float = RIDGE) -> tuple[float, np.ndarray]:
    """(intercept, slopes) on standardised columns' scale of penalty, returned in the columns' units."""
    scale = np.sqrt(np.diag(p)[own] / n)
    scale[scale == 0] = 1
    a = p[np.ix_(own, own)] / np.outer(scale, scale)
    slopes = np.linalg.solve(a + ridge * np.eye(len(own)), p[own, y] / scale) / scale
    return float(mean[y] - mean[own] @ slopes), slopes


def fit(df: DataFrame, features: list[str], target: str, ridge: float = RIDGE) -> dict:
    """Coefficients, standard errors, t and p values, R², adjusted R². Rows with a null in a feature or the target don't count."""
    columns = [*features, target]
    n, mean, p = gram(moments(df, columns).first(), columns)
    own, y = list(range(len(features))), len(features)
    intercept, slopes = solve(n, mean, p, own, y, ridge)
    sse = float(p[y, y] - 2 * slopes @ p[own, y] + slopes @ p[np.ix_(own, own)] @ slopes)
    k, r2 = len(features), 1 - sse / p[y, y]
    inverse = np.linalg.pinv(p[np.ix_(own, own)])
    s2 = sse / max(n - k - 1, 1)
    errors = np.sqrt(np.append(s2 * (1 / n + mean[own] @ inverse @ mean[own]), s2 * np.diag(inverse)))
    estimate = np.append(intercept, slopes)
    t = estimate / errors
    return {"n": n, "names": ["intercept", *features], "estimate": estimate, "error": errors, "t": t, "p": [2 * (1 - t_cdf(abs(v), n - k - 1)) for v in t], "r2": r2, "adj_r2": 1 - (1 - r2) * (n - 1) / (n - k - 1) if n > k + 1 else float("nan"), "sse": sse, "s2": s2, "inverse": inverse, "mean": mean[own]}


def predict(df: DataFrame, model: dict, name: str = "prediction", level: float | None = None, band: str = "prediction") -> DataFrame:
    """The prediction as a Column expression, with the bounds of its t interval where a level is given: of a new value, or (band
    "fit") of the mean. Null where a feature is null."""
    features, b = model["names"][1:], model["estimate"]
    value = F.lit(float(b[0]))
    for c, w in zip(features, b[1:], strict=True):
        value = value + F.col(c) * float(w)
    out = df.withColumn(name, value)
    if level is not None:
        spread = leverage(model) if band == "fit" else 1 + leverage(model)
        half = F.sqrt(F.lit(float(model["s2"])) * spread) * t_quantile((1 + level) / 2, model["n"] - len(features) - 1)
        out = out.withColumn("lower", F.col(name) - half).withColumn("upper", F.col(name) + half)
    return out


def leverage(model: dict):
    """The hat value of a row as a Column: 1/n + d' A d of the centred features."""
    features = model["names"][1:]
    d = [F.col(c) - float(m) for c, m in zip(features, model["mean"], strict=True)]
    h = F.lit(1.0 / model["n"])
    for i, a in enumerate(d):
        for j, b in enumerate(d):
            h = h + a * b * float(model["inverse"][i, j])
    return h


def evaluate(df: DataFrame, target: str, prediction: str, k: int) -> DataFrame:
    """(n, r2, adj_r2, mae, rmse) in one pass over rows with both values."""
    e = F.col(target) - F.col(prediction)
    s = df.where(e.isNotNull()).agg(F.count("*").alias("n"), F.sum(e * e).alias("sse"), F.avg(F.abs(e)).alias("mae"), (F.var_pop(target) * F.count("*")).alias("sst"))
    r2 = 1 - F.col("sse") / F.col("sst")
    return s.select("n", r2.alias("r2"), (1 - (1 - r2) * (F.col("n") - 1) / (F.col("n") - k - 1)).alias("adj_r2"), "mae", F.sqrt(F.col("sse") / F.col("n")).alias("rmse"))


def squared_correlation(df: DataFrame, target: str, prediction: str) -> DataFrame:
    """(r2) as the squared correlation of two columns."""
    return df.agg((F.corr(target, prediction) ** 2).alias("r2"))


def leave_one_out(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(q2, mae, rmsd) by residuals over one less the leverage: no refit. Rows with nulls don't count."""
    df = complete(df, [*features, target])
    model = fit(df, features, target, 0.0)
    e = (F.col(target) - F.col("prediction")) / (1 - leverage(model))
    rated = predict(df, model).withColumn("e", e)
    s = rated.agg(F.sum(F.col("e") ** 2).alias("press"), F.avg(F.abs("e")).alias("mae"), (F.var_pop(target) * F.count("*")).alias("sst"), F.count("*").alias("n"))
    return s.select((1 - F.col("press") / F.col("sst")).alias("q2"), "mae", F.sqrt(F.col("press") / F.col("n")).alias("rmsd"))


def leave_one_out_by(df: DataFrame, by: list[str], feature: str, target: str) -> DataFrame:
    """(by, n, r2, q2) of a model of one feature for each group, with the Q² of leaving each row out: the groups' sums, joined back to
    their rows. Groups of under three rows or of one value of the feature drop out."""
    own = complete(df, [feature, target]).select(*by, F.col(feature).cast("double").alias("x"), F.col(target).cast("double").alias("y"))
    m = own.groupBy(*by).agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.regr_slope("y", "x").alias("b"), F.regr_sxx("y", "x").alias("sxx"), F.regr_r2("y", "x").alias("r2"), (F.var_pop("y") * F.count("*")).alias("sst"))
    d = F.col("x") - F.col("mx")
    e = (F.col("y") - F.col("my") - F.col("b") * d) / (1 - 1 / F.col("n") - d * d / F.col("sxx"))
    rated = own.join(m.where("n > 2 AND sxx > 0"), by)
    return rated.groupBy(*by).agg(F.first("n").alias("n"), F.first("r2").alias("r2"), (1 - F.sum(e * e) / F.first("sst")).alias("q2"))


def k_fold(df: DataFrame, features: list[str], target: str, fold, k: int) -> DataFrame:
    """(q2, n) by k folds of a Column fold: each fold's model comes from the total sums less its own, so one pass fits all."""
    columns = [*features, target]
    rows = [r.asDict() for r in moments(df.withColumn("fold", fold), columns, ["fold"]).collect()]  # k rows
    total = {c: rows[0][c] if c.startswith("o_") else sum((r[c] or 0) for r in rows) for c in rows[0] if c != "fold"}
    own, y = list(range(len(features))), len(features)
    n, _, whole, _ = about(total, columns)
    press, sst = 0.0, whole[y, y]
    for r in rows:
        rest = {c: total[c] if c.startswith("o_") else total[c] - (r[c] or 0) for c in total}
        n_rest, mean_rest, p_rest, _ = about(rest, columns)
        b0, b = solve(n_rest, mean_rest, p_rest, own, y, 0.0)  # all from where values count
        m, mean, p, _ = about(r, columns)
        raw = p + m * np.outer(mean, mean)
        press += raw[y, y] + m * b0**2 + b @ raw[np.ix_(own, own)] @ b - 2 * b0 * m * mean[y] - 2 * b @ raw[own, y] + 2 * b0 * m * mean[own] @ b
    return df.sparkSession.createDataFrame([(float(1 - press / sst), int(n))], "q2 double, n long")


def unrank(n: int, k: int, rank: int) -> list[int]:
    """The rank-th choice, in order, of k of n things."""
    out, x = [], 0
    for left in range(k, 0, -1):
        while (c := comb(n - x - 1, left - 1)) <= rank:
            rank, x = rank - c, x + 1
        out.append(x)
        x += 1
    return out


def _next(choice: list[int], n: int) -> None:
    """The choice after this one, in place; after the last nothing changes."""
    k = len(choice)
    i = next((i for i in range(k - 1, -1, -1) if choice[i] < n - k + i), None)
    if i is not None:
        choice[i:] = range(choice[i] + 1, choice[i] + 1 + k - i)


def combinations_table(spark, features: list[str], least: int, most: int, required: tuple[str, ...] = (), chunk: int = 2000) -> DataFrame:
    """(combo): all feature subsets by size. Ranks are a range of Spark's; a task unranks the first of a chunk and steps on from it."""
    free = [f for f in features if f not in required]
    sizes = [(k - len(required), comb(len(free), k - len(required))) for k in range(max(least, len(required)), most + 1)]
    chunks = [-(-n // chunk) for _, n in sizes]

    def make(batches):
        for pdf in batches:
            out = []
            for at in pdf["id"]:
                for (k, n), m in zip(sizes, chunks, strict=True):
                    if at < m:
                        choice = unrank(len(free), k, at * chunk)
                        for _ in range(at * chunk, min((at + 1) * chunk, n)):
                            out.append(sorted([*required, *(free[i] for i in choice)]))
                            _next(choice, len(free))
                        break
                    at -= m
            yield pd.DataFrame({"combo": out})

    return spark.range(0, sum(chunks), 1, max(1, min(sum(chunks), spark.sparkContext.defaultParallelism))).mapInPandas(make, "combo array<string>")


def solve_many(n: int, mean: np.ndarray, p: np.ndarray, own: np.ndarray, y: int, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """(slopes, sums of squared errors) of subsets of one size, a row of column numbers each, as solve() does them one by one."""
    scale = np.sqrt(np.diag(p)[own] / n)
    scale[scale == 0] = 1
    raw, right = p[own[:, :, None], own[:, None, :]], p[own, y]
    a = raw / (scale[:, :, None] * scale[:, None, :]) + ridge * np.eye(own.shape[1])
    try:
        b = np.linalg.solve(a, (right / scale)[:, :, None])[:, :, 0] / scale
    except np.linalg.LinAlgError:  # of some subset alone
        b = np.stack([np.linalg.lstsq(one, r, rcond=None)[0] for one, r in zip(a, right / scale, strict=True)]) / scale
    return b, p[y, y] - 2 * (b * right).sum(1) + np.einsum("mi,mij,mj->m", b, raw, b)


#: Models whose errors are added up in one pass over the data.
TOGETHER = 512


def errors_of(df: DataFrame, models: list[tuple[list[str], float, np.ndarray, np.ndarray | None, np.ndarray | None, int]], target: str) -> list[tuple[int, float, float]]:
    """(rows, sum of squares, sum of absolutes) of the errors of each model (features, intercept, slopes, inverse, means, n) on df; with
    an inverse, of the errors that leaving each row out would give. A pass serves TOGETHER models; tasks send sums."""
    names = sorted({f for m in models for f in m[0]})
    rows, out = complete(df, [*names, target]).select(*[F.col(c).cast("double") for c in [*names, target]]), []
    for i in range(0, len(models), TOGETHER):
        given = df.sparkSession.sparkContext.broadcast([([names.index(f) for f in m[0]], *m[1:]) for m in models[i : i + TOGETHER]])

        def add(batches):
            total = np.zeros((len(given.value), 3))  # noqa: B023
            for b in batches:
                x = np.stack([np.asarray(c) for c in b.columns], axis=1) if b.num_rows else np.zeros((0, len(names) + 1))
                for j, (own, b0, slopes, inverse, mean, n) in enumerate(given.value):  # noqa: B023
                    e = x[:, -1] - b0 - x[:, own] @ slopes
                    if inverse is not None:
                        d = x[:, own] - mean
                        e = e / (1 - 1 / n - ((d @ inverse) * d).sum(1))
                    total[j] += len(e), e @ e, np.abs(e).sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), *[pa.array(c) for c in total.T]], ["model", "n", "ss", "sa"])

        sums = {r[0]: r[1:] for r in rows.mapInArrow(add, "model long, n double, ss double, sa double").groupBy("model").agg(F.sum("n"), F.sum("ss"), F.sum("sa")).collect()}
        out += [(int(sums[j][0]), sums[j][1], sums[j][2]) if j in sums else (0, 0.0, 0.0) for j in range(len(given.value))]
    return out


def search(df: DataFrame, features: list[str], target: str, least: int = 1, most: int = 2, required: tuple[str, ...] = (), threshold: float | None = None, done: DataFrame | None = None, top: int | None = None, ridge: float = RIDGE, leftout: DataFrame | None = None, q2: bool = False) -> DataFrame:
    """(combo, k, r2, adj_r2, rmse) of every feature subset, best first. done(combo) are left out, a threshold keeps r2 at least it.

    The data is read once for the Gram matrix of all columns, which goes to the tasks; each solves its subsets' small systems. With q2
    also (q2, q2_mae, q2_rmsd) by leaving each row out, and models are in order of q2; with leftout(features, target) also
    leftout_mae, on those rows. Only these two read data again, once for TOGETHER of the models that pass the threshold."""
    columns = [*features, target]
    n, mean, p = gram(moments(df, columns).first(), columns)
    at, y = {c: i for i, c in enumerate(columns)}, len(features)
    combos = combinations_table(df.sparkSession, features, least, most, required)
    if done is not None:
        combos = combos.join(done.select(F.array_sort("combo").alias("combo")), "combo", "left_anti")

    def rate(batches):
        for pdf in batches:
            parts = []
            size = pdf["combo"].map(len)
            for k in sorted(set(size)):
                some = pdf["combo"][size == k]
                _, sse = solve_many(n, mean, p, np.array([[at[c] for c in x] for x in some]).reshape(len(some), k), y, ridge)
                r2 = 1 - sse / p[y, y]
                adjusted = 1 - (1 - r2) * (n - 1) / (n - k - 1) if n > k + 1 else np.full(len(r2), np.nan)
                parts.append(pd.DataFrame({"combo": list(some), "k": k, "r2": r2, "adj_r2": adjusted, "rmse": np.sqrt(np.maximum(sse, 0) / n)}))
            yield pd.concat(parts) if parts else pd.DataFrame({"combo": [], "k": [], "r2": [], "adj_r2": [], "rmse": []})

    found = combos.mapInPandas(rate, "combo array<string>, k int, r2 double, adj_r2 double, rmse double")
    found = found.where(F.col("r2").isNotNull() & ~F.isnan("r2")).withColumn("adj_r2", F.when(~F.isnan("adj_r2"), F.col("adj_r2")))
    if threshold is not None:
        found = found.where(F.col("r2") >= threshold)
    if q2 or leftout is not None:
        found = _rated(df, found, columns, n, mean, p, leftout, q2, ridge)
    found = found.orderBy(*([F.desc("q2")] if q2 else []), F.desc("r2"), F.desc("adj_r2"), "combo")
    return found.limit(top) if top else found


def _rated(df, found, columns, n, mean, p, leftout, q2, ridge) -> DataFrame:
    """found with what leaving rows out and rows left out say of its models; it holds as many rows as it has models."""
    target, y, at = columns[-1], len(columns) - 1, {c: i for i, c in enumerate(columns)}
    rows = [tuple(r) for r in found.collect()]
    models = []
    for combo, *_ in rows:
        own = [at[c] for c in combo]
        b0, b = solve(n, mean, p, own, y, ridge)
        models.append((list(combo), b0, b, np.linalg.pinv(p[np.ix_(own, own)]), mean[own], n))
    more, names = [() for _ in rows], ""
    if q2:
        told = errors_of(complete(df, columns), models, target)
        more = [(float(1 - ss / p[y, y]), sa / m, float(np.sqrt(ss / m))) for m, ss, sa in told]
        names += ", q2 double, q2_mae double, q2_rmsd double"
    if leftout is not None:
        told = errors_of(leftout, [(*m[:3], None, None, 0) for m in models], target)
        more = [(*x, sa / m if m else None) for x, (m, _, sa) in zip(more, told, strict=True)]
        names += ", leftout_mae double"
    return df.sparkSession.createDataFrame([(*r, *x) for r, x in zip(rows, more, strict=True)], "combo array<string>, k int, r2 double, adj_r2 double, rmse double" + names)


def search_relaxing(df: DataFrame, features: list[str], target: str, threshold: float = 0.85, least_models: int = 5, step: float = 0.1, rounds: int = 6, by: str = "r2", **more) -> tuple[DataFrame, float]:
    """The search with a threshold on r2 or q2 that falls until enough models pass, at most `rounds` times; one search serves all."""
    found = durable(search(df, features, target, **({"q2": True} if by == "q2" else {}) | more))
    for _ in range(rounds):
        if found.where(F.col(by) >= threshold).count() >= least_models:
            break
        threshold = round(threshold - step, 10)
    return found.where(F.col(by) >= threshold).orderBy(F.desc(by), "combo"), threshold


def shap_linear(df: DataFrame, model: dict) -> DataFrame:
    """(feature, importance): mean absolute contribution slope * (x - mean), exact for linear models, largest first."""
    parts = [(c, float(b), float(m)) for c, b, m in zip(model["names"][1:], model["estimate"][1:], model["mean"], strict=True)]
    one = df.agg(*[F.avg(F.abs((F.col(c) - m) * b)).alias(c) for c, b, m in parts])
    return one.unpivot([], [c for c, *_ in parts], "feature", "importance").orderBy(F.desc("importance"))


def durbin_watson(df: DataFrame, residual: str, by: list[str], order: list[str]) -> DataFrame:
    """Of residuals in order, apart for each group, so that no sort is global: sums of squared steps over sums of squares."""
    w = Window.partitionBy(*by).orderBy(*order)
    s = df.withColumn("step", F.col(residual) - F.lag(residual).over(w)).groupBy(*by)
    return s.agg((F.sum(F.col("step") ** 2) / F.sum(F.col(residual) ** 2)).alias("dw"))


def jarque_bera(df: DataFrame, column: str) -> DataFrame:
    """(n, jb) from skewness and kurtosis in one pass."""
    s = df.agg(F.count(column).alias("n"), F.skewness(column).alias("s"), F.kurtosis(column).alias("k"))
    return s.select("n", (F.col("n") / 6 * (F.col("s") ** 2 + F.col("k") ** 2 / 4)).alias("jb"))


def breusch_pagan(df: DataFrame, features: list[str], residual: str) -> tuple[float, float]:
    """(LM, p): n R² of squared residuals on the features."""
    model = fit(df.withColumn("squared residual", F.col(residual) ** 2).withColumnRenamed("squared residual", "e2"), features, "e2", 0.0)
    lm = model["n"] * model["r2"]
    return lm, 1 - chi2_cdf(lm, len(features))


def white(df: DataFrame, features: list[str], residual: str) -> tuple[float, float]:
    """(LM, p): as breusch_pagan with squares and products of the features."""
    extra = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    wide = df.withColumn("e2", F.col(residual) ** 2).withColumns({f"w{i}": F.col(a) * F.col(b) for i, (a, b) in enumerate(extra)})
    columns = [*features, *[f"w{i}" for i in range(len(extra))]]
    model = fit(wide, columns, "e2", 1e-9)
    lm = model["n"] * model["r2"]
    return lm, 1 - chi2_cdf(lm, len(columns))


def reset_test(df: DataFrame, features: list[str], target: str) -> tuple[float, float]:
    """Ramsey's RESET: (F, p) of adding the fit's square and cube."""
    base = fit(df, features, target, 0.0)
    wide = predict(df, base, "fit").withColumn("fit2", F.col("fit") ** 2).withColumn("fit3", F.col("fit") ** 3)
    more = fit(wide, [*features, "fit2", "fit3"], target, 1e-12)
    df2 = base["n"] - len(features) - 3
    f = max(0.0, (base["sse"] - more["sse"]) / 2 / (more["sse"] / df2))
    return f, 1 - f_cdf(f, 2, df2)


def influence(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Each row's leverage, studentised residual, Cook's distance and DFFITS, with the usual flags."""
    model = fit(df, features, target, 0.0)
    n, k = model["n"], len(features) + 1
    h = F.col("leverage")
    out = predict(df, model).withColumn("leverage", leverage(model)).withColumn("residual", F.col(target) - F.col("prediction"))
    out = out.withColumn("studentised", F.col("residual") / F.sqrt(F.lit(float(model["s2"])) * (1 - h)))
    out = out.withColumn("cook", F.col("studentised") ** 2 * h / (1 - h) / k).withColumn("dffits", F.col("studentised") * F.sqrt(h / (1 - h)))
    return out.withColumn("high_leverage", h > 2.0 * k / n).withColumn("influential", F.col("cook") > 4.0 / n)


def lasso(df: DataFrame, features: list[str], target: str, alpha: float, rounds: int = 500) -> tuple[float, np.ndarray]:
    """(intercept, slopes) on standardised features by coordinate descent on the Gram matrix."""
    columns = [*features, target]
    n, mean, p = gram(moments(df, columns).first(), columns)
    k, y = len(features), len(features)
    d = np.sqrt(np.diag(p)[:k] / n)
    d[d == 0] = 1
    a, c, b = p[:k, :k] / np.outer(d, d) / n, p[:k, y] / d / n, np.zeros(k)
    for _ in range(rounds):
        before = b.copy()
        for j in range(k):
            r = c[j] - a[j] @ b + a[j, j] * b[j]
            b[j] = np.sign(r) * max(abs(r) - alpha, 0) / (a[j, j] or 1)
        if np.abs(b - before).max() < 1e-12:
            break
    return float(mean[y] - mean[:k] @ (b / d)), b / d


def spike_and_slab(df: DataFrame, features: list[str], target: str, draws: int = 2000, tune: int = 500, include: float = 0.5, slab: float = 1.0, seed: int = 0) -> DataFrame:
    """(feature, inclusion): posterior inclusion probabilities by Gibbs sampling on the Gram matrix of standardised columns."""
    columns = [*features, target]
    n, _, p = gram(moments(df, columns).first(), columns)
    d = np.sqrt(np.diag(p) / n)
    d[d == 0] = 1
    a, k = p / np.outer(d, d), len(features)
    rng, b, on, s2, kept = np.random.default_rng(seed), np.zeros(k), np.zeros(k, bool), 1.0, np.zeros(k)
    for t in range(draws + tune):
        for j in range(k):
            r = a[j, k] - a[j, :k] @ b + a[j, j] * b[j]
            v = 1 / (a[j, j] / s2 + 1 / slab**2)
            m = v * r / s2
            odds = np.log(include / (1 - include)) + 0.5 * np.log(v / slab**2) + 0.5 * m * m / v
            on[j] = rng.random() < 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
            b[j] = rng.normal(m, np.sqrt(v)) if on[j] else 0.0
        sse = a[k, k] - 2 * b @ a[:k, k] + b @ a[:k, :k] @ b
        s2 = max(sse, 1e-9) / 2 / rng.gamma(n / 2)
        kept += on * (t >= tune)
    return df.sparkSession.createDataFrame([(f, float(x / draws)) for f, x in zip(features, kept, strict=True)], "feature string, inclusion double")


def randomisation_check(df: DataFrame, features: list[str], target: str, key: str, runs: int = 20, shuffled: list[str] | None = None) -> DataFrame:
    """(run, r2, mae, rmse) with columns dealt out anew, together, by seeded hash order: the target, or those named, such as a feature
    or all of them; run -1 is the data as it is."""
    moved = shuffled or [target]
    base = complete(df, [*features, target]).select(key, *features, target)

    def row(run: int, one: DataFrame):
        model = fit(one, features, target)
        r = evaluate(predict(one, model), target, "prediction", len(features)).first()
        return run, float(model["r2"]), float(r["mae"]), float(r["rmse"])

    rows = [row(-1, base)]
    a = durable(dealt_places(base, key, -1).drop(key, *moved))
    for run in range(runs):
        b = dealt_places(base, key, 2 * run).select(*moved, "place")
        rows.append(row(run, a.join(b, "place")))
    return df.sparkSession.createDataFrame(rows, "run int, r2 double, mae double, rmse double")


def univariate(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, slope, intercept, r2) of each feature alone, in one pass."""
    one = df.agg(*[x for f in features for x in (F.regr_slope(target, f).alias(f"b_{f}"), F.regr_intercept(target, f).alias(f"a_{f}"), F.regr_r2(target, f).alias(f"r_{f}"))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"b_{f}").alias("slope"), F.col(f"a_{f}").alias("intercept"), F.col(f"r_{f}").alias("r2")) for f in features])))
