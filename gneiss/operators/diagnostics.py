"""Tests of the assumptions of linear models, each from sums, counts or per-part recursions."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gneiss.functions.distributions import chi2_cdf, f_cdf, t_cdf
from gneiss.operators.features import about, complete, gram, moments
from gneiss.operators.ranks import PART_ROWS, bucket, quantiles, running
from gneiss.operators.regression import fit, leverage, predict

#: The published approximation of its p value ends here.
SHAPIRO_ROWS = 5000


def _lags(df: DataFrame, column: str, by: list[str], order: list[str], lags: int) -> DataFrame:
    """Adds lag1 and so on within each group, 0 before its first row."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns({f"lag{k}": F.coalesce(F.lag(column, k).over(w), F.lit(0.0)) for k in range(1, lags + 1)})


def ljung_box(df: DataFrame, residual: str, by: list[str], order: list[str], lags: int = 1) -> DataFrame:
    """(by, n, q) of each group: n (n + 2) times the sum of squared autocorrelations over n - k."""
    centred = df.withColumn("e", F.col(residual) - F.avg(residual).over(Window.partitionBy(*by)))
    s = _lags(centred, "e", by, order, lags).groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("e") ** 2).alias("s0"), *[F.sum(F.col("e") * F.col(f"lag{k}")).alias(f"s{k}") for k in range(1, lags + 1)])
    q = sum(((F.col(f"s{k}") / F.col("s0")) ** 2 / (F.col("n") - k) for k in range(2, lags + 1)), (F.col("s1") / F.col("s0")) ** 2 / (F.col("n") - 1))
    return s.where((F.col("n") > lags) & (F.col("s0") > 0)).select(*by, "n", (F.col("n") * (F.col("n") + 2) * q).alias("q"))


def breusch_godfrey(df: DataFrame, features: list[str], residual: str, by: list[str], order: list[str], lags: int = 1) -> tuple[float, float]:
    """(LM, p): n R² of residuals on the features and the residuals before."""
    m = fit(_lags(df, residual, by, order, lags), [*features, *[f"lag{k}" for k in range(1, lags + 1)]], residual, 0.0)
    lm = m["n"] * m["r2"]
    return lm, 1 - chi2_cdf(lm, lags)


def _sse(df: DataFrame, features: list[str], target: str) -> tuple[int, float]:
    columns = [*features, target]
    n, _, p = gram(moments(df, columns).first(), columns)
    k = len(features)
    return n, float(p[k, k] - p[k, :k] @ np.linalg.pinv(p[:k, :k]) @ p[:k, k])


def goldfeld_quandt(df: DataFrame, features: list[str], target: str, order: str) -> tuple[float, float]:
    """(F, p): error variance of the rows above the median of `order` over that of the others."""
    (middle,) = quantiles(df, order, [0.5])
    (n1, low), (n2, high) = (_sse(df.where(c), features, target) for c in (F.col(order) <= middle, F.col(order) > middle))
    d1, d2 = n2 - len(features) - 1, n1 - len(features) - 1
    f = (high / d1) / (low / d2)
    return f, 1 - f_cdf(f, d1, d2)


def rainbow(df: DataFrame, features: list[str], target: str, order: str) -> tuple[float, float]:
    """(F, p): the fit of all rows against that of the middle half by `order`."""
    low, high = quantiles(df, order, [0.25, 0.75])
    (n, whole), (m, inner) = _sse(df, features, target), _sse(df.where(F.col(order).between(low, high)), features, target)
    d1, d2 = n - m, m - len(features) - 1
    f = ((whole - inner) / d1) / (inner / d2)
    return f, 1 - f_cdf(f, d1, d2)


def condition_number(df: DataFrame, features: list[str]) -> float:
    """Largest over least singular value of the features with a column of ones."""
    n, mean, p = gram(moments(df, features).first(), features)  # about zero, as asked
    raw = np.block([[np.array([[n]]), n * mean[None, :]], [n * mean[:, None], p + n * np.outer(mean, mean)]])
    values = np.linalg.eigvalsh(raw)
    return float(np.sqrt(values[-1] / max(values[0], 0.0))) if values[0] > 0 else math.inf


def harvey_collier(df: DataFrame, features: list[str], target: str, order: str, key: str, parts: int | None = None) -> tuple[float, float]:
    """(t, p) of the mean of standardised recursive residuals in the order of `order`, then key.

    Rows are parted by quantiles of the order, into more parts where there are more. A part starts from the sums of products of those
    before it, so parts run at once. Rows with nulls don't count."""
    k, columns = len(features) + 1, [*features, target]
    df = complete(df, columns)
    parts = parts or max(16, -(-df.count() // PART_ROWS))
    cuts = sorted(set(df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.5 / parts)))
    d = df.select(*[F.col(c).cast("double").alias(c) for c in columns], F.col(order).alias("o"), F.col(key).alias("k"), bucket(F.col(order), cuts).cast("int").alias("part"))
    before, total, at = {}, (0, np.zeros((k + 1, k + 1))), np.zeros(k)
    for row in sorted(moments(d, columns, ["part"]).collect(), key=lambda r: r["part"]):
        before[row["part"]] = total
        n, mean, p, at = about(row, columns)
        raw = np.block([[np.array([[n]]), n * mean[None, :]], [n * mean[:, None], p + n * np.outer(mean, mean)]])
        total = (total[0] + n, total[1] + raw)
    given = df.sparkSession.sparkContext.broadcast((before, at))

    def recur(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["o", "k"])
        starts, from_ = given.value  # residuals don't depend on where values count from
        x, y = np.c_[np.ones(len(pdf)), pdf[features].to_numpy() - from_[:-1]], pdf[target].to_numpy() - from_[-1]
        n, g = starts[int(pdf["part"].iloc[0])]
        a, c, inverse, out = g[:k, :k].copy(), g[:k, k].copy(), None, []
        for i in range(len(x)):
            if inverse is None and n >= k and np.linalg.matrix_rank(a) == k:
                inverse = np.linalg.inv(a)
            if inverse is not None:
                u = inverse @ x[i]
                scale = 1 + x[i] @ u
                out.append((y[i] - x[i] @ (inverse @ c)) / math.sqrt(scale))
                inverse = inverse - np.outer(u, u) / scale
            a, c, n = a + np.outer(x[i], x[i]), c + x[i] * y[i], n + 1
        r = np.array(out)
        return pd.DataFrame({"n": [len(r)], "s": [r.sum()], "ss": [(r**2).sum()]})

    r = d.groupBy("part").applyInPandas(recur, "n long, s double, ss double").agg(F.sum("n"), F.sum("s"), F.sum("ss")).first()
    n, mean = r[0], r[1] / r[0]
    t = mean / math.sqrt((r[2] - n * mean**2) / (n - 1) / n)
    return t, 2 * (1 - t_cdf(abs(t), n - 1))


def robust_errors(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(name, estimate, error): standard errors that allow for unequal variances, each squared residual over the square of one less
    its leverage (HC3); one more pass of sums."""
    own = complete(df, [*features, target])
    m = fit(own, features, target, 0.0)
    w = ((F.col(target) - F.col("prediction")) / (1 - leverage(m))) ** 2
    rated = predict(own, m).withColumn("hc", w)
    d = [F.lit(1.0), *[F.col(c).cast("double") - float(x) for c, x in zip(features, m["mean"], strict=True)]]
    k = len(d)
    row = list(rated.agg(*[F.sum(F.col("hc") * d[i] * d[j]) for i in range(k) for j in range(i, k)]).first())
    meat, at = np.zeros((k, k)), 0
    for i in range(k):
        for j in range(i, k):
            meat[i, j] = meat[j, i] = row[at]
            at += 1
    bread = np.zeros((k, k))
    bread[0, 0], bread[1:, 1:] = 1 / m["n"], m["inverse"]
    v = bread @ meat @ bread  # of the intercept at the means, and the slopes
    back = np.eye(k)
    back[0, 1:] = -m["mean"]
    errors = np.sqrt(np.diag(back @ v @ back.T))
    return df.sparkSession.createDataFrame([(c, float(b), float(e)) for c, b, e in zip(m["names"], m["estimate"], errors, strict=True)], "name string, estimate double, error double")


def _log_tail(t: np.ndarray) -> np.ndarray:
    """Logarithm of the normal distribution beyond t, for whole arrays: by a Chebyshev series of the scaled complementary error function
    (Press et al., 2007), to about twelve digits."""
    x = np.abs(t) / math.sqrt(2)
    k = 2.0 / (2.0 + x)
    y = 4 * k - 2
    # fixed values: Chebyshev coefficients of exp(x^2) erfc(x) / k
    c = [-1.3026537197817094, 6.4196979235649026e-1, 1.9476473204185836e-2, -9.561514786808631e-3, -9.46595344482036e-4, 3.66839497852761e-4, 4.2523324806907e-5, -2.0278578112534e-5, -1.624290004647e-6, 1.303655835580e-6, 1.5626441722e-8, -8.5238095915e-8, 6.529054439e-9, 5.059343495e-9, -9.91364156e-10, -2.27365122e-10, 9.6467911e-11, 2.394038e-12, -6.886027e-12, 8.94487e-13, 3.13092e-13, -1.12708e-13, 3.81e-16, 7.106e-15]
    d, dd = np.zeros_like(x), np.zeros_like(x)
    for v in c[:0:-1]:
        d, dd = y * d - dd + v, d
    log_upper = np.log(k) - x * x + 0.5 * (c[0] + y * d) - dd - math.log(2)
    return np.where(t >= 0, log_upper, np.log1p(-np.exp(np.minimum(log_upper, -math.log(2)))))


def anderson_darling(df: DataFrame, column: str) -> DataFrame:
    """(n, a2) against the normal distribution of the column's own mean and deviation. Equal values are one row, weighted."""

    @F.pandas_udf("struct<low double, high double>")
    def logs(z: pd.Series) -> pd.DataFrame:
        v = z.to_numpy(float)
        return pd.DataFrame({"low": _log_tail(-v), "high": _log_tail(v)})

    n, mean, sd = df.agg(F.count(column), F.avg(column), F.stddev_samp(column)).first()
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("value")).agg(F.count("*").alias("n"))
    r = running(counted, "value", ["n"]).withColumnRenamed("before_n", "smaller").withColumn("p", logs((F.col("value") - F.lit(mean)) / F.lit(sd)))
    up, down = F.col("n") * (2 * F.col("smaller") + F.col("n")), F.col("n") * (2 * n - 2 * F.col("smaller") - F.col("n"))
    return r.agg(F.sum("n").alias("n"), (-n - F.sum(up * F.col("p.low") + down * F.col("p.high")) / n).alias("a2"))


def shapiro_wilk(df: DataFrame, column: str) -> tuple[float, float]:
    """(W, p) by Royston's approximation, which holds for 12 to SHAPIRO_ROWS rows; other numbers are an error, not a sample."""
    x = np.array([r[0] for r in df.select(F.col(column).cast("double")).where(F.col(column).isNotNull()).limit(SHAPIRO_ROWS + 1).collect()])
    n = len(x)
    if not 12 <= n <= SHAPIRO_ROWS:
        raise ValueError(f"the approximation holds for 12 to {SHAPIRO_ROWS} rows")
    x.sort()
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u, unit = n**-0.5, m / math.sqrt(m @ m)
    # fixed values of the published polynomials
    last = unit[-1] + np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0], u)
    next_to = unit[-2] + np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0], u)
    a = m / math.sqrt((m @ m - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * next_to**2))
    a[[-1, -2, 0, 1]] = last, next_to, -last, -next_to
    w = float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum())
    g = math.log(n)
    z = (math.log(1 - w) - np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], g)) / math.exp(np.polyval([0.0030302, -0.082676, -0.4803], g))
    return w, 1 - NormalDist().cdf(z)
