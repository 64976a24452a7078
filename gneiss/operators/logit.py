"""Multinomial logistic models of many feature subsets at once.

A Newton round is one pass: each task adds up the sums of every subset, and only those leave it. So a round costs a scan whatever the
number of subsets in the batch, and the driver holds sums of coefficients alone.
"""

from __future__ import annotations

from itertools import batched, chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.operators.classification import measures, null_log_likelihood, stratified_folds
from gneiss.storage import durable

#: Subsets that share their passes.
BATCH = 128


def _sums(x: np.ndarray, y: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log-likelihood, gradient and negative Hessian, end to end; class 0 is the base."""
    z = np.c_[np.zeros(len(x)), x @ b.T]
    z -= z.max(1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(1, keepdims=True)
    ll = np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum()
    q = p[:, 1:]
    g = ((y[:, None] == np.arange(1, p.shape[1])) - q).T @ x
    c, k = b.shape
    h = np.zeros((c, k, c, k))
    for i in range(c):
        for j in range(c):
            h[i, :, j, :] = (x * (q[:, i] * ((i == j) - q[:, j]))[:, None]).T @ x
    return np.concatenate([[ll], g.ravel(), h.ravel()])


def fits(df: DataFrame, label: str, subsets: list[tuple[str, ...]], rounds: int = 25, ridge: float = 1e-6, without: list[tuple[str, int] | None] | None = None) -> tuple[list, list[tuple[np.ndarray, float]]]:
    """(classes, [(coefficients, log-likelihood)]) of each subset, by Newton rounds on standardised features. A row of coefficients is a
    class but the first, its first column the intercept. Rows with a null in a feature or the label don't count. `without` names, for
    each subset, a column and the value of it whose rows its model doesn't see: models of many folds share their passes."""
    names = sorted(set(chain.from_iterable(subsets)))
    without = without or [None] * len(subsets)
    marks = sorted({w[0] for w in without if w})
    d = df.select(*[F.col(f).cast("double").alias(f) for f in names], *[F.col(c).cast("long").alias(c) for c in marks], F.col(label).alias("label")).dropna()
    classes = sorted(r[0] for r in d.select("label").distinct().collect())
    s = d.agg(*[f(c) for c in names for f in (F.avg, F.stddev_pop)]).first()
    mean, scale = np.array(s[0::2], float), np.array([v or 1.0 for v in s[1::2]], float)
    at = [[names.index(f) for f in c] for c in subsets]
    hide = [None if w is None else (len(names) + marks.index(w[0]), w[1]) for w in without]
    coefficients = [np.zeros((len(classes) - 1, len(c) + 1)) for c in subsets]
    lls, live = [0.0] * len(subsets), list(range(len(subsets)))
    index = F.coalesce(*[F.when(F.col("label") == F.lit(c), F.lit(i)) for i, c in enumerate(classes)])
    rows = durable(d.select(*[((F.col(c) - F.lit(float(m))) / F.lit(float(v))).alias(c) for c, m, v in zip(names, mean, scale, strict=True)], *marks, index.alias("y")))
    for _ in range(rounds):
        given = df.sparkSession.sparkContext.broadcast([(i, at[i], hide[i], coefficients[i]) for i in live])

        def add(batches):
            total = {}
            for batch in batches:
                x = np.stack([np.asarray(batch.column(i)) for i in range(batch.num_columns - 1)], axis=1).astype(float)
                y, one = np.asarray(batch.column(batch.num_columns - 1)), np.ones((batch.num_rows, 1))
                for i, own, hidden, b in given.value:  # noqa: B023
                    see = slice(None) if hidden is None else x[:, hidden[0]] != hidden[1]
                    total[i] = total.get(i, 0) + _sums(np.hstack([one[see], x[see][:, own]]), y[see], b)
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.tolist() for t in total.values()], pa.list_(pa.float64()))], ["subset", "sums"])

        parts = rows.mapInArrow(add, "subset int, sums array<double>").select("subset", F.posexplode("sums"))
        found = {i: {} for i in live}
        for i, k, v in parts.groupBy("subset", "pos").agg(F.sum("col")).collect():
            found[i][k] = v
        for i in list(live):
            size = coefficients[i].size
            v = np.array([found[i][k] for k in range(1 + size + size * size)])
            lls[i] = float(v[0])
            step = np.linalg.solve(v[1 + size :].reshape(size, size) + ridge * np.eye(size), v[1 : 1 + size])
            step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-300))
            coefficients[i] = coefficients[i] + step.reshape(coefficients[i].shape)
            if np.abs(step).max() < 1e-8:
                live.remove(i)
        if not live:
            break
    out = []
    for own, b, ll in zip(at, coefficients, lls, strict=True):
        slopes = b[:, 1:] / scale[own]
        out.append((np.c_[b[:, 0] - slopes @ mean[own], slopes], ll))
    return classes, out


def search(df: DataFrame, features: list[str], label: str, least: int = 1, most: int = 2, required: tuple[str, ...] = (), threshold: float | None = None, done: DataFrame | None = None) -> DataFrame:
    """(combo, k, ll, mcfadden) of every subset, best first; subsets are compared on rows without nulls in any feature. done(combo) are
    left out, a threshold keeps mcfadden at least it. Subsets are made in batches of BATCH on the driver, which holds the results."""
    d = durable(df.select(*features, label).dropna())
    counts = np.array([r[1] for r in d.groupBy(label).count().collect()], float)
    ll0 = float((counts * np.log(counts / counts.sum())).sum())
    over = {frozenset(r[0]) for r in done.select("combo").collect()} if done is not None else set()
    every = chain.from_iterable(combinations(features, k) for k in range(least, most + 1))
    rows = []
    for some in batched((c for c in every if set(required) <= set(c) and frozenset(c) not in over), BATCH):
        rows += [(list(c), len(c), ll, 1 - ll / ll0) for c, (_, ll) in zip(some, fits(d, label, list(some))[1], strict=True)]
    if threshold is not None:
        rows = [r for r in rows if r[3] >= threshold]
    return df.sparkSession.createDataFrame(rows, "combo array<string>, k int, ll double, mcfadden double").orderBy(F.desc("mcfadden"), "k", "combo")


def probabilities(df: DataFrame, features: list[str], classes: list, coefficients: np.ndarray, label: str = "predicted") -> DataFrame:
    """Adds the probability of each class, as an array in order of classes, and the likeliest class, as Column expressions."""
    z = [F.lit(0.0), *[sum((F.col(f).cast("double") * float(w) for f, w in zip(features, b[1:], strict=True)), F.lit(float(b[0]))) for b in coefficients]]
    most = F.greatest(*z) if len(z) > 1 else z[0]
    e = [F.exp(x - most) for x in z]
    whole = sum(e[1:], e[0])
    p = F.array(*[x / whole for x in e])
    return df.withColumn("probability", p).withColumn(label, F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position("probability", F.array_max("probability")).cast("int")))


def cross_validate(df: DataFrame, features: list[str], label: str, key: list[str], k: int = 5, repeats: int = 1, seed: int = 0) -> DataFrame:
    """(rep, fold, n, accuracy, precision, recall, f1, mcfadden) of stratified k-fold cross-validation, with a dealing of its own for
    each repeat. Folds are no more than the rows of the smallest class. All folds' models of all repeats share their passes; mcfadden
    is against the class shares of the fold's own rows, and null where it has one class."""
    own = df.dropna(subset=[*features, label])
    smallest = own.groupBy(label).count().agg(F.min("count")).first()[0] or 0
    k = max(2, min(k, smallest))
    names = [f"fold of repeat {r}" for r in range(repeats)]
    for r, name in enumerate(names):
        own = stratified_folds(own, label, key, k, seed + r).withColumnRenamed("fold", name)
    own = durable(own.select(*features, label, *names))
    jobs = [(r, f) for r in range(repeats) for f in range(k)]
    classes, found = fits(own, label, [tuple(features)] * len(jobs), without=[(names[r], f) for r, f in jobs])
    order = sorted(features)
    at = [order.index(f) for f in features]
    given = df.sparkSession.sparkContext.broadcast({j: b for j, (b, _) in zip(jobs, found, strict=True)})

    def judge(batches):
        seen: dict[tuple, list] = {}
        for b in batches:
            x = np.stack([np.asarray(b.column(i)) for i in range(len(order))], axis=1) if b.num_rows else np.zeros((0, len(order)))
            y, folds = np.asarray(b.column(len(order))), [np.asarray(b.column(len(order) + 1 + r)) for r in range(repeats)]
            for (r, f), c in given.value.items():
                on = folds[r] == f
                z = np.c_[np.zeros(on.sum()), c[:, 0] + x[on][:, at] @ c[:, 1:].T]
                z -= z.max(1, keepdims=True, initial=-np.inf)
                log_p = z - np.log(np.exp(z).sum(1, keepdims=True))
                for t, s, v in zip(y[on].tolist(), z.argmax(1).tolist(), log_p[np.arange(len(z)), y[on]].tolist(), strict=True):
                    e = seen.setdefault((r, f, t, s), [0, 0.0])
                    e[0] += 1
                    e[1] += v
        rows = [(*key, n, v) for key, (n, v) in seen.items()]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], ["rep", "fold", "truth", "said", "n", "ll"])

    index = F.coalesce(*[F.when(F.col(label) == F.lit(c), F.lit(i)) for i, c in enumerate(classes)])
    counted = own.select(*[F.col(f).cast("double").alias(f) for f in order], index.alias("y"), *names).mapInArrow(judge, "rep int, fold int, truth int, said int, n long, ll double")
    c = counted.groupBy("rep", "fold", "truth", "said").agg(F.sum("n").cast("double").alias("n"), F.sum("ll").alias("ll"))
    ends = c.select("rep", "fold", "ll", F.explode(F.array(F.struct(F.col("truth").alias("k"), F.col("n").alias("support"), F.lit(0.0).alias("said"), F.when(F.col("truth") == F.col("said"), F.col("n")).otherwise(0.0).alias("hit"), F.col("ll").alias("own_ll")), F.struct(F.col("said").alias("k"), F.lit(0.0).alias("support"), F.col("n").alias("said"), F.lit(0.0).alias("hit"), F.lit(0.0).alias("own_ll")))).alias("e")).select("rep", "fold", "e.*")
    by = ends.groupBy("rep", "fold", "k").agg(*[F.sum(x).alias(x) for x in ("support", "said", "hit", "own_ll")])
    p, q = F.when(F.col("said") > 0, F.col("hit") / F.col("said")).otherwise(0.0), F.when(F.col("support") > 0, F.col("hit") / F.col("support")).otherwise(0.0)
    by = by.withColumn("p", p).withColumn("q", q).withColumn("f", F.when(F.col("p") + F.col("q") > 0, 2 * F.col("p") * F.col("q") / (F.col("p") + F.col("q"))).otherwise(0.0))
    n = F.sum("support")
    null_ll = F.sum(F.when(F.col("support") > 0, F.col("support") * F.log("support")).otherwise(0.0)) - n * F.log(n)
    return by.groupBy("rep", "fold").agg(n.cast("long").alias("n"), (F.sum("hit") / n).alias("accuracy"), *[(F.sum(F.col(a) * F.col("support")) / n).alias(b) for a, b in (("p", "precision"), ("q", "recall"), ("f", "f1"))], F.when(null_ll < -1e-9, 1 - F.sum("own_ll") / null_ll).alias("mcfadden"))


def rate(df: DataFrame, features: list[str], label: str, key: list[str], threshold: float = 0.0, k: int = 5, repeats: int = 1) -> dict:
    """What is said of one model: mcfadden, accuracy, precision, recall and f1 on its own rows, and, where mcfadden is over the threshold,
    the means of cross-validation as cv_mcfadden, cv_accuracy and cv_f1 (null below)."""
    own = df.dropna(subset=[*features, label])
    classes, ((b, ll),) = fits(own, label, [tuple(features)])
    ll0 = null_log_likelihood(own, label).first()["ll0"]
    m = measures(probabilities(own, features, classes, b, "said"), label, "said").first().asDict()
    out = {"mcfadden": 1 - ll / ll0, **m, "cv_mcfadden": None, "cv_accuracy": None, "cv_f1": None}
    if out["mcfadden"] > threshold:
        cv = cross_validate(own, features, label, key, k, repeats).agg(F.avg("mcfadden"), F.avg("accuracy"), F.avg("f1")).first()
        out |= dict(zip(("cv_mcfadden", "cv_accuracy", "cv_f1"), cv, strict=True))
    return out
