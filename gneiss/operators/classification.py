"""Classifiers and their measures: counts as grouped aggregates, small fits in numpy on sums."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gneiss.operators.ranks import bucket, places_within, running


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(truth, predicted, n) with totals, null standing for all, as a cube."""
    return df.cube(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def measures(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(accuracy, precision, recall, f1), the last three weighted by class size and 0 where undefined; from the counts alone."""
    c = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    by = c.select(F.explode(F.array(F.struct(F.col("t").alias("k"), F.col("n").alias("support"), F.lit(0).alias("said"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("p").alias("k"), F.lit(0).alias("support"), F.col("n").alias("said"), F.lit(0).alias("hit")))).alias("r")).select("r.*")
    k = by.groupBy("k").agg(*[F.sum(x).cast("double").alias(x) for x in ("support", "said", "hit")])
    precision, recall = F.when(F.col("said") > 0, F.col("hit") / F.col("said")).otherwise(0.0), F.when(F.col("support") > 0, F.col("hit") / F.col("support")).otherwise(0.0)
    k = k.withColumn("precision", precision).withColumn("recall", recall)
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    total = F.sum("support")
    return k.withColumn("f1", f1).agg((F.sum("hit") / total).alias("accuracy"), *[(F.sum(F.col(x) * F.col("support")) / total).alias(x) for x in ("precision", "recall", "f1")])


def null_log_likelihood(df: DataFrame, label: str) -> DataFrame:
    """(n, ll0): the log-likelihood of class shares alone, from class counts."""
    c = df.groupBy(label).agg(F.count("*").cast("double").alias("n"))
    return c.agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log("n")).alias("s")).select(F.col("total").cast("long").alias("n"), (F.col("s") - F.col("total") * F.log("total")).alias("ll0"))


def logistic(df: DataFrame, features: list[str], label: str, rounds: int = 25, ridge: float = 1e-8) -> tuple[np.ndarray, float]:
    """(coefficients with the intercept first, log-likelihood) by Newton steps; each is one aggregation of p² sums. Rows with nulls don't
    count. Features count in standard deviations from their means inside. A step that lowers the likelihood is halved; where no step
    gets small, as with classes that the features part wholly, a warning says so."""
    own = df.dropna(subset=[*features, label])
    stats = own.agg(*[f(F.col(c).cast("double")) for c in features for f in (F.avg, F.stddev_pop)]).first()
    mean, scale = np.array(stats[0::2], float), np.array([v or 1.0 for v in stats[1::2]], float)
    columns = [F.lit(1.0), *[(F.col(f).cast("double") - F.lit(float(m))) / F.lit(float(d)) for f, m, d in zip(features, mean, scale, strict=True)]]
    b, step, ll, last, done = np.zeros(len(columns)), np.zeros(len(columns)), -np.inf, -np.inf, False
    for _ in range(rounds):
        z = sum((c * float(w) for c, w in zip(columns[1:], b[1:], strict=True)), F.lit(float(b[0])))
        p, y = 1 / (1 + F.exp(-z)), F.col(label).cast("double")
        sums = [F.sum(y * z - F.greatest(z, F.lit(0.0)) - F.log1p(F.exp(-F.abs(z))))] + [F.sum(c * (y - p)) for c in columns] + [F.sum(columns[i] * columns[j] * p * (1 - p)) for i in range(len(columns)) for j in range(i, len(columns))]
        row = list(own.agg(*sums).first())
        if row[0] is None or row[0] < last - 1e-9 * abs(last):
            step = step / 2
            b = b - step
            continue
        ll, g, h, at = row[0], np.array(row[1 : len(columns) + 1], float), np.zeros((len(columns), len(columns))), len(columns) + 1
        last = ll
        if done:
            break
        for i in range(len(columns)):
            for j in range(i, len(columns)):
                h[i, j] = h[j, i] = row[at]
                at += 1
        step = np.linalg.solve(h + ridge * np.eye(len(h)), g)
        size = np.abs(step).max()
        step *= min(1.0, 5.0 / max(size, 1e-300))
        b = b + step
        done = size < 1e-9
    else:
        warnings.warn(f"no convergence after {rounds} rounds: the features may part the classes wholly", RuntimeWarning, stacklevel=2)
    slopes = b[1:] / scale
    return np.append(b[0] - slopes @ mean, slopes), float(ll)


def mcfadden(df: DataFrame, features: list[str], label: str) -> float:
    own = df.dropna(subset=[*features, label])
    return 1 - logistic(own, features, label)[1] / null_log_likelihood(own, label).first()["ll0"]


def stratified_folds(df: DataFrame, label: str, key: list[str], k: int, seed: int | None = None) -> DataFrame:
    """Adds fold: rows of each class are dealt out in order of a hash of the key."""
    h = F.xxhash64(*key) if seed is None else F.xxhash64(*key, F.lit(seed))
    return places_within(df, [label], [h, *key], "fold").withColumn("fold", (F.col("fold") - 1) % k)


def folds_in_order(df: DataFrame, label: str, key: list[str], k: int) -> DataFrame:
    """As stratified_folds in order of the key itself."""
    return places_within(df, [label], list(key), "fold").withColumn("fold", (F.col("fold") - 1) % k)


def best_threshold(df: DataFrame, feature: str, positive: str, thresholds: list[float]) -> DataFrame:
    """(threshold, above, f1) of the best cut in either direction. Rows are counted by the cuts they reach, once; sums over the few
    counts serve all cuts."""
    cuts = sorted(float(t) for t in thresholds)
    c = df.groupBy(bucket(F.col(feature), cuts).alias("b")).agg(F.count_if(F.col(positive).cast("boolean")).alias("pos"), F.count("*").alias("n"))
    every = df.sparkSession.createDataFrame([(i + 1, t) for i, t in enumerate(cuts)], "i int, threshold double")
    total = c.agg(F.sum("pos").alias("p"), F.sum("n").alias("m"))
    own = F.broadcast(every).join(c, F.col("b") >= F.col("i"), "left").groupBy("i", "threshold").agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum("n"), F.lit(0)).alias("said")).crossJoin(F.broadcast(total))
    up, down = 2.0 * F.col("tp") / (F.col("said") + F.col("p")), 2.0 * (F.col("p") - F.col("tp")) / (F.col("m") - F.col("said") + F.col("p"))
    both = own.select("threshold", F.inline(F.array(F.struct(F.lit(True).alias("above"), up.alias("f1")), F.struct(F.lit(False).alias("above"), down.alias("f1")))))
    return both.orderBy(F.desc("f1"), "threshold", F.desc("above")).limit(1)


def decision_stump(df: DataFrame, feature: str, positive: str) -> DataFrame:
    """(cut, gini): the midpoint of the least class-balanced Gini impurity. Values are counted first, and the
    running sums over distinct values are taken part by part."""
    c = df.groupBy(F.col(feature).alias("v")).agg(F.sum(F.col(positive).cast("double")).alias("p"), F.sum(1.0 - F.col(positive).cast("double")).alias("q"))
    total = c.agg(F.sum("p").alias("P"), F.sum("q").alias("Q"))
    t = running(c, "v", ["p", "q"]).where("next IS NOT NULL").select("v", "next", (F.col("before_p") + F.col("p")).alias("lp"), (F.col("before_q") + F.col("q")).alias("lq")).crossJoin(F.broadcast(total))
    a, b = F.col("lp") / F.col("P") / 2, F.col("lq") / F.col("Q") / 2
    gini = lambda x, y: F.when(x + y > 0, (x + y) * (1 - (x / (x + y)) ** 2 - (y / (x + y)) ** 2)).otherwise(0.0)
    g = gini(a, b) + gini(0.5 - a, 0.5 - b)
    return t.select(((F.col("v") + F.col("next")) / 2).alias("cut"), g.alias("gini")).orderBy(F.round("gini", 9), "cut").limit(1)


def probability_ranks(df: DataFrame, sample: list[str], probability: str) -> DataFrame:
    """Adds rank: of a sample's rows by probability, largest first, ties alike."""
    return df.withColumn("rank", F.rank().over(Window.partitionBy(*sample).orderBy(F.desc(probability))))


def log_likelihood(df: DataFrame, probability: str) -> DataFrame:
    return df.agg(F.sum(F.log(F.greatest(F.col(probability), F.lit(1e-15)))).alias("ll"))


def ordinal_fit(df: DataFrame, features: list[str], label: str, levels: int, rounds: int = 30) -> dict:
    """A proportional-odds model of levels 0 to `levels` - 1: (cuts, slopes, ll, converged), by Newton steps.

    A round is one aggregation by level: all derivatives are sums over a level's rows of products of the features, so only `levels` rows
    of p² sums leave Spark. Features count in standard deviations from their means inside. Rows with nulls don't count; a level without
    rows is an error, as it has no cut."""
    own = df.dropna(subset=[*features, label])
    stats = own.agg(*[f(F.col(c).cast("double")) for c in features for f in (F.avg, F.stddev_pop)]).first()
    mean, scale = np.array(stats[0::2], float), np.array([v or 1.0 for v in stats[1::2]], float)
    x = [(F.col(f).cast("double") - F.lit(float(m))) / F.lit(float(d)) for f, m, d in zip(features, mean, scale, strict=True)]
    k, m = len(x), levels - 1
    shares = {int(r[0]): r[1] for r in own.groupBy(F.col(label).cast("int")).count().collect()}
    if sorted(shares) != list(range(levels)):
        raise ValueError(f"levels must be 0 to {levels - 1}, each with rows; there are {sorted(shares)}")
    below = np.cumsum([shares[i] for i in range(levels)])[:-1] / sum(shares.values())
    at = np.concatenate([np.log(below / (1 - below)), np.zeros(k)])
    step, last, ll, converged = np.zeros(m + k), -np.inf, -np.inf, False
    for _ in range(rounds):
        if (np.diff(at[:m]) <= 0).any():
            step = step / 2
            at = at - step
            continue
        z = sum((c * float(w) for c, w in zip(x, at[m:], strict=True)), F.lit(0.0))
        level = F.col(label).cast("int")
        cut = lambda shift: F.element_at(F.array(*[F.lit(float(c)) for c in (-1e300, *at[:m], 1e300)]), level + shift)  # noqa: E731, B023
        s = lambda t: 1 / (1 + F.exp(-t))
        rows = own.select(level.alias("level"), *[c.alias(f"x{i}") for i, c in enumerate(x)], s(cut(2) - z).alias("u"), s(cut(1) - z).alias("l"))
        rows = rows.withColumn("p", F.greatest(F.col("u") - F.col("l"), F.lit(1e-300))).withColumn("f", F.col("u") * (1 - F.col("u"))).withColumn("g", F.col("l") * (1 - F.col("l")))
        p, f, g = F.col("p"), F.col("f"), F.col("g")
        da, db = f / p, -g / p
        haa, hbb, hab = f * (1 - 2 * F.col("u")) / p - da * da, -g * (1 - 2 * F.col("l")) / p - db * db, -da * db
        v = [F.col(f"x{i}") for i in range(k)]
        sums = [F.sum(F.log(p)), F.sum(da), F.sum(db), F.sum(haa), F.sum(hbb), F.sum(hab), *[F.sum((da + db) * c) for c in v], *[F.sum((haa + hab) * c) for c in v], *[F.sum((hbb + hab) * c) for c in v], *[F.sum((haa + 2 * hab + hbb) * v[i] * v[j]) for i in range(k) for j in range(i, k)]]
        told = {r[0]: list(r)[1:] for r in rows.groupBy("level").agg(*sums).collect()}
        ll = sum(r[0] for r in told.values())
        if not ll >= last - 1e-9 * abs(last):
            step = step / 2
            at = at - step
            continue
        last = ll
        if converged:
            break
        grad, h = np.zeros(m + k), np.zeros((m + k, m + k))
        for j, r in told.items():
            a, b = (j if j < m else None), (j - 1 if j > 0 else None)
            for place, d, own_h, cross in ((a, r[1], r[3], r[6 + k : 6 + 2 * k]), (b, r[2], r[4], r[6 + 2 * k : 6 + 3 * k])):
                if place is not None:
                    grad[place] += d
                    h[place, place] += own_h
                    h[place, m:] -= cross
                    h[m:, place] -= cross
            if a is not None and b is not None:
                h[a, b] += r[5]
                h[b, a] += r[5]
            grad[m:] -= r[6 : 6 + k]
            i = 6 + 3 * k
            for p_ in range(k):
                for q_ in range(p_, k):
                    h[m + p_, m + q_] += r[i]
                    if p_ != q_:
                        h[m + q_, m + p_] += r[i]
                    i += 1
        step = np.linalg.solve(-h + 1e-9 * np.eye(m + k), grad)
        size = np.abs(step).max()
        step *= min(1.0, 5.0 / max(size, 1e-300))
        at, converged = at + step, size < 1e-8
    if not converged:
        warnings.warn(f"no convergence after {rounds} rounds", RuntimeWarning, stacklevel=2)
    slopes = at[m:] / scale
    return {"features": list(features), "cuts": at[:m] + slopes @ mean, "slopes": slopes, "ll": float(ll), "converged": converged}


def ordinal_predict(df: DataFrame, model: dict, name: str = "level") -> DataFrame:
    """Adds probability_0, probability_1, ... and the likeliest level, the lower one on ties, as Column expressions."""
    z = sum((F.col(f).cast("double") * float(w) for f, w in zip(model["features"], model["slopes"], strict=True)), F.lit(0.0))
    up = [*[1 / (1 + F.exp(-(F.lit(float(c)) - z))) for c in model["cuts"]], F.lit(1.0)]
    parts = [up[0], *[b - a for a, b in zip(up, up[1:], strict=False)]]
    out = df.withColumns({f"probability_{i}": p for i, p in enumerate(parts)})
    each = F.array(*[F.col(f"probability_{i}") for i in range(len(parts))])
    return out.withColumn(name, (F.array_position(each, F.array_max(each)) - 1).cast("int"))


def ordinal_logistic(df: DataFrame, feature: str, label: str, levels: int) -> tuple[np.ndarray, float]:
    """(cut points, slope) of a proportional-odds model of one feature."""
    m = ordinal_fit(df, [feature], label, levels)
    return m["cuts"], float(m["slopes"][0])
