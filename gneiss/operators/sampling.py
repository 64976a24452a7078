"""Sampling that repeats: order comes from hashes of keys, not from generators."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gneiss.operators.ranks import dealt_places, places_within, running
from gneiss.storage import durable


def stratified(df: DataFrame, group: str, key: list[str], size: int | float | dict) -> DataFrame:
    """A number, a share, or a number by group, of each group's rows, in order of the key. A number is kept already before the shuffle;
    for others the places of large groups come by parts."""
    if isinstance(size, dict):
        most = F.create_map(*[F.lit(x) for kv in size.items() for x in kv])[F.col(group)]
        return stratified(df, group, key, max(size.values(), default=0)).withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*key))).where(F.col("place") <= F.coalesce(most, F.lit(0))).drop("place")
    if isinstance(size, float):
        n = df.groupBy(F.col(group).alias("its group")).agg(F.count("*").alias("all"))
        placed = places_within(df, [group], list(key)).join(F.broadcast(n), F.col(group).eqNullSafe(F.col("`its group`")))
        return placed.where(F.col("place") <= F.floor(F.col("all") * size + 0.5)).select(*df.columns)
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*key))).where(F.col("place") <= size).drop("place")


def sample(df: DataFrame, key: list[str], size: int, seed: int = 0) -> DataFrame:
    """A sample without replacement: the smallest hashes of key and seed."""
    return df.orderBy(F.xxhash64(*key, F.lit(seed)), *key).limit(size)


def sample_weighted(df: DataFrame, key: list[str], size: int, weight: str, seed: int = 0) -> DataFrame:
    """Without replacement, in proportion to a weight: the largest u^(1/w) of a hashed u (Efraimidis and Spirakis, 2006)."""
    u = (F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return df.where(F.col(weight) > 0).orderBy(F.desc(F.log(u) / F.col(weight)), *key).limit(size)


#: Class means, in numbers, up to which they are broadcast.
BROADCAST_MEANS = 4_000_000


def similarity_to_centroid(vectors: DataFrame, label: str, vector: str, key: str, to=None) -> DataFrame:
    """(key, label, similarity): cosine to the mean vector of the row's class, or of class `to`; means by position in one aggregation."""
    long = vectors.select(key, label, F.posexplode(vector).alias("k", "v")).withColumn("v", F.col("v").cast("double"))
    mean = durable(long.groupBy(F.col(label).alias("of"), "k").agg(F.avg("v").alias("m")))
    small = mean.limit(BROADCAST_MEANS + 1).count() <= BROADCAST_MEANS
    own = mean if to is None else mean.where(F.col("of") == F.lit(to))
    same = (long["k"] == own["k"]) & (long[label] == own["of"]) if to is None else long["k"] == own["k"]
    both = long.join(F.broadcast(own) if small else own, same)
    return both.groupBy(key, label).agg((F.sum(F.col("v") * F.col("m")) / F.sqrt(F.sum(F.col("v") ** 2) * F.sum(F.col("m") ** 2))).alias("similarity"))


def spread_by_similarity(df: DataFrame, label: str, features: list[str], key: str, of, size: int, to=None) -> DataFrame:
    """(key, label, similarity, status): of class `of`, `size` rows are kept whose similarities to a class mean, their own's or that of
    `to`, lie nearest to as many evenly spaced steps from the least to the largest; the others are dropped, other classes' rows are
    "other". Features are standardised, nulls are their means, constant ones don't count.

    A step takes the nearest row that no earlier one took, the smaller key on ties, so it is among the `size` nearest; only those, by
    places in order of similarity, come to the driver."""
    one = df.agg(*[f(F.col(c).cast("double")) for c in features for f in (F.avg, F.stddev_pop)]).first()
    stats = [(c, m, s) for c, m, s in zip(features, one[0::2], one[1::2], strict=True) if s]
    scaled = F.array(*[(F.coalesce(F.col(c).cast("double"), F.lit(m)) - F.lit(m)) / F.lit(s) for c, m, s in stats])
    rated = durable(similarity_to_centroid(df.select(key, label, scaled.alias("v")), label, "v", key, to))
    mine = rated.where(F.col(label) == F.lit(of))
    n, low, high = mine.agg(F.count("*"), F.min("similarity"), F.max("similarity")).first()
    if not n:
        raise ValueError(f"no rows of class {of}")
    status = F.lit("kept")
    if size < n:
        steps = [low + (high - low) * i / max(1, size - 1) for i in range(size)]
        placed = durable(places_within(mine.select(key, "similarity").withColumn("class", F.lit(0)), ["class"], ["similarity", key]))
        at = F.array(*[F.lit(float(x)) for x in steps])
        below = placed.select(F.explode(F.filter(F.transform(at, lambda x, i: F.struct(i.alias("i"), (x >= F.col("similarity")).alias("reached"))), lambda s: s["reached"])["i"]).alias("i"), "place").groupBy("i").agg(F.max("place").alias("place"))
        ends = [r["place"] for r in below.collect()] + [1]
        near = placed.where(F.exists(F.array(*[F.lit(e) for e in ends]), lambda e: F.abs(F.col("place") - e) <= size)).orderBy("similarity", key).collect()
        left, kept = [(r["similarity"], r[key]) for r in near], []
        for x in steps:
            best = min(left, key=lambda r: (abs(r[0] - x), r[1]))  # noqa: B023
            left.remove(best)
            kept.append((best[1],))
        own = F.broadcast(df.sparkSession.createDataFrame(kept, f"picked {dict(df.dtypes)[key]}"))
        rated, status = rated.join(own, F.col(key) == F.col("picked"), "left"), F.when(F.col("picked").isNotNull(), "kept").otherwise("dropped")
    return rated.select(key, label, "similarity", F.when(F.col(label) == F.lit(of), status).otherwise("other").alias("status"))


def evenly_along(df: DataFrame, group: str, value: str, key: str, size: int) -> DataFrame:
    """About `size` rows of each group, evenly spaced in rank along a value: the first of each of as many tiles."""
    n = df.groupBy(F.col(group).alias("its group")).agg(F.count("*").alias("all"))
    placed = places_within(df, [group], [value, key]).join(F.broadcast(n), F.col(group).eqNullSafe(F.col("`its group`")))
    # tiles of a group of n rows: the first n % size have a row more
    each, more, at = F.floor(F.col("all") / size), F.col("all") % size, F.col("place") - 1
    head = F.when(at < more * (each + 1), at % (each + 1) == 0).otherwise((at - more * (each + 1)) % each == 0)
    return placed.where(F.when(each > 0, head).otherwise(F.lit(True))).select(*df.columns)


def folds_none_empty(df: DataFrame, key: list[str], k: int, seed: int = 0) -> DataFrame:
    """Adds fold by hash; the k rows of least hash go one to each fold, so that none is empty."""
    h = F.xxhash64(*key, F.lit(seed))
    first = df.select(*key).orderBy(h, *key).limit(k).withColumn("own", F.row_number().over(Window.orderBy(h, *key)) - 1)
    return df.join(F.broadcast(first), key, "left").withColumn("fold", F.coalesce("own", F.pmod(h, F.lit(k)).cast("int"))).drop("own")


def ks_statistic(df: DataFrame, value: str, group: str, a: str, b: str) -> DataFrame:
    """(ks): the largest distance of two groups' distribution functions, over counts of distinct values."""
    c = df.where(F.col(group).isin(a, b)).groupBy(value).agg(F.count_if(F.col(group) == a).alias("na"), F.count_if(F.col(group) == b).alias("nb"))
    cum = running(c, value, ["na", "nb"]).select((F.col("before_na") + F.col("na")).alias("ca"), (F.col("before_nb") + F.col("nb")).alias("cb"))
    total = c.agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
    return cum.crossJoin(F.broadcast(total)).agg(F.max(F.abs(F.col("ca") / F.col("ta") - F.col("cb") / F.col("tb"))).alias("ks"))


def fibonacci_sphere(spark, n: int) -> DataFrame:
    """(i, x, y, z): n points spread evenly over the unit sphere."""
    i = F.col("id")
    z = 1 - (2 * i + 1) / F.lit(float(n))
    t = i * (math.pi * (3 - math.sqrt(5)))
    r = F.sqrt(1 - z * z)
    return spark.range(n).select(i.alias("i"), (r * F.cos(t)).alias("x"), (r * F.sin(t)).alias("y"), z.alias("z"))


def sample_again(df: DataFrame, key: str, size: int, seed: int = 0) -> DataFrame:
    """A sample with replacement: each draw is a hashed place in a dealt order; a row comes once a draw, with the draw's number."""
    placed = dealt_places(df, key, seed)
    n = df.count()
    draws = df.sparkSession.range(size).select(F.col("id").alias("draw"), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(n, 1))) + 1).alias("place"))
    return draws.join(placed, "place").drop("place")


def drop_for_shape(df: DataFrame, key: str, value: str, count: int, measure: str = "mean") -> DataFrame:
    """df without `count` rows, picked one by one so that the mean or the population deviation of the rest stays nearest to that of all,
    or, for "ks", its distribution function; ties go to the smaller key, for "ks" to the smaller value first. Keys are unique, values
    not null. A pick is one scan that returns one row; "ks" counts distinct values first, and picks among these counts."""
    if measure not in ("mean", "std", "ks"):
        raise ValueError(f"measure must be mean, std or ks, not {measure}")
    if measure == "ks":
        return _drop_for_steps(df, key, value, count)
    n, mean, s2 = df.agg(F.count(value), F.avg(value), F.var_pop(value)).first()
    if not 0 <= count < n:
        raise ValueError(f"{count} of {n} rows can't go")
    v, gone, total, squares = F.col(value) - F.lit(mean), [], 0.0, n * s2  # sums of what is left, about the mean of all
    for m in range(n - 1, n - 1 - count, -1):
        left = (F.lit(total) - v) / m
        score = F.abs(left) if measure == "mean" else F.abs(F.sqrt(F.greatest(F.lit(0.0), (F.lit(squares) - v * v) / m - left * left)) - F.lit(s2**0.5))
        k, d = df.where(~F.col(key).isin(gone)).select(key, v.alias("d"), score.alias("score")).orderBy("score", key).limit(1).first()[:2]
        gone, total, squares = [*gone, k], total - d, squares - d * d
    return df.where(~F.col(key).isin(gone))


#: Distinct values whose counts the driver holds to compare distribution functions.
DISTINCT = 2_000_000


def _drop_for_steps(df: DataFrame, key: str, value: str, count: int) -> DataFrame:
    """drop_for_shape by the Kolmogorov-Smirnov distance. Taking a value changes the rest's function by a step there, so the largest
    distance on either side of each value gives all scores of a round at once."""
    rows = df.groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n")).orderBy("v").limit(DISTINCT + 1).collect()
    if len(rows) > DISTINCT:
        raise ValueError(f"more than {DISTINCT} distinct values")
    v, n = np.array([r["v"] for r in rows]), np.array([r["n"] for r in rows], float)
    if not 0 <= count < n.sum():
        raise ValueError(f"{count} of {int(n.sum())} rows can't go")
    whole, left, taken = np.cumsum(n) / n.sum(), n.copy(), np.zeros(len(n), int)
    for _ in range(count):
        rest = left.sum() - 1
        before = np.abs(whole - np.cumsum(left) / rest)  # at smaller values than the one that goes
        after = np.abs(whole - (np.cumsum(left) - 1) / rest)  # at it and beyond
        worst = np.maximum(np.append(0.0, np.maximum.accumulate(before)[:-1]), np.maximum.accumulate(after[::-1])[::-1])
        worst[left == 0] = np.inf
        i = int(np.argmin(np.round(worst, 12)))
        left[i] -= 1
        taken[i] += 1
    gone = df.sparkSession.createDataFrame([(float(v[i]), int(taken[i])) for i in np.flatnonzero(taken)], "v double, taken int")
    picked = df.select(key, F.col(value).cast("double").alias("v")).join(F.broadcast(gone), "v")
    place = F.row_number().over(Window.partitionBy("v").orderBy(key))
    drop = picked.withColumn("place", place).where(F.col("place") <= F.col("taken")).select(key)
    return df.join(drop, key, "left_anti")
