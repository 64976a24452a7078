"""From long descriptors to feature matrices, and what is asked of their columns. One pass of sums serves all pairs of columns."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pivot(descriptors: DataFrame, keys: list[str], id_column: str = "mol_id", key: str = "param", value: str = "value") -> DataFrame:
    """Long to wide with an explicit list of columns: one conditional aggregation, no scan for the keys."""
    return descriptors.groupBy(id_column).agg(*[F.max(F.when(F.col(key) == k, F.col(value))).alias(k) for k in keys])


def unpivot(wide: DataFrame, columns: list[str], id_column: str = "mol_id") -> DataFrame:
    return wide.unpivot(id_column, columns, "param", "value")


def nan_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, missing_share)."""
    share = df.agg(*[F.avg((F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("double")).alias(c) for c in columns])
    return share.unpivot([], columns, "feature", "missing_share")


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without a null or NaN in these columns: what every model here is fitted on."""
    return df.dropna(subset=list(columns))


def moments(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """n, sums and sums of products of all columns over complete rows: what every Gram matrix here comes from.

    Values count from their means over all complete rows, which a first pass finds (o_), so that columns far from zero lose no digits."""
    own = complete(df, columns)
    first = own.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns]).first()
    at = {c: float(first[c]) if first[c] is not None else 0.0 for c in columns}
    d = {c: F.col(c).cast("double") - F.lit(at[c]) for c in columns}
    sums = [F.count("*").alias("n"), *[F.sum(d[c]).alias(f"s_{c}") for c in columns], *[F.lit(at[c]).alias(f"o_{c}") for c in columns]]
    sums += [F.sum(d[a] * d[b]).alias(f"p_{a}_{b}") for i, a in enumerate(columns) for b in columns[i:]]
    return (own.groupBy(*by) if by else own.groupBy()).agg(*sums)


def about(row, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(n, means from where values count, centred products, where values count from) of a row of moments()."""
    n = row["n"]
    mean = np.array([row[f"s_{c}"] or 0.0 for c in columns]) / max(n, 1)
    p = np.zeros((len(columns), len(columns)))
    for i, a in enumerate(columns):
        for j, b in enumerate(columns[i:], i):
            p[i, j] = p[j, i] = (row[f"p_{a}_{b}"] or 0.0) - n * mean[i] * mean[j]
    return n, mean, p, np.array([row[f"o_{c}"] or 0.0 for c in columns])


def gram(row, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, means, centred products) of a row of moments()."""
    n, mean, p, at = about(row, columns)
    return n, mean + at, p


def correlated_pairs(df: DataFrame, columns: list[str], threshold: float = 0.8) -> DataFrame:
    """(feature_1, feature_2, r) with abs(r) over the threshold, strongest first; all pairs in one aggregation."""
    pairs = list(combinations(columns, 2))
    one = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("feature_1"), F.lit(b).alias("feature_2"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(rows)).where(F.abs("r") > threshold).orderBy(F.desc(F.abs("r")), "feature_1", "feature_2")


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean over their population deviation; a constant column becomes 0. Means travel as one broadcast row."""
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"d_{c}") for c in columns])
    scaled = {c: F.when(F.col(f"d_{c}") > 0, (F.col(c) - F.col(f"m_{c}")) / F.col(f"d_{c}")).otherwise(F.lit(0.0)) for c in columns}
    return df.crossJoin(F.broadcast(stats)).withColumns(scaled).select(*df.columns)


def _vifs(p: np.ndarray) -> np.ndarray:
    """1 / (1 - R²) of each column on the others; infinite where they determine it."""
    d = np.sqrt(np.diag(p))
    d[d == 0] = 1
    r = p / np.outer(d, d)
    out = np.ones(len(r))
    for i in range(len(r)):
        rest = [j for j in range(len(r)) if j != i]
        if rest:
            b = np.linalg.lstsq(r[np.ix_(rest, rest)], r[rest, i], rcond=1e-10)[0]
            left = 1 - b @ r[rest, i]
            out[i] = 1 / left if left > 1e-10 else np.inf
    return out


def vif(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, vif), worst first; infinite for a column that the others determine."""
    _, _, p = gram(moments(df, columns).first(), columns)
    values = _vifs(p)
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(columns, values, strict=True)], "feature string, vif double").orderBy(F.desc("vif"))


def prune_by_vif(df: DataFrame, columns: list[str], limit: float = 5.0) -> list[str]:
    """Drops the column of the largest VIF until none is over the limit; one pass over the data for all steps."""
    _, _, p = gram(moments(df, columns).first(), columns)
    keep = list(range(len(columns)))
    while len(keep) > 1:
        v = _vifs(p[np.ix_(keep, keep)])
        if v.max() <= limit:
            break
        keep.pop(int(v.argmax()))
    return [columns[i] for i in keep]


def unique_names(df: DataFrame, name: str, position: str) -> DataFrame:
    """Repeated names get #2, #3, ... in order of position."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(position))
    return df.withColumn("k", k).withColumn(name, F.when(F.col("k") > 1, F.concat(name, F.lit("#"), F.col("k"))).otherwise(F.col(name))).drop("k")


def natural_key(name):
    """The first run of digits as a number, or null."""
    return F.regexp_extract(name, r"(\d+)", 1).try_cast("long")


def one_hot(df: DataFrame, columns: list[str], most: int = 50) -> DataFrame:
    """Each column becomes a column of 0 and 1 for each of its values but the least; more than `most` values are an error."""
    for c in columns:
        values = sorted(r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().limit(most + 1).collect())
        if len(values) > most:
            raise ValueError(f"{c} has more than {most} values")
        df = df.withColumns({f"{c}_{v}": (F.col(c) == F.lit(v)).cast("double") for v in values[1:]}).drop(c)
    return df


def scale_continuous(df: DataFrame, columns: list[str]) -> DataFrame:
    """standardize() of those of the columns that hold a value that isn't whole; codes and counts stay as they are."""
    one = df.agg(*[F.bool_or(F.col(c).cast("double") != F.rint(F.col(c).cast("double"))).alias(c) for c in columns]).first()
    return standardize(df, [c for c in columns if one[c]])


def correlation_order(df: DataFrame, columns: list[str], flag: float = 0.95) -> DataFrame:
    """(feature, total, flagged, place): the sum of absolute correlations with the other features, whether one is over `flag`, and the
    feature's place by that sum; from one pass."""
    _, _, p = gram(moments(df, columns).first(), columns)
    d = np.sqrt(np.diag(p))
    d[d == 0] = np.inf
    r = np.abs(p / np.outer(d, d)) * (1 - np.eye(len(columns)))
    rows = sorted(((c, float(t), bool(m > flag)) for c, t, m in zip(columns, r.sum(1), r.max(1, initial=0), strict=True)), key=lambda x: (-x[1], x[0]))
    return df.sparkSession.createDataFrame([(*x, i + 1) for i, x in enumerate(rows)], "feature string, total double, flagged boolean, place int")


def drop_correlated(df: DataFrame, columns: list[str], threshold: float = 0.8, share: float = 0.5, seed: int = 0) -> list[str]:
    """The columns without `share` of those that correlate with another over the threshold, picked in order of a seeded hash."""
    named = sorted({x for r in correlated_pairs(df, columns, threshold).collect() for x in (r["feature_1"], r["feature_2"])})
    order = df.sparkSession.createDataFrame([(c,) for c in named], "c string").orderBy(F.xxhash64("c", F.lit(seed))).collect() if named else []
    gone = {r["c"] for r in order[: int(len(named) * share)]}
    return [c for c in columns if c not in gone]


def principal_axis(df: DataFrame, columns: list[str]) -> np.ndarray:
    """The first principal component of the columns."""
    _, _, p = gram(moments(df, columns).first(), columns)
    axis = np.linalg.eigh(p)[1][:, -1]
    return axis * np.sign(axis[np.argmax(np.abs(axis))])
