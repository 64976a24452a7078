"""What a model says of rows that it hasn't seen: rows left out by name or place, repeated folds and holdouts, and a report of it all."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.operators import features as matrices
from gneiss.operators import regression
from gneiss.operators.features import complete, moments


def leave_out(df: DataFrame, key: str, names: list, keep_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows to fit, rows left out): those of these names are left out, or, with keep_only, all others. An unknown name is an error."""
    own = df.sparkSession.createDataFrame([(n,) for n in names], f"name {dict(df.dtypes)[key]}")
    missing = [r[0] for r in own.join(df.select(F.col(key).alias("name")), "name", "left_anti").collect()]
    if missing:
        raise ValueError(f"no rows of {key} {missing}")
    named, rest = (df.join(F.broadcast(own), F.col(key) == F.col("name"), how) for how in ("left_semi", "left_anti"))
    return (named, rest) if keep_only else (rest, named)


def leave_out_places(df: DataFrame, order: list[str], places: list[int], keep_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """As leave_out, by places from 0 in an order of rows; a place beyond the rows is an error. Only rows up to the largest place are
    numbered."""
    n = df.count()
    wrong = [p for p in places if not 0 <= p < n]
    if wrong:
        raise ValueError(f"no rows at places {wrong}; there are {n}")
    first = df.orderBy(*order).limit(max(places, default=-1) + 1).select(*order).collect()
    own = df.sparkSession.createDataFrame([tuple(first[p]) for p in places], df.select(*order).schema)
    same = [df[c].eqNullSafe(own[c]) for c in order]
    named, rest = (df.join(F.broadcast(own), same, how) for how in ("left_semi", "left_anti"))
    return (named, rest) if keep_only else (rest, named)


def drop_rows(df: DataFrame, key: str, names: list, columns: list[str]) -> DataFrame:
    """df without the rows of these names, with the columns standardised anew on what is left."""
    return matrices.standardize(leave_out(df, key, names)[0], columns)


def cross_validate(df: DataFrame, features: list[str], target: str, key: list[str], k: int = 5, repeats: int = 5, holdout: float | None = None, seed: int = 0, folds: Callable[[Column], Column] | None = None) -> DataFrame:
    """(rep, n, q2, mae, rmsd) of repeated k-fold cross-validation, or of holdouts of a share of the rows.

    Rows fall into folds by a hash of key and repeat, or by `folds`, which makes a fold of the column of the repeat; of a holdout fold
    0 is tested. One pass gives the sums of all folds of all repeats, and each model comes from the total less its fold; a second pass
    tests them. Rows with nulls don't count."""
    rep = F.col("rep")
    if folds is not None:
        fold = folds(rep)
    elif holdout is None:
        fold = F.pmod(F.xxhash64(*key, rep + F.lit(seed)), F.lit(k)).cast("int")
    else:
        fold = F.when(F.pmod(F.xxhash64(*key, rep + F.lit(seed)), F.lit(1_000_000)) < int(holdout * 1_000_000), 0).otherwise(1)
    columns = [*features, target]
    rows = complete(df, columns).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("fold", fold)
    sums = [r.asDict() for r in moments(rows, columns, ["rep", "fold"]).collect()]  # repeats times folds
    own, y, models = list(range(len(features))), len(features), []
    for r in range(repeats):
        mine = [x for x in sums if x["rep"] == r]
        for test in mine:
            if holdout is not None and test["fold"] != 0:
                continue
            others = [x for x in mine if x["fold"] != test["fold"]]
            if others:
                total = {c: test[c] if c.startswith("o_") else sum(x[c] or 0 for x in others) for c in test if c not in ("rep", "fold")}
                b0, b = regression.solve(*matrices.gram(total, columns), own, y, 0.0)
                models.append((r, test["fold"], float(b0), [float(v) for v in b]))
    given = df.sparkSession.createDataFrame(models, "rep int, fold int, intercept double, slopes array<double>")
    rated = rows.join(F.broadcast(given), ["rep", "fold"])
    said = sum((F.col(f) * F.get("slopes", F.lit(i)) for i, f in enumerate(features)), F.col("intercept"))
    e = F.col(target) - said
    told = rated.groupBy("rep").agg(F.count("*").alias("n"), F.sum(e * e).alias("ss"), F.avg(F.abs(e)).alias("mae"), (F.var_pop(target) * F.count("*")).alias("sst"))
    return told.select("rep", "n", (1 - F.col("ss") / F.col("sst")).alias("q2"), "mae", F.sqrt(F.col("ss") / F.col("n")).alias("rmsd"))


def equation(model: dict, target: str, digits: int = 3) -> str:
    """A model as text: y = 1.5 + 2.0 * a - 0.3 * b."""
    b = model["estimate"]
    return f"{target} = {b[0]:.{digits}f}" + "".join(f" {'-' if w < 0 else '+'} {abs(w):.{digits}f} * {f}" for f, w in zip(model["names"][1:], b[1:], strict=True))


def coefficients(spark, model: dict, level: float = 0.95) -> DataFrame:
    """(name, estimate, error, t, p, lower, upper)."""
    half = regression.t_quantile((1 + level) / 2, model["n"] - len(model["names"])) * np.asarray(model["error"])
    rows = [(n, *map(float, x)) for n, *x in zip(model["names"], model["estimate"], model["error"], model["t"], model["p"], model["estimate"] - half, model["estimate"] + half, strict=True)]
    return spark.createDataFrame(rows, "name string, estimate double, error double, t double, p double, lower double, upper double")


def leftout_report(df: DataFrame, model: dict, target: str, key: str) -> DataFrame:
    """(key, target, prediction, error, percent_error) of rows that a model hasn't seen."""
    rated = regression.predict(df, model)
    e = F.abs(F.col(target) - F.col("prediction"))
    return rated.select(key, target, "prediction", e.alias("error"), F.when(F.col(target) != 0, 100 * e / F.abs(F.col(target))).alias("percent_error"))


def report(df: DataFrame, features: list[str], target: str, key: str, leftout: DataFrame | None = None, level: float = 0.95, margins: tuple[float, float] = (0.25, 0.5)) -> dict[str, DataFrame]:
    """All that is said of one linear model, as tables: equation, coefficients, fit, leave_one_out, k_fold (of 3 and 5 folds), vif,
    predictions with their interval and the narrowest margin that holds them (null beyond all), and leftout for rows kept apart."""
    spark, own = df.sparkSession, complete(df, [*features, target])
    model = regression.fit(own, features, target, 0.0)
    rated = regression.predict(own, model, level=level)
    gap, within = F.abs(F.col(target) - F.col("prediction")), F.lit(None).cast("double")
    for m in sorted(margins, reverse=True):
        within = F.when(gap <= m, F.lit(float(m))).otherwise(within)
    folds = None
    for k in (3, 5):
        one = cross_validate(own, features, target, [key], k, 1).select(F.lit(k).alias("folds"), "q2", "mae", "rmsd")
        folds = one if folds is None else folds.unionByName(one)
    out = {
        "equation": spark.createDataFrame([(equation(model, target),)], "equation string"), "coefficients": coefficients(spark, model, level),
        "fit": regression.evaluate(rated, target, "prediction", len(features)), "leave_one_out": regression.leave_one_out(own, features, target), "k_fold": folds,
        "vif": matrices.vif(own, features), "predictions": rated.select(key, target, "prediction", "lower", "upper", (F.col(target) - F.col("prediction")).alias("residual"), within.alias("margin")),
    }
    return out | ({"leftout": leftout_report(leftout, model, target, key)} if leftout is not None else {})


def reports(df: DataFrame, found: DataFrame, target: str, key: str, most: int = 5) -> DataFrame:
    """(combo, equation, r2, q2, mae, q2_3, q2_5, worst_vif) of the first `most` models of a search."""
    rows = []
    for r in found.limit(most).collect():
        combo = list(r["combo"])
        t = report(df, combo, target, key)
        k = {x["folds"]: x["q2"] for x in t["k_fold"].collect()}
        rows.append((combo, t["equation"].first()[0], t["fit"].first()["r2"], *t["leave_one_out"].first()[:2], k[3], k[5], t["vif"].agg(F.max("vif")).first()[0]))
    return df.sparkSession.createDataFrame(rows, "combo array<string>, equation string, r2 double, q2 double, mae double, q2_3 double, q2_5 double, worst_vif double")
