"""Registered queries of models: rows with nulls and far-off columns, searches by Q², validation, reports and codings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.operators import diagnostics, features, logit, regression, sampling, validation
from gneiss.plans.registry import rd, register
from gneiss.plans.sqlgen import SQL_SAMPLES, query
from gneiss.sources import tables

SQL_GROUPS = "g AS MATERIALIZED (SELECT o_custkey AS k, avg(o_totalprice) AS y, CAST(count(*) AS DOUBLE) AS x1, avg(CAST(o_orderkey % 97 AS DOUBLE)) AS x2 FROM orders GROUP BY o_custkey)"


def groups(spark, d) -> DataFrame:
    o = tables.table(spark, d, "orders")
    return o.groupBy(F.col("o_custkey").alias("k")).agg(F.avg("o_totalprice").alias("y"), F.count("*").cast("double").alias("x1"), F.avg((F.col("o_orderkey") % 97).cast("double")).alias("x2"))


def one(spark, row: dict) -> DataFrame:
    return spark.createDataFrame([tuple(float(x) for x in row.values())], ", ".join(f"{k} double" for k in row))


_half = "CASE WHEN okey % 5 = 0 THEN NULL ELSE f1 END"


@register("ols_nulls", query(SQL_SAMPLES, select=f"SELECT {rd(f'regr_slope(y, {_half})', 'slope', 3)}, {rd(f'regr_intercept(y, {_half})', 'intercept', 2)}, {rd(f'regr_r2(y, {_half})', 'r2')}, regr_count(y, {_half}) AS n FROM samples"))
def ols_nulls(spark, d):
    """Rows without a feature don't count."""
    m = regression.fit(tables.samples(spark, d).withColumn("f1", F.when(F.col("okey") % 5 != 0, F.col("f1"))), ["f1"], "y", 0.0)
    return one(spark, {"slope": round(m["estimate"][1], 3), "intercept": round(m["estimate"][0], 2), "r2": m["r2"]}).withColumn("n", F.lit(m["n"]).cast("long"))


_far, _near_y = "(1000000 + f2 / 10)", "(2 * (f2 / 10) + f3 / 100)"


@register("ols_shifted", query(SQL_SAMPLES, select=f"SELECT round(regr_slope({_near_y}, f2 / 10), 4) + 0.0 AS slope, round(regr_r2({_near_y}, f2 / 10), 4) + 0.0 AS r2 FROM samples"))
def ols_shifted(spark, d):
    """A column a million off zero with a deviation of a few thousandths has the slope that it has about zero."""
    s = tables.samples(spark, d).select((F.lit(1_000_000) + F.col("f2") / 10).alias("x"), (2 * (F.col("f2") / 10) + F.col("f3") / 100).alias("y"))
    m = regression.fit(s, ["x"], "y", 0.0)
    return one(spark, {"slope": round(m["estimate"][1], 4), "r2": round(m["r2"], 4)})


_sums = "s AS (SELECT count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, regr_sxx(y, x1) AS s11, regr_sxx(y, x2) AS s22, regr_sxy(x1, x2) AS s12, regr_sxy(y, x1) AS s1y, regr_sxy(y, x2) AS s2y, var_pop(y) * count(*) AS syy FROM g)"
_alone = lambda i: f"SELECT 'x{i}' AS combo, 1 - sum(pow((y - my - s{i}y/s{i}{i}*(x{i} - m{i})) / (1 - 1.0/n - pow(x{i} - m{i}, 2)/s{i}{i}), 2)) / any_value(syy) AS q2 FROM g, s"
_both = "SELECT 'x1,x2' AS combo, 1 - sum(pow((y - my - (s22*s1y - s12*s2y)/(s11*s22 - s12*s12)*(x1 - m1) - (s11*s2y - s12*s1y)/(s11*s22 - s12*s12)*(x2 - m2)) / (1 - 1.0/n - (s22*pow(x1 - m1, 2) - 2*s12*(x1 - m1)*(x2 - m2) + s11*pow(x2 - m2, 2))/(s11*s22 - s12*s12)), 2)) / any_value(syy) AS q2 FROM g, s"


@register("search_q2", query(SQL_GROUPS, _sums, select=f"SELECT combo, {rd('q2', 'q2')} FROM ({_alone(1)} UNION ALL {_alone(2)} UNION ALL {_both})"))
def search_q2(spark, d):
    """All subsets by what leaving each row out says of them."""
    found = regression.search(groups(spark, d), ["x1", "x2"], "y", 1, 2, ridge=0.0, q2=True)
    return found.select(F.array_join("combo", ",").alias("combo"), "q2")


_out = lambda i: f"SELECT 'x{i}' AS combo, (SELECT avg(abs(y - a - b*x{i})) FROM g, (SELECT regr_slope(y, x{i}) AS b, regr_intercept(y, x{i}) AS a FROM g WHERE k % 10 <> 0) WHERE k % 10 = 0) AS mae"


@register("search_leftout", query(SQL_GROUPS, select=f"SELECT combo, {rd('mae', 'leftout_mae', 3)} FROM ({_out(1)} UNION ALL {_out(2)})"), 3)
def search_leftout(spark, d):
    g = groups(spark, d)
    found = regression.search(g.where("k % 10 <> 0"), ["x1", "x2"], "y", 1, 1, ridge=0.0, leftout=g.where("k % 10 = 0"))
    return found.select(F.array_join("combo", ",").alias("combo"), "leftout_mae")


_tested = " UNION ALL ".join(f"SELECT {r} AS rep, y, y - a - b*f1 AS e FROM samples, (SELECT regr_slope(y, f1) AS b, regr_intercept(y, f1) AS a FROM samples WHERE (okey // {3**r}) % 3 <> {f}) WHERE (okey // {3**r}) % 3 = {f}" for r in range(2) for f in range(3))


@register("cross_validate", query(SQL_SAMPLES.replace("samples AS (", "samples AS MATERIALIZED (", 1), f"t AS ({_tested})", select=f"SELECT CAST(rep AS INT) AS rep, count(*) AS n, {rd('1 - sum(e*e) / (var_pop(y) * count(*))', 'q2')}, {rd('avg(abs(e))', 'mae', 3)}, {rd('sqrt(avg(e*e))', 'rmsd', 3)} FROM t GROUP BY rep"))
def cross_validate(spark, d):
    """Two repeats of three folds, by digits of the key to the base of three."""
    s = tables.samples(spark, d)
    out = validation.cross_validate(s, ["f1"], "y", ["okey"], repeats=2, folds=lambda r: (F.floor(F.col("okey") / F.pow(F.lit(3), r)) % 3).cast("int"))
    return out.select("rep", "n", "q2", F.round("mae", 3).alias("mae"), F.round("rmsd", 3).alias("rmsd"))


@register("leave_out", query(SQL_GROUPS, select="SELECT k, k IN (1, 4, 7) AS left_out FROM g"))
def leave_out(spark, d):
    g = groups(spark, d)
    rest, out = validation.leave_out(g, "k", [1, 4, 7])
    return rest.select("k", F.lit(False).alias("left_out")).unionByName(out.select("k", F.lit(True).alias("left_out")))


_fit = "m AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(x1) AS mx, avg(y) AS my, regr_slope(y, x1) AS b, regr_intercept(y, x1) AS a, regr_sxx(y, x1) AS sxx, (regr_syy(y, x1) - regr_sxy(y, x1) * regr_sxy(y, x1) / regr_sxx(y, x1)) / (count(*) - 2) AS s2 FROM g)"


@register("coefficients", query(SQL_GROUPS, _fit, select=f"SELECT 'intercept' AS name, {rd('a', 'estimate', 3)}, {rd('sqrt(s2 * (1/n + mx*mx/sxx))', 'error', 3)}, {rd('a / sqrt(s2 * (1/n + mx*mx/sxx))', 't', 4)} FROM m UNION ALL SELECT 'x1', {rd('b', 'estimate', 3)}, {rd('sqrt(s2/sxx)', 'error', 3)}, {rd('b / sqrt(s2/sxx)', 't', 4)} FROM m"), 4)
def coefficients(spark, d):
    g = groups(spark, d)
    out = validation.report(g, ["x1"], "y", "k")["coefficients"]
    return out.select("name", F.round("estimate", 3).alias("estimate"), F.round("error", 3).alias("error"), "t")


@register("robust_errors", query(SQL_GROUPS, _fit, "e AS (SELECT x1 - mx AS d, pow((y - a - b*x1) / (1 - 1/n - pow(x1 - mx, 2)/sxx), 2) AS w, n, mx, sxx FROM g, m)", select=f"SELECT 'intercept' AS name, {rd('sqrt(sum(w * pow(1/n - mx*d/sxx, 2)))', 'error', 3)} FROM e UNION ALL SELECT 'x1', {rd('sqrt(sum(w*d*d)) / any_value(sxx)', 'error', 3)} FROM e"), 3)
def robust_errors(spark, d):
    return diagnostics.robust_errors(groups(spark, d), ["x1"], "y").select("name", "error")


@register("leftout_report", query(SQL_GROUPS, "m AS (SELECT regr_slope(y, x1) AS b, regr_intercept(y, x1) AS a FROM g WHERE k % 10 <> 0)", select=f"SELECT k, {rd('abs(y - a - b*x1)', 'error', 2)}, {rd('100 * abs(y - a - b*x1) / abs(y)', 'percent_error', 4)} FROM g, m WHERE k % 10 = 0"), 4)
def leftout_report(spark, d):
    g = groups(spark, d)
    out = validation.leftout_report(g.where("k % 10 = 0"), regression.fit(g.where("k % 10 <> 0"), ["x1"], "y", 0.0), "y", "k")
    return out.select("k", F.round("error", 2).alias("error"), "percent_error")


_segments = ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@register("one_hot", "SELECT c_custkey, " + ", ".join(f"CASE WHEN c_mktsegment = '{s}' THEN 1.0 ELSE 0.0 END AS m_{s}" for s in _segments) + " FROM customer")
def one_hot(spark, d):
    return features.one_hot(tables.table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("m")), ["m"])


@register("scale_continuous", f"SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS c_nationkey, {rd('(c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER ()', 'c_acctbal')} FROM customer")
def scale_continuous(spark, d):
    """Codes stay as they are."""
    c = tables.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("double").alias("c_nationkey"), "c_acctbal")
    return features.scale_continuous(c, ["c_nationkey", "c_acctbal"])


_fs = ("f1", "f2", "f4", "f5")
_total = " UNION ALL ".join(f"SELECT '{a}' AS feature, {' + '.join(f'abs(corr({a}, {b}))' for b in _fs if b != a)} AS total FROM samples" for a in _fs)


@register("correlation_order", query(SQL_SAMPLES, f"t AS ({_total})", select=f"SELECT feature, {rd('total', 'total')}, CAST(row_number() OVER (ORDER BY total DESC) AS INT) AS place FROM t"))
def correlation_order(spark, d):
    return features.correlation_order(tables.samples(spark, d), list(_fs)).select("feature", "total", "place")


@register("class_cross_validation", digits=4)
def class_cross_validation(spark, d):
    """Three stratified folds, two dealings, of a model of three classes of orders."""
    o = tables.table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), (F.col("o_custkey") % 31).alias("customer"), F.col("o_orderstatus").alias("status"))
    return logit.cross_validate(o, ["price", "customer"], "status", ["o_orderkey"], 3, 2)


@register("spread_by_similarity", digits=6)
def spread_by_similarity(spark, d):
    s = tables.table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", F.col("c_nationkey").cast("double").alias("nation"))
    return sampling.spread_by_similarity(s, "c_mktsegment", ["c_acctbal", "nation"], "c_custkey", "BUILDING", 12)


@register("drop_for_distribution")
def drop_for_distribution(spark, d):
    return sampling.drop_for_shape(tables.table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey", "c_acctbal", 5, "ks")
