import math
import warnings
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gneiss.operators import classification, diagnostics, features, logit, ranks, regression, sampling, validation


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 3))
    y = 1 + x @ [1.0, -0.5, 0.2] + rng.normal(0, 0.5, 90)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y, id=range(90))
    return spark.createDataFrame(pdf).cache(), x, y


def test_fit_ignores_rows_with_nulls_and_keeps_digits(spark):
    rng = np.random.default_rng(0)
    x = 1e6 + rng.normal(0, 0.01, 400)
    y = 2 * (x - 1e6) + rng.normal(0, 0.001, 400)
    gone = np.arange(400) % 5 == 0
    df = spark.createDataFrame([(None if g else float(a), float(b)) for a, b, g in zip(x, y, gone, strict=True)], "x double, y double")
    m = regression.fit(df, ["x"], "y", 0.0)
    slope = np.polyfit(x[~gone] - 1e6, y[~gone], 1)[0]
    assert m["n"] == (~gone).sum() and m["estimate"][1] == pytest.approx(slope, rel=1e-6) and 0.99 < m["r2"] < 1
    assert regression.leave_one_out(df, ["x"], "y").first()["q2"] < m["r2"]
    assert regression.k_fold(df.withColumn("id", F.monotonically_increasing_id()), ["x"], "y", F.col("id") % 4, 4).first()["q2"] == pytest.approx(m["r2"], abs=0.01)


def test_ranks_of_combinations():
    for n, k in ((6, 0), (6, 1), (7, 3), (5, 5)):
        want, choice = [list(c) for c in combinations(range(n), k)], list(range(k))
        assert [regression.unrank(n, k, r) for r in range(len(want))] == want
        for w in want:
            assert choice == w
            regression._next(choice, n)


def test_combinations_table_is_whole(spark):
    names = [f"f{i}" for i in range(9)]
    got = [tuple(r["combo"]) for r in regression.combinations_table(spark, names, 1, 4, ("f3",), chunk=7).collect()]
    want = [tuple(sorted(("f3", *c))) for k in range(4) for c in combinations([n for n in names if n != "f3"], k)]
    assert sorted(got) == sorted(want)


def test_search_by_q2_and_by_rows_left_out(frame):
    df, x, y = frame
    train, test = df.where("id < 70"), df.where("id >= 70")
    got = regression.search(train, ["a", "b", "c"], "y", 1, 3, ridge=0.0, q2=True, leftout=test).collect()
    assert len(got) == 7 and [r["q2"] for r in got] == sorted((r["q2"] for r in got), reverse=True)
    for r in got:
        own = ["abc".index(c) for c in r["combo"]]
        d = np.c_[np.ones(70), x[:70, own]]
        b, *_ = np.linalg.lstsq(d, y[:70], rcond=None)
        e = (y[:70] - d @ b) / (1 - np.diag(d @ np.linalg.inv(d.T @ d) @ d.T))
        assert r["q2"] == pytest.approx(1 - (e**2).sum() / ((y[:70] - y[:70].mean()) ** 2).sum())
        assert r["q2_mae"] == pytest.approx(np.abs(e).mean()) and r["leftout_mae"] == pytest.approx(np.abs(y[70:] - np.c_[np.ones(20), x[70:, own]] @ b).mean())
    found, threshold = regression.search_relaxing(train, ["a", "b", "c"], "y", 0.99, 2, by="q2", most=2)
    assert threshold < 0.99 and found.count() >= 2


def test_repeated_folds_and_holdouts(frame):
    df, x, y = frame
    got = {r["rep"]: r for r in validation.cross_validate(df, ["a", "b"], "y", ["id"], repeats=2, folds=lambda r: ((F.col("id") + r) % 4).cast("int")).collect()}
    for rep in (0, 1):
        fold, e = (np.arange(90) + rep) % 4, np.zeros(90)
        for k in range(4):
            d = np.c_[np.ones(90), x[:, :2]]
            b, *_ = np.linalg.lstsq(d[fold != k], y[fold != k], rcond=None)
            e[fold == k] = y[fold == k] - d[fold == k] @ b
        assert got[rep]["q2"] == pytest.approx(1 - (e**2).sum() / ((y - y.mean()) ** 2).sum()) and got[rep]["mae"] == pytest.approx(np.abs(e).mean()) and got[rep]["n"] == 90
    out = validation.cross_validate(df, ["a", "b"], "y", ["id"], repeats=4, holdout=0.2).collect()
    assert len(out) == 4 and all(5 <= r["n"] <= 35 and r["q2"] < 1 for r in out) and len({r["mae"] for r in out}) == 4


def test_rows_are_left_out_by_name_and_place(frame):
    df, *_ = frame
    rest, out = validation.leave_out(df, "id", [3, 5])
    assert rest.count() == 88 and {r["id"] for r in out.collect()} == {3, 5}
    kept, others = validation.leave_out(df, "id", [3, 5], keep_only=True)
    assert kept.count() == 2 and others.count() == 88
    with pytest.raises(ValueError, match="100"):
        validation.leave_out(df, "id", [3, 100])
    _, out = validation.leave_out_places(df, ["id"], [0, 89])
    assert {r["id"] for r in out.collect()} == {0, 89}
    with pytest.raises(ValueError, match="90"):
        validation.leave_out_places(df, ["id"], [90])
    scaled = validation.drop_rows(df, "id", [1, 2], ["a"])
    assert scaled.count() == 88 and scaled.agg(F.stddev_pop("a")).first()[0] == pytest.approx(1)


def test_report_of_a_model(frame):
    df, x, y = frame
    t = validation.report(df.where("id < 80"), ["a", "b"], "y", "id", df.where("id >= 80"))
    assert t["equation"].first()[0].startswith("y = ") and t["equation"].first()[0].count("*") == 2
    c = t["coefficients"].collect()
    assert [r["name"] for r in c] == ["intercept", "a", "b"] and all(r["lower"] < r["estimate"] < r["upper"] for r in c)
    assert {r["folds"] for r in t["k_fold"].collect()} == {3, 5} and t["vif"].count() == 2 and t["leftout"].count() == 10
    p = t["predictions"].collect()
    assert all((r["margin"] is None) == (abs(r["residual"]) > 0.5) for r in p)
    some = validation.reports(df, regression.search(df, ["a", "b", "c"], "y", 1, 2), "y", "id", 2).collect()
    assert len(some) == 2 and all(r["q2"] < r["r2"] for r in some)
    fit, new = (regression.predict(df, regression.fit(df, ["a"], "y", 0.0), level=0.9, band=b).agg(F.avg(F.col("upper") - F.col("lower"))).first()[0] for b in ("fit", "prediction"))
    assert fit < new / 3


def test_shuffled_features_explain_less(frame):
    df, *_ = frame
    for moved in (["a"], ["a", "b"]):
        r = {x["run"]: x["r2"] for x in regression.randomisation_check(df, ["a", "b"], "y", "id", 2, moved).collect()}
        assert max(r[0], r[1]) < r[-1]


def test_robust_errors(frame):
    df, x, y = frame
    d = np.c_[np.ones(90), x[:, :2]]
    inv = np.linalg.inv(d.T @ d)
    b = inv @ d.T @ y
    w = ((y - d @ b) / (1 - np.einsum("ij,jk,ik->i", d, inv, d))) ** 2
    want = np.sqrt(np.diag(inv @ (d.T * w) @ d @ inv))
    assert [r["error"] for r in diagnostics.robust_errors(df, ["a", "b"], "y").collect()] == pytest.approx(want)


def test_log_tail_of_the_normal_distribution():
    t = np.linspace(-9, 9, 500)
    assert diagnostics._log_tail(t) == pytest.approx([math.log(0.5 * math.erfc(v / math.sqrt(2))) for v in t], abs=1e-12)


def test_logistic_of_classes_that_part_wholly(spark):
    df = spark.createDataFrame([(float(i), int(i >= 50), None) for i in range(100)] + [(None, 1, None)], "x double, y int, z string")
    with pytest.warns(RuntimeWarning, match="no convergence"):
        b, ll = classification.logistic(df, ["x"], "y")
    assert np.isfinite(b).all() and -1 < ll <= 0 and b[1] > 0


def test_logistic_far_from_zero(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=300)
    label = (rng.random(300) < 1 / (1 + np.exp(-x))).astype(int)
    near = spark.createDataFrame([(float(a), int(c)) for a, c in zip(x, label, strict=True)], "x double, y int")
    far = near.withColumn("x", F.col("x") * 0.01 + 1e5)
    with warnings.catch_warnings():
        warnings.simplefilter("error", RuntimeWarning)
        (b, ll), (c, lc) = classification.logistic(near, ["x"], "y"), classification.logistic(far, ["x"], "y")
    assert lc == pytest.approx(ll) and c[1] == pytest.approx(b[1] * 100, rel=1e-6)


def test_ordinal_model_of_two_features(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 2)) * [1, 10] + [0, 50]
    z = x @ [1.5, -0.1] + rng.logistic(size=400)
    level = np.digitize(z, [-6, -4.5])
    df = spark.createDataFrame([(float(a), float(b), int(l)) for (a, b), l in zip(x, level, strict=True)], "a double, b double, level int")
    m = classification.ordinal_fit(df, ["a", "b"], "level", 3)

    def ll(cuts, slopes):
        up = np.concatenate([[-np.inf], cuts, [np.inf]])
        s = lambda t: 1 / (1 + np.exp(-t))
        return np.log(s(up[level + 1] - x @ slopes) - s(up[level] - x @ slopes)).sum()

    assert m["converged"] and m["ll"] == pytest.approx(ll(m["cuts"], m["slopes"]))
    for i in range(2):  # a maximum: no small change raises it
        for d in (1e-3, -1e-3):
            e = np.eye(2)[i] * d
            assert ll(m["cuts"] + e, m["slopes"]) < m["ll"] and ll(m["cuts"], m["slopes"] + e * [1, 0.1]) < m["ll"]
    rows = classification.ordinal_predict(df, m, "said").collect()
    assert all(sum(r[f"probability_{i}"] for i in range(3)) == pytest.approx(1) for r in rows)
    assert np.mean([r["said"] == r["level"] for r in rows]) > 0.55
    with pytest.raises(ValueError, match="levels"):
        classification.ordinal_fit(df, ["a"], "level", 4)


def test_class_folds_by_separate_fits(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(120, 2))
    label = ["uvw"[int(v)] for v in np.digitize(x[:, 0] + rng.normal(0, 0.7, 120), [-0.5, 0.6])]
    df = spark.createDataFrame([(i, float(a), float(b), c) for i, ((a, b), c) in enumerate(zip(x, label, strict=True))], "id long, a double, b double, c string")
    got = {(r["rep"], r["fold"]): r for r in logit.cross_validate(df, ["b", "a"], "c", ["id"], 3, 2).collect()}
    assert set(got) == {(r, f) for r in range(2) for f in range(3)} and sum(r["n"] for r in got.values()) == 240
    folds = classification.stratified_folds(df, "c", ["id"], 3, 1)
    for f in range(3):
        classes, ((b, _),) = logit.fits(folds.where(f"fold <> {f}"), "c", [("b", "a")])
        told = logit.probabilities(folds.where(f"fold = {f}"), ["b", "a"], classes, b, "said").collect()
        assert got[1, f]["accuracy"] == pytest.approx(np.mean([r["said"] == r["c"] for r in told]))
        ll = sum(math.log(r["probability"][classes.index(r["c"])]) for r in told)
        n = np.unique([r["c"] for r in told], return_counts=True)[1]
        assert got[1, f]["mcfadden"] == pytest.approx(1 - ll / (n * np.log(n / n.sum())).sum(), abs=1e-4)
        assert got[1, f]["n"] == len(told) and 0 <= got[1, f]["f1"] <= 1


def test_search_of_classes_resumes(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(float(a), float(b), "xy"[int(a + rng.normal() > 0)]) for a, b in rng.normal(size=(80, 2))], "a double, b double, c string")
    whole = logit.search(df, ["a", "b"], "c").collect()
    assert len(whole) == 3
    done = spark.createDataFrame([(["b", "a"],)], "combo array<string>")
    assert {tuple(r["combo"]) for r in logit.search(df, ["a", "b"], "c", done=done, threshold=-1.0).collect()} == {("a",), ("b",)}


def test_places_by_parts_are_those_of_a_window(spark, monkeypatch):
    monkeypatch.setattr(ranks, "PART_ROWS", 50)
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("g"), F.xxhash64("id").alias("h"))
    a = ranks.places_within(df, ["g"], ["h"])
    b = ranks.places_within(df, ["g"], ["h"], alone=10)
    assert a.columns == b.columns and a.dtypes == b.dtypes and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    q = {r["g"]: r["quantile"] for r in ranks.quantiles_within(df, ["g"], "id", 0.3).collect()}
    assert q == {g: pytest.approx(np.quantile(np.arange(g, 1000, 3), 0.3)) for g in range(3)}


def test_evenly_along_is_the_head_of_each_tile(spark):
    df = spark.range(103).select("id", (F.col("id") % 2).alias("g"), (F.col("id") * 7 % 103).alias("v"))
    from pyspark.sql.window import Window

    tiles = df.withColumn("t", F.ntile(10).over(Window.partitionBy("g").orderBy("v", "id")))
    want = tiles.withColumn("k", F.row_number().over(Window.partitionBy("g", "t").orderBy("v", "id"))).where("k = 1").select("id")
    got = sampling.evenly_along(df, "g", "v", "id", 10).select("id")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert sampling.evenly_along(df.where("id < 6"), "g", "v", "id", 10).count() == 6


def test_a_class_spread_by_similarity(spark):
    rng = np.random.default_rng(11)
    x, label = rng.normal(size=(60, 2)), np.array(["p", "q"])[(np.arange(60) % 3 == 0).astype(int)]
    df = spark.createDataFrame([(i, float(a), float(b), c, 1.0) for i, ((a, b), c) in enumerate(zip(x, label.tolist(), strict=True))], "id long, a double, b double, c string, same double")
    z = (x - x.mean(0)) / x.std(0)
    for to in (None, "q"):
        m = {c: z[label == c].mean(0) for c in "pq"}
        s = np.array([v @ m[to or c] / np.linalg.norm(v) / np.linalg.norm(m[to or c]) for v, c in zip(z, label, strict=True)])
        left, kept = {i: s[i] for i in np.flatnonzero(label == "p")}, set()
        for step in np.linspace(min(left.values()), max(left.values()), 7):
            best = min(left, key=lambda i: (abs(left[i] - step), i))  # noqa: B023
            kept.add(int(best))
            del left[best]
        got = {r["id"]: r for r in sampling.spread_by_similarity(df, "c", ["a", "b", "same"], "id", "p", 7, to).collect()}
        assert {i for i, r in got.items() if r["status"] == "kept"} == kept
        assert all((r["status"] == "other") == (r["c"] == "q") and r["similarity"] == pytest.approx(s[i]) for i, r in got.items())
    assert sampling.spread_by_similarity(df, "c", ["a", "b"], "id", "p", 100).where("status = 'dropped'").count() == 0


def test_rows_go_without_changing_the_distribution(spark):
    rng = np.random.default_rng(13)
    v = np.round(rng.normal(size=30), 1)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "id long, v double")

    def distance(rest):
        at = np.unique(v)
        return np.abs([(v <= x).mean() - (rest <= x).mean() for x in at]).max()

    left = v.copy()
    for _ in range(4):
        left = np.delete(left, min(range(len(left)), key=lambda i: (round(distance(np.delete(left, i)), 12), left[i])))  # noqa: B023
    got = sampling.drop_for_shape(df, "id", "v", 4, "ks")
    assert sorted(r["v"] for r in got.collect()) == pytest.approx(sorted(left))
    with pytest.raises(ValueError):
        sampling.drop_for_shape(df, "id", "v", 30, "ks")


def test_codes_of_features(spark):
    df = spark.createDataFrame([(1, "u", 0.5, 3.0), (2, "v", 1.5, 4.0), (3, None, 2.5, 5.0)], "id int, c string, x double, n double")
    hot = features.one_hot(df, ["c"]).orderBy("id").collect()
    assert [r["c_v"] for r in hot] == [0.0, 1.0, None]
    with pytest.raises(ValueError):
        features.one_hot(df, ["id"], most=2)
    scaled = features.scale_continuous(df, ["x", "n"]).orderBy("id").collect()
    assert [r["n"] for r in scaled] == [3.0, 4.0, 5.0] and scaled[1]["x"] == 0
    wide = spark.range(50).select((F.col("id") * 1.0).alias("a"), (F.col("id") * 2.0).alias("b"), F.pmod(F.xxhash64("id"), F.lit(97)).cast("double").alias("c"))
    kept = features.drop_correlated(wide, ["a", "b", "c"], 0.9)
    assert len(kept) == 2 and "c" in kept
    assert features.correlation_order(wide, ["a", "b", "c"]).where("flagged").count() == 2
