import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gneiss.functions import distributions as D
from gneiss.operators import classification, features, regression, sampling


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 3))
    y = 2 + x @ [1.5, -0.7, 0.0] + rng.normal(0, 0.3, 80)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y, id=range(80))
    return spark.createDataFrame(pdf).cache(), x, y


def test_distributions_have_known_values():
    assert D.t_cdf(2.228, 10) == pytest.approx(0.975, abs=1e-4)
    assert D.f_cdf(4.965, 1, 10) == pytest.approx(0.95, abs=1e-4)
    assert D.chi2_cdf(3.841, 1) == pytest.approx(0.95, abs=1e-4)
    assert D.normal_cdf(1.96) == pytest.approx(0.975, abs=1e-4)
    assert D.t_quantile(0.975, 10) == pytest.approx(2.2281, abs=1e-3)


def test_fit_and_leave_one_out(frame):
    df, x, y = frame
    m = regression.fit(df, ["a", "b"], "y", 0.0)
    design = np.c_[np.ones(80), x[:, :2]]
    b, *_ = np.linalg.lstsq(design, y, rcond=None)
    assert m["estimate"] == pytest.approx(b)
    hat = design @ np.linalg.inv(design.T @ design) @ design.T
    e = (y - design @ b) / (1 - np.diag(hat))
    q2 = 1 - (e**2).sum() / ((y - y.mean()) ** 2).sum()
    row = regression.leave_one_out(df, ["a", "b"], "y").first()
    assert row["q2"] == pytest.approx(q2) and row["mae"] == pytest.approx(np.abs(e).mean())
    assert q2 <= m["r2"]


def test_k_fold_by_difference_equals_refitting(frame):
    df, x, y = frame
    fold, press = np.arange(80) % 4, 0.0
    for k in range(4):
        d = np.c_[np.ones(80), x[:, :2]]
        b, *_ = np.linalg.lstsq(d[fold != k], y[fold != k], rcond=None)
        press += ((y[fold == k] - d[fold == k] @ b) ** 2).sum()
    row = regression.k_fold(df, ["a", "b"], "y", F.col("id") % 4, 4).first()
    assert row["q2"] == pytest.approx(1 - press / ((y - y.mean()) ** 2).sum())


def test_search_finds_the_true_features_and_resumes(spark, frame):
    df, _, _ = frame
    found = regression.search(df, ["a", "b", "c"], "y", 1, 3).collect()
    assert len(found) == 7 and found[0]["combo"] == ["a", "b", "c"]
    best_two = next(r for r in found if r["k"] == 2)
    assert best_two["combo"] == ["a", "b"]
    done = spark.createDataFrame([(["b", "a"],)], "combo array<string>")
    assert ["a", "b"] not in [r["combo"] for r in regression.search(df, ["a", "b", "c"], "y", 2, 2, done=done).collect()]
    assert all("c" in r["combo"] for r in regression.search(df, ["a", "b", "c"], "y", 1, 2, required=("c",)).collect())
    _, threshold = regression.search_relaxing(df, ["a", "b", "c"], "y", 0.999, 1, most=2)
    assert threshold < 0.999


def test_diagnostics(frame):
    df, x, y = frame
    m = regression.fit(df, ["a", "b"], "y", 0.0)
    rated = regression.predict(df, m).withColumn("e", F.col("y") - F.col("prediction"))
    lm, p = regression.breusch_pagan(rated, ["a", "b"], "e")
    assert lm >= 0 and 0 <= p <= 1
    assert 0 <= regression.white(rated, ["a", "b"], "e")[1] <= 1
    assert 0 <= regression.reset_test(df, ["a", "b"], "y")[1] <= 1
    banded = regression.predict(df, m, level=0.95)
    assert banded.where((F.col("y") > F.col("lower")) & (F.col("y") < F.col("upper"))).count() >= 68
    total = regression.influence(df, ["a", "b"], "y").agg(F.sum("leverage")).first()[0]
    assert total == pytest.approx(3)


def test_lasso_and_spike_and_slab_choose(frame):
    df, *_ = frame
    _, b = regression.lasso(df, ["a", "b", "c"], "y", 0.2)
    assert abs(b[0]) > 1 and b[2] == 0
    inclusion = {r["feature"]: r["inclusion"] for r in regression.spike_and_slab(df, ["a", "b", "c"], "y", 400, 100).collect()}
    assert inclusion["a"] > 0.95 and inclusion["c"] < 0.5


def test_randomisation_lowers_r2(frame):
    df, *_ = frame
    r = {x["run"]: x["r2"] for x in regression.randomisation_check(df, ["a", "b"], "y", "id", 3).collect()}
    assert max(r[i] for i in range(3)) < r[-1]


def test_vif_pruning_drops_the_copy(frame):
    df, *_ = frame
    wide = df.withColumn("d", F.col("a") * 2 + F.col("c") * 0.01)
    kept = features.prune_by_vif(wide, ["a", "b", "c", "d"])
    assert len({"a", "d"} & set(kept)) == 1 and "b" in kept
    assert features.vif(wide, ["a", "b"]).count() == 2


def test_logistic_matches_its_score_equations(frame):
    df, x, y = frame
    rng = np.random.default_rng(1)
    label = (rng.random(80) < 1 / (1 + np.exp(-x[:, 0]))).astype(int)
    own = df.join(df.sparkSession.createDataFrame([(i, int(v)) for i, v in enumerate(label)], "id long, label int"), "id")
    b, ll = classification.logistic(own, ["a"], "label")
    p = 1 / (1 + np.exp(-(b[0] + b[1] * x[:, 0])))
    assert (label - p).sum() == pytest.approx(0, abs=1e-6) and ((label - p) * x[:, 0]).sum() == pytest.approx(0, abs=1e-6)
    assert ll == pytest.approx(np.log(np.where(label == 1, p, 1 - p)).sum())
    assert 0 < classification.mcfadden(own, ["a"], "label") < 1


def test_ordinal_model_orders_its_cuts(spark):
    df = spark.createDataFrame([(i, min(2, i // 4)) for i in range(12)] * 3, "v int, level int")
    cuts, slope = classification.ordinal_logistic(df, "v", "level", 3)
    assert cuts[0] < cuts[1] and slope > 0


def test_samples_and_folds(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 3)
    assert sampling.stratified(df, "g", ["id"], {0: 2, 1: 1}).count() == 3
    assert sampling.stratified(df, "g", ["id"], 0.1).count() == 9
    a, b = sampling.sample(df, ["id"], 10, 1), sampling.sample(df, ["id"], 10, 1)
    assert a.exceptAll(b).isEmpty() and a.count() == 10
    weighted = sampling.sample_weighted(df.withColumn("w", (F.col("id") < 10).cast("double")), ["id"], 10, "w")
    assert {r["id"] for r in weighted.collect()} == set(range(10))
    folds = sampling.folds_none_empty(df, ["id"], 40)
    assert folds.select("fold").distinct().count() == 40
    sphere = sampling.fibonacci_sphere(spark, 50).collect()
    assert all(math.isclose(r["x"] ** 2 + r["y"] ** 2 + r["z"] ** 2, 1, abs_tol=1e-12) for r in sphere)
    by_class = classification.stratified_folds(df, "g", ["id"], 5).groupBy("g", "fold").count().agg(F.min("count"), F.max("count")).first()
    assert by_class[1] - by_class[0] <= 1
