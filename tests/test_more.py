import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gneiss.functions import selectors
from gneiss.functions.distributions import normal_cdf
from gneiss.operators import diagnostics, geometry, logit, paths, ranks, regression, sampling, sterics
from gneiss.sources import results


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2))
    y = 1 + x @ [0.8, -0.5] + rng.normal(0, 0.5, 300)
    label = (y > 0.6).astype(int) + (y > 1.6).astype(int)
    pdf = pd.DataFrame(x, columns=["a", "b"]).assign(y=y, label=label, t=rng.permutation(300).astype(float), id=range(300), tie=np.round(y, 1))
    return spark.createDataFrame(pdf).cache(), pdf


def test_running_sums_and_places(rows):
    df, pdf = rows
    got = ranks.running(df.groupBy("tie").agg(F.count("*").alias("n")), "tie", ["n"], 7).orderBy("tie").collect()
    values = sorted(set(pdf["tie"]))
    assert [r["tie"] for r in got] == values and [r["next"] for r in got] == [*values[1:], None]
    assert [r["before_n"] for r in got] == [(pdf["tie"] < v).sum() for v in values]
    places = sorted(r["place"] for r in ranks.dealt_places(df, "id", 3, 5).select("place").collect())
    assert places == list(range(1, 301))


def test_randomisation_breaks_the_relation(rows):
    got = regression.randomisation_check(rows[0], ["a", "b"], "y", "id", 2).orderBy("run").collect()
    assert got[0]["r2"] > 0.5 and all(r["r2"] < 0.1 for r in got[1:])


def test_harvey_collier_equals_refitting_row_by_row(rows):
    df, pdf = rows
    s = pdf.sort_values("t")
    x, y, out = np.c_[np.ones(300), s[["a", "b"]]], s["y"].to_numpy(), []
    for i in range(3, 300):
        b, *_ = np.linalg.lstsq(x[:i], y[:i], rcond=None)
        out.append((y[i] - x[i] @ b) / math.sqrt(1 + x[i] @ np.linalg.inv(x[:i].T @ x[:i]) @ x[i]))
    r = np.array(out)
    t, p = diagnostics.harvey_collier(df, ["a", "b"], "y", "t", "id", 5)
    assert t == pytest.approx(r.mean() / (r.std(ddof=1) / math.sqrt(len(r))), rel=1e-6) and 0 <= p <= 1


@pytest.mark.parametrize("column", ["y", "tie"])
def test_anderson_darling(rows, column):
    df, pdf = rows
    v = np.sort(pdf[column].to_numpy())
    z, n = (v - v.mean()) / v.std(ddof=1), len(v)
    p = np.array([normal_cdf(t) for t in z])
    i = np.arange(1, n + 1)
    want = -n - ((2 * i - 1) * (np.log(p) + np.log(1 - p[::-1]))).sum() / n
    assert diagnostics.anderson_darling(df, column).first()["a2"] == pytest.approx(want, rel=1e-5)


def test_shapiro_wilk_tells_normal_from_skewed(spark, rows):
    w, p = diagnostics.shapiro_wilk(rows[0], "y")
    assert w > 0.98 and p > 0.01
    w, p = diagnostics.shapiro_wilk(rows[0].withColumn("e", F.exp("y")), "e")
    assert w < 0.95 and p < 1e-4
    with pytest.raises(ValueError):
        diagnostics.shapiro_wilk(spark.range(6000), "id")


def test_breusch_godfrey_and_condition_number(spark, rows):
    df, pdf = rows
    e, u = np.zeros(300), np.random.default_rng(1).normal(size=300)
    for i in range(1, 300):
        e[i] = 0.7 * e[i - 1] + u[i]
    d = spark.createDataFrame(pdf.assign(e=e, g=0))
    assert diagnostics.breusch_godfrey(d, ["a", "b"], "e", ["g"], ["id"])[1] < 1e-6
    assert diagnostics.breusch_godfrey(d.withColumn("e", F.lit(0.0) + F.col("y") - F.col("a") * 0.8 + F.col("b") * 0.5 - 1), ["a", "b"], "e", ["g"], ["id"])[1] > 0.001
    assert diagnostics.condition_number(df, ["a", "b"]) == pytest.approx(np.linalg.cond(np.c_[np.ones(300), pdf[["a", "b"]]]))


def test_multinomial_fits_by_gradient(rows):
    df, pdf = rows
    classes, [(b, ll)] = logit.fits(df, "label", [("a", "b")])
    x, y = np.c_[np.ones(300), pdf[["a", "b"]]], pdf["label"].to_numpy()
    z = np.c_[np.zeros(300), x @ b.T]
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    assert classes == [0, 1, 2] and ll == pytest.approx(np.log(p[np.arange(300), y]).sum(), rel=1e-5)
    assert np.abs(((y[:, None] == [1, 2]) - p[:, 1:]).T @ x).max() < 1e-3  # at the optimum the gradient is nil


def test_logit_search_ranks_subsets(rows):
    got = logit.search(rows[0], ["a", "b", "t"], "label", 1, 3).collect()
    assert len(got) == 7 and got[0]["combo"] == ["a", "b", "t"] and [r["combo"] for r in got if r["k"] == 1] == [["a"], ["b"], ["t"]]
    assert 0 < got[0]["mcfadden"] < 1
    only = logit.search(rows[0], ["a", "b"], "label", 1, 2, required=("b",)).collect()
    assert [r["combo"] for r in only] == [["a", "b"], ["b"]]


@pytest.fixture(scope="module")
def chain(spark):
    """C1-C2-C3-C4 with O5 at C2, and an even ring of six carbons."""
    bonds = [("m", 1, 2), ("m", 2, 3), ("m", 3, 4), ("m", 2, 5)] + [("r", i, i % 6 + 1) for i in range(1, 7)]
    atoms = [("m", i, s, float(i), 0.0, 0.0) for i, s in enumerate("CCCCO", 1)] + [("r", i, "C", 0.0, float(i), 0.0) for i in range(1, 7)]
    return spark.createDataFrame(atoms, "mol_id string, atom_idx int, symbol string, x double, y double, z double"), spark.createDataFrame(bonds, "mol_id string, a1 int, a2 int")


def test_paths_and_classes(spark, chain):
    atoms, bonds = chain
    got = {r["mol_id"]: (r["length"], r["path"]) for r in paths.diameter_path(bonds).collect()}
    assert got == {"m": (3, [1, 2, 3, 4]), "r": (3, [1, 2, 3, 4])}
    classes = {(r["mol_id"], r["atom_idx"]): r["class"] for r in paths.atom_classes(atoms, bonds).collect()}
    assert len({classes["r", i] for i in range(1, 7)}) == 1 and len({classes["m", i] for i in range(1, 6)}) == 5
    third = {r["mol_id"]: r["third"] for r in paths.base_atoms(bonds, 3, 4).collect()}
    assert third == {"m": 2, "r": 5}
    empty = paths.diameter_path(bonds.limit(0)).collect()
    assert empty == []


def test_maps_are_made_one_to_one(spark, chain):
    atoms, _ = chain
    m = spark.createDataFrame([("m", 1, 2), ("m", 2, 3), ("m", 4, 3), ("m", 5, 9)], "mol_id string, old_idx int, new_idx int")
    got = {r["old_idx"]: r["new_idx"] for r in paths.closed_map(m, atoms).where("mol_id = 'm'").collect()}
    assert got == {1: 2, 2: 3, 3: 1, 4: 4, 5: 5}


def test_cone_of_one_sphere(spark):
    a = spark.createDataFrame([("m", 1, "Pd", 0.0, 0.0, 0.0), ("m", 2, "C", 0.0, 3.4, 0.0)], "mol_id string, atom_idx int, symbol string, x double, y double, z double")
    assert sterics.cone_angle(a, 1, 2).first()["cone"] == pytest.approx(60.0)


def test_selectors(spark):
    assert selectors.atom_groups("1,2 3,4") == [[1, 2], [3, 4]] and selectors.atom_groups("") == []
    assert selectors.combination("('a', 'Dist(1, 2)')") == ["a", "Dist(1, 2)"] and selectors.combination("['x',]") == ["x"] and selectors.combination("Dist(1, 2), b") == ["Dist(1, 2)", "b"]
    assert selectors.slug("Énergie (kcal/mol)") == "energie-kcal-mol"
    d = spark.createDataFrame([("1,2  3,4",), ("",), (None,)], "t string")
    assert [r[0] for r in d.select(selectors.atom_groups_column(F.col("t"))).collect()] == [[[1, 2], [3, 4]], [], None]


def test_quantiles_are_exact(rows):
    df, pdf = rows
    for column in ("y", "tie"):
        assert ranks.quantiles(df, column, [0.0, 0.25, 0.5, 1.0]) == pytest.approx(np.quantile(pdf[column], [0.0, 0.25, 0.5, 1.0]))


@pytest.mark.parametrize("measure", ["mean", "std"])
def test_rows_dropped_keep_the_shape(rows, measure):
    df, pdf = rows
    got = sampling.drop_for_shape(df, "id", "y", 3, measure)
    kept, stat = pdf, (lambda v: v.mean()) if measure == "mean" else (lambda v: v.std(ddof=0))
    for _ in range(3):
        worst = min(kept["id"], key=lambda i: (round(abs(stat(kept["y"][kept["id"] != i]) - stat(pdf["y"])), 15), i))
        kept = kept[kept["id"] != worst]
    assert sorted(r["id"] for r in got.select("id").collect()) == sorted(kept["id"])
    with pytest.raises(ValueError):
        sampling.drop_for_shape(df, "id", "y", 300)


def test_sample_with_replacement(rows):
    got = sampling.sample_again(rows[0], "id", 1000, 2).collect()
    assert len(got) == 1000 and len({r["draw"] for r in got}) == 1000 and 250 < len({r["id"] for r in got}) <= 300


def test_turn_and_push(spark, chain):
    a = spark.createDataFrame([("m", 1, "C", 1.0, 1.0, 1.0), ("m", 2, "C", 1.0, 1.0, -1.0), ("m", 3, "N", 2.0, 1.0, 1.0), ("m", 4, "H", 2.2, 1.0, 1.0)], "mol_id string, atom_idx int, symbol string, x double, y double, z double")
    for direction in ((0.0, 0.0, 1.0), (0.0, 0.0, -1.0), (1.0, 2.0, 2.0)):
        got = {r["atom_idx"]: np.array([r["x"], r["y"], r["z"]]) for r in geometry.turn_onto(a, 1, 2, direction).collect()}
        assert got[2] == pytest.approx(2 * np.array(direction) / np.linalg.norm(direction), abs=1e-9)
        assert np.linalg.norm(got[3]) == pytest.approx(1) and abs(got[3] @ got[2]) < 1e-9
    got = {r["atom_idx"]: r["x"] for r in geometry.push_apart(a).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 2.0, 4: pytest.approx(2.3)}


def test_tables_of_runs(spark, chain, tmp_path):
    (tmp_path / "a.csv").write_text("combo,q2\nx,0.5\ny,\n")
    spark.createDataFrame([("z", 0.9, 1.0)], "combo string, q2 double, mae double").write.parquet(str(tmp_path / "b"))
    got = results.load_results(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b")]).collect()
    assert [r["combo"] for r in got] == ["z", "x", "y"] and got[0]["mae"] == 1.0
    (tmp_path / "ids.csv").write_text("Name,Canonical SMILES\n water ,O\n")
    assert [tuple(r) for r in results.read_identifiers(spark, str(tmp_path / "ids.csv")).collect()] == [("water", "O")]
    written = {r["mol_id"]: r["n"] for r in results.write_feather(chain[0], str(tmp_path / "f")).collect()}
    assert written == {"m": 5, "r": 6}
    assert pd.read_feather(tmp_path / "f" / "m.feather")["symbol"].tolist() == list("CCCCO")
    results.write_tables({"Bond table": chain[1]}, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "bond-table")).count() == 10
    assert results.run_folder("/x/", "My set", "ee %", "t1") == "/x/my-set_ee_t1"
    out = results.with_output(chain[0], spark.createDataFrame([("m", 1.5)], "mol_id string, output double"), "mol_id", "output")
    assert out.where("output = 1.5").count() == 5 and out.count() == 11
