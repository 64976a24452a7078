import pytest
from pyspark.sql import functions as F

from gneiss.operators import logit
from gneiss.plans import readers
from gneiss.sources import quantum, results, text_blocks
from tests.test_molecules import LOG


def test_outputs_are_checked_by_name(spark):
    f = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "name string, x double")
    assert results.with_output(f, spark.createDataFrame([("a", 3.0)], "name string, y double"), "name", "y").where("y IS NULL").count() == 1
    with pytest.raises(ValueError, match="'b'"):
        results.with_output(f, spark.createDataFrame([("a", 3.0)], "name string, y double"), "name", "y", strict=True)
    with pytest.raises(ValueError, match="several"):
        results.with_output(f, spark.createDataFrame([("a", 3.0), ("a", 4.0), ("b", 1.0)], "name string, y double"), "name", "y", strict=True)


def test_state_of_a_search(spark):
    r = spark.createDataFrame([(0.5, float("-inf")), (0.7, None)], "r2 double, q2 double")
    assert tuple(results.state(r).first()) == (2, 0.7, None, True)
    assert results.state(r.unionByName(spark.createDataFrame([(0.1, 0.05)], r.schema))).first()["best_q2"] == 0.05
    assert results.state(r.where("false")).first()["all_failed"]


def test_a_model_of_classes_is_rated(spark):
    df = spark.createDataFrame([(i, float(i % 7), "uv"[int(i % 7 + (i % 3) > 4)]) for i in range(60)], "id long, x double, c string")
    out = logit.rate(df, ["x"], "c", ["id"], 0.0, 3)
    assert out["mcfadden"] > 0.2 and out["accuracy"] > 0.7 and 0 < out["cv_accuracy"] <= 1
    assert logit.rate(df, ["x"], "c", ["id"], 0.99)["cv_f1"] is None


def test_numbers_of_a_block_are_found_once_a_row(spark, data):
    """Not once for each row that is cut of them, and not again to filter; the texts are made in the session's partitions."""
    files = spark.createDataFrame([("a", LOG), ("b", " Entering\n"), ("c", LOG.replace("0.07     0.00   0.00   0.05", "")), ("d", None)], "mol_id string, text string")
    for table in (quantum.log_hirshfeld, quantum.log_displacements, quantum.log_npa_charges):
        plan = table(files)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(text_blocks.NUMBER) == 1, table
    assert quantum.log_hirshfeld(files).where("mol_id = 'a'").count() == 3 and quantum.log_displacements(files).where("mol_id = 'a'").count() == 9
    assert {r["mol_id"] for r in quantum.log_displacements(files).collect()} == {"a", "c"}
    cut = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0],), ([1.0],), ([],), (None,)], "v array<double>").select(text_blocks.rows_of(F.col("v"), 2).alias("r")).collect()
    assert [r["r"] for r in cut] == [[[1.0, 2.0], [3.0, 4.0]], [], [], []]
    assert readers.logs(spark, data).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_wide_reads_a_log_once(spark):
    """No join or shuffle; a charge that lacks, one too many and a log that comes twice are told row by row."""
    short = LOG.replace("      H    3    0.45900      0.00000     0.53941    0.00159     0.54100\n", "")
    files = spark.createDataFrame([("a", LOG), ("b", short), ("c", " Entering\n"), ("a", LOG)], "mol_id string, text string")
    out = quantum.wide(files)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    got = out.collect()
    assert sorted((r["mol_id"], r["atom_idx"] or 0) for r in got) == sorted([("a", 1), ("a", 2), ("a", 3)] * 2 + [("b", 1), ("b", 2), ("b", 3), ("c", 0)])
    b = {r["atom_idx"]: r for r in got if r["mol_id"] == "b"}
    assert b[3]["nbo_charge"] is None and b[3]["cm5_charge"] == 0.325 and b[1]["errors"] == ["2 charges for 3 atoms"] and b[2]["symbol"] == "H"
    c = next(r for r in got if r["mol_id"] == "c")
    assert len(c["errors"]) == 7 and c["x"] is None and c["total_dipole"] is None
    assert [tuple(r) for r in quantum.errors(files).where("mol_id = 'b'").collect()] == [("b", ["2 charges for 3 atoms"])]


def test_feather_files_are_written_without_pandas(spark, tmp_path):
    """In the session's partitions; what isn't a number is kept apart from what isn't there."""
    rows = [("a", 2, "H", 1.0), ("a", 1, "C", float("nan")), ("b", 1, None, None), ("b", None, "O", 3.0)]
    out = results.write_feather(spark.createDataFrame(rows, "mol_id string, atom_idx int, atom string, x double"), str(tmp_path / "f"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted((r["mol_id"], r["n"]) for r in out.collect()) == [("a", 2), ("b", 2)]
    got = {(r["mol_id"], r["row"]): r["fields"] for r in quantum.read_feather(spark, str(tmp_path / "f")).collect()}
    assert got["a", 0] == {"mol_id": "a", "atom_idx": "1", "atom": "C", "x": "nan"} and got["b", 0]["x"] is None and got["b", 1]["atom_idx"] is None
