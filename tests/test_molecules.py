import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.operators import alignment, geometry, graph
from gneiss.sources import quantum, sinks, text_blocks
from gneiss.streaming import ingest

LOG = """ Entering
 SCF Done:  E(RB3LYP) =  -76.1000000000     A.U. after    9 cycles
                         Standard orientation:
 ---------------------------------------------------------------------
 Center     Atomic      Atomic             Coordinates (Angstroms)
 Number     Number       Type             X           Y           Z
 ---------------------------------------------------------------------
      1          8           0        0.000000    0.000000    0.119262
      2          1           0        0.000000    0.763239   -0.477047
      3          1           0        0.000000   -0.763239   -0.477047
 ---------------------------------------------------------------------
 Rotational constants (GHZ):    1.0  2.0  3.0
 SCF Done:  E(RB3LYP) =  -76.4089533000     A.U. after    9 cycles
 Alpha  occ. eigenvalues --  -19.13797  -0.99747  -0.51437  -0.29121
 Alpha virt. eigenvalues --    0.06240   0.14811   0.77242
 Hirshfeld charges, spin densities, dipoles, and CM5 charges using IRadAn=      5:
              Q-H        S-H        Dx         Dy         Dz        Q-CM5
     1  O   -0.313500   0.000000   0.000000   0.000000  -0.143000  -0.650000
     2  H    0.156750   0.000000   0.000000   0.100000  -0.090000   0.325000
     3  H    0.156750   0.000000   0.000000  -0.100000  -0.090000   0.325000
       Tot  0.000000   0.000000   0.000000   0.000000  -0.323000   0.000000
 Summary of Natural Population Analysis:
    Atom  No    Charge         Core      Valence    Rydberg      Total
 --------------------------------------------------------------------
      O    1   -0.91800      1.99981     6.90905    0.00915     8.91800
      H    2    0.45900      0.00000     0.53941    0.00159     0.54100
      H    3    0.45900      0.00000     0.53941    0.00159     0.54100
 ====================================================================
 Dipole moment (field-independent basis, Debye):
    X=              0.0000    Y=              0.0000    Z=             -2.0915  Tot=              2.0915
 Quadrupole moment (field-independent basis, Debye-Ang):
   iso        0.538400D-02      0.797816D+00
   aniso      0.386000D-02      0.571983D+00
 Harmonic frequencies (cm**-1), IR intensities (KM/Mole)
                      1                      2                      3
 Frequencies --   1713.0412              3725.2210              3848.7315
 IR Inten    --     75.7987                 1.7020                19.2591
  Atom  AN      X      Y      Z        X      Y      Z        X      Y      Z
     1   8     0.00   0.00   0.07     0.00   0.00   0.05     0.00   0.07   0.00
     2   1     0.00  -0.43  -0.56     0.00   0.58  -0.40     0.00  -0.56   0.43
     3   1     0.00   0.43  -0.56     0.00  -0.58  -0.40     0.00  -0.56  -0.43
 Thermochemistry
 Normal termination
"""


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("logs")
    (folder / "water.log").write_text(LOG)
    (folder / "broken.log").write_text(" Entering\n nothing here\n")
    return quantum.read_files(spark, str(folder), ".log"), folder


def test_log_blocks(logs):
    files, _ = logs
    atoms = {r["atom_idx"]: r for r in quantum.log_atoms(files).collect()}
    assert len(atoms) == 3 and atoms[1]["symbol"] == "O" and atoms[2]["y"] == pytest.approx(0.763239)
    assert [r["charge"] for r in quantum.log_npa_charges(files).orderBy("atom_idx").collect()] == [-0.918, 0.459, 0.459]
    h = quantum.log_hirshfeld(files).orderBy("atom_idx").collect()
    assert [r["hirshfeld"] for r in h] == [-0.3135, 0.15675, 0.15675] and h[0]["cm5"] == -0.65
    assert quantum.log_dipole(files).first()["total"] == 2.0915
    p = quantum.log_polarizability(files).where("mol_id = 'water'").first()
    assert p["iso"] == pytest.approx(5.384) and p["aniso"] == pytest.approx(3.86)
    modes = quantum.log_modes(files).orderBy("mode_idx").collect()
    assert [m["frequency"] for m in modes] == [1713.0412, 3725.221, 3848.7315] and modes[2]["ir"] == 19.2591
    moved = {(r["mode_idx"], r["atom_idx"]): (r["x"], r["y"], r["z"]) for r in quantum.log_displacements(files).collect()}
    assert len(moved) == 9 and moved[2, 3] == (0.0, -0.58, -0.4)
    e = quantum.log_energies(files).where("mol_id = 'water'").first()
    assert e["scf_energy"] == -76.4089533 and e["homo_lumo_gap_ev"] == pytest.approx((0.0624 + 0.29121) * 27.2114)


def test_files_without_blocks_stay_visible(logs):
    files, _ = logs
    broken = quantum.summary(files).where("mol_id = 'broken'").first()
    assert not broken["has_geometry"] and not broken["normal_end"]
    assert quantum.log_energies(files).where("mol_id = 'broken'").first()["scf_energy"] is None


def test_logs_stream_in_once(spark, logs, tmp_path):
    _, folder = logs
    for _ in range(2):
        ingest.ingest_logs(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/atoms")).count() == 3
    assert spark.read.parquet(str(tmp_path / "out/summary")).count() == 2
    assert spark.read.parquet(str(tmp_path / "out/displacements")).count() == 9 and spark.read.parquet(str(tmp_path / "out/hirshfeld")).count() == 3
    assert spark.read.parquet(str(tmp_path / "out/energies")).where("scf_energy IS NOT NULL").count() == 1 and spark.read.parquet(str(tmp_path / "out/errors")).count() == 2


def test_windows_over_a_stream(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(data)
    q = ingest.windowed(stream).writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("hourly").agg(F.sum("n")).first()[0] == events.count()


def test_xyz_round_trip(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("2\n-1.25\nH 0 0 0\nH 0 0 0.74\n2\nsecond\nH 0 0 0\nH 0 0 0.80\n")
    atoms = quantum.xyz_atoms(quantum.read_files(spark, str(tmp_path), ".xyz"))
    assert atoms.count() == 4 and atoms.where("frame = 0").first()["energy"] == -1.25 and atoms.where("frame = 1").first()["energy"] is None
    text = sinks.xyz_text(atoms.where("frame = 1"), "x").first()["value"]
    assert text.split("\n") == ["2", "x", "H 0.000000 0.000000 0.000000", "H 0.000000 0.000000 0.800000"]
    sinks.write_xyz(atoms.where("frame = 1"), str(tmp_path / "out"))
    assert (tmp_path / "out" / "mol_id=a").exists()
    assert "# B3LYP/6-31G(d) opt freq" in sinks.gaussian_input_text(atoms.where("frame = 1")).first()["value"]


def test_json_and_cube(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"molecule": {"atoms": [{"symbol": "H", "x": 0, "y": 0, "z": 1}]}, "charges": {"nbo": [0.1], "cm5": [0.2]}, "energies": {"total": -1.0}, "vibrations": {"modes": [{"frequency": 5.0, "ir": 1.0}]}}))
    j = quantum.read_json(spark, str(tmp_path / "m.json"))
    assert quantum.json_atoms(j).first()["symbol"] == "H" and quantum.json_energy(j).first()["energy"] == -1.0
    assert {r["charge_type"]: r["charge"] for r in quantum.json_charges(j).collect()} == {"nbo": 0.1, "cm5": 0.2}
    assert quantum.json_modes(j).first()["frequency"] == 5.0
    cube = "c1\nc2\n1 0.0 0.0 0.0\n2 1.0 0 0\n2 0 1.0 0\n2 0 0 1.0\n1 1.0 0.0 0.0 0.0\n" + "0.0 0.00105 0.0 0.0 0.0 0.0 0.5 0.001\n"
    (tmp_path / "d.cube").write_text(cube)
    p = quantum.cube_points(quantum.read_files(spark, str(tmp_path), ".cube")).orderBy("x").collect()
    assert [(round(r["x"], 4), round(r["z"], 4)) for r in p] == [(0.0, 0.5292), (0.5292, 0.5292)]


def test_feature_csv(spark, tmp_path):
    (tmp_path / "f.csv").write_text("Name,A,SMILES,Output\nx,1.5,CC,2\ny,bad,C,3\nz,1,C,\n")
    rows = quantum.read_features(spark, str(tmp_path / "f.csv"), "name").orderBy("name").collect()
    assert [(r["name"], r["A"], r["target"]) for r in rows] == [("x", 1.5, 2.0), ("y", None, 3.0)]
    with pytest.raises(ValueError):
        quantum.read_features(spark, str(tmp_path / "f.csv"), target="absent")


def test_results_append_and_report(spark, tmp_path):
    r = spark.createDataFrame([(["a"], 0.9, 0.8), (["b"], 0.5, 0.1)], "combo array<string>, r2 double, q2 double")
    for run in ("one", "two"):
        sinks.append_results(r, str(tmp_path / "results"), run)
    back = spark.read.parquet(str(tmp_path / "results"))
    assert back.count() == 4 and sinks.report(back, 0.8, 0.5).count() == 2


def test_text_blocks(spark):
    row = spark.createDataFrame([("a [1.5 2.5D+01] b\nM\nnext\n",)], "t string").select(text_blocks.numbers(text_blocks.block(F.col("t"), "[", "]")).alias("n"), text_blocks.line_after(F.col("t"), "M").alias("l"), text_blocks.block(F.col("t"), "no", "]").alias("none")).first()
    assert row["n"] == [1.5, 25.0] and row["l"] == "next" and row["none"] is None


def _water(spark):
    return spark.createDataFrame([(1, 1, "O", 0.0, 0.0, 0.119), (1, 2, "H", 0.0, 0.763, -0.477), (1, 3, "H", 0.0, -0.763, -0.477)], "mol_id long, atom_idx int, symbol string, x double, y double, z double")


def test_water_geometry(spark):
    a = _water(spark)
    assert geometry.bond_angle(a, 2, 1, 3).first()["angle"] == pytest.approx(104.0, abs=0.3)
    bonds = graph.connectivity(a)
    assert {(r["a1"], r["a2"]) for r in bonds.collect()} == {(1, 2), (1, 3)}
    assert {r["atype"] for r in graph.atom_types(a, bonds).where("atom_idx = 1").collect()} == {"O"}
    assert {r["atom"] for r in graph.reachable(bonds, 1, 2).collect()} == {1, 2}
    assert geometry.frame_transform(a, (1, 2, 3)).where("atom_idx = 1").select("x", "y", "z").first() == (0.0, 0.0, 0.0)
    collinear = spark.createDataFrame([(1, i, "C", float(i), 0.0, 0.0) for i in (1, 2, 3)], a.schema)
    assert geometry.frame_transform(collinear, (1, 2, 3)).first()["x"] is None


def test_reach_along_a_long_chain(spark):
    bonds = spark.createDataFrame([(1, i, i + 1) for i in range(1, 24)], "mol_id long, a1 int, a2 int")
    assert {r["atom"] for r in graph.reachable(bonds, 1, 2).collect()} == set(range(1, 25))


def test_alignment_restores_a_moved_copy(spark):
    a = _water(spark)
    m = a.select("mol_id", F.col("atom_idx").alias("old_idx"), F.col("atom_idx").alias("new_idx"))
    back = alignment.align(geometry.rigid_motion(a, (3.0, 1.0, 2.0), (0.5, 1.0, 1.5)), a, m)
    get = lambda d: np.array([[r["x"], r["y"], r["z"]] for r in d.orderBy("atom_idx").collect()])
    assert get(back) == pytest.approx(get(a), abs=1e-9)
    assert alignment.growing_match(a, geometry.rigid_motion(a, (0.1, 0.0, 0.0), (0.0, 0.0, 0.0))).where("atom_idx = target_idx").count() == 3
    bonds = graph.connectivity(a)
    assert alignment.common_substructure(a, a, bonds, bonds).count() == 3
    assert alignment.bad_maps(spark.createDataFrame([(1, 1, 2), (1, 2, 2)], "mol_id long, old_idx int, new_idx int")).count() == 1


def test_six_rings_finds_benzene_once(spark):
    b = spark.createDataFrame([(1, i, i % 6 + 1) if i < 6 else (1, 1, 6) for i in range(1, 7)], "mol_id long, a1 int, a2 int")
    assert [tuple(r) for r in graph.six_rings(b).collect()] == [(1, 1, 2, 3, 4, 5, 6)]
