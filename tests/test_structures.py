import json
import random
from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss import storage
from gneiss.functions.elements import ELEMENTS
from gneiss.operators import alignment, geometry, graph, paths, sampling, sterimol, vibrations
from gneiss.sources import quantum, results
from tests.test_molecules import LOG

ATOMS = "mol_id long, atom_idx int, symbol string, x double, y double, z double"


def some_graph(r, n, p):
    near = {i: set() for i in range(n)}
    for i, j in combinations(range(n), 2):
        if r.random() < p:
            near[i].add(j)
            near[j].add(i)
    return {i: r.choice("CNO") for i in range(n)}, near


def connected(near, some):
    seen, queue = {min(some)}, [min(some)]
    while queue:
        for b in near[queue.pop()] & some - seen:
            seen.add(b)
            queue.append(b)
    return seen == some


def lies_in(some, first, second):
    (s1, n1), (s2, n2) = first, second
    return any(all(s1[a] == s2[m[a]] for a in some) and all(m[b] in n2[m[a]] for a in some for b in n1[a] & some) for p in permutations(s2, len(some)) for m in [dict(zip(sorted(some), p, strict=True))])


def test_largest_common_substructure_by_brute_force():
    r = random.Random(1)
    for _ in range(60):
        graphs = [some_graph(r, r.randint(2, 6), 0.45) for _ in range(3)]
        sizes = [len(s) for k in range(1, 7) for c in combinations(graphs[0][0], k) for s in [set(c)] if connected(graphs[0][1], s) and all(lies_in(s, graphs[0], g) for g in graphs[1:2])]
        m = alignment.largest_common(*graphs[:2])
        assert len(m) == max(sizes, default=0)
        assert all(graphs[0][0][a] == graphs[1][0][b] for a, b in m.items()) and all(m[y] in graphs[1][1][m[x]] for x in m for y in graphs[0][1][x] & m.keys())
        all_three = [len(s) for k in range(1, 7) for c in combinations(graphs[0][0], k) for s in [set(c)] if connected(graphs[0][1], s) and all(lies_in(s, graphs[0], g) for g in graphs[1:])]
        best, text = alignment.common_of_all(graphs)
        assert len(best) == max(all_three, default=0) and (not best or text.count(".") == len(best) - 1)


def test_canonical_text_tells_graphs_apart():
    r = random.Random(2)
    for _ in range(60):
        s, near = some_graph(r, r.randint(2, 6), 0.5)
        order = list(s)
        r.shuffle(order)
        m = dict(zip(s, order, strict=True))
        moved = {m[a]: v for a, v in s.items()}, {m[a]: {m[b] for b in v} for a, v in near.items()}
        assert alignment.canonical(s, near) == alignment.canonical(*moved)
    six = {i: "C" for i in range(6)}
    ring = {i: {(i + 1) % 6, (i - 1) % 6} for i in range(6)}
    two = {i: {j for j in range(i // 3 * 3, i // 3 * 3 + 3) if j != i} for i in range(6)}
    assert alignment.canonical(six, ring) != alignment.canonical(six, two)
    assert alignment.holds((six, ring), (six, two)) is None and len(alignment.holds((six, ring), (six, ring))) == 6


def test_atoms_on_paths_by_brute_force(spark):
    r, rows, want = random.Random(0), [], set()
    for mol in range(80):
        _, near = some_graph(r, r.randint(3, 8), 0.35)
        rows += [(mol, a, b) for a in near for b in near[a] if a < b]

        def go(path, near=near, mol=mol):
            if 1 in path:
                want.update((mol, a) for a in path)
            for b in near[path[-1]] - set(path):
                go([*path, b])

        go([0])
    got = {tuple(x) for x in graph.on_paths(spark.createDataFrame(rows, "mol_id long, a1 int, a2 int"), 0, 1).collect()}
    assert got == want


def test_patterns_by_brute_force(spark):
    r = random.Random(4)
    symbol, near = some_graph(r, 9, 0.35)
    atoms = spark.createDataFrame([(1, a, s, 0.0, 0.0, 0.0) for a, s in symbol.items()], ATOMS)
    bonds = spark.createDataFrame([(1, a, b) for a in near for b in near[a] if a < b], "mol_id long, a1 int, a2 int")
    for kinds, links in ((["C", "N"], [(0, 1)]), (["C", None, "O"], [(0, 1), (2, 1)]), ([None] * 3, [(0, 1), (1, 2), (2, 0)])):
        want = {p for p in permutations(symbol, len(kinds)) if all(k is None or symbol[a] == k for a, k in zip(p, kinds, strict=True)) and all(p[j] in near[p[i]] for i, j in links)}
        assert {tuple(x)[1:] for x in graph.match_pattern(atoms, bonds, kinds, links).collect()} == want
    with pytest.raises(ValueError):
        graph.match_pattern(atoms, bonds, ["C"] * 4, [(0, 1), (2, 3)])


def molecule(r, mol, n=12):
    """A chain with side atoms, about 1.5 apart."""
    p, rows, bonds = np.zeros(3), [], []
    at = []
    for i in range(1, n + 1):
        from_ = r.choice(range(max(0, len(at) - 3), len(at))) if at else None
        d = np.array([r.gauss(0, 1) for _ in range(3)])
        p = (at[from_] if at else p) + 1.5 * d / np.linalg.norm(d)
        at.append(p)
        rows.append((mol, i, r.choice("CCNO"), *map(float, p)))
        if from_ is not None:
            bonds.append((mol, from_ + 1, i))
    return rows, bonds


def test_renumbering_finds_the_numbers_again(spark):
    r = random.Random(6)
    made = [molecule(r, m) for m in range(8)]
    atoms = spark.createDataFrame([x for a, _ in made for x in a], ATOMS)
    bonds = spark.createDataFrame([x for _, b in made for x in b], "mol_id long, a1 int, a2 int")
    moved = alignment.shuffle_atoms(geometry.rigid_motion(atoms, (2.0, -1.0, 0.5), (0.3, 0.8, 1.1)))
    number = {(x["mol_id"], x["old_idx"]): x["atom_idx"] for x in moved.collect()}
    own = spark.createDataFrame([(m, *sorted((number[m, a], number[m, b]))) for _, bs in made for m, a, b in bs], bonds.schema)
    got = alignment.renumbering(moved.drop("old_idx"), atoms, own, bonds)
    back = {(x["mol_id"], x["old_idx"]): x["new_idx"] for x in got.collect()}
    assert len(back) == 96 and alignment.bad_maps(got).isEmpty()
    symbol = {(m, i): s for a, _ in made for m, i, s, *_ in a}
    right = sum(back[m, number[m, i]] == i for m, i in number)
    assert right >= 90 and all(symbol[m, back[m, number[m, i]]] == symbol[m, i] for m, i in number)
    every = alignment.renumber_all(atoms, bonds)
    assert every.count() == 96 and alignment.smallest(atoms).first()["mol_id"] == 0


def test_alike_atoms_change_partners(spark):
    target = spark.createDataFrame([(1, 1, "C", 0.0, 0.0, 0.0), (1, 2, "H", 1.0, 0.0, 0.0), (1, 3, "H", -1.0, 0.0, 0.0)], ATOMS)
    m = spark.createDataFrame([(1, 1, 1), (1, 2, 3), (1, 3, 2)], "mol_id long, old_idx int, new_idx int")
    classes = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, 1)], "mol_id long, atom_idx int, class int")
    assert {tuple(x)[1:] for x in alignment.swap_alike(m, target, target, classes).collect()} == {(1, 1), (2, 2), (3, 3)}


def test_rings_are_laid_on_each_other(spark):
    at = [(np.cos(k * np.pi / 3), np.sin(k * np.pi / 3)) for k in range(6)]
    target = spark.createDataFrame([(1, k + 1, "C", float(x), float(y), 0.0) for k, (x, y) in enumerate(at)], ATOMS)
    sample = spark.createDataFrame([(1, 7 - k, "C", float(x) + 0.01, float(y), 0.0) for k, (x, y) in enumerate(at, 1)], ATOMS)
    rings = spark.createDataFrame([(1, 1, 2, 3, 4, 5, 6)], "mol_id long, " + ", ".join(f"r{k} int" for k in range(1, 7)))
    assert {tuple(x)[1:] for x in alignment.ring_map(sample, target, rings, rings).collect()} == {(7 - k, k) for k in range(1, 7)}


def test_best_direction_by_brute_force(spark):
    r = random.Random(8)
    host = [(1, i, r.choice("CHO"), *(r.uniform(-2, 2) for _ in range(3))) for i in range(1, 7)]
    fragment = [("C", 0.0, 0.0, 0.0), ("O", 1.1, 0.5, 0.0), ("H", 0.5, -0.4, 0.7)]
    sphere = sampling.fibonacci_sphere(spark, 30).unionByName(spark.createDataFrame([(99, -1.0, 0.0, 0.0)], "i long, x double, y double, z double"))
    radius = {e[0]: e[4] for e in ELEMENTS}
    cost = {}
    for i, *d in sphere.collect():
        d = np.array(d)
        v = np.cross([1, 0, 0], d)
        k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
        turn = np.eye(3) + k + k @ k / (1 + d[0]) if d[0] > -1 + 1e-9 else np.diag([-1.0, -1.0, 1.0])
        placed = [(s, np.array(host[0][3:]) + 1.5 * d + turn @ p) for s, *p in fragment]
        cost[i] = sum(max(0, radius[s] + radius[h[2]] + 0.2 - np.linalg.norm(p - np.array(h[3:]))) ** 2 for s, p in placed for h in host)
    got = alignment.best_direction(spark.createDataFrame(host, ATOMS), spark.createDataFrame(fragment, "symbol string, x double, y double, z double"), 1, sphere).first()
    assert got["penalty"] == pytest.approx(min(cost.values())) and cost[got["i"]] == pytest.approx(min(cost.values()))


def test_sterimol_of_a_substituent(spark):
    """Of a chain C1-C2-O3 with a hydrogen behind the first atom: the hydrogen doesn't count, and the angle is that of the oxygen."""
    rows = [(1, 1, "C", 0.0, 0.0, 0.0), (1, 2, "C", 0.0, 1.5, 0.0), (1, 3, "O", 1.0, 2.5, 0.0), (1, 4, "H", -3.0, 0.0, 0.0)]
    atoms = spark.createDataFrame(rows, ATOMS)
    bonds = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 1, 4)], "mol_id long, a1 int, a2 int")
    whole, part = (sterimol.sterimol(atoms, (1, 2, 3), b).first() for b in (None, bonds))
    assert whole["b5"] == pytest.approx(4.1) and part["b5"] == pytest.approx(2.52) and part["l"] == pytest.approx(4.02) and part["loc_b5"] == pytest.approx(2.5)
    assert part["b1"] == pytest.approx(1.7) and 0 <= part["b1_b5_angle"] <= 90
    assert sterimol.sterimol(atoms, (1, 2, 3), bonds, drop=(4,)).first()["b5"] == part["b5"]


def test_ring_modes_take_the_sum_with_the_first_atom(spark):
    """A ring 1..6 in its own order: atoms 1, 3 and 5 move along the axis from 1 to 4, atoms 2, 4 and 6 across it."""
    at = [(np.cos(k * np.pi / 3), np.sin(k * np.pi / 3)) for k in range(6)]
    atoms = spark.createDataFrame([(1, k + 1, "C", float(x), float(y), 0.0) for k, (x, y) in enumerate(at)], ATOMS)
    rows = [(1, 1, 1650.0, k + 1, *((1.0, 0.0, 0.0) if k % 2 == 0 else (0.5, 1.0, 0.0))) for k in range(6)]
    moves = spark.createDataFrame(rows, "mol_id long, mode_idx int, frequency double, atom_idx int, x double, y double, z double")
    r = vibrations.ring_modes(moves, [1, 2, 3, 4, 5, 6], atoms).first()
    assert r["para_angle"] == pytest.approx(0, abs=1e-6)
    r = vibrations.ring_modes(moves, [2, 3, 4, 5, 6, 1], atoms).first()
    assert r["para_angle"] > 3  # from another first atom it is the other sum


def test_logs_into_tables_with_a_report(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "water.log").write_text(LOG)
    (tmp_path / "logs" / "broken.log").write_text(" Entering\n SCF Done:  E(X) =  -1.0\n")
    report = {r["mol_id"]: r["errors"] for r in quantum.write_logs(spark, str(tmp_path / "logs"), str(tmp_path / "out")).collect()}
    assert report["water"] == [] and "no geometry" in report["broken"] and "no energy" not in report["broken"]
    wide = spark.read.parquet(str(tmp_path / "out" / "wide"))
    assert wide.where("mol_id = 'water'").count() == 3 and wide.where("mol_id = 'broken' AND atom_idx IS NULL").first()["scf_energy"] == -1.0
    row = wide.where("atom_idx = 2").first()
    assert (row["symbol"], row["nbo_charge"], row["cm5_charge"], row["total_dipole"]) == ("H", 0.459, 0.325, 2.0915)
    assert spark.read.parquet(str(tmp_path / "out" / "displacements")).count() == 9


def test_wide_feather_frames_fall_into_six_tables(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.feather as feather

    t = pa.table({"atom": ["O", "H", None], "x": [0.0, 1.0, None], "y": [0.0, 0.0, None], "z": [0.0, 0.0, None], "dip_x": [1.0, None, None], "dip_y": [2.0, None, None], "dip_z": [2.0, None, None], "total_dipole": [3.0, None, None], "iso": [5.0, None, None], "aniso": [6.0, None, None], "nbo_charge": [-0.5, 0.5, None], "Frequency": [10.0, 20.0, 30.0], "IR": [1.0, 2.0, 3.0], "mode_0_x": [0.1, 0.2, None], "mode_0_y": [0.3, 0.4, None], "mode_0_z": [0.5, 0.6, None]})
    feather.write_feather(t, str(tmp_path / "w.feather"))
    six = quantum.feather_tables(quantum.read_feather(spark, str(tmp_path)))
    assert {k: v.count() for k, v in six.items()} == {"atoms": 2, "dipole": 1, "polarizability": 1, "info": 3, "charges": 2, "displacements": 2}
    assert six["displacements"].where("atom_idx = 2").first()["z"] == 0.6 and six["dipole"].first()["total"] == 3.0


def test_small_readers(spark, tmp_path):
    cube = "c1\nc2\n1 0.0 0.0 0.0\n1 1.0 0 0\n1 0 1.0 0\n1 0 0 1.0\n8 8.0 0.0 1.0 2.0\n0.5\n"
    files = spark.createDataFrame([("m", cube)], "mol_id string, text string")
    a = quantum.cube_atoms(files).first()
    assert a["symbol"] == "O" and a["z"] == pytest.approx(2 * quantum.BOHR)
    for name, text, coding in (("a", "Name,SMILES\né,C\n", "utf-8"), ("b", "Name,SMILES\né,C\n", "latin-1"), ("c", "Name,SMILES\né,C\n", "utf-16")):
        (tmp_path / f"{name}.csv").write_bytes(text.encode(coding))
        assert results.read_identifiers(spark, str(tmp_path / f"{name}.csv")).first()["name"] == "é"
    (tmp_path / "q.json").write_text(json.dumps({"atoms": "1,2 3,4"}))
    assert quantum.read_request(str(tmp_path / "q.json")) == {"atoms": "1,2 3,4"}
    opt = spark.createDataFrame([("m", "! R1 R(2,1) 1.50 -DE/DX = 0.0 !\n! R1 R(2,1) 1.40 !\n")], "mol_id string, text string")
    assert [tuple(r) for r in quantum.log_bonds(opt).collect()] == [("m", 1, 2, 1.4)]


def test_storage_is_shared_or_an_error(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://a:7077", "x"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="checkpoint"):
        storage.shared_dir(Session())
    df = storage.durable(spark.range(3))
    assert df.count() == 3 and storage.clear(spark) >= 1 and storage.clear(spark) == 0


def most_sorted(df):
    """The operators of a plan that hold a task's rows at once, all but those of whole molecules."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x.strip() for x in plan.splitlines() if "SortMergeJoin" in x or " Window " in x or "CartesianProduct" in x]


def test_bonds_are_found_in_a_molecules_own_row(spark, data):
    """Pairs are many times the atoms: none are sorted or windowed, and their tasks aren't merged to few."""
    from gneiss.plans import catalogue

    for name in ("base_atoms", "common_neighbour", "connectivity", "pair_distances"):
        df = catalogue.QUERIES[name](spark, data)
        assert not most_sorted(df), name
        assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")), name
    for name in ("bond_angles", "atom_types"):  # one join, on the molecule
        assert len(most_sorted(catalogue.QUERIES[name](spark, data))) <= 1, name


def test_contacts_are_ranked_as_in_sql(spark):
    """Metals keep six, halogens one; atoms that come twice, without a molecule or without a number are as in a join."""
    import duckdb

    r = random.Random(5)
    rows = [(m, i, r.choice(["C", "H", "Cl", "Fe", "N"]), *(round(r.uniform(0, 4), 1) for _ in range(3))) for m in range(30) for i in range(1, 15)]
    rows += [rows[0], rows[17], (None, 1, "C", 0.0, 0.0, 0.0), (None, 2, "C", 1.0, 0.0, 0.0), (3, None, "C", 0.0, 0.0, 0.0), (40, 1, "C", 0.0, 0.0, 0.0)]
    c = duckdb.connect()
    c.execute("CREATE TABLE atoms(mol_id BIGINT, atom_idx INT, symbol VARCHAR, x DOUBLE, y DOUBLE, z DOUBLE)")
    c.executemany("INSERT INTO atoms VALUES (?, ?, ?, ?, ?, ?)", rows)
    c.execute("CREATE TABLE pairs AS SELECT a.mol_id, a.atom_idx AS a1, b.atom_idx AS a2, a.symbol AS s1, b.symbol AS s2, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS dist FROM atoms a JOIN atoms b ON a.mol_id = b.mol_id AND a.atom_idx < b.atom_idx")
    c.execute("""CREATE TABLE found AS SELECT * FROM pairs WHERE (dist < 2.12 AND NOT (s1 = 'H' AND s2 = 'H') AND (NOT (s1 = 'H' OR s2 = 'H') OR dist < 1.5)) OR ((s1 = 'Cl' OR s2 = 'Cl') AND NOT (s1 = 'Fe' OR s2 = 'Fe') AND dist >= 2.12 AND dist < 2.6) OR ((s1 = 'Fe' OR s2 = 'Fe') AND dist <= 2.8)""")
    ranked = "SELECT *, row_number() OVER (PARTITION BY mol_id, atom ORDER BY dist, a1, a2) AS k FROM (SELECT mol_id, a1, a2, dist, a1 AS atom, s1 AS s FROM found UNION ALL SELECT mol_id, a1, a2, dist, a2, s2 FROM found)"
    c.execute(f"CREATE TABLE bonds AS SELECT f.mol_id, f.a1, f.a2, f.dist FROM found f ANTI JOIN ({ranked} QUALIFY (s = 'Cl' AND k > 1) OR (s = 'Fe' AND k > 6)) s ON s.mol_id = f.mol_id AND s.a1 = f.a1 AND s.a2 = f.a2")
    atoms = spark.createDataFrame(rows, ATOMS)
    bonds = graph.connectivity(atoms)
    plain = lambda found: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in x) for x in found)
    want = plain(c.execute("FROM bonds").fetchall())
    assert plain(bonds.collect()) == want and len(want) > 500
    assert plain(geometry.pairs(atoms).select("mol_id", "a1", "a2", "dist").collect()) == plain(c.execute("SELECT mol_id, a1, a2, dist FROM pairs").fetchall())
    near = "near AS (SELECT mol_id, a1 AS atom, a2 AS other FROM bonds UNION ALL SELECT mol_id, a2, a1 FROM bonds)"
    triples = c.execute(f"WITH {near} SELECT a.mol_id, a.other, a.atom, b.other FROM near a JOIN near b ON a.mol_id = b.mol_id AND a.atom = b.atom AND a.other < b.other").fetchall()
    assert plain(graph.common_neighbour(bonds).collect()) == plain(triples)
    count = c.execute(f"WITH {near} SELECT a.mol_id, a.atom_idx, a.symbol, (SELECT count(*) FROM near n WHERE n.mol_id = a.mol_id AND n.atom = a.atom_idx) FROM atoms a").fetchall()
    assert sorted(map(tuple, graph.degrees(atoms, bonds).collect()), key=repr) == sorted(count, key=repr)


def test_renumbering_is_its_steps_in_a_molecules_own_row(spark):
    """The same as the operators one by one, without a group or a join of frames; lone, short and unknown molecules too."""
    r = random.Random(12)
    made = [molecule(r, m, 9) for m in range(12)]
    atoms = spark.createDataFrame([x for a, _ in made for x in a if x[0] != 3 or x[1] < 6] + [(77, 1, "C", 0.0, 0.0, 0.0), (77, 2, "O", None, 0.0, 0.0)], ATOMS)
    bonds = spark.createDataFrame([x for _, b in made for x in b], "mol_id long, a1 int, a2 int")
    moved = alignment.shuffle_atoms(geometry.rigid_motion(atoms.where("mol_id <> 5"), (2.0, -1.0, 0.5), (0.3, 0.8, 1.1))).drop("old_idx")
    target = atoms.where("mol_id <> 6 AND (mol_id <> 7 OR atom_idx < 5)")
    got = alignment.renumbering(moved, target, bonds, bonds)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Group" not in plan.replace("CoGroup", "Group").replace("HashAggregate", "") and "Join" not in plan
    core = storage.durable(alignment.common_substructure(moved, target, bonds, bonds))
    rest = lambda t, c: t.join(core.select("mol_id", F.col(c).alias("atom_idx")), ["mol_id", "atom_idx"], "left_anti")
    more = alignment.growing_match(rest(alignment.align(moved, target, core), "old_idx"), rest(target, "new_idx")).toDF("mol_id", "old_idx", "new_idx", "dist").drop("dist")
    both = storage.durable(core.unionByName(more))
    again = alignment.align(moved, target, both)
    want = paths.closed_map(alignment.swap_alike(both, again, target, paths.atom_classes(target, bonds)), moved)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.where("mol_id = 6").count() == 9


def test_common_substructure_makes_no_frame_a_molecule(spark):
    """Rows of molecules, not groups, in the session's partitions, with the result of the search on each pair of graphs."""
    r = random.Random(13)
    graphs = {m: [some_graph(r, r.randint(3, 9), 0.35) for _ in range(2)] for m in range(40)}
    sides = [spark.createDataFrame([(m, a, s, 0.0, 0.0, 0.0) for m, g in graphs.items() for a, s in g[k][0].items()], ATOMS) for k in (0, 1)]
    bonds = [spark.createDataFrame([(m, a, b) for m, g in graphs.items() for a in g[k][1] for b in g[k][1][a] if a < b], "mol_id long, a1 int, a2 int") for k in (0, 1)]
    got = alignment.common_substructure(*sides, *bonds)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan and got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    want = {(m, a, b) for m, g in graphs.items() for best in [alignment.largest_common(*g)] if len(best) >= 3 for a, b in best.items()}
    assert {tuple(x) for x in got.collect()} == want and len(want) > 50
