"""Every registered query of the engine's own operators, with its SQL.

Queries run over whole tables. Doubles are rounded after all arithmetic, and negative zeros removed, so that two engines agree.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.operators import alignment, classification, diagnostics, features, geometry, graph, logit, paths, ranks, regression, sampling, sterics, sterimol, vibrations
from gneiss.plans import sqlgen as S
from gneiss.plans.registry import ORACLE_SQL, QUERIES, rd, register  # noqa: F401  the entry points read the first two here
from gneiss.plans.sqlgen import BONDS, NEAR, PAIRS, SQL_ATOMS, SQL_CHARGES, SQL_MOVES, SQL_SAMPLES, framed_cte, frame_ctes, pick, query, v
from gneiss.sources import sinks, tables, text_blocks
from gneiss.streaming.ingest import windowed

BASE = (1, 2, 3)


# --- geometry ---------------------------------------------------------------------------------------------------------


@register("bond_length", query(SQL_ATOMS, pick("p", 1, 2), select=f"SELECT mol_id, {rd(S.norm(S.sub(v(0), v(1))), 'length')} FROM p"))
def bond_length(spark, d):
    return geometry.bond_length(tables.atoms(spark, d), 1, 2)


@register("pair_distances", query(SQL_ATOMS, PAIRS, select=f"SELECT mol_id, count(*) AS n, {rd('min(dist)', 'least')}, {rd('max(dist)', 'most')}, {rd('avg(dist)', 'mean')} FROM pairs GROUP BY mol_id"))
def pair_distances(spark, d):
    return geometry.pairs(tables.atoms(spark, d)).groupBy("mol_id").agg(F.count("*").alias("n"), F.min("dist").alias("least"), F.max("dist").alias("most"), F.avg("dist").alias("mean"))


@register("bond_angle", query(SQL_ATOMS, pick("p", 1, 2, 3), select=f"SELECT mol_id, {rd(S.angle(S.sub(v(0), v(1)), S.sub(v(2), v(1))), 'angle')} FROM p"))
def bond_angle(spark, d):
    return geometry.bond_angle(tables.atoms(spark, d), 1, 2, 3)


_d1, _d2 = S.cross(S.sub(v(1), v(0)), S.sub(v(2), v(1))), S.cross(S.sub(v(2), v(1)), S.sub(v(3), v(2)))


@register("dihedral", query(SQL_ATOMS, pick("p", 1, 2, 3, 4), select=f"SELECT mol_id, {rd(S.angle(_d1, _d2), 'dihedral')} FROM p"))
def dihedral(spark, d):
    return geometry.dihedral(tables.atoms(spark, d), 1, 2, 3, 4)


@register("too_close", query(SQL_ATOMS, PAIRS, select=f"SELECT mol_id, a1, a2, {rd('dist', 'dist')} FROM pairs WHERE dist < 0.9"))
def too_close(spark, d):
    return geometry.too_close(tables.atoms(spark, d), 0.9)


@register("centroid", query(SQL_ATOMS, select="SELECT mol_id, " + ", ".join(rd(f"avg({c})", c) for c in "xyz") + " FROM atoms WHERE atom_idx IN (1, 2, 3, 4, 5, 6) GROUP BY mol_id"))
def centroid(spark, d):
    return geometry.centroid(tables.atoms(spark, d), [1, 2, 3, 4, 5, 6])


SQL_MASS = "mass AS (SELECT *, CASE symbol WHEN 'H' THEN 1.008::DOUBLE WHEN 'C' THEN 12.011::DOUBLE WHEN 'N' THEN 14.007::DOUBLE WHEN 'O' THEN 15.999::DOUBLE ELSE 35.45::DOUBLE END AS w FROM atoms), com AS (SELECT mol_id, sum(w*x)/sum(w) AS x, sum(w*y)/sum(w) AS y, sum(w*z)/sum(w) AS z FROM mass GROUP BY mol_id)"


@register("center_of_mass", query(SQL_ATOMS, SQL_MASS, select="SELECT mol_id, " + ", ".join(rd(c, c) for c in "xyz") + " FROM com"))
def center_of_mass(spark, d):
    return geometry.center_of_mass(tables.atoms(spark, d))


@register("nearest_to_center", query(SQL_ATOMS, SQL_MASS, "far AS (SELECT a.mol_id, a.atom_idx, sqrt((a.x-c.x)*(a.x-c.x)+(a.y-c.y)*(a.y-c.y)+(a.z-c.z)*(a.z-c.z)) AS dist FROM atoms a JOIN com c USING (mol_id))", select=f"SELECT mol_id, atom_idx, {rd('dist', 'dist')} FROM far QUALIFY row_number() OVER (PARTITION BY mol_id ORDER BY dist, atom_idx) = 1"))
def nearest_to_center(spark, d):
    return geometry.nearest_to_center(tables.atoms(spark, d))


@register("frame_transform", query(SQL_ATOMS, framed_cte(BASE), select="SELECT mol_id, atom_idx, symbol, " + ", ".join(rd(c, c, 4) for c in "xyz") + " FROM framed"), 4)
def frame_transform(spark, d):
    return geometry.frame_transform(tables.atoms(spark, d), BASE)


_mid = tuple(f"(({c}3 + {c}4) / 2)" for c in "xyz")


@register("frame_midpoint", query(SQL_ATOMS, pick("p", 2, 3, 4, 1, 2), f"q AS (SELECT mol_id, {', '.join(f'{m} AS {c}9' for m, c in zip(_mid, 'xyz', strict=True))}, x0, y0, z0 FROM p)", select=f"SELECT a.mol_id, a.atom_idx, {rd(S.dot(S.sub(('a.x', 'a.y', 'a.z'), v(9)), S.sub(('p.x1', 'p.y1', 'p.z1'), v(9))) + ' / ' + S.norm(S.sub(('p.x1', 'p.y1', 'p.z1'), v(9))), 'y')} FROM atoms a JOIN q ON a.mol_id = q.mol_id JOIN p ON a.mol_id = p.mol_id"))
def frame_midpoint(spark, d):
    return geometry.frame_transform(tables.atoms(spark, d), (2, 3, 4), (1, 2)).select("mol_id", "atom_idx", "y")


@register("npa_dipole", query(SQL_ATOMS, SQL_CHARGES, framed_cte(BASE), "s AS (SELECT f.mol_id, sum(c.charge*f.x) AS dx, sum(c.charge*f.y) AS dy, sum(c.charge*f.z) AS dz FROM framed f JOIN charges c ON f.mol_id = c.mol_id AND f.atom_idx = c.atom_idx GROUP BY f.mol_id)", select=f"SELECT mol_id, {rd('dx', 'dip_x')}, {rd('dy', 'dip_y')}, {rd('dz', 'dip_z')}, {rd('sqrt(dx*dx+dy*dy+dz*dz)', 'total')} FROM s"))
def npa_dipole(spark, d):
    return geometry.npa_dipole(tables.atoms(spark, d), tables.charges(spark, d), BASE)


def _dipoles(spark, d):
    return tables.table(spark, d, "embeddings").select(F.col("vec_id").alias("mol_id"), *[F.get("embedding", F.lit(61 + i)).cast("double").alias(n) for i, n in enumerate(("dx", "dy", "dz"))])


@register("dipole_rotated", query(SQL_ATOMS, frame_ctes(BASE), "dip AS (SELECT vec_id AS mol_id, CAST(embedding[62] AS DOUBLE) AS dx, CAST(embedding[63] AS DOUBLE) AS dy, CAST(embedding[64] AS DOUBLE) AS dz FROM embeddings)", select="SELECT mol_id, " + ", ".join(rd(f"dx*{u}x + dy*{u}y + dz*{u}z", f"dip_{c}") for u, c in zip("uvw", "xyz", strict=True)) + f", {rd('sqrt(dx*dx+dy*dy+dz*dz)', 'total')} FROM dip JOIN axes USING (mol_id)"))
def dipole_rotated(spark, d):
    return geometry.rotated_dipole(tables.atoms(spark, d), _dipoles(spark, d), BASE)


@register("charge_pivot", query(SQL_CHARGES, select="SELECT mol_id, " + ", ".join(rd(f"max(charge) FILTER (atom_idx = {i})", f"nbo_atom_{i}") for i in (1, 2, 5)) + " FROM charges GROUP BY mol_id"))
def charge_pivot(spark, d):
    return geometry.charges_at(tables.charges(spark, d), [1, 2, 5])


@register("charge_difference", query(SQL_CHARGES, select=f"SELECT a.mol_id, {rd('a.charge - b.charge', 'difference')} FROM charges a JOIN charges b ON a.mol_id = b.mol_id WHERE a.atom_idx = 1 AND b.atom_idx = 4"))
def charge_difference(spark, d):
    return geometry.charge_difference(tables.charges(spark, d), 1, 4)


@register("swap_atoms", query(SQL_ATOMS, select="SELECT a.mol_id, a.atom_idx, a.symbol, " + ", ".join(rd(f"b.{c}", c) for c in "xyz") + " FROM atoms a JOIN atoms b ON a.mol_id = b.mol_id AND b.atom_idx = CASE a.atom_idx WHEN 2 THEN 5 WHEN 5 THEN 2 ELSE a.atom_idx END"))
def swap_atoms(spark, d):
    return geometry.swap_atoms(tables.atoms(spark, d), 2, 5)


@register("rigid_motion", query(SQL_ATOMS, "r1 AS (SELECT mol_id, atom_idx, x, y*cos(0.3)-z*sin(0.3) AS y, y*sin(0.3)+z*cos(0.3) AS z FROM atoms)", "r2 AS (SELECT mol_id, atom_idx, x*cos(0.5)+z*sin(0.5) AS x, y, z*cos(0.5)-x*sin(0.5) AS z FROM r1)", "r3 AS (SELECT mol_id, atom_idx, x*cos(0.7)-y*sin(0.7) AS x, x*sin(0.7)+y*cos(0.7) AS y, z FROM r2)", select=f"SELECT mol_id, atom_idx, {rd('x + 1', 'x')}, {rd('y - 2', 'y')}, {rd('z + 3', 'z')} FROM r3"))
def rigid_motion(spark, d):
    return geometry.rigid_motion(tables.atoms(spark, d), (1.0, -2.0, 3.0), (0.3, 0.5, 0.7)).drop("symbol")


_cos = lambda t: f"SELECT a.mol_id, a.atom_idx AS a1, b.atom_idx AS a2, 1 - (a.x*b.x+a.y*b.y+a.z*b.z)/(sqrt(a.x*a.x+a.y*a.y+a.z*a.z)*sqrt(b.x*b.x+b.y*b.y+b.z*b.z)) AS d FROM {t} a JOIN {t} b ON a.mol_id = b.mol_id AND a.atom_idx < b.atom_idx"


@register("cosine_distance_difference", query(SQL_ATOMS, "moved AS (SELECT mol_id, atom_idx, x + 1 AS x, y + 0.5::DOUBLE AS y, z FROM atoms)", f"f AS ({_cos('atoms')})", f"g AS ({_cos('moved')})", select=f"SELECT f.mol_id, {rd('avg(abs(f.d - g.d))', 'difference')} FROM f JOIN g ON f.mol_id = g.mol_id AND f.a1 = g.a1 AND f.a2 = g.a2 GROUP BY f.mol_id"))
def cosine_distance_difference(spark, d):
    a = tables.atoms(spark, d)
    return geometry.cosine_distance_difference(a, a.withColumn("x", F.col("x") + 1).withColumn("y", F.col("y") + 0.5))


@register("ee_from_ddg", f"SELECT event_id, {rd('100 * tanh(-(value / 50 - 1) / (2 * 0.0019872041 * 298.15))', 'ee')}, abs(100 * tanh(-(value / 50 - 1) / (2 * 0.0019872041 * 298.15))) >= 35 AS selective FROM events")
def ee_from_ddg(spark, d):
    ddg = F.col("value") / 50 - 1
    return tables.table(spark, d, "events").select("event_id", geometry.enantiomeric_excess(ddg).alias("ee"), geometry.selectivity(ddg).alias("selective"))


# --- graphs -----------------------------------------------------------------------------------------------------------

SQL_GRAPH = (SQL_ATOMS, PAIRS, BONDS)


@register("connectivity", query(*SQL_GRAPH, select=f"SELECT mol_id, a1, a2, {rd('dist', 'dist')} FROM bonds"))
def connectivity(spark, d):
    return graph.connectivity(tables.atoms(spark, d))


_covalent = "CASE {s} WHEN 'H' THEN 0.31::DOUBLE WHEN 'C' THEN 0.76::DOUBLE WHEN 'N' THEN 0.71::DOUBLE WHEN 'O' THEN 0.66::DOUBLE ELSE 1.02::DOUBLE END"


@register("covalent_bonds", query(SQL_ATOMS, PAIRS, select=f"SELECT mol_id, a1, a2, {rd('dist', 'dist')} FROM pairs WHERE dist < ({_covalent.format(s='s1')} + {_covalent.format(s='s2')}) * 1.08::DOUBLE"))
def covalent_bonds(spark, d):
    return graph.covalent_bonds(tables.atoms(spark, d))


@register("atom_types", query(*SQL_GRAPH, NEAR, "deg AS (SELECT mol_id, atom, count(*) AS n FROM near GROUP BY 1, 2)", "t AS (SELECT a.mol_id, a.atom_idx, a.symbol AS s, coalesce(n, 0) AS n FROM atoms a LEFT JOIN deg ON a.mol_id = deg.mol_id AND a.atom_idx = deg.atom)", select="SELECT mol_id, atom_idx, CASE WHEN s = 'H' THEN 'H' WHEN s = 'O' THEN CASE WHEN n < 2 THEN 'O2' ELSE 'O' END WHEN s = 'N' THEN CASE WHEN n < 2 THEN 'N1' WHEN n < 3 THEN 'N2' ELSE 'N' END WHEN s = 'C' THEN CASE WHEN n < 3 THEN 'C3' WHEN n = 3 THEN 'C2' ELSE 'C' END ELSE s END AS atype FROM t"))
def atom_types(spark, d):
    a = tables.atoms(spark, d)
    return graph.atom_types(a, graph.connectivity(a))


@register("common_neighbour", query(*SQL_GRAPH, NEAR, select='SELECT a.mol_id, a.other AS "left", a.atom AS center, b.other AS "right" FROM near a JOIN near b ON a.mol_id = b.mol_id AND a.atom = b.atom AND a.other < b.other'))
def common_neighbour(spark, d):
    return graph.common_neighbour(graph.connectivity(tables.atoms(spark, d)))


_tri = S.angle(S.sub(("l.x", "l.y", "l.z"), ("c.x", "c.y", "c.z")), S.sub(("r.x", "r.y", "r.z"), ("c.x", "c.y", "c.z")))


@register("bond_angles", query(*SQL_GRAPH, NEAR, "t AS (SELECT a.mol_id, a.other AS lf, a.atom AS ce, b.other AS ri FROM near a JOIN near b ON a.mol_id = b.mol_id AND a.atom = b.atom AND a.other < b.other)", select=f'SELECT t.mol_id, lf AS "left", ce AS center, ri AS "right", {rd(_tri, "angle")} FROM t JOIN atoms l ON l.mol_id = t.mol_id AND l.atom_idx = lf JOIN atoms c ON c.mol_id = t.mol_id AND c.atom_idx = ce JOIN atoms r ON r.mol_id = t.mol_id AND r.atom_idx = ri'))
def bond_angles(spark, d):
    a = tables.atoms(spark, d)
    return graph.bond_angles(a, graph.connectivity(a))


@register("has_bond", query(*SQL_GRAPH, select="SELECT mol_id FROM bonds WHERE a1 = 1 AND a2 = 2"))
def has_bond(spark, d):
    return graph.has_bond(graph.connectivity(tables.atoms(spark, d)), 2, 1)


SQL_SPARSE = "bonds AS (SELECT mol_id, a1, a2, dist FROM pairs WHERE dist < 1.25::DOUBLE)"


@register("reachable", "WITH RECURSIVE " + ",\n".join([SQL_ATOMS, PAIRS, SQL_SPARSE, NEAR, "walk AS (SELECT DISTINCT mol_id, 2 AS atom FROM bonds UNION SELECT w.mol_id, n.other FROM walk w JOIN near n ON n.mol_id = w.mol_id AND n.atom = w.atom WHERE n.other <> 1 AND n.atom <> 1)"]) + "\nSELECT mol_id, atom FROM walk UNION SELECT DISTINCT mol_id, 1 FROM bonds")
def reachable(spark, d):
    return graph.reachable(geometry.pairs(tables.atoms(spark, d)).where("dist < 1.25").select("mol_id", "a1", "a2"), 1, 2)


_steps = " ".join(f"JOIN near n{k} ON n{k}.mol_id = n1.mol_id AND n{k}.atom = n{k - 1}.other" for k in range(2, 7))
_differ = " AND ".join(f"n{k}.other > n1.atom AND n{k}.other NOT IN ({', '.join(f'n{j}.other' for j in range(1, k))})" for k in range(2, 6))


@register("six_rings", query(SQL_ATOMS, PAIRS, SQL_SPARSE, NEAR, select=f"SELECT n1.mol_id, n1.atom AS r1, n1.other AS r2, n2.other AS r3, n3.other AS r4, n4.other AS r5, n5.other AS r6 FROM near n1 {_steps} WHERE n1.other > n1.atom AND {_differ} AND n6.other = n1.atom AND n1.other < n5.other"))
def six_rings(spark, d):
    return graph.six_rings(geometry.pairs(tables.atoms(spark, d)).where("dist < 1.25").select("mol_id", "a1", "a2"))


@register("bonds_without_atoms", query(*SQL_GRAPH, select="SELECT mol_id, a1, a2 FROM bonds b WHERE NOT EXISTS (SELECT 1 FROM atoms a WHERE a.mol_id = b.mol_id AND a.symbol = 'H' AND a.atom_idx IN (b.a1, b.a2))"))
def bonds_without_atoms(spark, d):
    a = tables.atoms(spark, d)
    return graph.without_atoms(graph.connectivity(a), a.where("symbol = 'H'")).select("mol_id", "a1", "a2")


@register("bond_difference", query(*SQL_GRAPH, f"other AS (SELECT mol_id, a1, a2 FROM pairs WHERE dist < ({_covalent.format(s='s1')} + {_covalent.format(s='s2')}) * 1.3::DOUBLE)", select="SELECT coalesce(b.mol_id, o.mol_id) AS mol_id, coalesce(b.a1, o.a1) AS a1, coalesce(b.a2, o.a2) AS a2, CASE WHEN o.mol_id IS NULL THEN 'left_only' WHEN b.mol_id IS NULL THEN 'right_only' ELSE 'both' END AS side FROM bonds b FULL JOIN other o ON b.mol_id = o.mol_id AND b.a1 = o.a1 AND b.a2 = o.a2"))
def bond_difference(spark, d):
    a = tables.atoms(spark, d)
    return graph.bond_difference(graph.connectivity(a), graph.covalent_bonds(a, 1.3))


# --- vibrations -------------------------------------------------------------------------------------------------------

_keys = "mol_id, mode_idx, frequency"
_bond = S.sub(v(1), v(0))


def _best(rated: str, order: str = "amplitude DESC, mode_idx") -> str:
    return f"SELECT mol_id, {rd('frequency', 'frequency')}, {rd('amplitude', 'amplitude')} FROM ({rated}) QUALIFY row_number() OVER (PARTITION BY mol_id ORDER BY {order}) = 1"


_mv = lambda k: (f"mx{k}", f"my{k}", f"mz{k}")


@register("stretch_mode", query(SQL_ATOMS, SQL_MOVES, pick("p", 1, 2), pick("m", 1, 2, source="moves", keys=_keys, letter="m"), select=_best(f"SELECT m.mol_id, mode_idx, frequency, abs({S.dot(_mv(0), _bond)}) + abs({S.dot(_mv(1), _bond)}) AS amplitude FROM m JOIN p ON m.mol_id = p.mol_id WHERE frequency > 1400 AND frequency < 3500")))
def stretch_mode(spark, d):
    return vibrations.stretch_mode(tables.displacements(spark, d), tables.atoms(spark, d), 1, 2)


@register("bend_mode", query(SQL_ATOMS, SQL_MOVES, pick("m", 1, 3, source="moves", keys=_keys), select=_best(f"SELECT mol_id, mode_idx, frequency, {S.norm(S.cross(v(0), v(1)))} AS amplitude FROM m WHERE frequency > 1300")))
def bend_mode(spark, d):
    return vibrations.bend_mode(tables.displacements(spark, d), 1, 3)


@register("strongest_mode", query(SQL_ATOMS, SQL_MOVES, select=_best("SELECT mol_id, mode_idx, frequency, sqrt(x*x+y*y+z*z) AS amplitude FROM moves WHERE atom_idx = 7 AND frequency > 1500")))
def strongest_mode(spark, d):
    return vibrations.strongest_mode(tables.displacements(spark, d), 7)


_odd, _even = tuple(f"(m{c}0 + m{c}2 + m{c}4)" for c in "xyz"), tuple(f"(m{c}1 + m{c}3 + m{c}5)" for c in "xyz")
_sine = f"least(1.0, {S.norm(S.cross(_odd, _bond))} / ({S.norm(_odd)} * {S.norm(_bond)}))"


@register("ring_modes", query(SQL_ATOMS, SQL_MOVES, pick("p", 1, 4), pick("m", 1, 2, 3, 4, 5, 6, source="moves", keys=_keys, letter="m"), f"r AS (SELECT m.mol_id, frequency, {S.dot(_odd, _even)} AS pr, {_sine} AS s FROM m JOIN p ON m.mol_id = p.mol_id WHERE frequency > 1600 AND frequency < 1750)", select=f"SELECT mol_id, {rd('arg_min(frequency, (s, frequency))', 'para')}, {rd('degrees(asin(min(s)))', 'para_angle')}, {rd('arg_max(frequency, (s, frequency))', chr(34) + 'cross' + chr(34))}, {rd('degrees(asin(max(s)))', 'cross_angle')} FROM r WHERE abs(pr) > 0.01 GROUP BY mol_id"))
def ring_modes(spark, d):
    return vibrations.ring_modes(tables.displacements(spark, d), [1, 2, 3, 4, 5, 6], tables.atoms(spark, d))


@register("similar_amplitude", query(SQL_ATOMS, SQL_MOVES, "a AS (SELECT mol_id, mode_idx, atom_idx, sqrt(x*x+y*y+z*z) AS far FROM moves)", select="SELECT a.mol_id, a.mode_idx, count(*) AS n FROM a JOIN a b ON a.mol_id = b.mol_id AND a.mode_idx = b.mode_idx AND b.atom_idx = 1 WHERE a.atom_idx <> 1 AND abs(a.far - b.far) <= 1e-8 + 0.1::DOUBLE * abs(b.far) GROUP BY a.mol_id, a.mode_idx"))
def similar_amplitude(spark, d):
    return vibrations.similar_amplitude(tables.displacements(spark, d), 1)


@register("ground_state", "SELECT vec_id AS mol_id, min(e) >= 0 AS ground_state FROM (SELECT vec_id, unnest(embedding[1:8]) AS e FROM embeddings) GROUP BY vec_id")
def ground_state(spark, d):
    return vibrations.ground_state(tables.table(spark, d, "embeddings").select(F.col("vec_id").alias("mol_id"), F.explode(F.slice("embedding", 1, 8)).alias("frequency")))


# --- sterimol ---------------------------------------------------------------------------------------------------------

_bondi = "CASE symbol WHEN 'H' THEN 1.10::DOUBLE WHEN 'C' THEN 1.70::DOUBLE WHEN 'N' THEN 1.55::DOUBLE WHEN 'O' THEN 1.52::DOUBLE ELSE 1.75::DOUBLE END"
SQL_EXTENT = f"e AS (SELECT *, r + sqrt(x*x + z*z) AS b5, y + r AS l FROM (SELECT *, {_bondi} AS r FROM framed))"


@register("sterimol_l_b5", query(SQL_ATOMS, framed_cte(BASE), SQL_EXTENT, select=f"SELECT mol_id, {rd('max(l)', 'l', 4)}, {rd('max(b5)', 'b5', 4)}, {rd('arg_max(y, (b5, y))', 'loc_b5', 4)} FROM e GROUP BY mol_id"), 4)
def sterimol_l_b5(spark, d):
    return sterimol.l_b5(tables.atoms(spark, d), BASE)


@register("sterimol_b1", query(SQL_ATOMS, framed_cte(BASE), SQL_EXTENT, "h AS (SELECT mol_id, t, max(x * cos(t * pi() / 180) + z * sin(t * pi() / 180) + r) AS h FROM e, (SELECT unnest(range(0, 360)) AS t) GROUP BY mol_id, t)", select=f"SELECT mol_id, {rd('min(h)', 'b1', 4)} FROM h GROUP BY mol_id"), 4)
def sterimol_b1(spark, d):
    return sterimol.b1(tables.atoms(spark, d), BASE).drop("degree")


@register("width_slices", query(SQL_ATOMS, framed_cte(BASE), SQL_EXTENT, "c AS (SELECT *, sqrt(r*r - (s - y)*(s - y)) AS rho FROM e, (SELECT unnest([0.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE]) AS s) WHERE abs(s - y) <= r)", "h AS (SELECT mol_id, s, t, max(x * cos(t * pi() / 180) + z * sin(t * pi() / 180) + rho) AS h FROM c, (SELECT unnest(range(0, 360, 10)) AS t) GROUP BY mol_id, s, t)", select=f"SELECT mol_id, s AS height, {rd('min(h)', 'b1', 4)}, {rd('max(h)', 'b5', 4)} FROM h GROUP BY mol_id, s"), 4)
def width_slices(spark, d):
    return sterimol.width_slices(tables.atoms(spark, d), BASE, [0.0, 1.0, 2.0])


@register("buried_volume", query(SQL_ATOMS, "g AS (SELECT i * 0.5::DOUBLE AS i, j * 0.5::DOUBLE AS j, k * 0.5::DOUBLE AS k FROM (SELECT unnest(range(-7, 8)) AS i), (SELECT unnest(range(-7, 8)) AS j), (SELECT unnest(range(-7, 8)) AS k) WHERE (i*i + j*j + k*k) * 0.25 <= 12.25)", f"o AS (SELECT *, {_bondi} * 1.17::DOUBLE AS r FROM atoms WHERE atom_idx <> 1)", "c AS (SELECT a.mol_id, i, j, k, bool_or((a.x + i - o.x)*(a.x + i - o.x) + (a.y + j - o.y)*(a.y + j - o.y) + (a.z + k - o.z)*(a.z + k - o.z) <= o.r * o.r) AS hit FROM atoms a JOIN o ON a.mol_id = o.mol_id, g WHERE a.atom_idx = 1 GROUP BY a.mol_id, i, j, k)", select=f"SELECT mol_id, {rd('avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END)', 'fraction', 4)} FROM c GROUP BY mol_id"), 4)
def buried_volume(spark, d):
    return sterimol.buried_volume(tables.atoms(spark, d), 1)


# --- alignment --------------------------------------------------------------------------------------------------------


@register("renumber", query(SQL_ATOMS, select="SELECT mol_id, CASE WHEN atom_idx <= 3 THEN 4 - atom_idx ELSE atom_idx END AS atom_idx, symbol, " + ", ".join(rd(c, c) for c in "xyz") + " FROM atoms"))
def renumber(spark, d):
    a = tables.atoms(spark, d)
    m = a.where("atom_idx <= 3").select("mol_id", F.col("atom_idx").alias("old_idx"), (4 - F.col("atom_idx")).alias("new_idx"))
    return alignment.renumber(a, m).select("mol_id", "atom_idx", "symbol", "x", "y", "z")


@register("nearest_match", query(SQL_ATOMS, "n AS (SELECT count(*) AS n FROM embeddings)", "t AS (SELECT (mol_id + n - 1) % n AS mol_id, atom_idx, symbol, x, y, z FROM atoms, n)", "d AS (SELECT a.mol_id, a.atom_idx, t.atom_idx AS target_idx, sqrt((a.x-t.x)*(a.x-t.x)+(a.y-t.y)*(a.y-t.y)+(a.z-t.z)*(a.z-t.z)) AS dist FROM atoms a JOIN t ON a.mol_id = t.mol_id AND a.symbol = t.symbol)", select=f"SELECT mol_id, atom_idx, target_idx, {rd('dist', 'dist')} FROM d WHERE dist <= 1.5 QUALIFY row_number() OVER (PARTITION BY mol_id, atom_idx ORDER BY dist, target_idx) = 1"))
def nearest_match(spark, d):
    a = tables.atoms(spark, d)
    n = tables.table(spark, d, "embeddings").agg(F.count("*").alias("n"))
    target = a.crossJoin(F.broadcast(n)).withColumn("mol_id", (F.col("mol_id") + F.col("n") - 1) % F.col("n")).drop("n")
    return alignment.nearest_match(a, target, 1.5)


@register("aligned_copy", query(SQL_ATOMS, select="SELECT mol_id, atom_idx, symbol, " + ", ".join(rd(c, c) for c in "xyz") + " FROM atoms"))
def aligned_copy(spark, d):
    a = tables.atoms(spark, d)
    m = a.select("mol_id", F.col("atom_idx").alias("old_idx"), F.col("atom_idx").alias("new_idx"))
    return alignment.align(geometry.rigid_motion(a, (1.0, 2.0, 3.0), (0.4, 0.2, 0.9)), a, m)


@register("common_substructure")
def common_substructure(spark, d):
    """Each molecule and the fifth one after it, of short bonds, as in molecules each atom has few."""
    a, bonds = tables.atoms(spark, d), _short_bonds(spark, d)
    n = tables.table(spark, d, "embeddings").agg(F.count("*").alias("n"))
    later = lambda t: t.crossJoin(F.broadcast(n)).withColumn("mol_id", (F.col("mol_id") + F.col("n") - 5) % F.col("n")).drop("n")
    return alignment.common_substructure(a, later(a), bonds, later(bonds))


def _short_bonds(spark, d) -> DataFrame:
    return geometry.pairs(tables.atoms(spark, d)).where("dist < 1.25").select("mol_id", "a1", "a2")


@register("growing_match")
def growing_match(spark, d):
    a = tables.atoms(spark, d)
    return alignment.growing_match(a, geometry.rigid_motion(a, (0.1, 0.0, 0.0), (0.05, 0.0, 0.0)))


_dirs = "dirs AS (SELECT i, sqrt(1 - z*z) * cos(i * (pi() * (3 - sqrt(5)))) AS x, sqrt(1 - z*z) * sin(i * (pi() * (3 - sqrt(5)))) AS y, z FROM (SELECT i, 1 - (2 * i + 1) / 32.0::DOUBLE AS z FROM (SELECT unnest(range(0, 32)) AS i)))"
_frag = "frag AS (SELECT * FROM (VALUES (1.70::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), (1.52::DOUBLE, 1.0::DOUBLE, 0.7::DOUBLE, 0.0::DOUBLE), (1.10::DOUBLE, 0.6::DOUBLE, -0.5::DOUBLE, 0.8::DOUBLE)) t(r, x, y, z))"
_placed = "p AS (SELECT i, r, d.x*(1.5 + f.x) - d.y*f.y - d.z*f.z AS x, d.y*(1.5 + f.x) + (1 - d.y*d.y/(1 + d.x))*f.y - d.y*d.z/(1 + d.x)*f.z AS y, d.z*(1.5 + f.x) - d.y*d.z/(1 + d.x)*f.y + (1 - d.z*d.z/(1 + d.x))*f.z AS z FROM dirs d, frag f)"


@register("best_direction", query(SQL_ATOMS, _dirs, _frag, _placed, "c AS (SELECT h.mol_id, i, sum(pow(greatest(0.0, p.r + 0.2::DOUBLE + CASE h.symbol WHEN 'H' THEN 1.10::DOUBLE WHEN 'C' THEN 1.70::DOUBLE WHEN 'N' THEN 1.55::DOUBLE WHEN 'O' THEN 1.52::DOUBLE ELSE 1.75::DOUBLE END - sqrt(pow(h.x - a.x - p.x, 2) + pow(h.y - a.y - p.y, 2) + pow(h.z - a.z - p.z, 2))), 2)) AS cost FROM atoms h JOIN atoms a ON a.mol_id = h.mol_id AND a.atom_idx = 1, p GROUP BY 1, 2)", select=f"SELECT mol_id, {rd('min(cost)', 'penalty', 4)} FROM c GROUP BY mol_id"), 4)
def best_direction(spark, d):
    fragment = spark.createDataFrame([("C", 0.0, 0.0, 0.0), ("O", 1.0, 0.7, 0.0), ("H", 0.6, -0.5, 0.8)], "symbol string, x double, y double, z double")
    return alignment.best_direction(tables.atoms(spark, d), fragment, 1, sampling.fibonacci_sphere(spark, 32)).drop("i")


# --- features ---------------------------------------------------------------------------------------------------------

X = ["f1", "f2", "f3", "f4", "f5"]


@register("feature_pivot", query(SQL_ATOMS, SQL_CHARGES, pick("p", 1, 2, 3), select=f"SELECT p.mol_id, {rd(S.norm(S.sub(v(0), v(1))), 'length_1_2')}, {rd(S.angle(S.sub(v(0), v(1)), S.sub(v(2), v(1))), 'angle_1_2_3')}, {rd('c.charge', 'nbo_atom_1')} FROM p JOIN charges c ON p.mol_id = c.mol_id AND c.atom_idx = 1"))
def feature_pivot(spark, d):
    """Families of long descriptors, united and pivoted once: no join between families."""
    a, c = tables.atoms(spark, d), tables.charges(spark, d)
    long = [
        geometry.bond_length(a, 1, 2).select("mol_id", F.lit("length_1_2").alias("param"), F.col("length").alias("value")),
        geometry.bond_angle(a, 1, 2, 3).select("mol_id", F.lit("angle_1_2_3").alias("param"), F.col("angle").alias("value")),
        c.where("atom_idx = 1").select("mol_id", F.lit("nbo_atom_1").alias("param"), F.col("charge").alias("value")),
    ]
    return features.pivot(long[0].unionByName(long[1]).unionByName(long[2]), ["length_1_2", "angle_1_2_3", "nbo_atom_1"])


FLAGSHIP = QUERIES["feature_pivot"]


@register("missing_report", "SELECT 'text' AS feature, avg(CASE WHEN quality IS NULL THEN 1.0 ELSE 0.0 END) AS missing_share FROM documents LEFT JOIN labels USING (doc_id)".replace("'text'", "'quality'").replace("avg(", "round(avg(").replace("END)", "END), 6) + 0.0"))
def missing_report(spark, d):
    docs, labels = tables.table(spark, d, "documents").select("doc_id"), tables.table(spark, d, "labels")
    return features.nan_report(docs.join(labels, "doc_id", "left"), ["quality"])


_pairs = [(a, b) for i, a in enumerate(X) for b in X[i + 1 :]]


@register("correlated_pairs", query(SQL_SAMPLES, select=" UNION ALL ".join(f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, {rd(f'corr({a}, {b})', 'r')} FROM samples HAVING abs(corr({a}, {b})) > 0.001" for a, b in _pairs)))
def correlated_pairs(spark, d):
    return features.correlated_pairs(tables.samples(spark, d), X, 0.001)


@register("standardize", query(SQL_SAMPLES, select=f"SELECT okey, line, {rd('(f1 - avg(f1) OVER ()) / stddev_pop(f1) OVER ()', 'f1')}, {rd('(f4 - avg(f4) OVER ()) / stddev_pop(f4) OVER ()', 'f4')} FROM samples"))
def standardize(spark, d):
    return features.standardize(tables.samples(spark, d).select("okey", "line", "f1", "f4"), ["f1", "f4"])


@register("vif_two", query(SQL_SAMPLES, "r AS (SELECT corr(f4, f5) AS r FROM samples)", select=" UNION ALL ".join(f"SELECT '{f}' AS feature, {rd('1 / (1 - r*r)', 'vif')} FROM r" for f in ("f4", "f5"))))
def vif_two(spark, d):
    return features.vif(tables.samples(spark, d), ["f4", "f5"])


@register("natural_sort", "SELECT c_custkey, TRY_CAST(regexp_extract(c_name, '(\\d+)', 1) AS BIGINT) AS k FROM customer")
def natural_sort(spark, d):
    return tables.table(spark, d, "customer").select("c_custkey", features.natural_key(F.col("c_name")).alias("k"))


@register("unique_names", "SELECT p_partkey, CASE WHEN k > 1 THEN p_name || '#' || k ELSE p_name END AS p_name FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part)")
def unique_names(spark, d):
    return features.unique_names(tables.table(spark, d, "part").select("p_partkey", "p_name"), "p_name", "p_partkey")


# --- regression -------------------------------------------------------------------------------------------------------


def _one(spark, row: dict) -> DataFrame:
    return spark.createDataFrame([tuple(float(x) for x in row.values())], ", ".join(f"{k} double" for k in row))


@register("ols_one", query(SQL_SAMPLES, select=f"SELECT {rd('regr_slope(y, f1)', 'slope', 3)}, {rd('regr_intercept(y, f1)', 'intercept', 3)}, {rd('regr_r2(y, f1)', 'r2')} FROM samples"), 6)
def ols_one(spark, d):
    m = regression.fit(tables.samples(spark, d), ["f1"], "y", 0.0)
    return _one(spark, {"slope": round(m["estimate"][1], 3), "intercept": round(m["estimate"][0], 3), "r2": m["r2"]})


SQL_TWO = "c AS (SELECT count(*) AS n, avg(y) AS my, avg(f1) AS m1, avg(f4) AS m4, covar_pop(f1, f1) AS s11, covar_pop(f1, f4) AS s14, covar_pop(f4, f4) AS s44, covar_pop(f1, y) AS s1y, covar_pop(f4, y) AS s4y, covar_pop(y, y) AS syy FROM samples), b AS (SELECT *, (s44*s1y - s14*s4y)/(s11*s44 - s14*s14) AS b1, (s11*s4y - s14*s1y)/(s11*s44 - s14*s14) AS b4 FROM c)"


@register("ols_two", query(SQL_SAMPLES, SQL_TWO, select=f"SELECT {rd('b1', 'b1', 3)}, {rd('b4', 'b4', 3)}, {rd('my - b1*m1 - b4*m4', 'b0', 2)}, {rd('(b1*s1y + b4*s4y)/syy', 'r2')} FROM b"))
def ols_two(spark, d):
    m = regression.fit(tables.samples(spark, d), ["f1", "f4"], "y", 0.0)
    e = m["estimate"]
    return _one(spark, {"b1": round(e[1], 3), "b4": round(e[2], 3), "b0": round(e[0], 2), "r2": m["r2"]})


@register("model_error", query(SQL_SAMPLES, SQL_TWO, "p AS (SELECT y, my + b1*(f1 - m1) + b4*(f4 - m4) AS q FROM samples, b)", select=f"SELECT count(*) AS n, {rd('1 - sum((y-q)*(y-q)) / sum((y-m)*(y-m))', 'r2')}, {rd('1 - (sum((y-q)*(y-q)) / sum((y-m)*(y-m))) * (count(*) - 1) / (count(*) - 3)', 'adj_r2')}, {rd('avg(abs(y-q))', 'mae', 3)}, {rd('sqrt(avg((y-q)*(y-q)))', 'rmse', 3)} FROM p, (SELECT avg(y) AS m FROM samples)"))
def model_error(spark, d):
    s = tables.samples(spark, d)
    out = regression.evaluate(regression.predict(s, regression.fit(s, ["f1", "f4"], "y", 0.0)), "y", "prediction", 2)
    return out.withColumn("mae", F.round("mae", 3)).withColumn("rmse", F.round("rmse", 3))


SQL_GROUPS = "g AS (SELECT o_custkey AS k, avg(o_totalprice) AS y, CAST(count(*) AS DOUBLE) AS x1, avg(CAST(o_orderkey % 97 AS DOUBLE)) AS x2 FROM orders GROUP BY o_custkey)"


def _groups(spark, d):
    o = tables.table(spark, d, "orders")
    return o.groupBy(F.col("o_custkey").alias("k")).agg(F.avg("o_totalprice").alias("y"), F.count("*").cast("double").alias("x1"), F.avg((F.col("o_orderkey") % 97).cast("double")).alias("x2"))


@register("loo_q2", query(SQL_GROUPS, "m AS (SELECT count(*) AS n, avg(x1) AS mx, avg(y) AS my, regr_slope(y, x1) AS b, regr_sxx(y, x1) AS sxx, var_pop(y) * count(*) AS sst FROM g)", "e AS (SELECT (y - my - b*(x1 - mx)) / (1 - 1.0/n - (x1 - mx)*(x1 - mx)/sxx) AS e, sst, n FROM g, m)", select=f"SELECT {rd('1 - sum(e*e)/max(sst)', 'q2')}, {rd('avg(abs(e))', 'mae', 3)}, {rd('sqrt(sum(e*e)/max(n))', 'rmsd', 3)} FROM e"))
def loo_q2(spark, d):
    return regression.leave_one_out(_groups(spark, d), ["x1"], "y").select("q2", F.round("mae", 3).alias("mae"), F.round("rmsd", 3).alias("rmsd"))


_fold = " UNION ALL ".join(f"SELECT sum(pow(y - b0 - b1*f1, 2)) AS press, count(*) AS n FROM samples, (SELECT regr_slope(y, f1) AS b1, regr_intercept(y, f1) AS b0 FROM samples WHERE okey % 5 <> {i}) WHERE okey % 5 = {i}" for i in range(5))


@register("kfold_q2", query(SQL_SAMPLES, f"f AS ({_fold})", select=f"SELECT {rd('1 - (SELECT sum(press) FROM f) / (var_pop(y) * count(*))', 'q2')}, count(*) AS n FROM samples"))
def kfold_q2(spark, d):
    return regression.k_fold(tables.samples(spark, d), ["f1"], "y", F.col("okey") % 5, 5)


def _r2(combo) -> str:
    if len(combo) == 1:
        return f"regr_r2(y, {combo[0]})"
    a, b = combo
    return f"(covar_pop({b},{b})*covar_pop({a},y)*covar_pop({a},y) - 2*covar_pop({a},{b})*covar_pop({a},y)*covar_pop({b},y) + covar_pop({a},{a})*covar_pop({b},y)*covar_pop({b},y)) / ((covar_pop({a},{a})*covar_pop({b},{b}) - covar_pop({a},{b})*covar_pop({a},{b})) * covar_pop(y,y))"


_combos = [(a,) for a in X] + _pairs


@register("model_search", query(SQL_SAMPLES, "c AS (" + " UNION ALL ".join(f"SELECT '{','.join(c)}' AS combo, {len(c)} AS k, {_r2(c)} AS r2 FROM samples" for c in _combos) + ")", select=f"SELECT combo, CAST(k AS INT) AS k, {rd('r2', 'r2')} FROM c ORDER BY c.r2 DESC LIMIT 5"))
def model_search(spark, d):
    found = regression.search(tables.samples(spark, d), X, "y", 1, 2, top=5, ridge=0.0)
    return found.select(F.array_join("combo", ",").alias("combo"), "k", "r2")


def _cholesky(combo: tuple[str, ...]) -> str:
    """SQL for the R² of a subset: the triangular factor of its covariances, a column a step, and what each column explains."""
    s = lambda a, b: f"s_{min(a, b)}_{max(a, b)}"
    inner = "cov"
    for j, a in enumerate(combo):
        left = "".join(f" - l{j}_{k}*l{j}_{k}" for k in range(j))
        inner = f"(SELECT *, sqrt({s(a, a)}{left}) AS d{j} FROM {inner})"
        rows = [f"({s(a, b)}" + "".join(f" - l{i}_{k}*l{j}_{k}" for k in range(j)) + f") / d{j} AS l{i}_{j}" for i, b in enumerate(combo) if i > j]
        rows.append(f"({s(a, 'y')}" + "".join(f" - l{j}_{k}*z{k}" for k in range(j)) + f") / d{j} AS z{j}")
        inner = f"(SELECT *, {', '.join(rows)} FROM {inner})"
    return f"SELECT '{','.join(combo)}' AS combo, {len(combo)} AS k, n, s_y_y, ({' + '.join(f'z{j}*z{j}' for j in range(len(combo)))}) / s_y_y AS r2 FROM {inner}"


_cov = "cov AS MATERIALIZED (SELECT count(*) AS n, " + ", ".join(f"covar_pop({a}, {b}) AS s_{a}_{b}" for i, a in enumerate([*X, "y"]) for b in [*X, "y"][i:]) + " FROM samples)"
_deep = [("f1", *c) for k in range(5) for c in combinations(X[1:], k)]


@register("model_search_deep", query(SQL_SAMPLES, _cov, "c AS (" + " UNION ALL ".join(map(_cholesky, _deep)) + ")", select=f"SELECT combo, CAST(k AS INT) AS k, {rd('r2', 'r2')}, {rd('1 - (1 - r2) * (n - 1) / (n - k - 1)', 'adj_r2')}, {rd('sqrt(s_y_y * (1 - r2))', 'rmse', 2)} FROM c"))
def model_search_deep(spark, d):
    """All subsets of up to five features, one of them required."""
    return regression.search(tables.samples(spark, d), X, "y", 1, 5, required=("f1",)).select(F.array_join("combo", ",").alias("combo"), "k", "r2", "adj_r2", F.round("rmse", 2).alias("rmse"))


@register("search_resume", query("c AS (SELECT unnest([" + ", ".join(f"'{','.join(c)}'" for c in _combos if len(c) == 2) + "]) AS combo)", select="SELECT combo FROM c WHERE combo NOT IN ('f1,f2', 'f4,f5')"))
def search_resume(spark, d):
    done = spark.createDataFrame([(["f2", "f1"],), (["f4", "f5"],)], "combo array<string>")
    return regression.search(tables.samples(spark, d), X, "y", 2, 2, done=done).select(F.array_join("combo", ",").alias("combo"))


@register("univariate", query(SQL_SAMPLES, select=" UNION ALL ".join(f"SELECT '{f}' AS feature, {rd(f'regr_slope(y, {f})', 'slope', 2)}, {rd(f'regr_intercept(y, {f})', 'intercept', 2)}, {rd(f'regr_r2(y, {f})', 'r2')} FROM samples" for f in X)))
def univariate(spark, d):
    return regression.univariate(tables.samples(spark, d), X, "y").select("feature", F.round("slope", 2).alias("slope"), F.round("intercept", 2).alias("intercept"), "r2")


@register("shap_linear", query(SQL_SAMPLES, SQL_TWO, select=" UNION ALL ".join(f"SELECT 'f{i}' AS feature, {rd(f'avg(abs(b{i} * (f{i} - m{i})))', 'importance', 2)} FROM samples, b" for i in (1, 4))), 2)
def shap_linear(spark, d):
    s = tables.samples(spark, d)
    return regression.shap_linear(s, regression.fit(s, ["f1", "f4"], "y", 0.0))


@register("influence", query(SQL_GROUPS, "m AS (SELECT count(*) AS n, avg(x1) AS mx, avg(y) AS my, regr_slope(y, x1) AS b, regr_sxx(y, x1) AS sxx FROM g)", "e AS (SELECT k, n, y - my - b*(x1 - mx) AS e, 1.0/n + (x1 - mx)*(x1 - mx)/sxx AS h FROM g, m)", "s AS (SELECT sum(e*e)/(max(n) - 2) AS s2 FROM e)", select=f"SELECT k, {rd('h', 'leverage')}, {rd('e*e/(s2*(1-h)) * h/(1-h)/2', 'cook')} FROM e, s"))
def influence(spark, d):
    return regression.influence(_groups(spark, d), ["x1"], "y").select("k", "leverage", "cook")


@register("durbin_watson", "SELECT event_type, round(sum(step*step) / sum(value*value), 6) + 0.0 AS dw FROM (SELECT event_type, value, value - lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS step FROM events) GROUP BY event_type")
def durbin_watson(spark, d):
    return regression.durbin_watson(tables.table(spark, d, "events"), "value", ["event_type"], ["ts", "event_id"])


@register("jarque_bera", "WITH m AS (SELECT avg(l_extendedprice) AS m FROM lineitem), c AS (SELECT count(*) AS n, avg(pow(l_extendedprice - m, 2)) AS m2, avg(pow(l_extendedprice - m, 3)) AS m3, avg(pow(l_extendedprice - m, 4)) AS m4 FROM lineitem, m) SELECT n, round(n / 6.0 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2*m2) - 3, 2) / 4), 2) + 0.0 AS jb FROM c", 2)
def jarque_bera(spark, d):
    return regression.jarque_bera(tables.table(spark, d, "lineitem"), "l_extendedprice")


@register("breusch_pagan", query(SQL_GROUPS, "m AS (SELECT regr_slope(y, x1) AS b, regr_intercept(y, x1) AS a FROM g)", select="SELECT round(count(*) * regr_r2(pow(y - a - b*x1, 2), x1), 4) + 0.0 AS lm FROM g, m"), 4)
def breusch_pagan(spark, d):
    g = _groups(spark, d)
    rated = regression.predict(g, regression.fit(g, ["x1"], "y", 0.0)).withColumn("e", F.col("y") - F.col("prediction"))
    return _one(spark, {"lm": regression.breusch_pagan(rated, ["x1"], "e")[0]})


_z = 1.959963984540054
#: A t quantile by the Cornish-Fisher expansion, whose error is far under the rounding for hundreds of rows.
_t = f"({_z} + {_z**3 + _z} / (4 * (n - 2)) + {5 * _z**5 + 16 * _z**3 + 3 * _z} / (96 * (n - 2) * (n - 2)) + {3 * _z**7 + 19 * _z**5 + 17 * _z**3 - 15 * _z} / (384 * pow(n - 2, 3)))"
_band = f"{_t} * sqrt(s2 * (1 + 1.0/n + (x1 - mx)*(x1 - mx)/sxx))"


@register("prediction_band", query(SQL_GROUPS, "m AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(x1) AS mx, avg(y) AS my, regr_slope(y, x1) AS b, regr_sxx(y, x1) AS sxx, (regr_syy(y, x1) - regr_sxy(y, x1) * regr_sxy(y, x1) / regr_sxx(y, x1)) / (count(*) - 2) AS s2 FROM g)", select=f"SELECT k, {rd('my + b*(x1 - mx)', 'prediction', 2)}, {rd(f'my + b*(x1 - mx) - {_band}', 'lower', 2)}, {rd(f'my + b*(x1 - mx) + {_band}', 'upper', 2)} FROM g, m"), 2)
def prediction_band(spark, d):
    g = _groups(spark, d)
    return regression.predict(g, regression.fit(g, ["x1"], "y", 0.0), level=0.95).select("k", "prediction", "lower", "upper")


@register("leftout_mae", query(SQL_SAMPLES, "m AS (SELECT regr_slope(y, f1) AS b, regr_intercept(y, f1) AS a FROM samples WHERE okey % 10 <> 0)", select="SELECT round(avg(abs(y - a - b*f1)), 3) + 0.0 AS mae FROM samples, m WHERE okey % 10 = 0"), 3)
def leftout_mae(spark, d):
    s = tables.samples(spark, d)
    model = regression.fit(s.where("okey % 10 <> 0"), ["f1"], "y", 0.0)
    return regression.predict(s.where("okey % 10 = 0"), model).agg(F.avg(F.abs(F.col("y") - F.col("prediction"))).alias("mae"))


# --- classification ---------------------------------------------------------------------------------------------------


def _judged(spark, d):
    return tables.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("truth"), F.when(F.col("l_quantity") < 10, "A").when(F.col("l_quantity") < 30, "N").otherwise("R").alias("said"), "l_quantity", "l_extendedprice")


SQL_JUDGED = "j AS (SELECT l_returnflag AS truth, CASE WHEN l_quantity < 10 THEN 'A' WHEN l_quantity < 30 THEN 'N' ELSE 'R' END AS said FROM lineitem)"


@register("confusion", query(SQL_JUDGED, select="SELECT truth, said AS predicted, count(*) AS n FROM j GROUP BY CUBE (truth, said)"))
def confusion(spark, d):
    return classification.confusion(_judged(spark, d), "truth", "said")


@register("class_measures", query(SQL_JUDGED, "k AS (SELECT DISTINCT truth AS k FROM j UNION SELECT DISTINCT said FROM j)", "c AS (SELECT k, (SELECT count(*) FROM j WHERE truth = k) AS s, (SELECT count(*) FROM j WHERE said = k) AS q, (SELECT count(*) FROM j WHERE truth = k AND said = k) AS h FROM k)", "r AS (SELECT s, h, CASE WHEN q > 0 THEN h * 1.0::DOUBLE / q ELSE 0 END AS p, CASE WHEN s > 0 THEN h * 1.0::DOUBLE / s ELSE 0 END AS c FROM c)", select=f"SELECT {rd('sum(h) * 1.0::DOUBLE / sum(s)', 'accuracy')}, {rd('sum(p * s) / sum(s)', 'precision')}, {rd('sum(c * s) / sum(s)', 'recall')}, {rd('sum(CASE WHEN p + c > 0 THEN 2*p*c/(p+c) ELSE 0 END * s) / sum(s)', 'f1')} FROM r"))
def class_measures(spark, d):
    return classification.measures(_judged(spark, d), "truth", "said")


@register("mcfadden_null", "SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n * ln(n)) - sum(n) * ln(sum(n)), 4) + 0.0 AS ll0 FROM (SELECT count(*) AS n FROM labels GROUP BY quality)", 4)
def mcfadden_null(spark, d):
    return classification.null_log_likelihood(tables.table(spark, d, "labels"), "quality")


@register("logistic_fit")
def logistic_fit(spark, d):
    both = tables.table(spark, d, "labels").join(tables.table(spark, d, "documents"), "doc_id").select("quality", F.log1p("n_chars").alias("size"))
    b, ll = classification.logistic(both, ["size"], "quality")
    return _one(spark, {"intercept": b[0], "size": b[1], "ll": ll})


@register("stratified_folds", "SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) % 5 AS INT) AS fold FROM orders")
def stratified_folds(spark, d):
    return classification.folds_in_order(tables.table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["o_orderkey"], 5).select("o_orderkey", "fold")


_cuts = [1000.0 * i for i in range(1, 100)]


@register("best_threshold", "WITH t AS (SELECT unnest(range(1, 100)) * 1000.0::DOUBLE AS t), c AS (SELECT t, count(*) FILTER (l_extendedprice >= t) AS said, count(*) FILTER (l_extendedprice >= t AND l_returnflag = 'R') AS tp, count(*) FILTER (l_returnflag = 'R') AS pos, count(*) AS n FROM lineitem, t GROUP BY t), r AS (SELECT t, true AS above, 2.0::DOUBLE * tp / (said + pos) AS f FROM c UNION ALL SELECT t, false, 2.0::DOUBLE * (pos - tp) / (n - said + pos) FROM c) SELECT t AS threshold, above, round(f, 6) + 0.0 AS f1 FROM r ORDER BY f DESC, t, above DESC LIMIT 1")
def best_threshold(spark, d):
    l = tables.table(spark, d, "lineitem").select("l_extendedprice", (F.col("l_returnflag") == "R").alias("pos"))
    return classification.best_threshold(l, "l_extendedprice", "pos", _cuts)


@register("decision_stump", "WITH c AS (SELECT l_quantity AS v, count(*) FILTER (l_returnflag = 'R') * 1.0::DOUBLE AS p, count(*) FILTER (l_returnflag <> 'R') * 1.0::DOUBLE AS q FROM lineitem GROUP BY 1), w AS (SELECT v, lead(v) OVER (ORDER BY v) AS nx, sum(p) OVER (ORDER BY v) / sum(p) OVER () / 2 AS a, sum(q) OVER (ORDER BY v) / sum(q) OVER () / 2 AS b FROM c), g AS (SELECT (v + nx) / 2 AS cut, (a+b)*(1 - pow(a/(a+b), 2) - pow(b/(a+b), 2)) + (1-a-b)*(1 - pow((0.5-a)/(1-a-b), 2) - pow((0.5-b)/(1-a-b), 2)) AS gini FROM w WHERE nx IS NOT NULL) SELECT cut, round(gini, 6) + 0.0 AS gini FROM g ORDER BY round(gini, 9), cut LIMIT 1")
def decision_stump(spark, d):
    l = tables.table(spark, d, "lineitem").select("l_quantity", (F.col("l_returnflag") == "R").alias("pos"))
    return classification.decision_stump(l, "l_quantity", "pos")


@register("probability_ranks", "SELECT event_id, CAST(rank() OVER (PARTITION BY user_id ORDER BY value DESC) AS INT) AS rank FROM events")
def probability_ranks(spark, d):
    return classification.probability_ranks(tables.table(spark, d, "events").select("event_id", "user_id", "value"), ["user_id"], "value").select("event_id", "rank")


@register("log_likelihood", "SELECT round(sum(ln(greatest(l_discount, 1e-15))), 3) + 0.0 AS ll FROM lineitem", 3)
def log_likelihood(spark, d):
    return classification.log_likelihood(tables.table(spark, d, "lineitem"), "l_discount")


# --- sampling and statistics ------------------------------------------------------------------------------------------


@register("stratified_sample", "SELECT o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) <= 50")
def stratified_sample(spark, d):
    return sampling.stratified(tables.table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["o_orderkey"], 50)


@register("hash_sample")
def hash_sample(spark, d):
    return sampling.sample(tables.table(spark, d, "customer").select("c_custkey"), ["c_custkey"], 20)


@register("folds_none_empty")
def folds_none_empty(spark, d):
    return sampling.folds_none_empty(tables.table(spark, d, "customer").select("c_custkey"), ["c_custkey"], 7)


@register("similarity_to_centroid", "WITH l AS (SELECT vec_id, label, unnest(range(1, 65)) AS k, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), m AS (SELECT label, k, avg(v) AS m FROM l GROUP BY 1, 2) SELECT vec_id, l.label, round(sum(v*m) / sqrt(sum(v*v) * sum(m*m)), 6) + 0.0 AS similarity FROM l JOIN m ON l.label = m.label AND l.k = m.k GROUP BY vec_id, l.label")
def similarity_to_centroid(spark, d):
    return sampling.similarity_to_centroid(tables.table(spark, d, "embeddings"), "label", "embedding", "vec_id")


@register("evenly_along", "WITH t AS (SELECT o_orderkey, o_orderstatus, o_totalprice, ntile(10) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS tile FROM orders) SELECT o_orderkey, o_orderstatus FROM t QUALIFY row_number() OVER (PARTITION BY o_orderstatus, tile ORDER BY o_totalprice, o_orderkey) = 1")
def evenly_along(spark, d):
    o = tables.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return sampling.evenly_along(o, "o_orderstatus", "o_totalprice", "o_orderkey", 10).select("o_orderkey", "o_orderstatus")


@register("ks_statistic", "WITH c AS (SELECT value, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type = 'view') AS b FROM events GROUP BY value), w AS (SELECT sum(a) OVER (ORDER BY value) AS ca, sum(b) OVER (ORDER BY value) AS cb, sum(a) OVER () AS ta, sum(b) OVER () AS tb FROM c) SELECT round(max(abs(ca * 1.0::DOUBLE / ta - cb * 1.0::DOUBLE / tb)), 6) + 0.0 AS ks FROM w")
def ks_statistic(spark, d):
    return sampling.ks_statistic(tables.table(spark, d, "events"), "value", "event_type", "click", "view")


@register("fibonacci_sphere", f"SELECT i, {rd('sqrt(1 - z*z) * cos(i * (pi() * (3 - sqrt(5))))', 'x')}, {rd('sqrt(1 - z*z) * sin(i * (pi() * (3 - sqrt(5))))', 'y')}, {rd('z', 'z')} FROM (SELECT i, 1 - (2 * i + 1) / 1000.0::DOUBLE AS z FROM (SELECT unnest(range(0, 1000)) AS i))")
def fibonacci_sphere(spark, d):
    return sampling.fibonacci_sphere(spark, 1000)


@register("percentile_cut", "SELECT event_type, round(quantile_cont(value, 0.75), 6) + 0.0 AS cutoff FROM events GROUP BY event_type")
def percentile_cut(spark, d):
    return ranks.quantiles_within(tables.table(spark, d, "events"), ["event_type"], "value", 0.75).withColumnRenamed("quantile", "cutoff")


# --- texts, joins, windows --------------------------------------------------------------------------------------------


@register("numbers_in_text", r"SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[-+]?\d+\.\d+(?:[DEde][-+]?\d+)?')) AS INT) AS n FROM documents")
def numbers_in_text(spark, d):
    return tables.table(spark, d, "documents").select("doc_id", F.size(text_blocks.numbers(F.col("text"))).alias("n"))


@register("marker_block", "SELECT page_id, CASE WHEN contains(html, '<h1>') THEN split_part(split_part(html, '<h1>', -1), '</h1>', 1) END AS body FROM pages")
def marker_block(spark, d):
    return tables.table(spark, d, "pages").select("page_id", text_blocks.block(F.col("html"), "<h1>", "</h1>").alias("body"))


@register("line_after_marker", "SELECT doc_id, CASE WHEN contains(text, '.') THEN CASE WHEN contains(list_extract(string_split(text, '.'), -1), chr(10)) THEN list_extract(string_split(list_extract(string_split(text, '.'), -1), chr(10)), 2) END END AS line FROM documents")
def line_after_marker(spark, d):
    return tables.table(spark, d, "documents").select("doc_id", text_blocks.line_after(F.col("text"), ".").alias("line"))


@register("phrase_count", "SELECT doc_id, CAST((length(text) - length(replace(text, 'th', ''))) / 2 AS INT) AS n FROM documents")
def phrase_count(spark, d):
    return tables.table(spark, d, "documents").select("doc_id", text_blocks.count_of(F.col("text"), "th").alias("n"))


@register("reshape_rows", "SELECT vec_id, k, round(list_sum(list_transform(embedding[6*k+1:6*k+6], lambda x: CAST(x AS DOUBLE))), 6) + 0.0 AS total FROM embeddings, (SELECT unnest(range(0, 10)) AS k)")
def reshape_rows(spark, d):
    e = tables.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    rows = e.select("vec_id", F.posexplode(text_blocks.rows_of(F.col("v"), 6)).alias("k", "r"))
    return rows.select("vec_id", F.col("k").cast("long").alias("k"), F.aggregate("r", F.lit(0.0), lambda a, x: a + x).alias("total"))


@register("json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_props(spark, d):
    return tables.table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@register("union_descriptors", "SELECT c_custkey AS id, 'balance' AS param, c_acctbal AS value FROM customer UNION ALL SELECT o_orderkey, 'price', o_totalprice FROM orders")
def union_descriptors(spark, d):
    c = tables.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("balance").alias("param"), F.col("c_acctbal").alias("value"))
    return c.unionByName(tables.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("price").alias("param"), F.col("o_totalprice").alias("value")))


@register("anti_done", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_done(spark, d):
    c, o = tables.table(spark, d, "customer"), tables.table(spark, d, "orders").where("o_orderstatus = 'P'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@register("semi_members", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi_members(spark, d):
    c, o = tables.table(spark, d, "customer"), tables.table(spark, d, "orders").where("o_orderstatus = 'F'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


_by_type = "l AS (SELECT p_brand, p_type, l_extendedprice AS y, l_quantity AS x FROM lineitem JOIN part ON l_partkey = p_partkey), m AS (SELECT p_brand, p_type, count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx, regr_r2(y, x) AS r2, var_pop(y) * count(*) AS sst FROM l GROUP BY 1, 2), q AS (SELECT p_brand, p_type, any_value(r2) AS r2, 1 - sum(pow((y - my - b*(x - mx)) / (1 - 1.0/n - (x - mx)*(x - mx)/sxx), 2)) / any_value(sst) AS q2 FROM l JOIN m USING (p_brand, p_type) WHERE n > 2 AND sxx > 0 GROUP BY 1, 2)"


@register("model_report", query(_by_type, select=f"SELECT p_brand, p_type, {rd('r2', 'r2')}, {rd('q2', 'q2')} FROM q WHERE r2 >= 0.002 AND q2 >= 0.0005"))
def model_report(spark, d):
    """One model a brand and type, with the Q² of leaving each row out."""
    l, p = tables.table(spark, d, "lineitem"), tables.table(spark, d, "part")
    own = l.join(p, l.l_partkey == p.p_partkey).select("p_brand", "p_type", F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("x"))
    return sinks.report(regression.leave_one_out_by(own, ["p_brand", "p_type"], "x", "y").select("p_brand", "p_type", "r2", "q2"), 0.002, 0.0005)


@register("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM events GROUP BY 1, 2", 4)
def event_windows(spark, d):
    return windowed(tables.table(spark, d, "events"))


@register("xyz_text", query(SQL_ATOMS, select="SELECT mol_id, count(*) || chr(10) || 'from a table' || chr(10) || string_agg(printf('%s %.6f %.6f %.6f', symbol, round(x, 6), round(y, 6), round(z, 6)), chr(10) ORDER BY atom_idx) AS value FROM atoms GROUP BY mol_id"))
def xyz_text(spark, d):
    return sinks.xyz_text(tables.atoms(spark, d), "from a table")


# --- sizes of ligands -------------------------------------------------------------------------------------------------

_d, _axis = S.sub(("a.x", "a.y", "a.z"), v(0)), S.sub(v(1), v(0))


@register("cone_angle", query(SQL_ATOMS, pick("p", 1, 2), f"h AS (SELECT a.mol_id, CASE WHEN {_bondi} >= {S.norm(_d)} THEN 180.0 ELSE {S.angle(_d, _axis)} + degrees(asin(least(1.0, {_bondi} / {S.norm(_d)}))) END AS half FROM atoms a JOIN p USING (mol_id) WHERE a.atom_idx <> 1)", select=f"SELECT mol_id, {rd('2 * max(half)', 'cone', 4)} FROM h GROUP BY mol_id"), 4)
def cone_angle(spark, d):
    return sterics.cone_angle(tables.atoms(spark, d), 1, 2)


@register("octant_volumes", query(SQL_ATOMS, framed_cte(BASE), "g AS (SELECT i + 0.25::DOUBLE AS i, j + 0.25::DOUBLE AS j, k + 0.25::DOUBLE AS k FROM (SELECT unnest(range(-7, 7)) * 0.5 AS i), (SELECT unnest(range(-7, 7)) * 0.5 AS j), (SELECT unnest(range(-7, 7)) * 0.5 AS k))", f"o AS (SELECT *, {_bondi} * 1.17::DOUBLE AS r FROM framed WHERE atom_idx <> 1)", "c AS (SELECT mol_id, i, j, k, bool_or((i - x)*(i - x) + (j - y)*(j - y) + (k - z)*(k - z) <= r*r) AS hit FROM o, g WHERE i*i + j*j + k*k <= 12.25 GROUP BY ALL)", select=f"SELECT mol_id, CAST((i > 0)::INT + 2 * (j > 0)::INT + 4 * (k > 0)::INT AS INT) AS octant, {rd('avg(hit::INT::DOUBLE)', 'fraction', 4)} FROM c GROUP BY 1, 2"), 4)
def octant_volumes(spark, d):
    return sterics.octant_volumes(tables.atoms(spark, d), BASE)


@register("closest_atoms", query(SQL_ATOMS, "f AS (SELECT p.mol_id, p.atom_idx AS point, a.atom_idx, (a.x-p.x)*(a.x-p.x) + (a.y-p.y)*(a.y-p.y) + (a.z-p.z)*(a.z-p.z) AS far FROM atoms p JOIN atoms a ON a.mol_id = p.mol_id AND p.atom_idx > 10 AND a.atom_idx <= 10)", select="SELECT mol_id, point, atom_idx FROM f QUALIFY row_number() OVER (PARTITION BY mol_id, point ORDER BY far, atom_idx) = 1"))
def closest_atoms(spark, d):
    a = tables.atoms(spark, d)
    return sterics.nearest_atoms(a.where("atom_idx > 10").select("mol_id", F.col("atom_idx").alias("point"), "x", "y", "z"), a.where("atom_idx <= 10")).select("mol_id", "point", "atom_idx")


_turn = "(SELECT mol_id, least(abs(max(x*cos(radians(t)) + z*sin(radians(t)))), abs(min(x*cos(radians(t)) + z*sin(radians(t)))), abs(max(z*cos(radians(t)) - x*sin(radians(t)))), abs(min(z*cos(radians(t)) - x*sin(radians(t))))) AS h FROM framed, (SELECT unnest(range(0, 90, 10)) AS t) GROUP BY mol_id, t)"


@register("surface_sterimol", query(SQL_ATOMS, framed_cte(BASE), f"sides AS (SELECT mol_id, min(h) AS b1 FROM {_turn} GROUP BY mol_id)", select=f"SELECT mol_id, {rd('max(y)', 'l', 4)}, {rd('max(b1)', 'b1', 4)}, {rd('max(sqrt(x*x + z*z))', 'b5', 4)} FROM framed JOIN sides USING (mol_id) GROUP BY mol_id"), 4)
def surface_sterimol(spark, d):
    a = tables.atoms(spark, d)
    return sterics.surface_sterimol(a.select("mol_id", "x", "y", "z"), a, BASE, 10)


# --- paths and maps ---------------------------------------------------------------------------------------------------


def _bonds(spark, d) -> DataFrame:
    return graph.connectivity(tables.atoms(spark, d))


@register("base_atoms", query(SQL_ATOMS, PAIRS, BONDS, NEAR, select="SELECT mol_id, 1 AS origin, 2 AS direction, coalesce(min(other) FILTER (atom = 2 AND other <> 1), min(other) FILTER (atom = 1 AND other <> 2)) AS third FROM near GROUP BY mol_id"))
def base_atoms(spark, d):
    return paths.base_atoms(_bonds(spark, d), 1, 2)


@register("accompanied", query(SQL_ATOMS, PAIRS, BONDS, NEAR, select="SELECT mol_id, atom_idx AS old_idx FROM atoms a WHERE atom_idx % 3 <> 0 AND EXISTS (SELECT 1 FROM near n WHERE n.mol_id = a.mol_id AND n.atom = a.atom_idx AND n.other % 3 <> 0)"))
def accompanied(spark, d):
    m = tables.atoms(spark, d).where("atom_idx % 3 <> 0").select("mol_id", F.col("atom_idx").alias("old_idx"), F.col("atom_idx").alias("new_idx"))
    return paths.accompanied(m, _bonds(spark, d)).select("mol_id", "old_idx")


@register("bonds_of_element", query(SQL_ATOMS, PAIRS, BONDS, select="SELECT b.mol_id, b.a1, b.a2 FROM bonds b JOIN atoms p ON p.mol_id = b.mol_id AND p.atom_idx = b.a1 JOIN atoms q ON q.mol_id = b.mol_id AND q.atom_idx = b.a2 WHERE p.symbol = 'N' OR q.symbol = 'N'"))
def bonds_of_element(spark, d):
    return paths.bonds_of(_bonds(spark, d).select("mol_id", "a1", "a2"), tables.atoms(spark, d), ["N"])


@register("diameter_path", "WITH RECURSIVE " + ",\n".join([SQL_ATOMS, PAIRS, SQL_SPARSE, NEAR, "walk AS (SELECT DISTINCT mol_id, atom AS src, atom AS dst, 0 AS d FROM near UNION SELECT w.mol_id, w.src, n.other, w.d + 1 FROM walk w JOIN near n ON n.mol_id = w.mol_id AND n.atom = w.dst WHERE w.d < 20)", "far AS (SELECT mol_id, src, dst, min(d) AS d FROM walk GROUP BY 1, 2, 3)"]) + "\nSELECT mol_id, max(d) AS length FROM far GROUP BY mol_id")
def diameter_path(spark, d):
    return paths.diameter_path(_short_bonds(spark, d)).select("mol_id", "length")


_round = lambda i: f"k{i} AS MATERIALIZED (SELECT mol_id, atom_idx, CAST(dense_rank() OVER (PARTITION BY mol_id ORDER BY k, near) - 1 AS INT) AS k FROM (SELECT a.mol_id, a.atom_idx, a.k, coalesce(list_sort(list(b.k) FILTER (b.k IS NOT NULL)), []) AS near FROM k{i - 1} a LEFT JOIN near n ON n.mol_id = a.mol_id AND n.atom = a.atom_idx LEFT JOIN k{i - 1} b ON b.mol_id = n.mol_id AND b.atom_idx = n.other GROUP BY ALL))"


@register("atom_classes", query(SQL_ATOMS, PAIRS, BONDS, NEAR, "k0 AS MATERIALIZED (SELECT mol_id, atom_idx, CAST(dense_rank() OVER (PARTITION BY mol_id ORDER BY symbol) - 1 AS INT) AS k FROM atoms)", *map(_round, range(1, 13)), select="SELECT mol_id, atom_idx, k AS class FROM k12"))
def atom_classes(spark, d):
    return paths.atom_classes(tables.atoms(spark, d), _bonds(spark, d))


@register("closed_map", query(SQL_ATOMS, select="SELECT mol_id, atom_idx AS old_idx, CASE WHEN atom_idx < 5 THEN atom_idx + 1 WHEN atom_idx = 5 THEN 1 ELSE atom_idx END AS new_idx FROM atoms"))
def closed_map(spark, d):
    """A chain from the first atom to the fifth, closed."""
    a = tables.atoms(spark, d)
    return paths.closed_map(a.where("atom_idx < 5").select("mol_id", F.col("atom_idx").alias("old_idx"), (F.col("atom_idx") + 1).alias("new_idx")), a)


# --- assumptions of linear models -------------------------------------------------------------------------------------

_sse = "(regr_syy(y, f1) - regr_sxy(y, f1) * regr_sxy(y, f1) / regr_sxx(y, f1))"


@register("goldfeld_quandt", query(SQL_SAMPLES, "m AS (SELECT quantile_cont(f1, 0.5) AS m FROM samples)", f"s AS (SELECT f1 > m AS high, {_sse} / (count(*) - 2) AS v FROM samples, m GROUP BY 1)", select=f"SELECT {rd('max(v) FILTER (high) / max(v) FILTER (NOT high)', 'f')} FROM s"))
def goldfeld_quandt(spark, d):
    return _one(spark, {"f": diagnostics.goldfeld_quandt(tables.samples(spark, d), ["f1"], "y", "f1")[0]})


@register("rainbow", query(SQL_SAMPLES, "m AS (SELECT quantile_cont(f1, 0.25) AS low, quantile_cont(f1, 0.75) AS high FROM samples)", f"w AS (SELECT count(*) AS n, {_sse} AS s FROM samples)", f"i AS (SELECT count(*) AS m, {_sse} AS t FROM samples, m WHERE f1 BETWEEN low AND high)", select=f"SELECT {rd('((s - t) / (n - m)) / (t / (m - 2))', 'f')} FROM w, i"))
def rainbow(spark, d):
    return _one(spark, {"f": diagnostics.rainbow(tables.samples(spark, d), ["f1"], "y", "f1")[0]})


@register("ljung_box", "WITH c AS (SELECT o_custkey, o_orderkey, o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_custkey) AS e FROM orders), l AS (SELECT *, coalesce(lag(e) OVER w, 0) AS l1, coalesce(lag(e, 2) OVER w, 0) AS l2 FROM c WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)), s AS (SELECT o_custkey, count(*) AS n, sum(e*e) AS s0, sum(e*l1) AS s1, sum(e*l2) AS s2 FROM l GROUP BY 1) SELECT o_custkey, n, round(n * (n + 2) * (pow(s1/s0, 2) / (n - 1) + pow(s2/s0, 2) / (n - 2)), 6) + 0.0 AS q FROM s WHERE n > 2 AND s0 > 0")
def ljung_box(spark, d):
    return diagnostics.ljung_box(tables.table(spark, d, "orders"), "o_totalprice", ["o_custkey"], ["o_orderkey"], 2)


_normal = [
    "odd AS (SELECT 0 AS k, 1.0::DOUBLE AS d UNION ALL SELECT k + 1, d * (2*k + 3) FROM odd WHERE k < 90)",
    "v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY y) AS i, count(*) OVER () AS n, (y - avg(y) OVER ()) / stddev_samp(y) OVER () AS z FROM samples)",
    "u AS MATERIALIZED (SELECT z, 0.5 + exp(-z*z/2) / sqrt(2*pi()) * sum(pow(z, 2*k + 1) / d) AS p FROM (SELECT DISTINCT z FROM v), odd GROUP BY z)",
]  # the normal distribution by its series in odd powers


@register("anderson_darling", "WITH RECURSIVE " + ",\n".join([SQL_SAMPLES, *_normal]) + f"\nSELECT any_value(n) AS n, {rd('-any_value(n) - sum((2*i - 1) * ln(p) + (2*n + 1 - 2*i) * ln(1 - p)) / any_value(n)', 'a2', 3)} FROM v JOIN u USING (z)", 3)
def anderson_darling(spark, d):
    return diagnostics.anderson_darling(tables.samples(spark, d), "y")


@register("harvey_collier", digits=4)
def harvey_collier(spark, d):
    t, p = diagnostics.harvey_collier(_groups(spark, d), ["x1", "x2"], "y", "x1", "k")
    return _one(spark, {"t": t, "p": p})


@register("logit_search", digits=4)
def logit_search(spark, d):
    """All subsets of up to two features by McFadden's measure, three classes of orders."""
    o = tables.table(spark, d, "orders").select(F.col("o_totalprice").alias("price"), (F.col("o_orderkey") % 97).alias("key"), (F.col("o_custkey") % 31).alias("customer"), F.col("o_orderstatus").alias("status"))
    return logit.search(o, ["price", "key", "customer"], "status").select(F.array_join("combo", ",").alias("combo"), "k", "ll", "mcfadden")


# --- structure editing ------------------------------------------------------------------------------------------------


@register("push_apart", query(SQL_ATOMS, PAIRS, "c AS (SELECT mol_id, a2 AS atom_idx, max(a1) AS partner, arg_max(dist, a1) AS dist FROM pairs WHERE dist < 0.9 AND dist > 0 GROUP BY 1, 2)", select="SELECT a.mol_id, a.atom_idx, a.symbol, " + ", ".join(f"round(coalesce(p.{k} + 0.3 * (a.{k} - p.{k}) / c.dist, a.{k}), 6) + 0.0 AS {k}" for k in "xyz") + " FROM atoms a LEFT JOIN c ON c.mol_id = a.mol_id AND c.atom_idx = a.atom_idx LEFT JOIN atoms p ON p.mol_id = c.mol_id AND p.atom_idx = c.partner"))
def push_apart(spark, d):
    return geometry.push_apart(tables.atoms(spark, d), 0.9).select("mol_id", "atom_idx", "symbol", "x", "y", "z")


_turned = "t AS (SELECT a.mol_id, a.atom_idx, a.symbol, a.x - p.x0 AS px, a.y - p.y0 AS py, a.z - p.z0 AS pz, (p.x1 - p.x0) / l AS ax, (p.y1 - p.y0) / l AS ay, (p.z1 - p.z0) / l AS az FROM atoms a JOIN (SELECT *, sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2) + pow(z1 - z0, 2)) AS l FROM p) p USING (mol_id))"


@register("turn_onto", query(SQL_ATOMS, pick("p", 1, 2), _turned, select=f"SELECT mol_id, atom_idx, symbol, {rd('px - ax*pz - ax*(ax*px + ay*py)/(1 + az)', 'x')}, {rd('py - ay*pz - ay*(ax*px + ay*py)/(1 + az)', 'y')}, {rd('pz + ax*px + ay*py - (ax*ax + ay*ay)*pz/(1 + az)', 'z')} FROM t"))
def turn_onto(spark, d):
    return geometry.turn_onto(tables.atoms(spark, d), 1, 2, (0.0, 0.0, 1.0))


from gneiss.plans import models, readers, structures  # noqa: E402, F401  more queries register themselves
