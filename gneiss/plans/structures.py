"""Registered queries of structures: substituents, patterns, widths in two steps, pairs of atoms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.operators import alignment, geometry, graph, sterics, sterimol, vibrations
from gneiss.plans import sqlgen as S
from gneiss.plans.registry import rd, register
from gneiss.plans.sqlgen import NEAR, PAIRS, SQL_ATOMS, SQL_CHARGES, SQL_MOVES, framed_cte, pick, query, v
from gneiss.sources import tables

BASE = (1, 2, 3)
SQL_SPARSE = "bonds AS MATERIALIZED (SELECT mol_id, a1, a2, dist FROM pairs WHERE dist < 1.25::DOUBLE)"
_bondi = "CASE symbol WHEN 'H' THEN 1.10::DOUBLE WHEN 'C' THEN 1.70::DOUBLE WHEN 'N' THEN 1.55::DOUBLE WHEN 'O' THEN 1.52::DOUBLE ELSE 1.75::DOUBLE END"
_extent = f"e AS MATERIALIZED (SELECT *, r + sqrt(x*x + z*z) AS b5, y + r AS l FROM (SELECT *, {_bondi} AS r FROM framed))"


def short_bonds(spark, d) -> DataFrame:
    return geometry.pairs(tables.atoms(spark, d)).where("dist < 1.25").select("mol_id", "a1", "a2")


@register("bond_lengths", query(SQL_ATOMS, pick("p", 1, 2, 5), select=f"SELECT mol_id, {rd(S.norm(S.sub(v(0), v(1))), 'length_1_2')}, {rd(S.norm(S.sub(v(1), v(2))), 'length_2_5')}, CAST(NULL AS DOUBLE) AS length_1_99 FROM p"))
def bond_lengths(spark, d):
    """Many pairs at once; an atom that a molecule lacks gives a null, not a lost row."""
    return geometry.bond_lengths(tables.atoms(spark, d), [(1, 2), (2, 5), (1, 99)])


@register("first_atoms", query(SQL_ATOMS, select="SELECT mol_id, max(symbol) FILTER (atom_idx = 1) AS symbol_1, max(symbol) FILTER (atom_idx = 2) AS symbol_2, max(symbol) FILTER (atom_idx = 3) AS symbol_3 FROM atoms GROUP BY mol_id"))
def first_atoms(spark, d):
    return geometry.first_atoms(tables.atoms(spark, d), 3)


_walk = "walk AS (SELECT DISTINCT mol_id, 2 AS atom FROM bonds UNION SELECT w.mol_id, n.other FROM walk w JOIN near n ON n.mol_id = w.mol_id AND n.atom = w.atom WHERE n.other <> 1 AND n.atom <> 1)"
_sub = "sub AS MATERIALIZED (SELECT e.* FROM e JOIN (SELECT mol_id, atom FROM walk UNION SELECT DISTINCT mol_id, 1 FROM bonds) w ON w.mol_id = e.mol_id AND w.atom = e.atom_idx)"
_h = "h AS (SELECT mol_id, t, max(x * cos(radians(t)) + z * sin(radians(t)) + r) AS h FROM sub, (SELECT unnest(range(0, 360)) AS t) GROUP BY mol_id, t)"


@register("sterimol_substituent", "WITH RECURSIVE " + ",\n".join([SQL_ATOMS, PAIRS, SQL_SPARSE, NEAR, framed_cte(BASE), _extent, _walk, _sub, _h, "w AS (SELECT mol_id, min(h) AS b1 FROM h GROUP BY mol_id)", "f AS (SELECT mol_id, max(b5) AS b5, max(l) AS l, arg_max(y, (b5, y)) AS loc_b5 FROM sub GROUP BY mol_id)"]) + f"\nSELECT mol_id, {rd('b1', 'b1', 4)}, {rd('b5', 'b5', 4)}, {rd('l', 'l', 4)}, {rd('loc_b5', 'loc_b5', 4)} FROM w JOIN f USING (mol_id)", 4)
def sterimol_substituent(spark, d):
    """Of the atoms that hang on the second one as seen from the first."""
    return sterimol.sterimol(tables.atoms(spark, d), BASE, short_bonds(spark, d)).drop("b1_b5_angle")


_all_h = "h AS MATERIALIZED (SELECT mol_id, t, max(x * cos(radians(t)) + z * sin(radians(t)) + r) AS h FROM e, (SELECT unnest(range(0, 360)) AS t) GROUP BY mol_id, t)"
_quarter = "q AS MATERIALIZED (SELECT mol_id, t % 90 AS t, min(h) AS h FROM h GROUP BY 1, 2)"


@register("b1_two_steps", query(SQL_ATOMS, framed_cte(BASE), _extent, _all_h, _quarter, "c AS (SELECT mol_id, arg_min(s, (h, s)) AS best FROM q JOIN (SELECT unnest([18, 36, 54, 72, 90]) AS s) ON t = s % 90 GROUP BY mol_id)", select=f"SELECT mol_id, {rd('min(h)', 'b1', 4)} FROM q JOIN c USING (mol_id) JOIN (SELECT unnest(range(-18, 19)) AS o) ON q.t = (best + o + 90) % 90 GROUP BY mol_id"), 4)
def b1_two_steps(spark, d):
    return sterimol.b1_two_steps(tables.atoms(spark, d), BASE).drop("degree")


_ten = "h AS MATERIALIZED (SELECT mol_id, t, max(x * cos(radians(t)) + z * sin(radians(t)) + r) AS h FROM e, (SELECT unnest(range(0, 360, 10)) AS t) GROUP BY mol_id, t)"


@register("envelope_axes", query(SQL_ATOMS, framed_cte(BASE), _extent, _ten, select=f"SELECT mol_id, {rd('min(h)', 'least', 4)}, {rd('max(h)', 'most', 4)}, CAST((arg_min(t, (h, t)) - arg_max(t, (h, -t)) + 360) % 180 AS INT) AS angle FROM h GROUP BY mol_id"), 4)
def envelope_axes(spark, d):
    return sterimol.envelope_axes(tables.atoms(spark, d), BASE)


_kinds = "kind AS MATERIALIZED (SELECT n.mol_id, n.atom, n.other, a.symbol AS s, b.symbol AS o FROM near n JOIN atoms a ON a.mol_id = n.mol_id AND a.atom_idx = n.atom JOIN atoms b ON b.mol_id = n.mol_id AND b.atom_idx = n.other)"


@register("match_pattern", query(SQL_ATOMS, PAIRS, SQL_SPARSE, NEAR, _kinds, select="SELECT p.mol_id, p.atom AS m0, p.other AS m1, q.other AS m2, r.other AS m3 FROM kind p JOIN kind q ON q.mol_id = p.mol_id AND q.atom = p.other JOIN kind r ON r.mol_id = p.mol_id AND r.atom = q.other WHERE p.s = 'O' AND p.o = 'C' AND q.o = 'N' AND q.other <> p.atom AND r.other NOT IN (p.atom, p.other, q.other)"))
def match_pattern(spark, d):
    """Every O-C-N-* chain."""
    return graph.match_pattern(tables.atoms(spark, d), short_bonds(spark, d), ["O", "C", "N", None], [(0, 1), (1, 2), (2, 3)])


@register("nth_atom", query(SQL_ATOMS, select="SELECT mol_id, atom_idx FROM atoms WHERE symbol = 'N' QUALIFY row_number() OVER (PARTITION BY mol_id ORDER BY atom_idx) = 2"))
def nth_atom(spark, d):
    return alignment.nth_atom(tables.atoms(spark, d), "N", 2)


@register("smallest_molecule", query(SQL_ATOMS, select="SELECT mol_id, count(*) AS n FROM atoms WHERE symbol <> 'H' GROUP BY mol_id ORDER BY n, mol_id LIMIT 1"))
def smallest_molecule(spark, d):
    return alignment.smallest(tables.atoms(spark, d).where("symbol <> 'H'"))


_line = S.sub(("p.x0", "p.y0", "p.z0"), ("p.x1", "p.y1", "p.z1"))


@register("similar_to_pair", query(SQL_ATOMS, SQL_MOVES, pick("p", 1, 2), f"f AS MATERIALIZED (SELECT m.mol_id, m.mode_idx, m.atom_idx, abs({S.dot(('m.x', 'm.y', 'm.z'), _line)}) / {S.norm(_line)} AS far FROM moves m JOIN p USING (mol_id))", "a AS (SELECT mol_id, mode_idx, sum(far) AS amplitude FROM f WHERE atom_idx <= 2 GROUP BY 1, 2)", select=f"SELECT f.mol_id, f.mode_idx, {rd('any_value(amplitude)', 'amplitude')}, count(*) FILTER (atom_idx > 2 AND abs(far - amplitude) <= 1e-8 + 0.1::DOUBLE * amplitude) AS n FROM f JOIN a ON f.mol_id = a.mol_id AND f.mode_idx = a.mode_idx GROUP BY 1, 2"))
def similar_to_pair(spark, d):
    out = vibrations.similar_to_pair(tables.displacements(spark, d), tables.atoms(spark, d), 1, 2)
    return out.select("mol_id", "mode_idx", "amplitude", F.size("similar").cast("long").alias("n"))


_keys = "mol_id, mode_idx, frequency"
_cosine = f"{S.dot(v(0), v(1))} / ({S.norm(v(0))} * {S.norm(v(1))})"


@register("direction_symmetry", query(SQL_ATOMS, SQL_MOVES, pick("m", 4, 6, source="moves", keys=_keys), select=f"SELECT mol_id, mode_idx, {rd(_cosine, 'cosine')}, CASE WHEN {_cosine} > 0 THEN 'asymmetric' WHEN {_cosine} < 0 THEN 'symmetric' ELSE 'unclear' END AS kind FROM m"))
def direction_symmetry(spark, d):
    return vibrations.direction_symmetry(tables.displacements(spark, d), 4, 6)


_simple = "trail AS (SELECT mol_id, [1, other] AS path FROM near WHERE atom = 1 UNION ALL SELECT t.mol_id, list_append(t.path, n.other) FROM trail t JOIN near n ON n.mol_id = t.mol_id AND n.atom = t.path[-1] WHERE NOT list_contains(t.path, n.other))"


@register("on_paths", "WITH RECURSIVE " + ",\n".join([SQL_ATOMS, PAIRS, SQL_SPARSE, NEAR, _simple]) + "\nSELECT DISTINCT mol_id, CAST(unnest(path) AS INT) AS atom FROM trail WHERE list_contains(path, 2)")
def on_paths(spark, d):
    return graph.on_paths(short_bonds(spark, d), 1, 2)


_part = "part AS MATERIALIZED (SELECT f.* FROM framed f JOIN (SELECT mol_id, atom FROM walk UNION SELECT DISTINCT mol_id, 1 FROM bonds) w ON w.mol_id = f.mol_id AND w.atom = f.atom_idx)"
_turned = "turned AS (SELECT mol_id, t, least(abs(max(x*cos(radians(t)) + z*sin(radians(t)))), abs(min(x*cos(radians(t)) + z*sin(radians(t)))), abs(max(z*cos(radians(t)) - x*sin(radians(t)))), abs(min(z*cos(radians(t)) - x*sin(radians(t))))) AS h FROM part, (SELECT unnest(range(0, 90, 10)) AS t) GROUP BY mol_id, t)"


@register("surface_substituent", "WITH RECURSIVE " + ",\n".join([SQL_ATOMS, PAIRS, SQL_SPARSE, NEAR, framed_cte(BASE), _walk, _part, _turned, "side AS (SELECT mol_id, min(h) AS b1 FROM turned GROUP BY mol_id)"]) + f"\nSELECT mol_id, {rd('max(y)', 'l', 4)}, {rd('max(b1)', 'b1', 4)}, {rd('max(sqrt(x*x + z*z))', 'b5', 4)} FROM part JOIN side USING (mol_id) GROUP BY mol_id", 4)
def surface_substituent(spark, d):
    a = tables.atoms(spark, d)
    return sterics.surface_sterimol(a.select("mol_id", "x", "y", "z"), a, BASE, 10, short_bonds(spark, d))


@register("common_to_group")
def common_to_group(spark, d):
    """What each three molecules in a row have in common."""
    a = tables.atoms(spark, d).withColumn("three", F.floor(F.col("mol_id") / 3).cast("long"))
    return alignment.common_to_group(a, short_bonds(spark, d), "three")


@register("renumbering")
def renumbering(spark, d):
    """Shuffled copies get the numbers of their originals."""
    a, bonds = tables.atoms(spark, d), short_bonds(spark, d)
    moved = alignment.shuffle_atoms(a)
    m = moved.select("mol_id", "old_idx", F.col("atom_idx").alias("n"))
    end = lambda t, c: t.join(m.withColumnsRenamed({"old_idx": c, "n": f"n{c}"}), ["mol_id", c])
    own = end(end(bonds, "a1"), "a2").select("mol_id", F.least("na1", "na2").alias("a1"), F.greatest("na1", "na2").alias("a2"))
    return alignment.renumbering(moved.drop("old_idx"), a, own, bonds)


@register("descriptor_summary", query(SQL_ATOMS, SQL_CHARGES, framed_cte(BASE), _extent, "d AS (SELECT f.mol_id, sqrt(pow(sum(charge*x), 2) + pow(sum(charge*y), 2) + pow(sum(charge*z), 2)) AS total FROM framed f JOIN charges c ON c.mol_id = f.mol_id AND c.atom_idx = f.atom_idx GROUP BY f.mol_id)", select=f"SELECT e.mol_id, {rd('any_value(total)', 'total', 4)}, {rd('max(l)', 'l', 4)}, {rd('max(b5)', 'b5', 4)}, {rd('arg_max(y, (b5, y))', 'loc_b5', 4)} FROM e JOIN d USING (mol_id) GROUP BY e.mol_id"), 4)
def descriptor_summary(spark, d):
    return geometry.descriptor_summary(tables.atoms(spark, d), tables.charges(spark, d), BASE)
