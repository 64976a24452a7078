"""SQL text for the oracle: vectors as triples of expressions, and atoms picked into columns."""

from __future__ import annotations

from gneiss.sources.tables import SQL_ATOMS, SQL_CHARGES, SQL_MOVES, SQL_SAMPLES

V = tuple[str, str, str]


def v(i) -> V:
    return f"x{i}", f"y{i}", f"z{i}"


def sub(a: V, b: V) -> V:
    return tuple(f"({p} - {q})" for p, q in zip(a, b, strict=True))


def mul(a: V, k: str) -> V:
    return tuple(f"({p} * {k})" for p in a)


def dot(a: V, b: V) -> str:
    return "(" + " + ".join(f"{p} * {q}" for p, q in zip(a, b, strict=True)) + ")"


def cross(a: V, b: V) -> V:
    return f"({a[1]} * {b[2]} - {a[2]} * {b[1]})", f"({a[2]} * {b[0]} - {a[0]} * {b[2]})", f"({a[0]} * {b[1]} - {a[1]} * {b[0]})"


def norm(a: V) -> str:
    return f"sqrt({dot(a, a)})"


def angle(a: V, b: V) -> str:
    return f"degrees(acos(greatest(-1.0, least(1.0, {dot(a, b)} / ({norm(a)} * {norm(b)})))))"


def pick(name: str, *indexes: int, source: str = "atoms", keys: str = "mol_id", letter: str = "") -> str:
    cols = ", ".join(f"max({c}) FILTER (atom_idx = {i}) AS {letter}{c}{k}" for k, i in enumerate(indexes) for c in "xyz")
    return f"{name} AS (SELECT {keys}, {cols} FROM {source} WHERE atom_idx IN ({', '.join(map(str, sorted(set(indexes))))}) GROUP BY {keys})"


def frame_ctes(base: tuple[int, int, int]) -> str:
    """Columns u, v, w of three axes and the origin, step by step, as the CTE axes."""
    d = sub(v(2), v(0))
    return f"""{pick('b', *base)},
b1 AS (SELECT *, {', '.join(f'{c} / {norm(sub(v(1), v(0)))} AS v{n}' for c, n in zip(sub(v(1), v(0)), 'xyz', strict=True))} FROM b),
b2 AS (SELECT *, {', '.join(f'{c} - v{n} * {dot(d, ("vx", "vy", "vz"))} AS q{n}' for c, n in zip(d, 'xyz', strict=True))} FROM b1),
b3 AS (SELECT *, {', '.join(f'q{n} / sqrt(qx*qx + qy*qy + qz*qz) AS u{n}' for n in 'xyz')} FROM b2),
axes AS (SELECT mol_id, x0, y0, z0, ux, uy, uz, vx, vy, vz, {', '.join(f'{c} AS w{n}' for c, n in zip(cross(('ux', 'uy', 'uz'), ('vx', 'vy', 'vz')), 'xyz', strict=True))} FROM b3)"""


def framed_cte(base: tuple[int, int, int]) -> str:
    d = sub(("a.x", "a.y", "a.z"), v(0))
    new = ", ".join(f"{dot(d, tuple(f'{u}{c}' for c in 'xyz'))} AS {n}" for u, n in zip("uvw", "xyz", strict=True))
    return f"{frame_ctes(base)},\nframed AS (SELECT a.mol_id, a.atom_idx, a.symbol, {new} FROM atoms a JOIN axes USING (mol_id))"


PAIRS = "pairs AS MATERIALIZED (SELECT a.mol_id, a.atom_idx AS a1, b.atom_idx AS a2, a.symbol AS s1, b.symbol AS s2, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS dist FROM atoms a JOIN atoms b ON a.mol_id = b.mol_id WHERE a.atom_idx < b.atom_idx)"
BONDS = """found AS MATERIALIZED (SELECT * FROM pairs WHERE (dist < 2.12 AND NOT (s1 = 'H' AND s2 = 'H') AND (NOT (s1 = 'H' OR s2 = 'H') OR dist < 1.5)) OR ((s1 = 'Cl' OR s2 = 'Cl') AND dist >= 2.12 AND dist < 2.6)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY mol_id, atom ORDER BY dist, a1, a2) AS k FROM (SELECT mol_id, a1, a2, dist, a1 AS atom FROM found WHERE s1 = 'Cl' UNION ALL SELECT mol_id, a1, a2, dist, a2 FROM found WHERE s2 = 'Cl')),
surplus AS MATERIALIZED (SELECT DISTINCT mol_id, a1, a2 FROM ranked WHERE k > 1),
bonds AS MATERIALIZED (SELECT f.mol_id, f.a1, f.a2, f.dist FROM found f ANTI JOIN surplus s ON s.mol_id = f.mol_id AND s.a1 = f.a1 AND s.a2 = f.a2)"""
NEAR = "near AS (SELECT mol_id, a1 AS atom, a2 AS other FROM bonds UNION ALL SELECT mol_id, a2, a1 FROM bonds)"


def query(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


__all__ = ["SQL_ATOMS", "SQL_CHARGES", "SQL_MOVES", "SQL_SAMPLES"]
