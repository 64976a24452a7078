"""Distances, angles, centres, local frames and what is computed in them. Atom tables have (mol_id, atom_idx, symbol, x, y, z)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions.elements import lookup
from gneiss.functions.vectors import angle, axes, cross, dot, into, minus, norm, unit, vector, with_frame


def pick(atoms: DataFrame, *indexes: int) -> DataFrame:
    """One row a molecule with the named atoms as structs p0, p1, ...: a pivot, not a join a piece; molecules lacking one drop out."""
    wanted = atoms.where(F.col("atom_idx").isin(list(set(indexes))))
    point = F.struct("x", "y", "z")
    out = wanted.groupBy("mol_id").agg(*[F.max(F.when(F.col("atom_idx") == i, point)).alias(f"p{k}") for k, i in enumerate(indexes)])
    return out.dropna(subset=[f"p{k}" for k in range(len(indexes))])


def dealt(df: DataFrame, key: str = "mol_id") -> DataFrame:
    """df by molecule in the session's own number of partitions, which adaptive execution would merge into few: a molecule's rows are few
    bytes, but what is made of them isn't."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def molecules(atoms: DataFrame) -> DataFrame:
    """(mol_id, atoms array<struct<atom_idx, symbol, x, y, z>>): one row a molecule, and no row for atoms without one."""
    return dealt(atoms.where("mol_id IS NOT NULL")).groupBy("mol_id").agg(F.collect_list(F.struct("atom_idx", "symbol", "x", "y", "z")).alias("atoms"))


def pairs(atoms: DataFrame) -> DataFrame:
    """(mol_id, a1, a2, s1, s2, dist) of all atom pairs, a1 < a2. They are made in the molecule's own row and never sorted."""
    one = lambda k: F.inline("atoms").alias(f"a{k}", f"s{k}", f"x{k}", f"y{k}", f"z{k}")
    both = molecules(atoms).select("mol_id", "atoms", one(1)).select("mol_id", "a1", "s1", "x1", "y1", "z1", one(2)).where("a1 < a2")
    first, second = (tuple(F.col(f"{c}{k}") for c in "xyz") for k in (1, 2))
    return both.select("mol_id", "a1", "a2", "s1", "s2", norm(minus(first, second)).alias("dist"))


def bond_length(atoms: DataFrame, i: int, j: int) -> DataFrame:
    return pick(atoms, i, j).select("mol_id", norm(minus(vector("p0"), vector("p1"))).alias("length"))


def bond_lengths(atoms: DataFrame, ends: list[tuple[int, int]]) -> DataFrame:
    """(mol_id, length_i_j, ...) for all pairs of atoms in one aggregation; a molecule that lacks an atom keeps its row, with nulls."""
    wanted = sorted({a for pair in ends for a in pair})
    point = F.struct("x", "y", "z")
    held = atoms.groupBy("mol_id").agg(*[F.max(F.when(F.col("atom_idx") == i, point)).alias(f"p{i}") for i in wanted])
    return held.select("mol_id", *[norm(minus(vector(f"p{i}"), vector(f"p{j}"))).alias(f"length_{i}_{j}") for i, j in ends])


def first_atoms(atoms: DataFrame, n: int) -> DataFrame:
    """(mol_id, symbol_1, ..., symbol_n): the first atoms of each molecule side by side."""
    return atoms.where(F.col("atom_idx") <= n).groupBy("mol_id").agg(*[F.max(F.when(F.col("atom_idx") == i, F.col("symbol"))).alias(f"symbol_{i}") for i in range(1, n + 1)])


def selectivity(ddg: Column, kelvin: float = 298.15, threshold: float = 35.0) -> Column:
    """Whether an enantiomeric excess is of the selective class."""
    return F.abs(enantiomeric_excess(ddg, kelvin)) >= threshold


def bond_angle(atoms: DataFrame, i: int, j: int, k: int) -> DataFrame:
    """Degrees at the middle atom."""
    return pick(atoms, i, j, k).select("mol_id", angle(minus(vector("p0"), vector("p1")), minus(vector("p2"), vector("p1"))).alias("angle"))


def dihedral(atoms: DataFrame, i: int, j: int, k: int, l: int) -> DataFrame:
    """Unsigned degrees between the planes of the first and the last three atoms."""
    p = [vector(f"p{n}") for n in range(4)]
    first, second = cross(minus(p[1], p[0]), minus(p[2], p[1])), cross(minus(p[2], p[1]), minus(p[3], p[2]))
    return pick(atoms, i, j, k, l).select("mol_id", angle(first, second).alias("dihedral"))


def too_close(atoms: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pairs nearer than the threshold."""
    return pairs(atoms).where(F.col("dist") < threshold).select("mol_id", "a1", "a2", "dist")


def centroid(atoms: DataFrame, indexes: list[int] | None = None) -> DataFrame:
    own = atoms.where(F.col("atom_idx").isin(indexes)) if indexes else atoms
    return own.groupBy("mol_id").agg(*[F.avg(c).alias(c) for c in "xyz"])


def center_of_mass(atoms: DataFrame) -> DataFrame:
    w = lookup(F.col("symbol"), "weight")
    return atoms.groupBy("mol_id").agg(*[(F.sum(w * F.col(c)) / F.sum(w)).alias(c) for c in "xyz"])


def nearest_to_center(atoms: DataFrame) -> DataFrame:
    """The atom nearest to the centre of mass, the smaller index on ties."""
    both = atoms.alias("a").join(center_of_mass(atoms).alias("c"), "mol_id")
    far = both.select("mol_id", "atom_idx", norm(minus(vector("a"), vector("c"))).alias("dist"))
    return far.groupBy("mol_id").agg(F.min(F.struct("dist", "atom_idx")).alias("m")).select("mol_id", "m.atom_idx", "m.dist")


def _framed(atoms: DataFrame, base: tuple[int, int, int], midpoint_of: tuple[int, int] | None = None) -> DataFrame:
    points = pick(atoms, *base, *(midpoint_of or ()))
    origin = tuple((F.col(f"p3.{c}") + F.col(f"p4.{c}")) / 2 for c in "xyz") if midpoint_of else vector("p0")
    return with_frame(points, origin, vector("p1"), vector("p2")).select("mol_id", "fo", "fx", "fy", "fz")


def frame_transform(atoms: DataFrame, base: tuple[int, int, int], midpoint_of: tuple[int, int] | None = None) -> DataFrame:
    """Atoms in the frame of three base atoms: origin, y direction, plane; a midpoint of two atoms may be the origin. Null if collinear.

    The frame is one row a molecule, joined to its atoms on the molecule."""
    both = atoms.alias("a").join(_framed(atoms, base, midpoint_of), "mol_id")
    new = into(axes(), vector("fo"), vector("a"))
    return both.select("mol_id", "atom_idx", "symbol", *[n.alias(c) for n, c in zip(new, "xyz", strict=True)])


def npa_dipole(atoms: DataFrame, charges: DataFrame, base: tuple[int, int, int], sub_atoms: list[int] | None = None) -> DataFrame:
    """Dipole of point charges in the frame: sums of charge times coordinate, and the norm."""
    moved = frame_transform(atoms, base)
    if sub_atoms:
        moved = moved.where(F.col("atom_idx").isin(sub_atoms))
    sums = moved.join(charges, ["mol_id", "atom_idx"]).groupBy("mol_id").agg(*[F.sum(F.col("charge") * F.col(c)).alias(f"dip_{c}") for c in "xyz"])
    return sums.withColumn("total", norm((F.col("dip_x"), F.col("dip_y"), F.col("dip_z"))))


def rotated_dipole(atoms: DataFrame, dipoles: DataFrame, base: tuple[int, int, int]) -> DataFrame:
    """dipoles(mol_id, dx, dy, dz) in the frame of base; a right-handed rotation, so the total stays."""
    d = (F.col("dx"), F.col("dy"), F.col("dz"))
    new = into(axes(), (F.lit(0.0), F.lit(0.0), F.lit(0.0)), d)
    return _framed(atoms, base).join(dipoles, "mol_id").select("mol_id", *[n.alias(f"dip_{c}") for n, c in zip(new, "xyz", strict=True)], norm(d).alias("total"))


def charges_at(charges: DataFrame, indexes: list[int], kind: str = "nbo") -> DataFrame:
    """A column `kind_atom_i` for each atom, by conditional aggregation."""
    return charges.where(F.col("atom_idx").isin(indexes)).groupBy("mol_id").agg(*[F.max(F.when(F.col("atom_idx") == i, F.col("charge"))).alias(f"{kind}_atom_{i}") for i in indexes])


def charge_difference(charges: DataFrame, i: int, j: int) -> DataFrame:
    c = charges_at(charges, [i, j], "q")
    return c.select("mol_id", (F.col(f"q_atom_{i}") - F.col(f"q_atom_{j}")).alias("difference"))


def swap_atoms(atoms: DataFrame, i: int, j: int) -> DataFrame:
    """Coordinates of two atoms change places; symbols stay. One aggregation finds them, one join brings them."""
    points = pick(atoms, i, j)
    idx = F.col("atom_idx")
    new = [F.when(idx == i, F.col(f"p1.{c}")).when(idx == j, F.col(f"p0.{c}")).otherwise(F.col(c)).alias(c) for c in "xyz"]
    return atoms.join(points, "mol_id").select("mol_id", "atom_idx", "symbol", *new)


def rigid_motion(atoms: DataFrame, shift: tuple[float, float, float], turn: tuple[float, float, float]) -> DataFrame:
    """Rotation about x, then y, then z by radians, then translation."""
    import math

    x, y, z = F.col("x"), F.col("y"), F.col("z")
    for axis, t in enumerate(turn):
        c, s = math.cos(t), math.sin(t)
        if axis == 0:
            y, z = y * c - z * s, y * s + z * c
        elif axis == 1:
            x, z = x * c + z * s, z * c - x * s
        else:
            x, y = x * c - y * s, x * s + y * c
    return atoms.select("mol_id", "atom_idx", "symbol", (x + shift[0]).alias("x"), (y + shift[1]).alias("y"), (z + shift[2]).alias("z"))


def enantiomeric_excess(ddg: Column, kelvin: float = 298.15, r: float = 0.0019872041) -> Column:
    """Percent from a free energy difference in kcal/mol."""
    return F.lit(100.0) * F.tanh(-ddg / (2 * r * kelvin))


def cosine_distance_difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """Mean absolute difference, a molecule, between the cosine distances of atom pairs in two geometries."""

    def cosines(t: DataFrame) -> DataFrame:
        a, b = t.alias("a"), t.alias("b")
        both = a.join(b, (F.col("a.mol_id") == F.col("b.mol_id")) & (F.col("a.atom_idx") < F.col("b.atom_idx")))
        n = norm(vector("a")) * norm(vector("b"))
        d = F.lit(1.0) - (F.col("a.x") * F.col("b.x") + F.col("a.y") * F.col("b.y") + F.col("a.z") * F.col("b.z")) / n
        return both.select(F.col("a.mol_id").alias("mol_id"), F.col("a.atom_idx").alias("a1"), F.col("b.atom_idx").alias("a2"), d.alias("d"))

    both = cosines(first).join(cosines(second).withColumnRenamed("d", "d2"), ["mol_id", "a1", "a2"])
    return both.groupBy("mol_id").agg(F.avg(F.abs(F.col("d") - F.col("d2"))).alias("difference"))


def push_apart(atoms: DataFrame, threshold: float = 0.5, distance: float = 0.3) -> DataFrame:
    """Atoms, those within the threshold of an earlier one set `distance` from the last such along the line that joins them; atoms at
    one place stay there, as they have no such line."""
    close = pairs(atoms).where((F.col("dist") < threshold) & (F.col("dist") > 0)).groupBy("mol_id", F.col("a2").alias("atom_idx")).agg(F.max_by("a1", "a1").alias("partner"), F.max_by("dist", "a1").alias("dist"))
    other = atoms.select("mol_id", F.col("atom_idx").alias("partner"), *[F.col(c).alias(f"p{c}") for c in "xyz"])
    moved = close.join(other, ["mol_id", "partner"])
    new = [F.coalesce(F.col(f"p{c}") + distance * (F.col(c) - F.col(f"p{c}")) / F.col("dist"), F.col(c)).alias(c) for c in "xyz"]
    return atoms.join(moved, ["mol_id", "atom_idx"], "left").select(*[c for c in atoms.columns if c not in "xyz"], *new)


def turn_onto(atoms: DataFrame, i: int, j: int, direction: tuple[float, float, float]) -> DataFrame:
    """Atoms turned about atom i, which goes to the origin, so that atom j lies in the direction: the shortest turn; for the opposite
    direction a half turn about an axis across it."""
    size = sum(d * d for d in direction) ** 0.5
    u = tuple(d / size for d in direction)
    least = min(range(3), key=lambda k: abs(u[k]))
    e = tuple(float(k == least) for k in range(3))
    across = (u[1] * e[2] - u[2] * e[1], u[2] * e[0] - u[0] * e[2], u[0] * e[1] - u[1] * e[0])
    long = sum(a * a for a in across) ** 0.5
    b, axis = tuple(F.lit(c) for c in u), tuple(F.lit(a / long) for a in across)
    d = atoms.alias("a").join(pick(atoms, i, j), "mol_id")
    p, a = minus(vector("a"), vector("p0")), unit(minus(vector("p1"), vector("p0")))
    w, c = cross(a, b), dot(a, b)
    once, back = cross(w, p), 2 * dot(axis, p)
    twice = cross(w, once)
    new = [F.when(c < -1 + 1e-9, back * axis[k] - p[k]).otherwise(p[k] + once[k] + twice[k] / (1 + c)).alias(n) for k, n in enumerate("xyz")]
    return d.select("mol_id", "atom_idx", "symbol", *new)


def descriptor_summary(atoms: DataFrame, charges: DataFrame, base: tuple[int, int, int], energies: DataFrame | None = None) -> DataFrame:
    """(mol_id, total, l, b5, loc_b5[, scf_energy]): a molecule's dipole of charges, its reach and its energy, for those that have all."""
    from gneiss.operators.sterimol import l_b5

    out = npa_dipole(atoms, charges, base).select("mol_id", "total").join(l_b5(atoms, base), "mol_id")
    return out.join(energies.select("mol_id", "scf_energy"), "mol_id") if energies is not None else out
