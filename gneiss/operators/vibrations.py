"""Vibrational modes: which mode moves a bond, an angle, a ring. Displacements have (mol_id, mode_idx, frequency, atom_idx, x, y, z)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions.vectors import cross, dot, minus, norm, vector
from gneiss.operators.geometry import pick
from gneiss.operators.graph import common_neighbour


def modes_of(moves: DataFrame, *indexes: int, lower: float | None = None, upper: float | None = None) -> DataFrame:
    """(mol_id, mode_idx, frequency, v0, v1, ...): displacements of the named atoms, of modes strictly between two frequencies."""
    own = moves.where(F.col("atom_idx").isin(list(set(indexes))))
    if lower is not None:
        own = own.where(F.col("frequency") > lower)
    if upper is not None:
        own = own.where(F.col("frequency") < upper)
    point = F.struct("x", "y", "z")
    out = own.groupBy("mol_id", "mode_idx", "frequency").agg(*[F.max(F.when(F.col("atom_idx") == i, point)).alias(f"v{k}") for k, i in enumerate(indexes)])
    return out.dropna(subset=[f"v{k}" for k in range(len(indexes))])


def _strongest(rated: DataFrame, *more: str) -> DataFrame:
    """The mode of the largest amplitude, the lower mode number on ties."""
    best = rated.groupBy("mol_id").agg(F.max(F.struct("amplitude", (-F.col("mode_idx")).alias("k"), "frequency", *more)).alias("m"))
    return best.select("mol_id", "m.frequency", "m.amplitude", *[f"m.{c}" for c in more])


def stretch_mode(moves: DataFrame, atoms: DataFrame, i: int, j: int, lower: float = 1400, upper: float = 3500) -> DataFrame:
    """The mode that stretches a bond most: the sum of both ends' absolute products with the bond vector."""
    m = modes_of(moves, i, j, lower=lower, upper=upper).join(pick(atoms, i, j), "mol_id")
    bond = minus(vector("p1"), vector("p0"))
    return _strongest(m.select("mol_id", "mode_idx", "frequency", (F.abs(dot(vector("v0"), bond)) + F.abs(dot(vector("v1"), bond))).alias("amplitude")))


def bend_mode(moves: DataFrame, i: int, j: int, lower: float = 1300, bonds: DataFrame | None = None) -> DataFrame:
    """The mode of the largest cross product of two atoms' displacements; with bonds only of molecules in which the two atoms have a
    neighbour in common."""
    if bonds is not None:
        held = common_neighbour(bonds).where((F.col("left") == min(i, j)) & (F.col("right") == max(i, j))).select("mol_id")
        moves = moves.join(held, "mol_id", "left_semi")
    m = modes_of(moves, i, j, lower=lower)
    return _strongest(m.select("mol_id", "mode_idx", "frequency", norm(cross(vector("v0"), vector("v1"))).alias("amplitude")))


def strongest_mode(moves: DataFrame, i: int, lower: float = 1500) -> DataFrame:
    """The mode above a frequency that moves an atom most."""
    m = modes_of(moves, i, lower=lower)
    return _strongest(m.select("mol_id", "mode_idx", "frequency", norm(vector("v0")).alias("amplitude")))


def ring_modes(moves: DataFrame, ring: list[int], atoms: DataFrame, lower: float = 1600, upper: float = 1750, least: float = 0.01) -> DataFrame:
    """Of a six-ring's modes, those of the least and largest angle between the motion of alternate atoms and the ring's axis.

    The ring is given in its own order. The two sums of alternate atoms' displacements are multiplied, and small products don't count;
    the sine is that of the sum with the first atom to the line from the first atom to the fourth."""
    m = modes_of(moves, *ring, lower=lower, upper=upper).join(pick(atoms, ring[0], ring[3]), "mol_id")
    odd = tuple(F.col(f"v0.{c}") + F.col(f"v2.{c}") + F.col(f"v4.{c}") for c in "xyz")
    even = tuple(F.col(f"v1.{c}") + F.col(f"v3.{c}") + F.col(f"v5.{c}") for c in "xyz")
    axis = minus(vector("p1"), vector("p0"))
    sine = norm(cross(odd, axis)) / (norm(odd) * norm(axis))
    rated = m.select("mol_id", "frequency", dot(odd, even).alias("product"), F.least(F.lit(1.0), sine).alias("sine")).where(F.abs("product") > least)
    best = rated.groupBy("mol_id").agg(F.min(F.struct("sine", "frequency")).alias("a"), F.max(F.struct("sine", "frequency")).alias("b"))
    return best.select("mol_id", F.col("a.frequency").alias("para"), F.degrees(F.asin("a.sine")).alias("para_angle"), F.col("b.frequency").alias("cross"), F.degrees(F.asin("b.sine")).alias("cross_angle"))


def similar_amplitude(moves: DataFrame, i: int, tolerance: float = 0.1) -> DataFrame:
    """(mol_id, mode_idx, n): how many other atoms move about as far as atom i in each mode."""
    a = moves.select("mol_id", "mode_idx", "atom_idx", norm((F.col("x"), F.col("y"), F.col("z"))).alias("far"))
    own = a.where(F.col("atom_idx") == i).select("mol_id", "mode_idx", F.col("far").alias("own"))
    return a.where(F.col("atom_idx") != i).join(own, ["mol_id", "mode_idx"]).where(F.abs(F.col("far") - F.col("own")) <= 1e-8 + tolerance * F.abs("own")).groupBy("mol_id", "mode_idx").agg(F.count("*").alias("n"))


def similar_to_pair(moves: DataFrame, atoms: DataFrame, i: int, j: int, tolerance: float = 0.1, projected: bool = True) -> DataFrame:
    """(mol_id, mode_idx, amplitude, similar): the sum of two atoms' amplitudes, along the line that joins them or in all, and the other
    atoms, in order, whose own amplitude is within the tolerance of it."""
    m = moves.join(pick(atoms, i, j), "mol_id")
    bond, move = minus(vector("p0"), vector("p1")), (F.col("x"), F.col("y"), F.col("z"))
    far = F.abs(dot(move, bond)) / norm(bond) if projected else norm(move)
    rated = m.select("mol_id", "mode_idx", "atom_idx", far.alias("far")).groupBy("mol_id", "mode_idx").agg(F.sum(F.when(F.col("atom_idx").isin(i, j), F.col("far"))).alias("amplitude"), F.collect_list(F.when(~F.col("atom_idx").isin(i, j), F.struct("atom_idx", "far"))).alias("others"))
    near = F.filter("others", lambda a: F.abs(a["far"] - F.col("amplitude")) <= 1e-8 + tolerance * F.abs("amplitude"))
    return rated.select("mol_id", "mode_idx", "amplitude", F.array_sort(near["atom_idx"]).alias("similar"))


def direction_symmetry(moves: DataFrame, i: int, j: int, threshold: float = 0.0) -> DataFrame:
    """(mol_id, mode_idx, cosine, kind): whether two atoms move alike (asymmetric), against each other (symmetric) or neither (unclear)."""
    m = modes_of(moves, i, j)
    size = norm(vector("v0")) * norm(vector("v1"))
    cosine = F.when(size > 0, dot(vector("v0"), vector("v1")) / size).otherwise(0.0)
    kind = F.when(F.col("cosine") > threshold, "asymmetric").when(F.col("cosine") < threshold, "symmetric").otherwise("unclear")
    return m.select("mol_id", "mode_idx", cosine.alias("cosine")).withColumn("kind", kind)


def ground_state(modes: DataFrame) -> DataFrame:
    """Whether no frequency is negative."""
    return modes.groupBy("mol_id").agg(F.bool_and(F.col("frequency") >= 0).alias("ground_state"))
