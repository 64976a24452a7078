"""Sizes of ligands: cone angles, buried volume by octant, and Sterimol parameters of a density surface."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions.elements import lookup
from gneiss.functions.vectors import angle, axes, into, minus, norm, vector, with_frame
from gneiss.operators.geometry import frame_transform, pick
from gneiss.operators.graph import reachable
from gneiss.operators.sterimol import counted, covered, grid, spheres


def cone_angle(atoms: DataFrame, apex: int, toward: int, radii: str = "bondi", without: tuple[int, ...] = (), hydrogens: bool = True) -> DataFrame:
    """(mol_id, cone): degrees of the cone about the axis from one atom to another that holds the spheres of all atoms but the first.
    A sphere around the apex counts as a half-angle of 180."""
    p = counted(atoms, (apex, *without), hydrogens).alias("a").join(pick(atoms, apex, toward), "mol_id")
    d, axis = minus(vector("a"), vector("p0")), minus(vector("p1"), vector("p0"))
    far, r = norm(d), lookup(F.col("symbol"), radii)
    half = F.when(r >= far, 180.0).otherwise(angle(d, axis) + F.degrees(F.asin(r / far)))
    return p.groupBy("mol_id").agg((2 * F.max(half)).alias("cone"))


def octant_volumes(atoms: DataFrame, base: tuple[int, int, int], radius: float = 3.5, scale: float = 1.17, spacing: float = 0.5, radii: str = "bondi") -> DataFrame:
    """(mol_id, octant, fraction): buried volume around the first base atom by octant of its frame; octant adds 1, 2 and 4 for
    positive x, y and z. Grid points lie between the planes, so that each has one octant."""
    f = frame_transform(atoms, base).where(F.col("atom_idx") != base[0]).withColumn("r", lookup(F.col("symbol"), radii) * scale)
    points = grid(radius, spacing, 0.5)
    octant = (points > 0) @ np.array([1, 2, 4])
    size = np.bincount(octant, minlength=8)

    @F.pandas_udf("array<double>")
    def shares(x: pd.Series, y: pd.Series, z: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([np.bincount(octant, covered(points, *v), 8) / size for v in zip(x, y, z, r, strict=True)])

    return spheres(f.where("x IS NOT NULL")).select("mol_id", F.posexplode(shares("x", "y", "z", "r")).alias("octant", "fraction"))


def nearest_atoms(points: DataFrame, atoms: DataFrame) -> DataFrame:
    """points(mol_id, x, y, z) with the atom_idx of the closest atom of the molecule, ties to the smaller."""
    held = atoms.groupBy("mol_id").agg(F.collect_list(F.struct("x", "y", "z", "atom_idx")).alias("held"))
    far = F.transform("held", lambda a: F.struct(((a["x"] - F.col("x")) ** 2 + (a["y"] - F.col("y")) ** 2 + (a["z"] - F.col("z")) ** 2).alias("d"), a["atom_idx"].alias("atom_idx")))
    return points.join(held, "mol_id").select(*points.columns, F.array_min(far)["atom_idx"].alias("atom_idx"))


def surface_sterimol(points: DataFrame, atoms: DataFrame, base: tuple[int, int, int], step: int = 1, bonds: DataFrame | None = None) -> DataFrame:
    """(mol_id, l, b1, b5) of surface points in the frame of three atoms: reach along the axis, least of the four extents over all
    turns of a quarter, and farthest point off the axis. With bonds only the points count whose nearest atom hangs on the second base
    atom as seen from the first."""
    if bonds is not None:
        part = reachable(bonds, base[0], base[1]).select("mol_id", F.col("atom").alias("atom_idx"))
        points = nearest_atoms(points.select("mol_id", "x", "y", "z"), atoms).join(part, ["mol_id", "atom_idx"], "left_semi")
    frame = with_frame(pick(atoms, *base), vector("p0"), vector("p1"), vector("p2")).select("mol_id", "fo", "fx", "fy", "fz")
    p = points.alias("q").join(frame, "mol_id")
    x, y, z = into(axes(), vector("fo"), vector("q"))
    p = p.select("mol_id", x.alias("u"), y.alias("v"), z.alias("w"))
    reach = p.groupBy("mol_id").agg(F.max("v").alias("l"), F.max(F.sqrt(F.col("u") ** 2 + F.col("w") ** 2)).alias("b5"))
    t = F.radians(F.col("degree"))
    a, b = F.col("u") * F.cos(t) + F.col("w") * F.sin(t), F.col("w") * F.cos(t) - F.col("u") * F.sin(t)
    turned = p.withColumn("degree", F.explode(F.sequence(F.lit(0), F.lit(89), F.lit(step)))).groupBy("mol_id", "degree")
    sides = turned.agg(F.least(F.abs(F.max(a)), F.abs(F.min(a)), F.abs(F.max(b)), F.abs(F.min(b))).alias("h"))
    return sides.groupBy("mol_id").agg(F.min("h").alias("b1")).join(reach, "mol_id").select("mol_id", "l", "b1", "b5")
