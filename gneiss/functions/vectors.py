"""Vectors of three Columns: geometry that stays inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def vector(prefix: str) -> Vector:
    """The columns x, y and z of an aliased atom table."""
    return F.col(f"{prefix}.x"), F.col(f"{prefix}.y"), F.col(f"{prefix}.z")


def minus(a: Vector, b: Vector) -> Vector:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def times(a: Vector, k: Column) -> Vector:
    return a[0] * k, a[1] * k, a[2] * k


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vector) -> Vector:
    n = norm(a)
    return tuple(F.when(n > 0, c / n) for c in a)


def angle(a: Vector, b: Vector) -> Column:
    """Degrees between two vectors; null where one has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n)))))


def point(a: Vector) -> Column:
    """A vector as a struct."""
    return F.struct(*[c.alias(n) for c, n in zip(a, "xyz", strict=True)])


def with_frame(df, origin: Vector, toward: Vector, plane: Vector):
    """Adds the structs fo (origin) and fx, fy, fz: y points from the origin toward the second point, x lies in the plane of the third,
    z = x cross y. Each axis is a column of its own, so later axes read it instead of computing it again."""
    df = df.withColumn("fo", point(origin)).withColumn("fy", point(unit(minus(toward, origin))))
    df = df.withColumn("fc", point(minus(plane, vector("fo"))))
    df = df.withColumn("fq", point(minus(vector("fc"), times(vector("fy"), dot(vector("fc"), vector("fy"))))))
    df = df.withColumn("fx", point(unit(vector("fq"))))
    return df.withColumn("fz", point(cross(vector("fx"), vector("fy")))).drop("fc", "fq")


def axes() -> tuple[Vector, Vector, Vector]:
    return vector("fx"), vector("fy"), vector("fz")


def into(frame: tuple[Vector, Vector, Vector], origin: Vector, p: Vector) -> Vector:
    """Coordinates of p in the frame."""
    d = minus(p, origin)
    return dot(d, frame[0]), dot(d, frame[1]), dot(d, frame[2])
