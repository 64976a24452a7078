"""The element table: a small dimension that is always broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Symbol, atomic number, standard weight, covalent radius, van der Waals radius, valence electrons, metal.
ELEMENTS = [
    ("H", 1, 1.008, 0.31, 1.10, 1, False), ("B", 5, 10.81, 0.84, 1.92, 3, False), ("C", 6, 12.011, 0.76, 1.70, 4, False),
    ("N", 7, 14.007, 0.71, 1.55, 5, False), ("O", 8, 15.999, 0.66, 1.52, 6, False), ("F", 9, 18.998, 0.57, 1.47, 7, False),
    ("Si", 14, 28.085, 1.11, 2.10, 4, False), ("P", 15, 30.974, 1.07, 1.80, 5, False), ("S", 16, 32.06, 1.05, 1.80, 6, False),
    ("Cl", 17, 35.45, 1.02, 1.75, 7, False), ("Br", 35, 79.904, 1.20, 1.83, 7, False), ("I", 53, 126.904, 1.39, 1.98, 7, False),
    ("Li", 3, 6.94, 1.28, 1.81, 1, True), ("Na", 11, 22.990, 1.66, 2.27, 1, True), ("Mg", 12, 24.305, 1.41, 1.73, 2, True),
    ("Al", 13, 26.982, 1.21, 1.84, 3, True), ("K", 19, 39.098, 2.03, 2.75, 1, True), ("Ca", 20, 40.078, 1.76, 2.31, 2, True),
    ("Ti", 22, 47.867, 1.60, 2.11, 4, True), ("Mn", 25, 54.938, 1.39, 2.05, 7, True), ("Fe", 26, 55.845, 1.32, 2.04, 8, True),
    ("Co", 27, 58.933, 1.26, 2.00, 9, True), ("Ni", 28, 58.693, 1.24, 1.63, 10, True), ("Cu", 29, 63.546, 1.32, 1.40, 11, True),
    ("Zn", 30, 65.38, 1.22, 1.39, 12, True), ("Ru", 44, 101.07, 1.46, 2.13, 8, True), ("Rh", 45, 102.906, 1.42, 2.10, 9, True),
    ("Pd", 46, 106.42, 1.39, 1.63, 10, True), ("Ag", 47, 107.868, 1.45, 1.72, 11, True), ("Ir", 77, 192.217, 1.41, 2.13, 9, True),
    ("Pt", 78, 195.084, 1.36, 1.75, 10, True), ("Au", 79, 196.967, 1.36, 1.66, 11, True),
]
HALOGENS = ("F", "Cl", "Br", "I")
METALS = tuple(e[0] for e in ELEMENTS if e[6])
FIELDS = ("symbol", "z", "weight", "covalent", "bondi", "valence", "is_metal")


def element_table(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(ELEMENTS, "symbol string, z int, weight double, covalent double, bondi double, valence int, is_metal boolean"))


def lookup(symbol: Column, field: str) -> Column:
    """A property by element as a literal map, so that no join is needed; null for unknown elements."""
    at = FIELDS.index(field)
    return F.create_map(*[F.lit(x) for e in ELEMENTS for x in (e[0], e[at])])[symbol]


def symbol_of(number: Column) -> Column:
    return F.create_map(*[F.lit(x) for e in ELEMENTS for x in (e[1], e[0])])[number]
