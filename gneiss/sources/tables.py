"""Molecular views over the driver's tables: atoms, charges, modes and samples, all deterministic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ATOMS = 21
SYMBOLS = ("C", "H", "N", "O", "Cl")
MODES = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mol_id, atom_idx, symbol, x, y, z): 21 pseudo-atoms of each vector, 1-based."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("mol_id"), "embedding", F.explode(F.sequence(F.lit(1), F.lit(ATOMS))).alias("atom_idx"))
    place = [(F.lit(10.0) * F.get("embedding", (F.col("atom_idx") - 1) * 3 + k).cast("double")).alias(c) for k, c in enumerate("xyz")]
    symbol = F.get(F.array(*[F.lit(s) for s in SYMBOLS]), ((F.col("mol_id") + F.col("atom_idx")) % 5).cast("int")).alias("symbol")
    return e.select("mol_id", "atom_idx", symbol, *place)


def charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mol_id, atom_idx, charge)."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("mol_id"), "embedding", F.explode(F.sequence(F.lit(1), F.lit(ATOMS))).alias("atom_idx"))
    return e.select("mol_id", "atom_idx", F.get("embedding", (F.col("atom_idx") * 7) % 64).cast("double").alias("charge"))


def displacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mol_id, mode_idx, frequency, atom_idx, x, y, z): mode k of a molecule is the vector of the k-th after it, modulo their number."""
    a = atoms(spark, sf_dir)
    n = table(spark, sf_dir, "embeddings").agg(F.count("*").alias("n"))
    moved = a.select(F.col("mol_id").alias("source"), "atom_idx", "x", "y", "z").crossJoin(F.broadcast(n)).withColumn("mode_idx", F.explode(F.sequence(F.lit(1), F.lit(MODES))))
    return moved.select(((F.col("source") - F.col("mode_idx") + F.col("n")) % F.col("n")).alias("mol_id"), "mode_idx", (F.lit(1300.0) + 75.0 * F.col("mode_idx")).alias("frequency"), "atom_idx", "x", "y", "z")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(okey, line, y, f1..f5): a row for each line item."""
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return l.join(p, l.l_partkey == p.p_partkey).select(
        F.col("l_orderkey").alias("okey"), F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("y"),
        F.col("l_quantity").alias("f1"), F.col("l_discount").alias("f2"), F.col("l_tax").alias("f3"), F.col("p_retailprice").alias("f4"), F.col("p_size").cast("double").alias("f5"),
    )


SQL_ATOMS = """atoms AS MATERIALIZED (SELECT vec_id AS mol_id, i AS atom_idx, list_extract(['C','H','N','O','Cl'], CAST((vec_id + i) % 5 + 1 AS INT)) AS symbol,
  10.0::DOUBLE * CAST(embedding[3*(i-1)+1] AS DOUBLE) AS x, 10.0::DOUBLE * CAST(embedding[3*(i-1)+2] AS DOUBLE) AS y, 10.0::DOUBLE * CAST(embedding[3*(i-1)+3] AS DOUBLE) AS z
  FROM embeddings, (SELECT unnest(range(1, 22)) AS i))"""
SQL_CHARGES = """charges AS (SELECT vec_id AS mol_id, i AS atom_idx, CAST(embedding[(i*7) % 64 + 1] AS DOUBLE) AS charge FROM embeddings, (SELECT unnest(range(1, 22)) AS i))"""
SQL_MOVES = """moves AS (SELECT (a.mol_id - k + n) % n AS mol_id, k AS mode_idx, 1300.0::DOUBLE + 75.0::DOUBLE * k AS frequency, a.atom_idx, a.x, a.y, a.z
  FROM atoms a, (SELECT unnest(range(1, 9)) AS k), (SELECT count(*) AS n FROM embeddings))"""
SQL_SAMPLES = """samples AS (SELECT l_orderkey AS okey, l_linenumber AS line, l_extendedprice AS y, l_quantity AS f1, l_discount AS f2, l_tax AS f3, p_retailprice AS f4, CAST(p_size AS DOUBLE) AS f5
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
