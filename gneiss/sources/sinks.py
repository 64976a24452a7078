"""Writers: geometries, inputs, result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT_SCHEMA = "run_id string, combo array<string>, k int, r2 double, adj_r2 double, q2 double, mae double, rmse double, threshold double"


def xyz_text(atoms: DataFrame, comment: str = "") -> DataFrame:
    """(mol_id, value): an XYZ text for each molecule, atoms in order of their number."""
    line = F.format_string("%s %.6f %.6f %.6f", "symbol", "x", "y", "z")
    rows = atoms.groupBy("mol_id").agg(F.array_sort(F.collect_list(F.struct("atom_idx", line.alias("line")))).alias("r"))
    return rows.select("mol_id", F.concat_ws("\n", F.size("r").cast("string"), F.lit(comment), F.concat_ws("\n", "r.line")).alias("value"))


def write_xyz(atoms: DataFrame, path: str, comment: str = "") -> None:
    """A folder for each molecule with its XYZ text."""
    xyz_text(atoms, comment).write.partitionBy("mol_id").mode("overwrite").text(path)


def gaussian_input_text(atoms: DataFrame, functional: str = "B3LYP", basis: str = "6-31G(d)", charge: int = 0, multiplicity: int = 1, title: str = "title", task: str = "opt freq", frozen: tuple[int, ...] = ()) -> DataFrame:
    """(mol_id, value): a route line, title, charge and multiplicity, the geometry, and frozen atoms."""
    line = F.format_string("%s %.6f %.6f %.6f", "symbol", "x", "y", "z")
    rows = atoms.groupBy("mol_id").agg(F.array_sort(F.collect_list(F.struct("atom_idx", line.alias("line")))).alias("r"))
    route = f"# {functional}/{basis} {task}" + (" geom=connectivity" if frozen else "")
    tail = "\n".join(f"X {i} F" for i in frozen)
    return rows.select("mol_id", F.concat(F.lit(f"{route}\n\n{title}\n\n{charge} {multiplicity}\n"), F.concat_ws("\n", "r.line"), F.lit(f"\n\n{tail}\n")).alias("value"))


def append_results(results: DataFrame, path: str, run_id: str) -> None:
    """Model results in a fixed schema, appended as Parquet; missing measures are null."""
    columns = [c.split(" ") for c in RESULT_SCHEMA.split(", ")]
    own = results.withColumn("run_id", F.lit(run_id))
    own.select(*[(F.col(n) if n in own.columns else F.lit(None)).cast(t).alias(n) for n, t in columns]).write.mode("append").parquet(path)


def report(results: DataFrame, least_r2: float, least_q2: float) -> DataFrame:
    """Models over both limits, best first."""
    return results.where((F.col("r2") >= least_r2) & (F.col("q2") >= least_q2)).orderBy(F.desc("q2"), F.desc("r2"))
