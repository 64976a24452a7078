"""Tables around a model run: earlier results, identifiers, dumps of tables, and one feather file a molecule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions.selectors import slug
from gneiss.operators.graph import groups

MEASURES = ("r2", "adj_r2", "q2", "mae", "rmse", "threshold", "mcfadden", "ll")


def load_results(spark: SparkSession, paths: list[str], by: str = "q2", ascending: bool = False) -> DataFrame:
    """Results of runs, CSV (with a header) or Parquet, as one table in order of a measure; columns that a run lacks are null."""
    out = None
    for path in paths:
        one = spark.read.option("header", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)
        one = one.select(*[F.col(f"`{c}`").try_cast("double").alias(c) if c in MEASURES else F.col(f"`{c}`") for c in one.columns])
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no paths")
    return out.orderBy(F.asc_nulls_last(by) if ascending else F.desc_nulls_last(by))


def encoding_of(spark: SparkSession, path: str) -> str:
    """UTF-16 or UTF-8 by a file's byte order mark, else UTF-8 if its bytes are that, else ISO-8859-1."""
    head, body = spark.read.format("binaryFile").load(path).select(F.hex(F.substring("content", 1, 2)), F.try_validate_utf8(F.col("content").cast("string")).isNotNull()).first()
    return "UTF-16" if head in ("FFFE", "FEFF") else "UTF-8" if body else "ISO-8859-1"


def read_identifiers(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """(name, smiles) of a CSV whose columns are found by name, whatever their case; without a name column the first is it. The encoding
    is found if it isn't told."""
    encoding = encoding or encoding_of(spark, path)
    raw = spark.read.option("header", True).option("encoding", encoding).csv(path)
    smiles = next((c for c in raw.columns if "smiles" in c.lower()), None)
    if smiles is None:
        raise ValueError(f"no SMILES column; there are {', '.join(raw.columns)}")
    name = next((c for c in raw.columns if c != smiles and "name" in c.lower()), next((c for c in raw.columns if c != smiles), smiles))
    return raw.select(F.trim(F.col(f"`{name}`")).alias("name"), F.trim(F.col(f"`{smiles}`")).alias("smiles"))


def state(results: DataFrame) -> DataFrame:
    """(n, best_r2, best_q2, all_failed): what a search has come to; a q2 that is null, NaN or infinite is a failed one."""
    good = F.col("q2").isNotNull() & ~F.isnan("q2") & (F.abs("q2") < float("inf"))
    return results.agg(F.count("*").alias("n"), F.max("r2").alias("best_r2"), F.max(F.when(good, F.col("q2"))).alias("best_q2"), F.coalesce(F.bool_and(~good), F.lit(True)).alias("all_failed"))


def with_output(features: DataFrame, outputs: DataFrame, key: str, name: str, strict: bool = False) -> DataFrame:
    """features with a column of another table of the same key; rows without a value get null, or, if strict, are an error that names
    some of them, as is a key that comes twice among the outputs."""
    if strict:
        missing = [r[0] for r in features.select(key).join(outputs.select(key), key, "left_anti").limit(5).collect()]
        twice = [r[0] for r in outputs.groupBy(key).count().where("count > 1").select(key).limit(5).collect()]
        if missing or twice:
            raise ValueError(f"no outputs of {missing}" if missing else f"several outputs of {twice}")
    return features.join(outputs.select(key, name), key, "left")


def write_tables(tables: dict[str, DataFrame], folder: str, form: str = "csv") -> None:
    """Each table in a folder of its name, as CSV with a header or as Parquet."""
    for name, df in tables.items():
        flat = df.select(*[F.to_json(c).alias(c) if form == "csv" and t.startswith(("array", "map", "struct")) else F.col(f"`{c}`") for c, t in df.dtypes])
        flat.write.mode("overwrite").option("header", True).format(form).save(f"{folder.rstrip('/')}/{slug(name)}")


def run_folder(base: str, dataset: str, target: str, tag: str = "", stamp: str = "") -> str:
    """base/dataset_target[_tag][_stamp], in file-safe names."""
    return f"{base.rstrip('/')}/" + "_".join(slug(p) for p in (dataset, target, tag, stamp) if p)


def write_feather(df: DataFrame, folder: str, key: str = "mol_id") -> DataFrame:
    """(key, path, n): one feather file of each molecule's rows, in order of atom_idx if there is one. A task that runs again writes the
    same file; a molecule's rows are one group."""

    kind = dict(df.dtypes)[key]

    def one(rows):
        import pyarrow as pa
        import pyarrow.feather as feather
        from pyarrow import fs

        rows = rows.sort_by("atom_idx") if "atom_idx" in rows.column_names else rows
        system, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        path = f"{root}/{slug(str(rows[key][0].as_py()))}.feather"
        try:
            out = system.open_output_stream(path)
        except FileNotFoundError:  # the first file of the folder
            system.create_dir(root, recursive=True)
            out = system.open_output_stream(path)
        with out:
            feather.write_feather(rows, out)
        return pa.table({key: rows[key].combine_chunks().slice(0, 1), "path": [path], "n": pa.array([rows.num_rows], pa.int64())})

    return groups(df, key).applyInArrow(one, f"{key} {kind}, path string, n long")
