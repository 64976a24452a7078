"""Storage that driver and executors share: where lineage is cut."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_MADE: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir. Where that is unset, a session in one process gets a
    temporary one; on a cluster, whose machines don't share such a folder, that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="gneiss-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/gneiss-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear(spark: SparkSession) -> int:
    """Deletes all folders that this application's shared_dir() has named, and says how many there were. DataFrames that read them,
    such as an operator's result that isn't written yet, can't be read any more."""
    made, jvm = _MADE.pop(spark.sparkContext.applicationId, []), spark.sparkContext._jvm
    found = 0
    for x in made:
        path = jvm.org.apache.hadoop.fs.Path(x)
        found += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return found


def durable(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder and read again: lineage ends here and survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
