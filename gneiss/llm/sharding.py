"""Sharding by jump consistent hashing (Lamping and Veach, 2014): no ring table, and a new shard takes only its own share."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gneiss.llm.common import U64, durable, small_batches, table

BUCKET_ROWS = 20_000


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key: it jumps ahead at shard counts that a generator seeded with the key draws."""
    key = keys.astype(U64)
    shard, ahead = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        shard[live] = ahead[live]
        key[live] = key[live] * U64(2862933555777941757) + U64(1)
        ahead[live] = ((shard[live] + 1) * (float(1 << 31) / ((key[live] >> U64(33)) + U64(1)).astype(np.float64))).astype(np.int64)
        live = live[ahead[live] < shards]
    return shard


def _shard_of(shards: int):
    @F.pandas_udf("int")
    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64).view(U64), shards))

    return of


def shard(docs: DataFrame, shards: int = 24, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row, by the law `key`.

    The key is the hash of doc_id, so a row's shard depends on its doc_id and the shard count alone; grown_shard is its shard with
    one more. size is the text's UTF-8 bytes plus 8; null text has none and the checksum of nothing, 0. slot counts a shard's rows
    from 0 without gaps, in order of bucket, doc_id and checksum; like rows may take each other's slot. A null doc_id is a key like
    others; rows of one doc_id share its shard. Other columns are ignored, whatever their names; an empty table gives an empty one.
    Slots come from counts by bucket, so no shard is ever sorted in one task.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    key = F.xxhash64(F.col(f"`{doc_id}`").cast("long"))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), key.alias("key"))
    rows = durable(rows.withColumn("shard", _shard_of(shards)("key")).withColumn("grown_shard", _shard_of(shards + 1)("key")))
    buckets = math.ceil(rows.count() / shards / BUCKET_ROWS) or 1
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key", "text_crc32", "size"), F.lit(buckets)))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    base = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("base"))
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")) - 1
    return rows.withColumn("place", place).join(base, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("place")).alias("slot"), "grown_shard")


def query(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
