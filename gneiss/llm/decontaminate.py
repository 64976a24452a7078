"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

Every item window is a shingle of `width` words. A document contains it only if it contains all of its words, so one necessary
prefix word is enough: the window's rarest in the corpus. Document words join these prefixes; length and position bounds discard
windows that would leave the text; the rest are verified, word by word, against the item-sized window at that place.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import durable, small_batches, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: UTF-8 bytes of item windows up to which they are broadcast; beyond it the joins shuffle. Of their prefix words, as many bytes are
#: broadcast even then, so that other words of documents aren't shuffled; frequent prefix words are a skewed join, which Spark splits.
BROADCAST_BYTES = 32 << 20
#: Windows kept together for one prefix word.
TOGETHER = 64


def words(text):
    """Words of a text column: A-Z lower-cased, no other letter; runs of digits, a-z and what isn't ASCII."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    low = F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))
    return F.array_remove(F.split(low, GAP), "")


def item_windows(items: DataFrame, width: int, text: str, item_id: str) -> DataFrame:
    """(item_id, window): distinct; a window is its words' array. An item of fewer words than `width` is one window."""
    rows = items.select(F.col(f"`{item_id}`").cast("string").alias("item_id"), words(F.col(f"`{text}`")).alias("w")).where("size(w) > 0 and item_id is not null")
    return rows.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0))), lambda s: F.slice("w", s + 1, width))).alias("window")).distinct()


def contamination(docs: DataFrame, items: DataFrame, width: int = 8, least_items: int = 2, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", broadcast_bytes: int = BROADCAST_BYTES, vocabulary_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of docs.

    n_hit counts the words inside any occurrence of an item window, n_items the items with an occurring window; items_sha256 is of
    their ids, sorted as strings and comma-joined. Null or empty texts have no words. Items without words, or with a null id, match
    nothing; rows of one item_id are one item. Rows of one doc_id, or of a null one, get a result each. No items, no hits; an empty
    table gives an empty one. Very long texts are read whole, row by row. Other columns don't matter, whatever their names.
    """
    owned = durable(item_windows(items, width, item_text, item_id))
    windows = owned.select("window").distinct()
    size = owned.agg(F.sum(F.octet_length(F.concat_ws(" ", "item_id", "window")))).first()[0] or 0  # bounds every table joined below
    small = (lambda df: F.broadcast(df)) if size <= broadcast_bytes else (lambda df: df)

    read = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), words(F.col(f"`{text}`")).alias("words"))
    vocabulary = windows.select(F.explode("window").alias("word")).distinct()
    counts = read.select(F.explode("words").alias("word")).join(small(vocabulary), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))

    # each window's rarest word; a window with a word that no document has can't occur
    placed = windows.select("window", F.posexplode("window").alias("place", "word"))
    ranked = placed.join(small(counts), "word", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "place")).alias("least"))
    prefixes = durable(ranked.where("least.n > 0").select("window", F.col("least.word").alias("word"), F.col("least.place").alias("place")))
    most = prefixes.groupBy("word").count().agg(F.max("count")).first()[0] or 1
    slots = math.ceil(most / TOGETHER)
    index = prefixes.groupBy("word", F.pmod(F.xxhash64("window"), F.lit(slots)).alias("slot")).agg(F.collect_list(F.struct("place", "window")).alias("windows")).drop("slot")

    spread = read.select("row", "doc_id", F.size("words").alias("n_words"), "words", F.posexplode_outer("words").alias("at", "word"))
    if size > broadcast_bytes:  # only words that are some window's prefix, with what a window can reach, go through the shuffle
        starts = durable(prefixes.select("word").distinct())
        if (starts.agg(F.sum(F.octet_length("word"))).first()[0] or 0) <= vocabulary_bytes:
            spread = spread.join(F.broadcast(starts.withColumn("starts", F.lit(True))), "word", "left").where("starts or coalesce(at, 0) = 0").drop("starts")
        spread = spread.withColumn("words", F.slice("words", F.greatest(F.col("at") - width + 2, F.lit(1)), F.least(F.col("at"), F.lit(width - 1)) + width)).withColumn("first", F.greatest(F.col("at") - width + 1, F.lit(0)))
    else:
        spread = spread.withColumn("first", F.lit(0))
    met = spread.join(small(index), "word", "left").where("windows is not null or coalesce(at, 0) = 0")

    def occurs(x):
        start = F.col("at") - x["place"]
        return (start >= 0) & (start + F.size(x["window"]) <= F.col("n_words")) & (F.slice("words", F.greatest(start - F.col("first") + 1, F.lit(1)), F.size(x["window"])) == x["window"])

    verified = F.transform(F.filter("windows", occurs), lambda x: F.struct((F.col("at") - x["place"]).alias("start"), x["window"].alias("window")))
    found = met.select("row", "doc_id", "n_words", F.coalesce(verified, F.expr("array()").cast("array<struct<start:int,window:array<string>>>")).alias("found"))
    hits = found.groupBy("row", "doc_id", "n_words").agg(F.flatten(F.collect_list("found")).alias("found"))
    inside = F.array_distinct(F.flatten(F.transform("found", lambda x: F.sequence(x["start"], x["start"] + F.size(x["window"]) - 1))))
    judged = hits.select("row", "doc_id", F.col("n_words").cast("long"), F.size(inside).cast("long").alias("n_hit"), F.explode_outer(F.array_distinct(F.transform("found", lambda x: x["window"]))).alias("window"))
    named = judged.join(small(owned), "window", "left").groupBy("row", "doc_id", "n_words", "n_hit").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    return named.select("doc_id", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "ids"), 256).alias("items_sha256"), (F.size("ids") >= least_items).alias("contaminated"))


def query(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), v AS (
  SELECT DISTINCT item_id, array_to_string(w[s + 1:s + 8], ' ') AS k, least(len(w), 8) AS n FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 7, 1))) AS s FROM b WHERE len(w) > 0)
), t AS (
  SELECT doc_id, w, unnest(range(len(w))) AS s FROM d
), h AS (
  SELECT t.doc_id, t.s, v.n, v.item_id FROM t CROSS JOIN (SELECT DISTINCT n FROM v) z JOIN v ON v.n = z.n AND v.k = array_to_string(t.w[t.s + 1:t.s + z.n], ' ') AND t.s + z.n <= len(t.w)
), c AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY doc_id
), i AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(i.n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""
