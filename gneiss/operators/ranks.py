"""Positions in an order over whole tables, without a task that sees all rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gneiss.storage import durable


def bucket(value, thresholds: list[float]):
    """How many of the sorted thresholds a value reaches, as a balanced tree of comparisons."""

    def tree(low: int, high: int):
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value >= thresholds[middle], tree(middle + 1, high)).otherwise(tree(low, middle))

    return tree(0, len(thresholds))


#: Rows that a part of an order is to have.
PART_ROWS = 200_000


def _parts(df: DataFrame) -> int:
    """Parts of about PART_ROWS rows of a table, so that a task's share doesn't grow with it; 16 at least."""
    return max(16, -(-df.count() // PART_ROWS))


def places_within(df: DataFrame, group: list[str], order: list, name: str = "place", alone: int = 1_000_000) -> DataFrame:
    """df with the place of each row, from 1, in an order of its group.

    Where no group has over `alone` rows, a window does it. Else rows are dealt by range of group and order to parts of PART_ROWS, each
    part numbers its own, and counts of the parts before are added; no task sees a large group. Both give the same places where the
    order is one of single rows."""
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    largest = df.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    if largest <= alone:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    keyed = df.withColumns({f"order {i}": o for i, o in enumerate(order)})
    names = [f"order {i}" for i in range(len(order))]
    p = durable(keyed.repartitionByRange(_parts(df), *[F.col(g) for g in group], *[F.col(f"`{n}`") for n in names]).withColumn("part", F.spark_partition_id()))
    counts = p.groupBy("part", *group).agg(F.count("*").alias("own"))
    before = counts.select("part", *group, (F.sum("own").over(Window.partitionBy(*group).orderBy("part")) - F.col("own")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part", *group).orderBy(*[F.col(f"`{n}`") for n in names]))
    told = before.select(F.col("part").alias("its part"), *[F.col(g).alias(f"its {g}") for g in group], "before")
    same = F.col("part") == F.col("`its part`")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"`its {g}`"))
    return p.withColumn("inside", inside).join(told, same).withColumn(name, (F.col("inside") + F.col("before")).cast("int")).select(*df.columns, name)


def quantiles_within(df: DataFrame, group: list[str], value: str, share: float) -> DataFrame:
    """(group, quantile): the exact quantile of each group, interpolated between neighbours, from places in order."""
    own = df.where(F.col(value).isNotNull())
    n = own.groupBy(*group).agg(F.count("*").alias("n"))
    at = (F.col("n") - 1) * F.lit(share)
    placed = places_within(own.select(*group, value), group, [value]).join(n, group)
    near = placed.where((F.col("place") - 1 == F.floor(at)) | (F.col("place") - 1 == F.ceil(at)))
    low, high = F.min(value), F.max(value)
    return near.groupBy(*group).agg((low + (F.first(at) - F.floor(F.first(at))) * (high - low)).alias("quantile"))


def running(counted: DataFrame, value: str, sums: list[str], parts: int | None = None) -> DataFrame:
    """Adds to a table of one row a value: next, the next larger value, and before_ of each column of sums, its sum over smaller values.

    Values are parted by approximate quantiles, into more parts where there are more; the parts' totals are few rows."""
    parts = parts or max(64, _parts(counted))
    c = durable(counted.withColumn(value, F.col(value).cast("double")))
    cuts = sorted(set(c.approxQuantile(value, [i / parts for i in range(1, parts)], 0.5 / parts)))
    c = c.withColumn("part", bucket(F.col(value), cuts).cast("int"))
    totals = sorted(c.groupBy("part").agg(F.min(value), *[F.sum(F.col(s).cast("double")) for s in sums]).collect())
    firsts = [*[t[1] for t in totals[1:]], None]
    before = [list(accumulate([t[2 + k] for t in totals], initial=0.0)) for k in range(len(sums))]
    rows = [(t[0], firsts[i], *[b[i] for b in before]) for i, t in enumerate(totals)]
    offsets = F.broadcast(c.sparkSession.createDataFrame(rows, "part int, first_after double" + "".join(f", offset_{s} double" for s in sums)))
    w = Window.partitionBy("part").orderBy(value)
    own = c.withColumns({"next": F.lead(value).over(w)} | {f"before_{s}": F.sum(s).over(w) - F.col(s) for s in sums}).join(offsets, "part")
    return own.select(*counted.columns, F.coalesce("next", "first_after").alias("next"), *[(F.col(f"before_{s}") + F.col(f"offset_{s}")).alias(f"before_{s}") for s in sums])


def dealt_places(df: DataFrame, key: str, seed: int, parts: int | None = None) -> DataFrame:
    """Adds place, from 1 to the number of rows, in an order that a seeded hash of the key gives."""
    parts = parts or max(64, _parts(df))
    p = df.withColumn("part", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(parts)).cast("int"))
    counts = sorted(tuple(r) for r in p.groupBy("part").count().collect())
    rows = [(part, before) for (part, _), before in zip(counts, accumulate((n for _, n in counts), initial=0), strict=False)]
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.xxhash64(key, F.lit(seed + 1)), key))
    offsets = F.broadcast(df.sparkSession.createDataFrame(rows, "part int, before long"))
    return p.withColumn("inside", inside).join(offsets, "part").withColumn("place", F.col("inside") + F.col("before")).drop("part", "inside", "before")


def quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float]:
    """Exact quantiles, interpolated between neighbours, from counts of distinct values; no task holds them all."""
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("value")).agg(F.count("*").alias("n"))
    r = durable(running(counted, "value", ["n"]))
    n = r.agg(F.sum("n")).first()[0]
    if not n:
        raise ValueError(f"no values in {column}")
    at = [share * (n - 1) for share in shares]
    wanted = sorted({int(p) for p in at} | {min(int(p) + 1, n - 1) for p in at})
    hits = r.select("value", F.explode(F.filter(F.array(*[F.lit(float(p)) for p in wanted]), lambda p: (p >= F.col("before_n")) & (p < F.col("before_n") + F.col("n")))).alias("p"))
    value = {int(p): v for v, p in hits.collect()}
    return [value[int(p)] + (p - int(p)) * (value[min(int(p) + 1, n - 1)] - value[int(p)]) for p in at]
