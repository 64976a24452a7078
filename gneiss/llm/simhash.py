"""SimHash near-dedup: fingerprints by majority bits, links by a pivot distance table, groups by connected components.

A fingerprint's row in the pivot table holds its Hamming distances to fixed reference fingerprints. By the triangle inequality two
fingerprints within r bits differ by r at most in every coordinate, so a pair with a larger difference is discarded unread, and only
survivors are compared bit by bit. The table alone doesn't say which rows to compare without comparing all, so it is parted: bits
fall into r + 3 blocks, r differing bits leave at least three blocks alike, and rows meet only in parts that agree on three blocks.
A part of more than MOST distinct fingerprints is parted again on its other bits, into blocks of four, so that at most 2^(4 r)
distinct fingerprints can meet; no part is capped. Each part yields a spanning forest of its links, never all its pairs.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import U64, bites, durable, fresh, mix, small_batches, table, texts_of, tidy, without
from gneiss.llm.components import components

PIVOTS = 16
MOST = 4096
#: The reference fingerprints: a fixed pseudo-random sequence.
REFERENCES = mix(np.arange(101, 101 + PIVOTS, dtype=U64))


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The majority bits of the XXH64 hashes (seed 42) of all word shingles, repeats included; 0 without words."""
    words = text.lower().split()  # of bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    body = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    k = min(shingle, len(words))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, [body[s:e] for s, e in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], repeat(42)), U64, len(words) - k + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        block = hashes[i : i + 8192]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text_hash, fp): fp is the fingerprint as a signed long. Null text has no words."""

    def make(batches):
        for b in bites(batches):
            data, off = texts_of(b.column(2))
            raw = data.tobytes()
            fp = np.array([fingerprint(raw[s:e], shingle) for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], U64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp, pa.int64())], ["doc_id", "text_hash", "fp"])

    body = F.col(f"`{text}`").cast("string")
    return docs.select(F.col(f"`{doc_id}`").cast("long"), F.xxhash64(body), body).mapInArrow(tidy(make), "doc_id long, text_hash long, fp long")


def _masks(bits: list[int], sizes: list[int], keep: int) -> list[int]:
    """Masks, as signed longs, of all choices of `keep` blocks out of blocks of these sizes."""
    blocks, at = [], 0
    for n in sizes:
        blocks.append(sum(1 << b for b in bits[at : at + n]))
        at += n
    return [x - (1 << 64) if x >> 63 else x for x in (sum(c) for c in combinations(blocks, keep))]


def _forest(fps: np.ndarray, table: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as stars, of the links among one part's fingerprints; table has their pivot distances."""
    n = len(fps)
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order].astype(np.int16)
    root = np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(0, n, 256):
        last = min(i + 256, n)
        end = int(np.searchsorted(table[:, 0], table[last - 1, 0] + radius, "right"))
        a, b = np.nonzero(table[i:last, 0][:, None] + radius >= table[i:end, 0][None, :])
        a, b = a[a < b] + i, b[a < b] + i
        for k in range(1, table.shape[1]):
            near = np.abs(table[a, k] - table[b, k]) <= radius
            a, b = a[near], b[near]
        near = np.bitwise_count(fps[a] ^ fps[b]) <= radius
        a, b = a[near], b[near]
        if len(a):
            label = np.fromiter(map(find, range(n)), np.int64, n)
            x, y = label[a], label[b]
            for p in np.unique((x * n + y)[x != y]).tolist():
                p, q = find(p // n), find(p % n)
                if p != q:
                    root[max(p, q)] = min(p, q)
    label = np.fromiter(map(find, range(n)), np.int64, n)
    away = label != np.arange(n)
    return fps[label[away]], fps[away]


def _parts(rows: DataFrame, radius: int, most: int | None) -> DataFrame:
    """rows(mask, part, fp, pivots) -> (a, b) links, or a null and (mask, part, fp) of the parts with over `most` fingerprints."""

    def emit(kind, a, b, mask):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64(), mask=np.full(len(b), kind)), pa.array(b, pa.int64()), pa.array(mask, pa.int64())], ["a", "b", "mask"])

    def link(batches):
        held, large = None, None
        for batch in _ended(batches):
            if batch is not None:
                new = [np.asarray(batch.column(i)) for i in range(3)] + [np.stack([np.frombuffer(x, np.uint8) for x in batch.column(3).to_pylist()])] if batch.num_rows else None
                if new is None:
                    continue
                if large is not None:  # a part that is already too large: its rows pass on
                    same = (new[0] == large[0]) & (new[1] == large[1])
                    if same.any():
                        yield emit(True, new[1][same], new[2][same], new[0][same])
                    if same.all():
                        continue
                    new, large = [x[~same] for x in new], None
                held = new if held is None else [np.concatenate(p) for p in zip(held, new, strict=True)]
            if held is None:
                continue
            mask, part, fp, pivots = held
            heads = np.flatnonzero(np.concatenate([[True], (mask[1:] != mask[:-1]) | (part[1:] != part[:-1])]))
            ends = np.append(heads[1:], len(mask))
            if batch is not None:
                whole = slice(0, len(heads) - 1)
                s = heads[-1]
                if most is not None and ends[-1] - s > most:
                    large = (mask[s], part[s])
                    yield emit(True, part[s:], fp[s:], mask[s:])
                    held = None
                else:
                    held = [x[s:] for x in held]
                heads, ends = heads[whole], ends[whole]
            a, b = [], []
            for s, e in zip(*(x[ends - heads > 1].tolist() for x in (heads, ends)), strict=True):
                if most is not None and e - s > most:
                    yield emit(True, part[s:e], fp[s:e], mask[s:e])
                    continue
                x, y = _forest(fp[s:e].view(U64), pivots[s:e], radius)
                a.append(x.view(np.int64))
                b.append(y.view(np.int64))
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                yield emit(False, a, b, np.zeros(len(a), np.int64))

    return rows.repartition("mask", "part").sortWithinPartitions("mask", "part", "fp").mapInArrow(tidy(link), "a long, b long, mask long")


def _ended(batches):
    yield from batches
    yield None


def links(prints: DataFrame, radius: int = 3) -> DataFrame:
    """Distinct fingerprints (fp, pivots) -> (a, b): links enough that what reaches what is as with all pairs within `radius` bits."""
    sizes = [64 // (radius + 3) + (i < 64 % (radius + 3)) for i in range(radius + 3)]
    masks = _masks(list(range(64)), sizes, 3)
    rows = prints.select(F.explode(F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("part")) for m in masks])).alias("k"), "fp", "pivots").select("k.mask", "k.part", "fp", "pivots")
    found = durable(_parts(rows, radius, MOST))
    direct, large = found.where("a is not null").select("a", "b"), found.where("a is null")
    if large.isEmpty():
        return direct
    again = None
    for m in masks:
        free = [b for b in range(64) if not (m >> b) & 1]
        finer = _masks(free, [4] * (len(free) // 4) + [len(free) % 4] * bool(len(free) % 4), -(-len(free) // 4) - radius)
        own = large.where(F.col("mask") == m).select(F.col("b").alias("fp"), F.explode(F.array(*[F.lit(x | m).cast("long") for x in finer])).alias("mask"))
        again = own if again is None else again.unionByName(own)
    refined = again.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("part"), "fp").transform(with_pivots)
    return direct.unionByName(_parts(refined.select("mask", "part", "fp", "pivots"), radius, None).select("a", "b"))


def with_pivots(prints: DataFrame) -> DataFrame:
    """Adds the pivot table's row: a byte for each reference fingerprint, the Hamming distance to it."""
    near = [F.lpad(F.hex(F.bit_count(F.col("fp").bitwiseXOR(F.lit(int(np.int64(r.view(np.int64))))))), 2, "0") for r in REFERENCES]
    return prints.withColumn("pivots", F.unhex(F.concat(*near)))


def clusters(docs: DataFrame, shingle: int, radius: int, text: str, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, fp) of every row, and (fp, root, component_id) of every fingerprint."""
    marked = durable(fingerprints(docs, shingle, text, doc_id))
    nodes = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(links(nodes.select("fp").transform(with_pivots), radius))
    lows = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = lows.groupBy("root").agg(F.min("low").alias("component_id"))
    return marked, lows.select("fp", "root").join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; fingerprints within `radius` bits link, and component_id is the smallest
    doc_id that is reached.

    Null and empty texts, and those of white space, have fingerprint zero and link like others. Rows of one doc_id each get a row. A
    null doc_id counts as no id: it stays, and a component of nulls only has a null id. Very long texts are hashed whole in blocks.
    Other columns, whatever their names, don't matter. An empty table gives an empty table. Equal fingerprints meet once, as one
    node, so copies cost no pairs.
    """
    marked, told = clusters(docs, shingle, radius, text, doc_id)
    return marked.join(told, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs, all columns, with one row of each component: that of the smallest doc_id (a null one last), and of the smallest text
    hash among rows of that id. Only keys of rows to drop meet the texts; a short list of them is broadcast.

    Null and empty texts, and those of white space, are alike: one of them all stays. Very long texts are hashed whole. Rows that are
    alike in doc_id and text are one, whatever their other columns. Columns pass through under any name. An empty table gives an
    empty one."""
    marked, told = clusters(docs, shingle, radius, text, doc_id)
    ranked = marked.join(told, "fp").select("root", "doc_id", "text_hash")
    first = ranked.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("k")).select("root", "k.doc_id", "k.text_hash")
    same = ["root", "doc_id", "text_hash"]
    drop = ranked.join(first.withColumn("first", F.lit(True)), [ranked[c].eqNullSafe(first[c]) for c in same], "left").where("first is null").select(ranked["doc_id"], ranked["text_hash"]).distinct()
    key = fresh(docs, "hash of the text")
    keyed = docs.withColumn(key, F.xxhash64(F.col(f"`{text}`").cast("string")))
    kept = without(keyed, drop.select(F.col("doc_id").alias(doc_id), F.col("text_hash").alias(key)))
    twins = durable(marked.groupBy("doc_id", "text_hash").count().where("count > 1").select(F.col("doc_id").alias(doc_id), F.col("text_hash").alias(key)))
    if not twins.isEmpty():  # like rows of one doc_id
        like = [kept[f"`{c}`"].eqNullSafe(twins[f"`{c}`"]) for c in (doc_id, key)]
        kept = without(kept, twins).unionByName(kept.join(twins, like, "left_semi").dropDuplicates([doc_id, key]))
    return kept.drop(key)


def query(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
