"""Near-duplicates of a Jaccard similarity on word shingles, as SimHash candidates that are verified exactly.

Texts that share four fifths of their shingles differ in about a seventh of their SimHash bits, too many for a few agreeing blocks of
one fingerprint. So each text gets a wide fingerprint: TABLES parts of KEY_BITS independent bits. Two such texts agree on a whole part
with a probability of 0.07, and on one of 64 with 0.99. That holds for long texts: of few shingles, ties in the votes push bits apart,
so pairs of which one has up to SHORT meet exactly, on the rarest shingles of which two similar texts must share one. Others meet in
parts they agree on; there the pivot table of the first 64 bits discards by coordinate differences, the bits themselves by RADIUS, and
the numbers of shingles by the similarity. All near pairs of a part are verified on the whole sets of shingles; a pair that agrees on a part of the first 64 bits counts only there, not again in each
later part that it agrees on, as copies do on most.

Texts of one template are near, but most aren't similar. So the rows of a part with over LIGHT near pairs a row get a sketch of their
set, the parities of the numbers of shingles in SKETCH_BITS buckets: two sets differ in at least as many shingles as their sketches do
in bits, so a pair with too many is discarded without a loss, before it is joined with sets. Where what is left is over SMALL a row,
links to leaders (rows unlike all leaders before them) are verified first, and then all pairs left of rows that no verified link
connects yet: the others can't change what is connected, so copies of one text don't cost the square of their number, and no pair that
counts is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import U64, bites, durable, fresh, grams, mix, row_slices, texts_of, tidy, without, word_hashes, words_of
from gneiss.llm.components import components
from gneiss.llm.simhash import REFERENCES, _ended

TABLES, KEY_BITS, RADIUS, EARLY_RADIUS = 64, 16, 18, 20
#: Texts of up to this many shingles meet on shingles.
SHORT = 16
#: The first part number beyond the parts of the first 64 bits.
LATE = 64 // KEY_BITS << KEY_BITS
#: Shingles whose bits are laid out at once.
SLICE = 4080
#: Near pairs a row up to which a part needs no sketches, and those left by sketches up to which all of a part's are verified at once.
LIGHT, SMALL = 1, 16
SKETCH_BITS = 4096
#: Rows of parts that are compared many parts at a time.
FEW = 32
_SEEDS = mix(np.arange(501, 501 + TABLES * KEY_BITS // 64, dtype=U64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(column, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of k lower-cased words; a shorter text is one run."""
    data, offsets = texts_of(column)
    out: list[np.ndarray] = []
    for i, j in row_slices(offsets):
        part, off = _LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        starts, ends, first = words_of(part, off)
        h = word_hashes(part, starts, ends)
        g = grams(h, k)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            out.append(np.unique(g[a : b - k + 1]) if b - a >= k else grams(h[a:b], b - a) if b > a else np.zeros(0, U64))
    return out


def wide_fingerprint(shingles: np.ndarray) -> bytes:
    """Majority bits of TABLES * KEY_BITS independent hash bits of the shingles."""
    ones = np.zeros(TABLES * KEY_BITS, np.int64)
    for j in range(0, len(shingles), SLICE):
        s = shingles[j : j + SLICE]
        bits = mix(mix(s)[:, None] ^ _SEEDS[None, :]).view(np.uint8).reshape(len(s), 8 * len(_SEEDS))
        for i in range(0, len(s), 255):
            ones += np.unpackbits(bits[i : i + 255], axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(shingles)).tobytes()


def sketch(shingles: np.ndarray) -> bytes:
    """A bit for each of SKETCH_BITS even ranges of hashes: whether an odd number of the shingles is there."""
    at = (shingles >> U64(64 - SKETCH_BITS.bit_length() + 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=SKETCH_BITS).astype(np.uint8) & 1).tobytes()


def _prints(docs: DataFrame, k: int, similarity: float, text: str, doc_id: str) -> DataFrame:
    most = int(SHORT / similarity + 1e-9)

    def make(batches):
        for b in bites(batches):
            sets = shingle_sets(b.column(2), k)
            few = pa.array([s.view(np.int64) if len(s) <= most else None for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int32()), pa.array([wide_fingerprint(s) for s in sets], pa.binary()), few], ["doc_id", "text_hash", "n", "wide", "few"])

    body = F.col(f"`{text}`").cast("string")
    return docs.select(F.col(f"`{doc_id}`").cast("long"), F.xxhash64(body), body).mapInArrow(tidy(make), "doc_id long, text_hash long, n int, wide binary, few array<long>")


def _met(fa: np.ndarray, fb: np.ndarray) -> np.ndarray:
    """Whether pairs agree on a whole part of the first 64 bits: they meet there, and needn't again in later parts."""
    x = fa ^ fb
    out = np.zeros(len(x), bool)
    for k in range(0, 64, KEY_BITS):
        out |= x >> U64(k) & U64((1 << KEY_BITS) - 1) == 0
    return out


def _near(fa, na, fb, nb, similarity: float, radius=RADIUS) -> np.ndarray:
    """Whether pairs may be similar, by sizes, pivots and bits."""
    ok = np.minimum(na, nb) >= similarity * np.maximum(na, nb)
    for r in REFERENCES[:2]:
        ok &= np.abs(np.bitwise_count(fa ^ r).astype(np.int16) - np.bitwise_count(fb ^ r)) <= radius
    return ok & (np.bitwise_count(fa ^ fb) <= radius)


def _radius(part):
    """Of a part; early parts alone answer for the pairs that meet there, so theirs is wider."""
    return np.where(part < LATE, EARLY_RADIUS, RADIUS)


def _sketches(column: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(column.tolist()), U64).reshape(len(column), -1)


def _may(bits: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the sketches of places x and y differ in as few bits as sets of this similarity may differ in shingles."""
    out, most = np.zeros(len(x), bool), (1 - similarity) / (1 + similarity)
    for i in range(0, len(x), 8192):
        a, b = x[i : i + 8192], y[i : i + 8192]
        out[i : i + 8192] = np.bitwise_count(bits[a] ^ bits[b]).sum(1, dtype=np.int64) <= most * (n[a].astype(np.int64) + n[b]) + 1e-6
    return out


def _to_leaders(fp: np.ndarray, n: np.ndarray, bits: np.ndarray, similarity: float):
    """Places (i, j): each row of one part with the first leader that it may be similar to; a row that has none is a leader."""

    def close(own, lead):
        near = _near(fp[own][:, None], n[own][:, None], fp[None, lead], n[None, lead], similarity)
        x, y = np.nonzero(near)
        near[x, y] = _may(bits, n, own[x], lead[y], similarity)
        return near

    leaders, a, b = np.zeros(0, np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, len(fp), 256):
        own, new = np.arange(i, min(i + 256, len(fp))), []
        for j in range(0, len(leaders), 4096):
            near = close(own, leaders[j : j + 4096])
            hit = near.any(1)
            a.append(leaders[j + near[hit].argmax(1)])
            b.append(own[hit])
            own = own[~hit]
        while len(own):
            new.append(own[0])
            hit = close(own[1:], own[:1])[:, 0]
            a.append(np.full(hit.sum(), own[0]))
            b.append(own[1:][hit])
            own = own[1:][~hit]
        leaders = np.append(leaders, np.array(new, np.int64))
    return np.concatenate(a), np.concatenate(b)


def _whole_parts(batches):
    """Columns of rows in part order, as arrays that end where a part ends."""
    held: list[list[np.ndarray]] = []
    join = lambda x: [np.concatenate(c) for c in zip(*x, strict=True)]
    for batch in _ended(batches):
        if batch is None:
            if held:
                yield join(held)
        elif batch.num_rows:
            cols = [np.asarray(c) for c in batch.columns]
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            if held and (last or held[-1][0][0] != cols[0][0]):
                yield join([*held, [c[:last] for c in cols]])
                held = []
            elif last:
                yield [c[:last] for c in cols]
            held.append([c[last:] for c in cols])


def _near_pairs(fp: np.ndarray, n: np.ndarray, similarity: float, root: np.ndarray | None = None, part: int = -1, bits: np.ndarray | None = None):
    """Blocks of places (i, j) of all near pairs of one part; with root, in its order, of those whose roots differ; of a late part those
    that haven't met in an early one; with bits, the sketches, of those that may be similar by them."""
    for i in range(0, len(fp), 256):
        own = slice(i, min(i + 256, len(fp)))
        start = i if root is None else int(np.searchsorted(root, root[i], "right"))
        for j in range(start, len(fp), 4096):
            to = slice(j, j + 4096)
            near = _near(fp[own][:, None], n[own][:, None], fp[None, to], n[None, to], similarity, _radius(part))
            x, y = np.nonzero(near)
            x, y = x + i, y + j
            apart = x < y if root is None else (x < y) & (root[x] != root[y])
            if part >= LATE:
                apart &= ~_met(fp[x], fp[y])
            x, y = x[apart], y[apart]
            if bits is not None:
                left = _may(bits, n, x, y, similarity)
                x, y = x[left], y[left]
            if len(x):
                yield x, y


def _spread(nodes: DataFrame) -> DataFrame:
    """nodes(node, n, wide) -> (part, node, fp, n): a row for each table. fp has 64 bits of which none is the part's own."""

    def spread(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            wide = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            key = wide.reshape(batch.num_rows, TABLES, KEY_BITS // 8).astype(np.int64)
            key = (np.arange(TABLES) << KEY_BITS) + (key[:, :, 0] << 8) + key[:, :, 1]
            bits = np.ascontiguousarray(wide[:, :16]).view(np.int64)
            fp = np.where(np.arange(TABLES) < 64 // KEY_BITS, bits[:, 1:], bits[:, :1])
            node, n = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for i in range(0, batch.num_rows, 2000):
                rep = lambda x: np.repeat(x[i : i + 2000], TABLES)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(key[i : i + 2000].ravel()), pa.array(rep(node)), pa.array(fp[i : i + 2000].ravel()), pa.array(rep(n))], ["part", "node", "fp", "n"])

    return nodes.select("node", "n", "wide").mapInArrow(tidy(spread), "part long, node long, fp long, n int")


def _spread_short(nodes: DataFrame, similarity: float) -> DataFrame:
    """nodes(node, n, few) -> (part, node, fp, n): a row for each shingle of a short text's prefix, the rarest first. Of two similar
    texts' prefixes at least one shingle is the same. fp is 0, as bits don't count here. Parts of table keys aren't negative."""
    each = nodes.where("few is not null").select("node", "n", F.explode("few").alias("shingle"))
    common = each.groupBy("shingle").count()
    sorted_ = each.join(common, "shingle").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("count", "shingle"))).alias("all"))
    length = F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9).cast("int") + 1
    first = sorted_.select("node", "n", F.explode(F.slice("all", F.lit(1), length)).alias("s")).where("s.count > 1")
    return first.select((F.lit(-1).cast("long") - F.shiftrightunsigned("s.shingle", 1)).alias("part"), "node", F.lit(0).cast("long").alias("fp"), "n")


def _emit(a, b, part=None, fp=None, n=None):
    """Pairs (a, b), or rows b of parts that are to be worked on again."""
    rest = [pa.nulls(len(a), t) for t in (pa.int64(), pa.int64(), pa.int32())] if part is None else [pa.array(x) for x in (part, fp, n)]
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) if part is None else pa.nulls(len(b), pa.int64()), pa.array(b, pa.int64()), *rest], ["a", "b", "part", "fp", "n"])


_EMITTED = "a long, b long, part long, fp long, n int"


def _both(met: DataFrame) -> tuple[DataFrame, DataFrame]:
    return met.where("a is not null").select("a", "b").distinct(), met.where("a is null").select("part", F.col("b").alias("node"), "fp", "n")


def _ordered(a, b):
    return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)


def _candidates(nodes: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """nodes(node, n, wide, few) -> (a, b), distinct near pairs, and (part, node, fp, n) of the dense parts, whose pairs aren't among them."""
    most = min(LIGHT, SMALL)

    def meet(batches):
        for part, node, fp, n in _whole_parts(batches):
            fp = fp.view(U64)
            heads = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            ends, found = np.append(heads[1:], len(part)), []
            size, own = ends - heads, np.repeat(np.arange(len(heads)), ends - heads)
            inner, firsts, seconds = size[own] <= FEW, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for d in range(1, FEW):
                i = np.flatnonzero(inner[:-d] & (part[:-d] == part[d:])) if d < len(part) else np.zeros(0, np.int64)
                if not len(i):
                    break
                i = i[_near(fp[i], n[i], fp[i + d], n[i + d], similarity, _radius(part[i]))]
                i = i[(part[i] < LATE) | ~_met(fp[i], fp[i + d])]
                firsts.append(i)
                seconds.append(i + d)
            x, y = np.concatenate(firsts), np.concatenate(seconds)
            dense = np.bincount(own[x], minlength=len(heads)) > most * size
            found.append((node[x[~dense[own[x]]]], node[y[~dense[own[x]]]]))
            for k in np.flatnonzero(size > FEW).tolist():
                s, e, pairs, count = heads[k], ends[k], [], 0
                for x, y in _near_pairs(fp[s:e], n[s:e], similarity, part=int(part[s])):
                    pairs.append((node[s + x], node[s + y]))
                    count += len(x)
                    if count > most * (e - s):
                        dense[k] = True
                        break
                else:
                    found += pairs
            if dense.any():
                again = dense[own]
                yield _emit(node[again], node[again], part[again], fp[again].view(np.int64), n[again])
            pairs = _ordered(*(np.concatenate(x) for x in zip(*found, strict=True)))
            if pairs.shape[1]:
                yield _emit(pairs[0], pairs[1])

    return _both(durable(_spread(nodes).unionByName(_spread_short(nodes, similarity)).repartition("part").sortWithinPartitions("part", F.xxhash64("node", "part")).mapInArrow(tidy(meet), _EMITTED)))


def _sketched(dense: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """dense(part, node, fp, n, sketch) -> (a, b), distinct pairs that may be similar by their sketches, and (part, node, fp, n) of the
    parts of which that is the leaders' only."""
    most = SMALL

    def meet(batches):
        for part, node, fp, n, column in _whole_parts(batches):
            heads = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            for s, e in zip(heads.tolist(), [*heads[1:].tolist(), len(part)], strict=True):
                own, bits, pairs, count = fp[s:e].view(U64), _sketches(column[s:e]), [], 0
                for x, y in _near_pairs(own, n[s:e], similarity, part=int(part[s]), bits=bits):
                    pairs.append((x, y))
                    count += len(x)
                    if count > most * (e - s):
                        pairs = [_to_leaders(own, n[s:e], bits, similarity)]
                        yield _emit(node[s:e], node[s:e], part[s:e], fp[s:e], n[s:e])
                        break
                if pairs:
                    x, y = (np.concatenate(x) for x in zip(*pairs, strict=True))
                    yield _emit(*_ordered(node[s + x], node[s + y]))

    return _both(durable(dense.repartition("part").sortWithinPartitions("part", F.xxhash64("node", "part")).mapInArrow(tidy(meet), _EMITTED)))


def _rest(large: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """large(part, node, fp, n, sketch) -> (a, b), distinct: all pairs that may be similar and whose roots differ."""

    def meet(batches):
        for part, root, node, fp, n, column in _whole_parts(batches):
            heads = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            for s, e in zip(heads.tolist(), [*heads[1:].tolist(), len(part)], strict=True):
                for x, y in _near_pairs(fp[s:e].view(U64), n[s:e], similarity, root[s:e], int(part[s]), _sketches(column[s:e])):
                    a, b = node[s + x], node[s + y]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    rows = large.join(roots, "node", "left").select("part", F.coalesce("root", "node").alias("root"), "node", "fp", "n", "sketch")
    return rows.repartition("part").sortWithinPartitions("part", "root").mapInArrow(tidy(meet), "a long, b long").distinct()


def keep_unlike(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs, all columns, with one row of each group that verified links of at least `similarity` connect: that of the smallest doc_id
    (a null one last). Texts without words are unlike all others; of texts with like sets of shingles one stays. Rows that are alike in
    doc_id and text stay or go together. Very long texts count with all their shingles. Columns pass through under any name. An empty
    table gives an empty one. Like texts should be dropped before, as keep_one does."""
    prints = durable(_prints(docs, shingle, similarity, text, doc_id)).where("n > 0")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    nodes = durable(prints.groupBy("wide", "n").agg(F.min(order).alias("first"), F.min("few").alias("few")).select(F.xxhash64("wide", "n").alias("node"), "wide", "n", "first", "few"))
    pairs, dense = _candidates(nodes, similarity)
    pairs = durable(pairs)
    key = fresh(docs, "hash of the text")
    keyed = docs.withColumn(key, F.xxhash64(F.col(f"`{text}`").cast("string")))
    named = durable(nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).union(dense.select("node")).distinct(), "node").select("node", F.col("first.doc_id").alias(doc_id), F.col("first.text_hash").alias(key)))
    wanted = without(keyed, named.select(doc_id, key), "left_semi").select(F.col(f"`{doc_id}`").alias(doc_id), key, F.col(f"`{text}`").cast("string").alias("body"))

    def sets(batches):
        for b in bites(batches):
            made = shingle_sets(b.column(2), shingle)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([s.view(np.int64) for s in made], pa.list_(pa.int64())), pa.array([sketch(s) for s in made], pa.binary())], ["doc_id", "text_hash", "shingles", "sketch"])

    held = wanted.select(F.col(doc_id).cast("long"), key, "body").mapInArrow(tidy(sets), "doc_id long, text_hash long, shingles array<long>, sketch binary").dropDuplicates(["doc_id", "text_hash"])
    by_node = durable(named.join(held, named[f"`{doc_id}`"].eqNullSafe(held["doc_id"]) & (named[key] == held["text_hash"])).select("node", "shingles", "sketch"))

    def verified(some):
        both = some.join(by_node.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(by_node.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
        shared = F.size(F.array_intersect("sa", "sb"))
        return durable(both.where(shared >= similarity * (F.size("sa") + F.size("sb") - shared)).select("a", "b"))

    large, with_sketches = None, lambda rows: rows.join(by_node.select("node", "sketch"), "node").select("part", "node", "fp", "n", "sketch")
    if not dense.isEmpty():
        more, large = _sketched(with_sketches(dense), similarity)
        pairs = pairs.union(more).distinct()
    links = verified(pairs)
    roots = components(links)
    if large is not None and not large.isEmpty():
        roots = components(links.union(verified(_rest(with_sketches(large), roots, similarity))))
    rooted = nodes.join(roots, "node", "left").select("wide", "n", "first", F.coalesce("root", "node").alias("root"))
    best = rooted.groupBy("root").agg(F.min("first").alias("best"))
    kept = rooted.select("wide", "n", "root").join(best, "root").select("wide", "n", "best")
    drop = prints.join(kept, ["wide", "n"]).where(~(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))))
    return without(keyed, drop.select(F.col("doc_id").alias(doc_id), F.col("text_hash").alias(key)).distinct()).drop(key)
