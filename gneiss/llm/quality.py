"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network with calibrated probabilities.

A token is a run of letters, digits or other signs. It falls into one of BUCKETS by hash, and every bucket has a sparse random index
vector; a bucket's word vector is the mean index vector of the tokens around its own, over all documents. Beside it a token has its
shape, kind, case and length, whose index vector is one coordinate each, as have tokens that repeat one of the two before them. A document is the mean of its tokens' vectors. The network
is trained by numpy on a bounded sample of labelled rows, and a temperature is fitted on rows that it wasn't trained on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.llm.common import U64, bites, durable, mix, release, row_slices, small_batches, table, texts_of, tidy, word_hashes

BUCKETS, DIM, NONZERO, REACH = 8192, 32, 2, 2
SHAPES = 50
#: Labelled rows, of the smallest hashes, that the network and its temperature are fitted on.
SAMPLE = 40_000
HIDDEN, EPOCHS, BATCH, RATE = 32, 40, 256, 3e-3
ACCEPT = 0.7

#: Classes of bytes: 0 white space, 1 letters (and all beyond ASCII), 2 digits, 3 other signs.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_AT = mix(np.arange(7, 7 + BUCKETS * NONZERO, dtype=U64)).reshape(BUCKETS, NONZERO)
_PLACE, _SIGN = (_AT % U64(DIM)).astype(np.int64), np.where((_AT >> U64(40)) & U64(1), 1.0, -1.0)


def tokens(data: np.ndarray, offsets: np.ndarray):
    """(hash, shape, first): of every token, and the n + 1 token indexes at which rows begin."""
    if not len(data):
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    c = _CLASS[data]
    new = np.ones(len(c), bool)
    new[1:] = c[1:] != c[:-1]
    new[offsets[:-1][offsets[:-1] < len(c)]] = True
    heads = np.flatnonzero(new)
    ends = np.append(heads[1:], len(c))
    real = c[heads] > 0
    starts, ends = heads[real], ends[real]
    kind, size = c[starts].astype(np.int64), ends - starts
    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    caps = upper[ends] - upper[starts]
    case = np.where(caps == 0, 0, np.where((caps == 1) & _UPPER[data[starts]], 1, np.where(caps * 2 > size, 2, 3)))
    shape = (kind - 1) * 16 + case * 4 + np.minimum(size - 1, 12) // 4
    return word_hashes(data, starts, ends), shape, np.searchsorted(starts, offsets)


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes % U64(BUCKETS)).astype(np.int64)


def _body(docs: DataFrame, text: str):
    return F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))


#: Tables that are added up in one task.
FAN = 16


def add_up(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of the compressed double tables of `size` numbers in the column sums, one a row, with a number of its own in the column
    part. They are added up as a tree, FAN at a time, in order of part, so that no task's share grows with their number."""

    def add(t):
        total = np.zeros(size)
        for x in t.sort_by("part").column("sums").to_pylist():
            total += np.frombuffer(pa.decompress(x, 8 * size, "zstd", asbytes=True))
        out = pa.table({"part": pa.array([t.column("part")[0].as_py() // FAN], pa.int64()), "sums": pa.array([pa.compress(total.tobytes(), "zstd", asbytes=True)], pa.binary())})
        release()
        return out

    parts = durable(parts)
    n = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        parts, n = parts.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(add, "part long, sums binary"), -(-n // FAN)
        if n == 1:
            one = parts.first()
            return np.frombuffer(pa.decompress(bytes(one["sums"]), 8 * size, "zstd", asbytes=True)) if one else np.zeros(size)


def context_sums(docs: DataFrame, text: str = "text") -> np.ndarray:
    """(BUCKETS, DIM + 1): the summed index vectors around each bucket's tokens and, last, their number, over all documents.

    Every task sends one table of sums; tables are added up as a tree. Only one, of fixed size, goes to the driver.
    """
    width = DIM + 1

    def count(batches):
        total = np.zeros(BUCKETS * width)
        for b in bites(batches):
            data, offsets = texts_of(b.column(0))
            for i, j in row_slices(offsets):
                hashes, _, first = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                bucket = bucket_of(hashes)
                row = np.repeat(np.arange(j - i), np.diff(first))
                total[DIM::width] += np.bincount(bucket, minlength=BUCKETS)
                for step in range(1, REACH + 1):
                    same = row[step:] == row[:-step]
                    left, right = bucket[:-step][same], bucket[step:][same]
                    for own, other in ((left, right), (right, left)):
                        for k in range(NONZERO):
                            total += np.bincount(own * width + _PLACE[other, k], _SIGN[other, k], BUCKETS * width)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([pa.compress(total.tobytes(), "zstd", asbytes=True)], pa.binary())], ["part", "sums"])

    parts = docs.select(_body(docs, text)).mapInArrow(tidy(count), "part long, sums binary")
    return add_up(parts, BUCKETS * width).reshape(BUCKETS, width)


def centred(sums: np.ndarray) -> np.ndarray:
    """Word vectors: each bucket's mean index vector less that of all tokens; zero for buckets that don't occur."""
    mean = sums[:, :DIM] / np.maximum(sums[:, DIM:], 1)
    weight = sums[:, DIM] / max(1, sums[:, DIM].sum())
    return ((mean - weight @ mean) * (sums[:, DIM:] > 0)).astype(np.float32)


def features(bodies, v: np.ndarray) -> np.ndarray:
    """A row for each text of an Arrow column: its mean word vector, its shares of shapes, and the logarithm of its length."""
    data, offsets = texts_of(bodies)
    out = np.zeros((len(offsets) - 1, DIM + SHAPES + 1), np.float32)
    for i, j in row_slices(offsets):
        hashes, shape, first = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        bucket = bucket_of(hashes)
        size = np.diff(first)
        row = np.repeat(np.arange(j - i), size)
        full = np.flatnonzero(size)
        if len(full):
            out[i + full, :DIM] = np.add.reduceat(v[bucket], first[full], axis=0)
        shapes = [row * SHAPES + shape]
        for step in (1, 2):
            same = (row[step:] == row[:-step]) & (bucket[step:] == bucket[:-step])
            shapes.append(row[step:][same] * SHAPES + SHAPES - step)
        out[i:j, DIM : DIM + SHAPES] = np.bincount(np.concatenate(shapes), minlength=(j - i) * SHAPES).reshape(j - i, SHAPES)
        out[i:j, :-1] /= np.maximum(size, 1)[:, None]
        out[i:j, -1] = np.log1p(size)
    return out


class Network:
    """Standardised inputs, a tanh layer, a logistic output, and a temperature."""

    def __init__(self, inputs: int, hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.rng, self.shift, self.scale, self.temperature = rng, np.zeros(inputs), np.ones(inputs), 1.0
        self.w = [rng.normal(0, inputs**-0.5, (inputs, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]

    def logit(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.w
        return np.tanh((x - self.shift) / self.scale @ a + b) @ c + d[0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> Network:
        self.shift, self.scale = x.mean(0), x.std(0) + 1e-3
        z = (x - self.shift) / self.scale
        first, second, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(epochs):
            for at in np.array_split(self.rng.permutation(len(z)), max(1, len(z) // BATCH)):
                a, b, c, d = self.w
                h = np.tanh(z[at] @ a + b)
                off = (1 / (1 + np.exp(-np.clip(h @ c + d[0], -30, 30))) - y[at]) / len(at)
                back = np.outer(off, c) * (1 - h * h)
                t += 1
                for k, g in enumerate((z[at].T @ back + 1e-4 * a, back.sum(0), h.T @ off + 1e-4 * c, off.sum(keepdims=True))):
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - RATE * first[k] / (1 - 0.9**t) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Network:
        if len(x):
            z = self.logit(x)
            loss = lambda t: np.logaddexp(0, -np.where(y > 0.5, z, -z) / t).mean()
            self.temperature = float(min(np.geomspace(0.25, 8, 60), key=loss))
        return self


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample: int = SAMPLE):
    """(vectors, judge): the word vectors of docs, and what turns feature rows into probabilities of label 1."""
    vectors = centred(context_sums(docs, text))
    known = labels.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("double").alias("y")).where("y in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.orderBy(F.xxhash64("doc_id"), "y").limit(sample)
    given = docs.sparkSession.sparkContext.broadcast(vectors)

    def pool(batches):
        for b in bites(batches):
            made = features(b.column(2), given.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in made], pa.binary())], ["doc_id", "y", "features"])

    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), _body(docs, text).alias("text")).join(F.broadcast(known), "doc_id").select("doc_id", "y", "text")
    learnt = own.mapInArrow(tidy(pool), "doc_id long, y double, features binary").orderBy(F.xxhash64("doc_id"), "y", "features").limit(sample).toArrow()
    y = np.asarray(learnt.column("y"))
    x = np.frombuffer(b"".join(learnt.column("features").to_pylist()), np.float32).reshape(len(y), DIM + SHAPES + 1).astype(float)
    if len(np.unique(y)) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return vectors, lambda x: np.full(len(x), share)
    # rows come in order of a hash, so every fifth is a fair part
    part = np.arange(len(y)) % 5 != 0
    return vectors, Network(x.shape[1]).fit(x[part], y[part]).calibrate(x[~part], y[~part]).probability


def with_score(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample: int = SAMPLE, name: str = "score") -> DataFrame:
    """docs with all columns and the probability of label 1, in one pass over the texts; see score()."""
    vectors, judge = fit(docs, labels, text, doc_id, label, sample)
    given = docs.sparkSession.sparkContext.broadcast(vectors)
    columns = [c for c in docs.columns if c != name]
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    at = columns.index(text)

    def rate(batches):
        for b in bites(batches):
            p = np.round(judge(features(b.column(at).cast(pa.string()), given.value).astype(float)), 12)  # the last digits depend on a row's place
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], [*b.schema.names, "score"])

    rated = plain.mapInArrow(tidy(rate), T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())]))
    return rated.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], F.col("score").alias(name))


def score(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", accept: float = ACCEPT, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs; score is the probability of label 1, predicted is score >= accept.

    It learns from labels(doc_id, `label`) of 0 or 1, at most `sample` of them, never from rows whose crc32(doc_id as text) mod 4 is
    2. Null labels don't count; labels of one doc_id count each; without labels of both kinds every score is the share of ones, or
    one half. Null and empty texts have a score like others. A null doc_id is not held out and isn't learnt from. Rows of one doc_id
    get a row each. Texts are read whole. Other columns don't matter, whatever their names; an empty table gives an empty one.
    """
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    known = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").alias("y"))
    rated = with_score(own, known, label="y", sample=sample)
    return rated.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
