"""LM scoring by masked pseudo-likelihood.

Every token is masked in turn and predicted from WINDOW tokens on either side; a document's score is the sum of these conditional
log-probabilities. The vocabulary is counted over all documents, token by token, and grows with them. The most frequent tokens are
symbols of their own; the others share RARE symbols by hash, and a token's probability in such a symbol is its share of the symbol's
count. Symbols are sorted by frequency into CLASSES classes. The network, one tanh layer over the neighbours' embeddings, weighted by
place, predicts the class, and then the symbol among its class, from the same layer.

Documents are dealt by hash to chunks of bounded bytes, which don't depend on how the input is split. Every chunk trains a copy of the
network on all of its windows, in order of the documents; the copies are averaged by their numbers of windows. Scores are computed in
tiles of one size and added up in fixed point, so like texts have like scores wherever they stand.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import U64, durable, release, row_slices, small_batches, table, texts_of
from gneiss.llm.quality import add_up, tokens

CLASSES, SIZE, WINDOW, HIDDEN = 32, 64, 2, 24
SYMBOLS, RARE = CLASSES * SIZE, 512
FREQUENT = SYMBOLS - RARE
#: Stands for what lies beyond a document's ends.
EDGE = SYMBOLS
BATCH, RATE = 8192, 0.1
TILE = 8192
PLACE_BITS = 16
CHUNK_BYTES = 16 << 20
#: Hashes that a bucket counts.
BUCKET_TOKENS = 300_000
SLICE = 1 << 19
#: Scores are sums of multiples of this.
STEP = 2.0**-20


class Vocabulary:
    """Symbols of token hashes: frequent tokens by rank, others by hash."""

    def __init__(self, frequent: np.ndarray, counts: np.ndarray, rare: np.ndarray):
        """frequent: hashes, the most frequent first, with their counts; rare: the counts of the RARE symbols."""
        self.hashes, self.rare = frequent, np.maximum(rare, 1)
        self.counts = np.concatenate([counts, np.zeros(FREQUENT - len(counts), np.int64), rare])
        # a table by the first bits of the hash; of tokens that share a place the more frequent has it, the others are looked for
        place = (frequent >> U64(64 - PLACE_BITS)).astype(np.int64)
        self.table = np.full(1 << PLACE_BITS, -1, np.int32)
        self.table[place[::-1]] = np.arange(len(frequent), dtype=np.int32)[::-1]
        second = np.flatnonzero(self.table[place] != np.arange(len(frequent)))
        self.second = second[np.argsort(frequent[second])].astype(np.int32)
        self.crowded = np.zeros(1 << PLACE_BITS, bool)
        self.crowded[place[second]] = True

    def symbols(self, h: np.ndarray) -> np.ndarray:
        place = (h >> U64(64 - PLACE_BITS)).astype(np.int32)
        out = self.table[place]
        if len(self.hashes):
            own = self.hashes[out] == h  # place -1 is the last token's, which has another hash or is it
        else:
            own = np.zeros(len(h), bool)
        if len(self.second):
            more = np.flatnonzero(self.crowded[place] & ~own)
            keys = self.hashes[self.second]
            at = np.minimum(np.searchsorted(keys, h[more]), len(keys) - 1)
            hit = keys[at] == h[more]
            out[more[hit]] = self.second[at[hit]]
            own[more[hit]] = True
        rest = np.flatnonzero(~own)
        out[rest] = FREQUENT + (h[rest] % U64(RARE)).astype(np.int32)
        return out


class Model:
    """embed: of symbols and the edge; place: the weights of the window's places; then the layers of classes and of their symbols."""

    def __init__(self, counts: np.ndarray | None = None, seed: int = 3):
        rng, f = np.random.default_rng(seed), np.float32
        self.embed = rng.normal(0, 0.3, (SYMBOLS + 1, HIDDEN)).astype(f)
        self.place = (1 + rng.normal(0, 0.3, (2 * WINDOW, HIDDEN))).astype(f)
        self.hidden = np.zeros(HIDDEN, f)
        self.top, self.low = rng.normal(0, 0.1, (HIDDEN, CLASSES)).astype(f), rng.normal(0, 0.1, (CLASSES, HIDDEN, SIZE)).astype(f)
        seen = np.log(np.maximum(np.zeros(SYMBOLS) if counts is None else counts, 0.1)).reshape(CLASSES, SIZE)
        most = seen.max(1, keepdims=True)
        whole = most[:, 0] + np.log(np.exp(seen - most).sum(1))
        self.top_bias, self.low_bias = (whole - whole.max()).astype(f), (seen - whole[:, None]).astype(f)
        self._seen: dict[str, np.ndarray] | None = None

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.place, self.hidden, self.top, self.low, self.top_bias, self.low_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()]).astype(float)

    @staticmethod
    def of(flat: np.ndarray) -> Model:
        out, at = Model(), 0
        for p in out.parts():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size
        return out

    def placed(self) -> np.ndarray:
        """The embeddings as each place weighs them: few rows, where a batch has many."""
        return self.embed * self.place[:, None]

    def layer(self, around: np.ndarray, placed: np.ndarray) -> np.ndarray:
        h = np.take(placed[0], around[:, 0], 0)
        for k in range(1, 2 * WINDOW):
            h += np.take(placed[k], around[:, k], 0)
        h += self.hidden
        return np.tanh(h, out=h)

    def _begin(self) -> None:
        """What AdaGrad remembers: of embeddings by row, of layers by column."""
        f = np.float32
        self._seen = {"embed": np.zeros((SYMBOLS + 1, 1), f), "place": np.zeros_like(self.place), "hidden": np.zeros(HIDDEN, f), "top": np.zeros((1, CLASSES), f), "low": np.zeros((CLASSES, 1, SIZE), f), "top_bias": np.zeros(CLASSES, f), "low_bias": np.zeros((CLASSES, SIZE), f)}

    def _move(self, name: str, at, gradient: np.ndarray, axis: int | None = None) -> None:
        """A step of AdaGrad, with one rate for what lies along `axis`."""
        seen = self._seen[name]
        square = gradient * gradient
        now = seen[at] + (square if axis is None else np.add.reduce(square, axis, keepdims=True) / square.shape[axis])
        seen[at] = now
        now += 1e-8
        np.sqrt(now, out=now)
        np.divide(RATE, now, out=now)
        getattr(self, name)[at] -= gradient * now

    def train(self, around: np.ndarray, target: np.ndarray) -> None:
        if self._seen is None:
            self._begin()
        for i in range(0, len(target), BATCH):
            a, t = around[i : i + BATCH], target[i : i + BATCH]
            n = len(t)
            kind = (t // SIZE).astype(np.int16)
            order = np.argsort(kind, kind="stable")
            a, t, kind = np.take(a, order, 0), t[order], kind[order]
            h = self.layer(a, self.placed())
            z = _softmax(h @ self.top + self.top_bias)
            z[np.arange(n), kind] -= 1
            back = z @ self.top.T
            self._move("top", slice(None), h.T @ z, 0)
            self._move("top_bias", slice(None), np.ones(n, np.float32) @ z)
            heads = np.flatnonzero(np.diff(kind, prepend=-1))
            for s, e in zip(heads.tolist(), [*heads[1:].tolist(), n], strict=True):
                c, own = kind[s], h[s:e]
                z = _softmax(own @ self.low[c] + self.low_bias[c])
                z[np.arange(e - s), t[s:e] % SIZE] -= 1
                back[s:e] += z @ self.low[c].T
                self._move("low", c, own.T @ z, 0)
                self._move("low_bias", c, np.ones(e - s, np.float32) @ z)
            back *= 1 - h * h
            self._move("hidden", slice(None), back.sum(0))
            turn, move, met = np.zeros((2 * WINDOW, HIDDEN), np.float32), np.zeros_like(self.embed), np.zeros(SYMBOLS + 1, bool)
            for k in range(2 * WINDOW):  # sums by symbol serve the embeddings and the place
                where = a[:, k].astype(np.int16)  # symbols fit, and 16 bits sort fast
                order = np.argsort(where, kind="stable")
                where = where[order]
                heads = np.flatnonzero(np.diff(where, prepend=-1))
                own, sums = where[heads], np.add.reduceat(np.take(back, order, 0), heads, axis=0)
                turn[k] = np.einsum("nh,nh->h", sums, np.take(self.embed, own, 0))
                move[own] += sums * self.place[k]
                met[own] = True
            own = np.flatnonzero(met)
            self._move("embed", own, move[own], 1)
            self._move("place", slice(None), turn)

    def log_probability(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of each target symbol, in tiles of TILE rows and, in a class, of multiples of 16, so that no value depends on its place."""
        out, placed = np.zeros(len(target)), self.placed()
        for i in range(0, len(target), TILE):
            t = target[i : i + TILE]
            a = np.full((TILE, 2 * WINDOW), EDGE, np.int32)
            a[: len(t)] = around[i : i + TILE]
            h = self.layer(a, placed)
            kind = (t // SIZE).astype(np.int16)
            own = _log_share(h @ self.top + self.top_bias, len(t), kind)
            order = np.argsort(kind, kind="stable")
            heads = np.flatnonzero(np.diff(kind[order], prepend=-1))
            for s, e in zip(heads.tolist(), [*heads[1:].tolist(), len(t)], strict=True):
                at, c = order[s:e], kind[order[s]]
                rows = np.zeros((-(-(e - s) // 16) * 16, HIDDEN), np.float32)
                np.take(h, at, 0, out=rows[: e - s])
                own[at] += _log_share(rows @ self.low[c] + self.low_bias[c], e - s, t[at] % SIZE)
            out[i : i + TILE] = own
        return out


def _softmax(z: np.ndarray) -> np.ndarray:
    """Of training: logits begin at logarithms of shares, and what could leave the range of exp() is held back."""
    np.minimum(z, 80, out=z)
    np.exp(z, out=z)
    z *= (1 / (z @ np.ones(z.shape[1], np.float32) + 1e-30))[:, None]
    return z


def _log_share(z: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
    """Logarithms of the first n rows' softmax at one column each."""
    z = z[:n]
    z -= z.max(1, keepdims=True)
    own = z[np.arange(n), at].astype(np.float64)
    np.exp(z, out=z)
    return own - np.log(z.sum(1))


def windows(symbol: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The symbols around every token of rows that begin at `first`: WINDOW to the left, nearest last, and WINDOW to the right."""
    around = np.full((len(symbol), 2 * WINDOW), EDGE, np.int32)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for step in range(1, WINDOW + 1):
        same = row[step:] == row[:-step]
        around[step:, WINDOW - step][same] = symbol[:-step][same]
        around[:-step, WINDOW + step - 1][same] = symbol[step:][same]
    return around


def _hashes(texts):
    """(first row, hashes, first) of the slices of a column of texts."""
    data, offsets = texts_of(texts)
    for i, j in row_slices(offsets, SLICE):
        h, _, first = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        yield i, h, first


def _counted(slices) -> tuple[np.ndarray, np.ndarray]:
    """The distinct token hashes of what _hashes() gives, in order, and how often each occurs."""
    found = [np.unique(h, return_counts=True) for _, h, _ in slices]
    h, n = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, U64), np.zeros(0, np.int64))
    return summed(h, n)


def summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, in order, with the sums of their numbers."""
    order = np.argsort(h, kind="stable")
    heads = np.flatnonzero(np.diff(h[order], prepend=~h[order][:1]) != 0)
    return h[order][heads], np.add.reduceat(n[order], heads) if len(h) else n


def _edges(h: np.ndarray, n: int) -> np.ndarray:
    """Where each of n buckets, of even ranges of hashes, begins among hashes in order."""
    return np.searchsorted((h >> U64(32)) * U64(n) >> U64(32), np.arange(n + 1))


class Corpus:
    """Documents dealt to chunks, and their counted vocabulary."""

    def __init__(self, docs: DataFrame, text: str, doc_id: str, chunk_bytes: int = CHUNK_BYTES, bucket_tokens: int = BUCKET_TOKENS):
        body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
        own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), body.alias("text"))
        total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        chunks, self.buckets = math.ceil(total / chunk_bytes) or 1, math.ceil(total / 60 / bucket_tokens) or 1
        n = self.buckets
        spread = F.xxhash64(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.col("doc_id")))
        self.dealt = own.withColumn("chunk", F.pmod(spread, F.lit(chunks)).cast("int"))

        def send(key, t):
            h, count = _counted(_hashes(t.column("text")))
            edges = _edges(h, n)
            held = np.flatnonzero(np.diff(edges))
            out = pa.table({"bucket": pa.array(held, pa.int32()), "chunk": pa.array([key[0].as_py()] * len(held), pa.int32()), "payload": pa.array([h[edges[b] : edges[b + 1]].tobytes() + count[edges[b] : edges[b + 1]].tobytes() for b in held], pa.binary())})
            release()
            return out

        def count(key, t):
            own = [np.frombuffer(x, U64).reshape(2, -1) for x in t.column("payload").to_pylist()]
            h, times = summed(np.concatenate([x[0] for x in own]), np.concatenate([x[1] for x in own]).astype(np.int64))
            back = [times[np.searchsorted(h, x[0])].tobytes() for x in own]
            most = np.lexsort((h.view(np.int64), -times))[:FREQUENT]
            rare = np.bincount((h % U64(RARE)).astype(np.int64), times, RARE).astype(np.int64)
            rows = len(own)
            return pa.table({
                "bucket": pa.array([key[0].as_py()] * (rows + 1), pa.int32()), "chunk": pa.concat_arrays([t.column("chunk").combine_chunks(), pa.array([None], pa.int32())]), "payload": pa.array([*back, None], pa.binary()),
                "token": pa.array([*[None] * rows, h[most].view(np.int64)], pa.list_(pa.int64())), "times": pa.array([*[None] * rows, times[most]], pa.list_(pa.int64())), "rare": pa.array([*[None] * rows, rare], pa.list_(pa.int64())),
            })

        sent = self.dealt.groupBy("chunk").applyInArrow(send, "bucket int, chunk int, payload binary")
        told = durable(sent.groupBy("bucket").applyInArrow(count, "bucket int, chunk int, payload binary, token array<long>, times array<long>, rare array<long>"))
        self.told = told.where("chunk is not null").select("chunk", "bucket", "payload")
        ends = told.where("chunk is null")
        each = ends.select(F.explode(F.arrays_zip("token", "times")).alias("x")).select("x.token", "x.times").orderBy(F.desc("times"), "token").limit(FREQUENT).toArrow()
        rare = np.zeros(RARE, np.int64)
        for r in ends.select(F.posexplode("rare").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect():  # RARE rows
            rare[r["at"]] = r["n"]
        frequent, counts = np.asarray(each.column(0)).view(U64), np.asarray(each.column(1))
        np.subtract.at(rare, (frequent % U64(RARE)).astype(np.int64), counts)
        self.vocabulary = Vocabulary(frequent, counts, rare)


def fit(corpus: Corpus) -> tuple[Model, int]:
    """(model, number of windows that it was trained on)."""
    words = corpus.vocabulary
    given = corpus.dealt.sparkSession.sparkContext.broadcast(words)
    size = len(Model().flat())

    def train(key, t):
        t, words, seen = t.sort_by([("doc_id", "ascending"), ("text", "ascending")]), given.value, 0
        own = Model(words.counts)
        for _, h, first in _hashes(t.column("text")):
            symbol = words.symbols(h)
            own.train(windows(symbol, first), symbol)
            seen += len(symbol)
        sums = np.append(own.flat() * seen, seen)
        out = pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "sums": pa.array([pa.compress(sums.tobytes(), "zstd", asbytes=True)], pa.binary())})
        release()
        return out

    total = add_up(corpus.dealt.groupBy("chunk").applyInArrow(train, "part long, sums binary"), size + 1)
    return (Model.of(total[:-1] / total[-1]) if total[-1] else Model(words.counts)), int(total[-1])


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", chunk_bytes: int = CHUNK_BYTES, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_likelihood) of every row: natural logarithms, summed over all masked tokens.

    Null and empty texts, and those of white space, have no tokens, a sum of 0 and a null mean. Rows of one doc_id, or of a null one,
    get a row each; like texts have like scores. Texts are read whole, in slices of rows. Other columns don't matter, whatever their
    names; an empty table gives an empty one. What is gathered grows with the input: all distinct tokens of every chunk are counted,
    and every chunk sends a network; what any one process holds doesn't.
    """
    corpus = Corpus(docs, text, doc_id, chunk_bytes, bucket_tokens)
    model, _ = fit(corpus)
    given = docs.sparkSession.sparkContext.broadcast((corpus.vocabulary, [p.copy() for p in model.parts()]))
    n_buckets = corpus.buckets

    def rate(key, t, told):
        words, parts = given.value
        own = Model()
        own.embed, own.place, own.hidden, own.top, own.low, own.top_bias, own.low_bias = parts
        slices = list(_hashes(t.column("text")))  # 8 bytes a token of a chunk; texts are read once
        h, _ = _counted(slices)
        edges, times = _edges(h, n_buckets), np.ones(len(h), np.int64)
        for b, x in zip(told.column("bucket").to_pylist(), told.column("payload").to_pylist(), strict=True):
            times[edges[b] : edges[b + 1]] = np.frombuffer(x, np.int64)
        n, total = np.zeros(t.num_rows, np.int64), np.zeros(t.num_rows, np.int64)
        for i, hashes, first in slices:
            symbol = words.symbols(hashes)
            each = own.log_probability(windows(symbol, first), symbol)
            rare = np.flatnonzero(symbol >= FREQUENT)
            each[rare] += np.log(times[np.searchsorted(h, hashes[rare])] / words.rare[symbol[rare] - FREQUENT])
            whole = np.append(0, np.cumsum(np.rint(each / STEP).astype(np.int64)))
            n[i : i + len(first) - 1], total[i : i + len(first) - 1] = np.diff(first), whole[first[1:]] - whole[first[:-1]]
        mean = pa.array(total * STEP / np.maximum(n, 1), pa.float64(), mask=n == 0)
        out = pa.table({"doc_id": t.column("doc_id"), "n_tokens": pa.array(n), "log_likelihood": pa.array(total * STEP), "mean_log_likelihood": mean})
        release()
        return out

    return corpus.dealt.groupBy("chunk").cogroup(corpus.told.groupBy("chunk")).applyInArrow(rate, "doc_id long, n_tokens long, log_likelihood double, mean_log_likelihood double")


def query(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))
