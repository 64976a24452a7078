"""Nearest neighbours by additive quantisation.

Codebooks span the full dimension and are trained in turn on the residuals of a bounded sample. A vector's codes come from a beam
search over all codebooks; its norm is stored as the ratio to its decoded vector's. A block of codes is scored for many queries by
lookup tables of inner products; a bounded number of rows, those of the best scores, is ranked again by the exact double inner product
of the original vectors. Blocks are dealt by hash, so each holds its share of any query's neighbours.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gneiss.llm.common import durable, release, small_batches, table, tidy

BOOKS, WORDS, BEAM = 24, 256, 4
#: Vectors that the codebooks are trained on: those of the smallest hashes.
SAMPLE = 16384
BLOCK_ROWS = 16384
QUERY_BATCH = 32768
#: Of all rows, for each query, ranked exactly; shared() says how many of a block that makes.
RERANK = 320


def train(sample: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """(books, words, dim) codebooks, each by k-means on what the earlier ones leave of the sample."""
    rng, rest, out = np.random.default_rng(seed), sample.astype(np.float32).copy(), []
    for _ in range(books):
        centre = rest[rng.integers(0, len(rest), words)].copy() if len(rest) else np.zeros((words, sample.shape[1]), np.float32)
        for _ in range(rounds if len(rest) else 0):
            near = np.argmin((centre**2).sum(1) - 2 * rest @ centre.T, axis=1)
            count = np.bincount(near, minlength=words)
            total = np.zeros_like(centre)
            np.add.at(total, near, rest)
            centre[count > 0] = total[count > 0] / count[count > 0, None]
        if len(rest):
            rest -= centre[np.argmin((centre**2).sum(1) - 2 * rest @ centre.T, axis=1)]
        out.append(centre)
    return np.stack(out)


def encode(vectors: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, books) by beam search for the least error, and the norm of each vector over that of its decoded vector."""
    m, k, dim = books.shape
    square = (books**2).sum(2)
    codes, ratio = np.zeros((len(vectors), m), np.uint8), np.ones(len(vectors), np.float32)
    for i in range(0, len(vectors), 256):
        x = vectors[i : i + 256].astype(np.float32)
        n, left = len(x), x[:, None, :]
        paths, error = np.zeros((n, 1, 0), np.uint8), np.zeros((n, 1), np.float32)
        for j in range(m):  # what each path leaves, less each word of the next book
            cost = error[:, :, None] + (square[j] - 2 * (left.reshape(-1, dim) @ books[j].T)).reshape(n, -1, k)
            cost = cost.reshape(n, -1)
            best = np.argpartition(cost, min(beam, cost.shape[1]) - 1, axis=1)[:, :beam]
            error = np.take_along_axis(cost, best, 1)
            path, word = best // k, best % k
            left = np.take_along_axis(left, path[:, :, None], 1) - books[j][word]
            paths = np.concatenate([np.take_along_axis(paths, path[:, :, None], 1), word[:, :, None].astype(np.uint8)], axis=2)
        last = np.argmin(error, 1)
        codes[i : i + n] = paths[np.arange(n), last]
        made = np.linalg.norm(x - left[np.arange(n), last], axis=1)
        ratio[i : i + n] = np.linalg.norm(x, axis=1) / np.where(made > 0, made, 1)
    return codes, ratio


def shared(rerank: int, blocks: int, top: int) -> int:
    """How many of a block's rows are ranked exactly for a query: a block's even share, four deviations of it more, and `top`, so that
    neither chance nor copies of one vector keep a neighbour out."""
    share = rerank / blocks
    return rerank if blocks == 1 else math.ceil(share + 4 * math.sqrt(share)) + top


def _few_copies(vectors: np.ndarray, top: int) -> np.ndarray:
    """Places of the rows without those that have `top` + 1 equal rows before them: these can't be among any query's `top`."""
    _, kind = np.unique(vectors, axis=0, return_inverse=True)
    order = np.argsort(kind.ravel(), kind="stable")
    own = kind.ravel()[order]
    turn = np.arange(len(own)) - np.searchsorted(own, own)
    return np.sort(order[turn <= top])


def search_block(queries: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, ratio: np.ndarray, books: np.ndarray, top: int, rerank: int):
    """(query, id, score) of each query's best of a block whose rows are in order of id; equal scores go to smaller ids."""
    keep = _few_copies(vectors, top)
    ids, vectors, codes, ratio = ids[keep], vectors[keep], codes[keep], ratio[keep]
    m, out = len(books), []
    want = min(rerank, len(ids))
    for i in range(0, len(queries), 64):
        q = queries[i : i + 64]
        tables = np.ascontiguousarray(np.einsum("mkd,qd->mkq", books, q.astype(np.float32)))
        scores = tables[0][codes[:, 0]]
        for j in range(1, m):
            scores += tables[j][codes[:, j]]
        scores = np.ascontiguousarray((scores * ratio[:, None]).T)
        edge = -np.partition(-scores, want - 1, axis=1)[:, want - 1]
        for a in range(len(q)):
            row, most = scores[a], want
            near = np.flatnonzero(row > edge[a])
            near = np.concatenate([near, np.flatnonzero(row == edge[a])[: most - len(near)]])
            near = near[ids[near] != query_ids[i + a]]
            exact = vectors[near].astype(np.float64) @ q[a].astype(np.float64)
            order = np.lexsort((ids[near], -exact))[:top]
            out.append((np.full(len(order), query_ids[i + a]), ids[near][order], exact[order]))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]


def _vectors(column) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(a.flatten()).reshape(len(a), -1) if len(a) else np.zeros((0, 1))


def usable(vectors: DataFrame, vector: str, vec_id: str) -> DataFrame:
    """(vec_id, v) of the rows that take part: a non-null id and finite components, not all zero, as many as most rows have."""
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (common[0] if common else 0))


def nearest(vectors: DataFrame, every: int = 20, top: int = 20, vector: str = "embedding", vec_id: str = "vec_id", books: int = BOOKS, rerank: int = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id `every` divides, the `top` rows of largest inner product, all indexed.

    Null ids and vectors that are null, empty, zero, of another length than most, or hold null or non-finite components take no part.
    A query's own row, and others of its id, are no candidates; rows of one id are candidates each. With fewer candidates than `top`
    all are returned. Ties go to smaller ids. Other columns don't matter, whatever their names; an empty table gives an empty one.
    The index is a table of codes in blocks by hash of the id; queries come to it in broadcast batches of bounded size. Every code is
    scored for every query: where vectors have no clusters, as here, a coarse partition loses more neighbours than it saves work. With
    few rows more of them are ranked exactly than the codes leave out.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, vector, vec_id)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
    book = train(_vectors(sample.column(0)), books)
    del sample

    def index(batches):
        for b in batches:
            x = _vectors(b.column(1))
            codes, ratio = encode(x, book) if len(x) else (np.zeros((0, books), np.uint8), np.zeros(0, np.float32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(ratio, pa.float32())], ["vec_id", "v", "codes", "ratio"])

    indexed = durable(rows.mapInArrow(tidy(index), "vec_id long, v array<double>, codes binary, ratio float"))
    blocks = math.ceil(indexed.count() / BLOCK_ROWS) or 1
    indexed = indexed.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    asked = rows.where(F.col("vec_id") % every == 0)
    turns = math.ceil(asked.count() / QUERY_BATCH) or 1
    found = None
    for turn in range(turns):
        batch = asked.where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(turns)) == turn).toArrow()
        given = spark.sparkContext.broadcast((np.asarray(batch.column(0)), _vectors(batch.column(1))))

        part = indexed.groupBy("block").applyInArrow(_looker(given, book, top, shared(rerank, blocks, top)), "query_id long, vec_id long, score double")
        found = part if found is None else found.unionByName(part)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def _looker(given, book: np.ndarray, top: int, rerank: int):
    """What searches one block for a broadcast batch of queries."""

    def look(t):
        t = t.sort_by([("vec_id", "ascending")])
        query_ids, queries = given.value
        codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), np.uint8).reshape(t.num_rows, -1)
        q, i, s = search_block(queries, query_ids, np.asarray(t.column("vec_id")), _vectors(t.column("v")), codes, np.asarray(t.column("ratio")), book, top, rerank)
        out = pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array(s, pa.float64())})
        release()
        return out

    return look


def query(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
