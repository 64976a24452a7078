"""Substring dedup: words under long repeats of an earlier document go, found with suffix automata of reference shards.

Every window of `length` words has an anchor: of its runs of `GRAM` words, the one with the least hash. Equal windows have equal
anchors, so a corpus falls into shards by anchor, and only windows whose anchor occurs in two documents can repeat.

1. Documents are dealt to chunks of bounded bytes. A chunk sends its distinct anchors to buckets, as sorted arrays.
2. A bucket tells each chunk, a bit an anchor, which of them other chunks hold too, and which of them are in HOT_CHUNKS or more.
3. A chunk cuts the word runs around repeated anchors, keeps each distinct one with its smallest doc_id, and sends it to a shard. The
   windows of an anchor that is in many chunks, as a line that many documents share may be, go one by one to the shards of their own
   hashes, so that no shard has to hold all surroundings of such a line.
4. A shard is the reference: it builds suffix automata of its distinct runs, each state with the smallest doc_id of its
   occurrences, streams the runs through them, and from the matching statistics gets each window's smallest doc_id. Where an anchor
   has one distinct run, as most have, all of it matches, and no automaton is built.
5. A chunk marks the windows with a smaller doc_id than its document's own; the union of them are the maximal spans to remove.

Automata of a whole corpus have no size bound, so they aren't broadcast to every executor: each stays in the task of its shard and
the runs that can match it are streamed there. A run that is in many documents reaches a shard once a chunk, so no frequent passage
piles up. All steps are deterministic, so that lost tasks are repeated alike.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.llm.common import U64, grams, release, row_slices, small_batches, table, texts_of, word_hashes, words_of

GRAM = 5
CHUNK_BYTES = 8 << 20
BUCKET_ANCHORS = 300_000
HOT_CHUNKS = 16


class SuffixAutomaton:
    """Of several word sequences; `low` has the smallest owner of each state's occurrences after close()."""

    def __init__(self):
        self.next, self.link, self.size, self.low = [{}], [-1], [0], [1 << 63]

    def _state(self, size: int, link: int, moves: dict, low: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.size.append(size)
        self.low.append(low)
        return len(self.size) - 1

    def _split(self, p: int, word, q: int) -> int:
        """The state of p's longest string with the word behind it, given that p moves to q."""
        if self.size[p] + 1 == self.size[q]:
            return q
        clone = self._state(self.size[p] + 1, self.link[q], self.next[q].copy(), self.low[q])
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, sequence: list, owner: int) -> None:
        last = 0
        for word in sequence:
            p, q = last, self.next[last].get(word)
            if q is not None:
                last = self._split(p, word, q)
            else:
                last = self._state(self.size[p] + 1, 0, {}, owner)
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = last
                    p = self.link[p]
                if p >= 0:
                    self.link[last] = self._split(p, word, self.next[p][word])
            if owner < self.low[last]:
                self.low[last] = owner

    def close(self) -> None:
        for v in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            up = self.link[v]
            if self.low[v] < self.low[up]:
                self.low[up] = self.low[v]

    def owners(self, sequence: list, length: int) -> list[int]:
        """For each window of `length` words in the sequence, the smallest owner of an occurrence; 1 << 63 if it has none."""
        v, matched, out = 0, 0, []
        for i, word in enumerate(sequence):
            while v and word not in self.next[v]:
                v = self.link[v]
                matched = self.size[v]
            if word in self.next[v]:
                v, matched = self.next[v][word], matched + 1
            if i >= length - 1:
                if matched < length:
                    out.append(1 << 63)
                    continue
                u = v
                while self.size[self.link[u]] >= length:
                    u = self.link[u]
                out.append(self.low[u])
        return out


def _runs(texts, ids: np.ndarray, known: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """The word runs around all anchors: anchor, row, doc, first window (word index in the row), number of windows, byte range, and
    the place of their first word in the byte ranges of all words of the slices that have windows."""
    data, offsets = texts_of(texts)
    parts: list[tuple] = []
    spans: list[tuple] = []
    n_words = 0
    reach = length - GRAM + 1
    for i, j in row_slices(offsets):
        if not known[i:j].any():
            continue
        base = offsets[i]
        part, off = data[base : offsets[j]], offsets[i : j + 1] - base
        starts, ends, first = words_of(part, off)
        n = len(starts) - length + 1
        if n < 1:
            continue
        g = grams(word_hashes(part, starts, ends), GRAM)
        best, at = g[:n].copy(), np.zeros(n, np.int64)
        for k in range(1, reach):
            other = g[k : k + n]
            less = other < best
            np.copyto(best, other, where=less)
            at[less] = k
        row = np.repeat(np.arange(j - i), np.diff(first))
        at += np.arange(n)
        ok = row[:n] == row[length - 1 :]
        ok &= known[i:j][row[:n]]
        w = np.flatnonzero(ok)
        if not len(w):
            continue
        fresh = np.ones(len(w), bool)
        fresh[1:] = (at[w[1:]] != at[w[:-1]]) | (row[w[1:]] != row[w[:-1]])
        head = np.flatnonzero(fresh)
        s1, count = w[head], np.diff(np.append(head, len(w)))
        r = row[s1]
        parts.append((best[s1], r + i, ids[i:j][r], s1 - first[r], count, starts[s1] + base, ends[s1 + count + length - 2] + base, s1 + n_words))
        spans.append((starts + base, ends + base))
        n_words += len(starts)
    names = ("anchor", "row", "doc", "window", "count", "start", "end", "word")
    kinds = (U64, *[np.int64] * 7)
    out = {k: np.concatenate([p[x] for p in parts]) if parts else np.zeros(0, t) for x, (k, t) in enumerate(zip(names, kinds, strict=True))}
    return out | {"data": data, "spans": [np.concatenate(x) for x in zip(*spans, strict=True)] if spans else [np.zeros(0, np.int64)] * 2}


def _ids(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = t.column("doc_id").combine_chunks().cast(pa.int64())
    return np.asarray(ids.fill_null(0)), ~np.asarray(ids.is_null())


def _bucket(anchor: np.ndarray, n: int) -> np.ndarray:
    return ((anchor >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)


def _cut(sorted_buckets: np.ndarray, n: int):
    """(bucket, from, to) of each bucket that occurs."""
    edges = np.searchsorted(sorted_buckets, np.arange(n + 1))
    return [(b, edges[b], edges[b + 1]) for b in np.flatnonzero(np.diff(edges))]


def _marked(t: pa.Table, masks: pa.Table, n: int, length: int) -> dict:
    """The runs of a chunk whose anchor occurs in two documents, here or, by the masks, in another chunk; the windows of hot anchors are
    runs of their own, with no anchor (`hot`)."""
    ids, known = _ids(t)
    runs = _runs(t.column("text"), ids, known, length)
    anchors = np.unique(runs["anchor"])
    data, (word_start, word_end) = runs.pop("data"), runs.pop("spans")
    if not len(anchors):
        return runs | {"data": data, "hot": np.zeros(0, bool)}
    order = np.argsort(runs["anchor"], kind="stable")
    head = np.searchsorted(runs["anchor"][order], anchors)
    doc = runs["doc"][order]
    repeated, hot = np.minimum.reduceat(doc, head) < np.maximum.reduceat(doc, head), np.zeros(len(anchors), bool)
    edges = np.searchsorted(_bucket(anchors, n), np.arange(n + 1))
    for b, bits in zip(masks.column("bucket").to_pylist(), masks.column("payload").to_pylist(), strict=True):
        size, raw = edges[b + 1] - edges[b], np.frombuffer(bits, np.uint8)
        repeated[edges[b] : edges[b + 1]] |= np.unpackbits(raw[: len(raw) // 2], count=size).astype(bool)
        hot[edges[b] : edges[b + 1]] = np.unpackbits(raw[len(raw) // 2 :], count=size)
    place = np.searchsorted(anchors, runs["anchor"])
    keep = np.flatnonzero(repeated[place])
    runs, is_hot = {k: x[keep] for k, x in runs.items()}, hot[place][keep]
    if is_hot.any():
        apart, whole = {k: x[is_hot] for k, x in runs.items()}, {k: x[~is_hot] for k, x in runs.items()}
        count = apart["count"]
        step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        each = {k: np.repeat(x, count) for k, x in apart.items()}
        word = each["word"] + step
        each |= {"window": each["window"] + step, "count": np.ones(len(step), np.int64), "start": word_start[word], "end": word_end[word + length - 1], "word": word}
        runs, is_hot = {k: np.concatenate([x, each[k]]) for k, x in whole.items()}, np.arange(len(whole["row"]) + len(step)) >= len(whole["row"])
    return runs | {"data": data, "hot": is_hot}


def _distinct(runs: dict, n: int):
    """{bucket: (texts, anchors, smallest docs, sizes)} of distinct runs, in order of their bytes, and each run's text."""
    data = runs["data"].tobytes()
    texts = [b" ".join(data[s:e].split()) for s, e in zip(runs["start"].tolist(), runs["end"].tolist(), strict=True)]
    anchors = runs["anchor"].copy()
    alone = np.flatnonzero(runs["hot"])
    anchors[alone] = np.fromiter((xxhash.xxh64_intdigest(texts[i], 3) for i in alone.tolist()), U64, len(alone))
    low: dict[int, dict[bytes, list]] = {}
    for text, b, anchor, doc, count in zip(texts, _bucket(anchors, n).tolist(), anchors.tolist(), runs["doc"].tolist(), runs["count"].tolist(), strict=True):
        at = low.setdefault(b, {})
        had = at.get(text)
        if had is None:
            at[text] = [doc, anchor, count]
        elif doc < had[0]:
            had[0] = doc
    return {b: [(text, *at[text]) for text in sorted(at)] for b, at in low.items()}, texts


def _shard(entries: list[tuple[int, bytes]], length: int):
    """For each (chunk, payload) of a shard: every run's windows' smallest doc_ids, end to end."""
    groups: dict[int, dict[bytes, int]] = {}
    sent = []
    for chunk, payload in entries:
        docs, anchors, texts = _unpack(payload)
        sent.append((chunk, anchors, texts))
        for doc, anchor, text in zip(docs, anchors, texts, strict=True):
            at = groups.setdefault(anchor, {})
            if doc < at.get(text, 1 << 63):
                at[text] = doc
    found: dict[bytes, list[int]] = {}
    for at in groups.values():
        if len(at) == 1:  # the automaton of a single sequence matches all of it
            (text, doc), = at.items()
            found[text] = [doc] * (text.count(b" ") + 2 - length)
            continue
        automaton = SuffixAutomaton()
        split = {text: text.split(b" ") for text in sorted(at)}
        for text, words in split.items():
            automaton.add(words, at[text])
        automaton.close()
        for text, words in split.items():
            found[text] = automaton.owners(words, length)
    for chunk, _, texts in sent:
        yield chunk, np.array([x for text in texts for x in found[text]], np.int64)


def _pack(rows: list[tuple]) -> bytes:
    head = np.array([[r[1] for r in rows]], np.int64).tobytes() + np.array([r[2] for r in rows], U64).tobytes()
    text = b"\n".join(r[0] for r in rows)
    return np.array([len(rows), len(text)], np.int64).tobytes() + head + pa.compress(text, "zstd", asbytes=True)


def _unpack(payload: bytes):
    n, size = np.frombuffer(payload, np.int64, 2).tolist()
    docs, anchors = np.frombuffer(payload, np.int64, n, 16), np.frombuffer(payload, U64, n, 16 + 8 * n)
    text = pa.decompress(payload[16 + 16 * n :], size, "zstd", asbytes=True)
    return docs.tolist(), anchors.tolist(), text.split(b"\n")


def remove_repeats(docs: DataFrame, length: int = 13, text: str = "text", doc_id: str = "doc_id", chunk_bytes: int = CHUNK_BYTES, bucket_anchors: int = BUCKET_ANCHORS, hot_chunks: int = HOT_CHUNKS) -> DataFrame:
    """docs with the words gone that a window of `length` words covers whose words also start in a document of smaller doc_id.

    Words are runs of bytes other than ASCII white space; windows are judged on the input. All columns stay; text holds what is
    kept, with its white space (an untouched text stays as it is), and these columns join: n_words, n_removed, kept_sha256 (of the
    kept words joined by one space).

    Null or empty text: no words, nothing removed, null stays null. Null doc_id: nothing is removed and nothing is held against it.
    Rows of one doc_id are one document: they don't cut each other, and each gets its own result. Very long texts are hashed alone;
    no size is capped. An empty table gives an empty table. Columns other than the two named pass through, whatever their names,
    unless they are named like the added ones, which replace them.
    """
    added = {"n_words": T.LongType(), "n_removed": T.LongType(), "kept_sha256": T.StringType()}
    names = [c for c in docs.columns if c not in added]
    kept = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    id_at, text_at = f"c{names.index(doc_id)}", f"c{names.index(text)}"
    total = kept.agg(F.sum(F.octet_length(text_at))).first()[0] or 0
    chunks, n = math.ceil(total / chunk_bytes) or 1, math.ceil(total / 6 * 0.2 / bucket_anchors) or 1
    spread = F.xxhash64(F.when(F.col(id_at).isNull(), F.xxhash64(text_at)).otherwise(F.col(id_at).cast("long")))
    dealt = kept.withColumn("chunk", F.pmod(spread, F.lit(chunks)).cast("int"))

    def plain(t: pa.Table) -> pa.Table:
        return t.select([id_at, text_at]).rename_columns(["doc_id", "text"])

    def anchors(key, t):
        t = plain(t)
        a = np.unique(_runs(t.column("text"), *_ids(t), length)["anchor"])
        rows = [(b, a[i:j].tobytes()) for b, i, j in _cut(_bucket(a, n), n)]
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "chunk": pa.array([key[0].as_py()] * len(rows), pa.int32()), "payload": pa.array([r[1] for r in rows], pa.binary())})

    def shared(key, t):
        own = [np.frombuffer(x, U64) for x in t.column("payload").to_pylist()]
        u, times = np.unique(np.concatenate(own), return_counts=True)
        bits = []
        for a in own:
            seen = times[np.searchsorted(u, a)]
            bits.append(np.packbits(seen > 1).tobytes() + np.packbits(seen >= hot_chunks).tobytes())
        return pa.table({"bucket": pa.array([key[0].as_py()] * len(own), pa.int32()), "chunk": t.column("chunk"), "payload": pa.array(bits, pa.binary())})

    def cut(key, t, masks):
        sent = _distinct(_marked(plain(t), masks, n, length), n)[0]
        release()
        return pa.table({"bucket": pa.array(list(sent), pa.int32()), "chunk": pa.array([key[0].as_py()] * len(sent), pa.int32()), "payload": pa.array([_pack(x) for x in sent.values()], pa.binary())})

    def judge(key, t):
        release()
        out = [(c, pa.compress(x.tobytes(), "zstd", asbytes=True)) for c, x in _shard(list(zip(t.column("chunk").to_pylist(), t.column("payload").to_pylist(), strict=True)), length)]
        return pa.table({"bucket": pa.array([key[0].as_py()] * len(out), pa.int32()), "chunk": pa.array([x[0] for x in out], pa.int32()), "payload": pa.array([x[1] for x in out], pa.binary()), "is_mask": pa.array([False] * len(out))})

    out_schema = T.StructType([T.StructField(f"c{i}", kept.schema[f"c{i}"].dataType) for i in range(len(names))] + [T.StructField(k, v) for k, v in added.items()])

    def remove(key, t, told):
        is_mask = told.column("is_mask").combine_chunks()
        runs = _marked(plain(t), told.filter(is_mask), n, length)
        sent, texts = _distinct(runs, n)
        at: dict[bytes, int] = {}
        low, size = [], 0
        judged = told.filter(pa.compute.invert(is_mask))
        for b, payload in zip(judged.column("bucket").to_pylist(), judged.column("payload").to_pylist(), strict=True):
            for row in sent[b]:
                at[row[0]] = size
                size += row[3]
            low.append(payload)
        flat = np.concatenate([np.frombuffer(pa.decompress(p, 8 * sum(r[3] for r in sent[b]), "zstd", asbytes=True), np.int64) for b, p in zip(judged.column("bucket").to_pylist(), low, strict=True)]) if low else np.zeros(0, np.int64)
        count = runs["count"]
        begin = np.array([at[x] for x in texts], np.int64)
        step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        hit = flat[np.repeat(begin, count) + step] < np.repeat(runs["doc"], count)
        rows, windows = np.repeat(runs["row"], count)[hit], (np.repeat(runs["window"], count) + step)[hit]
        del runs, sent, texts, at
        release()
        return _kept(t, text_at, names, rows, windows, length)

    first = dealt.groupBy("chunk").applyInArrow(anchors, "bucket int, chunk int, payload binary")
    masks = first.groupBy("bucket").applyInArrow(shared, "bucket int, chunk int, payload binary")
    cuts = dealt.groupBy("chunk").cogroup(masks.groupBy("chunk")).applyInArrow(cut, "bucket int, chunk int, payload binary")
    judged = cuts.groupBy("bucket").applyInArrow(judge, "bucket int, chunk int, payload binary, is_mask boolean")
    told = judged.unionByName(masks.withColumn("is_mask", F.lit(True)))
    out = dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(remove, out_schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], *added)


def _kept(t: pa.Table, text_at: str, names: list[str], rows: np.ndarray, windows: np.ndarray, length: int) -> pa.Table:
    import hashlib

    data, offsets = texts_of(t.column(text_at))
    raw = data.tobytes()
    order = np.lexsort((windows, rows))
    rows, windows = rows[order], windows[order]
    edges = np.searchsorted(rows, np.arange(t.num_rows + 1))
    total, removed, digest, texts = [], [], [], []
    valid = t.column(text_at).is_valid().to_pylist()
    for r in range(t.num_rows):
        body = raw[offsets[r] : offsets[r + 1]]
        words = body.split()
        hit = windows[edges[r] : edges[r + 1]]
        n_removed = 0
        if len(hit):
            turn = np.zeros(len(words) + 1, np.int64)
            np.add.at(turn, hit, 1)
            np.add.at(turn, hit + length, -1)
            gone = np.cumsum(turn[:-1]) > 0
            n_removed = int(gone.sum())
            one = np.frombuffer(body, np.uint8)
            starts, _, _ = words_of(one, np.array([0, len(one)]))
            change = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
            bounds = np.append(starts, len(body))[change]
            pieces, place = [], 0
            for a, b in zip(bounds[::2].tolist(), bounds[1::2].tolist(), strict=True):
                pieces.append(body[place:a])
                place = b
            body = b"".join([*pieces, body[place:]])
            total.append(len(words))
            words = body.split()
        else:
            total.append(len(words))
        removed.append(n_removed)
        digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
        texts.append(body.decode() if valid[r] else None)
    columns = {f"c{i}": t.column(f"c{i}") for i in range(len(names))}
    columns[text_at] = pa.array(texts, pa.string())
    return pa.table(columns | {"n_words": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())})


def query(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), t AS (
  SELECT doc_id, s, array_to_string(w[s + 1:s + 13], ' ') AS k FROM (SELECT doc_id, w, unnest(range(len(w) - 12)) AS s FROM d WHERE len(w) >= 13)
), m AS (
  SELECT k, min(doc_id) AS low FROM t GROUP BY k
), g AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS p FROM t JOIN m USING (k) WHERE m.low < t.doc_id
), w AS (
  SELECT doc_id, unnest(range(len(w))) AS p, unnest(w) AS word FROM d
), e AS (
  SELECT w.doc_id, count(g.p) AS n_removed, string_agg(CASE WHEN g.p IS NULL THEN w.word END, ' ' ORDER BY w.p) AS kept FROM w LEFT JOIN g ON w.doc_id = g.doc_id AND w.p = g.p GROUP BY w.doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(e.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(e.kept, '')) AS kept_sha256 FROM d LEFT JOIN e USING (doc_id)
"""
