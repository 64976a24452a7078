"""Best-fit packing by swap-based local search.

How well documents pack depends on how many there are of each length alone, and there are at most `capacity` lengths. So documents are
tokenised where they are read, only the counts of lengths reach the driver, and all documents of a corpus are packed as one: bins that
hold like lengths are one entry with a number of copies, in best fit and in the search. Each document then gets the place of its rank
among those of its length. Memory and time on the driver don't grow with the number of documents.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gneiss.llm.common import BROADCAST_ROWS, bites, durable, small_batches, table, tidy

#: The emptiest bins, of different contents, that trade with each other; the emptiest of all trades with every bin.
WIDTH = 48

#: What a bin holds: (length, copies), longest first.
Held = tuple[tuple[int, int], ...]


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """The ids of a byte-level BPE file of the tokenizers library, through tiktoken, which is several times as fast.

    A special token's string in a text becomes that token, as in the library with add_special_tokens=False.
    """
    import json

    import public_tokenizers
    import tiktoken

    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    made = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: made.encode(text, allowed_special="all") if any(x in text for x in special) else made.encode_ordinary(text)


def pieces(docs: DataFrame, path: str | None, capacity: int, text: str, doc_id: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, place): the token ids of each text and a closing 0, cut where longer than
    `capacity`. part is the task that made the row, place counts its rows of the same length from 0."""

    def cut(batches):
        if path is None:
            import public_tokenizers

            encode = encoder(public_tokenizers.path("byte_bpe_50k.json"))
        else:
            encode = encoder(path)
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64).tolist()
        for b in bites(batches):
            ids, out = b.column(0).to_pylist(), []
            for i, body in enumerate(b.column(1)):
                tokens = np.array([*encode(body.as_py() or ""), 0], "<u4")
                first = len(tokens) % capacity or capacity
                for k, start in enumerate([0, *range(first, len(tokens), capacity)]):
                    own = tokens[start : start + capacity] if k else tokens[:first]
                    out.append((ids[i], k, start, len(own), zlib.crc32(own.tobytes()), part, seen[len(own)]))
                    seen[len(own)] += 1
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"])

    rows = docs.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`").cast("string"))
    return rows.mapInArrow(tidy(cut), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long")


def fill_of(held: Held) -> int:
    return sum(n * k for n, k in held)


def least_bins(count: dict[int, int], capacity: int) -> int:
    """A number of bins that no packing goes below (Martello and Toth, 1990): long documents need bins of their own, and what lies
    between a limit and half a bin must go beside the shorter of these or into more."""
    n = np.array(sorted(count), np.int64)
    c = np.array([count[x] for x in n.tolist()], np.int64)
    best = -(-int((n * c).sum()) // capacity)
    for k in [0, *n[n <= capacity // 2].tolist()]:
        alone, long, short = n > capacity - k, (n <= capacity - k) & (2 * n > capacity), (n >= k) & (2 * n <= capacity)
        beside = int(c[long].sum()) * capacity - int((n * c)[long].sum())
        best = max(best, int(c[alone].sum() + c[long].sum()) + max(0, -(-(int((n * c)[short].sum()) - beside) // capacity)))
    return best


def best_fit(count: dict[int, int], capacity: int) -> dict[Held, int]:
    """Bins by content with their numbers, of count[length] documents: longest first, each into the fullest bin that still takes it."""
    groups: list[tuple[int, tuple]] = []  # (copies, content)
    by_room: dict[int, list[int]] = {}
    open_rooms, done = 0, []  # bit r: some bins have room r

    def put(copies: int, room: int, held: tuple) -> None:
        nonlocal open_rooms
        if not room:
            done.append((copies, held))
            return
        by_room.setdefault(room, []).append(len(groups))
        groups.append((copies, held))
        open_rooms |= 1 << room

    for n in sorted(count, reverse=True):
        left = count[n]
        while left:
            fits = open_rooms >> n
            if fits:
                room = n + (fits & -fits).bit_length() - 1
                copies, held = groups[by_room[room].pop()]
                if not by_room[room]:
                    open_rooms &= ~(1 << room)
            else:
                room, held = capacity, ()
                copies = -(-left // (capacity // n))
            each = room // n
            whole = min(copies, left // each)
            if whole:
                put(whole, room - each * n, (*held, (n, each)))
                copies, left = copies - whole, left - whole * each
            if copies and left:  # fewer than a bin takes
                put(1, room - left * n, (*held, (n, left)))
                copies, left = copies - 1, 0
            if copies:
                put(copies, room, held)
    out: dict[Held, int] = {}
    for copies, held in [*done, *(groups[g] for own in by_room.values() for g in own)]:
        out[held] = out.get(held, 0) + copies
    return out


@functools.lru_cache(maxsize=1 << 14)
def _sums(held: Held) -> tuple[np.ndarray, list, np.ndarray, list]:
    """The lengths of single documents and of pairs that a bin holds, in order, and what they are."""
    one = sorted(n for n, _ in held)
    two = sorted({a + b: (a, b) for i, (a, k) in enumerate(held) for b, _ in held[i + (k < 2) :]}.items())
    return np.array(one, np.int64), [(n,) for n in one], np.array([s for s, _ in two], np.int64), [p for _, p in two]


def _exchange(mine: Held, other: Held, gap: int):
    """The exchange of one or two documents for none, one or two that fills most of the gap: (gain, out of mine, out of other).

    A bin holds few different lengths, about the square root of twice its capacity at most, so copies cost nothing."""
    one, ones, two, twos = _sums(mine)
    back_one, back_ones, back_two, back_twos = _sums(other)
    best, found = 0, None
    for out, outs, give, gives in ((one, ones, np.append(0, back_one), [(), *back_ones]), (two, twos, np.append(0, back_one), [(), *back_ones]), (one, ones, back_two, back_twos)):
        if not len(out) or not len(give):
            continue
        at = np.searchsorted(give, out - gap)  # the least to give back so that the rest fits
        gain = np.where(at < len(give), out - give[np.minimum(at, len(give) - 1)], 0)
        i = int(gain.argmax())
        if gain[i] > best:
            best, found = int(gain[i]), (outs[i], gives[at[i]])
            if best == gap:
                break
    return (best, *found) if found else None


def _changed(held: Held, less: tuple, more: tuple) -> Held:
    now = dict(held)
    for n in less:
        now[n] -= 1
    for n in more:
        now[n] = now.get(n, 0) + 1
    return tuple((n, now[n]) for n in sorted(now, reverse=True) if now[n])


def local_search(bins: dict[Held, int], capacity: int, width: int = WIDTH) -> dict[Held, int]:
    """Empties bins: documents move to fuller bins, or change places one for one, two for one or one for two, whenever the fuller bin
    gets fuller by it, that is, whenever the sum of squared fills rises. The `width` emptiest contents trade with each other, and the
    emptiest with all; bins of like content trade at once. Ends at the least count that is possible, or when none of these exchanges
    raises the sum any more; exchanges of more documents, or between two fuller bins, aren't tried."""
    bins, count = dict(bins), {}
    for held, copies in bins.items():
        for n, k in held:
            count[n] = count.get(n, 0) + k * copies
    least, number, better = least_bins(count, capacity), sum(bins.values()), True
    fill = {held: fill_of(held) for held in bins}
    while better and number > least:
        better = False
        slack = sorted((held for held in bins if fill[held] < capacity), key=lambda held: (fill[held], held))
        for k, e in enumerate(slack[:width]):
            for b in reversed(slack if k == 0 else slack[k:width]):
                pairs = bins.get(e, 0) // 2 if e == b else min(bins.get(e, 0), bins.get(b, 0))
                swap = _exchange(e, b, capacity - fill[b]) if pairs else None
                if not swap:
                    continue
                gain, out, back = swap
                for held, less in ((e, pairs), (b, pairs)):
                    bins[held] -= less
                    if not bins[held]:
                        del bins[held]
                for held, size in ((_changed(e, out, back), fill[e] - gain), (_changed(b, back, out), fill[b] + gain)):
                    if held:
                        bins[held], fill[held] = bins.get(held, 0) + pairs, size
                    else:
                        number -= pairs
                better = True
            if number <= least:
                break
    return bins


def pack_counts(count: dict[int, int], capacity: int) -> dict[Held, int]:
    """Bins by content with their numbers, for count[length] documents of each length."""
    return local_search(best_fit(count, capacity), capacity)


def _slots(bins: dict[Held, int], capacity: int) -> dict[str, np.ndarray]:
    """For each length in turn, the ranks of documents that each content's bins take: index bounds by length, and for each entry the
    first rank, the copies in a bin, the first bin's number and the offset in a bin."""
    rows, number = [], 0
    for held, copies in sorted(bins.items()):
        at = 0
        for n, k in held:
            rows.append((n, k, number, at, k * copies))
            at += n * k
        number += copies
    rows.sort()
    n, each, first, at, size = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 5
    bounds = np.searchsorted(n, np.arange(capacity + 2))
    total = np.append(0, np.cumsum(size))
    return {"bounds": bounds, "rank": total[:-1] - total[bounds[n]] if len(n) else total[:-1], "each": each, "first": first, "at": at}


def pack(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, text: str = "text", doc_id: str = "doc_id", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): all documents in as few sequences of `capacity` tokens as found.

    tokenizer is the path of a byte-level BPE file of the tokenizers library; None is the installed byte_bpe_50k.json. A document is
    its token ids and a closing 0; special tokens' strings become these tokens. A longer one is cut, its first piece the shorter one.
    Null text counts as empty: its one token is the 0. Rows of one doc_id are documents of their own, and like rows take each other's
    places. Null doc_id stays null. Very long texts are tokenised whole. Other columns are ignored, whatever their names; an empty
    table gives an empty one. sequence_id counts from 0 without gaps.
    """
    made = durable(pieces(docs, tokenizer, capacity, text, doc_id))
    sizes = durable(made.groupBy("length", "part").agg(F.count("*").alias("n")))
    count = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `capacity` rows at most
    given = docs.sparkSession.sparkContext.broadcast(_slots(pack_counts(count, capacity), capacity))
    base = sizes.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("base"))
    if sizes.limit(broadcast_rows + 1).count() <= broadcast_rows:
        base = F.broadcast(base)

    def put(batches):
        slots = given.value
        for b in batches:
            n, rank = np.asarray(b.column(3)), np.asarray(b.column(5))
            # entries of one length are in order of rank, and so are lengths: one search in a key of both
            key = np.repeat(np.arange(len(slots["bounds"]) - 1), np.diff(slots["bounds"]))
            at = _last(key, slots["rank"], n, rank)
            over = rank - slots["rank"][at]
            copy, turn = np.divmod(over, slots["each"][at])
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(slots["first"][at] + copy), pa.array(slots["at"][at] + turn * n)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = made.join(base, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("place")).alias("rank"))
    kinds = [("doc_id", T.LongType()), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType())]
    return ranked.mapInArrow(tidy(put), T.StructType([T.StructField(*k) for k in kinds]))


def _last(keys: np.ndarray, ranks: np.ndarray, key: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The last place whose (key, rank) is at most each one asked for; keys and ranks are in order, a key's ranks begin at 0."""
    order = np.lexsort((rank, key))
    out, bounds = np.zeros(len(key), np.int64), np.searchsorted(keys, np.arange(keys[-1] + 2) if len(keys) else [0])
    edges = np.flatnonzero(np.diff(key[order], prepend=-1))
    for s, e in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True):
        a, b = bounds[key[order[s]]], bounds[key[order[s]] + 1]
        out[order[s:e]] = a + np.searchsorted(ranks[a:b], rank[order[s:e]], "right") - 1
    return out


def query(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
