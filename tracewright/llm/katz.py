"""LM scoring by Katz backoff over word n-grams (``order``, bigrams unless told otherwise).

Counts are discounted by Good-Turing (counts up to ``DISCOUNTED``); the backoff weight of each history is
the mass left by the discounts over the mass that the lower order gives to words not seen after it, so
every conditional distribution sums to one exactly.  The lowest order is the smoothed unigram
distribution over the training vocabulary and one class of unknown words.  A text's score is the sum of
log10 probabilities of its tokens, evaluated recursively: seen n-gram, else backoff weight times the next
lower order; the first token's history is the beginning of the text, tokens too near it for an order take
the highest one that their history fills, and a history without counts backs off freely.

Tables stay distributed.  A chunk is some megabytes of neighbouring documents; it sends each of its
distinct words, then each of its distinct bigrams, once to the shard that counts them (sorted, packed),
and gets the totals back in the same order, so no text and no table is ever joined token by token.  Each
higher order is one more round of the same kind: its histories are the numbers that the shards of the order
below gave their n-grams, and each n-gram brings its probability in that order.  Shards
hash words by themselves and bigrams by history; a history so frequent that it would fill a shard is
dealt by both of its words, and the sums of such histories (at most ``FREQUENT``) are told to all chunks.
Tasks follow the numbers of chunks and of shards, whatever ``spark.sql.shuffle.partitions`` says, so that
what one task reads does not grow with the input.

* null and empty text: the end token alone; words are as ``text.Words`` has them; words are compared by
  64-bit hashes; a training set without rows gives every token the unknown class;
* a null doc_id counts as '' where folds are dealt; repeated rows: each counts and each is scored;
  empty table: no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from .langid import fold
from .text import Words, release, slices

DISCOUNTED = 5
#: Text of a chunk, and tokens of the input for each shard.
CHUNK_BYTES, SHARD_TOKENS = 12 << 20, 1 << 22
#: Words whose totals every shard is told: a bound on what is broadcast.
FREQUENT = 1 << 16
END = np.uint64(2)  # hashes of words are odd
BEGIN = 0


def pack(values: np.ndarray) -> bytes:
    """Integers, sorted ones as differences, compressed."""
    values = np.asarray(values, np.int64)
    rising = len(values) > 0 and bool((values[1:] >= values[:-1]).all())
    body = np.diff(values, prepend=np.int64(0)) if rising else values
    low, high = (int(body.min()), int(body.max())) if len(body) else (0, 0)
    kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return bytes([rising, np.dtype(kind).itemsize]) + zstandard.compress(body.astype(kind).view(np.uint8).reshape(len(body), np.dtype(kind).itemsize).T.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    kind = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}[data[1]]
    raw = np.frombuffer(zstandard.decompress(data[2:]), np.uint8)
    values = np.ascontiguousarray(raw.reshape(data[1], -1).T).view(kind).ravel().astype(np.int64) if len(raw) else np.zeros(0, np.int64)
    return np.cumsum(values) if data[0] else values


def _chunked(batches, chunk_bytes: int):
    """chunk rows: documents, fold, token counts, and tokens as indices into the chunk's words, which are
    ordered by how often the chunk has them."""
    ids, held, lengths, hashes, size, number = [], [], [], [], 0, TaskContext.get().partitionId() << 32

    def row():
        words, tokens, often = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        order = np.argsort(-often, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        n, flags, doc_ids = np.concatenate(lengths), np.concatenate(held), [i for x in ids for i in x]
        tokens = rank[tokens]
        trained = np.bincount(tokens, np.repeat(~flags, n), len(words))
        present = np.array([i is not None for i in doc_ids])
        out = (number, pack(np.array([i or 0 for i in doc_ids], np.int64)), pack(present), pack(flags), pack(n), pack(tokens), words[order].tobytes(), pack(trained), int(n.sum()))
        return pa.RecordBatch.from_arrays([pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64()) for v in out], names=["chunk", "ids", "present", "held", "lengths", "tokens", "words", "trained", "n"])

    for batch, texts in slices(batches):
        words = Words(texts)
        hashes.append(np.insert(words.hashes(), words.first[1:], END))
        ids.append(batch.column("doc_id").to_pylist())
        held.append(np.asarray(batch.column("held_out")))
        lengths.append(words.count + 1)
        size += sum(map(len, texts)) + 16 * len(texts)
        if size >= chunk_bytes:
            yield row()
            ids, held, lengths, hashes, size, number = [], [], [], [], 0, number + 1
    if ids:
        yield row()


def _word_shard(words: np.ndarray, shards: int) -> np.ndarray:
    return ((words >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)


def _word_requests(shards: int):
    def run(batches):
        for batch in batches:
            for chunk, words, trained in zip(*(batch.column(c).to_pylist() for c in ("chunk", "words", "trained"))):
                w, c = np.frombuffer(words, np.uint64), unpack(trained)
                shard = _word_shard(w, shards)
                order = np.argsort(shard, kind="stable")
                parts = np.split(order, np.searchsorted(shard[order], np.arange(1, shards)))
                rows = [(s, p) for s, p in enumerate(parts) if len(p)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * len(rows), pa.int64()), pa.array([s for s, _ in rows], pa.int32()), pa.array([w[p].tobytes() for _, p in rows], pa.binary()), pa.array([pack(c[p]) for _, p in rows], pa.binary())],
                    names=["chunk", "shard", "keys", "counts"],
                )

    return run


def _word_totals(shards: int, most: int):
    """Of one shard: for every chunk the totals and numbers of its words, frequent words having low
    numbers; and one row with the shard's sums and the totals of the numbers up to ``most``."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        shard = int(group["shard"].iloc[0])
        parts = [np.frombuffer(k, np.uint64) for k in group["keys"]]
        keys, place = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(place, np.concatenate([unpack(c) for c in group["counts"]]), len(keys)).astype(np.int64)
        order = np.argsort(-total, kind="stable")
        number = np.empty(len(total), np.int64)
        number[order] = np.arange(len(total)) * shards + shard + 1  # 0 is BEGIN
        placed = np.split(place, np.cumsum([len(p) for p in parts])[:-1])
        rows = [(chunk, shard, pack(total[p]), pack(number[p]), None, None, None) for chunk, p in zip(group["chunk"], placed)]
        top = order[: -(-(most - shard) // shards)] if shard < most else order[:0]
        rows.append((None, shard, pack(total[top]), None, int((total > 0).sum()), int(total.sum()), len(top)))
        return pd.DataFrame(rows, columns=["chunk", "shard", "totals", "numbers", "types", "sum", "top"]).astype({"chunk": "Int64", "types": "Int64", "sum": "Int64", "top": "Int64"})

    return run


class _Chunk:
    """A chunk with its words' totals and numbers, and its distinct bigrams in order of their numbers."""

    def __init__(self, row: pd.DataFrame, told: pd.DataFrame, shards: int, limit: int, most: int):
        word_shard = unpack(row["shards"].iloc[0])
        self.tokens, self.lengths, held = (unpack(row[c].iloc[0]) for c in ("tokens", "lengths", "held"))
        self.held = held == 1
        self.total, number = np.zeros(len(word_shard), np.int64), np.zeros(len(word_shard), np.int64)
        order = np.argsort(word_shard, kind="stable")
        begin = np.searchsorted(word_shard[order], np.arange(shards + 1))
        for s, t, i in zip(told["shard"], told["totals"], told["numbers"]):
            at = order[begin[s] : begin[s + 1]]
            self.total[at], number[at] = unpack(t), unpack(i)
        order = np.argsort(number, kind="stable")
        rank = np.empty(len(number), np.int64)
        rank[order] = np.arange(len(number))
        self.rank, self.numbers = rank, number[order]
        before = np.concatenate(([-1], rank[self.tokens[:-1]]))
        before[np.cumsum(self.lengths)[:-1]] = -1
        keys, self.place = np.unique((before + 1) * len(number) + rank[self.tokens], return_inverse=True)
        h, w = keys // len(number) - 1, order[keys % len(number)]
        at = np.where(h >= 0, order[h], -1)
        self.history, self.word = np.where(h >= 0, number[at], BEGIN), number[w]
        self.word_total = self.total[w]
        self.count = np.bincount(self.place, np.repeat(~self.held, self.lengths), len(keys)).astype(np.int64)
        frequent = (np.where(h >= 0, self.total[at], limit) >= limit) & (self.history <= most)
        mixed = self.history * 0x9E3779B1 + np.where(frequent, self.word * 0x85EBCA77, 0)
        self.shard = ((mixed ^ (mixed >> 15)) & 0x7FFFFFFF) % shards


class _Level:
    """A chunk's distinct n-grams of a higher order, from those of the order below: ``place`` of each token
    (-1: none), ``low``, the log10 probability below, and ``split``, whether a history is dealt by its words."""

    def __init__(self, chunk: _Chunk, order: int, place: np.ndarray, number: np.ndarray, count: np.ndarray, value: np.ndarray, shards: int, limit: int):
        first = np.repeat(np.cumsum(chunk.lengths) - chunk.lengths, chunk.lengths)
        at = np.flatnonzero(np.arange(len(first)) - first >= order - 2)
        before = place[at - 1]
        ids, of = np.unique(number[before], return_inverse=True)
        keys, own = np.unique(of * len(chunk.numbers) + chunk.rank[chunk.tokens[at]], return_inverse=True)
        self.place = np.full(len(place), -1, np.int64)
        self.place[at] = own
        self.history, self.word = ids[keys // len(chunk.numbers)], chunk.numbers[keys % len(chunk.numbers)]
        self.count = np.bincount(own, np.repeat(~chunk.held, chunk.lengths)[at], len(keys)).astype(np.int64)
        self.low, often = np.zeros(len(keys)), np.zeros(len(keys), np.int64)
        self.low[own], often[own] = value[place[at]], count[before]
        self.split = often >= limit
        mixed = self.history * 0x9E3779B1 + np.where(self.split, self.word * 0x85EBCA77, 0)
        self.shard = ((mixed ^ (mixed >> 15)) & 0x7FFFFFFF) % shards


def _requests(shards: int, limit: int, most: int):
    """Of one chunk: its bigrams, to the shards that count them."""

    def run(key, row: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(row):
            c = _Chunk(row, told, shards, limit, most)
            order = np.argsort(c.shard, kind="stable")
            for s, p in enumerate(np.split(order, np.searchsorted(c.shard[order], np.arange(1, shards)))):
                if len(p):
                    rows.append((key[0], s, pack(c.history[p]), pack(c.word[p]), pack(c.count[p]), pack(c.word_total[p][c.word[p] > most])))
        release()
        return pd.DataFrame(rows, columns=["chunk", "shard", "histories", "words", "counts", "rare"])

    return run


_STATS = DISCOUNTED + 2  # tokens after a history, words that follow it 1, 2, ... times, and their mass


_TOTALS = "chunk long, shard int, totals binary, stats binary, grams binary, histories binary, words binary, counts_of_counts array<long>, often array<struct<h:long,s:array<double>>>"


def _gram_totals(shards: int, frequent, limit: int, order: int, last: bool):
    """Of one shard: for every chunk its n-grams' totals, their numbers unless this order is the last and,
    for each of its histories, what follows in training; and one row with the shard's table of counts."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        shard = int(group["shard"].iloc[0])
        h, w = ([unpack(x) for x in group[k]] for k in ("histories", "words"))
        if order == 2:
            top = frequent.value
            most = len(top) - 1
            totals = []
            for words, rare in zip(w, group["rare"]):
                t = top[np.minimum(words, most)]
                t[words > most] = unpack(rare)
                totals.append(2 * t + 1)
        else:
            totals = []
            for counts, low in zip(group["counts"], group["low"]):  # only what is counted has a mass
                counted = unpack(counts) > 0
                totals.append(np.zeros(len(counted)))
                totals[-1][counted] = 10.0 ** np.frombuffer(zstandard.decompress(low))
        hh, ww = np.concatenate(h), np.concatenate(w)
        by = np.lexsort((ww, hh))
        hs, ws = hh[by], ww[by]
        new = np.concatenate(([True], (hs[1:] != hs[:-1]) | (ws[1:] != ws[:-1])))
        place = np.empty(len(hh), np.int64)
        place[by] = np.cumsum(new) - 1
        hs, ws = hs[new], ws[new]
        total = np.bincount(place, np.concatenate([unpack(c) for c in group["counts"]]), len(hs)).astype(np.int64)
        if order == 2:
            mass = np.where(total > 0, np.concatenate(totals)[by][new], 0)
        else:
            mass = np.zeros(len(hs))
            np.maximum.at(mass, place, np.concatenate(totals))
        histories, of = np.unique(hs, return_inverse=True)
        if order == 2:
            part = (histories == BEGIN) | ((histories <= most) & (top[np.minimum(histories, most)] >= limit))
        else:
            part = np.zeros(len(histories), bool)
            part[of] = np.concatenate([unpack(x) for x in group["split"]])[by][new] == 1
        del hh, ww, by, totals
        add = lambda x: np.bincount(of, x, len(histories))  # noqa: E731  counts are exact below 2**53
        stats = np.stack([add(total), *(add(total == r) for r in range(1, DISCOUNTED + 1)), add(mass)])
        packed = stats.astype(np.int64)
        rows = []
        for chunk, own, at in zip(group["chunk"], h, np.split(place, np.cumsum([len(x) for x in h])[:-1])):
            i = np.searchsorted(histories, own[np.concatenate(([True], own[1:] != own[:-1]))])
            parts = list(packed[:, i])
            if order > 2:  # the mass of histories that will back off
                parts[-1] = stats[-1, np.unique(of[at[total[at] == 0]])].view(np.int64)
            grams = None if last else pack(at * shards + shard + 1)
            rows.append((chunk, shard, pack(total[at]), b"".join(len(x).to_bytes(4, "big") + x for x in map(pack, parts)), grams, None, None, None, None))
        seen = total > 0
        often = [(int(k), x) for k, x in zip(histories[part], stats[:, part].T.tolist())]
        rows.append((None, shard, pack(total[seen]), None, None, pack(hs[seen]), pack(ws[seen]), [int((total == r).sum()) for r in range(1, DISCOUNTED + 2)], often))
        release()
        return pd.DataFrame(rows, columns=["chunk", "shard", "totals", "stats", "grams", "histories", "words", "counts_of_counts", "often"]).astype({"chunk": "Int64"})

    return run


def discounts(n: list[int]) -> np.ndarray:
    """Factor for each count up to DISCOUNTED (index 0 unused), from counts of counts n[0] = N_1, ...:
    Good-Turing with Katz's renormalisation; 1 where the counts of counts do not allow it."""
    out = np.ones(DISCOUNTED + 1)
    top = (DISCOUNTED + 1) * n[DISCOUNTED] / n[0] if n[0] else 1.0
    for r in range(1, DISCOUNTED + 1):
        if n[r - 1] and top < 1:
            d = ((r + 1) * n[r] / (r * n[r - 1]) - top) / (1 - top)
            out[r] = d if 0 < d <= 1 else out[r]
    if out[1:].min() == 1.0:  # too little to estimate from: some mass must be left all the same
        out[1] = 0.5
    return out


def _values(level, order: int, low: np.ndarray, whole: float, shards: int, grams: pd.DataFrame, d: np.ndarray, often):
    """Totals of a chunk's n-grams, their numbers (none at the last order) and log10 probabilities."""
    change = np.concatenate(([True], level.history[1:] != level.history[:-1]))[: len(level.history)]
    of, histories = np.cumsum(change) - 1, level.history[change]
    count, number = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
    stats = np.zeros((_STATS, len(histories)))
    by = np.argsort(level.shard, kind="stable")
    begin = np.searchsorted(level.shard[by], np.arange(shards + 1))
    for s, totals, packed, own in zip(grams["shard"], grams["totals"], grams["stats"], grams["grams"]):
        p = by[begin[s] : begin[s + 1]]
        count[p] = unpack(totals)
        if own is not None:
            number[p] = unpack(own)
        mine, at = np.unique(of[p]), 0
        for k in range(_STATS):
            size = int.from_bytes(packed[at : at + 4], "big")
            x = unpack(packed[at + 4 : at + 4 + size])
            if order > 2 and k == _STATS - 1:
                stats[k, np.unique(of[p[count[p] == 0]])] += x.view(np.float64)
            else:
                stats[k, mine] += x
            at += 4 + size
    numbers, sums = often.value
    at = np.minimum(np.searchsorted(numbers, histories), len(numbers) - 1)
    whole_sums = numbers[at] == histories
    stats[:, whole_sums] = sums[:, at[whole_sums]]
    after, mass = stats[0], 0.5 * stats[-1] / whole if order == 2 else stats[-1]
    kept = after - ((1 - d[1:])[:, None] * np.arange(1, DISCOUNTED + 1)[:, None] * stats[1:-1]).sum(0)
    # a history whose followers are all beyond the discounted counts leaves nothing: one count is set aside
    aside = ((after > 0) & (after - kept <= 1e-9)).astype(np.int64)
    left = np.where(after > 0, 1 - kept / np.maximum(after + aside, 1), 1.0)
    weight = np.log10(left) - np.log10(np.maximum(1 - mass, 1e-300))
    value = weight[of] + low
    seen = count > 0
    n = count[seen]
    value[seen] = np.log10(d[np.where(n <= DISCOUNTED, n, 0)] * n) - np.log10((after + aside)[of[seen]])
    return count, number, value


def _evaluated(row: pd.DataFrame, answers: pd.DataFrame, shards: int, limit: int, most: int, whole: float, orders: list):
    """A chunk, its n-grams of the highest order answered, each token's place among them, their totals,
    numbers and log10 probabilities, and each token's log10 probability."""
    chunk = _Chunk(row, answers[answers["order"] == 1], shards, limit, most)
    level, place, low = chunk, chunk.place, np.log10((chunk.word_total + 0.5) / whole)
    out = np.zeros(len(place))
    count = number = value = None
    for order, (d, often) in enumerate(orders, 2):
        if order > 2:
            level = _Level(chunk, order, place, number, count, value, shards, limit)
            place, low = level.place, level.low
        count, number, value = _values(level, order, low, whole, shards, answers[answers["order"] == order], d, often)
        out = np.where(place >= 0, value[place], out) if len(value) else out
    return chunk, place, count, number, value, out


def _higher_requests(shards: int, limit: int, most: int, whole: float, orders: list):
    """Of one chunk: its n-grams of the order above ``orders``, to the shards that count them."""

    def run(key, row: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(row):
            chunk, place, count, number, value, _ = _evaluated(row, answers, shards, limit, most, whole, orders)
            c = _Level(chunk, len(orders) + 2, place, number, count, value, shards, limit)
            order = np.argsort(c.shard, kind="stable")
            for s, p in enumerate(np.split(order, np.searchsorted(c.shard[order], np.arange(1, shards)))):
                if len(p):
                    rows.append((key[0], s, pack(c.history[p]), pack(c.word[p]), pack(c.count[p]), zstandard.compress(c.low[p][c.count[p] > 0].tobytes(), 1), pack(c.split[p])))
        release()
        return pd.DataFrame(rows, columns=["chunk", "shard", "histories", "words", "counts", "low", "split"])

    return run


def _scores(shards: int, limit: int, most: int, whole: float, orders: list, base_n: int):
    """Of one chunk: its documents' scores."""

    def run(key, row: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(row):
            return pd.DataFrame({c: [] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")})
        c, *_, value = _evaluated(row, answers, shards, limit, most, whole, orders)
        first = np.cumsum(c.lengths) - c.lengths
        add = lambda x: np.add.reduceat(x, first)
        ids, present = unpack(row["ids"].iloc[0]), unpack(row["present"].iloc[0]) == 1
        doc_ids = pd.array(ids, "Int64")
        doc_ids[~present] = pd.NA
        release()
        return pd.DataFrame(
            {
                "doc_id": doc_ids,
                "held_out": c.held,
                "n_tokens": c.lengths,
                "n_known": add((c.total > 0)[c.tokens].astype(np.int64)),
                "train_tokens": base_n,
                "base_score": add(np.log10((c.total + 0.5) / whole)[c.tokens]),
                "score": add(value),
            }
        )

    return run


def score(docs: DataFrame, held_out: Column | None = None, chunk_bytes: int = CHUNK_BYTES, most: int = FREQUENT, order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``
    (doc_id, text); rows that are ``held_out`` are scored and not learnt from.  ``order`` is 2 or more."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark = store.prepare(docs.sparkSession)
    held = fold(F.col("doc_id"), 5) == 1 if held_out is None else held_out
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", held)
    schema = "chunk long, ids binary, present binary, held binary, lengths binary, tokens binary, words binary, trained binary, n long"
    chunks = store.written(docs.mapInArrow(lambda batches: _chunked(batches, chunk_bytes), schema), "katz-chunks")
    tokens, number = chunks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(least, math.ceil(tokens / SHARD_TOKENS))
    # twice as many partitions as keys: few keys share one
    by_shard = lambda df: df.repartition(2 * shards, "shard").groupBy("shard")
    by_chunk = lambda df: df.repartition(max(least, 2 * number), "chunk").groupBy("chunk")
    asked = chunks.select("chunk", "words", "trained").mapInArrow(_word_requests(shards), "chunk long, shard int, keys binary, counts binary")
    words = store.written(by_shard(asked).applyInPandas(_word_totals(shards, most), "chunk long, shard int, totals binary, numbers binary, types long, sum long, top long"), "katz-words")
    base_n = base_v = 0
    frequent = np.zeros(most + 1, np.int64)
    for r in words.where("chunk is null").collect():  # a row a shard; ``most`` totals in all
        base_v, base_n = base_v + r["types"], base_n + r["sum"]
        frequent[r["shard"] + 1 :: shards][: r["top"]] = unpack(r["totals"])
    limit = max(64, base_n // min(4 * shards, FREQUENT))  # so at most FREQUENT words are that frequent
    told = words.where("chunk is not null").select("chunk", "shard", "totals", "numbers")

    def word_shards(batches):
        for batch in batches:
            own = [pack(_word_shard(np.frombuffer(w, np.uint64), shards)) for w in batch.column("words").to_pylist()]
            keep = ["chunk", "ids", "present", "held", "lengths", "tokens"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(own, pa.binary())], names=[*keep, "shards"])

    lean = chunks.mapInArrow(word_shards, "chunk long, ids binary, present binary, held binary, lengths binary, tokens binary, shards binary")
    asked = by_chunk(lean).cogroup(by_chunk(told)).applyInPandas(_requests(shards, limit, most), "chunk long, shard int, histories binary, words binary, counts binary, rare binary")
    whole = base_n + 0.5 * (base_v + 1)
    orders: list = []
    answers = told.select("chunk", "shard", F.lit(1).alias("order"), "totals", "numbers", *[F.lit(None).cast("binary").alias(c) for c in ("stats", "grams")])
    shared = spark.sparkContext.broadcast(frequent)
    for m in range(2, order + 1):
        if m > 2:
            schema = "chunk long, shard int, histories binary, words binary, counts binary, low binary, split binary"
            asked = by_chunk(lean).cogroup(by_chunk(answers)).applyInPandas(_higher_requests(shards, limit, most, whole, list(orders)), schema)
        grams = store.written(by_shard(asked).applyInPandas(_gram_totals(shards, shared, limit, m, m == order), _TOTALS), f"katz-{m}-grams")
        orders.append(_told(grams))
        own = grams.where("chunk is not null").select("chunk", "shard", F.lit(m).alias("order"), "totals", F.lit(None).cast("binary").alias("numbers"), "stats", "grams")
        answers = answers.unionByName(own)
    result = by_chunk(lean).cogroup(by_chunk(answers))
    return result.applyInPandas(_scores(shards, limit, most, whole, orders, base_n), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _told(grams: DataFrame):
    """Discounts of an order, and the sums of its frequent histories, which are dealt to many shards."""
    n = [0] * (DISCOUNTED + 1)
    for r in grams.where("chunk is null").select(F.posexplode("counts_of_counts").alias("r", "n")).groupBy("r").agg(F.sum("n").alias("n")).collect():
        n[r["r"]] = r["n"]
    sums = grams.where("chunk is null").select(F.inline("often")).groupBy("h").agg(*[F.sum(F.col("s")[k]).alias(f"s{k}") for k in range(_STATS)]).orderBy("h").toPandas()
    told = (sums["h"].to_numpy(np.int64), sums.drop(columns="h").to_numpy(np.float64).T.copy()) if len(sums) else (np.array([-1]), np.zeros((_STATS, 1)))
    return discounts(n), grams.sparkSession.sparkContext.broadcast(told)
