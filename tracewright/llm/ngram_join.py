"""N-gram Jaccard join: which documents have word-shingle sets of Jaccard similarity >= 80 %.

The document by shingle incidence matrix is multiplied with its transpose in blocks, and never in full:

1. Equal rows of the matrix (documents with the same shingle set) become one class, its smallest doc_id
   standing for it.
2. Shingles are ordered by approximate document frequency (a count sketch of fixed size, then the hash),
   rare first.  A pair at the threshold must meet in the first ``n - ceil(t n) + 1`` columns of both
   rows, so only these entries enter the product.
3. In each column block every row meets the column's most central row (the one whose shingles are most
   frequent), not each other row: a family of near copies costs one product a member.  Products are
   exact: overlap counts of the full rows.  Pairs whose sizes alone bound the similarity below the
   threshold are discarded before.
4. Columns with the same rows are one block, weighted.  Rows that are connected by links found so far
   need no more products among themselves.  For the other pairs of a block the sizes, the columns that
   prefixes of such sizes must share (against those counted over all blocks), and the triangle inequality
   of the Jaccard distance on the known distances to the central row discard what cannot link; what is
   left is multiplied exactly.

So every link between documents of different components would be found: components are exact, whatever
the order or the sketch.  Shingles are compared by 64-bit hashes of their words.

* empty or null text, or one of blanks only: the empty set, linked with nothing, its own component;
* fewer than five words: the whole sequence is the one shingle;
* repeated rows or doc_ids: one class (equal sets) or nodes of the same id; each row is returned;
* a null doc_id is its own component (null) and links nothing; empty table: no rows; columns beside
  doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store
from .graph import components
from .text import STEP_BYTES, Words, mix, slices

WORDS = 5
NUMERATOR, DENOMINATOR = 80, 100
SKETCH_BITS = 20
#: Rows from which a column counts as frequent, and how many counters may be.
HOT_ROWS, HOT_COUNTERS = 2000, 4096
#: Ratio of the sizes in one class.
SIZE_CLASS = 1.05
_PART = 1 << 14  # counters a row of the sketch holds while partitions are added up


def _windows(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first): the hash of every window of words, and where each text's begin."""
    words = Words(texts)
    h = words.hashes()
    n = np.where(words.count >= width, words.count - width + 1, np.minimum(words.count, 1))
    first = np.concatenate(([0], np.cumsum(n)))
    doc = np.repeat(np.arange(len(texts)), n)
    at = words.first[:-1][doc] + np.arange(first[-1]) - first[:-1][doc]
    last = words.first[1:][doc]
    padded = np.concatenate((h, np.zeros(width, np.uint64)))
    mixed = np.zeros(len(at), np.uint64)
    for k in range(width):
        mixed = mix(mixed * np.uint64(0x9E3779B97F4A7C15) + np.where(at + k < last, padded[at + k], np.uint64(k + 1)))
    return mixed, first


def _order(doc: np.ndarray, level: np.ndarray | None, h: np.ndarray) -> np.ndarray:
    """The order by document, level (below 256) and hash: one packed key, all three where keys tie."""
    spare = 64 - int(doc[-1]).bit_length() if len(doc) else 64
    key = doc.astype(np.uint64) << np.uint64(spare) if spare < 64 else np.zeros(len(doc), np.uint64)
    if level is not None:
        spare -= 8
        key |= level.astype(np.uint64) << np.uint64(spare)
    key |= h >> np.uint64(64 - spare)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    if (same & (h[order][1:] != h[order][:-1])).any():
        return np.lexsort((h, doc) if level is None else (h, level, doc))
    return order


def shingles(texts: list[bytes], width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): distinct shingle hashes of each text in order of hash, and where each text's begin."""
    mixed, first = _windows(texts, width)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    order = _order(doc, None, mixed)
    mixed = mixed[order]
    new = np.concatenate(([True], (mixed[1:] != mixed[:-1]) | (doc[1:] != doc[:-1]))) if len(mixed) else np.zeros(0, bool)
    return mixed[new], np.searchsorted(doc[new], np.arange(len(texts) + 1))


def _sketch(batches):
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    any_ = False
    for _, texts in slices(batches, step=8 * STEP_BYTES):
        h = np.concatenate([_windows(texts[i : i + 256], WORDS)[0] for i in range(0, len(texts), 256)])
        counts += np.bincount((h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
        any_ = True
    if any_:
        parts = [(i, counts[i : i + _PART]) for i in range(0, len(counts), _PART)]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([np.minimum(c, 2**31 - 1).astype(np.int32).tobytes() for _, c in parts], pa.binary())], names=["part", "counts"])


def _added(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
            total[part] = total.get(part, 0) + np.frombuffer(counts, np.int32).astype(np.int64)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.minimum(c, 2**31 - 1).astype(np.int32).tobytes() for c in total.values()], pa.binary())], names=["part", "counts"])


def frequency_sketch(docs: DataFrame) -> np.ndarray:
    """Approximate document frequencies by hash prefix: 2**SKETCH_BITS counters, whatever the input."""
    parts = docs.select("text").mapInArrow(_sketch, "part int, counts binary")
    rows = parts.repartition((1 << SKETCH_BITS) // _PART, "part").mapInArrow(_added, "part int, counts binary").collect()
    out = np.zeros(1 << SKETCH_BITS, np.int32)
    for r in rows:
        out[r["part"] : r["part"] + _PART] = np.frombuffer(r["counts"], np.int32)
    return out


def prefix_length(n):
    """Columns of a row in which any row at the threshold must meet it."""
    return n - (-(-NUMERATOR * n // DENOMINATOR)) + 1


def _rows(sketch):
    """doc_id, class key, n, prefix entries, centrality of each document."""

    def run(batches):
        counts = sketch.value
        levels = np.minimum(np.log2(np.maximum(counts, 1)) * 8, 255).astype(np.uint8)
        for batch, texts in slices(batches):
            h, first = shingles(texts)
            level = levels[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
            n = np.diff(first)
            doc = np.repeat(np.arange(len(n)), n)
            order = _order(doc, level, h)
            rank = np.arange(len(h)) - first[:-1][doc]
            take = rank < np.where(n > 0, prefix_length(n), 0)[doc]
            prefix = h[order][take].view(np.int64)
            offsets = np.concatenate(([0], np.cumsum(np.bincount(doc[take], minlength=len(n))))).astype(np.int32)
            central = (np.bincount(doc, level, len(n)) / np.maximum(n, 1) * 256).astype(np.int64)
            keys = [hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(keys), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(prefix)), pa.array(central << 32 | n)],
                names=["doc_id", "key", "n", "prefix", "info"],
            )

    return run


def _met(batches):
    """Rows sorted by column and doc_id, repeated ones counting once: those of columns that more than one row has, with the column's centre and, as
    its block, a hash of the set of its rows."""
    held: list[np.ndarray] = []

    def told(column, doc, info):
        new = np.concatenate(([True], (column[1:] != column[:-1]) | (doc[1:] != doc[:-1])))
        column, doc, info = column[new], doc[new], info[new]
        cut = np.flatnonzero(np.concatenate(([True], column[1:] != column[:-1])))
        size = np.diff(np.append(cut, len(column)))
        top = np.maximum.reduceat(info, cut) if len(cut) else info
        run = np.repeat(np.arange(len(cut)), size)
        best = np.where(info == top[run], doc, np.iinfo(np.int64).min)
        centre = np.maximum.reduceat(best, cut) if len(cut) else best
        block = np.bitwise_xor.reduceat(mix(doc.view(np.uint64) + np.uint64(1)), cut).view(np.int64) if len(cut) else column
        take = size[run] > 1
        run = run[take]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (block[run], doc[take], info[take] & 0xFFFFFFFF, centre[run], top[run] & 0xFFFFFFFF)], names=["block", "doc_id", "n", "centre", "n_centre"])

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(c)) for c in ("column", "doc_id", "info")]
        if held:
            columns = [np.concatenate(x) for x in zip(held, columns)]
        last = int(np.searchsorted(columns[0], columns[0][-1]))
        held = [x[last:] for x in columns]
        if last:
            yield told(*[x[:last] for x in columns])
    if held:
        yield told(*held)


def _full_rows(bitmap):
    def run(batches):
        have = bitmap.value
        for batch, texts in slices(batches):
            take = np.flatnonzero(store.hits(have, np.asarray(batch.column("bit"))))
            if len(take):
                h, first = shingles([texts[i] for i in take])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(take)), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h.view(np.int64)))], names=["doc_id", "row"])

    return run


def _needed(a: Column, b: Column) -> Column:
    """Columns that the prefixes of a linked pair of these sizes share at least: of the overlap that the
    threshold asks for, no more than one row's entries beyond its prefix can lie outside of them."""
    beyond = lambda n: F.floor((NUMERATOR * n + DENOMINATOR - 1) / DENOMINATOR) - 1
    both = NUMERATOR + DENOMINATOR
    return F.greatest(F.floor((NUMERATOR * (a + b) + both - 1) / both) - F.greatest(beyond(a), beyond(b)), F.lit(1))


def _large_enough(a: Column, b: Column) -> Column:
    """Sizes alone allow the threshold."""
    return DENOMINATOR * F.least(a, b) >= NUMERATOR * F.greatest(a, b)


def _multiplied(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with n_a, n_b and ``both``, the exact overlap count of their full rows.  Rows are
    made anew from the texts, of the documents in pairs only."""
    context = docs.sparkSession.sparkContext

    def rows(name: str) -> DataFrame:
        bitmap = context.broadcast(store.filter_of(pairs.select(store.filter_bit(name).alias("bit"))))
        return docs.mapInArrow(_full_rows(bitmap), "doc_id long, row array<long>").select(F.col("doc_id").alias(name), F.col("row").alias(f"row_{name}"))

    joined = pairs.transform(store.merged, rows("a"), "a").transform(store.merged, rows("b").transform(store.merged, pairs.select("b").distinct(), "b", "left_semi"), "b")
    return joined.select("a", "b", F.size("row_a").alias("n_a"), F.size("row_b").alias("n_b"), F.size(F.array_intersect("row_a", "row_b")).alias("both"))


def _linked() -> Column:
    return DENOMINATOR * F.col("both") >= NUMERATOR * (F.col("n_a") + F.col("n_b") - F.col("both"))


def _columns(entries: DataFrame, hot: Column) -> DataFrame:
    """(block, doc_id, n, centre, n_centre, weight) of the entries (column, doc_id, info) of columns that
    more than one row has; the centre is the row with the largest info.  Columns with the same rows are one
    block of that weight.  Columns that the sketch says are frequent are aggregated before they are dealt
    out (and are blocks of their own), the others are sorted."""
    few = entries.where(~hot)
    schema = "block long, doc_id long, n long, centre long, n_centre long"
    met = few.repartition("column").sortWithinPartitions("column", "doc_id").mapInArrow(_met, schema)
    many = entries.where(hot).dropDuplicates(["column", "doc_id"])
    of = many.groupBy("column").agg(F.count(F.lit(1)).alias("rows"), F.max(F.struct("info", "doc_id")).alias("top")).where("rows > 1")
    size = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))
    wide = many.transform(store.merged, of, "column").select(F.col("column").alias("block"), "doc_id", size("info").alias("n"), F.col("top.doc_id").alias("centre"), size("top.info").alias("n_centre"))
    return met.unionByName(wide).groupBy("block", "doc_id", "n", "centre", "n_centre").agg(F.count(F.lit(1)).alias("weight"))


def similarity_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs`` (doc_id, text)."""
    spark = store.prepare(docs.sparkSession)
    context = spark.sparkContext
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = frequency_sketch(docs)
    sketch = context.broadcast(counts)
    rows = store.written(docs.mapInArrow(_rows(sketch), "doc_id long, key binary, n long, prefix array<long>, info long"), "ngram-rows")
    usable = rows.where("n > 0 and doc_id is not null")
    classes = store.written(usable.groupBy("key", "n").agg(F.min("doc_id").alias("a")), "ngram-classes")
    entries = usable.transform(store.merged, classes.select("key", F.col("a").alias("doc_id")), ["key", "doc_id"]).select("doc_id", "info", F.explode("prefix").alias("column"))
    # counters far above the rest, few whatever the input
    frequent = np.flatnonzero(counts >= max(HOT_ROWS, int(np.partition(counts, -HOT_COUNTERS)[-HOT_COUNTERS]), 8 * int(counts.mean())))
    counter = F.shiftrightunsigned("column", 64 - SKETCH_BITS)
    entries = store.written(_columns(entries, counter.isin([int(i) for i in frequent]) if len(frequent) else F.lit(False)), "ngram-entries")
    docs = docs.where("doc_id is not null").withColumn("bit", store.filter_bit("doc_id"))
    have = entries.groupBy("doc_id").agg(F.sum("weight").alias("have"))
    entries = store.written(entries.transform(store.merged, have, "doc_id"), "ngram-blocks")
    # first each row with the centre that it shares most columns with
    stars = entries.where(F.col("doc_id") != F.col("centre")).groupBy(F.col("doc_id").alias("a"), F.col("centre").alias("b")).agg(F.sum("weight").alias("columns"), F.first("n").alias("n"), F.first("n_centre").alias("n_centre"))
    stars = store.written(stars.where(_large_enough(F.col("n"), F.col("n_centre")) & (F.col("columns") >= _needed(F.col("n"), F.col("n_centre")))), "ngram-stars")
    best = store.written(stars.groupBy("a").agg(F.max_by("b", F.struct("columns", "b")).alias("b")), "ngram-best")
    products = store.written(_multiplied(best, docs), "ngram-products")
    found = components(products.where(_linked()).select("a", "b"))
    # then each row with its blocks' other centres, where they are of another component
    label = found.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    open_ = stars.select("a", "b").join(best, ["a", "b"], "left_anti").join(label, "a", "left").join(label.withColumnsRenamed({"a": "b", "ca": "cb"}), "b", "left")
    open_ = open_.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    products = products.unionByName(store.written(_multiplied(store.written(open_, "ngram-open"), docs), "ngram-products"))
    found = components(products.where(_linked()).select("a", "b"))
    # what is left: pairs of a block whose components differ, and which neither the sizes, nor the columns
    # that they could share, nor the distances to the centre exclude
    distance = products.groupBy(F.col("a").alias("doc_id"), F.col("b").alias("centre")).agg(F.min(1 - F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))).alias("distance"))
    bound = 1 - F.least("n", "n_centre") / F.greatest("n", "n_centre")
    placed = _mixed(entries, found).transform(store.merged, distance, ["doc_id", "centre"], "left")
    own = F.col("doc_id") == F.col("centre")
    placed = placed.select("block", "doc_id", "n", "have", "weight", "rows", "component", F.when(own, 0.0).otherwise(F.coalesce("distance", bound)).alias("near"), F.when(own, 0.0).otherwise(F.coalesce("distance", F.lit(1.0))).alias("far"))
    rest = store.written(_pairs_left(store.written(placed, "ngram-placed")), "ngram-rest")
    rest = rest.transform(store.merged, products.select("a", "b"), ["a", "b"], "left_anti")
    last = store.written(_multiplied(store.written(rest, "ngram-rest"), docs), "ngram-products").where(_linked())
    found = components(products.where(_linked()).select("a", "b").unionByName(last.select("a", "b")))
    labels = classes.transform(store.merged, found.select(F.col("node").alias("a"), "component"), "a", "left").select("key", F.coalesce("component", "a").alias("component"))
    labels = store.written(labels, "ngram-labels")
    joined = rows.select("doc_id", "key", "n").transform(store.merged, labels, "key", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.least("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _pairs_left(placed: DataFrame) -> DataFrame:
    """(a, b) of rows of different components that neither sizes, columns nor distances exclude.

    Rows meet by size class: the larger one is ``apart`` classes above the smaller.  For such sizes a pair
    must share a known number of columns, so each row keeps, of its blocks in order of their frequency, only
    those before a tail of less than that weight: the rarest block of a pair is always kept by both.
    """
    tail = F.sum("weight").over(Window.partitionBy("doc_id", "n").orderBy(F.desc("rows"), F.desc("block")))
    rows = placed.withColumns({"tail": tail, "class": F.floor(F.log("n") / math.log(SIZE_CLASS)).cast("int")})
    classes = range(math.ceil(math.log(DENOMINATOR / NUMERATOR) / math.log(SIZE_CLASS)) + 1)

    def side(name: str, sign: int) -> DataFrame:
        other = F.col("class") + sign * F.col("apart")
        low = F.greatest(F.floor(F.pow(F.lit(SIZE_CLASS), other)) - 1, F.lit(1))
        high = F.ceil(F.pow(F.lit(SIZE_CLASS), other + 1)) + 1
        needed = F.least(_needed(F.col("n"), low), _needed(F.col("n"), high))
        out = rows.withColumn("apart", F.explode(F.array(*map(F.lit, classes)))).where(F.col("tail") >= needed)
        smaller = F.col("class") if sign > 0 else other
        return out.select("block", "apart", smaller.alias("smaller"), *[F.col(c).alias(f"{c}_{name}") for c in ("doc_id", "n", "have", "component", "near", "far")])

    apart = 1 - NUMERATOR / DENOMINATOR + 1e-9
    met = side("x", 1).transform(store.merged, side("y", -1), ["block", "apart", "smaller"]).where(
        (F.col("component_x") != F.col("component_y"))
        & ((F.col("apart") > 0) | (F.col("component_x") < F.col("component_y")))
        & _large_enough(F.col("n_x"), F.col("n_y"))
        & (F.least("have_x", "have_y") >= _needed(F.col("n_x"), F.col("n_y")))
        & (F.col("near_x") - F.col("far_y") <= apart)
        & (F.col("near_y") - F.col("far_x") <= apart)
    )
    pair = met.select(F.col("doc_id_x").alias("a"), F.col("doc_id_y").alias("b"), "n_x", "n_y").distinct()
    # the columns that such a pair does share, all blocks counted
    own = placed.groupBy("doc_id", "n").agg(F.collect_list(F.struct("block", "weight")).alias("held"))  # no more than a prefix each
    joined = pair.transform(store.merged, own.withColumnsRenamed({"doc_id": "a", "n": "n_x", "held": "held_x"}), ["a", "n_x"]).transform(store.merged, own.withColumnsRenamed({"doc_id": "b", "n": "n_y", "held": "held_y"}), ["b", "n_y"])
    columns = F.aggregate(F.array_intersect("held_x", "held_y"), F.lit(0).cast("long"), lambda total, b: total + b["weight"])
    return joined.where(columns >= _needed(F.col("n_x"), F.col("n_y"))).select("a", "b").distinct()


def _mixed(entries: DataFrame, found: DataFrame) -> DataFrame:
    """``entries`` with their component, of the blocks in which several components meet."""
    placed = entries.transform(store.merged, found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    placed = store.written(placed.withColumn("component", F.coalesce("component", "doc_id")), "ngram-located")
    several = placed.groupBy("block").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("rows")).where("low < high").select("block", "rows")
    return placed.transform(store.merged, several, "block")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one of each component (its smallest doc_id), all columns kept, whatever
    their names.  Documents without words, and rows without a doc_id, are linked with nothing and stay;
    rows that repeat a doc_id stay or go together."""
    spark = docs.sparkSession
    gone = similarity_classes(docs).where("doc_id <> component_id").select("doc_id").distinct()
    gone = store.written(gone, "ngram-gone")
    bitmap = store.filter_of(gone.select(store.filter_bit("doc_id").alias("bit")))
    maybe, own = store.unused(docs, "maybe", "own")
    flagged = docs.withColumn(maybe, F.coalesce(store.in_filter(spark, bitmap, store.filter_bit(F.col("doc_id").cast("long"))), F.lit(False)))
    some = flagged.where(F.col(maybe)).transform(store.merged, gone.select(F.col("doc_id").alias(own)), F.col("doc_id").cast("long") == F.col(own), "left_anti")
    return flagged.where(~F.col(maybe)).select(*docs.columns).unionByName(some.select(*docs.columns))
