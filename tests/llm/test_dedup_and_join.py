import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import exact_dedup, graph, ngram_join, store

from .helpers import HARD, hard, lower, similarity_components


def expected_dedup(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    out = []
    for i, t in rows:
        own = groups[lower(t)]
        keep = max((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_dedup_hard_cases(spark):
    got = sorted((tuple(r) for r in exact_dedup.exact_dedup(hard(spark)).collect()), key=str)
    assert got == expected_dedup([r[:2] for r in HARD])


def test_exact_dedup_documents(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    rows += [(i + 10_000, t.swapcase()) for i, t in rows[:40]] + [(k + 20_000, "hot copy") for k in range(300)]
    got = sorted((tuple(r) for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()), key=str)
    assert got == expected_dedup(rows)


def test_drop_copies_keeps_columns_and_one_of_each(spark):
    df = hard(spark)
    out = exact_dedup.drop_copies(df)
    assert out.columns == df.columns
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert len(kept) == len({lower(t) for _, t in kept}) == len({lower(r[1]) for r in HARD})
    assert {i for i, t in kept if lower(t).startswith("the same")} == {5}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert exact_dedup.exact_dedup(none).collect() == []
    assert ngram_join.similarity_classes(none).collect() == []


@pytest.mark.parametrize("block_bits", [0, 1, 3])
def test_counting_quotient_filter_merges_losslessly(block_bits):
    pick = np.random.default_rng(3)
    values = pick.integers(0, 2**63, 300).astype(np.uint64) * np.uint64(2)
    values[:40] = values[0] + np.arange(40, dtype=np.uint64)  # one run, far longer than its room
    values[40:60] = np.uint64(2**64 - 1) - np.arange(20, dtype=np.uint64)
    parts = [pick.choice(values, n) for n in (200, 30, 1, 1000)]
    blocks = {}
    for p in parts:
        for block, f in exact_dedup.blocks_of(*exact_dedup.sorted_counts(p), block_bits):
            again = exact_dedup.CountingQuotientFilter.unpack(f.pack())
            keys, counts = again.entries()
            own = p[(p >> np.uint64(64 - block_bits)) == block] if block_bits else p
            want = np.unique(own, return_counts=True)
            assert keys.tolist() == want[0].tolist() and counts.tolist() == want[1].tolist()
            assert again.occupied.sum() == again.run_end.sum() and len(again.pack()) < 32 + len(again.slot) * (again.bits + 4) // 8 + 4
            blocks.setdefault(block, []).append(again)
    merged = [exact_dedup.merged_entries(blocks[k]) for k in sorted(blocks)]
    keys, counts = np.unique(np.concatenate(parts), return_counts=True)
    assert np.concatenate([k for k, _ in merged]).tolist() == keys.tolist() and np.concatenate([n for _, n in merged]).tolist() == counts.tolist()


def test_counters_of_any_size():
    keys, counts = np.arange(7, dtype=np.uint64) << np.uint64(50), np.array([1, 2, 255, 256, 2**20, 2**40, 2**62])
    for bits in (1, 20, 57):
        got = exact_dedup.CountingQuotientFilter.unpack(exact_dedup.CountingQuotientFilter.of(keys, counts, bits).pack()).entries() if bits < 21 else exact_dedup.CountingQuotientFilter.of(keys[:1], counts[-1:], 12).entries()
        assert got[1].tolist() == (counts.tolist() if bits < 21 else [2**62])


def joined(spark, rows):
    return sorted((tuple(r) for r in ngram_join.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=str)


def test_similarity_hard_cases(spark):
    got = sorted((tuple(r) for r in ngram_join.similarity_classes(hard(spark)).collect()), key=str)
    assert got == similarity_components([r[:2] for r in HARD])


@pytest.mark.parametrize("seed", range(3))
def test_similarity_families(spark, seed, monkeypatch):
    """Families of near copies around the threshold, with passages that all documents share."""
    pick = random.Random(seed)
    monkeypatch.setattr(ngram_join, "HOT_ROWS", 5)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [pick.choice(vocabulary) for _ in range(30)]
    rows = []
    for family in range(4):
        base = [pick.choice(vocabulary) for _ in range(pick.choice([12, 60, 150]))]
        for _ in range(40):
            text = list(base)
            for _ in range(pick.choice([0, 0, 1, 2, 4, 7])):
                k = pick.randrange(len(text))
                text[k : k + pick.choice([0, 1, 2])] = [pick.choice(vocabulary)] * pick.choice([0, 1, 1])
            at = pick.randrange(len(text))
            rows.append((len(rows) * 7 % 1000, " ".join(text[:at] + passage * (pick.random() < 0.5) + text[at:])))
    assert joined(spark, rows) == similarity_components(rows)


def test_stages_keep_clashing_columns(spark):
    base = " ".join(f"a{k}" for k in range(60))
    rows = [(1, base, True, "s"), (2, base + " b", False, "t"), (3, base.upper(), True, "u"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, maybe boolean, `Own` string").withColumns({"sha": F.lit("x"), "key": F.lit(1), "stays": F.lit(False)})
    out = exact_dedup.drop_copies(df)
    assert out.columns == df.columns and sorted(r["doc_id"] or 0 for r in out.collect()) == [0, 2, 3]
    out = ngram_join.one_of_each(df)
    assert out.columns == df.columns and sorted(r["doc_id"] or 0 for r in out.collect()) == [0, 1]


def test_filters_grow_with_their_keys(spark):
    few = store.filter_of(spark.range(1000).select(store.filter_bit("id").alias("bit")))
    many = store.filter_of(spark.range(400_000).select(store.filter_bit("id").alias("bit")))
    assert 64 * len(few) == store.LEAST_BITS and 64 * len(many) == 1 << 22
    inside = spark.range(500_000).where(store.in_filter(spark, many, store.filter_bit("id")))
    assert inside.where("id < 400000").count() == 400_000 and inside.count() < 420_000


def test_one_of_each(spark):
    base = " ".join(f"a{k}" for k in range(60))
    df = spark.createDataFrame([(3, base, "x"), (1, base + " b", "y"), (2, "other words here", "z"), (9, None, "n"), (10, None, "n")], "doc_id long, text string, key string")
    assert sorted(r["doc_id"] for r in ngram_join.one_of_each(df).collect()) == [1, 2, 9, 10]


def test_components(spark):
    chain = [(k, k + 1) for k in range(0, 60)] + [(500, 400), (400, 300)] + [(1000 + k, 1000) for k in range(50)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, 500: 300, 400: 300, 300: 300, **{1000 + k: 1000 for k in range(50)}}
