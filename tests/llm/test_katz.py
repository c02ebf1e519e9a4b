"""Katz scores against a direct computation, and exact normalisation."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tracewright.llm import katz


def direct(rows, order=2):
    """{doc_id: (n_tokens, n_known, N, base, score)} and the conditional probability function."""
    docs = {i: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for i, t in rows}
    train = {i for i in docs if zlib.crc32(str(i).encode()) % 5 != 1}
    uni, grams = Counter(), {m: defaultdict(Counter) for m in range(2, order + 1)}

    def histories(t):
        """Of each token the history of the highest order that fits."""
        padded = ["<s>", *t]
        return [tuple(padded[max(0, k + 2 - order) : k + 1]) for k in range(len(t))]

    for i in train:
        uni.update(docs[i])
        for h, w in zip(histories(docs[i]), docs[i]):
            for m in range(2, len(h) + 2):
                grams[m][h[1 - m :]][w] += 1
    n, v = sum(uni.values()), len(uni)
    d = {}
    for m, own in grams.items():
        counts = Counter(c for x in own.values() for c in x.values())
        d[m] = katz.discounts([counts[r] for r in range(1, katz.DISCOUNTED + 2)])

    def p(w, h):
        if not h:
            return (uni[w] + 0.5) / (n + 0.5 * (v + 1))
        own = grams[len(h) + 1].get(h, {})
        after = sum(own.values())
        if not after:
            return p(w, h[1:])
        cut = lambda c: d[len(h) + 1][c] * c if c <= katz.DISCOUNTED else c
        kept = sum(cut(c) for c in own.values())
        whole = after + (after - kept <= 1e-9)
        if w in own:
            return cut(own[w]) / whole
        return (1 - kept / whole) / (1 - sum(p(x, h[1:]) for x in own)) * p(w, h[1:])

    out = {i: (len(t), sum(uni[w] > 0 for w in t), n, sum(math.log10(p(w, ())) for w in t), sum(math.log10(p(w, h)) for h, w in zip(histories(t), t))) for i, t in docs.items()}
    return out, p, uni


def check(spark, rows, **how):
    got = {r["doc_id"]: tuple(r)[2:] for r in katz.score(spark.createDataFrame(rows, "doc_id long, text string"), **how).collect()}
    want, p, uni = direct(rows, how.get("order", 2))
    assert got.keys() == want.keys()
    for i in want:
        assert got[i] == pytest.approx(want[i], rel=1e-9), i
    return p, uni


def test_equal_to_direct(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.limit(120).collect()] + [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "A a\tb")]
    p, uni = check(spark, rows)
    for h in ["<s>", "the", "a", "nowhere"]:
        assert sum(p(w, (h,)) for w in uni) + p("no such word", (h,)) == pytest.approx(1)


def test_small_chunks_and_shards(spark, documents):
    rows = [(r["doc_id"], r["text"][:400]) for r in documents.limit(60).collect()]
    check(spark, rows, chunk_bytes=3000, most=7)


@pytest.mark.parametrize("order", [3, 4])
def test_higher_orders(spark, documents, order):
    rows = [(r["doc_id"], r["text"][:600]) for r in documents.limit(60).collect()] + [(10**6, None), (10**6 + 1, "a"), (10**6 + 2, "a b a b a b " * 90)]
    p, uni = check(spark, rows, order=order, chunk_bytes=9000, most=7)
    for h in [("<s>", "a"), ("a", "b"), ("b", "nowhere")]:
        assert sum(p(w, h) for w in uni) + p("no such word", h) == pytest.approx(1)


def test_higher_order_of_little(spark):
    rows = [(0, None), (2, ""), (3, "one")]
    check(spark, rows, order=4)
    assert katz.score(spark.createDataFrame([], "doc_id long, text string"), order=3).collect() == []
    with pytest.raises(ValueError):
        katz.score(spark.createDataFrame(rows, "doc_id long, text string"), order=1)


def test_empty_and_null(spark):
    assert katz.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    out = katz.score(spark.createDataFrame([(None, "a b"), (3, None), (3, None)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] is None, r["n_tokens"]) for r in out) == [(False, 1), (False, 1), (True, 3)]


def test_packing():
    for x in ([], [5], [1, 1, 9, 400], [-3, 2**40, 7], list(range(1000))):
        assert katz.unpack(katz.pack(np.array(x, np.int64))).tolist() == x
