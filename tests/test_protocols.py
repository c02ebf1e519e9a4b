"""Operators that raise, and the growth of fragments against a plain search."""

from collections import deque

import pytest
from pyspark.sql import functions as F

from tracewright.functions import text as fx
from tracewright.operators import graph, protocol, quality, resample


def test_what_must_be_there_is_an_error(spark):
    a, b = spark.createDataFrame([(1, 5), (2, 6)], "k long, x long"), spark.createDataFrame([(1, 7)], "k long, y long")
    assert protocol.aligned(a.where("k = 1"), b, ["k"]).collect() == [(1, 5, 7)]
    for broken in (lambda: protocol.aligned(a, b, ["k"]), lambda: protocol.with_roles(a, b.withColumn("role", F.lit("r")), "k", "role"), lambda: protocol.at_least(a, "k", 2), lambda: spark.createDataFrame([("xy",)], "h string").select(fx.hex_words(F.col("h"), 4))):
        with pytest.raises(Exception):
            broken().collect()
    assert protocol.at_least(a.withColumn("g", F.lit(1)), "g", 2).count() == 2


def test_shortest_paths_and_growth(spark):
    edges = {1: [(1, 2), (2, 3), (3, 4), (1, 5), (5, 4), (4, 6), (6, 7)], 2: [(9, 8)]}
    rows = [(g, a, b) for g, own in edges.items() for a, b in own]
    frame = spark.createDataFrame(rows, "graph long, a long, b long")
    starts = spark.createDataFrame([(1, 1), (2, 8)], "graph long, node long")
    near = {}
    for g, own in edges.items():
        start = {1: 1, 2: 8}[g]
        steps, queue = {start: 0}, deque([start])
        while queue:
            x = queue.popleft()
            for a, b in own + [(b, a) for a, b in own]:
                if a == x and b not in steps:
                    steps[b] = steps[x] + 1
                    queue.append(b)
        near |= {(g, n): s for n, s in steps.items()}
    got = graph.distances(frame, starts, 9).collect()
    assert {(r["graph"], r["node"]): r["steps"] for r in got} == near
    assert {r["node"]: r["before"] for r in got if r["graph"] == 1}[4] == 5
    assert max(r["steps"] for r in graph.distances(frame, starts, 2).collect()) == 2
    hard = spark.createDataFrame([(1, 6), (1, 2), (1, 7), (2, 9)], "graph long, node long")
    roles = {(r["graph"], r["node"]): r["role"] for r in graph.grown(frame, starts, hard, 3, 9).collect()}
    assert roles == {(1, 1): "ANCHOR", (1, 2): "HARD", (1, 6): "HARD", (1, 4): "CONNECTOR", (1, 5): "CONNECTOR", (2, 8): "ANCHOR", (2, 9): "HARD"}


def test_simhash_is_the_plain_sum(spark):
    import hashlib
    from collections import Counter

    rows = [(1, ["a", "b", "a", None]), (2, []), (3, None), (4, ["é"] * 9 + ["x"]), (5, [f"t{k}" for k in range(300)])]
    got = {r["id"]: tuple(r)[1:] for r in quality.simhash128(spark.createDataFrame(rows, "id long, tokens array<string>").repartition(2), "id", "tokens").collect()}
    assert got.keys() == {1, 4, 5}
    for i, tokens in rows:
        if i in got:
            total = [0] * 128
            for token, n in Counter(t or "" for t in tokens).items():
                bits = int.from_bytes(hashlib.sha256(token.encode()).digest()[:16], "big")
                for k in range(128):
                    total[k] += n if bits >> (127 - k) & 1 else -n
            whole = sum((s >= 0) << (127 - k) for k, s in enumerate(total))
            assert got[i] == tuple(whole >> 32 * k & 0xFFFFFFFF for k in (3, 2, 1, 0))


def test_clusters_are_drawn_whole(spark):
    stats = spark.createDataFrame([("a", 1.0)] * 3 + [("b", 0.0)] + [("c", 0.5)] * 2, "source string, value double")
    means = [r["mean"] for r in resample.cluster_bootstrap(stats, "source", "value", 400).collect()]
    sums = {"a": (3.0, 3), "b": (0.0, 1), "c": (1.0, 2)}
    possible = {sum(sums[x][0] for x in draw) / sum(sums[x][1] for x in draw) for draw in [(i, j, k) for i in "abc" for j in "abc" for k in "abc"]}
    assert len(means) == 400 and set(means) <= possible and len(set(means)) == len(possible)


def test_anchor_is_the_unsigned_remainder(spark):
    import hashlib

    rows = spark.range(300).select(F.concat(F.lit("q"), "id").alias("q"), F.transform(F.sequence(F.lit(1), (F.col("id") % 9 + 1).cast("int")), lambda k: k * 10).alias("c"))
    for r in rows.select("q", "c", resample.anchor(F.col("q"), F.col("c")).alias("a")).collect():
        assert r["a"] == sorted(r["c"])[int.from_bytes(hashlib.sha256(r["q"].encode()).digest()[:8], "big") % len(r["c"])]
