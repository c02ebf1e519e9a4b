"""Hand-made cases of the boundary semantics."""

import itertools

import pytest
from pyspark.sql import functions as F

from tracewright.functions import text as fx
from tracewright.operators import assign, distance, graph, metrics, quality, resample
from tracewright.params import THRESHOLD, Method


def test_single_precision_threshold(spark):
    rows = spark.range(1).select(F.array(*[F.lit(float(b)) for b in (50, 51)]).alias("b")).select(F.explode("b").alias("b"))
    d = rows.withColumn("d", (F.col("b") / 384).cast("float").cast("double")).withColumn("ok", distance.eligible(F.col("d"), THRESHOLD["CODE_BINARY"]))
    assert {r["b"]: r["ok"] for r in d.collect()} == {50.0: True, 51.0: False}


def test_exact_only(spark):
    d = spark.createDataFrame([(0.0,), (0.001,)], "d double").select("d", distance.eligible(F.col("d"), 0.0).alias("ok"), distance.cost(F.col("d"), F.lit(0.0), 0.0).alias("cost"))
    assert [tuple(r) for r in d.collect()] == [(0.0, True, 0.0), (0.001, False, 0.75)]


def test_missing_parent_is_one_and_blocks_agree(spark):
    nodes = spark.createDataFrame([(1, 10, 5), (1, 11, 7)], "query_id long, node_id long, w long")
    gallery = spark.createDataFrame([(1, 5), (1, 4), (2, 0)], "parent int, w long")
    one = distance.parent_minima(nodes, gallery, {"w": 32}, blocks=1).collect()
    assert sorted(one) == sorted(distance.parent_minima(nodes, gallery, {"w": 32}, blocks=5).collect())
    assert {(r["node_id"], r["parent"]): r["d_w"] * 32 for r in one} == {(10, 1): 0, (10, 2): 2, (11, 1): 1, (11, 2): 3}


def brute(costs, pool, nodes, penalty):
    best = None
    for k in range(4):
        for s in itertools.combinations(range(len(pool)), k):
            total = sum(min([costs[n, pool[i]] for i in s if (n, pool[i]) in costs and costs[n, pool[i]] <= 1] or [1.0]) for n in nodes) + penalty * k
            key = (round(total, 9), k, s + (-1,) * (3 - k))
            best = min(best, key) if best else key
    return best[0], best[1], [pool[i] if i >= 0 else None for i in best[2]]


@pytest.mark.parametrize("seed", range(4))
def test_solver_is_brute_force(spark, seed):
    import random

    pick = random.Random(seed)
    pool = pick.sample(range(20), 10)
    costs = {(n, p): pick.choice([0.1, 0.2, 0.4, 0.6, 0.9, 1.2]) for n in range(7) for p in pool if pick.random() < 0.7}
    table = spark.createDataFrame([(1, n, p, True, c) for (n, p), c in costs.items()] + [(1, n, 99, False, 0.5) for n in range(7)], "query_id long, node_id long, parent int, eligible boolean, cost double")
    ranked = spark.createDataFrame([(1, p, i + 1) for i, p in enumerate(pool)], "query_id long, parent int, rank int")
    got = assign.solve(table, ranked, Method()).first()
    assert (got["objective"], got["k"], [got["p1"], got["p2"], got["p3"]]) == brute(costs, pool, range(7), 0.5)


@pytest.mark.parametrize("cost, size, objective", [(0.6, 0, 7.0), (0.4, 1, 6.9)])
def test_parent_pays_for_itself(spark, cost, size, objective):
    table = spark.createDataFrame([(1, n, 5, n == 0, cost) for n in range(7)], "query_id long, node_id long, parent int, eligible boolean, cost double")
    ranked = spark.createDataFrame([(1, 5, 1)], "query_id long, parent int, rank int")
    got = assign.solve(table, ranked, Method()).first()
    assert (got["k"], got["objective"]) == (size, pytest.approx(objective))


def test_ties_go_to_the_smaller_parent(spark):
    table = spark.createDataFrame([(1, 1, 9, True, 0.3), (1, 1, 4, True, 0.3), (1, 2, 4, False, 0.1)], "query_id long, node_id long, parent int, eligible boolean, cost double")
    assert {r["node_id"]: r["parent"] for r in assign.independent(table).collect()} == {1: 4, 2: None}


def test_unknown_counts_as_one_label_and_empty_sets(spark):
    pairs = spark.createDataFrame([(1, 1, None), (1, None, None), (2, None, None)], "query_id long, truth int, predicted int")
    zero = {r["query_id"]: r for r in metrics.set_metrics(pairs).collect()}
    assert (zero[1]["k_true"], zero[1]["k_found"], zero[2]["f1"]) == (2, 1, 0.0)
    assert {r["query_id"]: r["f1"] for r in metrics.set_metrics(pairs, "one").collect()}[2] == 1.0


def test_simhash_and_shapes(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "a"]), (2, [])], "id long, tokens array<string>")
    assert [r["id"] for r in quality.simhash128(rows, "id", "tokens").collect()] == [1]
    s = spark.createDataFrame([("",), ("a:b/c",), ("http://x",), ("0123456789abcdef",), ("a.B.c",)], "s string").select(fx.string_shape(F.col("s")))
    assert [r[0] for r in s.collect()] == ["EMPTY", "RESOURCE_ID", "URL", "HEX", "QUALIFIED_ID"]


def test_paths_and_versions(spark):
    df = spark.createDataFrame([("a\\b\\C$1.class", "V1.2_Beta"), ("META-INF/x.json", "refs/tags/v3")], "p string, v string")
    got = df.select(fx.basename(F.col("p")), fx.outer_class(F.col("p")), fx.modality(F.col("p")), fx.normal_version(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [("C$1.class", "C", "CODE_BINARY", "12beta"), ("x.json", "", None, "3")]


def test_unique_resolution_and_components(spark):
    refs = spark.createDataFrame([(1, "k"), (1, "two")], "source long, key string")
    targets = spark.createDataFrame([("k", "p"), ("k", "p"), ("two", "a"), ("two", "b")], "key string, path string")
    assert {r["key"]: r["path"] for r in graph.unique_resolve(refs, targets).collect()} == {"k": "p", "two": None}
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    assert {(r["node"], r["component"]) for r in graph.connected_components(chain).collect()} == {(i, 1) for i in range(1, 41)} | {(100, 100), (101, 100)}


def test_bootstrap_of_a_constant(spark):
    rows = spark.createDataFrame([(i, "s" if i % 2 else "t", 2.5) for i in range(10)], "query_id long, stratum string, value double")
    assert {r["mean"] for r in resample.bootstrap(rows, "stratum", "value", 20).collect()} == {2.5}
