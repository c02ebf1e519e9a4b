"""Queries of the whole job, which have no SQL, against brute force."""

import hashlib
import itertools
from collections import defaultdict
from statistics import mean

import pytest

import __spark_entry__ as entry
from tracewright.operators import graph
from tracewright.plans import catalogue
from tracewright.sources.tables import Tables

from .conftest import SMALL


def full(spark, name):
    return entry.queries()[name](spark, SMALL).collect()


def test_full_pool_and_sets(spark):
    tab = [r for r in catalogue.table(Tables(spark, SMALL)).collect()]
    cost, score = defaultdict(dict), defaultdict(list)
    for r in tab:
        score[r["query_id"], r["parent"]].append(r["cost"])
        cost[r["query_id"]].setdefault(r["node_id"], {})
        if r["eligible"] and r["cost"] <= 1:
            cost[r["query_id"]][r["node_id"]][r["parent"]] = r["cost"]
    ranked = defaultdict(list)
    for (q, p), costs in score.items():
        ranked[q].append((round(mean(sorted(costs)[:3]), 9), p))
    pools = {q: [p for _, p in sorted(x)[:10]] for q, x in ranked.items()}
    assert max(map(len, pools.values())) > 5
    got = defaultdict(list)
    for r in sorted(full(spark, "candidate_pool_full"), key=lambda r: r["rank"]):
        got[r["query_id"]].append(r["parent"])
    assert dict(got) == pools
    best = {}
    for q, pool in pools.items():
        sets = [s for k in range(4) for s in itertools.combinations(range(len(pool)), k)]
        total = lambda s: round(sum(min([c[pool[i]] for i in s if pool[i] in c] or [1.0]) for c in cost[q].values()) + 0.5 * len(s), 9)  # noqa: B023, E731
        objective, _, s = min((total(s), len(s), s) for s in sets)
        best[q] = (objective, [pool[i] for i in s] + [None] * (3 - len(s)))
    assert {r["query_id"]: (r["objective"], [r["p1"], r["p2"], r["p3"]]) for r in full(spark, "parent_set_solver_full")} == best


def test_full_bootstrap_draws_ten_thousand(spark):
    strata = defaultdict(list)
    for r in sorted(catalogue.stats(Tables(spark, SMALL)).collect(), key=lambda r: r["query_id"]):
        strata[r["stratum"]].append(r["value"])
    draw = lambda g, i, slot, n: int(hashlib.sha256(f"0|{g}|{i}|{slot}".encode()).hexdigest()[:8], 16) % n
    means = sorted(mean(v[draw(g, i, slot, len(v))] for g, v in strata.items() for slot in range(len(v))) for i in range(10_000))
    at = lambda p: means[int(p * 9999)] + (p * 9999 % 1) * (means[int(p * 9999) + 1] - means[int(p * 9999)])
    (got,) = full(spark, "bootstrap_ci_full")
    assert (got["mean"], got["low"], got["high"]) == tuple(pytest.approx(x, abs=2e-9) for x in (mean(means), at(0.025), at(0.975)))


def test_components_of_a_long_chain(spark):
    n = 60
    chain = spark.createDataFrame([(i, i + 1) for i in range(2, n)] + [(n, 1)], "a long, b long")  # the least node is at the far end
    assert {(r["node"], r["component"]) for r in graph.connected_components(chain).collect()} == {(i, 1) for i in range(1, n + 1)}


def test_graphs_of_all_of_lineitem(spark):
    pairs = {tuple(r) for r in spark.read.parquet(f"{SMALL}/lineitem.parquet").select("l_partkey", "l_suppkey").collect()}
    degree, root = defaultdict(int), {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        b += 1000000000
        degree[a] += 1
        degree[b] += 1
        low, high = sorted((find(a), find(b)))
        root[high] = low
    assert {r["node"]: r["component"] for r in full(spark, "connected_components")} == {x: find(x) for x in root}
    assert {r["node"]: r["degree"] for r in full(spark, "graph_degrees_full")} == dict(degree)
    thin = {(r["a"], r["b"]) for r in full(spark, "edge_corruption_full")}
    assert thin <= pairs and len(thin) == sum(d - int(0.3 * d) for x, d in degree.items() if x < 1000000000)
