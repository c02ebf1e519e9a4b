"""Bootstrap draws against hashlib and plain loops, and how their work is dealt out."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
from tracewright.functions.sha import first_words
from tracewright.operators import resample

from .conftest import SMALL

STRATA = "query_id long, stratum string, value double"


def draw(*names, n):
    return int(hashlib.sha256("|".join(map(str, names)).encode()).hexdigest()[:8], 16) % n


@pytest.mark.parametrize("size", [1, 10, 55, 56, 63, 64, 65, 119, 120, 130])
def test_first_words(size):
    rng = np.random.default_rng(size)
    for differ in ([], [0], [size - 1], list(range(0, size, 3))):
        message = [int(x) for x in rng.integers(0, 256, size)]
        for k in differ:
            message[k] = rng.integers(0, 256, 6).astype(np.uint32)
        texts = [bytes(x if isinstance(x, int) else int(x[i]) for x in message) for i in range(6)]
        assert first_words(message, 6).tolist() == [int(hashlib.sha256(t).hexdigest()[:8], 16) for t in texts]


@pytest.mark.parametrize(("head", "begin", "end", "n"), [("0|en", 0, 1, 1), ("0|en", 5, 130, 7), ("0|", 98, 102, 20_011), ("0|日本", 9_998, 10_002, 9_123), ("0|" + "x" * 70, 0, 64, 150)])
def test_drawn_slots(head, begin, end, n):
    got = defaultdict(list)
    for replicates, slots in resample._drawn_slots(f"{head}|".encode(), begin, end, n):
        for r, row in zip(replicates.tolist(), slots.tolist()):
            got[r] += row
    assert got == {r: [draw(head, r, slot, n=n) for slot in range(n)] for r in range(begin, end)}


def test_bootstrap_of_odd_rows(spark):
    """Unknown values are drawn and left out of the mean; rows without a stratum have no draws."""
    rows = [(7 * i % 101, ["a", "", "b" * 80, None][i % 4], None if i % 5 == 0 else i / 8) for i in range(100)] + [(500, "alone", None)]
    strata = defaultdict(list)
    for _, stratum, value in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        strata[stratum].append(value)
    want = {}
    for r in range(150):
        drawn = [v[draw(5, g, r, slot, n=len(v))] for g, v in strata.items() for slot in range(len(v))]
        known = [x for x in drawn if x is not None]
        want[r] = pytest.approx(sum(known) / len(known))
    frame = spark.createDataFrame(rows, STRATA).repartition(7)
    assert {r["replicate"]: r["mean"] for r in resample.bootstrap(frame, "stratum", "value", 150, "5").collect()} == want
    unknown = spark.createDataFrame([(1, "a", None), (2, "a", None)], STRATA)
    assert [tuple(r) for r in resample.bootstrap(unknown, "stratum", "value", 2).orderBy("replicate").collect()] == [(0, None), (1, None)]
    assert resample.bootstrap(unknown.limit(0), "stratum", "value", 2).collect() == []


def test_draws_are_not_rows(spark):
    """Replicates are dealt over tasks of their own and no draw meets a join, however few the strata."""
    means = resample.bootstrap(spark.range(50).selectExpr("id AS query_id", "'s' AS stratum", "id / 1D AS value"), "stratum", "value", 1_000)
    assert means.rdd.getNumPartitions() == -(-1_000 // resample.REPLICATES_A_TASK)
    assert "Join" not in means._jdf.queryExecution().optimizedPlan().toString()
    assert means.count() == 1_000


@pytest.mark.parametrize("seed", ["0", "5|é"])
def test_draws_in_the_jvm(spark, monkeypatch, seed):
    """The JVM's draws, from a package's jar, are those of the Python workers, in strata of many batches and long names."""
    name = "element_at(array('en', '', '日本', repeat('b', 80)), CASE WHEN id < 20011 THEN 1 ELSE 2 + CAST(id % 3 AS INT) END)"
    frame = spark.range(30_011).selectExpr("id AS query_id", f"{name} AS stratum", "IF(id % 7 = 0, NULL, pmod(hash(id), 1000) / 8D) AS value")
    found = []
    for jvm in (True, False):
        if not jvm:
            monkeypatch.setattr(resample, "_in_jvm", lambda spark: False)
        means = resample.bootstrap(frame, "stratum", "value", 70, seed)
        plan = means._jdf.queryExecution().optimizedPlan().toString()
        assert ("tracewright_replicate_means" in plan, plan.count("MapInArrow")) == ((True, 1) if jvm else (False, 2))
        found.append(dict(map(tuple, means.collect())))
    assert found[0] == pytest.approx(found[1], rel=1e-12) and sorted(found[0]) == list(range(70))


def test_full_paired_bootstrap(spark):
    """All 10,000 replicates, by plain loops; the one join is that of labels with documents."""
    rows = spark.read.parquet(f"{SMALL}/labels.parquet").join(spark.read.parquet(f"{SMALL}/documents.parquet"), "doc_id").orderBy("doc_id").collect()
    strata = defaultdict(list)
    for r in rows:
        strata[r["lang"]].append(r["quality"] - r["toxic"])
    means = np.array([sum(v[draw(0, g, r, slot, n=len(v))] for g, v in strata.items() for slot in range(len(v))) for r in range(10_000)]) / len(rows)
    frame = entry.queries()["paired_bootstrap_full"](spark, SMALL)
    (got,) = frame.collect()
    low, high = np.percentile(means, [2.5, 97.5])
    assert (got["delta"], got["low"], got["high"]) == tuple(pytest.approx(x, abs=2e-9) for x in (means.mean(), low, high))
    assert (got["p_above"], got["p_not_below"], got["direction"]) == ((means > 0).mean(), (means >= 0).mean(), "BETTER" if low > 0 else "WORSE" if high < 0 else "UNDECIDED")
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
