"""run() against its stages done plainly, on a fixture."""

import math
import re

import corpus_pipeline
from tracewright.llm import langid, pieces

from .helpers import BLANKS, hard, lower, plain_targets, similarity_components

SMALL = "/root/testdata/sf0.001"


def test_run(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {r["doc_id"]: r for r in langid.keep_known(docs).collect()}
    assert len(kept) > 0.97 * docs.count()
    last = {}
    for i, r in sorted(kept.items()):
        last[lower(r["text"])] = i
    kept = {i: kept[i] for i in last.values()}
    near = {i: c for i, _, c in similarity_components([(i, r["text"]) for i, r in kept.items()])}
    kept = {i: r for i, r in kept.items() if near[i] == i}
    sizes = {}
    for r in kept.values():
        sizes["1" + r["source"]] = sizes.get("1" + r["source"], 0) + len(re.findall(BLANKS, r["text"]))
    wanted = plain_targets(sizes)
    out = corpus_pipeline.run(spark, SMALL).collect()
    assert {r["doc_id"] for r in out} <= set(kept) and all(r["round_trip"] for r in out)
    taken = {}
    for r in out:
        own = kept[r["doc_id"]]
        taken["1" + own["source"]] = taken.get("1" + own["source"], 0) + len(re.findall(BLANKS, own["text"]))
    for k, w in wanted.items():
        own = sorted(len(re.findall(BLANKS, r["text"])) for r in kept.values() if "1" + r["source"] == k)
        sums = {0}
        for n in own:
            sums |= {s + n for s in sums}
        times = min(int(w // sizes[k]), 2)
        rest = math.floor(w - times * sizes[k] + 0.5)
        best = min(abs(s - rest) for s in sums) if times < 2 else 0
        assert abs(taken.get(k, 0) - times * sizes[k] - (rest if times < 2 else 0)) <= max(best, own[0]), k
    encoder = pieces.Encoder(pieces.Vocabulary(pieces.load()))
    assert all(encoder.decode(encoder.encode([kept[r["doc_id"]]["text"].encode()])[0]).decode() == kept[r["doc_id"]]["text"] for r in out[:20])


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns


def test_stages_on_hard_rows_and_none(spark):
    docs = hard(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == docs.count()
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SMALL).count() == 0
    kept = [r["doc_id"] for r in corpus_pipeline.STAGES[0][1](spark, docs, SMALL).collect()]
    assert not {1, 2, 3, 11} & set(kept)  # null, empty, blanks, no letter
    assert sorted(r["doc_id"] for r in corpus_pipeline.STAGES[1][1](spark, docs, SMALL).collect() if r["doc_id"] in (4, 5)) == [5]


def test_stages_give_heap_back(spark):
    none = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    for name, stage in corpus_pipeline.STAGES:
        spark.range(0, 4, 1, 4).selectExpr("length(repeat('x', cast(300000000 + id as int)))").collect()
        before = runtime.totalMemory()
        stage(spark, none, SMALL)
        assert before > 1000 << 20 and runtime.totalMemory() < before - (400 << 20), name
