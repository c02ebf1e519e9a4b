"""Queries by name, with the SQL that says what each returns."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import assign, distance, graph, metrics, quality, resample, retrieve
from ..params import POOL, Method
from ..sources.tables import Tables

QUERIES: dict = {}
ORACLES: dict = {}
METHOD = Method()
#: As published.  The SQL states the smaller sizes, so queries of these sizes have names of their own; theirs
#: is the same SQL with the whole pool and all lines (none for bootstraps, whose draws are too many for it).
PUBLISHED, REPLICATES = replace(METHOD, pool=POOL), 10_000
WORDS = {"w0": 32, "w1": 32}
DISTANCES = ["d_w0", "d_w1"]


def query(name: str, oracle: str | None = None, full: dict | None = None):
    """Registers ``name``; ``full`` holds the arguments of the whole job, registered beside it as ``name``_full."""

    def register(f):
        def named(name: str, **sizes):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return f(Tables(spark, sf_dir), **sizes)

            run.__name__ = name
            QUERIES[name] = run

        named(name)
        if full:
            named(f"{name}_full", **full)
            told = {"method": (f"parent) AS rank FROM score) WHERE rank <= {METHOD.pool})", f"parent) AS rank FROM score) WHERE rank <= {POOL})"), "lines": ("WHERE l_quantity = 1", "WHERE true")}
            for argument in set(full) & set(told):
                if oracle and told[argument][0] in oracle:
                    ORACLES[f"{name}_full"] = oracle.replace(*told[argument])
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


# ---- the test workload: vectors as components, labels as parents, packages of seven vectors

_SIG = """sig AS (SELECT vec_id, label, CAST(list_sum(list_transform(embedding[1:32], lambda x, i: CASE WHEN x >= 0 THEN CAST(1 AS BIGINT) << (i - 1) ELSE 0 END)) AS BIGINT) AS w0,
  CAST(list_sum(list_transform(embedding[33:64], lambda x, i: CASE WHEN x >= 0 THEN CAST(1 AS BIGINT) << (i - 1) ELSE 0 END)) AS BIGINT) AS w1 FROM embeddings),
nodes AS (SELECT vec_id // 70 AS query_id, vec_id AS node_id, CASE WHEN label < 8 THEN label END AS truth, w0, w1 FROM sig WHERE vec_id % 10 = 0),
gal AS (SELECT vec_id, label AS parent, w0, w1 FROM sig WHERE vec_id % 10 <> 0 AND label < 8)"""
_MIN = _SIG + """,
minima AS (SELECT query_id, node_id, parent, min(bit_count(xor(n.w0, g.w0))) / 32.0 AS d_w0, min(bit_count(xor(n.w1, g.w1))) / 32.0 AS d_w1 FROM nodes n CROSS JOIN gal g GROUP BY ALL)"""
_TABLE = _MIN + """,
fused AS (SELECT *, CAST(CAST((d_w0 + d_w1) / 2 AS FLOAT) AS DOUBLE) AS fused, ((d_w0 - min(d_w0) OVER w) + (d_w1 - min(d_w1) OVER w)) / 2 AS regret FROM minima WINDOW w AS (PARTITION BY query_id, node_id)),
tab AS (SELECT *, fused <= 0.25 + 1e-12 AS eligible, 0.75 * least(fused / 0.25, 1.0) + 0.25 * least(greatest(regret, 0.0), 1.0) AS cost FROM fused)"""
_POOL = _TABLE + """,
score AS (SELECT query_id, parent, avg(cost) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, parent ORDER BY cost, node_id) AS place FROM tab) WHERE place <= 3 GROUP BY ALL),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), parent) AS rank FROM score) WHERE rank <= 5)"""
_SOLVE = _POOL + """,
sets AS (SELECT DISTINCT query_id, 0 AS k, CAST(NULL AS INTEGER) AS p1, CAST(NULL AS INTEGER) AS p2, CAST(NULL AS INTEGER) AS p3, -1 AS r1, -1 AS r2, -1 AS r3 FROM pool
  UNION ALL SELECT query_id, 1, parent, NULL, NULL, rank, -1, -1 FROM pool
  UNION ALL SELECT a.query_id, 2, a.parent, b.parent, NULL, a.rank, b.rank, -1 FROM pool a JOIN pool b ON a.query_id = b.query_id AND a.rank < b.rank
  UNION ALL SELECT a.query_id, 3, a.parent, b.parent, c.parent, a.rank, b.rank, c.rank FROM pool a JOIN pool b ON a.query_id = b.query_id AND a.rank < b.rank JOIN pool c ON c.query_id = a.query_id AND b.rank < c.rank),
each_ AS (SELECT s.query_id, k, r1, r2, r3, p1, p2, p3, n.node_id, min(t.cost) AS cost FROM sets s JOIN nodes n ON n.query_id = s.query_id
  LEFT JOIN tab t ON t.query_id = s.query_id AND t.node_id = n.node_id AND t.eligible AND t.cost <= 1 AND (t.parent = p1 OR t.parent = p2 OR t.parent = p3) GROUP BY ALL),
total AS (SELECT query_id, k, r1, r2, r3, p1, p2, p3, round(sum(coalesce(cost, 1.0)) + 0.5 * k, 9) AS objective FROM each_ GROUP BY query_id, k, r1, r2, r3, p1, p2, p3),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY objective, k, r1, r2, r3) AS place FROM total) WHERE place = 1)"""
_ASSIGNED = _SOLVE + """,
found AS (SELECT b.query_id, n.node_id, n.truth, (SELECT arg_min(t.parent, (round(t.cost, 9), t.parent)) FROM tab t WHERE t.query_id = b.query_id AND t.node_id = n.node_id AND t.eligible AND t.cost <= 1 AND (t.parent = p1 OR t.parent = p2 OR t.parent = p3)) AS predicted
  FROM best b JOIN nodes n ON n.query_id = b.query_id)"""


def signatures(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", "label", distance.sign_word(F.col("embedding"), 0).alias("w0"), distance.sign_word(F.col("embedding"), 32).alias("w1"))


def nodes(t: Tables) -> DataFrame:
    return signatures(t).where("vec_id % 10 = 0").select(F.floor(F.col("vec_id") / 70).alias("query_id"), F.col("vec_id").alias("node_id"), F.when(F.col("label") < 8, F.col("label")).alias("truth"), "w0", "w1")


def gallery(t: Tables) -> DataFrame:
    return signatures(t).where("vec_id % 10 <> 0 and label < 8").select("vec_id", F.col("label").alias("parent"), "w0", "w1")


def minima(t: Tables) -> DataFrame:
    return distance.parent_minima(nodes(t), gallery(t), WORDS)


def table(t: Tables) -> DataFrame:
    return distance.scored(minima(t), DISTANCES, METHOD)


def pool_of(tab: DataFrame, method: Method = METHOD) -> DataFrame:
    return retrieve.pool(retrieve.parent_scores(tab, method.best), method.pool)


def outcome(t: Tables, method: Method = METHOD):
    """(table, pool, sets, pairs of truth and prediction)."""
    tab = table(t)
    pool = pool_of(tab, method)
    sets = assign.solve(tab, pool, method)
    pairs = assign.assigned(tab, sets).withColumnRenamed("parent", "predicted").join(nodes(t).select("query_id", "node_id", "truth"), ["query_id", "node_id"])
    return tab, pool, sets, pairs


@query("signature_bits", f"WITH {_SIG} SELECT vec_id, label, w0, w1 FROM sig")
def _(t):
    return signatures(t)


@query("hamming_parent_min", f"WITH {_MIN} SELECT * FROM minima")
def _(t):
    return minima(t)


@query("fused_distance", f"WITH {_TABLE} SELECT query_id, node_id, parent, fused FROM tab")
def _(t):
    return table(t).select("query_id", "node_id", "parent", "fused")


@query("mean_regret", f"WITH {_TABLE} SELECT query_id, node_id, parent, round(regret, 9) AS regret FROM tab")
def _(t):
    return rounded(table(t).select("query_id", "node_id", "parent", "regret"), "regret")


@query("component_cost", f"WITH {_TABLE} SELECT query_id, node_id, parent, eligible, round(cost, 9) AS cost FROM tab")
def _(t):
    return rounded(table(t).select("query_id", "node_id", "parent", "eligible", "cost"), "cost")


@query(
    "regret_minmax_rank_fusion",
    f"""WITH {_MIN}, n AS (SELECT query_id, node_id, parent,
  CASE WHEN max(d_w0) OVER w > min(d_w0) OVER w THEN (d_w0 - min(d_w0) OVER w) / (max(d_w0) OVER w - min(d_w0) OVER w) ELSE 0 END AS a,
  CASE WHEN max(d_w1) OVER w > min(d_w1) OVER w THEN (d_w1 - min(d_w1) OVER w) / (max(d_w1) OVER w - min(d_w1) OVER w) ELSE 0 END AS b,
  rank() OVER (PARTITION BY query_id, node_id ORDER BY d_w0) AS ka, rank() OVER (PARTITION BY query_id, node_id ORDER BY d_w1) AS kb
  FROM minima WINDOW w AS (PARTITION BY query_id, node_id))
SELECT query_id, node_id, parent, round((a + b) / 2, 9) AS mean_regret, round((a + b) / 2, 9) AS median_regret, (ka + kb) / 2.0 AS mean_rank FROM n""",
)
def _(t):
    return rounded(distance.fusion_variants(minima(t), DISTANCES), "mean_regret", "median_regret")


@query(
    "open_set_features",
    f"""WITH {_TABLE}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, node_id ORDER BY fused, regret, parent) AS place FROM tab)
SELECT query_id, node_id, max(parent) FILTER (place = 1) AS best_parent, max(fused) FILTER (place = 1) AS best, max(fused) FILTER (place = 2) AS second,
  coalesce(max(fused) FILTER (place = 2) - max(fused) FILTER (place = 1), 0) AS margin FROM r GROUP BY ALL""",
)
def _(t):
    return distance.open_set_features(table(t))


@query(
    "second_distinct_margin",
    f"""WITH {_TABLE}, r AS (SELECT *, dense_rank() OVER (PARTITION BY query_id, node_id ORDER BY fused) AS place FROM tab)
SELECT query_id, node_id, min(fused) AS best, count(*) FILTER (place = 1) AS ties, max(fused) FILTER (place = 2) AS second, max(fused) FILTER (place = 2) - min(fused) AS margin FROM r GROUP BY ALL""",
)
def _(t):
    return distance.second_distinct(table(t))


@query("parent_top3_score", f"WITH {_POOL} SELECT query_id, parent, round(score, 9) AS score FROM score")
def _(t):
    return rounded(retrieve.parent_scores(table(t), METHOD.best), "score")


@query("candidate_pool", f"WITH {_POOL} SELECT query_id, parent, round(score, 9) AS score, rank FROM pool", full={"method": PUBLISHED})
def _(t, method=METHOD):
    return rounded(pool_of(table(t), method), "score")


def _bands(width: int, rows: str) -> str:
    return " UNION ALL ".join(f"SELECT *, 'w{w}' AS word, {k} AS band, (w{w} >> {k * width}) & {(1 << width) - 1} AS value FROM {rows}" for w in range(2) for k in range(32 // width))


def _short(mode: str) -> str:
    width = retrieve.BAND_BITS[mode]
    return f"""{_SIG}, gb AS ({_bands(width, "gal")}), nb AS ({_bands(width, "nodes")}),
short AS (SELECT DISTINCT n.query_id, g.parent FROM nb n JOIN gb g USING (word, band, value))"""


@query("lsh_band_index", f"WITH {_SIG}, gb AS ({_bands(16, 'gal')}) SELECT DISTINCT word, band, value, parent FROM gb")
def _(t):
    return retrieve.bands(gallery(t), ["w0", "w1"], "BALANCED").select("word", "band", "value", "parent").distinct()


for _mode in retrieve.BAND_BITS:

    @query(f"lsh_shortlist_{_mode.lower()}", f"WITH {_short(_mode)} SELECT query_id, parent FROM short")
    def _(t, mode=_mode):
        return retrieve.shortlist(nodes(t), gallery(t), ["w0", "w1"], mode)


@query(
    "lsh_fidelity",
    f"""WITH {_POOL}, gb AS ({_bands(8, "gal")}), nb AS ({_bands(8, "nodes")}), short AS (SELECT DISTINCT n.query_id, g.parent FROM nb n JOIN gb g USING (word, band, value)),
z AS (SELECT query_id, count(*) AS shortlist FROM short GROUP BY 1)
SELECT p.query_id, count(*) AS pool, count(s.parent) AS held, coalesce(any_value(z.shortlist), 0) AS shortlist, count(*) = count(s.parent) AS identical
FROM pool p LEFT JOIN short s ON s.query_id = p.query_id AND s.parent = p.parent LEFT JOIN z ON z.query_id = p.query_id GROUP BY p.query_id""",
    full={"method": PUBLISHED},
)
def _(t, method=METHOD):
    return retrieve.fidelity(pool_of(table(t), method), retrieve.shortlist(nodes(t), gallery(t), ["w0", "w1"], "HIGH_RECALL"))


@query(
    "lsh_rescored",
    f"""WITH {_MIN}, gb AS ({_bands(16, "gal")}), nb AS ({_bands(16, "nodes")}), short AS (SELECT DISTINCT n.query_id, g.parent FROM nb n JOIN gb g USING (word, band, value)),
m AS (SELECT minima.* FROM minima JOIN short USING (query_id, parent))
SELECT query_id, node_id, parent, CAST(CAST((d_w0 + d_w1) / 2 AS FLOAT) AS DOUBLE) AS fused, ((d_w0 - min(d_w0) OVER w) + (d_w1 - min(d_w1) OVER w)) / 2 AS regret FROM m WINDOW w AS (PARTITION BY query_id, node_id)""",
)
def _(t):
    short = retrieve.shortlist(nodes(t), gallery(t), ["w0", "w1"], "BALANCED")
    return distance.fused(distance.listed_minima(nodes(t), gallery(t), short, WORDS), DISTANCES).select("query_id", "node_id", "parent", "fused", "regret")


@query("independent_assignment", f"WITH {_TABLE} SELECT query_id, node_id, arg_min(parent, (round(cost, 9), parent)) FILTER (eligible) AS parent FROM tab GROUP BY ALL")
def _(t):
    return assign.independent(table(t))


@query("parent_set_solver", f"WITH {_SOLVE} SELECT query_id, objective, k, p1, p2, p3 FROM best", full={"method": PUBLISHED})
def _(t, method=METHOD):
    return outcome(t, method)[2]


@query("parent_set_assignment", f"WITH {_ASSIGNED} SELECT query_id, node_id, truth, predicted FROM found", full={"method": PUBLISHED})
def _(t, method=METHOD):
    return outcome(t, method)[3]


@query("oracle_k_solver", f"WITH {_SOLVE} SELECT query_id, objective, k, p1, p2, p3 FROM (SELECT *, row_number() OVER (PARTITION BY query_id, k ORDER BY objective, r1, r2, r3) AS own FROM total) WHERE own = 1", full={"method": PUBLISHED})
def _(t, method=METHOD):
    tab = table(t)
    return assign.solve(tab, pool_of(tab, method), method, by_size=True)


@query(
    "lambda_grid",
    f"""WITH {_SOLVE}, bestk AS (SELECT query_id, k, min(objective) - 0.5 * k AS paid FROM total GROUP BY query_id, k),
g AS (SELECT query_id, i / 20.0 AS penalty, k, round(paid + i / 20.0 * k, 9) AS objective FROM bestk CROSS JOIN range(46) r(i))
SELECT penalty, avg(k) AS mean_k, round(avg(objective), 9) AS mean_objective FROM (SELECT *, row_number() OVER (PARTITION BY query_id, penalty ORDER BY objective, k) AS place FROM g) WHERE place = 1 GROUP BY penalty""",
    full={"method": PUBLISHED},
)
def _(t, method=METHOD):
    tab = table(t)
    best = assign.solve(tab, pool_of(tab, method), method, by_size=True).select("query_id", "k", (F.col("objective") - method.penalty * F.col("k")).alias("paid"))
    grid = best.crossJoin(F.broadcast(t.spark.range(46).select((F.col("id") / 20.0).alias("penalty"))))
    key = F.struct(F.round(F.col("paid") + F.col("penalty") * F.col("k"), 9).alias("objective"), "k")
    chosen = grid.groupBy("query_id", "penalty").agg(F.min(key).alias("best"))
    return chosen.groupBy("penalty").agg(F.avg("best.k").alias("mean_k"), F.round(F.avg("best.objective"), 9).alias("mean_objective"))


@query(
    "boundary_smoothing",
    f"""WITH {_TABLE}, e AS (SELECT a.query_id, a.node_id AS node_a, b.node_id AS node_b FROM nodes a JOIN nodes b ON a.query_id = b.query_id AND b.node_id = a.node_id + 10),
both_ AS (SELECT query_id, node_a, node_b FROM e UNION ALL SELECT query_id, node_b, node_a FROM e),
tops AS (SELECT query_id, node_id, list(parent) AS tops FROM (SELECT *, row_number() OVER (PARTITION BY query_id, node_id ORDER BY round(cost, 9), parent) AS place FROM tab) WHERE place <= 3 GROUP BY ALL),
w AS (SELECT b.*, len(list_intersect(x.tops, y.tops)) / CAST(len(list_distinct(list_concat(x.tops, y.tops))) AS DOUBLE) AS w FROM both_ b JOIN tops x ON x.query_id = b.query_id AND x.node_id = node_a JOIN tops y ON y.query_id = b.query_id AND y.node_id = node_b),
near AS (SELECT w.query_id, node_a AS node_id, t.parent, sum(w * t.cost) / sum(w) AS near FROM w JOIN tab t ON t.query_id = w.query_id AND t.node_id = node_b WHERE w > 0 GROUP BY ALL)
SELECT t.query_id, t.node_id, t.parent, round(CASE WHEN near IS NULL THEN cost ELSE 0.9 * cost + 0.1 * near END, 9) AS cost FROM tab t LEFT JOIN near n ON n.query_id = t.query_id AND n.node_id = t.node_id AND n.parent = t.parent""",
)
def _(t):
    n = nodes(t).select("query_id", F.col("node_id").alias("node_a"))
    edges = n.join(n.select("query_id", (F.col("node_a") - 10).alias("before"), F.col("node_a").alias("node_b")), ["query_id"]).where("before = node_a")
    return rounded(assign.smoothed(table(t), edges, METHOD.beta).select("query_id", "node_id", "parent", "cost"), "cost")


@query(
    "package_votes",
    f"""WITH {_TABLE}, r AS (SELECT *, rank() OVER w AS place, row_number() OVER (PARTITION BY query_id, node_id ORDER BY fused, parent) AS row_, count(*) OVER v AS n, min(fused) OVER v AS best FROM tab WINDOW w AS (PARTITION BY query_id, node_id ORDER BY fused), v AS (PARTITION BY query_id, node_id)),
q AS (SELECT *, sum((place = 1)::INT) OVER (PARTITION BY query_id, node_id) AS ties FROM r)
SELECT query_id, parent, round(sum(CASE WHEN place = 1 THEN 1.0 / ties ELSE 0 END), 9) AS fractional, round(sum(CASE WHEN place = 1 THEN 1.0 / (1 + best) / ties ELSE 0 END), 9) AS confidence,
  round(sum(1.0 / place), 9) AS reciprocal, round(sum((row_ - 1) / CAST(greatest(n - 1, 1) AS DOUBLE)), 9) AS normalised FROM q GROUP BY ALL""",
)
def _(t):
    return rounded(assign.votes(table(t)), "fractional", "confidence", "reciprocal", "normalised")


_CONF = """SELECT count(*) FILTER (truth IS NULL AND predicted IS NULL) AS tp, count(*) FILTER (truth IS NOT NULL AND predicted IS NULL) AS fp,
  count(*) FILTER (truth IS NULL AND predicted IS NOT NULL) AS fn, count(*) FILTER (truth IS NOT NULL AND predicted IS NOT NULL) AS tn, avg((truth IS NOT DISTINCT FROM predicted)::DOUBLE) AS accuracy FROM found"""


@query(
    "unknown_confusion",
    f"""WITH {_ASSIGNED}, c AS ({_CONF}), p AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall,
  CASE WHEN tn + fn = 0 THEN 0 ELSE tn / (tn + fn) END AS kp, CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp) END AS kr FROM c),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS unknown_f1, CASE WHEN kp + kr = 0 THEN 0 ELSE 2 * kp * kr / (kp + kr) END AS known_f1 FROM p)
SELECT tp, fp, fn, tn, round(accuracy, 9) AS accuracy, round(precision, 9) AS precision, round(recall, 9) AS recall, round(unknown_f1, 9) AS unknown_f1, round(known_f1, 9) AS known_f1, round((unknown_f1 + known_f1) / 2, 9) AS macro_f1 FROM f""",
    full={"method": PUBLISHED},
)
def _(t, method=METHOD):
    return rounded(metrics.unknown_confusion(outcome(t, method)[3]), "accuracy", "precision", "recall", "unknown_f1", "known_f1", "macro_f1")


_SETS = """s AS (SELECT query_id, list_distinct(list(truth)) AS ts, list_distinct(list(predicted)) AS ps, max((truth IS NULL)::INT) AS tu, max((predicted IS NULL)::INT) AS pu FROM found GROUP BY 1),
m AS (SELECT query_id, coalesce(len(list_intersect(ts, ps)), 0) AS b, coalesce(len(ts), 0) AS nt, coalesce(len(ps), 0) AS np, tu, pu FROM s),
sm AS (SELECT query_id, CASE WHEN np = 0 THEN 0 ELSE b / CAST(np AS DOUBLE) END AS precision, CASE WHEN nt = 0 THEN 0 ELSE b / CAST(nt AS DOUBLE) END AS recall,
  CASE WHEN b = 0 THEN 0 ELSE 2 * (b / CAST(np AS DOUBLE)) * (b / CAST(nt AS DOUBLE)) / (b / CAST(np AS DOUBLE) + b / CAST(nt AS DOUBLE)) END AS f1, b = nt AND b = np AS exact, nt + tu AS k_true, np + pu AS k_found FROM m)"""


@query("set_metrics", f"WITH {_ASSIGNED}, {_SETS} SELECT query_id, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, exact, k_true, k_found FROM sm", full={"method": PUBLISHED})
def _(t, method=METHOD):
    return rounded(metrics.set_metrics(outcome(t, method)[3]), "precision", "recall", "f1")


@query("k_metrics", f"WITH {_ASSIGNED}, {_SETS} SELECT round(avg((k_true = k_found)::DOUBLE), 9) AS k_accuracy, round(avg(abs(k_true - k_found)), 9) AS k_mae, round(avg(f1), 9) AS mean_f1, round(avg(exact::DOUBLE), 9) AS exact_rate FROM sm", full={"method": PUBLISHED})
def _(t, method=METHOD):
    m = metrics.set_metrics(outcome(t, method)[3])
    return rounded(m.agg(F.avg((F.col("k_true") == F.col("k_found")).cast("double")).alias("k_accuracy"), F.avg(F.abs(F.col("k_true") - F.col("k_found")).cast("double")).alias("k_mae"), F.avg("f1").alias("mean_f1"), F.avg(F.col("exact").cast("double")).alias("exact_rate")), "k_accuracy", "k_mae", "mean_f1", "exact_rate")


@query(
    "topk_recall_mrr",
    f"""WITH {_TABLE}, o AS (SELECT t.query_id, t.node_id, t.fused AS own FROM tab t JOIN nodes n ON n.node_id = t.node_id AND n.truth = t.parent),
r AS (SELECT t.query_id, t.node_id, count(*) FILTER (fused < own) + 1 AS rank, count(*) FILTER (fused = own) AS ties FROM tab t JOIN o ON o.node_id = t.node_id GROUP BY ALL)
SELECT round(avg((rank <= 1)::DOUBLE), 9) AS recall_1, round(avg((rank <= 3)::DOUBLE), 9) AS recall_3, round(avg((rank <= 5)::DOUBLE), 9) AS recall_5, round(avg(1.0 / rank), 9) AS mrr, round(avg((ties > 1)::DOUBLE), 9) AS tie_rate, count(*) AS nodes FROM r""",
)
def _(t):
    return rounded(metrics.recall_at(table(t), nodes(t).select("query_id", "node_id", "truth")), "recall_1", "recall_3", "recall_5", "mrr", "tie_rate")


@query(
    "failure_localisation",
    f"""WITH {_ASSIGNED} SELECT f.query_id, f.node_id, CASE WHEN truth IS NULL THEN 'UNKNOWN' WHEN p.parent IS NULL THEN 'RETRIEVAL' WHEN truth IN (p1, p2, p3) THEN 'ASSIGNMENT' ELSE 'SELECTION' END AS stage
FROM found f LEFT JOIN pool p ON p.query_id = f.query_id AND p.parent = f.truth LEFT JOIN best b ON b.query_id = f.query_id WHERE truth IS DISTINCT FROM predicted""",
    full={"method": PUBLISHED},
)
def _(t, method=METHOD):
    _, pool, sets, pairs = outcome(t, method)
    return metrics.localised(pairs, pool, sets)


@query(
    "pool_size_audit",
    f"""WITH {_TABLE}, score AS (SELECT query_id, parent, avg(cost) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, parent ORDER BY cost, node_id) AS place FROM tab) WHERE place <= 3 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), parent) AS rank FROM score), tr AS (SELECT DISTINCT query_id, truth FROM nodes WHERE truth IS NOT NULL),
h AS (SELECT m, tr.query_id, count(*) AS n, count(*) FILTER (rank <= m) AS held FROM tr JOIN r ON r.query_id = tr.query_id AND r.parent = tr.truth CROSS JOIN (VALUES (3), (4), (5), (6), (8)) v(m) GROUP BY ALL)
SELECT m, round(avg(held / n), 9) AS recall, round(avg((held = n)::DOUBLE), 9) AS all_present FROM h GROUP BY m""",
    full={"sizes": (3, 4, 5, 6, 8, 10)},
)
def _(t, sizes=(3, 4, 5, 6, 8)):
    ranked = retrieve.pool(retrieve.parent_scores(table(t), METHOD.best), 1000)
    true = nodes(t).where("truth is not null").select("query_id", F.col("truth").alias("parent")).distinct().join(ranked, ["query_id", "parent"])
    sizes = true.withColumn("m", F.explode(F.array(*[F.lit(m) for m in sizes])))
    held = sizes.groupBy("m", "query_id").agg(F.avg((F.col("rank") <= F.col("m")).cast("double")).alias("share"))
    return held.groupBy("m").agg(F.round(F.avg("share"), 9).alias("recall"), F.round(F.avg((F.col("share") == 1).cast("double")), 9).alias("all_present"))


@query(
    "threshold_sweep",
    f"""WITH {_TABLE}, r AS (SELECT n.node_id, min(fused) AS d, any_value(truth) IS NOT NULL AS known FROM tab t JOIN nodes n ON n.node_id = t.node_id GROUP BY n.node_id),
v AS (SELECT DISTINCT d FROM r), th AS (SELECT d AS threshold FROM v UNION ALL SELECT (d + lead(d) OVER (ORDER BY d)) / 2 FROM v), c AS (
SELECT threshold, count(*) FILTER (d > threshold AND NOT known) AS tp, count(*) FILTER (d > threshold AND known) AS fp, count(*) FILTER (d <= threshold AND NOT known) AS fn, count(*) FILTER (d <= threshold AND known) AS tn FROM th CROSS JOIN r WHERE threshold IS NOT NULL GROUP BY 1),
f AS (SELECT *, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS uf, CASE WHEN 2 * tn + fn + fp = 0 THEN 0 ELSE 2.0 * tn / (2 * tn + fn + fp) END AS kf FROM c)
SELECT threshold, tp, fp, round((uf + kf) / 2, 9) AS macro_f1, round(uf, 9) AS unknown_f1 FROM f""",
)
def _(t):
    best = table(t).groupBy("query_id", "node_id").agg(F.min("fused").alias("distance"))
    rows = best.join(nodes(t).select("query_id", "node_id", F.col("truth").isNotNull().alias("known")), ["query_id", "node_id"])
    return metrics.threshold_sweep(rows)


# ---- registry hygiene over documents

@query("content_hash", "SELECT doc_id, sha256(text) AS sha256, n_chars AS size FROM documents")
def _(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("size"))


@query("log_bucket_hist", "SELECT CASE WHEN n_chars <= 0 THEN 0 ELSE floor(log2(n_chars))::INT + 1 END AS bucket, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy(fx.log_bucket(F.col("n_chars")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "size_ladders",
    """SELECT CASE WHEN n <= 0 THEN '0' WHEN n = 1 THEN '1' WHEN n < 4 THEN '2-3' WHEN n < 8 THEN '4-7' WHEN n < 16 THEN '8-15' WHEN n < 32 THEN '16-31' WHEN n < 64 THEN '32-63' WHEN n < 128 THEN '64-127' WHEN n < 256 THEN '128-255' WHEN n < 512 THEN '256-511' ELSE '512+' END AS count_bucket,
CASE WHEN n <= 1 THEN '1' WHEN n <= 3 THEN '2-3' WHEN n <= 5 THEN '4-5' WHEN n <= 10 THEN '6-10' WHEN n <= 20 THEN '11-20' ELSE '21+' END AS size_bucket, count(*) AS documents FROM (SELECT n_chars AS n FROM documents) GROUP BY 1, 2""",
)
def _(t):
    return t.documents.groupBy(fx.count_bucket(F.col("n_chars")).alias("count_bucket"), fx.size_bucket(F.col("n_chars")).alias("size_bucket")).agg(F.count(F.lit(1)).alias("documents"))


@query(
    "string_shape",
    r"""WITH s AS (SELECT unnest(string_split_regex(url, '[/?&=#]')) AS s FROM pages UNION ALL SELECT url FROM pages UNION ALL SELECT props FROM events)
SELECT CASE WHEN length(s) = 0 THEN 'EMPTY' WHEN regexp_matches(s, '^[a-z][a-z0-9+.-]*://') THEN 'URL' WHEN regexp_matches(s, '^[0-9a-fA-F]{16,}$') THEN 'HEX' WHEN regexp_matches(s, '^[a-z0-9_.-]+:[a-z0-9_./-]+$') THEN 'RESOURCE_ID'
WHEN regexp_matches(s, '^[A-Za-z_$][A-Za-z0-9_$]*(\.[A-Za-z_$][A-Za-z0-9_$]*)+$') THEN 'QUALIFIED_ID'
ELSE 'WORDS' || CASE WHEN regexp_matches(s, '[0-9]') THEN '_DIGIT' ELSE '' END || CASE WHEN regexp_matches(s, '[A-Z]') THEN '_UPPER' ELSE '' END || CASE WHEN contains(s, '/') THEN '_SLASH' ELSE '' END || '_' || (floor(log2(len(string_split_regex(trim(s), '\s+'))))::INT + 1) END AS shape, count(*) AS n FROM s GROUP BY 1""",
)
def _(t):
    parts = t.pages.select(F.explode(F.split("url", "[/?&=#]")).alias("s")).unionByName(t.pages.select(F.col("url").alias("s"))).unionByName(t.events.select(F.col("props").alias("s")))
    return parts.groupBy(fx.string_shape(F.col("s")).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


@query("nondiscriminative_filter", r"SELECT reason, count(*) AS n FROM (SELECT CASE WHEN length(props) = 0 THEN 'EMPTY_BYTES' WHEN regexp_replace(props, '\s+', '', 'g') = '' THEN 'WHITESPACE_ONLY' WHEN regexp_replace(props, '\s+', '', 'g') = '{}' THEN 'EMPTY_JSON_OBJECT' WHEN regexp_replace(props, '\s+', '', 'g') = '[]' THEN 'EMPTY_JSON_ARRAY' END AS reason FROM events) GROUP BY 1")
def _(t):
    return t.events.groupBy(fx.nondiscriminative(F.col("props")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("duplicate_groups", "SELECT lang, sha256(text) AS sha, count(DISTINCT source) AS projects, count(*) AS components, min(source) AS first_project FROM documents GROUP BY 1, 2 HAVING count(DISTINCT source) > 1")
def _(t):
    return quality.duplicate_groups(t.documents.select("lang", F.sha2("text", 256).alias("sha"), F.col("source").alias("project")), "lang")


@query("composition_counts", "SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang = 'fr') AS fr FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy("source").agg(*[F.count_if(F.col("lang") == c).alias(c) for c in ("en", "de", "es", "fr")])


_DOCS = "d AS (SELECT doc_id AS id, source AS project, sha256(text) AS sha, md5(substr(text, 1, 40)) AS head, ascii(md5(CAST(doc_id AS VARCHAR))) % 2 = 0 AS now FROM documents)"


def halves(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Historical and current components."""
    d = t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("project"), F.sha2("text", 256).alias("sha"), F.md5(F.substring("text", 1, 40)).alias("head"), (F.ascii(F.md5(F.col("doc_id").cast("string"))) % 2 == 0).alias("now"))
    return d.where("not now"), d.where("now")


for _key in ("sha", "head"):

    @query(
        f"identity_verdicts_{_key}",
        f"""WITH {_DOCS}, g AS (SELECT {_key}, list(DISTINCT project) AS f FROM d WHERE now GROUP BY 1)
SELECT id, project, CAST(coalesce(len(f), 0) AS BIGINT) AS candidates, CASE WHEN f IS NULL THEN 'NO_MATCH' WHEN len(f) = 1 THEN CASE WHEN list_contains(f, project) THEN 'CORRECT_UNIQUE' ELSE 'WRONG_UNIQUE' END WHEN list_contains(f, project) THEN 'AMBIGUOUS_TRUE_INCLUDED' ELSE 'AMBIGUOUS_WRONG' END AS verdict
FROM d LEFT JOIN g USING ({_key}) WHERE NOT now""",
    )
    def _(t, key=_key):
        old, new = halves(t)
        return quality.identity_hits(old, new, key)


@query(
    "survival_attribution",
    f"""WITH {_DOCS}, n AS (SELECT * FROM d WHERE now), o AS (SELECT sha, list(DISTINCT project) AS ow FROM n GROUP BY 1)
SELECT id, project, CASE WHEN EXISTS (SELECT 1 FROM n WHERE n.project = d.project AND n.head = d.head AND n.sha = d.sha) THEN 'UNCHANGED_SAME_PATH' WHEN EXISTS (SELECT 1 FROM n WHERE n.project = d.project AND n.sha = d.sha) THEN 'UNCHANGED_MOVED_PATH' ELSE 'CHANGED_OR_REMOVED' END AS state,
  CASE WHEN ow IS NULL THEN 'NO_EXACT_MATCH' WHEN len(ow) = 1 AND list_contains(ow, project) THEN 'CORRECT_PARENT' WHEN len(ow) = 1 THEN 'WRONG_PARENT' ELSE 'AMBIGUOUS' END AS attribution
FROM d LEFT JOIN o USING (sha) WHERE NOT now""",
)
def _(t):
    old, new = halves(t)
    return quality.survival(old.withColumnRenamed("head", "path"), new.withColumnRenamed("head", "path"))


@query("benchmark_collision", r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), b AS (SELECT item_id, unnest(string_split(text, chr(10))) AS line FROM benchmark) SELECT DISTINCT l.doc_id, b.item_id FROM l JOIN b ON sha256(l.line) = sha256(b.line) WHERE length(l.line) > 20")
def _(t):
    lines = lambda df, key: df.select(key, F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") > 20).select(key, F.sha2("line", 256).alias("h"))
    return lines(t.documents, "doc_id").join(lines(t.benchmark, "item_id"), "h").select("doc_id", "item_id").distinct()


@query(
    "path_parts",
    r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages)
SELECT page_id, regexp_extract(path, '[^/]*$') AS base, split_part(path, '/', 1) AS host, regexp_replace(lower(path), '[^a-z0-9]', '', 'g') AS version FROM p""",
)
def _(t):
    p = t.pages.select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path"))
    return p.select("page_id", fx.basename(F.col("path")).alias("base"), F.substring_index("path", "/", 1).alias("host"), fx.normal_version(F.col("path")).alias("version"))


@query(
    "link_reference_resolution",
    r"""WITH r AS (SELECT DISTINCT page_id AS source, regexp_extract(unnest(regexp_extract_all(html, 'href="([^"#?]*)"', 1)), '[^/]*$') AS key FROM pages),
g AS (SELECT regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/]*$') AS key, url AS path FROM pages), o AS (SELECT key, count(DISTINCT path) AS paths, min(path) AS path FROM g GROUP BY 1)
SELECT source, r.key, CASE WHEN paths = 1 THEN o.path END AS path, coalesce(paths, 0) AS paths FROM r LEFT JOIN o ON o.key = r.key""",
)
def _(t):
    found = F.explode(F.regexp_extract_all("html", F.lit('href="([^"#?]*)"'), F.lit(1)))
    references = t.pages.select(F.col("page_id").alias("source"), found.alias("link")).select("source", F.regexp_extract("link", "[^/]*$", 0).alias("key")).distinct()
    targets = t.pages.select(F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), "[^/]*$", 0).alias("key"), F.col("url").alias("path"))
    return graph.unique_resolve(references, targets)


_TOKENS = r"""tok AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS token FROM documents)"""


@query(
    "simhash128_text",
    f"""WITH {_TOKENS}, c AS (SELECT doc_id, token, count(*) AS w FROM tok GROUP BY ALL), h AS (SELECT doc_id, w, sha256(token) AS h FROM c),
x AS (SELECT doc_id, w, k, CAST('0x' || substr(h, k * 8 + 1, 8) AS BIGINT) AS v FROM h CROSS JOIN range(4) r(k)),
b AS (SELECT doc_id, k, i, sum(CASE WHEN (v >> (31 - i)) & 1 = 1 THEN w ELSE -w END) AS s FROM x CROSS JOIN range(32) q(i) GROUP BY ALL),
o AS (SELECT doc_id, k, CAST(sum(CASE WHEN s >= 0 THEN CAST(1 AS BIGINT) << (31 - i) ELSE 0 END) AS BIGINT) AS v FROM b GROUP BY ALL)
SELECT doc_id, max(v) FILTER (k = 0) AS w0, max(v) FILTER (k = 1) AS w1, max(v) FILTER (k = 2) AS w2, max(v) FILTER (k = 3) AS w3 FROM o GROUP BY 1""",
)
def _(t):
    tokens = F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "")
    return quality.simhash128(t.documents.select("doc_id", tokens.alias("tokens")), "doc_id", "tokens")


# ---- metrics, resampling and samples over labels and events

@query(
    "metrics_grouping_sets",
    """SELECT event_type, hour(ts) AS h, round(avg(value), 9) AS mean, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (hour(ts)), ())""",
)
def _(t):
    rows = t.events.select("event_type", F.hour("ts").cast("long").alias("h"), "value")
    return rounded(metrics.by_levels(rows, "value", [["event_type"], ["h"], []]), "mean")


@query("cross_tab", "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'O') AS o, count(*) FILTER (l_linestatus = 'F') AS f FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.count_if(F.col("l_linestatus") == "O").alias("o"), F.count_if(F.col("l_linestatus") == "F").alias("f"))


@query("latency_percentiles", "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.95), 9) AS p95, round(quantile_cont(value, 0.99), 9) AS p99, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS std, max(value) AS most FROM events GROUP BY 1")
def _(t):
    p = lambda q: F.round(F.percentile("value", q), 9)
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.round(F.avg("value"), 9).alias("mean"), F.round(F.stddev_samp("value"), 9).alias("std"), F.max("value").alias("most"))


@query("nearest_rank_percentile", "SELECT source, quantile_disc(n_chars, 0.9) AS p90 FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy("source").agg(F.expr("percentile_disc(0.9) within group (order by n_chars)").cast("long").alias("p90"))


@query("throughput_by_type", "SELECT event_type, count(*) AS n, round(count(*) / greatest(epoch(max(ts)) - epoch(min(ts)), 1), 9) AS per_second FROM events GROUP BY 1")
def _(t):
    s = F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.count(F.lit(1)) / F.greatest(s / 1e6, F.lit(1.0)), 9).alias("per_second"))


_STATS = "st AS (SELECT l.doc_id AS query_id, d.lang AS stratum, d.source AS source, CAST(l.quality AS DOUBLE) AS value FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"


def stats(t: Tables) -> DataFrame:
    return t.labels.join(t.documents.select("doc_id", "lang", "source"), "doc_id").select(F.col("doc_id").alias("query_id"), F.col("lang").alias("stratum"), "source", F.col("quality").cast("double").alias("value"))


_DRAWS = """p AS (SELECT {s} AS g, value, row_number() OVER (PARTITION BY {s} ORDER BY query_id) - 1 AS slot, count(*) OVER (PARTITION BY {s}) AS n FROM st),
dr AS (SELECT g, replicate, CAST('0x' || substr(sha256('0|' || g || '|' || replicate || '|' || slot), 1, 8) AS BIGINT) % n AS slot FROM p CROSS JOIN range(200) r(replicate)),
bs AS (SELECT replicate, avg(value) AS mean FROM dr JOIN p USING (g, slot) GROUP BY 1)"""
_CI = "SELECT round(avg(mean), 9) AS mean, round(stddev_samp(mean), 9) AS std, round(quantile_cont(mean, 0.025), 9) AS low, round(quantile_cont(mean, 0.975), 9) AS high FROM bs"


@query("bootstrap_ci", f"WITH {_STATS}, {_DRAWS.format(s='stratum')} {_CI}", full={"replicates": REPLICATES})
def _(t, replicates=200):
    return rounded(resample.interval(resample.bootstrap(stats(t), "stratum", "value", replicates)), "mean", "std", "low", "high")


@query(
    "cluster_bootstrap_ci",
    f"""WITH {_STATS}, c AS (SELECT source, sum(value) AS s, count(*) AS m, row_number() OVER (ORDER BY source) - 1 AS slot, count(*) OVER () AS n FROM st GROUP BY source),
dr AS (SELECT replicate, CAST('0x' || substr(sha256('0|' || replicate || '|' || slot), 1, 8) AS BIGINT) % n AS slot FROM c CROSS JOIN range({REPLICATES}) r(replicate)),
bs AS (SELECT replicate, sum(s) / sum(m) AS mean FROM dr JOIN c USING (slot) GROUP BY replicate) {_CI}""",
)
def _(t):
    return rounded(resample.interval(resample.cluster_bootstrap(stats(t), "source", "value", REPLICATES)), "mean", "std", "low", "high")


@query("leave_one_source_out", f"WITH {_STATS}, w AS (SELECT sum(value) AS s, count(*) AS n FROM st), p AS (SELECT source, sum(value) AS sp, count(*) AS np FROM st GROUP BY 1) SELECT source, round((s - sp) / (n - np), 9) AS mean, round(s / n, 9) AS whole FROM p CROSS JOIN w")
def _(t):
    return rounded(resample.leave_one_out(stats(t), "source", "value"), "mean", "whole")


@query("hash_split", "SELECT source, CASE WHEN place <= 10 THEN 'DEVELOPMENT' WHEN place <= 15 THEN 'CALIBRATION' ELSE 'TEST' END AS split FROM (SELECT source, row_number() OVER (ORDER BY sha256('0||' || source), source) AS place FROM (SELECT DISTINCT source FROM documents))")
def _(t):
    return resample.split(t.documents.select("source").distinct(), "source", {"DEVELOPMENT": 10, "CALIBRATION": 5, "TEST": 5}).select("source", "split")


@query("stratified_hash_sample", "SELECT lang, doc_id, place FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('0||' || doc_id), doc_id) AS place FROM documents) WHERE place <= 20")
def _(t):
    return resample.hash_sample(t.documents.select("lang", "doc_id"), "doc_id", "lang", 20).select("lang", "doc_id", "place")


_EDGES = "e AS (SELECT DISTINCT l_partkey AS a, l_suppkey + 1000000000 AS b FROM lineitem WHERE l_quantity = 1)"


def edges(t: Tables, lines: str = "true") -> DataFrame:
    return t.lineitem.where(lines).select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1000000000).alias("b")).distinct()


_LABELLED = """e AS (SELECT DISTINCT l_partkey AS a, l_suppkey + 1000000000 AS b FROM lineitem), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
cc(node, component) USING KEY (node) AS (SELECT a, min(least(a, b)) FROM u GROUP BY a
  UNION (SELECT u.a, min(c.component) FROM cc c JOIN u ON u.b = c.node JOIN recurring.cc AS own ON own.node = u.a GROUP BY u.a, own.component HAVING min(c.component) < own.component))"""


@query("connected_components", f"WITH RECURSIVE {_LABELLED} SELECT node, component FROM cc")
def _(t):
    return graph.connected_components(edges(t))


@query(
    "largest_component_rate",
    f"WITH RECURSIVE {_LABELLED}, s AS (SELECT component, count(*) AS size FROM cc GROUP BY 1) SELECT sum(size)::BIGINT AS nodes, count(*) AS components, max(size) AS largest, max(size) / sum(size) AS largest_rate FROM s",
)
def _(t):
    return graph.component_stats(graph.connected_components(edges(t)))


@query("graph_degrees", f"WITH {_EDGES}, n AS (SELECT a AS node FROM e UNION ALL SELECT b FROM e) SELECT node, count(*) AS degree FROM n GROUP BY 1", full={"lines": "true"})
def _(t, lines="l_quantity = 1"):
    return graph.degrees(edges(t, lines))
