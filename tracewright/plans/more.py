"""Further queries: structure and image signatures, relabelling over graphs, protocol tables, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hash_order
from ..operators import assign, baseline, classfile, images, protocol, relabel, resample, structure
from ..sources.tables import Tables
from .catalogue import _DRAWS, _SIG, _SOLVE, _TABLE, METHOD, PUBLISHED, REPLICATES, nodes, outcome, query, rounded, table


def _bucket(x: str) -> str:
    return f"CASE WHEN {x} <= 0 THEN 0 ELSE CAST(floor(log2({x})) AS INT) + 1 END"


# ---- structure and images


@query(
    "json_structure_tokens",
    f"""SELECT event_id, 'JSON' AS kind, 'OBJ_LEN_1 KEY_OTHER_LEN_1 INT_MAG_' || ({_bucket("v")}) AS tokens
FROM (SELECT event_id, abs(CAST(json_extract(props, '$.k') AS BIGINT)) AS v FROM events)""",
)
def _(t):
    s = structure.structure(F.col("props"))
    return t.events.select("event_id", s.alias("s")).select("event_id", F.col("s.kind").alias("kind"), F.array_join("s.tokens", " ").alias("tokens"))


@query(
    "json_structure_signature",
    f"""WITH s AS (SELECT event_id, ['OBJ_LEN_1', 'KEY_OTHER_LEN_1', 'INT_MAG_' || ({_bucket("v")})] AS t FROM (SELECT event_id, abs(CAST(json_extract(props, '$.k') AS BIGINT)) AS v FROM events)),
x AS (SELECT t, k, CAST('0x' || substr(sha256(token), k * 8 + 1, 8) AS BIGINT) AS v FROM (SELECT t, unnest(list_concat(t, [array_to_string(t, '|')])) AS token FROM (SELECT DISTINCT t FROM s)) CROSS JOIN range(4) r(k)),
b AS (SELECT t, k, i, sum(CASE WHEN (v >> (31 - i)) & 1 = 1 THEN 1 ELSE -1 END) AS s FROM x CROSS JOIN range(32) q(i) GROUP BY ALL),
o AS (SELECT t, k, CAST(sum(CASE WHEN s >= 0 THEN CAST(1 AS BIGINT) << (31 - i) ELSE 0 END) AS BIGINT) AS v FROM b GROUP BY ALL)
SELECT event_id, 'JSON' AS kind, 3::BIGINT AS token_count, max(v) FILTER (k = 0) AS w0, max(v) FILTER (k = 1) AS w1, max(v) FILTER (k = 2) AS w2, max(v) FILTER (k = 3) AS w3 FROM s JOIN o USING (t) GROUP BY event_id""",
)
def _(t):
    return structure.signatures(t.events, "event_id", "props")


_GRAY = """g AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(least(greatest((CAST(x AS DOUBLE) + 1) * 128, 0), 255)) AS INTEGER)) AS v FROM embeddings)"""


def image_features(t: Tables) -> DataFrame:
    """Vectors as 8 by 8 grey images, stored as PNG and read again."""
    level = F.transform("embedding", lambda x: F.floor(F.least(F.greatest((x.cast("double") + 1) * 128, F.lit(0.0)), F.lit(255.0))).cast("int"))
    png = t.embeddings.select("vec_id", images.gray_png(level).alias("payload"))
    return png.select("vec_id", images.image_features(F.col("payload")).alias("f"))


@query(
    "image_average_hash",
    f"""WITH {_GRAY}, b AS (SELECT vec_id, v, list_transform(v, lambda x: CAST(64 * x >= list_sum(v) AS INTEGER)) AS b FROM g)
SELECT vec_id, array_to_string(list_transform(range(16), lambda i: substr('0123456789abcdef', CAST(1 + 8 * b[4 * i + 1] + 4 * b[4 * i + 2] + 2 * b[4 * i + 3] + b[4 * i + 4] AS BIGINT), 1)), '') AS ahash,
  array_to_string(list_transform(range(16), lambda i: CAST(CAST(round_even(len(list_filter(v, lambda x: x // 16 = i)) / 64.0 * 10000, 0) AS INTEGER) AS VARCHAR)), ',') AS hist16 FROM b""",
)
def _(t):
    return image_features(t).select("vec_id", "f.ahash", "f.hist16")


@query("image_wave_hashes")
def _(t):
    return image_features(t).select("vec_id", "f.dhash", "f.phash", "f.width", "f.height")


@query("structured_fingerprint64")
def _(t):
    return t.events.select("event_id", baseline.structured_fingerprint(F.col("props").cast("binary")).alias("fingerprint"))


@query("code_fingerprint64")
def _(t):
    return t.pages.select("page_id", baseline.code_fingerprint(F.col("html").cast("binary")).alias("fingerprint"))


_LADDER = " ".join(f"WHEN op <= {last} THEN '{name}'" for last, name in classfile.CATEGORIES)


@query("opcode_categories", f"SELECT category, count(*) AS n, min(op) AS first FROM (SELECT op, CASE {_LADDER} END AS category FROM (SELECT o_orderkey % 256 AS op FROM orders)) GROUP BY 1")
def _(t):
    ops = t.orders.select((F.col("o_orderkey") % 256).alias("op")).select("op", classfile.opcode_category(F.col("op")).alias("category"))
    return ops.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.min("op").alias("first"))


# ---- graphs of queries


def query_edges(t: Tables) -> DataFrame:
    """Consecutive components of a query."""
    n = nodes(t).select("query_id", F.col("node_id").alias("node_a"))
    return n.join(n.select("query_id", (F.col("node_a") - 10).alias("node_a"), F.col("node_a").alias("node_b")), ["query_id", "node_a"])


@query("soft_graph_labels")
def _(t):
    return relabel.soft_graph(table(t).select("query_id", "node_id", "parent", "fused"), query_edges(t), 0.02, 0.01)


@query("bridge_cuts")
def _(t):
    return relabel.bridge_cuts(table(t).select("query_id", "node_id", "parent", "fused"), query_edges(t), 0.005)


@query("hierarchical_assignment")
def _(t):
    return relabel.hierarchical(table(t).select("query_id", "node_id", "parent", "fused"), query_edges(t), 0.005)


@query(
    "edge_corruption",
    """WITH e AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_quantity = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sha256('0|drop|' || a || '-' || b), b) AS place, count(*) OVER (PARTITION BY a) AS n FROM e) SELECT a, b FROM r WHERE place > floor(0.3 * n)""",
    full={"lines": "true"},
)
def _(t, lines="l_quantity = 1"):
    e = t.lineitem.where(lines).select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    return protocol.thinned(e, "a", F.concat_ws("-", "a", "b"), 0.3)


# ---- assignment variants and comparisons


@query(
    "global_parent_pair",
    f"""WITH {_TABLE}, p AS (SELECT x.query_id, x.parent AS p1, y.parent AS p2, round(sum(least(x.fused, y.fused)), 9) AS total FROM tab x JOIN tab y ON x.query_id = y.query_id AND x.node_id = y.node_id AND x.parent < y.parent GROUP BY ALL)
SELECT query_id, p1, p2, total FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total, p1, p2) AS place FROM p) WHERE place = 1""",
)
def _(t):
    return protocol.global_pair(table(t).select("query_id", "node_id", "parent", "fused"))


@query(
    "prediction_comparison",
    f"""WITH {_SOLVE}, a AS (SELECT query_id, node_id, arg_min(parent, (round(cost, 9), parent)) FILTER (eligible) AS one FROM tab GROUP BY ALL),
b AS (SELECT b.query_id, n.node_id, (SELECT arg_min(t.parent, (round(t.cost, 9), t.parent)) FROM tab t WHERE t.query_id = b.query_id AND t.node_id = n.node_id AND t.eligible AND t.cost <= 1 AND (t.parent = p1 OR t.parent = p2 OR t.parent = p3)) AS other FROM best b JOIN nodes n ON n.query_id = b.query_id)
SELECT query_id, node_id, one, other, one IS NOT DISTINCT FROM other AS same FROM a FULL JOIN b USING (query_id, node_id)""",
    full={"method": PUBLISHED},
)
def _(t, method=METHOD):
    tab, _, _, pairs = outcome(t, method)
    return protocol.compared(assign.independent(tab).withColumnRenamed("parent", "one"), pairs.select("query_id", "node_id", F.col("predicted").alias("other")), ["query_id", "node_id"])


@query("candidate_universe", f"WITH {_TABLE}, n AS (SELECT query_id, count(*) AS n FROM nodes GROUP BY 1) SELECT t.query_id, parent FROM tab t JOIN n USING (query_id) WHERE fused < 0.3 GROUP BY t.query_id, parent, n HAVING count(*) = n")
def _(t):
    return protocol.shared_by_all(table(t).where("fused < 0.3"), nodes(t))


@query(
    "nested_gallery",
    f"""WITH {_TABLE}, o AS (SELECT parent, row_number() OVER (ORDER BY sha256('0||' || parent), parent) AS place FROM (SELECT DISTINCT parent FROM gal)),
m AS (SELECT scale, query_id, node_id, min(fused) AS best FROM tab JOIN o USING (parent) CROSS JOIN (VALUES (2), (4), (8)) s(scale) WHERE place <= scale GROUP BY ALL)
SELECT scale, count(*) AS nodes, round(avg(best), 9) AS mean_best FROM m GROUP BY scale""",
)
def _(t):
    return rounded(protocol.nested(table(t), [2, 4, 8]), "mean_best")


@query(
    "clone_support",
    """WITH s AS (SELECT l_orderkey AS node_id, l_suppkey AS parent, count(DISTINCT l_partkey) AS support FROM lineitem GROUP BY ALL),
r AS (SELECT *, max(support) OVER (PARTITION BY node_id) AS best FROM s)
SELECT node_id, max(best) AS support, count(*) AS ties, CASE WHEN count(*) = 1 THEN max(parent) END AS parent FROM r WHERE support = best GROUP BY node_id""",
)
def _(t):
    return protocol.clone_votes(t.lineitem.select(F.col("l_orderkey").alias("node_id"), F.col("l_suppkey").alias("parent"), F.col("l_partkey").alias("method")))


@query(
    "older_versions",
    "SELECT o_custkey, o_orderkey, place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders) WHERE place BETWEEN 2 AND 4",
)
def _(t):
    return protocol.older(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], 3).select("o_custkey", "o_orderkey", "place")


@query("version_before_date", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1995-06-30' GROUP BY 1")
def _(t):
    return protocol.as_of(t.orders, "o_custkey", "o_orderdate", "o_orderkey", F.lit("1995-06-30").cast("timestamp_ntz"))


@query(
    "pseudo_unknown_protocol",
    f"""WITH {_SIG}, tr AS (SELECT DISTINCT query_id, truth AS parent FROM nodes WHERE truth IS NOT NULL),
h AS (SELECT query_id, parent, row_number() OVER (PARTITION BY query_id ORDER BY sha256('0|hide|' || query_id || '-' || parent), parent) AS place, count(*) OVER (PARTITION BY query_id) AS n FROM tr)
SELECT h.query_id, h.parent AS hidden_parent, n - 1 AS visible_true_parents, count(*) FILTER (truth = h.parent) AS pseudo_unknown_components FROM h JOIN nodes ON nodes.query_id = h.query_id WHERE place = 1 GROUP BY ALL""",
)
def _(t):
    return protocol.hidden(nodes(t))


@query(
    "hidden_parent_scores",
    f"""WITH {_TABLE}, tr AS (SELECT DISTINCT query_id, truth AS parent FROM nodes WHERE truth IS NOT NULL),
h AS (SELECT query_id, parent FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sha256('0|hide|' || query_id || '-' || parent), parent) AS place FROM tr) WHERE place = 1)
SELECT query_id, node_id, parent, fused, h.parent IS NULL AS visible FROM tab LEFT JOIN h USING (query_id, parent)""",
)
def _(t):
    rows, hide = table(t).select("query_id", "node_id", "parent", "fused"), protocol.hidden(nodes(t))
    return protocol.restored(rows, hide)


_PAIR = "st AS (SELECT l.doc_id AS query_id, d.lang AS stratum, CAST(l.quality AS DOUBLE) - l.toxic AS value FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"


@query(
    "paired_bootstrap",
    f"""WITH {_PAIR}, {_DRAWS.format(s="stratum")}
SELECT round(avg(mean), 9) AS delta, round(quantile_cont(mean, 0.025), 9) AS low, round(quantile_cont(mean, 0.975), 9) AS high, avg((mean > 0)::DOUBLE) AS p_above, avg((mean >= 0)::DOUBLE) AS p_not_below,
  quantile_cont(mean, 0.025) > 0 OR quantile_cont(mean, 0.975) < 0 AS excludes_zero,
  CASE WHEN quantile_cont(mean, 0.025) > 0 THEN 'BETTER' WHEN quantile_cont(mean, 0.975) < 0 THEN 'WORSE' ELSE 'UNDECIDED' END AS direction FROM bs""",
    full={"replicates": REPLICATES},
)
def _(t, replicates=200):
    d = t.labels.join(t.documents.select("doc_id", F.col("lang").alias("stratum")), "doc_id").select(F.col("doc_id").alias("query_id"), "stratum", (F.col("quality").cast("double") - F.col("toxic")).alias("value"))
    means = resample.bootstrap(d, "stratum", "value", replicates).select(F.col("mean").alias("a"), F.lit(0.0).alias("b"))
    return rounded(resample.paired(means), "delta", "low", "high")


@query("volume_tiles", f"WITH {_SIG} SELECT parent, count(*) * 3 AS components FROM gal GROUP BY 1")
def _(t):
    from .catalogue import gallery

    return protocol.tiled(gallery(t), 3).groupBy("parent").agg(F.count(F.lit(1)).alias("components"))


@query(
    "chosen_per_stratum",
    "SELECT source, lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY sha256('0|choose|' || doc_id), doc_id) AS place FROM documents) WHERE place <= 2",
)
def _(t):
    place = F.row_number().over(Window.partitionBy("source", "lang").orderBy(hash_order(F.col("doc_id"), salt="choose"), "doc_id"))
    return t.documents.select("source", "lang", "doc_id").withColumn("place", place).where("place <= 2").drop("place")


assert METHOD.most_parents == 3  # the SQL above enumerates sets of at most three
