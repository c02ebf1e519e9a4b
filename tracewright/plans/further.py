"""Queries over entries, names, protocols, graphs and resampling, with the SQL that says what each returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import assign, distance, graph, metrics, protocol, resample
from ..sources.tables import Tables
from .catalogue import _ASSIGNED, _CI, _POOL, _SIG, _SOLVE, _STATS, _TABLE, METHOD, REPLICATES, gallery, nodes, outcome, pool_of, query, rounded, signatures, stats, table
from .more import query_edges

# ---- entries, names and fields


def _case(value: str, choices: list[str], other: str) -> str:
    """SQL that both engines read: choices by remainder."""
    return f"CASE {value} % {len(choices) + 1} " + " ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(choices)) + f" ELSE {other} END"


_ENTRY = f"""concat({_case('page_id', ["'META-INF/'", "'__MACOSX/'", "'src/main/java/'", "'x/src/main/resources/test/'", "'Src/Main/kotlin/a/'"], "'build/src/main/java/'")}, 'n', page_id, {_case('page_id', ["'.class'", "'/.DS_Store'", "'.json'", "'.PNG'"], "'.txt'")})"""


@query(
    "entry_filter",
    f"""WITH p AS (SELECT page_id, {_ENTRY} AS path FROM pages)
SELECT page_id, path, starts_with(lower(path), 'meta-inf/') OR contains(lower(path), '__macosx/') OR ends_with(lower(path), '.ds_store') AS ignored,
  regexp_matches(lower(path), '(^|/)src/main/(java|kotlin|resources)/') AND NOT regexp_matches('/' || lower(path), '/(test|tests|example|examples|fixture|fixtures|sample|samples|template|templates|build|target)/') AS production,
  CASE WHEN starts_with(path, 'META-INF/') THEN NULL WHEN ends_with(path, '.class') THEN 'CODE_BINARY' WHEN ends_with(path, '.json') THEN 'STRUCTURED' WHEN ends_with(path, '.PNG') THEN 'IMAGE' END AS modality FROM p""",
)
def _(t):
    p = t.pages.select("page_id", F.expr(_ENTRY).alias("path"))
    return p.select("page_id", "path", fx.ignored_entry(F.col("path")).alias("ignored"), fx.production_path(F.col("path")).alias("production"), fx.modality(F.col("path")).alias("modality"))


_SPLIT = _case("doc_id", ["'CALIBRATION_KNOWN'", "'TEST_KNOWN'", "'UNKNOWN_HELDOUT'"], "'OTHER'")


@query(
    "split_stage",
    f"""WITH d AS (SELECT source, {_SPLIT} AS split FROM documents)
SELECT source, split, CASE WHEN split = 'CALIBRATION_KNOWN' THEN 'CALIBRATION' WHEN split IN ('TEST_KNOWN', 'UNKNOWN_HELDOUT') THEN 'TEST' END AS stage, count(*) AS n FROM d GROUP BY ALL""",
)
def _(t):
    d = t.documents.select("source", F.expr(_SPLIT).alias("split"))
    return d.groupBy("source", "split").agg(F.count(F.lit(1)).alias("n")).select("source", "split", fx.stage_of_split(F.col("split")).alias("stage"), "n")


@query("stage_filter", f"SELECT doc_id, lang FROM documents WHERE {_SPLIT} IN ('TEST_KNOWN', 'UNKNOWN_HELDOUT') AND lang IS NOT NULL")
def _(t):
    return t.documents.where(fx.stage_of_split(F.expr(_SPLIT)) == "TEST").where("lang is not null").select("doc_id", "lang")


_NAME = _case("p_partkey", ["concat('[Lorg/x', p_partkey, ';')", "'[[I'", "concat('org/A', p_partkey, '$B.class')", "'c.class'", "'a/Y$.CLASS'"], "'[[Lz/Q;'")
_FLAG = _case("p_partkey", ["'1'", "' True'", "'YES'", "'y '", "'no'", "''"], "'t'")


@query(
    "class_names",
    f"""WITH p AS (SELECT p_partkey, {_NAME} AS name, {_FLAG} AS flag FROM part)
SELECT p_partkey, CASE WHEN ends_with(name, '.class') THEN regexp_replace(regexp_extract(name, '[^/]*$'), '([$].*)?[.]class$', '') ELSE '' END AS outer_class,
  CASE WHEN starts_with(name, '[') THEN nullif(regexp_extract(name, '^[[]+L(.+);$', 1), '') ELSE name END AS reference, lower(trim(flag)) IN ('1', 'true', 'yes', 'y') AS flag FROM p""",
)
def _(t):
    p = t.part.select("p_partkey", F.expr(_NAME).alias("name"), F.expr(_FLAG).alias("flag"))
    return p.select("p_partkey", fx.outer_class(F.col("name")).alias("outer_class"), fx.class_reference(F.col("name")).alias("reference"), fx.as_bool(F.col("flag")).alias("flag"))


_REPO = _case("page_id", ["concat('https://github.com/o', page_id, '/r2.git/')", "'http://WWW.GitHub.com/o/r/tree/x?y=1'", "'https://gitlab.com/a/b'", "'https://github.com/only'", "''", "' https://github.com//a//b.git'"], "NULL")


@query(
    "repository_urls",
    f"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(trim(coalesce({_REPO}, '')), '/+$', ''), '[.]git$', '') AS u FROM pages),
q AS (SELECT page_id, lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host, list_filter(string_split(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM p)
SELECT page_id, CASE WHEN host IN ('github.com', 'www.github.com') AND len(parts) >= 2 THEN 'https://github.com/' || parts[1] || '/' || parts[2] ELSE '' END AS repository FROM q""",
)
def _(t):
    return t.pages.select("page_id", fx.repository_url(F.expr(_REPO)).alias("repository"))


@query(
    "capacity_flags",
    "SELECT o_custkey, count(*) AS n, count(*) >= 5 AS supports_budget_5, count(*) >= 10 AS supports_budget_10, count(*) >= 20 AS supports_budget_20, count(DISTINCT o_orderpriority) >= 4 AS supports_template FROM orders GROUP BY 1",
)
def _(t):
    n = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderpriority").alias("kinds"))
    return n.select("o_custkey", "n", *[(F.col("n") >= b).alias(f"supports_budget_{b}") for b in (5, 10, 20)], (F.col("kinds") >= 4).alias("supports_template"))


_RELEASES = """comp AS (SELECT doc_id AS id, lang AS project, substr(text, 1, 12) AS path, sha256(lower(text)) AS sha FROM documents WHERE lang IS NOT NULL), now_ AS (SELECT * FROM comp WHERE id % 2 = 1), then_ AS (SELECT * FROM comp WHERE id % 2 = 0)"""


def _releases(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(old, current) components; the first characters stand for a path."""
    rows = t.documents.where("lang is not null").select(F.col("doc_id").alias("id"), F.col("lang").alias("project"), F.left("text", F.lit(12)).alias("path"), F.sha2(F.lower("text"), 256).alias("sha"))
    return rows.where("id % 2 = 0"), rows.where("id % 2 = 1")


@query(
    "hard_masks",
    f"""WITH {_RELEASES} SELECT id, NOT EXISTS (SELECT 1 FROM now_ n WHERE n.project = o.project AND n.sha = o.sha) AS hard,
  NOT EXISTS (SELECT 1 FROM now_ n WHERE n.project = o.project AND n.sha = o.sha) AND NOT EXISTS (SELECT 1 FROM now_ n WHERE n.project = o.project AND n.path = o.path) AS strict FROM then_ o""",
)
def _(t):
    return protocol.masks(*_releases(t))


@query("image_survival", f"WITH {_RELEASES} SELECT id, project FROM then_ o WHERE EXISTS (SELECT 1 FROM now_ n WHERE n.project = o.project AND n.sha = o.sha)")
def _(t):
    old, now = _releases(t)
    return old.join(now.select("project", "sha"), ["project", "sha"], "left_semi").select("id", "project")


@query(
    "sha_or_path_verdicts",
    f"""WITH {_RELEASES}, s AS (SELECT sha, list(DISTINCT project) AS a FROM now_ GROUP BY 1), p AS (SELECT path, list(DISTINCT project) AS b FROM now_ GROUP BY 1),
u AS (SELECT o.id, o.project, list_distinct(list_concat(coalesce(a, []), coalesce(b, []))) AS f FROM then_ o LEFT JOIN s ON s.sha = o.sha LEFT JOIN p ON p.path = o.path)
SELECT id, len(f) AS candidates, CASE WHEN len(f) = 0 THEN 'NO_MATCH' WHEN len(f) = 1 THEN CASE WHEN list_contains(f, project) THEN 'CORRECT_UNIQUE' ELSE 'WRONG_UNIQUE' END
  WHEN list_contains(f, project) THEN 'AMBIGUOUS_TRUE_INCLUDED' ELSE 'AMBIGUOUS_WRONG' END AS verdict FROM u""",
)
def _(t):
    old, now = _releases(t)
    rows = old
    for key in ("sha", "path"):
        rows = rows.join(now.groupBy(key).agg(F.collect_set("project").alias(f"by_{key}")), key, "left")
    none = F.array().cast("array<string>")
    found = F.array_union(F.coalesce("by_sha", none), F.coalesce("by_path", none))
    return rows.select("id", F.size(found).cast("long").alias("candidates"), fx.set_verdict(found, F.col("project")).alias("verdict"))


@query(
    "candidate_filter",
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'O' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""",
)
def _(t):
    seen = t.orders.where("o_orderstatus = 'P'").select("o_custkey").distinct()
    return t.orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_orderstatus") == "O")).join(seen, "o_custkey", "left_anti").select("o_orderkey", "o_custkey")


@query("role_lookup", "SELECT c_custkey, n_name AS role FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(t):
    roles = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("role"))
    return protocol.with_roles(t.customer.select("c_custkey", "c_nationkey"), roles, "c_nationkey", "role").select("c_custkey", "role")


@query(
    "package_stats_merge",
    "SELECT c_custkey, coalesce(n, 0) AS n, round(coalesce(total, 0), 2) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(CAST(o_totalprice AS DOUBLE)) AS total FROM orders GROUP BY 1) ON o_custkey = c_custkey",
)
def _(t):
    own = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("double")).alias("total"))
    return t.customer.select("c_custkey").join(own, "c_custkey", "left").fillna(0, ["n", "total"]).withColumn("total", F.round("total", 2))


_FILE = "concat('src/', s_nationkey, '/n', s_suppkey % 50, '.java')"
_CLASS = "concat(p_partkey % 30, '/n', p_partkey % 60, '.java')"


@query(
    "class_source_map",
    f"""WITH f AS (SELECT DISTINCT {_FILE} AS path FROM supplier), r AS (SELECT p_partkey AS id, {_CLASS} AS path FROM part),
a AS (SELECT r.id, r.path, count(f.path) AS n, min(f.path) AS file FROM r LEFT JOIN f ON f.path = r.path OR ends_with(f.path, '/' || r.path) GROUP BY ALL),
b AS (SELECT r.id, count(f.path) AS n, min(f.path) AS file FROM r LEFT JOIN f ON regexp_extract(f.path, '[^/]*$') = regexp_extract(r.path, '[^/]*$') GROUP BY ALL)
SELECT a.id, CASE WHEN a.n = 1 THEN 'SUFFIX' WHEN a.n > 1 THEN 'AMBIGUOUS_SUFFIX' WHEN b.n = 1 THEN 'BASENAME' WHEN b.n > 1 THEN 'AMBIGUOUS_BASENAME' ELSE 'MISSING' END AS status,
  CASE WHEN a.n = 1 THEN a.file WHEN a.n = 0 AND b.n = 1 THEN b.file END AS file FROM a JOIN b USING (id)""",
)
def _(t):
    return protocol.source_files(t.part.select(F.col("p_partkey").alias("id"), F.expr(_CLASS).alias("path")), t.supplier.select(F.expr(_FILE).alias("path")))


_TAG = f"concat('v1.', o_orderkey % 9, {_case('o_orderkey', ["''", "'-rc'"], "'+x'")})"
_NORMAL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({}), '_', '-', 'g'), '^refs/tags/', ''), '^v([0-9])', '\\1'), '[^a-z0-9]', '', 'g')"


@query(
    "version_tags",
    f"""WITH g AS (SELECT o_custkey AS repo, {_NORMAL.format(_TAG)} AS tag, o_orderdate AS date FROM orders), w AS (SELECT c_custkey AS id, c_custkey AS repo, {_NORMAL.format(_case('c_custkey', ["concat('1.', c_custkey % 9)", "concat('', c_custkey % 9, 'x')"], "'V7_0'"))} AS version FROM customer),
f AS (SELECT w.id, max((g.date, g.tag)) FILTER (g.tag = version) AS e, count(DISTINCT g.tag) FILTER (ends_with(g.tag, version)) AS n, max((g.date, g.tag)) FILTER (ends_with(g.tag, version)) AS s, max((g.date, g.tag)) FILTER (g.date <= TIMESTAMP '1996-01-01') AS d FROM w JOIN g USING (repo) GROUP BY w.id),
h AS (SELECT w.id, e[2] AS e, CASE WHEN n = 1 THEN s[2] END AS s, d[2] AS d FROM w LEFT JOIN f USING (id))
SELECT id, coalesce(e, s, d) AS tag, CASE WHEN e IS NOT NULL THEN 'EXACT' WHEN s IS NOT NULL THEN 'SUFFIX' WHEN d IS NOT NULL THEN 'DATE' ELSE 'NONE' END AS how FROM h""",
)
def _(t):
    tags = t.orders.select(F.col("o_custkey").alias("repo"), fx.normal_version(F.expr(_TAG)).alias("tag"), F.col("o_orderdate").alias("date"))
    version = F.expr(_case("c_custkey", ["concat('1.', c_custkey % 9)", "concat('', c_custkey % 9, 'x')"], "'V7_0'"))
    wanted = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("repo"), fx.normal_version(version).alias("version"), F.lit("1996-01-01").cast("timestamp_ntz").alias("date"))
    return protocol.chosen_tags(wanted, tags)


@query(
    "hash_words",
    """WITH h AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE substr(sha256(text), 1, 32) END AS h FROM documents)
SELECT doc_id, CASE WHEN h <> '' THEN CAST('0x' || substr(h, 1, 8) AS BIGINT) END AS w0, CASE WHEN h <> '' THEN CAST('0x' || substr(h, 25, 8) AS BIGINT) END AS w3 FROM h""",
)
def _(t):
    h = t.documents.select("doc_id", F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.left(F.sha2("text", 256), F.lit(32))).alias("h"))
    return h.select("doc_id", fx.hex_words(F.col("h"), 4).alias("w")).select("doc_id", F.col("w")[0].alias("w0"), F.col("w")[3].alias("w3"))


_BINS = "list_transform(embedding[{}:{}], lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 1000) AS BIGINT))"


@query(
    "histogram_distances",
    f"""WITH h AS (SELECT vec_id, {_BINS.format(1, 16)} AS a, {_BINS.format(17, 32)} AS b FROM embeddings)
SELECT vec_id, least(greatest(list_sum(list_transform(a, lambda x, i: abs(x - b[i]))) / 20000.0, 0), 1) AS distance FROM h""",
)
def _(t):
    bins = lambda at: F.transform(F.slice("embedding", at, 16), lambda x: F.floor(F.abs(x.cast("double")) * 1000))
    return t.embeddings.select("vec_id", fx.histogram_distance(bins(1), bins(17)).alias("distance"))


@query(
    "signature_equality",
    """WITH v AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '7' WHEN 1 THEN '7.0' WHEN 2 THEN '' ELSE ' x ' END AS a, CASE page_id % 3 WHEN 0 THEN '7' WHEN 1 THEN '' ELSE 'x' END AS b FROM pages)
SELECT page_id, CASE WHEN trim(a) = '' OR trim(b) = '' THEN trim(a) = trim(b) ELSE trim(a) = trim(b) END AS as_text,
  CASE WHEN trim(a) = '' OR trim(b) = '' THEN trim(a) = trim(b) ELSE coalesce(TRY_CAST(trim(a) AS DOUBLE) = TRY_CAST(trim(b) AS DOUBLE), false) END AS as_number FROM v""",
)
def _(t):
    pick = lambda n, choices, other: F.expr(f"CASE page_id % {n} " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(choices)) + f" ELSE '{other}' END")
    a, b = pick(4, ["7", "7.0", ""], " x "), pick(3, ["7", ""], "x")
    return t.pages.select("page_id", fx.same_value(a, b, False).alias("as_text"), fx.same_value(a, b, True).alias("as_number"))


# ---- candidates, sets and outcomes


@query("primary_versions", "SELECT o_custkey, arg_min(o_orderkey, (CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderdate, o_orderkey)) AS o_orderkey FROM orders WHERE o_totalprice > 1000 GROUP BY 1")
def _(t):
    priority = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return t.orders.where("o_totalprice > 1000").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct(priority, "o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("pool_of_at_least", f"WITH {_POOL} SELECT query_id, parent, rank FROM pool")
def _(t):
    return protocol.at_least(pool_of(table(t)), "query_id", 2).select("query_id", "parent", "rank")


@query(
    "aligned_methods",
    f"""WITH {_ASSIGNED}, a AS (SELECT query_id, node_id, arg_min(parent, (round(cost, 9), parent)) FILTER (eligible) AS one FROM tab GROUP BY ALL)
SELECT a.query_id, a.node_id, one, predicted AS other FROM a JOIN found f ON f.query_id = a.query_id AND f.node_id = a.node_id""",
)
def _(t):
    tab, _, _, pairs = outcome(t)
    return protocol.aligned(assign.independent(tab).withColumnRenamed("parent", "one"), pairs.select("query_id", "node_id", F.col("predicted").alias("other")), ["query_id", "node_id"])


@query(
    "oracle_k_known",
    f"""WITH {_SOLVE}, tk AS (SELECT query_id, least(count(DISTINCT truth), 3) AS k FROM nodes GROUP BY 1),
o AS (SELECT t.*, row_number() OVER (PARTITION BY t.query_id ORDER BY objective, r1, r2, r3) AS own FROM total t JOIN tk ON tk.query_id = t.query_id AND tk.k = t.k)
SELECT query_id, objective, k, p1, p2, p3 FROM o WHERE own = 1""",
)
def _(t):
    tab = table(t)
    true = nodes(t).groupBy("query_id").agg(F.least(F.countDistinct("truth"), F.lit(METHOD.most_parents)).cast("int").alias("k"))
    return assign.solve(tab, pool_of(tab), METHOD, by_size=True).join(true, ["query_id", "k"]).select("query_id", "objective", "k", "p1", "p2", "p3")


@query(
    "global_parent_sets",
    f"""WITH {_TABLE}, s AS (SELECT query_id, node_id, 1 AS k, parent AS p1, NULL::INTEGER AS p2, NULL::INTEGER AS p3, fused AS d FROM tab
UNION ALL SELECT x.query_id, x.node_id, 2, x.parent, y.parent, NULL, least(x.fused, y.fused) FROM tab x JOIN tab y ON x.query_id = y.query_id AND x.node_id = y.node_id AND x.parent < y.parent
UNION ALL SELECT x.query_id, x.node_id, 3, x.parent, y.parent, z.parent, least(x.fused, y.fused, z.fused) FROM tab x JOIN tab y ON x.query_id = y.query_id AND x.node_id = y.node_id AND x.parent < y.parent JOIN tab z ON z.query_id = x.query_id AND z.node_id = x.node_id AND y.parent < z.parent),
g AS (SELECT query_id, k, p1, p2, p3, round(sum(d), 9) AS total FROM s GROUP BY ALL)
SELECT query_id, k, total, p1, p2, p3 FROM (SELECT *, row_number() OVER (PARTITION BY query_id, k ORDER BY total, p1, p2, p3) AS place FROM g) WHERE place = 1""",
)
def _(t):
    return protocol.global_sets(table(t).select("query_id", "node_id", "parent", "fused"))


@query(
    "package_parent_restricted",
    f"""WITH {_TABLE}, r AS (SELECT *, rank() OVER (PARTITION BY query_id, node_id ORDER BY fused) AS place FROM tab),
v AS (SELECT query_id, parent, round(sum(1.0 / place), 9) AS votes FROM r GROUP BY ALL), top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, parent) AS own FROM v) WHERE own <= 2)
SELECT t.query_id, t.node_id, arg_min(t.parent, (t.fused, t.parent)) AS parent FROM tab t JOIN top USING (query_id, parent) GROUP BY ALL""",
)
def _(t):
    tab = table(t)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("reciprocal", 9).desc(), "parent"))
    top = assign.votes(tab).withColumn("place", place).where("place <= 2").select("query_id", "parent")
    return tab.join(top, ["query_id", "parent"]).groupBy("query_id", "node_id").agg(F.min_by("parent", F.struct("fused", "parent")).alias("parent"))


_GRID = """grid AS (SELECT t.query_id, t.node_id, t.parent, a.alpha, h.view, a.alpha * least(fused / 0.25, 1.0) + (1 - a.alpha) * least(greatest(regret, 0.0), 1.0) AS c, eligible
  FROM tab t CROSS JOIN (VALUES (0.25), (0.5), (0.75), (1.0)) a(alpha) CROSS JOIN (VALUES ('KNOWN'), ('PSEUDO')) h(view) LEFT JOIN hid ON hid.query_id = t.query_id AND hid.parent = t.parent WHERE view = 'KNOWN' OR hid.parent IS NULL)"""


@query(
    "alpha_grid",
    f"""WITH {_TABLE}, tr AS (SELECT DISTINCT query_id, truth AS parent FROM nodes WHERE truth IS NOT NULL),
hid AS (SELECT query_id, parent FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sha256('0|hide|' || query_id || '-' || parent), parent) AS place FROM tr) WHERE place = 1), {_GRID},
b AS (SELECT query_id, node_id, alpha, view, arg_min(parent, (round(c, 9), parent)) FILTER (eligible AND c <= 1) AS parent FROM grid GROUP BY ALL)
SELECT CAST(alpha AS DOUBLE) AS alpha, view, avg((b.parent IS NOT DISTINCT FROM CASE WHEN view = 'KNOWN' OR hid.parent IS NULL THEN truth END)::DOUBLE) AS accuracy, count(*) FILTER (b.parent IS NULL) AS unknown
FROM b JOIN nodes n ON n.query_id = b.query_id AND n.node_id = b.node_id LEFT JOIN hid ON hid.query_id = b.query_id AND hid.parent = n.truth GROUP BY 1, 2""",
)
def _(t):
    tab, hide = table(t), protocol.hidden(nodes(t)).select("query_id", F.col("hidden_parent").alias("parent")).withColumn("hidden", F.lit(True))
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(v).alias("view")) for a in (0.25, 0.5, 0.75, 1.0) for v in ("KNOWN", "PSEUDO")]))
    grid = tab.join(hide, ["query_id", "parent"], "left").withColumn("cell", cells).where("cell.view = 'KNOWN' or hidden is null")
    cost = F.col("cell.alpha") * F.least(F.col("fused") / METHOD.threshold, F.lit(1.0)) + (1 - F.col("cell.alpha")) * F.least(F.greatest("regret", F.lit(0.0)), F.lit(1.0))
    usable = F.when(F.col("eligible") & (cost <= 1), F.struct(F.round(cost, 9), F.col("parent")))
    best = grid.groupBy("query_id", "node_id", "cell").agg(F.min(usable).alias("best"))
    truth = nodes(t).select("query_id", "node_id", "truth").join(hide.withColumnRenamed("parent", "truth"), ["query_id", "truth"], "left")
    wanted = F.when((F.col("cell.view") == "KNOWN") | F.col("hidden").isNull(), F.col("truth"))
    rows = best.join(truth, ["query_id", "node_id"]).select("cell.alpha", "cell.view", F.col("best.parent").alias("found"), wanted.alias("wanted"))
    return rows.groupBy("alpha", "view").agg(F.avg(F.col("found").eqNullSafe(F.col("wanted")).cast("double")).alias("accuracy"), F.count_if(F.col("found").isNull()).alias("unknown"))


_EDGES = "e AS (SELECT a.query_id, a.node_id AS node_a, b.node_id AS node_b FROM nodes a JOIN nodes b ON a.query_id = b.query_id AND b.node_id = a.node_id + 10)"
_SMOOTH = f"""{_EDGES}, both_ AS (SELECT query_id, node_a, node_b FROM e UNION ALL SELECT query_id, node_b, node_a FROM e),
tops AS (SELECT query_id, node_id, list(parent) AS tops FROM (SELECT *, row_number() OVER (PARTITION BY query_id, node_id ORDER BY round(cost, 9), parent) AS place FROM tab) WHERE place <= 3 GROUP BY ALL),
w AS (SELECT b.*, len(list_intersect(x.tops, y.tops)) / CAST(len(list_distinct(list_concat(x.tops, y.tops))) AS DOUBLE) AS w FROM both_ b JOIN tops x ON x.query_id = b.query_id AND x.node_id = node_a JOIN tops y ON y.query_id = b.query_id AND y.node_id = node_b),
near AS (SELECT w.query_id, node_a AS node_id, t.parent, sum(w * t.cost) / sum(w) AS near FROM w JOIN tab t ON t.query_id = w.query_id AND t.node_id = node_b WHERE w > 0 GROUP BY ALL),
sm AS (SELECT t.query_id, t.node_id, t.parent, eligible, beta, CASE WHEN near IS NULL THEN cost ELSE (1 - beta) * cost + beta * near END AS cost FROM tab t LEFT JOIN near n ON n.query_id = t.query_id AND n.node_id = t.node_id AND n.parent = t.parent CROSS JOIN (VALUES (0.0::DOUBLE), (0.1), (0.2), (0.3), (0.4), (0.5)) b(beta)),
pick AS (SELECT query_id, node_id, beta, arg_min(parent, (round(cost, 9), parent)) FILTER (eligible) AS parent FROM sm GROUP BY ALL),
acc AS (SELECT beta, avg((p.parent IS NOT DISTINCT FROM truth)::DOUBLE) AS accuracy, count(*) FILTER (p.parent IS NULL AND truth IS NULL) AS unknown_right FROM pick p JOIN nodes n ON n.query_id = p.query_id AND n.node_id = p.node_id GROUP BY beta)"""
BETAS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5)


def _beta_scores(t: Tables) -> DataFrame:
    """Accuracy and known UNKNOWNs of independent assignment after smoothing with each beta."""
    tab, edges, truth = table(t), query_edges(t), nodes(t).select("query_id", "node_id", "truth")
    near = assign.smoothed(tab, edges, 1.0).select("query_id", "node_id", "parent", "eligible", F.col("cost").alias("near"))
    both = near.join(tab.select("query_id", "node_id", "parent", "cost"), ["query_id", "node_id", "parent"])
    grid = both.withColumn("beta", F.explode(F.array(*map(F.lit, BETAS)))).withColumn("cost", (1 - F.col("beta")) * F.col("cost") + F.col("beta") * F.col("near"))
    best = F.min(F.when(F.col("eligible"), F.struct(F.round("cost", 9), F.col("parent"))))
    found = grid.groupBy("query_id", "node_id", "beta").agg(best.alias("best")).select("query_id", "node_id", "beta", F.col("best.parent").alias("found")).join(truth, ["query_id", "node_id"])
    return found.groupBy("beta").agg(F.avg(F.col("found").eqNullSafe(F.col("truth")).cast("double")).alias("accuracy"), F.count_if(F.col("found").isNull() & F.col("truth").isNull()).alias("unknown_right"))


@query("beta_grid", f"WITH {_TABLE}, {_SMOOTH} SELECT beta, accuracy, unknown_right, (accuracy, unknown_right, -beta) = (SELECT max((accuracy, unknown_right, -beta)) FROM acc) AS selected FROM acc")
def _(t):
    scores = _beta_scores(t)
    best = scores.agg(F.max_by("beta", F.struct("accuracy", "unknown_right", -F.col("beta"))).alias("best"))
    return scores.join(F.broadcast(best)).select("beta", "accuracy", "unknown_right", (F.col("beta") == F.col("best")).alias("selected"))  # six rows and one


@query(
    "keep_decision",
    f"""WITH {_TABLE}, {_SMOOTH} SELECT beta, one, accuracy AS other, accuracy - one AS delta, CASE WHEN accuracy - one > 1e-12 THEN 'KEEP' ELSE 'REJECT' END AS decision FROM acc CROSS JOIN (SELECT accuracy AS one FROM acc WHERE beta = 0) z WHERE beta > 0""",
)
def _(t):
    scores = _beta_scores(t)
    one = scores.where("beta = 0").select(F.col("accuracy").alias("one"))
    return metrics.kept_if_better(scores.where("beta > 0").join(F.broadcast(one)).select("beta", "one", F.col("accuracy").alias("other")))  # a row


@query(
    "failure_taxonomy",
    f"""WITH {_ASSIGNED} SELECT f.query_id, f.node_id, CASE WHEN truth IS NOT DISTINCT FROM predicted THEN 'CORRECT' WHEN truth IS NULL THEN 'UNKNOWN_TO_KNOWN' WHEN predicted IS NULL THEN 'KNOWN_TO_UNKNOWN' ELSE 'WRONG_KNOWN_PARENT' END AS error_type,
  CASE WHEN truth IS NOT DISTINCT FROM predicted THEN 'NONE' WHEN truth IS NOT NULL AND p.parent IS NULL THEN 'RETRIEVAL' ELSE 'RECONSTRUCTION' END AS failure_stage, CASE WHEN truth IS NOT NULL THEN p.parent IS NOT NULL END AS in_pool
FROM found f LEFT JOIN pool p ON p.query_id = f.query_id AND p.parent = f.truth""",
)
def _(t):
    _, pool, _, pairs = outcome(t)
    return metrics.taxonomy(pairs, pool)


@query(
    "three_truths",
    f"""WITH {_ASSIGNED}, l AS (SELECT f.query_id, truth, predicted, coalesce(CAST(truth AS VARCHAR), 'UNKNOWN') AS ct, coalesce(CAST(predicted AS VARCHAR), 'UNKNOWN') AS cp, label FROM found f JOIN embeddings ON vec_id = f.node_id),
g AS (SELECT query_id, list(DISTINCT ct) AS ct, list(DISTINCT cp) AS cp, coalesce(list(DISTINCT truth) FILTER (truth IS NOT NULL), []) AS rt, coalesce(list(DISTINCT predicted) FILTER (predicted IS NOT NULL), []) AS rp, count(DISTINCT label) AS sources FROM l GROUP BY 1),
n AS (SELECT *, len(list_intersect(ct, cp)) AS cb, len(list_intersect(rt, rp)) AS rb FROM g)
SELECT query_id, CASE WHEN cb = 0 THEN 0.0 ELSE round(2.0 * cb / (len(ct) + len(cp)), 9) END AS collapsed_f1, cb = len(ct) AND cb = len(cp) AS collapsed_exact,
  CASE WHEN len(rt) + len(rp) = 0 THEN 1.0 WHEN rb = 0 THEN 0.0 ELSE round(2.0 * rb / (len(rt) + len(rp)), 9) END AS registered_f1, rb = len(rt) AND rb = len(rp) AS registered_exact, len(cp) = len(ct) AS collapsed_k, len(cp) = sources AS actual_k FROM n""",
)
def _(t):
    pairs = outcome(t)[3].join(t.embeddings.select(F.col("vec_id").alias("node_id"), F.col("label").alias("source")), "node_id")
    return rounded(metrics.three_truths(pairs), "collapsed_f1", "registered_f1")


@query(
    "hidden_parent_usage",
    f"""WITH {_SIG}, tr AS (SELECT DISTINCT query_id, truth AS parent FROM nodes WHERE truth IS NOT NULL),
h AS (SELECT query_id, parent FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sha256('0|hide|' || query_id || '-' || parent), parent) AS place FROM tr) WHERE place = 1)
SELECT g.parent, count(h.parent) AS used FROM (SELECT DISTINCT parent FROM gal) g LEFT JOIN h ON h.parent = g.parent GROUP BY 1""",
)
def _(t):
    return metrics.usage(protocol.hidden(nodes(t)).select(F.col("hidden_parent").alias("parent")), "parent", gallery(t))


@query(
    "modal_minima",
    f"""WITH {_SIG}, m AS (SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 'STRUCTURED' ELSE 'IMAGE' END AS modality, list_transform(embedding[1:16], lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 1000) AS BIGINT)) AS h FROM embeddings),
x AS (SELECT n.query_id, n.node_id, g.parent, a.modality, min(bit_count(xor(n.w0, g.w0)) + bit_count(xor(n.w1, g.w1))) / 64.0 AS both_, min(bit_count(xor(n.w0, g.w0))) / 32.0 AS one, min(least(list_sum(list_transform(a.h, lambda v, i: abs(v - b.h[i]))) / 20000.0, 1)) AS hist
  FROM nodes n JOIN m a ON a.vec_id = n.node_id JOIN m b ON b.modality = a.modality JOIN gal g ON g.vec_id = b.vec_id GROUP BY ALL)
SELECT query_id, node_id, parent, round(CASE WHEN modality = 'IMAGE' THEN (one + hist) / 2 ELSE both_ END, 9) AS distance FROM x""",
)
def _(t):
    bins = F.transform(F.slice("embedding", 1, 16), lambda x: F.floor(F.abs(x.cast("double")) * 1000))
    more = t.embeddings.select("vec_id", F.when(F.col("vec_id") % 3 == 0, "STRUCTURED").otherwise("IMAGE").alias("modality"), bins.alias("h"))
    own, other = nodes(t).join(more.withColumnRenamed("vec_id", "node_id"), "node_id"), gallery(t).join(more, "vec_id")
    return rounded(distance.modal_minima(own, other, {"STRUCTURED": {"both": ["w0", "w1"]}, "IMAGE": {"one": ["w0"]}}, {"IMAGE": "h"}), "distance")


# ---- graphs


@query(
    "reference_diagnostic",
    r"""WITH r AS (SELECT DISTINCT page_id AS source, regexp_extract(url, '://([^/?#]*)', 1) AS owner, regexp_extract(unnest(regexp_extract_all(html, 'href="([^"#?]*)"', 1)), '[^/]*$') AS key FROM pages),
g AS (SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) AS owner, regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/]*$') AS key FROM pages)
SELECT source, count(*) FILTER (own) AS internal, count(*) FILTER (NOT own AND any_) AS external, count(*) FILTER (NOT any_) AS unresolved
FROM (SELECT source, EXISTS (SELECT 1 FROM g WHERE g.owner = r.owner AND g.key = r.key) AS own, EXISTS (SELECT 1 FROM g WHERE g.key = r.key) AS any_ FROM r) GROUP BY source""",
)
def _(t):
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    found = F.explode(F.regexp_extract_all("html", F.lit('href="([^"#?]*)"'), F.lit(1)))
    references = t.pages.select(F.col("page_id").alias("source"), host.alias("owner"), found.alias("link")).select("source", "owner", F.regexp_extract("link", "[^/]*$", 0).alias("key"))
    targets = t.pages.select(host.alias("owner"), F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), "[^/]*$", 0).alias("key"))
    return graph.reference_kinds(references, targets, targets)


_GRAPH = f"""{_SIG}, ge AS (SELECT a.query_id AS graph, a.node_id AS a, b.node_id AS b FROM nodes a JOIN nodes b ON a.query_id = b.query_id AND a.node_id < b.node_id AND (a.node_id // 10 + b.node_id // 10) % 3 = 0),
gb AS (SELECT graph, a, b FROM ge UNION SELECT graph, b, a FROM ge), st AS (SELECT query_id AS graph, min(node_id) AS node FROM nodes GROUP BY 1)"""


def _graph(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(edges, starts) of each package: pairs of components by a rule, and the least component."""
    n = nodes(t).select(F.col("query_id").alias("graph"), F.col("node_id").alias("a"))
    pairs = n.join(n.withColumnRenamed("a", "b"), "graph").where("a < b and (a div 10 + b div 10) % 3 = 0")
    return pairs, n.groupBy("graph").agg(F.min("a").alias("node"))


@query(
    "shortest_paths",
    f"""WITH RECURSIVE {_GRAPH}, w AS (SELECT graph, node, 0 AS steps FROM st UNION SELECT w.graph, gb.b, w.steps + 1 FROM w JOIN gb ON gb.graph = w.graph AND gb.a = w.node WHERE w.steps < 6),
d AS (SELECT graph, node, min(steps) AS steps FROM w GROUP BY ALL)
SELECT d.graph, d.node, d.steps, min(p.node) AS before FROM d LEFT JOIN gb ON gb.graph = d.graph AND gb.b = d.node LEFT JOIN d p ON p.graph = d.graph AND p.node = gb.a AND p.steps = d.steps - 1 GROUP BY ALL""",
)
def _(t):
    return graph.distances(*_graph(t), 6)


@query("fragment_growth")
def _(t):
    edges, starts = _graph(t)
    hard = nodes(t).where("truth is null or truth % 2 = 0").select(F.col("query_id").alias("graph"), F.col("node_id").alias("node"))
    return graph.grown(edges, starts, hard, 4, 6)


def _labels(t: Tables) -> DataFrame:
    """(graph, node, component) of the packages' graphs; a component stays inside its package."""
    edges, _ = _graph(t)
    every = nodes(t).select(F.col("query_id").alias("graph"), F.col("node_id").alias("node"))
    return graph.connected_components(edges.select("a", "b"), every.select("node")).join(every, "node").select("graph", "node", "component")


_COMPONENTS = f"""{_GRAPH}, reach AS (SELECT query_id AS graph, node_id AS node, node_id AS r FROM nodes UNION SELECT reach.graph, reach.node, gb.b FROM reach JOIN gb ON gb.graph = reach.graph AND gb.a = reach.r),
lab AS (SELECT graph, node, min(r) AS component FROM reach GROUP BY ALL)"""


@query("package_components", f"WITH RECURSIVE {_COMPONENTS} SELECT graph, node, component FROM lab")
def _(t):
    return _labels(t)


@query(
    "deterministic_connection",
    f"""WITH RECURSIVE {_COMPONENTS}, c AS (SELECT graph, component, min(node) AS node FROM lab GROUP BY ALL),
l AS (SELECT graph, node AS a, lead(node) OVER (PARTITION BY graph ORDER BY sha256('0|connect|' || component), component) AS b FROM c) SELECT graph, a, b FROM l WHERE b IS NOT NULL""",
)
def _(t):
    return graph.chained(_labels(t))


@query(
    "release_graph_statistics",
    f"""WITH RECURSIVE {_COMPONENTS}, s AS (SELECT lab.graph, component, count(*) AS size, count(*) FILTER (truth IS NULL) AS hard FROM lab JOIN nodes ON node_id = node GROUP BY ALL)
SELECT graph, sum(size)::BIGINT AS nodes, count(*) AS components, max(size) / sum(size) AS largest_rate, CASE WHEN sum(hard) > 0 THEN arg_max(hard, (size, -component)) / sum(hard) ELSE 0.0 END AS hard_coverage FROM s GROUP BY graph""",
)
def _(t):
    return graph.release_statistics(_labels(t), nodes(t).where("truth is null").select(F.col("query_id").alias("graph"), F.col("node_id").alias("node")))


@query("induced_edges", f"WITH {_GRAPH} SELECT a, b FROM ge WHERE a % 20 = 0 AND b % 20 = 0")
def _(t):
    edges, _ = _graph(t)
    return graph.induced(edges, nodes(t).where("node_id % 20 = 0").select(F.col("node_id").alias("node")))


# ---- resampling and the building of benchmarks

_UNITS = f"""WITH {_ASSIGNED}, ind AS (SELECT query_id, node_id, arg_min(parent, (round(cost, 9), parent)) FILTER (eligible) AS one FROM tab GROUP BY ALL),
u AS (SELECT f.query_id, sum((f.predicted IS NOT DISTINCT FROM f.truth)::INTEGER) AS a, sum((ind.one IS NOT DISTINCT FROM f.truth)::INTEGER) AS b, count(*) AS m FROM found f JOIN ind ON ind.query_id = f.query_id AND ind.node_id = f.node_id GROUP BY 1)"""


def _units(t: Tables) -> DataFrame:
    """Right components of both methods a package: parent sets (a), independent assignment (b)."""
    tab, _, _, pairs = outcome(t)
    both = pairs.join(assign.independent(tab).withColumnRenamed("parent", "one"), ["query_id", "node_id"])
    right = lambda c: F.sum(F.col(c).eqNullSafe(F.col("truth")).cast("int"))
    return both.groupBy("query_id").agg(right("predicted").alias("a"), right("one").alias("b"), F.count(F.lit(1)).alias("m"))


_PACKAGE_DRAWS = f"""p AS (SELECT *, row_number() OVER (ORDER BY query_id) - 1 AS slot, count(*) OVER () AS n FROM u),
dr AS (SELECT replicate, CAST('0x' || substr(sha256('0|' || replicate || '|' || slot), 1, 8) AS BIGINT) % n AS slot FROM p CROSS JOIN range({REPLICATES}) r(replicate)),
bs AS (SELECT replicate, CAST(sum(a) AS DOUBLE) / sum(m) AS a, CAST(sum(b) AS DOUBLE) / sum(m) AS b FROM dr JOIN p USING (slot) GROUP BY replicate)"""


def _package_means(t: Tables) -> DataFrame:
    sums = resample.cluster_sums(_units(t), "query_id", ["a", "b", "m"])
    return resample.cluster_draws(sums, REPLICATES).groupBy("replicate").agg((F.sum("a") / F.sum("m")).alias("a"), (F.sum("b") / F.sum("m")).alias("b"))


@query(
    "paired_methods_bootstrap",
    f"""{_UNITS}, {_PACKAGE_DRAWS}, d AS (SELECT a - b AS d FROM bs)
SELECT round(avg(d), 9) AS delta, round(quantile_cont(d, 0.025), 9) AS low, round(quantile_cont(d, 0.975), 9) AS high, avg((d > 0)::DOUBLE) AS p_above, avg((d >= 0)::DOUBLE) AS p_not_below,
  quantile_cont(d, 0.025) > 0 OR quantile_cont(d, 0.975) < 0 AS excludes_zero, CASE WHEN quantile_cont(d, 0.025) > 0 THEN 'BETTER' WHEN quantile_cont(d, 0.975) < 0 THEN 'WORSE' ELSE 'UNDECIDED' END AS direction FROM d""",
)
def _(t):
    return rounded(resample.paired(_package_means(t)), "delta", "low", "high")


_ANCHORED = f"""{_UNITS}, so AS (SELECT DISTINCT query_id, label FROM nodes n JOIN embeddings e ON e.vec_id = n.node_id), sl AS (SELECT query_id, list_sort(list(label)) AS l FROM so GROUP BY 1),
an AS (SELECT query_id, l[1 + CAST(CAST('0x' || substr(sha256(CAST(query_id AS VARCHAR)), 1, 16) AS UBIGINT) % len(l) AS INTEGER)] AS anchor FROM sl),
cl AS (SELECT anchor, sum(a) AS a, sum(m) AS m, row_number() OVER (ORDER BY anchor) - 1 AS slot, count(*) OVER () AS n FROM u JOIN an USING (query_id) GROUP BY anchor),
cd AS (SELECT replicate, CAST('0x' || substr(sha256('0|' || replicate || '|' || slot), 1, 8) AS BIGINT) % n AS slot FROM cl CROSS JOIN range({REPLICATES}) r(replicate)),
cb AS (SELECT replicate, CAST(sum(a) AS DOUBLE) / sum(m) AS mean FROM cd JOIN cl USING (slot) GROUP BY replicate)"""


def _anchored(t: Tables) -> DataFrame:
    sources = nodes(t).select("query_id", "node_id").join(t.embeddings.select(F.col("vec_id").alias("node_id"), "label"), "node_id").groupBy("query_id").agg(F.collect_set("label").alias("labels"))
    return _units(t).join(sources.select("query_id", resample.anchor(F.col("query_id").cast("string"), F.col("labels")).alias("anchor")), "query_id")


def _anchor_means(t: Tables) -> DataFrame:
    sums = resample.cluster_sums(_anchored(t), "anchor", ["a", "m"])
    return resample.cluster_draws(sums, REPLICATES).groupBy("replicate").agg((F.sum("a") / F.sum("m")).alias("mean"))


@query("source_anchors", f"{_ANCHORED} SELECT query_id, anchor FROM an")
def _(t):
    return _anchored(t).select("query_id", "anchor")


@query("anchor_cluster_bootstrap", f"{_ANCHORED} {_CI.replace('FROM bs', 'FROM cb')}")
def _(t):
    return rounded(resample.interval(_anchor_means(t)), "mean", "std", "low", "high")


@query(
    "interval_widths",
    f"""{_ANCHORED}, {_PACKAGE_DRAWS}, x AS (SELECT quantile_cont(a, 0.975) - quantile_cont(a, 0.025) AS package FROM bs), y AS (SELECT quantile_cont(mean, 0.975) - quantile_cont(mean, 0.025) AS cluster FROM cb)
SELECT round(package, 9) AS package_width, round(cluster, 9) AS cluster_width, round(cluster - package, 9) AS difference, round(CASE WHEN package = 0 THEN 0 ELSE cluster / package END, 9) AS ratio FROM x CROSS JOIN y""",
)
def _(t):
    width = lambda means, c, name: resample.interval(means, c).select((F.col("high") - F.col("low")).alias(name))
    both = width(_package_means(t), "a", "package_width").join(F.broadcast(width(_anchor_means(t), "mean", "cluster_width")))  # a row each
    out = both.select("package_width", "cluster_width", (F.col("cluster_width") - F.col("package_width")).alias("difference"), metrics.ratio(F.col("cluster_width"), F.col("package_width")).alias("ratio"))
    return rounded(out, *out.columns)


@query(
    "source_stability",
    f"""WITH {_STATS}, w AS (SELECT sum(value) AS s, count(*) AS n FROM st), p AS (SELECT source, sum(value) AS sp, count(*) AS np FROM st GROUP BY 1), c AS (SELECT source, round((s - sp) / (n - np) - s / n, 9) AS change FROM p CROSS JOIN w),
m AS (SELECT max((abs(change), change, source)) AS m FROM c) SELECT m[1] AS max_abs_delta, m[2] AS signed_delta, m[3] AS most_influential, m[1] <= 0.05 AS stable FROM m""",
)
def _(t):
    parts = resample.leave_one_out(stats(t), "source", "value").select("source", F.round(F.col("mean") - F.col("whole"), 9).alias("mean"), F.lit(0.0).alias("whole"))
    return resample.stability(parts, 0.05)


KINDS = [("KNOWN_K1", 1, 0), ("KNOWN_K2", 2, 0), ("KNOWN_K3", 3, 0), ("MIXED_1K1U", 1, 1), ("MIXED_2K1U", 2, 1), ("UNKNOWN_ONLY", 0, 1)]
# fixed values: components of each of one, two or three parents
ALLOCATION = {1: [5], 2: [3, 2], 3: [2, 2, 1]}
_KINDS = ", ".join(f"('{n}', {k}, {u})" for n, k, u in KINDS)


@query(
    "query_generator",
    f"""WITH k AS (SELECT * FROM (VALUES {_KINDS}) v(scenario, known, unknown)), q AS (SELECT scenario, scenario || '-' || i AS query, known, unknown FROM k CROSS JOIN range(10) r(i)),
s AS (SELECT q.*, CAST(slot AS INTEGER) AS slot, CASE known + unknown WHEN 1 THEN [5] WHEN 2 THEN [3, 2] ELSE [2, 2, 1] END[CAST(slot AS INTEGER)] AS take FROM q CROSS JOIN range(1, 4) r(slot) WHERE slot <= known + unknown),
pa AS (SELECT DISTINCT label AS parent, label < 8 AS is_known FROM embeddings), rp AS (SELECT query, parent, is_known, row_number() OVER (PARTITION BY query, is_known ORDER BY sha256('0|parent|' || query || '-' || parent), parent) AS place FROM q CROSS JOIN pa),
ch AS (SELECT s.*, rp.parent FROM s JOIN rp ON rp.query = s.query AND rp.is_known = (slot <= known) AND rp.place = CASE WHEN slot <= known THEN slot ELSE slot - known END),
dr AS (SELECT ch.*, e.vec_id AS id, row_number() OVER (PARTITION BY ch.query, ch.slot ORDER BY sha256('0|component|' || ch.query || '-' || e.vec_id), e.vec_id) AS nth FROM ch JOIN embeddings e ON e.label = ch.parent)
SELECT scenario, query, slot, parent, id FROM dr WHERE nth <= take""",
)
def _(t):
    parents = t.embeddings.select(F.col("label").alias("parent"), (F.col("label") < 8).alias("known")).distinct()
    return protocol.scenarios(parents, t.embeddings.select(F.col("label").alias("parent"), F.col("vec_id").alias("id")), KINDS, 10, ALLOCATION)


@query(
    "parent_combinations",
    f"""WITH {_SIG}, pa AS (SELECT DISTINCT parent FROM gal), r AS (SELECT i, parent, row_number() OVER (PARTITION BY i ORDER BY sha256('0|combination|' || i || '-' || parent), parent) AS place FROM pa CROSS JOIN range(40) d(i)),
c AS (SELECT i, min(parent) AS p1, max(parent) AS p2 FROM r WHERE place <= 2 GROUP BY i) SELECT p1, p2, min(i) AS first FROM c GROUP BY ALL""",
)
def _(t):
    asked = gallery(t).select("parent").distinct().join(t.spark.range(40).withColumnRenamed("id", "i"))  # a project list for each draw
    place = F.row_number().over(Window.partitionBy("i").orderBy(fx.hash_order(F.concat_ws("-", "i", "parent"), salt="combination"), "parent"))
    drawn = asked.withColumn("place", place).where("place <= 2").groupBy("i").agg(F.min("parent").alias("p1"), F.max("parent").alias("p2"))
    return drawn.groupBy("p1", "p2").agg(F.min("i").alias("first"))


@query(
    "anonymous_queries",
    f"""WITH {_SIG}, q AS (SELECT query_id, row_number() OVER (ORDER BY sha256('0|anonymous|' || query_id), query_id) AS place FROM (SELECT DISTINCT query_id FROM nodes))
SELECT 'q' || lpad(CAST(place AS VARCHAR), 5, '0') AS query, 'c' || lpad(CAST(row_number() OVER (PARTITION BY query_id ORDER BY sha256('0|anonymous|' || node_id), node_id) AS VARCHAR), 2, '0') AS component, node_id FROM nodes JOIN q USING (query_id)""",
)
def _(t):
    n = nodes(t).select("query_id", "node_id")
    order = lambda c: (fx.hash_order(F.col(c), salt="anonymous"), F.col(c))
    names = n.select("query_id").distinct().withColumn("query", F.concat(F.lit("q"), F.lpad(F.row_number().over(Window.orderBy(*order("query_id"))).cast("string"), 5, "0")))  # a row a package
    component = F.concat(F.lit("c"), F.lpad(F.row_number().over(Window.partitionBy("query_id").orderBy(*order("node_id"))).cast("string"), 2, "0"))
    return n.withColumn("component", component).join(names, "query_id").select("query", "component", "node_id")


_RECOMPOSED = f"""WITH {_SIG}, un AS (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY node_id) - 1 AS slot FROM nodes WHERE truth IS NULL),
don AS (SELECT label AS source, vec_id AS id, row_number() OVER (PARTITION BY label ORDER BY sha256('0|donor|' || vec_id), vec_id) AS nth FROM embeddings WHERE label >= 8 AND vec_id % 10 <> 0),
tu AS (SELECT query_id, source, row_number() OVER (PARTITION BY query_id ORDER BY sha256('0|source|' || query_id || '-' || source), source) - 1 AS turn, count(*) OVER (PARTITION BY query_id) AS n FROM (SELECT DISTINCT query_id FROM un) CROSS JOIN (SELECT DISTINCT source FROM don)),
re AS (SELECT un.query_id, node_id, slot, tu.source, id AS donor FROM un JOIN tu ON tu.query_id = un.query_id AND slot % n = turn JOIN don ON don.source = tu.source AND don.nth = slot // n + 1)"""


def _recomposed(t: Tables) -> DataFrame:
    donors = t.embeddings.where("label >= 8 and vec_id % 10 <> 0").select(F.col("label").alias("source"), F.col("vec_id").alias("id"))
    return protocol.recomposed(nodes(t).where("truth is null"), donors)


@query("multi_unknown_recomposition", f"{_RECOMPOSED} SELECT query_id, node_id, slot, source, donor FROM re")
def _(t):
    return _recomposed(t)


@query("donor_evidence", f"{_RECOMPOSED} SELECT re.query_id, re.node_id, s.w0, s.w1 FROM re JOIN sig s ON s.vec_id = re.donor")
def _(t):
    return _recomposed(t).join(signatures(t).select(F.col("vec_id").alias("donor"), "w0", "w1"), "donor").select("query_id", "node_id", "w0", "w1")
