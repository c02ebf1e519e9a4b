"""Queries over corrupted and connected package graphs, constrained assignment, re-encoded images, freeze
checks, audits and typed edges, with the SQL that says what each returns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import assign, disassembly, graph, images, protocol, references, relabel
from ..sources.tables import Tables
from .catalogue import _SIG, _SOLVE, _TABLE, METHOD, PUBLISHED, nodes, outcome, query, rounded, table
from .further import _labels
from .more import _GRAY, query_edges

_CORRUPT = f"""{_SIG}, e AS (SELECT a.query_id, a.node_id AS node_a, b.node_id AS node_b FROM nodes a JOIN nodes b ON a.query_id = b.query_id AND b.node_id = a.node_id + 10),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sha256('0|drop|' || query_id || '-' || node_a || '-' || node_b), node_a, node_b) AS place, greatest(round_even(0.3::DOUBLE * count(*) OVER (PARTITION BY query_id), 0), 1) AS gone FROM e),
d AS (SELECT query_id, node_a, node_b FROM r WHERE place > gone),
f AS (SELECT query_id, truth, arg_min(node_id, (sha256('0|left|' || node_id), node_id)) AS l, arg_min(node_id, (sha256('0|right|' || node_id), node_id)) AS r FROM nodes WHERE truth IS NOT NULL GROUP BY ALL),
o AS (SELECT query_id, l, lead(r) OVER (PARTITION BY query_id ORDER BY truth) AS o FROM f),
b AS (SELECT query_id, least(l, o) AS node_a, greatest(l, o) AS node_b FROM o WHERE o IS NOT NULL)"""


@query(
    "corrupted_package_edges",
    f"""WITH {_CORRUPT} SELECT 'DROP30' AS condition, * FROM d UNION ALL SELECT 'BRIDGE', * FROM (SELECT * FROM e UNION SELECT * FROM b) UNION ALL SELECT 'DROP30_BRIDGE', * FROM (SELECT * FROM d UNION SELECT * FROM b)""",
)
def _(t):
    return protocol.corrupted(query_edges(t), nodes(t).select("query_id", "node_id", "truth"))


def _corrupted_labels(t: Tables) -> DataFrame:
    """Components of each package under DROP30 and bridges."""
    n = nodes(t).select("query_id", "node_id", "truth")
    edges = protocol.corrupted(query_edges(t), n).where("condition = 'DROP30_BRIDGE'").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    every = n.select(F.col("node_id").alias("node"))
    return graph.connected_components(edges, every).withColumnRenamed("node", "node_id").join(n.select("query_id", "node_id"), "node_id").select("query_id", "node_id", "component")


_REACH = """cb AS (SELECT * FROM (SELECT * FROM d UNION SELECT * FROM b)), two AS (SELECT query_id, node_a AS a, node_b AS b FROM cb UNION SELECT query_id, node_b, node_a FROM cb),
reach AS (SELECT query_id, node_id, node_id AS r FROM nodes UNION SELECT reach.query_id, reach.node_id, two.b FROM reach JOIN two ON two.query_id = reach.query_id AND two.a = reach.r),
lab AS (SELECT query_id, node_id, min(r) AS component FROM reach GROUP BY ALL)"""
_BY_COMPONENT = """g AS (SELECT query_id, node_id, parent, fused - min(fused) OVER (PARTITION BY query_id, node_id) AS regret FROM allowed),
j AS (SELECT g.*, component FROM g JOIN lab USING (query_id, node_id)),
s AS (SELECT query_id, component, parent, count(*) AS known, round(sum(regret), 9) AS cost FROM j GROUP BY ALL),
z AS (SELECT query_id, component, count(DISTINCT node_id) AS nodes FROM j GROUP BY ALL),
c AS (SELECT s.query_id, s.component, arg_min(parent, (cost, parent)) AS parent FROM s JOIN z ON z.query_id = s.query_id AND z.component = s.component AND known = z.nodes GROUP BY ALL)
SELECT j.query_id, j.node_id, j.component, c.parent FROM (SELECT DISTINCT query_id, node_id, component FROM j) j LEFT JOIN c ON c.query_id = j.query_id AND c.component = j.component"""


def _tail(ctes: str) -> str:
    """The tables that follow the signatures."""
    return ctes[len(_SIG) :].lstrip(", \n")


@query("dependency_assignment", f"WITH RECURSIVE {_CORRUPT}, {_tail(_TABLE)}, {_REACH}, allowed AS (SELECT query_id, node_id, parent, fused FROM tab), {_BY_COMPONENT}")
def _(t):
    return assign.by_component(table(t), _corrupted_labels(t))


@query(
    "constrained_assignment",
    f"WITH RECURSIVE {_CORRUPT}, {_tail(_SOLVE)}, {_REACH}, allowed AS (SELECT t.query_id, node_id, parent, fused FROM tab t JOIN best ON best.query_id = t.query_id AND (parent = p1 OR parent = p2 OR parent = p3)), {_BY_COMPONENT}",
    full={"method": PUBLISHED},
)
def _(t, method=METHOD):
    tab, _, sets, _ = outcome(t, method)
    return assign.by_component(assign.within(tab, sets), _corrupted_labels(t))


@query("hierarchical_constrained")
def _(t):
    tab, _, sets, _ = outcome(t, PUBLISHED)
    return relabel.hierarchical(assign.within(tab, sets).select("query_id", "node_id", "parent", "fused"), query_edges(t), 0.005)


@query("least_digest_connection")
def _(t):
    return graph.connected(_labels(t))


@query(
    "image_reencoded",
    f"""WITH {_GRAY} SELECT vec_id, 8 AS width, 8 AS height, sha256(unhex(array_to_string(list_transform(v, lambda x: printf('%02x%02x%02xff', x, x, x)), ''))) AS pixels_sha256 FROM g""",
)
def _(t):
    level = F.transform("embedding", lambda x: F.floor(F.least(F.greatest((x.cast("double") + 1) * 128, F.lit(0.0)), F.lit(255.0))).cast("int"))
    again = t.embeddings.select("vec_id", images.reencoded(images.gray_png(level)).alias("f"))
    return again.select("vec_id", "f.width", "f.height", "f.pixels_sha256")


@query("frozen_manifest", "SELECT doc_id AS name, sha256(text) AS sha FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL")
def _(t):
    files = t.documents.where("text is not null and doc_id is not null").select(F.col("doc_id").alias("name"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    return protocol.frozen(files, files)


@query(
    "reporting_audit",
    """WITH r AS (SELECT lang, source, round(avg(n_chars), 2) AS value FROM (SELECT lang, source, length(text) AS n_chars FROM documents) WHERE source IS NOT NULL GROUP BY ALL),
c AS (SELECT lang, source, avg(length(text)) AS value FROM documents GROUP BY ALL HAVING count(*) > 3)
SELECT coalesce(r.lang, c.lang) AS lang, coalesce(r.source, c.source) AS source, r.value AS reported, round(c.value, 9) AS computed,
  CASE WHEN r.lang IS NULL THEN 'UNREPORTED' WHEN c.lang IS NULL THEN 'UNSUPPORTED' WHEN r.value IS NOT DISTINCT FROM c.value OR abs(r.value - c.value) <= 0.003 THEN 'MATCH' ELSE 'DIFFERENT' END AS status
FROM r FULL JOIN c ON r.lang = c.lang AND r.source = c.source""",
)
def _(t):
    d = t.documents.select("lang", "source", F.length("text").alias("n"))
    reported = d.where("source is not null").groupBy("lang", "source").agg(F.round(F.avg("n"), 2).alias("value"))
    computed = d.groupBy("lang", "source").agg(F.avg("n").alias("value"), F.count(F.lit(1)).alias("rows")).where("rows > 3")
    return rounded(protocol.audited(reported, computed, ["lang", "source"], 0.003), "computed")


_SLOTS = """(VALUES (0, 1, 'ENTRYPOINT'), (0, 2, 'MIXIN_CONFIG'), (0, 4, 'FABRIC_ICON'), (0, 4, 'JSON_EXACT_PATH'), (0, 4, 'STRUCTURED_REF'), (0, 2, 'JSON_EXACT_PATH'), (0, 2, 'STRUCTURED_REF'), (0, 1, 'STRUCTURED_CLASS_REF'),
(2, 1, 'MIXIN_CLASS'), (3, 6, 'MODEL_PARENT'), (3, 4, 'TEXTURE_REF'), (5, 4, 'JSON_EXACT_PATH'), (5, 3, 'JSON_IDENTIFIER_REF'), (5, 1, 'STRUCTURED_CLASS_REF')) s(a, b, kind)"""
_PATHS = ["fabric.mod.json", "a/b/C{p}.class", "x{p}.mixins.json", "assets/m/models/item/thing{p}.json", "assets/m/textures/item/art{p}.png", "data/m/recipes/r{p}.json", "assets/m/models/block/base{p}.json"]
_BODIES = [
    '{"entrypoints": {"main": ["a.b.C{p}::init", {"value": "a.b.C{p}"}]}, "mixins": ["x{p}.mixins.json", {"config": "none.json"}], "icon": "assets/m/textures/item/art{p}.png"}',
    "",
    '{"package": "a.b", "mixins": ["C{p}", "Gone"], "client": "C{p}"}',
    '{"parent": "m:block/base{p}", "textures": {"layer0": "m:item/art{p}", "layer1": "#art"}}',
    "",
    '{"result": ["m:item/thing{p}", "m:nowhere"], "file": "/assets\\\\m/textures/item/art{p}.png", "maker": " a.b.C{p} "}',
    "[]",
]


_SLOT_PATH = "replace(CASE page_id % 7 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(_PATHS)) + " END, '{p}', CAST(page_id // 7 AS VARCHAR))"


@query(
    "typed_edges",
    f"""WITH p AS (SELECT page_id // 7 AS package, page_id % 7 AS slot, {_SLOT_PATH} AS path FROM pages)
SELECT x.package, x.path AS source, y.path AS target, kind FROM {_SLOTS} JOIN p x ON x.slot = a JOIN p y ON y.package = x.package AND y.slot = b""",
)
def _(t):
    p = t.pages.select(F.floor(F.col("page_id") / 7).alias("package"), (F.col("page_id") % 7).alias("slot"))
    listed = lambda texts: F.element_at(F.array(*[F.lit(x) for x in texts]), (F.col("slot") + 1).cast("int"))
    told = lambda texts: F.replace(listed(texts), F.lit("{p}"), F.col("package").cast("string"))
    return references.typed_edges(p.select("package", told(_PATHS).alias("path"), told(_BODIES).cast("binary").alias("payload")))


_LISTING = [
    ("aload_0", "", "LOCAL"), ("getfield", "#2  // Field a:I", "FIELD"), ("ifeq", "12", "BRANCH"), ("ldc", "#3  // String x", "STRING_CONST"), ("aload_0", "", "LOCAL"),
    ("invokevirtual", "#7  // Method a/b.c:()V", "CALL"), ("bipush", "7", "CONST"), ("new", "", "TYPE_OP"), ("ldc2_w", "#9  // long 5l", "NUM_CONST"), ("return", "", "NONE"),
]
_OPS, _KINDS = ("[" + ", ".join(f"'{x}'" for x in xs) + "]" for xs in ([o for o, _, _ in _LISTING], [f"CTX:{o}:{k}" for o, _, k in _LISTING]))
_MAGNITUDE = "CASE WHEN {n} <= 0 THEN '0' WHEN {n} = 1 THEN '1' WHEN {n} <= 3 THEN '2-3' WHEN {n} <= 7 THEN '4-7' ELSE '8-15' END"


@query(
    "disassembly_features",
    f"""WITH k AS (SELECT page_id, page_id % 11 AS n, page_id % 3 AS m, {_OPS}[1:page_id % 11] AS ops, {_KINDS}[1:page_id % 11] AS ctx FROM pages),
w AS (SELECT *, CASE WHEN n >= 3 THEN list_transform(range(1, n - 1), lambda i: 'OP3:' || ops[i] || '>' || ops[i + 1] || '>' || ops[i + 2]) ELSE list_transform(ops, lambda x: 'OP1:' || x) END AS w3,
  list_transform(range(m), lambda i: 'DESC:(LREF;I)LREF;') AS d, ['METHOD_COUNT:' || {_MAGNITUDE.format(n='m')}, 'OP_COUNT:' || {_MAGNITUDE.format(n='n')}] AS counts,
  list_transform(list_filter(ops, lambda x, i: list_position(ops, x) = i), lambda x: 'OPCOUNT:' || x || ':' || {_MAGNITUDE.format(n='len(list_filter(ops, lambda y: y = x))')}) AS each_ FROM k)
SELECT page_id, array_to_string(w3, ' ') AS opcode_3gram, array_to_string(list_concat(list_concat(list_concat(w3, d), counts), each_), ' ') AS opcode_struct, array_to_string(list_concat(list_concat(list_concat(w3, ctx), d), counts), ' ') AS opcode_context FROM w""",
)
def _(t):
    lines = F.array(*[F.lit(f"      {3 * i}: {op}   {rest}") for i, (op, rest, _) in enumerate(_LISTING)])
    shapes = F.array_repeat(F.lit("    descriptor: (La/b/C;I)Lx/Y; "), (F.col("page_id") % 3).cast("int"))
    text = F.array_join(F.concat(F.array(F.lit("class a.b.C {")), shapes, F.array(F.lit("    Code:")), F.slice(lines, 1, (F.col("page_id") % 11).cast("int"))), "\n")
    told = disassembly.features(t.pages.select("page_id", text.alias("text")), "page_id", "text")
    return told.select("page_id", *[F.array_join(c, " ").alias(c) for c in told.columns[1:]])
