"""URL filters by a path-template tree, in DataFrame operations only.

A url is a host and a path.  Rules label what they fit; the tree learns from these labels and judges the
rest.  Per host, path segments of every depth become nodes: segments with a digit, and rare children of a
node with many children, are generalised to a wildcard; sibling branches whose labelled shares do not
differ by a two-sided test from their parent's pool are merged; a template is rejected if its smoothed
labelled purity, ``(blocked + M * PRIOR) / (labelled + M)``, is at least ``REJECT``.  A template takes the
deepest level that has labels, its host at last; without any the prior stands (allow).

Equal shapes of a host enter aggregated, so one host may hold any share of the rows.  A node is named by
its depth and the exclusive or of the hashes of its segments and their depths: a path costs its length,
not the square of it.

* null url or none with ``://``: empty host and path, no rule; their template is that of the empty host;
* repeated rows: each is judged alike; empty table: no rows; a rule's path must begin the url's path, so
  a url without a path fits no rule; an empty segment is a segment; equal counts need no tie-break, as
  every threshold is on a node of its own; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

#: (verdict, host, path): the longest that fits wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
PRIOR, M, REJECT, Z = 0.2, 4.0, 0.5, 1.96
RARE, MANY = 3, 20


def with_parts(pages: DataFrame) -> DataFrame:
    """``pages`` with host and path."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substr(coalesce(cast(url as string), ''), instr(coalesce(cast(url as string), ''), '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumns({"host": host, "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def rule_of(rules=RULES) -> Column:
    """The longest rule that fits host and path, as written (``net/``); null if none does."""
    out = F.lit(None).cast("string")
    for _, host, path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out = F.when(fits, F.lit(host + path)).otherwise(out)
    return out


def _prefixes(segments: DataFrame, segment: str) -> DataFrame:
    """``segments`` (id, depth, ...) with ``node`` and ``parent``: names of the path up to each depth."""
    own = F.xxhash64("depth", segment)
    upto = F.bit_xor(own).over(Window.partitionBy("id").orderBy("depth"))
    return segments.withColumn("node", upto).withColumn("parent", F.col("node").bitwiseXOR(own))


def templates(pages: DataFrame) -> DataFrame:
    """(host, shape, template, purity) of every shape; ``pages`` has host, path and label (1 block, 0 allow,
    null none), and ``shape``, its path with a wildcard for segments that hold a digit."""
    shapes = pages.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("rows"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("blocked"))
    shapes = store.written(shapes.withColumn("id", F.xxhash64("host", "shape")), "url-shapes")
    segments = shapes.where("shape <> ''").select("id", "host", "rows", "labelled", "blocked", F.posexplode(F.split("shape", "/")).alias("depth", "segment")).where("depth > 0")
    named = store.written(_prefixes(segments, "segment"), "url-segments")
    # rare children of nodes with many
    children = store.written(named.groupBy("host", "depth", "parent", "node").agg(F.sum("rows").alias("rows")), "url-children")
    many = children.groupBy("host", "depth", "parent").agg(F.count(F.lit(1)).alias("children")).where(F.col("children") > MANY)
    rare = store.merged(children.where(F.col("rows") < RARE), many, ["host", "depth", "parent"]).select("host", "depth", "node", F.lit("*").alias("wildcard"))
    general = store.merged(named, rare, ["host", "depth", "node"], "left").drop("node", "parent").withColumn("segment", F.coalesce("wildcard", "segment")).drop("wildcard")
    nodes = store.written(_prefixes(general, "segment"), "url-nodes")
    written = nodes.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("depth", "segment"))).alias("s")).select("id", F.concat(F.lit("/"), F.array_join("s.segment", "/")).alias("general"))
    # labelled branches, pooled with those of their siblings that do not differ from the parent's pool
    key = ["host", "depth", "parent"]
    own = store.written(nodes.where("labelled > 0").groupBy(*key, "node").agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("b")), "url-branches")
    pool = own.groupBy(*key).agg(F.sum("n").alias("pn"), F.sum("b").alias("pb"))
    share, part = F.col("pb") / F.col("pn"), F.col("b") / F.col("n")
    alike = F.abs(part - share) * F.sqrt(F.col("n").cast("double")) <= Z * F.sqrt(share * (1 - share))
    tested = store.merged(own, pool, key).withColumn("alike", alike)
    pooled = tested.where("alike").groupBy(*key).agg(F.sum("n").alias("mn"), F.sum("b").alias("mb"))
    branches = store.merged(tested, pooled, key, "left").select("host", "depth", "node", F.when(F.col("alike"), F.col("mn")).otherwise(F.col("n")).alias("n"), F.when(F.col("alike"), F.col("mb")).otherwise(F.col("b")).alias("b"))
    deepest = store.merged(nodes.select("id", "host", "depth", "node"), branches, ["host", "depth", "node"]).groupBy("id").agg(F.max_by(F.struct("n", "b"), "depth").alias("deepest"))
    hosts = shapes.groupBy("host").agg(F.sum("labelled").alias("hn"), F.sum("blocked").alias("hb"))
    wide = shapes.select("id", "host", "shape").transform(store.merged, written, "id", "left").transform(store.merged, deepest, "id", "left").transform(store.merged, hosts, "host")
    n, b = F.coalesce("deepest.n", "hn"), F.coalesce("deepest.b", "hb")
    return wide.select("host", "shape", F.concat("host", F.coalesce("general", F.lit(""))).alias("template"), ((b + M * PRIOR) / (n + M)).alias("purity"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template for each row of ``pages`` (page_id, url)."""
    verdicts = {host + path: verdict for verdict, host, path in rules}
    ruled = with_parts(pages.select("page_id", "url")).drop("url").withColumn("rule", rule_of(rules))
    said = F.lit(None).cast("string")
    for rule, verdict in verdicts.items():
        said = F.when(F.col("rule") == rule, verdict).otherwise(said)
    ruled = ruled.withColumns({"said": said, "shape": F.regexp_replace("path", "[^/]*[0-9][^/]*", "*")})
    ruled = ruled.withColumn("label", F.when(F.col("said") == "block", 1).when(F.col("said") == "allow", 0))
    known = store.written(templates(ruled), "url-purity")
    judged = store.merged(ruled, known, ["host", "shape"], "left")
    verdict = F.coalesce("said", F.when(F.col("purity") >= REJECT, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template")
