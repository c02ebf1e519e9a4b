"""One query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, katz, langid, media, mixing, ngram_join, pieces, quality, secrets, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_classes(_table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(_table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(_table(spark, sf_dir, "documents"))


def op10_media_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_ngram_jaccard_join, op3_sentencepiece, op4_lm_scoring, op5_url_filter, op6_source_mixing, op7_secret_scan, op8_exact_dedup, op9_language_id, op10_media_flac)}

ORACLES = {
    "op2_ngram_jaccard_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s
  FROM words),
rows_ AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM rows_ a JOIN rows_ b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT x, y FROM pairs UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(r.y), s.doc_id)) AS component_id
FROM sets s LEFT JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, s.s""",
    "op5_url_filter": r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, instr(coalesce(url, ''), '://') AS pos_ FROM pages),
r AS (SELECT page_id, CASE WHEN pos_ > 0 THEN substr(url, pos_ + 3) ELSE '' END AS rest FROM u),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
q AS (SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p),
v AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS said,
  regexp_replace(path, '[^/]*[0-9][^/]*', '*', 'g') AS shape FROM q),
sh AS (SELECT host, shape, count(*) AS cnt, count(said) AS n, count(*) FILTER (said = 'block') AS b,
  CASE WHEN shape = '' THEN [] ELSE string_split(shape, '/')[2:] END AS segs FROM v GROUP BY host, shape),
e0 AS (SELECT *, unnest(range(1, len(segs) + 1)) AS d FROM sh),
e AS (SELECT host, shape, cnt, n, b, d, segs[d] AS seg, array_to_string(segs[1:d], '/') AS pre, array_to_string(segs[1:d-1], '/') AS par FROM e0),
c AS (SELECT host, d, pre, par, sum(cnt) AS cc FROM e GROUP BY ALL),
m AS (SELECT host, d, par, count(*) AS ch FROM c GROUP BY ALL),
ra AS (SELECT host, d, pre FROM c JOIN m USING (host, d, par) WHERE cc < 3 AND ch > 20),
f AS (SELECT e.*, CASE WHEN ra.pre IS NOT NULL THEN '*' ELSE seg END AS tseg FROM e LEFT JOIN ra ON ra.host = e.host AND ra.d = e.d AND ra.pre = e.pre),
tp AS (SELECT host, shape, list(tseg ORDER BY d) AS ts FROM f GROUP BY host, shape),
k AS (SELECT f.host, f.shape, f.n, f.b, f.d, array_to_string(ts[1:f.d], '/') AS pre, array_to_string(ts[1:f.d-1], '/') AS par FROM f JOIN tp USING (host, shape)),
o AS (SELECT host, d, pre, par, sum(n) AS n, sum(b) AS b FROM k GROUP BY ALL HAVING sum(n) > 0),
po AS (SELECT host, d, par, sum(n) AS pn, sum(b) AS pb FROM o GROUP BY ALL),
x AS (SELECT *, abs(b / n - pb / pn) * sqrt(CAST(n AS DOUBLE)) <= 1.96 * sqrt((pb / pn) * (1 - pb / pn)) AS alike FROM o JOIN po USING (host, d, par)),
y AS (SELECT host, d, pre, CASE WHEN alike THEN sum(n) FILTER (alike) OVER w ELSE n END AS bn, CASE WHEN alike THEN sum(b) FILTER (alike) OVER w ELSE b END AS bb
  FROM x WINDOW w AS (PARTITION BY host, d, par)),
z AS (SELECT k.host, k.shape, arg_max(bn, k.d) AS bn, arg_max(bb, k.d) AS bb FROM k JOIN y USING (host, d, pre) GROUP BY k.host, k.shape),
h AS (SELECT host, sum(n) AS hn, sum(b) AS hb FROM sh GROUP BY host)
SELECT page_id, v.host, path, rule, coalesce(said, CASE WHEN (coalesce(bb, hb) + 0.8) / (coalesce(bn, hn) + 4.0) >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
  v.host || CASE WHEN v.shape = '' THEN '' ELSE '/' || array_to_string(ts, '/') END AS template
FROM v LEFT JOIN tp ON tp.host = v.host AND tp.shape = v.shape LEFT JOIN z ON z.host = v.host AND z.shape = v.shape LEFT JOIN h ON h.host = v.host""",
    "op8_exact_dedup": """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g USING (t)""",
}
