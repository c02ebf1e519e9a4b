"""URL filters against a plain tree and against SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb

from tracewright.llm import queries, urls

SMALL = "/root/testdata/sf0.01"


def parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match("[^?#]*", rest[len(host) :])[0]


def plain(rows, rules=urls.RULES):
    """{page_id: (host, path, rule, verdict, template)} by walking a tree of dictionaries."""
    pages = {}
    for i, url in rows:
        host, path = parts(url)
        fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, said = max(fit, default=(0, None, None))
        segments = tuple("*" if re.search("[0-9]", s) else s for s in path.split("/")[1:]) if path else ()
        pages[i] = (host, path, rule, said, segments)
    count, children = Counter(), defaultdict(set)
    for host, _, _, _, s in pages.values():
        for d in range(1, len(s) + 1):
            count[host, s[:d]] += 1
            children[host, s[: d - 1]].add(s[:d])
    general = {(host, s): tuple("*" if count[host, s[:d]] < urls.RARE and len(children[host, s[: d - 1]]) > urls.MANY else s[d - 1] for d in range(1, len(s) + 1)) for host, _, _, _, s in pages.values()}
    labels = defaultdict(lambda: [0, 0])
    for host, _, _, said, s in pages.values():
        t = general[host, s]
        for d in range(len(t) + 1):
            labels[host, t[:d]][0] += said is not None
            labels[host, t[:d]][1] += said == "block"
    siblings = defaultdict(set)
    for host, t in list(labels):
        if t and labels[host, t][0]:
            siblings[host, t[:-1]].add(t)
    pooled = {}
    for (host, _), own in siblings.items():
        pn, pb = (sum(labels[host, t][k] for t in own) for k in (0, 1))
        alike = {t for t in own if abs(labels[host, t][1] / labels[host, t][0] - pb / pn) * labels[host, t][0] ** 0.5 <= urls.Z * (pb / pn * (1 - pb / pn)) ** 0.5}
        both = tuple(sum(labels[host, t][k] for t in alike) for k in (0, 1))
        pooled |= {(host, t): both if t in alike else tuple(labels[host, t]) for t in own}
    out = {}
    for i, (host, path, rule, said, s) in pages.items():
        t = general[host, s]
        n, b = next((pooled[host, t[:d]] for d in range(len(t), 0, -1) if (host, t[:d]) in pooled), labels[host, ()])
        verdict = said or ("block" if (b + urls.M * urls.PRIOR) / (n + urls.M) >= urls.REJECT else "allow")
        out[i] = (host, path, rule, verdict, host + "".join("/" + x for x in t))
    return out


def judged(spark, rows, rules=urls.RULES):
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()
    assert len(got) == len(rows)
    return {r["page_id"]: tuple(r)[1:] for r in got}


HARD = [(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "http://A.net"), (6, "http://a.NET/"), (7, "http://x.com//a///b/"), (8, "http://x.com/é/ü?q=/1/2"), (9, "ftp://example.com/de/"), (10, "http://x.com/" + "a/" * 5000), (11, "http://x.com#f"), (12, "http://a.b/c://d/e1")]


def test_whole_table(spark):
    rows = [(r["page_id"], r["url"]) for r in spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url").collect()]
    got = {r["page_id"]: tuple(r)[1:] for r in queries.op5_url_filter(spark, SMALL).collect()}
    assert got == plain(rows)


def test_deep_branches_and_wide_nodes(spark):
    pick = random.Random(3)
    rules = [("block", "h.com", "/a/b/spam/"), ("allow", "h.com", "/a/b/news/"), ("block", "h.com", "/x/"), ("allow", "g.org", "/ok/")]
    rows = []
    for k in range(900):
        host = pick.choice(["h.com", "s.h.com", "g.org", "none.io"])
        path = pick.choice(["/a/b/spam/", "/a/b/news/", "/a/b/", "/x/", "/ok/", "/a/", "/", "/a/b/spam/deep/er/", "/wide/"])
        tail = f"{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvw'[k // 100 % 3]}" if path == "/wide/" else pick.choice(["", "p", "q/r", str(k), "p/z9/t"])
        rows.append((k, f"https://{host}{path}{tail}"))
    got = judged(spark, rows, rules)
    assert got == plain(rows, rules)
    # beyond the second segment: what lies beside the ruled branches is told apart by them
    more = [(10**6 + k, f"https://h.com/a/b/{s}{t}") for k, (s, t) in enumerate([("spam", ""), ("news", ""), ("spam?x", ""), ("other/", "u")])]
    got = judged(spark, rows + more, rules)
    assert got == plain(rows + more, rules) and got[10**6][3] == "block" and got[10**6 + 1][3] == "allow"


def test_hard_cases(spark):
    assert judged(spark, HARD) == plain(HARD)
    twice = spark.createDataFrame([*HARD, *HARD], "page_id long, url string").selectExpr("*", "'x' as host", "1 as label", "2 as id", "3 as shape", "'r' as rule")
    assert urls.judge(twice).count() == 2 * len(HARD)
    assert urls.judge(twice.limit(0)).collect() == []


def test_sql_on_hard_cases(spark):
    import pandas as pd

    pages = pd.DataFrame([x for x in HARD if x[0] != 10], columns=["page_id", "url"])  # noqa: F841
    got = {r[0]: tuple(r[1:]) for r in duckdb.sql(queries.ORACLES["op5_url_filter"]).fetchall()}
    assert got == plain([x for x in HARD if x[0] != 10])
