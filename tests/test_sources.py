"""Readers and writers, by round trips."""

import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tracewright.sources import tables


def zipped(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


def test_csv_with_and_without_mark(spark, tmp_path):
    df = spark.createDataFrame([("ü,\"x\"", 1), (None, 2)], "name string, n long")
    tables.write_report_csv(df, f"file://{tmp_path}/r.csv")
    assert (tmp_path / "r.csv").read_bytes().startswith(b"\xef\xbb\xbfname,n")
    (tmp_path / "quoted.csv").write_text('\ufeffname,n\n"ü,x",1\n,2\n')
    assert [tuple(r) for r in tables.read_csv(spark, f"file://{tmp_path}/quoted.csv", "name string, n long").collect()] == [("ü,x", 1), (None, 2)]
    tables.write_csv(df.where("n = 2"), f"file://{tmp_path}/c")
    assert [tuple(r) for r in tables.read_csv(spark, f"file://{tmp_path}/c", "name string, n long").collect()] == [(None, 2)]


def test_json_lines_and_documents(spark, tmp_path):
    df = spark.createDataFrame([("a\nb", [1, 2]), (None, [])], "s string, l array<long>")
    tables.write_json_lines(df, f"file://{tmp_path}/l")
    assert sorted(map(str, tables.read_json_lines(spark, f"file://{tmp_path}/l", "s string, l array<long>").collect())) == sorted(map(str, df.collect()))
    tables.write_json_document(spark, {"method": {"pool": 10, "name": "é"}}, f"file://{tmp_path}/d.json")
    assert tables.read_json_document(spark, f"file://{tmp_path}/d.json").select("method.pool", "method.name").first() == (10, "é")
    assert json.loads((tmp_path / "d.json").read_text())["method"]["pool"] == 10


def test_clone_pairs(spark, tmp_path):
    (tmp_path / "c.xml").write_text('<clones><clone nlines="7" similarity="91"><source file="a.java" startline="1" endline="7"/><source file="b.java" startline="3" endline="9"/></clone></clones>')
    row = tables.read_clone_pairs(spark, f"file://{tmp_path}/c.xml").first()
    assert row["_similarity"] == 91 and [s["_file"] for s in row["source"]] == ["a.java", "b.java"]


def test_archives_and_single_entries(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "ENTRY_BATCH", 10)
    one = [("META-INF/MANIFEST.MF", b"m"), ("a/B.class", b"\xca\xfe"), ("x/", b""), ("x/t.png", b"p" * 30), ("__MACOSX/t.png", b"q"), ("d/.DS_Store", b"s"), ("d/n.txt", b"t")]
    (tmp_path / "one.jar").write_bytes(zipped(one))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "two.jar").write_bytes(zipped([("a/B.class", b"other")]))
    (tmp_path / "three.zip").write_bytes(zipped([("a", b"")]))
    rows = tables.read_archives(spark, f"file://{tmp_path}")
    assert rows.count() == 7 and all(r["component_sha256"] == hashlib.sha256(r["payload"]).hexdigest() and r["size_bytes"] == len(r["payload"]) for r in rows.collect())
    assert sorted((r["entry"], r["modality"]) for r in tables.component_entries(rows).collect()) == [("a/B.class", "CODE_BINARY"), ("a/B.class", "CODE_BINARY"), ("x/t.png", "IMAGE")]
    archives = tables._files(spark, f"file://{tmp_path}", "*.jar")
    wanted = rows.where("archive like '%one.jar' and entry like 'x/%'").select("archive", "entry").union(rows.select("archive", F.lit("no such entry")))
    assert [(r["entry"], bytes(r["payload"])) for r in tables.read_entries(archives, wanted).collect()] == [("x/t.png", b"p" * 30)]


def test_packages_round_trip(spark, tmp_path):
    rows = [(q, f"n{k}", "IMAGE", f"{q}-{k}".encode()) for q in ("q1", "q2") for k in range(7 - (q == "q2"))]
    built = tables.build_packages(spark.createDataFrame(rows, "query_id string, node_id string, modality string, payload binary"))
    again = {r["path"]: bytes(r["content"]) for r in built.collect()}
    assert again == {r["path"]: bytes(r["content"]) for r in built.repartition(3).collect()}
    for name, data in again.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "q3.zip").write_bytes(again["q1.zip"])
    (tmp_path / "q4.zip").write_bytes(zipped([("manifest.json", json.dumps({"query_id": "q4", "components": [{"node_id": str(k), "modality": "IMAGE", "payload_relpath": "gone"} for k in range(7)]}))]))
    got = tables.read_packages(spark, f"file://{tmp_path}").collect()
    problems = {r["archive"].rsplit("/", 1)[1]: r["problem"] for r in got}
    assert problems == {"q1.zip": None, "q2.zip": "COMPONENTS", "q3.zip": "QUERY_ID", "q4.zip": "PAYLOAD"}
    assert {r["component_sha256"] for r in got if r["archive"].endswith("q1.zip")} == {hashlib.sha256(p).hexdigest() for q, _, _, p in rows if q == "q1"}


def test_payload_table_is_hashed_again(spark, tmp_path):
    rows = [(hashlib.sha256(b).hexdigest(), b) for b in (b"a", b"", b"a")]
    df = spark.createDataFrame(rows, "component_sha256 string, payload binary")
    assert tables.write_payloads(df, f"file://{tmp_path}/p").count() == 2
    with pytest.raises(ValueError):
        tables.write_payloads(spark.createDataFrame([("0" * 64, b"a")], df.schema), f"file://{tmp_path}/w")


def test_locator_prefers_the_earlier_root(spark):
    listing = spark.createDataFrame([("/b/x/f", 1, "s"), ("/a/f", 1, "s"), ("/a/f2", 1, "s"), ("/a/y/f", 2, "s"), ("/c/g", 1, "t")], "path string, size long, sha string")
    wanted = spark.createDataFrame([(1, "f", "s", 1), (2, "g", "t", 9), (3, "g", "t", 1)], "id long, name string, sha string, size long")
    assert {r["id"]: r["path"] for r in tables.located(wanted, listing, ["/b", "/a"]).collect()} == {1: "/b/x/f", 2: None, 3: "/c/g"}
    assert {r["id"]: r["path"] for r in tables.located(wanted, listing, ["/a", "/b"]).collect()}[1] == "/a/f"
