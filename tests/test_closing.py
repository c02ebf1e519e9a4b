"""Connection of components, corrupted edges, freeze checks, audits, re-encoded images, typed edges and listings."""

import hashlib
import struct
import zlib

import numpy as np
import pytest

from tracewright.operators import assign, disassembly, graph, images, protocol, references
from tracewright.sources import tables


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plainly(name, components, seed):
    """Joins the two components of least digest, all digests told anew each time."""
    parts, out = [set(c) for c in components], []
    while len(parts) > 1:
        parts.sort(key=lambda c: sha(f"{name}|{'|'.join(sorted(c))}"))
        ends = [min(c, key=lambda n: (sha(f"{seed}|{name}|component-node-order|{n}"), n)) for c in parts[:2]]
        out.append(tuple(sorted(ends)))
        parts = [parts[0] | parts[1], *parts[2:]]
    return out


def test_bridging():
    for k in range(30):
        components = [[f"n{k}-{i}-{j}" for j in range(1 + (i * k) % 4)] for i in range(1 + k % 9)]
        assert graph.bridging(f"q{k}", components) == plainly(f"q{k}", components, graph.CONNECT_SEED)


def test_connected(spark):
    labels = spark.createDataFrame([(1, n, c) for n, c in [(10, 10), (20, 10), (30, 30), (40, 40)]] + [(2, 50, 50)], "graph long, node long, component long")
    got = graph.connected(labels).collect()
    assert sorted((r["a"], r["b"]) for r in got) == sorted(plainly("1", [["10", "20"], ["30"], ["40"]], graph.CONNECT_SEED))
    assert {r["graph"] for r in got} == {1}
    assert graph.connected(labels.limit(0)).collect() == []


def test_corrupted(spark):
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(5)] + [(2, 9, 8)], "query_id long, node_a long, node_b long")
    nodes = spark.createDataFrame([(1, i, i // 2) for i in range(6)] + [(2, 8, None), (2, 9, 4)], "query_id long, node_id long, truth long")
    got = protocol.corrupted(edges, nodes).collect()
    of = lambda c, q: {(r["node_a"], r["node_b"]) for r in got if r["condition"] == c and r["query_id"] == q}
    whole = {(i, i + 1) for i in range(5)}
    assert len(of("DROP30", 1)) == 3 and of("DROP30", 1) < whole  # 1.5 rounds to 2
    assert of("DROP30", 2) == set() and of("BRIDGE", 2) == {(8, 9)}
    bridges = of("DROP30_BRIDGE", 1) - whole
    assert whole <= of("BRIDGE", 1) and all(abs(a // 2 - b // 2) == 1 for a, b in bridges)


def test_by_component(spark):
    rows = [(1, 1, 0, 0.1), (1, 1, 1, 0.2), (1, 2, 0, 0.5), (1, 2, 1, 0.1), (1, 3, 1, 0.4), (1, 4, 0, 0.3)]
    table = spark.createDataFrame(rows, "query_id long, node_id long, parent long, fused double")
    labels = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (1, 3, 3), (1, 4, 3)], "query_id long, node_id long, component long")
    got = {r["node_id"]: (r["component"], r["parent"]) for r in assign.by_component(table, labels).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, None), 4: (3, None)}
    sets = spark.createDataFrame([(1, 0, None, None)], "query_id long, p1 long, p2 long, p3 long")
    assert {r["parent"] for r in assign.by_component(assign.within(table, sets), labels).collect()} == {0}


def test_frozen_and_audited(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2")], "name string, sha string")
    assert protocol.frozen(files, files).count() == 2
    for wrong in ([("a", "1")], [("a", "1"), ("b", "3")], [("a", "1"), ("b", "2"), ("c", "4")]):
        with pytest.raises(Exception, match="not as frozen"):
            protocol.frozen(files, spark.createDataFrame(wrong, "name string, sha string")).collect()
    reported = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", None), ("d", 1.0)], "metric string, value double")
    computed = spark.createDataFrame([("a", 0.5), ("b", 0.6), ("c", None), ("e", 1.0)], "metric string, value double")
    got = {r["metric"]: r["status"] for r in protocol.audited(reported, computed, ["metric"]).collect()}
    assert got == {"a": "MATCH", "b": "DIFFERENT", "c": "MATCH", "d": "UNSUPPORTED", "e": "UNREPORTED"}


def png(head, *chunks):
    return images.SIGNATURE + images._chunk(b"IHDR", struct.pack(">IIBBBBB", *head)) + b"".join(images._chunk(n, d) for n, d in chunks) + images._chunk(b"IEND", b"")


def test_rgba():
    pixels = np.random.default_rng(5).integers(0, 256, (5, 7, 4), np.uint8)
    assert np.array_equal(images.read_rgba(images.write_rgba(pixels)), pixels)
    rows = lambda *r: (b"IDAT", zlib.compress(b"".join(b"\0" + bytes(x) for x in r)))
    assert images.read_rgba(png((2, 1, 8, 3, 0, 0, 0), (b"PLTE", bytes([1, 2, 3, 4, 5, 6])), (b"tRNS", bytes([9])), rows([0, 1]))).tolist() == [[[1, 2, 3, 9], [4, 5, 6, 255]]]
    assert images.read_rgba(png((2, 1, 8, 0, 0, 0, 0), (b"tRNS", bytes([0, 7])), rows([7, 8]))).tolist() == [[[7, 7, 7, 0], [8, 8, 8, 255]]]
    assert images.read_rgba(png((2, 1, 1, 0, 0, 0, 0), rows([0b01000000]))).tolist() == [[[0, 0, 0, 255], [255, 255, 255, 255]]]
    assert images.read_rgba(png((1, 1, 8, 4, 0, 0, 0), rows([7, 3]))).tolist() == [[[7, 7, 7, 3]]]
    assert images.read_rgba(png((1, 1, 8, 2, 0, 0, 0), (b"tRNS", bytes([0, 1, 0, 2, 0, 3])), rows([1, 2, 3]))).tolist() == [[[1, 2, 3, 0]]]


def test_reencoded(spark):
    given = spark.createDataFrame([(1, bytearray(images.write_png(np.arange(6).reshape(2, 3)))), (2, bytearray(b"no image")), (3, None)], "id long, payload binary")
    got = {r["id"]: r["f"] for r in given.select("id", images.reencoded(given["payload"]).alias("f")).collect()}
    assert (got[1]["width"], got[1]["height"]) == (3, 2) and images.read_rgba(bytes(got[1]["png"]))[1, 2].tolist() == [5, 5, 5, 255]
    assert got[2]["png"] is None and got[3]["png"] is None


def class_file(texts, classes):
    texts = [*texts, *classes]
    pool = b"".join(b"\1" + struct.pack(">H", len(t)) + t.encode() for t in texts)
    pool += b"".join(b"\7" + struct.pack(">H", len(texts) - len(classes) + 1 + i) for i in range(len(classes)))
    return b"\xca\xfe\xba\xbe\0\0\0\x34" + struct.pack(">H", 1 + len(texts) + len(classes)) + pool


def test_typed_edges(spark):
    deep = b"[" * 5000 + b"]" * 5000
    rows = [
        ("p", "a/A.class", class_file(["/assets/m/textures/t.png", "see m:t, x:none", "a/A.class"], ["a/B", "[La/B;", "[I", "a/A"])),
        ("p", "a/B.class", b"cut short"),
        ("p", "assets/m/textures/t.png", b""),
        ("p", "assets/m/lang/en.json", b'{"a": "m:twice", "parent": "m:t", "big_texture": "m:t", "note": "\\ud800"}'),
        ("p", "data/m/tags/twice.json", b"not json"),
        ("p", "data/m/loot/twice.json", deep),
        ("p", "fabric.mod.json", b'{"entrypoints": {"main": "a.A"}, "mixins": 3, "icon": {"16": "/assets/m/textures/t.png"}}'),
        ("q", "assets/m/lang/en.json", b'{"a": "m:t"}'),
        ("q", "empty.json", None),
    ]
    got = references.typed_edges(spark.createDataFrame([(p, n, None if d is None else bytearray(d)) for p, n, d in rows], "package string, path string, payload binary"))
    told = sorted((r["source"], r["target"], r["kind"]) for r in got.collect())
    art = "assets/m/textures/t.png"
    assert told == sorted(
        [
            ("a/A.class", "a/B.class", "CLASS_REF"),
            ("a/A.class", art, "RESOURCE_LITERAL"),
            ("a/A.class", art, "CLASS_IDENTIFIER_REF"),
            ("assets/m/lang/en.json", art, "TEXTURE_REF"),
            ("fabric.mod.json", "a/A.class", "ENTRYPOINT"),
            ("fabric.mod.json", "a/A.class", "STRUCTURED_CLASS_REF"),
            ("fabric.mod.json", art, "FABRIC_ICON"),
            ("fabric.mod.json", art, "JSON_EXACT_PATH"),
        ]
    )


def test_listing(spark, tmp_path):
    (tmp_path / "tree.txt").write_text("100644 blob 0a1b\tsrc/A.java\n100644 blob 0a1c     120\tsrc/b c.KT\n040000 tree 0a1d\tsrc\nnoise\n")
    rows = tables.read_listing(spark, str(tmp_path / "tree.txt"))
    assert [r["path"] for r in rows.collect()] == ["src/A.java", "src/b c.KT", "src"]
    assert [(r["object"], r["path"]) for r in tables.read_listing(spark, str(tmp_path / "tree.txt"), (".java", ".kt")).collect()] == [("0a1b", "src/A.java"), ("0a1c", "src/b c.KT")]


def test_disassembly(spark):
    listing = """Classfile A.class
  void m(a.b.C);
    descriptor: (La/b/C;[J)V
    Code:
         0: aload_0
         1: invokeinterface #5,  1   // InterfaceMethod a/b/C.d:()V
         6: invokedynamic #6,  0   // InvokeDynamic #0:run:()V
        11: checkcast     #9   // class a/B
        14: istore_2
        16: goto          0
        19: ldc   #2
     Exceptions: none
"""
    rows = spark.createDataFrame([(1, listing), (2, "   3: iinc 1, 1\r\n"), (3, ""), (4, None)], "id long, text string")
    got = {r["id"]: r for r in disassembly.features(rows, "id", "text").collect()}
    ops = ["aload_0", "invokeinterface", "invokedynamic", "checkcast", "istore_2", "goto", "ldc"]
    windows = ["OP3:" + ">".join(w) for w in zip(ops, ops[1:], ops[2:])]
    kinds = ["LOCAL", "CALL", "DYNAMIC_CALL", "TYPE", "LOCAL", "BRANCH", "CONST"]
    counts = ["METHOD_COUNT:1", "OP_COUNT:4-7"]
    assert got[1]["opcode_3gram"] == windows
    assert got[1]["opcode_struct"] == [*windows, "DESC:(LREF;[J)V", *counts, *(f"OPCOUNT:{o}:1" for o in ops)]
    assert got[1]["opcode_context"] == [*windows, *(f"CTX:{o}:{k}" for o, k in zip(ops, kinds)), "DESC:(LREF;[J)V", *counts]
    assert got[2]["opcode_context"] == ["OP1:iinc", "CTX:iinc:LOCAL", "METHOD_COUNT:0", "OP_COUNT:1"]
    assert (got[3]["opcode_3gram"], got[3]["opcode_struct"]) == ([], ["METHOD_COUNT:0", "OP_COUNT:0"])
    assert got[4]["opcode_3gram"] is None and got[4]["opcode_struct"] is None
