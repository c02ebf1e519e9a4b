"""Class files (hand-assembled, and real ones against the JDK's disassembler) and baseline fingerprints."""

import glob
import hashlib
import os
import re
import shutil
import struct
import subprocess
import zipfile

import pyspark
import pytest
from pyspark.sql import functions as F

from tracewright.operators import baseline, classfile


def assembled(code: bytes) -> bytes:
    text = lambda s: b"\x01" + struct.pack(">H", len(s)) + s
    pool = [text(b"A"), b"\x07\0\x01", text(b"java/lang/Object"), b"\x07\0\x03", text(b"Code"), text(b"m"), text(b"()V"), b"\x05" + b"\0" * 8, text(b"[LB;"), b"\x07\0\x0a"]
    head = struct.pack(">IHHH", 0xCAFEBABE, 0, 61, 13) + b"".join(pool) + text(b"x")  # the long takes two slots
    body = struct.pack(">HHI", 2, 3, len(code)) + code + struct.pack(">HH", 0, 0)
    field = struct.pack(">HHHH", 0, 6, 7, 0)
    method = struct.pack(">HHHH", 0x0028, 6, 7, 1) + struct.pack(">HI", 5, len(body)) + body
    bare = struct.pack(">HHHH", 0x0400, 6, 7, 0)
    return head + struct.pack(">HHHH", 0x21, 2, 4, 0) + struct.pack(">H", 1) + field + struct.pack(">H", 2) + method + bare + struct.pack(">H", 0)


def test_hand_assembled():
    p = classfile.parse(assembled(bytes([0x2A, 0xB4, 0, 1, 0xAC])))
    assert (p["major"], p["fields"], p["classes"]) == (61, 1, ["A", "java/lang/Object", "[LB;"])
    op3, shape, context = classfile.tokens(p)
    assert op3 == ["2a-b4-ac", "EMPTY_METHOD"] and context == ["LOAD-FIELD-RETURN", "CTX_EMPTY"]
    assert shape == [
        "METHOD_LEN_2", "METHOD_STACK_2", "METHOD_LOCALS_2", "METHOD_STATIC", "METHOD_SYNCHRONIZED", "CAT_FIELD_1", "CAT_LOAD_1", "CAT_RETURN_1",
        "METHOD_LEN_0", "METHOD_STACK_0", "METHOD_LOCALS_0", "METHOD_ABSTRACT", "CLASS_METHODS_2", "CLASS_CODE_METHODS_1", "CLASS_FIELDS_1", "CLASS_INSTRUCTIONS_2",
    ]


def test_switches_wide_and_cut_code():
    table = bytes([0, 0xAA, 0, 0]) + struct.pack(">iii", 0, 5, 6) + struct.pack(">ii", 0, 0) + bytes([0xB1])
    assert classfile.opcodes(table) == [0, 0xAA, 0xB1]
    lookup = bytes([0xAB, 0, 0, 0]) + struct.pack(">ii", 0, 1) + struct.pack(">ii", 7, 0) + bytes([0xB1])
    assert classfile.opcodes(lookup) == [0xAB, 0xB1]
    assert classfile.opcodes(bytes([0xC4, 0x84, 0, 1, 0, 1, 0xC4, 0x15, 0, 1, 0xB1])) == [0xC4, 0xC4, 0xB1]
    assert classfile.opcodes(b"") == [] and classfile.opcodes(bytes([0x11, 1])) == [0x11]
    assert classfile._CATEGORY[0xC2] == "OBJECT" and classfile._CATEGORY[0xC6] == "BRANCH" and classfile._CATEGORY[0xCA] == "MISC"


@pytest.mark.skipif(not shutil.which("javap"), reason="needs the JDK's disassembler")
def test_real_classes_like_the_disassembler(tmp_path):
    jar = sorted(glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "spark-unsafe_*.jar")))[0]
    with zipfile.ZipFile(jar) as z:
        names = sorted(n for n in z.namelist() if n.endswith(".class"))[:25]
        for i, n in enumerate(names):
            (tmp_path / f"{i}.class").write_bytes(z.read(n))
    for i in range(len(names)):
        said = subprocess.run(["javap", "-c", "-p", str(tmp_path / f"{i}.class")], capture_output=True, text=True, timeout=60).stdout
        parsed = classfile.parse((tmp_path / f"{i}.class").read_bytes())
        assert sum(len(m["opcodes"]) for m in parsed["methods"]) == len(re.findall(r"^ +\d+: [a-z]", said, re.M))
        assert len([m for m in parsed["methods"] if m["opcodes"]]) == said.count("    Code:\n")


def test_signatures_and_edges(spark):
    code = assembled(bytes([0x2A, 0xB4, 0, 1, 0xAC]))
    rows = spark.createDataFrame([(1, code), (2, code), (3, code[:40]), (4, None), (5, b"")], "id long, payload binary")
    got = {r["id"]: r for r in classfile.signatures(rows, "id", "payload").collect()}
    assert got[1][1:] == got[2][1:] and got[1]["instructions"] == 3 and got[1]["op3_w0"] is not None
    assert all(got[i][1:] == (None,) * 15 for i in (3, 4, 5))
    assert sorted(r["target"] for r in classfile.class_edges(rows.where("id = 1"), "id", "payload").collect()) == ["A", "B", "java/lang/Object"]


def test_baseline_fingerprints(spark):
    def plain(tokens, weights, size, person=b""):
        out = 0
        for bit in range(8 * size):
            total = sum(w if int.from_bytes(hashlib.blake2b(t, digest_size=size, person=person).digest(), "big") >> bit & 1 else -w for t, w in zip(tokens, weights))
            out |= (total >= 0) << bit
        return out

    assert baseline.simhash64(["b", "a", "a"]) == plain([b"a", b"b"], [1, 1], 8)
    assert baseline.simhash128(["a"] * 20 + ["b"], b"apart") == plain([b"a", b"b"], [8, 1], 16, b"apart")
    assert baseline.simhash64([]) == baseline.simhash128([], b"x") == 0
    assert sorted(baseline.flat({"K": [1, True, None, "a b"]})) == ["KEY:k", "LIST", "TYPE:bool", "TYPE:int", "VAL:a", "VAL:b"]
    assert baseline.code_tokens(b"\0Abc\0ab\0" + b"z" * 201) == [b"abc"]
    rows = spark.createDataFrame([(1, b'{"k": 1}'), (2, b"no json"), (3, None), (4, b"")], "id long, payload binary")
    got = {r["id"]: r["f"] for r in rows.select("id", baseline.structured_fingerprint(F.col("payload")).alias("f")).collect()}
    assert (got[1], got[3], got[4]) == (f"{baseline.simhash64(['KEY:k', 'TYPE:int']):016x}", None, "0" * 16)
