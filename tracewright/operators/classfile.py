"""Compiled classes from their bytes: opcodes, method summaries and the classes a constant pool names."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import class_reference
from . import quality
from .structure import magnitude

MAGIC = 0xCAFEBABE
# fixed values: bytes of a constant by its tag (text, tag 1, carries its own length)
CONSTANT_BYTES = {3: 4, 4: 4, 5: 8, 6: 8, 7: 2, 8: 2, 9: 4, 10: 4, 11: 4, 12: 4, 15: 3, 16: 2, 17: 4, 18: 4, 19: 2, 20: 2}
# fixed values: first and last opcode with so many operand bytes; others have none
OPERANDS = (
    (0x10, 0x10, 1), (0x11, 0x11, 2), (0x12, 0x12, 1), (0x13, 0x14, 2), (0x15, 0x19, 1), (0x36, 0x3A, 1), (0x84, 0x84, 2), (0x99, 0xA8, 2),
    (0xA9, 0xA9, 1), (0xB2, 0xB8, 2), (0xB9, 0xBA, 4), (0xBB, 0xBB, 2), (0xBC, 0xBC, 1), (0xBD, 0xBD, 2), (0xC0, 0xC1, 2), (0xC5, 0xC5, 3),
    (0xC6, 0xC7, 2), (0xC8, 0xC9, 4),
)
# fixed values: last opcode of each category, in order of opcodes
CATEGORIES = (
    (0x14, "CONST"), (0x35, "LOAD"), (0x56, "STORE"), (0x5F, "STACK"), (0x84, "ARITH"), (0x93, "CONVERT"), (0x98, "COMPARE"), (0xAB, "BRANCH"),
    (0xB1, "RETURN"), (0xB5, "FIELD"), (0xBA, "INVOKE"), (0xC5, "OBJECT"), (0xC9, "BRANCH"), (0xFF, "MISC"),
)
TABLE_SWITCH, LOOKUP_SWITCH, WIDE, INCREMENT = 0xAA, 0xAB, 0xC4, 0x84
FLAGS = ((0x0008, "STATIC"), (0x0020, "SYNCHRONIZED"), (0x0100, "NATIVE"), (0x0400, "ABSTRACT"))

_SIZE = [next((n for lo, hi, n in OPERANDS if lo <= op <= hi), 0) for op in range(256)]
_CATEGORY = [next(name for last, name in CATEGORIES if op <= last) for op in range(256)]


def opcode_category(op: Column) -> Column:
    out = F.lit("MISC")
    for last, name in reversed(CATEGORIES):
        out = F.when(op <= last, name).otherwise(out)
    return out


def opcodes(code: bytes) -> list[int]:
    """The instructions of a method, operands skipped; a cut-off tail ends the list."""
    out, at = [], 0
    while at < len(code):
        op = code[at]
        out.append(op)
        at += 1
        if op in (TABLE_SWITCH, LOOKUP_SWITCH):
            at += -at % 4
            words = 3 if op == TABLE_SWITCH else 2
            if at + 4 * words > len(code):
                break
            head = struct.unpack_from(f">{words}i", code, at)
            cases = head[2] - head[1] + 1 if op == TABLE_SWITCH else 2 * head[1]
            if cases < 0:
                break
            at += 4 * (words + cases)
        elif op == WIDE:
            at += 5 if code[at : at + 1] == bytes([INCREMENT]) else 3
        else:
            at += _SIZE[op]
    return out


class _Bytes:
    """A cursor that refuses to pass the end."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("class file ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "big")


def _pool(b: _Bytes) -> tuple[dict[int, str], list[int]]:
    """(texts by index, indexes of class names)."""
    texts, classes, i, n = {}, [], 1, b.number(2)
    while i < n:
        tag = b.number(1)
        if tag == 1:
            texts[i] = b.take(b.number(2)).decode("utf-8", "replace")
        elif tag in CONSTANT_BYTES:
            body = b.take(CONSTANT_BYTES[tag])
            if tag == 7:
                classes.append(int.from_bytes(body, "big"))
        else:
            raise ValueError(f"constant tag {tag}")
        i += 2 if tag in (5, 6) else 1
    return texts, classes


def constants(data: bytes) -> tuple[list[str], list[str]]:
    """Texts and class names of the constant pool."""
    b = _Bytes(data)
    if b.number(4) != MAGIC:
        raise ValueError("not a class file")
    b.take(4)
    texts, classes = _pool(b)
    return list(texts.values()), [texts[i] for i in classes if i in texts]


def parse(data: bytes) -> dict:
    """Version, names, fields and methods (flags, stack, locals, opcodes) of one class."""
    b = _Bytes(data)
    if b.number(4) != MAGIC:
        raise ValueError("not a class file")
    b.take(2)
    major = b.number(2)
    texts, classes = _pool(b)
    b.take(6)
    b.take(2 * b.number(2))
    members = []
    for _ in range(2):  # fields, then methods
        here = []
        for _ in range(b.number(2)):
            one = {"flags": b.number(2), "stack": 0, "locals": 0, "opcodes": []}
            b.take(4)
            for _ in range(b.number(2)):
                name, body = texts.get(b.number(2)), _Bytes(b.take(b.number(4)))
                if name == "Code":
                    one |= {"stack": body.number(2), "locals": body.number(2)}
                    one["opcodes"] = opcodes(body.take(body.number(4)))
            here.append(one)
        members.append(here)
    return {"major": major, "fields": len(members[0]), "methods": members[1], "classes": [texts[i] for i in classes if i in texts]}


def _windows(names: list[str], short: str, empty: str) -> list[str]:
    if len(names) < 3:
        return [short + "_".join(names)] if names else [empty]
    return ["-".join(w) for w in zip(names, names[1:], names[2:])]


def tokens(parsed: dict) -> tuple[list[str], list[str], list[str]]:
    """Opcode windows, structure and category windows; windows stay inside a method."""
    op3, shape, context, methods = [], [], [], parsed["methods"]
    for m in methods:
        ops = m["opcodes"]
        kinds = [_CATEGORY[o] for o in ops]
        op3 += _windows([f"{o:02x}" for o in ops], "SHORT_", "EMPTY_METHOD")
        context += _windows(kinds, "CTX_SHORT_", "CTX_EMPTY")
        shape += [f"METHOD_LEN_{magnitude(len(ops))}", f"METHOD_STACK_{magnitude(m['stack'])}", f"METHOD_LOCALS_{magnitude(m['locals'])}"]
        shape += [f"METHOD_{name}" for flag, name in FLAGS if m["flags"] & flag]
        shape += [f"CAT_{k}_{magnitude(kinds.count(k))}" for k in sorted(set(kinds))]
    sizes = {"METHODS": len(methods), "CODE_METHODS": sum(bool(m["opcodes"]) for m in methods), "FIELDS": parsed["fields"], "INSTRUCTIONS": sum(len(m["opcodes"]) for m in methods)}
    return op3, shape + [f"CLASS_{k}_{magnitude(n)}" for k, n in sizes.items()], context


def _described(payloads: pd.Series) -> pd.DataFrame:
    rows = []
    for data in payloads:
        try:
            p = parse(bytes(data))
            rows.append((*tokens(p), len(p["methods"]), sum(len(m["opcodes"]) for m in p["methods"]), p["major"], p["classes"]))
        except (ValueError, TypeError):
            rows.append((None,) * 7)
    return pd.DataFrame(rows, columns=["op3", "struct", "context", "methods", "instructions", "major", "classes"], dtype=object)


def described(payload: Column) -> Column:
    """Struct of tokens, counts and class names; nulls where the payload is not a whole class file."""
    kind = "struct<op3:array<string>,struct:array<string>,context:array<string>,methods:long,instructions:long,major:long,classes:array<string>>"
    return F.pandas_udf(_described, kind)(payload)


def signatures(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """Three 128-bit signatures (four words each) with method and instruction counts and the class version."""
    told = rows.select(key, described(F.col(payload)).alias("s")).select(key, "s.*")
    out = told.select(key, "methods", "instructions", "major")
    for name in ("op3", "struct", "context"):
        words = quality.simhash128(told.select(key, F.col(name).alias("all")), key, "all")
        out = out.join(words.select(key, *[F.col(f"w{k}").alias(f"{name}_w{k}") for k in range(4)]), key, "left")
    return out


def class_edges(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, target): distinct classes each class names, arrays reduced to their element class."""
    named = rows.select(key, F.explode(described(F.col(payload)).getField("classes")).alias("name"))
    return named.select(key, class_reference(F.col("name")).alias("target")).where("target is not null").distinct()
