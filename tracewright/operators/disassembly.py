"""Features of printed disassembly (one listing a row), by array functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_bucket

# fixed values: lines, instructions, object types, operand comments, opcodes by category
LINES = r"\R|[\x1c-\x1e]"
DESCRIPTOR, INSTRUCTION, OBJECT = r"^\s*descriptor:\s*(.*?)\s*$", r"^\s*\d+:\s+([a-z][a-z0-9_]*)\b(.*)$", "L[^;]+;"
COMMENTS = [
    ("CALL", ("// interfacemethod", "// method")),
    ("DYNAMIC_CALL", ("// invokedynamic",)),
    ("FIELD", ("// field",)),
    ("TYPE", ("// class",)),
    ("STRING_CONST", ("// string",)),
    ("NUM_CONST", ("// int ", "// long ", "// float ", "// double ")),
]
BRANCHES = ("goto", "goto_w", "jsr", "jsr_w", "tableswitch", "lookupswitch")
TYPE_OPS = ("new", "anewarray", "newarray", "multianewarray", "checkcast", "instanceof")
CONSTANTS = ("ldc", "ldc_w", "ldc2_w", "bipush", "sipush")


def operand(opcode: Column, rest: Column) -> Column:
    """What an instruction works on, from its printed comment, else from its name."""
    rest = F.lower(rest)
    rules = [(name, [rest.contains(x) for x in marks]) for name, marks in COMMENTS]
    rules += [
        ("BRANCH", [opcode.startswith("if"), opcode.isin(*BRANCHES)]),
        ("LOCAL", [opcode.contains("load"), opcode.contains("store"), opcode == "iinc"]),
        ("TYPE_OP", [opcode.isin(*TYPE_OPS)]),
        ("CONST", [opcode.isin(*CONSTANTS)]),
    ]
    return F.coalesce(*[F.when(F.array_contains(F.array(*tests), True), name) for name, tests in rules], F.lit("NONE"))


def features(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, opcode_3gram, opcode_struct, opcode_context): opcode windows, and those with structure or with
    operands; a null text gives nulls, one without instructions only its counts."""
    lines = F.split(text, LINES)
    codes = F.transform(F.filter(lines, lambda x: x.rlike(INSTRUCTION)), lambda x: F.struct(F.regexp_extract(x, INSTRUCTION, 1).alias("op"), F.regexp_extract(x, INSTRUCTION, 2).alias("rest")))
    shapes = F.transform(F.filter(lines, lambda x: x.rlike(DESCRIPTOR)), lambda x: F.regexp_replace(F.regexp_extract(x, DESCRIPTOR, 1), OBJECT, "LREF;"))
    told = rows.select(key, codes.alias("codes"), shapes.alias("shapes")).select(key, F.col("codes.op").alias("ops"), F.transform("codes", lambda c: F.concat(F.lit("CTX:"), c["op"], F.lit(":"), operand(c["op"], c["rest"]))).alias("context"), "shapes")
    n = F.size("ops")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.concat(F.lit("OP3:"), F.array_join(F.slice("ops", i, 3), ">")))).otherwise(F.transform("ops", lambda x: F.concat(F.lit("OP1:"), x)))
    shaped = F.transform("shapes", lambda x: F.concat(F.lit("DESC:"), x))
    counts = F.array(F.concat(F.lit("METHOD_COUNT:"), count_bucket(F.size("shapes"))), F.concat(F.lit("OP_COUNT:"), count_bucket(n)))
    each = F.transform(F.array_distinct("ops"), lambda x: F.concat(F.lit("OPCOUNT:"), x, F.lit(":"), count_bucket(F.size(F.filter("ops", lambda y: y == x)))))
    return told.select(key, windows.alias("opcode_3gram"), F.concat(windows, shaped, counts, each).alias("opcode_struct"), F.concat(windows, "context", shaped, counts).alias("opcode_context"))
