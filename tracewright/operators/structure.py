"""Structure tokens of JSON and other structured text: what a document looks like, never what it says."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quality

# fixed values: keys that keep their name
COMMON_KEYS = frozenset(
    """type parent textures texture model item items ingredient ingredients result results count conditions condition values value
    replace entries entry pools pool rolls functions function name weight quality predicate display elements faces variants multipart
    apply when loader providers provider feature placement biomes biome category group pattern key criteria requirements rewards
    recipes advancements sounds subtitle min max chance levels level tag id""".split()
)
# fixed values: shapes, tokens and the most tokens a document gives
URL, HEX = re.compile(r"(https?|ftp)://", re.I), re.compile(r"[0-9a-fA-F]{16,}$")
RESOURCE, QUALIFIED = re.compile(r"[A-Za-z0-9_.-]+:[A-Za-z0-9_./-]+$"), re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*([./][A-Za-z_$][A-Za-z0-9_$]*){2,}$")
NUMBER, WORD = re.compile(r"[-+]?\d+(?:\.\d+)?"), re.compile(r"[A-Za-z_][A-Za-z0-9_.:/-]*|[-+]?\d+(?:\.\d+)?|[{}\[\](),:=]")
MOST_TOKENS = 100_000
OUTER = ("minecraft", "c")


def magnitude(v: int) -> int:
    return v.bit_length() if v > 0 else 0


def shape(text: str) -> list[str]:
    """Length class of a string, then the first shape that fits it."""
    s = text.strip()
    first = f"STR_LEN_{magnitude(len(s))}"
    for name, fits in (("STR_EMPTY", not s), ("STR_URL", URL.match(s)), ("STR_HEX", HEX.match(s))):
        if fits:
            return [first, name]
    if RESOURCE.match(s):
        space, path = s.lower().split(":", 1)
        parts = [len(p) for p in path.split("/") if p]
        kind = f"RID_EXTERNAL_{space}" if space in OUTER else "RID_NONSTANDARD_NAMESPACE"
        return [first, kind, f"RID_DEPTH_{magnitude(len(parts))}", *(f"RID_PART_LEN_{magnitude(n)}" for n in parts[:8])]
    if QUALIFIED.match(s):
        return [first, "STR_QUALIFIED_IDENTIFIER"]
    kinds = (("INTEGER_TEXT", s.isdigit()), ("NUMBER_TEXT", NUMBER.fullmatch(s)), ("ALPHA", s.isalpha()), ("ALNUM", s.isalnum()), ("MIXED", True))
    spaced = ["STR_HAS_SPACE"] if any(map(str.isspace, s)) else []
    return [first, *spaced, "STR_" + next(k for k, fits in kinds if fits), f"STR_WORDS_{magnitude(len(re.findall(r'\w+', s)))}"]


def key_token(key: str) -> str:
    k = key.strip().lower()
    return f"KEY_COMMON_{k}" if k in COMMON_KEYS else f"KEY_OTHER_LEN_{magnitude(len(k))}"


def json_tokens(value) -> list[str]:
    """Depth-first tokens of a parsed document, members in the order of their key tokens.  The walk keeps its
    own stack, so depth is bounded by the parser alone."""
    out, todo = [], [("value", value)]
    while todo and len(out) < MOST_TOKENS:
        kind, v = todo.pop()
        if kind == "key":
            out.append(v)
        elif v is None or isinstance(v, bool):
            out.append("NULL" if v is None else "BOOL")
        elif isinstance(v, int):
            out.append(f"INT_MAG_{magnitude(abs(v))}")
        elif isinstance(v, float):
            out.append(f"FLOAT_MAG_{magnitude(int(abs(v)))}" if math.isfinite(v) else "FLOAT_SPECIAL")
        elif isinstance(v, str):
            out += shape(v)
        elif isinstance(v, list):
            out.append(f"ARR_LEN_{magnitude(len(v))}")
            todo += [("value", x) for x in reversed(v)]
        else:
            out.append(f"OBJ_LEN_{magnitude(len(v))}")
            for k, x in reversed(sorted(((key_token(k), x) for k, x in v.items()), key=lambda m: m[0])):
                todo += [("value", x), ("key", k)]
    return out[:MOST_TOKENS]


def word_tokens(text: str) -> list[str]:
    """Tokens of text that is not JSON."""
    out = []
    for w in WORD.findall(text)[:MOST_TOKENS]:
        if w in "{}[](),:=":
            out.append(f"PUNC_{w}")
        elif NUMBER.fullmatch(w):
            out.append("NUMBER")
        elif RESOURCE.match(w):
            out += shape(w)
        else:
            out.append(f"WORD_COMMON_{w.lower()}" if w.lower() in COMMON_KEYS else f"WORD_LEN_{magnitude(len(w))}")
    return out


def described(text: str | None) -> tuple[str, list[str]]:
    """(parse kind, tokens); null counts as empty."""
    text = (text or "").removeprefix("﻿")
    if text.lstrip()[:1] in ("{", "["):
        try:
            return "JSON", json_tokens(json.loads(text))
        except (ValueError, RecursionError):
            pass
    return "TEXT_FALLBACK", word_tokens(text)


def _described(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([described(x) for x in texts], columns=["kind", "tokens"])


def structure(text: Column) -> Column:
    """Struct of parse kind and tokens."""
    return F.pandas_udf(_described, "struct<kind:string,tokens:array<string>>")(text)


def signatures(rows: DataFrame, key: str, text: str) -> DataFrame:
    """The 128-bit signature of tokens and their windows of three, with parse kind and token count; documents
    without tokens have null words."""
    told = rows.select(key, structure(F.col(text)).alias("s")).select(key, F.col("s.kind").alias("kind"), F.col("s.tokens").alias("tokens"))
    n = F.size("tokens")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(1), F.least(n - 2, F.lit(MOST_TOKENS))), lambda i: F.array_join(F.slice("tokens", i, 3), "|"))).otherwise(F.array().cast("array<string>"))
    words = quality.simhash128(told.select(key, F.concat("tokens", windows).alias("all")), key, "all")
    return told.select(key, "kind", n.cast("long").alias("token_count")).join(words, key, "left")
