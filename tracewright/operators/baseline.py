"""Baseline fingerprints: SimHash over BLAKE2b of raw tokens, least significant bit first; no tokens give zero."""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: tokens of code, of JSON strings and of other text, and the longest code token
CODE_TOKEN = re.compile(rb"[A-Za-z_$][A-Za-z0-9_$/.$<>;():\[\]-]{2,}")
VALUE_TOKEN, TEXT_TOKEN, LONGEST = re.compile(r"[A-Za-z0-9_$./:-]+"), re.compile(r"[A-Za-z0-9_$./:-]{2,}"), 200


def simhash(weights: dict[bytes, int], size: int, person: bytes = b"") -> int:
    """Sign of each bit's weighted sum over digests of ``size`` bytes, zero counting as one."""
    if not weights:
        return 0
    digests = b"".join(hashlib.blake2b(x, digest_size=size, person=person).digest() for x in weights)
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, size), axis=1).astype(np.int64)
    total = (2 * bits - 1).T @ np.array(list(weights.values()), np.int64)
    return int.from_bytes(np.packbits(total >= 0).tobytes(), "big")


def simhash64(tokens) -> int:
    return simhash({x if isinstance(x, bytes) else x.encode("utf-8", "ignore"): 1 for x in tokens}, 8)


def simhash128(tokens, person: bytes, most: int = 8) -> int:
    """Counts weigh up to ``most``; ``person`` keeps the hash apart from others."""
    return simhash({x.encode("utf-8", "ignore"): min(n, most) for x, n in Counter(tokens).items()}, 16, person)


def code_tokens(data: bytes) -> list[bytes]:
    return [x.lower() for x in CODE_TOKEN.findall(data) if len(x) <= LONGEST]


def flat(value) -> list[str]:
    """Keys, words of strings, types of scalars and list marks of a parsed document (null gives nothing)."""
    out, todo = [], [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            out += [f"KEY:{k.lower()}" for k in v]
            todo += v.values()
        elif isinstance(v, list):
            out.append("LIST")
            todo += v
        elif isinstance(v, str):
            out += [f"VAL:{x}" for x in VALUE_TOKEN.findall(v.lower())]
        elif v is not None:
            out.append(f"TYPE:{type(v).__name__}")
    return out


def structured_tokens(data: bytes) -> list[str]:
    try:
        return flat(json.loads(data.decode("utf-8")))
    except (ValueError, RecursionError):
        return TEXT_TOKEN.findall(data.decode("utf-8", "ignore").lower())


def _column(tokens_of):
    def told(payloads: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else f"{simhash64(tokens_of(bytes(x))):016x}" for x in payloads], dtype=object)

    return told


def code_fingerprint(payload: Column) -> Column:
    """64 bits as hex; null stays null."""
    return F.pandas_udf(_column(code_tokens), "string")(payload)


def structured_fingerprint(payload: Column) -> Column:
    return F.pandas_udf(_column(structured_tokens), "string")(payload)
