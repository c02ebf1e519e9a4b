"""Secret scans with structural confirmation.

Base spans are found by pattern (assignments, access keys, long hex runs).  The method adds spans of
candidates that prove to be what they look like: base64 or hex text is decoded and its key encoding
parsed (nested DER lengths that close exactly, length-prefixed public keys), armoured keys are decoded
between their marks, header lines apart, and the header of a signed token must be a JSON object that names
an algorithm.  Base64 that is wrapped into lines is joined as far as the outer DER length says.
Every whole text is scanned; offsets are code points, ends exclusive.

* null and empty text: no spans; overlapping kinds: each kind reports its own; repeated rows: each is
  scanned; empty table: no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from . import store
from .text import slices

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # a shorter run fails as a whole, whatever begins inside it
HEX = re.compile(r"[0-9a-f]{32,}")
UPPER_HEX = re.compile(r"[0-9A-F]{48,}")
ANY_HEX = re.compile(r"[0-9A-Fa-f]{48,}")
#: Any three dotted runs, also those that begin inside of others; the header's JSON decides.
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(?=([A-Za-z0-9_-]{11,}+\.[A-Za-z0-9_-]{2,}+\.[A-Za-z0-9_-]*+))")
ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9]+(?: [A-Z0-9]+)*)-----\s*((?:[A-Za-z-]+: [^\n]*\n)*)([A-Za-z0-9+/=\s]{16,})-----END \1-----")
#: What encrypted armour tells of its cipher; its bytes have whole cipher blocks and no structure.
CIPHER = re.compile(r"^DEK-Info: [A-Z0-9-]+,[0-9A-Fa-f]{16,32}\s*$", re.M)
#: Lines of base64 below one that begins as DER does.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/])M[A-P][A-Za-z0-9+/]{28,}+(?:\r?\n[ \t]*+[A-Za-z0-9+/]++)+={0,2}")
_GAP = re.compile(r"\s+")
#: Whole runs of either alphabet, of 24 bytes at least; a key begins with byte 0x30 (M and A to P) or with three bytes 0.
BASE64 = [re.compile(rf"(?<![{own}])(?:M[A-P]|AAAA)[{own}]{{28,}}+={{0,2}}") for own in ("A-Za-z0-9+/", "A-Za-z0-9_-")]
#: Kinds in the order in which spans that begin together are listed.
KINDS = ("assign", "access", "hex", "token", "key", "der", "ssh")
_SSH = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521")


def der_closes(data: bytes, depth: int = 0) -> bool:
    """Whether the bytes are a run of DER values whose nested lengths all close exactly."""
    at = 0
    while at < len(data):
        if at + 2 > len(data) or depth > 12:
            return False
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            many = size & 0x7F
            if not 1 <= many <= 4 or at + many > len(data) or data[at] == 0:
                return False
            size = int.from_bytes(data[at : at + many], "big")
            at += many
        if tag == 0 or at + size > len(data):
            return False
        if tag & 0x20 and not der_closes(data[at : at + size], depth + 1):
            return False
        at += size
    return True


def der_size(data: bytes) -> int:
    """Bytes of the value that begins here, as its length says."""
    body = 2 + (data[1] & 0x7F if data[1] & 0x80 else 0)
    return body + (int.from_bytes(data[2:body], "big") if data[1] & 0x80 else data[1])


def is_der_key(data: bytes) -> bool:
    """One outer SEQUENCE that fills the bytes and begins with an INTEGER or a SEQUENCE."""
    if len(data) < 24 or data[0] != 0x30 or der_size(data) != len(data) or not der_closes(data):
        return False
    return data[2 + (data[1] & 0x7F if data[1] & 0x80 else 0)] in (0x02, 0x30)


def is_ssh_key(data: bytes) -> bool:
    """Length-prefixed fields that close exactly, the first one naming a key type."""
    at, fields = 0, []
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return False
        fields.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return len(fields) >= 2 and fields[0] in _SSH


def from_base64(text: str, url: bool = False) -> bytes | None:
    try:
        text = text.rstrip("=")
        return base64.b64decode(text + "=" * (-len(text) % 4), b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def _key_kind(data: bytes | None) -> int | None:
    return None if not data else 5 if is_der_key(data) else 6 if is_ssh_key(data) else None


def wrapped_key_end(text: str, start: int, end: int) -> int | None:
    """Where the key that begins in these lines of base64 ends, if it is one that ends with a line."""
    head = from_base64(text[start : start + 8])
    chars, at, parts = -(-der_size(head) * 4 // 3) if head else 0, start, []
    while chars > 0 and at < end:
        gap = _GAP.search(text, at, end)
        line = text[at : gap.start() if gap else end].rstrip("=")
        if len(line) > chars:
            return None
        parts.append(line)
        chars -= len(line)
        last, at = at + len(line), gap.end() if gap else end
    if chars > 0 or len(parts) < 2:
        return None
    data = from_base64("".join(parts))
    return last + len(text[last:end]) - len(text[last:end].lstrip("=")) if data and is_der_key(data) else None


def is_signed_token(text: str) -> bool:
    head, body, _ = text.split(".")
    raw, claims = from_base64(head, True), from_base64(body, True)
    if raw is None or claims is None:
        return False
    try:
        header = json.loads(raw)
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the pattern kinds."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of candidates whose structure was parsed."""
    spans, last = [], 0
    for m in TOKEN.finditer(text):
        if m.start() >= last and is_signed_token(m[1]):
            last = m.end(1)
            spans.append((m.start(), 3, last))
    if "-----BEGIN" in text:
        for m in ARMOUR.finditer(text):
            data = from_base64("".join(m[3].split()))
            if data and (is_der_key(data) or data.startswith(b"openssh-key-v1\0") or (len(data) % 8 == 0 and CIPHER.search(m[2]))):
                spans.append((m.start(), 4, m.end()))
    found = set()
    for url, pattern in enumerate(BASE64):
        for m in pattern.finditer(text):
            found.add((m.start(), _key_kind(from_base64(m[0], bool(url))), m.end()))
    for m in WRAPPED.finditer(text):
        last = wrapped_key_end(text, m.start(), m.end())
        if last:
            found.add((m.start(), 5, last))
    for run in ANY_HEX.finditer(text):
        # the run of mixed case, and the runs of one case in it
        for m in (run, *HEX.finditer(text, *run.span()), *UPPER_HEX.finditer(text, *run.span())):
            if len(m[0]) % 2 == 0 and m[0].startswith(("30", "000000")):
                found.add((m.start(), _key_kind(bytes.fromhex(m[0])), m.end()))
    spans += [x for x in found if x[1] is not None]
    return spans


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def _scanned(batches):
    for batch, texts in slices(batches):
        rows = []
        for t in texts:
            text = t.decode("utf-8", "replace")
            base = base_spans(text)
            rows.append((*[sum(k == kind for _, k, _ in base) for kind in range(3)], hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + confirmed_spans(text))))
        columns = list(zip(*rows))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3]), pa.array(columns[4])],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of ``docs`` (doc_id, text)."""
    store.prepare(docs.sparkSession)
    docs = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    return docs.mapInArrow(_scanned, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
