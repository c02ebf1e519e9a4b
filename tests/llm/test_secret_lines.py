"""Keys in lines: wrapped base64 and armour with header lines."""

import base64
import textwrap

from tracewright.llm import secrets


def der(size):
    body = bytes([2, 1, 0, 0x30, 0x05, 0x06, 3, 42, 3, 4, 4, 0x82]) + size.to_bytes(2, "big") + b"\x17" * size
    return bytes([0x30, 0x82]) + len(body).to_bytes(2, "big") + body


SHORT = bytes.fromhex("302e020100300506032b657004220420") + b"\x09" * 32  # an ed25519 key
EC = bytes([0x30, 0x77, 2, 1, 1, 4, 32]) + b"\x05" * 32 + bytes([0xA0, 10, 6, 8]) + b"\x2a\x86\x48\xce\x3d\x03\x01\x07" + bytes([0xA1, 68, 3, 66, 0, 4]) + b"\x08" * 64


def spans(text):
    return [(secrets.KINDS[k], text[a:b]) for a, k, b in sorted(secrets.confirmed_spans(text))]


def test_short_keys_after_an_equals_sign():
    assert secrets.is_der_key(SHORT) and secrets.is_der_key(EC)
    for key in (SHORT, EC, der(300)):
        b64 = base64.b64encode(key).decode()
        for text in (f"key={b64}", f"private_key='{b64}'", f"é {b64}\n", f"k: {key.hex()} ", f"k={key.hex().upper()}"):
            assert [k for k, _ in spans(text)] == ["der"], text


def test_wrapped_lines():
    for size in range(290, 300):
        b64 = base64.b64encode(der(size)).decode()
        for width in (64, 76, 100):
            for gap in ("\n", "\r\n", "\n    "):
                lines = gap.join(textwrap.wrap(b64, width))
                assert ("der", lines) in spans(f"x {lines}\nmore words here"), (size, width, gap)
                assert spans(f"x {lines[:-9]}\nmore words here") == []


def test_armour_with_headers():
    b64 = "\n".join(textwrap.wrap(base64.b64encode(der(300)).decode(), 64))
    pem = f"-----BEGIN RSA PRIVATE KEY-----\nComment: mine, 2024\n\n{b64}\n-----END RSA PRIVATE KEY-----"
    assert ("key", pem) in spans("a " + pem + " b")
    secret = base64.b64encode(b"\x99" * 304).decode()
    sealed = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,{'0A' * 16}\n\n{secret}\n-----END RSA PRIVATE KEY-----"
    assert spans(sealed) == [("key", sealed)]
    assert spans(sealed.replace("DEK-Info", "Other")) == []
    assert spans("-----BEGIN A-----\n" * 2000 + "MIIB" * 5000) == []
