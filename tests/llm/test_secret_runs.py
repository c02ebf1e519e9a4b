"""Keys and tokens in every spelling that the parsers take."""

import base64
import json

from tracewright.llm import secrets

P256 = bytes([0x30, 0x31, 0x02, 0x01, 0x01, 0x04, 0x20]) + b"\xfb" * 32 + bytes([0xA0, 0x0A, 0x06, 0x08]) + b"\x2a\x86\x48\xce\x3d\x03\x01\x07"
ED25519 = bytes([0x30, 0x2E, 0x02, 0x01, 0x00, 0x30, 0x05, 0x06, 0x03, 0x2B, 0x65, 0x70, 0x04, 0x22, 0x04, 0x20]) + b"\xff" * 32
BODY = bytes([0x02, 0x01, 0x00, 0x04, 0x82, 0x01, 0x00]) + b"\x11" * 256
RSA = bytes([0x30, 0x82]) + len(BODY).to_bytes(2, "big") + BODY
SSH = b"".join(len(f).to_bytes(4, "big") + f for f in (b"ssh-ed25519", b"\xff" * 32))


def spans(text):
    return [(secrets.KINDS[k], text[a:b]) for a, k, b in sorted(secrets.confirmed_spans(text))]


def test_every_spelling_of_a_key():
    for data, kind in ((P256, "der"), (ED25519, "der"), (RSA, "der"), (SSH, "ssh")):
        for run in (base64.b64encode(data).decode(), base64.urlsafe_b64encode(data).decode(), base64.urlsafe_b64encode(data).decode().rstrip("="), data.hex(), data.hex().upper()):
            assert spans(f"é KEY={run}&x") == [(kind, run)], run
    assert spans("A" + P256.hex()) == [("der", P256.hex())]
    assert spans(P256.hex()[:-2] + " " + base64.b64encode(ED25519[:-1]).decode()) == []


def test_headers_of_tokens_in_any_layout():
    url = lambda d: base64.urlsafe_b64encode(d.encode()).decode().rstrip("=")
    rest = url('{"sub":"1"}') + "." + url("signed")
    for header in (json.dumps({"alg": "HS256"}), '{ "alg": "HS256" }', '\n{\n"alg":"HS256"}', '{\r\n "alg": "HS256"}'):
        token = url(header) + "." + rest
        assert spans(f"t={token} {token}") == [("token", token)] * 2
        assert spans(f"documentation.example.{token}") == [("token", token)]
    assert spans("documentation.example.com " + url('{"typ":"JWT"}') + "." + rest) == []
