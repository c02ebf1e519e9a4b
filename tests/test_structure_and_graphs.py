"""Structure tokens, image signatures and relabelling against hand-made cases and brute force."""

import itertools
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import images, protocol, relabel, structure


def test_shapes():
    assert structure.shape("  ") == ["STR_LEN_0", "STR_EMPTY"]
    assert structure.shape("HTTP://x")[1] == "STR_URL"
    assert structure.shape("0123456789abcdef")[1] == "STR_HEX"
    assert structure.shape("mine:block/stone") == ["STR_LEN_5", "RID_NONSTANDARD_NAMESPACE", "RID_DEPTH_2", "RID_PART_LEN_3", "RID_PART_LEN_3"]
    assert structure.shape("C:tag")[1] == "RID_EXTERNAL_c"
    assert structure.shape("a.b.C") == ["STR_LEN_3", "STR_QUALIFIED_IDENTIFIER"]
    assert structure.shape("a.b")[1:] == ["STR_MIXED", "STR_WORDS_2"]
    assert structure.shape("two words") == ["STR_LEN_4", "STR_HAS_SPACE", "STR_MIXED", "STR_WORDS_2"]
    assert [structure.shape(x)[1] for x in ("12", "-1.5", "abc", "a1")] == ["STR_INTEGER_TEXT", "STR_NUMBER_TEXT", "STR_ALPHA", "STR_ALNUM"]


def test_json_walk():
    kind, tokens = structure.described('{"zz": [1, -2.5, true], "type": null}')
    assert kind == "JSON"
    assert tokens == ["OBJ_LEN_2", "KEY_COMMON_type", "NULL", "KEY_OTHER_LEN_2", "ARR_LEN_2", "INT_MAG_1", "FLOAT_MAG_2", "BOOL"]
    assert structure.described('﻿{"a": 1}')[0] == "JSON"
    assert structure.described("[" * 200_000) == ("TEXT_FALLBACK", ["PUNC_["] * 100_000)
    assert structure.described("name = 12") == ("TEXT_FALLBACK", ["WORD_COMMON_name", "PUNC_=", "NUMBER"])
    assert structure.described(None) == structure.described("") == ("TEXT_FALLBACK", [])


def test_structure_signature(spark):
    rows = spark.createDataFrame([(1, '{"a": 1, "b": 2}'), (2, '{"c": 1, "d": 3}'), (3, None), (4, "x")], "id long, text string")
    got = {r["id"]: r for r in structure.signatures(rows, "id", "text").collect()}
    assert got[1]["w0"] is not None and got[1][3:] != got[4][3:]
    assert (got[3]["token_count"], got[3]["w0"]) == (0, None)
    assert got[1]["kind"] == "JSON" and got[4]["kind"] == "TEXT_FALLBACK"


def packed(pixels, colour, depth=8, palette=None, kind=0):
    """A PNG with every row stored by one filter."""
    high, wide = pixels.shape[:2]
    rows = pixels.reshape(high, -1).astype(np.uint8)
    step, body, above = max(images.CHANNELS[colour] * depth // 8, 1), b"", np.zeros(rows.shape[1], np.int64)
    for row in rows.astype(np.int64):
        left = np.concatenate([np.zeros(step, np.int64), row[:-step]])
        corner = np.concatenate([np.zeros(step, np.int64), above[:-step]])
        p = left + above - corner
        dist = np.stack([abs(p - left), abs(p - above), abs(p - corner)])
        paeth = np.choose(dist.argmin(axis=0), [left, above, corner])
        guess = [0 * row, left, above, (left + above) // 2, paeth][kind]
        body += bytes([kind]) + ((row - guess) & 255).astype(np.uint8).tobytes()
        above = row
    head = struct.pack(">IIBBBBB", wide, high, depth, colour, 0, 0, 0)
    return images.SIGNATURE + images._chunk(b"IHDR", head) + (images._chunk(b"PLTE", palette) if palette else b"") + images._chunk(b"IDAT", zlib.compress(body)) + images._chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    pick = np.random.default_rng(kind)
    gray, colour = pick.integers(0, 256, (7, 5)), pick.integers(0, 256, (6, 4, 4))
    assert (images.read_png(packed(gray, 0, kind=kind)) == gray).all()
    luminance = (colour[..., 0] * 19595 + colour[..., 1] * 38470 + colour[..., 2] * 7471 + 0x8000) >> 16
    assert (images.read_png(packed(colour, 6, kind=kind)) == luminance).all()


def test_png_palette_and_round_trip():
    gray = np.random.default_rng(1).integers(0, 256, (9, 9)).astype(np.uint8)
    assert (images.read_png(images.write_png(gray)) == gray).all()
    assert images.read_png(packed(np.array([[0, 1]]), 3, palette=b"\0\0\0\xff\xff\xff")).tolist() == [[0, 255]]


def test_resize_keeps_flat_images_and_ramps():
    assert set(images.resized(np.full((40, 17), 93, np.uint8), 8, 8).ravel()) == {93}
    ramp = images.resized(np.tile(np.arange(0, 256, 2, dtype=np.uint8), (32, 1)), 9, 8)
    assert (np.diff(ramp, axis=1) > 0).all() and (ramp == ramp[0]).all()


def test_image_hashes(spark):
    ramp = np.tile(np.arange(0, 256, 8, dtype=np.uint8), (32, 1))
    rows = spark.createDataFrame([(1, images.write_png(ramp)), (2, images.write_png(ramp[:, ::-1])), (3, b"no image"), (4, None), (5, b"")], "id long, payload binary")
    got = {r["id"]: r["f"] for r in rows.select("id", images.image_features(F.col("payload")).alias("f")).collect()}
    assert (got[1]["dhash"], got[2]["dhash"]) == ("0" * 16, "f" * 16)
    assert (got[1]["ahash"], got[2]["ahash"]) == ("0f" * 8, "f0" * 8)
    assert got[1]["hist16"] == ",".join(["625"] * 16) and int(got[1]["phash"], 16) < 1 << 63
    assert [got[i]["ahash"] for i in (3, 4, 5)] == [None] * 3


def graph_of(seed, n=7):
    pick = random.Random(seed)
    edges = sorted({(min(a, b), max(a, b)) for a, b in ((pick.randrange(n), pick.randrange(n)) for _ in range(8)) if a != b})
    return pick, edges


def parts(nodes, edges):
    return len({frozenset(relabel.component_of(n, edges)) for n in nodes})


@pytest.mark.parametrize("seed", range(20))
def test_bridges_are_brute_force(seed):
    _, edges = graph_of(seed)
    found = relabel.bridges(range(7), edges)
    assert [e for e, _ in found] == [e for e in edges if parts(range(7), [x for x in edges if x != e]) > parts(range(7), edges)]
    for e, far in found:
        assert far in [relabel.component_of(x, [y for y in edges if y != e]) for x in e]


@pytest.mark.parametrize("seed", range(10))
def test_markov_is_a_local_optimum(seed):
    pick, edges = graph_of(seed)
    evidence = {n: {p: pick.random() for p in range(3)} for n in range(6)}  # the seventh node has none
    labels, cost = relabel.markov(evidence, edges, 0.1, 0.05)
    unary = {n: {p: d[p] - min(d.values()) for p in d} for n, d in evidence.items()}
    assert cost == pytest.approx(relabel.energy(labels, unary, edges, 0.1, 0.05))
    for n, p in itertools.product(labels, range(3)):
        assert relabel.energy(labels | {n: p}, unary, edges, 0.1, 0.05) >= cost - 1e-9
    nodes = sorted(labels)
    least = min(relabel.energy(dict(zip(nodes, c)), unary, edges, 0.1, 0.05) for c in itertools.product(range(3), repeat=len(nodes)))
    assert least - 1e-9 <= cost


def test_a_bridge_between_two_sources_goes(spark):
    near = lambda p: [(p, 0.0), (3 - p, 0.5)]
    rows = [(1, n, p, d) for n in range(4) for p, d in near(1 if n < 2 else 2)]
    table = spark.createDataFrame(rows, "query_id long, node_id long, parent int, fused double")
    edges = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 2, 3)], "query_id long, node_a long, node_b long")
    # single ends lead by 0.5 and their far sides by a third of it: only the middle edge passes 0.2, all pass 0.1
    assert [tuple(r) for r in relabel.bridge_cuts(table, edges, 0.2).collect()] == [(1, 1, 2, 1, 2, 0.5)]
    assert sorted(tuple(r)[1:5] for r in relabel.bridge_cuts(table, edges, 0.1).collect()) == [(0, 1, 1, 2), (1, 2, 1, 2), (2, 3, 1, 2)]
    got = {r["node_id"]: (r["component"], r["parent"]) for r in relabel.hierarchical(table, edges, 0.2).collect()}
    assert got == {0: (0, 1), 1: (0, 1), 2: (2, 2), 3: (2, 2)}
    assert {r["parent"] for r in relabel.soft_graph(table, edges, 0.01, 0.01).collect()} == {1, 2}
    none = edges.where("query_id < 0")
    assert relabel.bridge_cuts(table, none, 0.1).count() == 0 and relabel.hierarchical(table, none, 0.1).count() == 4


def test_clone_ties_and_hidden_parents(spark):
    pairs = spark.createDataFrame([(1, 7, "m"), (1, 7, "m"), (1, 8, "n"), (2, 7, "m"), (2, 7, "n"), (2, 8, "m")], "node_id long, parent long, method string")
    assert {r["node_id"]: (r["support"], r["ties"], r["parent"]) for r in protocol.clone_votes(pairs).collect()} == {1: (1, 2, None), 2: (2, 1, 7)}
    nodes = spark.createDataFrame([(1, 1, None), (2, 1, 4), (2, 2, 4)], "query_id long, node_id long, truth int")
    assert [tuple(r) for r in protocol.hidden(nodes).collect()] == [(2, 4, 0, 2)]
