import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import flac, langid, media, mixing, pieces, quality, queries, secrets

from .helpers import BLANKS, HARD, hard, plain_targets

SMALL = "/root/testdata/sf0.01"


def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = queries.op9_language_id(spark, SMALL).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    held = [r["lang"] == r["lang_pred"] for r in got if r["held_out"]]
    assert sum(held) / len(held) > 0.97


def test_language_id_labels_switches_and_hard_cases(spark):
    sample = {"a": [b"alpha beta gamma delta alpha gamma " * 20], "b": [b"unos dosu tresu cuatu unos tresu " * 20]}
    model = (["a", "b"], *langid.train([langid.pieces_of(own[0], np.random.default_rng(1)) for own in sample.values()]))
    assert sorted(model[3].language.tolist()) == [0] * 4 + [1] * 4  # the lexicon: each of these words
    assert langid.spans_of("é alpha beta gamma alpha beta, unos dosu tresu cuatu unos".encode(), model)[-1] == (31, 57, "b")
    assert langid.spans_of(b"alpha beta gamma alpha beta unos dosu tresu cuatu unos", model) == [(0, 27, "a"), (28, 54, "b")]
    out = {(r["doc_id"], r["lang_pred"]) for r in langid.language_id(hard(spark)).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (11, "und")} <= out and len([i for i, _ in out]) == len({(r[0]) for r in HARD})
    assert {r["lang_pred"] for r in langid.language_id(hard(spark).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.language_id(hard(spark).limit(0)).collect() == []


def test_language_id_windows_are_the_whole_sequence(monkeypatch):
    sample = [[b"alpha beta gamma delta alpha gamma"] * 20, [b"unos dosu tresu cuatu unos tresu"] * 20]
    model = (["a", "b"], *langid.train(sample))
    text = b"alpha beta unos dosu alpha gamma tresu " * 30 + b"unalpha " * 9
    whole, one = langid.label_texts([text], model), langid.spans_of(text, model)
    monkeypatch.setattr(langid, "STEP_BYTES", 100)
    cut = langid.label_texts([text], model)
    assert cut[0] == whole[0] and cut[1] == pytest.approx(whole[1]) and langid.spans_of(text, model) == one


def test_language_id_learns_every_language(spark, monkeypatch):
    words = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in "bdfgklmn"]
    rows = [(70 * k + n, " ".join(words[(7 * k + j * (1 + n % 3)) % 480] + f"{chr(97 + k % 26)}{chr(97 + k // 26)}" for j in range(60)), f"l{k:02d}") for k in range(70) for n in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.language_id(docs).join(docs, "doc_id").collect()
    assert len({r["lang_pred"] for r in got}) == 70 and sum(r["lang"] == r["lang_pred"] for r in got) > 0.9 * len(got)
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 60)
    with pytest.raises(ValueError):
        langid.language_id(docs)


def test_language_spans_cover_the_words(spark):
    rows = langid.language_spans(hard(spark)).collect()
    assert len(rows) == len(HARD) and all(r["spans"] == [] for r in rows if r["doc_id"] in (1, 2, 3, 11))


@pytest.mark.parametrize("few", [0, 16])
@pytest.mark.parametrize("seed", range(3))
def test_forward_backward_is_the_plain_recursion(seed, few, monkeypatch):
    monkeypatch.setattr(langid, "FEW", few)
    pick = np.random.default_rng(seed)
    lengths = np.array([1, 0, 70, 33, 32, 5])
    first = np.concatenate(([0], np.cumsum(lengths)))
    scores, transition = pick.normal(size=(first[-1], 3)), pick.normal(size=(3, 3))
    got = langid.forward_backward(scores, first, transition)[0]
    for a, b in zip(first[:-1], first[1:]):
        e, m = np.exp(scores[a:b]), np.exp(transition)
        alpha, beta = np.ones((b - a, 3)), np.ones((b - a, 3))
        now = np.ones(3) / 3
        for k in range(b - a):
            now = (now @ m) * e[k]
            now /= now.sum()
            alpha[k] = now
        for k in range(b - a - 2, -1, -1):
            beta[k] = m @ (e[k + 1] * beta[k + 1])
            beta[k] /= beta[k].sum()
        want = alpha * beta
        assert np.allclose(got[a:b], want / want.sum(1, keepdims=True))


def test_quality_held_out_accuracy_and_edges(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    got = queries.op1_quality_classifier(spark, SMALL).join(labels, "doc_id").collect()
    held = [r["quality"] == r["predicted"] for r in got if r["held_out"]]
    assert sum(held) / len(held) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] is not None}) > 100
    few = spark.createDataFrame([(4, 1), (4, 0), (5, None), (None, 1), (6, 7)], "doc_id long, quality int")
    assert len(quality.quality(hard(spark), few).collect()) == len(HARD)
    assert len(quality.quality(hard(spark), few.limit(0)).collect()) == len(HARD)
    assert quality.quality(hard(spark).limit(0), few).collect() == []


def test_quality_score_is_the_plain_computation(spark):
    """The score from dictionaries, sizes and calibration done one text at a time."""
    import zstandard

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").where(langid.fold(F.col("doc_id"), 3) != 1)
    sample = quality.labelled_sample(docs, labels)
    dictionaries, slope, offset = quality.train(sample)
    wanted = {(r["doc_id"], r["quality"]) for r in labels.collect()}
    texts = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    assert sorted((r["quality"], r["text"].encode()) for r in sample.collect()) == sorted((q, texts[i]) for i, q in wanted)  # few: all, whole

    def size(text, raw):
        tool = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw), level=quality.LEVEL, write_content_size=False, write_dict_id=False)
        return sum(len(tool.compress(text[i : i + quality.CHUNK])) for i in range(0, len(text), quality.CHUNK))

    got = {r["doc_id"]: r["score"] for r in queries.op1_quality_classifier(spark, SMALL).collect()}
    for i in sorted(texts)[:40]:
        bad, good = (size(texts[i], raw) for raw in dictionaries)
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(slope * (bad - good) / (bad + good) + offset))), abs=1e-9)


def plain_secrets(text):
    spans = []
    assign = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    spans += [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(spans)


def test_secrets_base_is_the_plain_scan(spark):
    pick = random.Random(5)
    parts = ["password", "Passwd", "SECRET", "token", "api_key", "apiKEY", "ſecret", "=", ":", " ", '"', "'", "abcdefgh", "x", "AKIA", "ABCD1234", "0a" * 9, "f", "\n", "é"]
    for _ in range(3000):
        text = "".join(pick.choice(parts) for _ in range(pick.randrange(1, 14)))
        assert secrets.base_spans(text) == plain_secrets(text), text
    assert len(secrets.scan(hard(spark)).collect()) == len(HARD) and secrets.scan(hard(spark).limit(0)).collect() == []


def test_secrets_confirms_structure():
    import base64

    b64 = lambda d: base64.b64encode(d).decode()
    der = bytes([0x30, 0x82, 0x00, 0x00])
    body = bytes([0x02, 0x01, 0x00, 0x30, 0x0D]) + bytes([0x06, 0x09]) + b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01" + bytes([0x05, 0x00]) + bytes([0x04, 0x82, 0x01, 0x00]) + b"\x11" * 256
    der = bytes([0x30, 0x82]) + len(body).to_bytes(2, "big") + body
    ssh = b"".join(len(f).to_bytes(4, "big") + f for f in (b"ssh-ed25519", b"\x07" * 32))
    url = lambda d: base64.urlsafe_b64encode(d).decode().rstrip("=")
    jwt = ".".join((url(json.dumps({"alg": "HS256"}).encode()), url(b'{"sub":"1"}'), url(b"\x01" * 32)))
    pem = "-----BEGIN PRIVATE KEY-----\n" + b64(der) + "\n-----END PRIVATE KEY-----"
    kinds = lambda text: [secrets.KINDS[k] for _, k, _ in secrets.confirmed_spans(text)]
    assert kinds(f"é {b64(der)} x") == ["der"] and kinds(b64(ssh)) == ["ssh"] and kinds(f"t {jwt} t") == ["token"] and kinds(pem) == ["key", "der"]
    assert kinds(b64(der[:-1]) + " " + b64(ssh[:-2]) + " " + jwt.replace("eyJ", "eyK")) == []
    assert kinds("MI" + "A" * 60) == []
    assert secrets.is_der_key(der) and not secrets.is_der_key(der + b"\0") and kinds(der.hex()) == ["der"]


def targets(spark, sizes):
    return {r["key"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "key string, words long").repartition(3)).collect()}


def test_mixing(spark):
    sizes = {"1a": 100, "1b": 1000, "1c": 10, "2": 0} | {f"1d{k:02d}": k * 37 % 50 for k in range(30)}
    t = targets(spark, sizes)
    assert sum(t.values()) == pytest.approx(1.5 * sum(sizes.values())) and all(t[k] <= 2 * v + 1e-9 for k, v in sizes.items())
    assert t == pytest.approx(plain_targets(sizes)) and targets(spark, {}) == {} and targets(spark, {"2": 0}) == {"2": 0}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and sorted(rows) == sorted(mixing.mix(docs.repartition(7)).collect())
    of = {r["doc_id"]: (r["source"], len(re.findall(BLANKS, r["text"]))) for r in docs.collect()}
    taken, target = {}, {}
    for r in rows:
        source, n = of[r["doc_id"]]
        assert r["size"] == n and 0 <= r["taken"] <= 2 * n
        taken[source] = taken.get(source, 0) + r["taken"]
        target[source] = r["target"]
    names = sorted(target)
    whole = {s: sum(n for x, n in of.values() if x == s) for s in names}
    assert plain_targets(whole) == pytest.approx(target)
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert sum(1 for _ in mixing.repeat_to_mix(docs).collect()) == sum(r["taken"] // r["size"] for r in rows if r["size"])
    assert len(mixing.mix(hard(spark)).collect()) == len(HARD) and mixing.mix(hard(spark).limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(20))
def test_subset_sums(seed):
    pick = np.random.default_rng(seed)
    lengths = np.unique(pick.integers(1, 60, 8))
    counts = pick.integers(1, 5, len(lengths))
    total = int((lengths * counts).sum())
    reach = {0}
    for n, c in zip(lengths, counts):
        reach = {s + k * int(n) for s in reach for k in range(int(c) + 1)}
    budget = int(pick.integers(0, total + 1))
    take = mixing.fit(lengths, counts, budget)
    assert ((0 <= take) & (take <= counts)).all()
    assert abs(int((take * lengths).sum()) - budget) == min(abs(s - budget) for s in reach)


def test_subset_sums_of_very_long_documents():
    assert mixing.fit(np.array([2_000_000]), np.array([1]), 1_500_000).tolist() == [1]
    assert mixing.fit(np.array([1_500_000]), np.array([3]), 2_400_000).tolist() == [2]
    pick = np.random.default_rng(3)
    for _ in range(60):
        lengths = np.unique(pick.integers(1 << 20, 1 << 23, 5))
        counts = pick.integers(1, 4, len(lengths))
        total, reach = int((lengths * counts).sum()), {0}
        for n, c in zip(lengths, counts):
            reach = {s + k * int(n) for s in reach for k in range(int(c) + 1)}
        budget = int(pick.integers(0, total + 1))
        off = abs(int((mixing.fit(lengths, counts, budget) * lengths).sum()) - budget)
        assert off - min(abs(s - budget) for s in reach) <= 1e-3 * total


def test_null_ids_and_repeats_meet_the_target(spark):
    rows = [(None, f"w{k} " * (k % 5 + 1), "a") for k in range(4000)] + [(k, "x y", "b") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs).groupBy("target").agg(F.sum("taken").alias("taken")).collect()
    assert len(out) == 2 and all(abs(r["taken"] - r["target"]) <= 5 for r in out)


def test_repeat_to_mix_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(k, "x y z", "a", k, "s", 0) for k in range(40)], "doc_id long, text string, source string, `key` long, `size` string, `Order` int")
    out = mixing.repeat_to_mix(docs)
    assert out.columns == docs.columns and out.count() == 60 and all(r["key"] == r["doc_id"] for r in out.collect())


def test_pieces_equal_the_library(spark, documents):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    odd = ["", " ", "  a  b ", "漢字 テスト\n\n\tx", "a" * 300, "▁x ▁▁ y", "🎉 🎉x", "<s> </s> <0x0A>", "1234567 89.0", " " * 40 + "z"]
    texts = odd + [r["text"] for r in documents.collect()]
    rows = pieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["ids"] == model.encode(texts[r["doc_id"]]), texts[r["doc_id"]][:50]
        assert r["n_pieces"] == len(r["ids"]) and r["round_trip"] == ("▁" not in texts[r["doc_id"]])
    assert len(pieces.encode(hard(spark)).collect()) == len(HARD) and pieces.encode(hard(spark).limit(0)).collect() == []


def test_flac_round_trips_and_checks():
    pick = np.random.default_rng(2)
    payloads = [b"", b"a" * 64, bytes(range(256)) * 20, pick.bytes(64 * 70), b"ab" * 5000, bytes(192), "né ".encode() * 999]
    payloads = [media.payload(p) for p in payloads]
    streams = flac.encode(payloads)
    assert flac.decode(streams) == payloads and [flac.decode_plain(s) for s in streams] == payloads
    for k in (len(streams[2]) - 5, len(streams[2]) // 2):
        broken = bytearray(streams[2])
        broken[k] ^= 4
        with pytest.raises((flac.FlacError, IndexError)):
            flac.decode([bytes(broken)])


def test_media(spark, documents):
    rows = {r["doc_id"]: r for r in media.media_features(documents).collect()}
    texts = {r["doc_id"]: r["text"].encode() for r in documents.collect()}
    blocks = {}
    for r in media.pcm_blocks(media.media_streams(documents)).collect():
        blocks.setdefault(r["doc_id"], {})[r["sample_offset"]] = bytes(r["pcm"])
    import hashlib

    for i, t in texts.items():
        p = media.payload(t)
        assert rows[i]["payload_sha256"] == hashlib.sha256(p).hexdigest() and rows[i]["tail_crc32"] == zlib.crc32(p[-64:]) and rows[i]["n_bytes"] == len(t)
        assert b"".join(blocks[i][k] for k in sorted(blocks[i])) == p
    assert len(media.media_features(hard(spark)).collect()) == len(HARD) and media.media_features(hard(spark).limit(0)).collect() == []


def test_pieces_of_unbroken_and_windowed_texts(monkeypatch):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    pick = random.Random(4)
    encoder = pieces.Encoder(pieces.Vocabulary(pieces.load()))
    texts = ["a" * 9000, " " * 9000, "漢字テスト" * 700, "x" * 70 + " " + "y" * 90, " " * 300 + "a" * 4000 + "\n" * 50 + "b é" * 2000]
    texts += ["".join(pick.choice(letters) for _ in range(12000)) for letters in ("abcdeéñ漢🎉", "etaoin shrdlu", "▁ \n\tab", "01")]
    for step in (pieces.STEP, 777, 5000):
        monkeypatch.setattr(pieces, "STEP", step)
        for indexed in (pieces.INDEXED, 100):
            monkeypatch.setattr(pieces, "INDEXED", indexed)
            for t in texts:
                ids = encoder.encode([t.encode()])[0]
                assert ids.tolist() == model.encode(t)
                assert encoder.check(ids, t.encode())[1] == ("▁" not in t)
        monkeypatch.undo()


def test_pieces_memory_of_an_unbroken_text_is_bounded():
    import tracemalloc

    vocabulary = pieces.Vocabulary(pieces.load())
    most = []
    for size in (1 << 19, 1 << 21):
        text = ("%x" % random.Random(1).getrandbits(4 * size)).encode()
        tracemalloc.start()
        ids = pieces.Encoder(vocabulary).encode([text])[0]
        most.append(tracemalloc.get_traced_memory()[1] - 3 * ids.nbytes)
        tracemalloc.stop()
    assert most[1] < 1.3 * most[0]


def test_pieces_decode(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(["", None, " a  b ", "漢字 テスト\n\tx", "🎉x" * 3000])], "doc_id long, text string")
    back = {r["doc_id"]: r["text"] for r in pieces.decode(pieces.encode(rows).repartition(2)).collect()}
    assert back == {r["doc_id"]: r["text"] or "" for r in rows.collect()}
    odd = spark.createDataFrame([(1, None), (2, []), (3, [10**6]), (4, [None]), (5, [-7])], "doc_id long, ids array<int>")
    assert [r["text"] for r in pieces.decode(odd).orderBy("doc_id").collect()] == ["", "", "�", "�", "�"]
    assert pieces.decode(odd.limit(0)).collect() == []
