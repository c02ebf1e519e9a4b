"""Language ID by a linear-chain conditional random field over words.

Words are runs of letters (ASCII letters or bytes of longer characters).  A word's features are its whole
form, affixes of two and three bytes and its byte trigrams, hashed into a table with one weight a
language, and its entry in a lexicon learnt from the training words: the language that has most of its
occurrences.  Transitions between the languages of neighbouring words are learned too, from code-switched
sequences spliced out of pieces of the training documents.  Forward-backward labels each word of the
whole text; a document's language is that with the largest mean marginal, its score that mean.  A text
beyond a step is labelled in windows, whose borders keep the forward and backward vectors: the marginals
are those of the whole sequence.

Training reads a bounded sample of labelled rows, about ``DOCS_A_LANGUAGE`` for each language by hash of
id and text, and of their whole texts a share of pieces by chance, about ``BYTES_A_LANGUAGE`` for each
language (fewer with many languages, so that training stays below ``WORK`` products).  Every language is
learnt; more than ``MOST_LANGUAGES`` raise an error.  Prediction reads only the text, all of it.

* null text, or a text without a letter: ``und``, score 0; no labelled row at all: ``und`` everywhere;
* ties go to the language that is smaller by code point; repeated rows and ids are separate documents;
* empty table: no rows; other columns are not read, whatever their names; a null doc_id counts as ''
  where folds are dealt.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from .text import STEP_BYTES, Words, slices

DOCS_A_LANGUAGE, BYTES_A_LANGUAGE, MOST_LANGUAGES, WORK = 150, 400_000, 256, 2e11
#: Bits of the feature table, steps of training, words of a block; languages up to which blocks are chained.
TABLE_BITS, ROUNDS, BLOCK, FEW = 15, 20, 32, 16
#: Occurrences of a word in the lexicon at least, and the share that its language has of them.
SEEN, SURE = 3, 0.8
UNKNOWN = "und"

_NO_LETTER = np.ones(256, bool)
_NO_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def fold(doc_id: Column, folds: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds))


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


class Lexicon:
    """Words (by hash) with the language that has most of their occurrences in training."""

    def __init__(self, words: Words, language: np.ndarray, languages: int):
        keys, at = np.unique(words.hashes(), return_inverse=True)
        count = np.zeros((len(keys), max(1, languages)), np.int64)
        np.add.at(count, (at, language), 1)
        total, best = count.sum(1), count.argmax(1)
        keep = (total >= SEEN) & (count[np.arange(len(keys)), best] >= SURE * total)
        self.keys, self.language, self.none = keys[keep], best[keep].astype(np.int32), max(1, languages)

    def entry(self, hashes: np.ndarray) -> np.ndarray:
        """The language of each word, or ``none``."""
        if not len(self.keys):
            return np.full(len(hashes), self.none, np.int32)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.language[at], self.none).astype(np.int32)


class Features:
    """Feature indices: ``single`` has one row a kind, one column a word; ``grams`` those of the trigrams,
    whose words are ``gram_word``.  Entries of the lexicon follow the hashed table."""

    def __init__(self, words: Words, lexicon: Lexicon):
        start, end = words.start, words.end
        shift = np.uint64(64 - TABLE_BITS)
        spans = [(start, end), (start, np.minimum(start + 2, end)), (start, np.minimum(start + 3, end)), (np.maximum(end - 2, start), end), (np.maximum(end - 3, start), end)]
        self.rows = (1 << TABLE_BITS) + lexicon.none + 1
        self.single = np.zeros((len(spans) + 1, len(start)), np.int32)
        for k, (a, b) in enumerate(spans if len(start) else []):
            hashes = words.span_hash(a, b)
            if not k:
                self.single[-1] = (1 << TABLE_BITS) + lexicon.entry(hashes)
            self.single[k] = (hashes * np.uint64(2 * k + 0x9E3779B97F4A7C15)) >> shift
        data = words.data.astype(np.uint64)
        code = (data[:-2] << np.uint64(16) | data[1:-1] << np.uint64(8) | data[2:]) if len(data) > 2 else np.zeros(0, np.uint64)
        inside = np.maximum(end - start - 2, 0)
        at = np.repeat(start - (np.cumsum(inside) - inside), inside) + np.arange(int(inside.sum()))
        self.gram_word = np.repeat(np.arange(len(start)), inside)
        self.grams = ((code[at] * np.uint64(0xC2B2AE3D27D4EB4F)) >> shift).astype(np.int32)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros((self.single.shape[1], weights.shape[1]))
        for row in self.single:
            out += weights[row]
        for k in range(weights.shape[1]):
            out[:, k] += np.bincount(self.gram_word, weights[:, k][self.grams], len(out))
        return out

    def gather(self, error: np.ndarray) -> np.ndarray:
        """The gradient of the weights, from the error of each word."""
        grad = np.empty((self.rows, error.shape[1]))
        for k in range(error.shape[1]):
            grad[:, k] = np.bincount(self.grams, error[:, k][self.gram_word], self.rows)
            for row in self.single:
                grad[:, k] += np.bincount(row, error[:, k], self.rows)
        return grad


def forward_backward(scores: np.ndarray, first: np.ndarray, transition: np.ndarray, enters: np.ndarray | None = None, leaves: np.ndarray | None = None):
    """Marginals of every word, with the forward and backward vectors (each scaled to sum 1), and those
    that leave each sequence at its end and at its beginning.

    ``first`` delimits the sequences, which begin with the vectors ``enters`` and end with ``leaves`` (one
    a sequence; else all labels alike).  Exact: with few labels, sequences are cut into blocks whose
    transfer matrices are multiplied for all blocks at once, then chained within each sequence; with more,
    a sequence is one block.
    """
    labels = scores.shape[1]
    weight = np.exp(scores - scores.max(1, keepdims=True)) if len(scores) else scores
    move = np.exp(transition - transition.max())
    lengths = np.diff(first)
    block_size = BLOCK if labels <= FEW else max(1, int(lengths.max(initial=1)))
    per = -(-lengths // block_size)
    block_first = np.concatenate(([0], np.cumsum(per)))
    blocks = int(block_first[-1])
    out = np.full((len(per), labels), 1 / labels) if enters is None else enters.copy()
    back = np.full((len(per), labels), 1 / labels) if leaves is None else leaves.copy()
    if not blocks:
        return scores, scores, scores, out, back
    sequence = np.repeat(np.arange(len(per)), per)
    begin = first[:-1][sequence] + block_size * (np.arange(blocks) - block_first[sequence])
    size = np.minimum(block_size, first[1:][sequence] - begin)
    enter, leave = out[sequence], back[sequence]
    if int(per.max()) > 1:
        transfer = np.broadcast_to(np.eye(labels), (blocks, labels, labels)).copy()
        for k in range(block_size):
            on = np.flatnonzero(size > k)
            if not len(on):
                break
            step = (transfer[on].reshape(-1, labels) @ move).reshape(-1, labels, labels) * weight[begin[on] + k][:, None, :]
            transfer[on] = step / step.max((1, 2), keepdims=True)
        order = np.argsort(-per, kind="stable")
        counts = np.sort(per)[::-1]
        now = out.copy()
        for j in range(int(counts[0])):
            who = order[: np.searchsorted(-counts, -j, "left")]
            block = block_first[who] + j
            enter[block] = now[who]
            new = np.einsum("bi,bij->bj", now[who], transfer[block])
            now[who] = new / new.sum(1, keepdims=True)
        now = back.copy()
        for j in range(int(counts[0])):
            who = order[: np.searchsorted(-counts, -j, "left")]
            block = block_first[who] + per[who] - 1 - j
            leave[block] = now[who]
            new = np.einsum("bij,bj->bi", transfer[block], now[who])
            now[who] = new / new.sum(1, keepdims=True)
    alpha, beta = np.empty_like(weight), np.empty_like(weight)
    now = enter
    for k in range(block_size):
        on = np.flatnonzero(size > k)
        if not len(on):
            break
        new = (now[on] @ move) * weight[begin[on] + k]
        now[on] = new / new.sum(1, keepdims=True)
        alpha[begin[on] + k] = now[on]
    some = per > 0
    out[some] = now[block_first[1:][some] - 1]
    now = leave
    for k in range(int(size.max()) - 1, -1, -1):
        on = np.flatnonzero(size > k)
        at = begin[on] + k
        beta[at] = now[on]
        new = (now[on] * weight[at]) @ move.T
        now[on] = new / new.sum(1, keepdims=True)
    back[some] = now[block_first[:-1][some]]
    marginal = alpha * beta
    return marginal / marginal.sum(1, keepdims=True), alpha, beta, out, back


def pieces_of(text: bytes, pick: np.random.Generator) -> list[bytes]:
    """The text cut into pieces of some words."""
    words, out, at = text.split(), [], 0
    while at < len(words):
        to = at + int(pick.integers(8, 60))
        out.append(b" ".join(words[at:to]))
        at = to
    return out


def train(texts: list[list[bytes]], seed: int = 7) -> tuple[np.ndarray, np.ndarray, Lexicon]:
    """Feature weights and transitions by maximum conditional likelihood, Adagrad steps, from pieces of
    each language; and the lexicon."""
    labels, pick = len(texts), np.random.default_rng(seed)
    order = pick.permutation(sum(map(len, texts)))
    pieces, language = [p for own in texts for p in own], np.repeat(np.arange(labels), [len(own) for own in texts]).astype(int)
    pieces, language = [pieces[i] for i in order], language[order]
    words = Words(pieces, _NO_LETTER)
    truth = np.repeat(language, words.count)
    lexicon = Lexicon(words, truth, labels)
    # sequences of twelve pieces: mostly within one text's language, switching where pieces meet
    first = np.append(words.first[:-1:12], len(truth))
    first = first[np.concatenate(([True], np.diff(first) > 0))]
    features = Features(words, lexicon)
    weights, transition = np.zeros((features.rows, labels)), np.zeros((labels, labels))
    seen_w, seen_t = np.full_like(weights, 1e-6), np.full_like(transition, 1e-6)
    if labels < 2 or not len(truth):
        return weights, transition, lexicon
    one = np.eye(labels)[truth]
    inner = np.ones(len(truth), bool)
    inner[first[:-1]] = False
    then = np.flatnonzero(inner)
    observed = one[then - 1].T @ one[then]
    total = len(truth)
    for _ in range(ROUNDS):
        scores = features.scores(weights)
        marginal, alpha, beta, _, _ = forward_backward(scores, first, transition)
        move = np.exp(transition - transition.max())
        right = np.exp(scores - scores.max(1, keepdims=True))[then] * beta[then]
        norm = ((alpha[then - 1] @ move) * right).sum(1, keepdims=True)
        expected = move * ((alpha[then - 1] / norm).T @ right)
        grad = features.gather(one - marginal) / total - 1e-6 * weights
        step = (observed - expected) / total
        seen_w += grad**2
        seen_t += step**2
        weights += 0.5 * grad / np.sqrt(seen_w)
        transition += 0.3 * step / np.sqrt(seen_t)
    return weights, transition, lexicon


def _cut(rates: dict[str, float]):
    def run(batches):
        for batch, texts in slices(batches):
            langs, out = [], []
            for lang, key, text in zip(batch.column("lang").to_pylist(), batch.column("key").to_pylist(), texts):
                pick = np.random.default_rng(key & 0x7FFFFFFFFFFFFFFF)
                own = [p for p in pieces_of(text, pick) if pick.random() < rates[lang]]
                langs += [lang] * len(own)
                out += own
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], names=["lang", "piece"])

    return run


def labelled_sample(docs: DataFrame) -> dict[str, list[bytes]]:
    """Pieces of the whole texts of about DOCS_A_LANGUAGE rows for each language: about BYTES_A_LANGUAGE."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return {}
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, DOCS_A_LANGUAGE / n))]), F.col("lang"))
    keyed = rows.select("lang", "text", F.xxhash64("doc_id", "text").alias("key")).where(F.col("key") / F.lit(float(2**64)) + 0.5 < share)
    sample = store.written(keyed.dropDuplicates(["lang", "key"]), "langid-sample")
    sizes = {r["lang"]: r["bytes"] for r in sample.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes")).collect()}
    most = min(BYTES_A_LANGUAGE, 6 * WORK / (3 * ROUNDS * len(counts) ** 3))
    rates = {k: min(1.0, most / n) for k, n in sizes.items()}
    out: dict[str, list[bytes]] = {k: [] for k in sorted(counts)}
    for r in sorted((r["lang"], bytes(r["piece"])) for r in sample.mapInArrow(_cut(rates), "lang string, piece binary").collect()):
        out[r[0]].append(r[1])
    return out


def _windows(text: bytes) -> list[bytes]:
    """The text in windows of about STEP_BYTES, cut where no word is."""
    data, at, out = np.frombuffer(text, np.uint8), 0, []
    while at < len(text):
        to = at + STEP_BYTES
        while to < len(text):
            gaps = np.flatnonzero(_NO_LETTER[data[to : to + STEP_BYTES]])
            if len(gaps):
                to += int(gaps[0])
                break
            to += STEP_BYTES
        out.append(text[at:to])
        at = to
    return out


def label_parts(text: bytes, model):
    """(marginals, words) of each window of a long text, from the last to the first."""
    _, weights, transition, lexicon = model
    labels, windows = weights.shape[1], _windows(text)
    enter = [np.full((1, labels), 1 / labels)]
    for part in windows[:-1]:
        words = Words([part], _NO_LETTER)
        enter.append(forward_backward(Features(words, lexicon).scores(weights), words.first, transition, enter[-1])[3])
    leave = np.full((1, labels), 1 / labels)
    for part, vector in zip(reversed(windows), reversed(enter)):
        words = Words([part], _NO_LETTER)
        marginal, _, _, _, leave = forward_backward(Features(words, lexicon).scores(weights), words.first, transition, vector, leave)
        yield marginal, words


def label_texts(texts: list[bytes], model):
    """(language, score) of some texts."""
    languages = model[0]
    if not languages:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    share, count, ascii_letter = np.zeros((len(texts), len(languages))), np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
    if len(texts) == 1 and len(texts[0]) > STEP_BYTES:
        found = label_parts(texts[0], model)
    else:
        words = Words(texts, _NO_LETTER)
        found = [(forward_backward(Features(words, model[3]).scores(model[1]), words.first, model[2])[0], words)]
    for marginal, words in found:
        for k in range(share.shape[1]):
            share[:, k] += np.bincount(words.doc, marginal[:, k], len(texts))
        count += words.count
        ascii_letter |= np.bincount(words.doc, words.data[words.start] < 0x80, len(texts)) > 0
    share /= np.maximum(count, 1)[:, None]
    best = share.argmax(1)
    sure = [bool(count[i]) and (bool(ascii_letter[i]) or has_letter(t)) for i, t in enumerate(texts)]
    return [languages[b] if ok else UNKNOWN for b, ok in zip(best, sure)], [float(min(share[i, b], 1.0)) if ok else 0.0 for i, (b, ok) in enumerate(zip(best, sure))]


def spans_of(text: bytes, model) -> list[tuple[int, int, str]]:
    """(start, end, language) of each run of words of one language; offsets are code points, ends exclusive."""
    languages, out = model[0], []
    if not languages:
        return out
    before = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    end = len(text)
    for marginal, words in label_parts(text, model):
        shift = end - (len(words.data) - 1)  # a blank ends the window's data
        end = shift
        label = marginal.argmax(1)
        edge = np.flatnonzero(np.diff(label)) + 1
        runs = zip(np.concatenate(([0], edge)), np.concatenate((edge, [len(label)]))) if len(label) else ()
        out += [(int(before[words.start[a] + shift]), int(before[words.end[b - 1] + shift]), languages[label[a]]) for a, b in reversed(list(runs))]
    merged: list[tuple[int, int, str]] = []
    for a, b, lang in reversed(out):
        if merged and merged[-1][2] == lang:
            a = merged.pop()[0]
        merged.append((a, b, lang))
    return merged


def _step(languages: list[str]) -> int:
    return max(1 << 14, STEP_BYTES * FEW // max(FEW, len(languages)))


def _predict(model):
    def run(batches):
        for batch, texts in slices(batches, step=_step(model.value[0])):
            names, score = label_texts(texts, model.value)
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["text"]).columns, pa.array(names, pa.string()), pa.array(score, pa.float64())], names=[*batch.drop_columns(["text"]).schema.names, "lang_pred", "score"])

    return run


def fit(docs: DataFrame):
    """The model (languages, weights, transitions, lexicon), broadcast: its size is bounded by TABLE_BITS,
    MOST_LANGUAGES and the sample."""
    sample = labelled_sample(docs)
    return docs.sparkSession.sparkContext.broadcast((list(sample), *train(list(sample.values()))))


def language_id(docs: DataFrame, train_on: Column | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs`` (doc_id, text, lang); rows where
    ``train_on`` is false are held out of training."""
    store.prepare(docs.sparkSession)
    held = fold(F.col("doc_id"), 4) == 2 if train_on is None else ~train_on
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), held.alias("held_out"))
    model = fit(docs.where(~F.col("held_out")))
    return docs.select("doc_id", "held_out", "text").mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")


def language_spans(docs: DataFrame, train_on: Column | None = None) -> DataFrame:
    """doc_id, spans for each row of ``docs`` (doc_id, text, lang): the runs of words of one language."""
    store.prepare(docs.sparkSession)
    teach = fold(F.col("doc_id"), 4) != 2 if train_on is None else train_on
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), teach.alias("teach"))
    model = fit(docs.where("teach"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches):
        for batch, texts in slices(batches):
            spans = [[dict(zip(("start", "end", "lang"), x)) for x in spans_of(t, model.value)] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, spans array<struct<start:int,end:int,lang:string>>")


def keep_known(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose language is known with a score of at least ``least``, all columns kept,
    whatever their names; null and empty texts go; repeated rows each stay or go."""
    store.prepare(docs.sparkSession)
    model = fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(fold(F.col("doc_id"), 4) != 2))

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        out = []
        table = pa.RecordBatch.from_arrays([pa.array(texts, pa.string(), from_pandas=True)], names=["text"])
        for _, part in slices([table], step=_step(model.value[0])):
            names, score = label_texts(part, model.value)
            out += [n != UNKNOWN and s >= least for n, s in zip(names, score)]
        return pd.Series(out, dtype=bool)

    return docs.where(known(F.col("text").cast("string")))
