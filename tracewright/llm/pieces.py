"""SentencePiece encoding and decoding by suffix-array matching.

The text of a batch is cut where no piece can cross (before a blank that follows something else); its
distinct segments are concatenated and indexed by a suffix array over as many characters as the longest
piece has.  Binary search finds every piece's range of occurrences.  The occurrences are edges between
positions; sorted by position they are relaxed from left to right: each position keeps the one piece
that may end there, an edge being admitted if its piece may follow the piece kept at its start.  Two
pieces may stand side by side if no merge of higher priority would have joined characters across their
border; that makes the path the very segmentation that merging by score gives.  Characters outside the
vocabulary become their UTF-8 bytes.

Memory is bounded whatever the texts: a step takes ``STEP`` bytes of text, an index ``INDEXED``
characters.  A text beyond a step is read in windows.  A segment beyond ``LONG`` characters is relaxed
as a stream: blocks are indexed with the end of their predecessor, and pieces are handed out as soon as
all positions that later edges can start from descend from the same one.

* null or empty text: no pieces, decoded to an empty text; a text is decoded to itself unless it holds
  U+2581, which the model cannot tell from a blank; that is what ``round_trip`` says;
* ``decode``: null or empty ids give an empty text; an id outside the vocabulary gives U+FFFD, as do
  byte pieces that are not UTF-8; control pieces give nothing;
* repeated rows: each is encoded; empty table: no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import codecs
import hashlib
import itertools
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import store
from .text import release, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Bytes of segments that a worker remembers within a task (an entry counts ENTRY and its text and ids),
#: text that one step takes, characters that one suffix array indexes, pairs of pieces that are remembered.
REMEMBERED, ENTRY, STEP, INDEXED, PAIRS = 40 << 20, 136, 1 << 19, 1 << 17, 1 << 16
#: Characters of a sequence that is relaxed with all others at once, bytes of a segment that is no stream.
SHORT, LONG = 48, 1 << 12

_SEGMENT = re.compile(rb" +[^ \n]*|[^ \n]+|\n")
_GOES_ON = {True: re.compile(rb" *[^ \n]*"), False: re.compile(rb"[^ \n]*")}
_NONE = np.int64(1) << 40
_BLANK = BLANK.encode()


class Vocabulary:
    """What matching needs of a model: ``pieces`` is a list of (piece, score, kind); kind is 'text',
    'byte' or 'control'."""

    def __init__(self, pieces: list[tuple[str, float, str]]):
        self.size = len(pieces)
        self.name = hashlib.sha256(repr(pieces).encode()).hexdigest()
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == "byte"}
        self.decoded = [bytes([int(p[3:5], 16)]) if kind == "byte" else p.replace(BLANK, " ").encode() if kind == "text" else b"" for p, _, kind in pieces]
        ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == "text"}
        order = sorted((i for p, i in ids.items() if len(p) > 1), key=lambda i: (-pieces[i][1], i))
        self.rank = np.zeros(self.size, np.int64)
        self.rank[order] = np.arange(1, len(order) + 1)
        self.left, self.right = np.full(self.size, -1, np.int64), np.full(self.size, -1, np.int64)
        own, joins = {p: i for p, i in ids.items() if len(p) == 1}, {}
        for i in order:
            parts = self._merged(pieces[i][0], ids)
            if parts:
                self.left[i], self.right[i] = parts
                own[pieces[i][0]] = i
        for p, i in own.items():
            for k in range(1, len(p)):
                a, b = own.get(p[:k]), own.get(p[k:])
                if a is not None and b is not None:
                    joins[a << 20 | b] = i
        self.join_key = np.array(sorted(joins), np.int64)
        self.join_rank = self.rank[[joins[k] for k in self.join_key.tolist()]]
        self.may_join = np.zeros(1 << 21, bool)
        self.may_join[self._mixed(self.join_key)] = True
        self.longest = max(map(len, own))
        letters = sorted({c for p in own for c in p})
        self.codes = np.zeros(0x110000, np.int32)  # 0: outside the vocabulary
        self.codes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        listed = sorted(own.items())
        self.piece_id = np.array([i for _, i in listed])
        self.piece_length = np.array([len(p) for p, _ in listed])
        self.length = np.zeros(self.size, np.int64)
        self.length[self.piece_id] = self.piece_length
        self.bits = max(1, int(len(letters) + 1).bit_length())
        self.per_key = 62 // self.bits
        self.tops = self._keys(np.full((1, self.longest), (1 << self.bits) - 1, np.int64))
        codes = np.zeros((len(listed), self.longest), np.int64)
        for row, (p, _) in enumerate(listed):
            codes[row, : len(p)] = self.codes[[ord(c) for c in p]]
        high = np.where(np.arange(self.longest) < self.piece_length[:, None], codes, (1 << self.bits) - 1)
        self.low_keys, self.high_keys = self._keys(codes), self._keys(high)
        self._plain()

    def _plain(self) -> None:
        """The tables again, for one pair at a time."""
        self.pairs: dict[int, bool] = {}
        self.one = [array("q", x.tolist()) for x in (self.join_key, self.join_rank, self.rank, self.left, self.right)]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("pairs", "one")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._plain()

    @staticmethod
    def _mixed(key: np.ndarray) -> np.ndarray:
        """A place in ``may_join``, whose False is certain."""
        return ((key >> 20) * 40503 + (key & 0xFFFFF) * 2654435761 >> 4) & ((1 << 21) - 1)

    def _keys(self, codes: np.ndarray) -> list[np.ndarray]:
        """Columns of characters packed into integers that order as the characters do."""
        out = []
        for at in range(0, self.longest, self.per_key):
            key = np.zeros(len(codes), np.int64)
            for k in range(at, at + self.per_key):
                key = key << self.bits
                if k < self.longest:
                    key |= codes[:, k]
            out.append(key)
        return out

    def _merged(self, piece: str, ids: dict[str, int]) -> tuple[int, int] | None:
        """The two pieces whose merge gives ``piece``, if merging by score ends in it."""
        parts = list(piece)
        while len(parts) > 2:
            found = [(self.rank[ids[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ids]
            if not found:
                return None
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return (ids[parts[0]], ids[parts[1]]) if len(parts) == 2 and parts[0] in ids and parts[1] in ids else None

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves the pieces ``a`` and ``b`` side by side.  The later merged of the two is
        undone step by step; a join across the border that would have come before that merge excludes it."""
        a, b = a.copy(), b.copy()
        out = np.zeros(len(a), bool)
        before = np.full(len(a), _NONE)  # a join below this rank (b's own merges lose ties: +1) came first
        todo = np.arange(len(a))
        while len(todo):
            x, y, limit = a[todo], b[todo], before[todo]
            key = x << 20 | y
            joined = self.may_join[self._mixed(key)]
            some = np.flatnonzero(joined)
            if len(some):
                at = np.minimum(np.searchsorted(self.join_key, key[some]), len(self.join_key) - 1)
                joined[some] = (self.join_key[at] == key[some]) & (2 * self.join_rank[at] < limit[some])
            todo, x, y = todo[~joined], x[~joined], y[~joined]
            rank_x, rank_y = self.rank[x], self.rank[y]
            first = (rank_x > rank_y) & (rank_x > 0)
            done = (rank_x == 0) & (rank_y == 0)
            out[todo[done]] = True
            before[todo] = np.where(first, 2 * rank_x, 2 * rank_y + 1)
            a[todo] = np.where(first, self.right[x], x)
            b[todo] = np.where(first, y, np.where(done, y, self.left[y]))
            todo = todo[~done]
        return out

    def _one_may_follow(self, a: int, b: int) -> bool:
        """``may_follow`` of one pair."""
        join_key, join_rank, rank, left, right = self.one
        limit = 1 << 40
        while True:
            key = a << 20 | b
            at = bisect_left(join_key, key)
            if at < len(join_key) and join_key[at] == key and 2 * join_rank[at] < limit:
                return False
            x, y = rank[a], rank[b]
            if not x and not y:
                return True
            if x > y:
                limit, a = 2 * x, right[a]
            else:
                limit, b = 2 * y + 1, left[b]

    def relax(self, kept: list[int], edges: Iterator[tuple[int, int, int, bool]]) -> None:
        """Edges (begin, end, piece, whether a sequence begins there) in the order of their ends: ``kept``
        gets the piece that may end at each position."""
        pairs = self.pairs
        if len(pairs) > PAIRS:
            pairs.clear()
        for b, e, p, first in edges:
            if not first:
                key = kept[b] << 20 | p
                ok = pairs.get(key)
                if ok is None:
                    ok = pairs[key] = self._one_may_follow(kept[b], p)
                if not ok:
                    continue
            kept[e] = p

    def edges(self, code: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, piece) of every occurrence of a piece, none crossing the ``stop`` of its position."""
        n = len(code)
        window = np.zeros((n, self.longest), np.int32)
        reach = stop - np.arange(n)
        for k in range(min(self.longest, n)):
            window[: n - k, k] = np.where(reach[: n - k] > k, code[k:], 0)
        keys = self._keys(window)
        del window
        suffix = np.lexsort(keys[::-1])
        ordered = [k[suffix] for k in keys]
        low, high = self._search(ordered, self.low_keys, False), self._search(ordered, self.high_keys, True)
        many = high - low
        rows = np.repeat(np.arange(len(many)), many)
        begin = suffix[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
        return begin, self.piece_id[rows]

    def encode(self, segments: list[str], kind: type = np.int32) -> list[bytes]:
        """Ids (as bytes of ``kind``) of each segment; a segment is matched on its own."""
        lengths = np.array([len(s) for s in segments])
        chars = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(chars)
        code = self.codes[chars]
        ends = np.cumsum(lengths)
        # sequences: segments, further cut around characters outside the vocabulary
        cut = np.zeros(n + 1, bool)
        cut[np.concatenate(([0], ends))] = True
        strange = np.flatnonzero(code == 0)
        cut[strange] = True
        cut[strange + 1] = True
        starts = np.flatnonzero(cut[:-1])
        stop = np.append(starts[1:], n)[np.cumsum(cut[:-1]) - 1]
        start = starts[np.cumsum(cut[:-1]) - 1]
        begin, piece = self.edges(code, stop)
        end = begin + self.length[piece]
        kept = np.full(n + 1, -1, np.int64)
        # kept[e] of a sequence's end is also a later sequence's start: that one is told to be the first
        long = (stop - start)[begin] > SHORT
        if long.any():
            b, e, p = begin[long], end[long], piece[long]
            order = np.argsort(e, kind="stable")
            plain = kept.tolist()
            self.relax(plain, zip(*(x[order].tolist() for x in (b, e, p, b == start[b]))))
            kept = np.array(plain, np.int64)
            begin, end, piece = begin[~long], end[~long], piece[~long]
        # short sequences: edges by their end within the sequence, all sequences are relaxed at once
        depth = end - start[begin]
        order = np.argsort(depth, kind="stable")
        begin, end, piece = begin[order], end[order], piece[order]
        bounds = np.searchsorted(depth[order], np.arange(1, (int(depth.max()) if len(depth) else 0) + 2))
        for lo, hi in itertools.pairwise(bounds):
            b, e, p = begin[lo:hi], end[lo:hi], piece[lo:hi]
            initial = b == start[b]
            ok = initial.copy()
            rest = np.flatnonzero(~initial)
            ok[rest] = self.may_follow(kept[b[rest]], p[rest])
            kept[e[ok]] = p[ok]
        at = np.full(n, -1, np.int64)
        place = np.unique(stop[code > 0]) if n else np.zeros(0, int)
        floor = start[place - 1]
        while len(place) > 8:
            p = kept[place]
            place = place - self.length[p]
            at[place] = p
            on = place > floor
            place, floor = place[on], floor[on]
        for e, f in zip(place.tolist(), floor.tolist()):
            while e > f:
                p = kept[e]
                e -= int(self.length[p])
                at[e] = p
        ids = at[at >= 0].astype(kind)
        count = np.concatenate(([0], np.cumsum(at >= 0)))
        out = [ids[count[a] : count[b]].tobytes() for a, b in zip(ends - lengths, ends)]
        for i in np.unique(np.searchsorted(ends, strange, "right")):
            a, b = ends[i] - lengths[i], ends[i]
            flat = []
            for k in range(a, b):
                if code[k] == 0:
                    flat += self.byte_ids(int(chars[k]))
                elif at[k] >= 0:
                    flat.append(at[k])
            out[i] = np.array(flat, kind).tobytes()
        return out

    def byte_ids(self, char: int) -> list[int]:
        return [self.bytes[x] for x in chr(char).encode("utf-8", "replace")]

    def _search(self, ordered: list[np.ndarray], keys: list[np.ndarray], after: bool) -> np.ndarray:
        """For each key the number of suffixes below it (or, ``after``, not above it)."""
        first = ordered[0]
        low = np.searchsorted(first, keys[0], "left")
        high = np.searchsorted(first, keys[0], "right")
        # the first column decides, but where suffixes share it and a further one differs
        todo = np.flatnonzero((low < high) & np.any([k != (top[0] if after else 0) for k, top in zip(keys[1:], self.tops[1:])], axis=0)) if len(keys) > 1 else np.zeros(0, int)
        out = high if after else low
        lo, hi = low[todo], high[todo]
        while len(todo):
            mid = (lo + hi) // 2
            below, same = np.zeros(len(todo), bool), np.ones(len(todo), bool)
            for column, key in zip(ordered[1:], keys[1:]):
                x, k = column[mid], key[todo]
                below |= same & (x < k)
                same &= x == k
            go = below | same if after else below
            lo, hi = np.where(go, mid + 1, lo), np.where(go, hi, mid)
            done = lo >= hi
            out[todo[done]] = lo[done]
            todo, lo, hi = todo[~done], lo[~done], hi[~done]
        return out


def load(path: str = MODEL) -> list[tuple[str, float, str]]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: "byte" if model.is_byte(i) else "control" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "text"
    return [(model.id_to_piece(i), model.get_score(i), kind(i)) for i in range(model.get_piece_size())]


class Stream:
    """One segment of any length, fed in parts; pieces come out as soon as nothing can change them."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._restart()

    def _restart(self) -> None:
        # kept[k]: the piece that ends k characters after what was handed out; the last characters' codes
        self.kept, self.tail, self.fresh = [-1], np.zeros(0, np.int32), True

    def feed(self, text: str) -> list[np.ndarray]:
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        code = self.vocabulary.codes[chars]
        out, at = [], 0
        for k in np.flatnonzero(code == 0).tolist():
            out += [*self._extend(code[at:k]), self.end(), np.array(self.vocabulary.byte_ids(int(chars[k])), np.int32)]
            at = k + 1
        return out + self._extend(code[at:])

    def _extend(self, code: np.ndarray) -> list[np.ndarray]:
        return [self._block(code[at : at + INDEXED]) for at in range(0, len(code), INDEXED)]

    def _block(self, code: np.ndarray) -> np.ndarray:
        v, old = self.vocabulary, len(self.tail)
        block = np.concatenate((self.tail, code))
        begin, piece = v.edges(block, np.full(len(block), len(block)))
        end = begin + v.length[piece]
        new = end > old
        begin, end, piece = begin[new], end[new], piece[new]
        order = np.argsort(end, kind="stable")
        shift = len(self.kept) - 1 - old
        begin, end, piece = begin[order] + shift, end[order] + shift, piece[order]
        self.kept += [-1] * len(code)
        v.relax(self.kept, zip(begin.tolist(), end.tolist(), piece.tolist(), ((begin == 0) & self.fresh).tolist()))
        self.tail = block[max(0, len(block) - v.longest + 1) :]
        last = len(self.kept) - 1
        path, common = {last: None}, last
        at = last
        while at:
            at -= int(v.length[self.kept[at]])
            path[at] = None
        for at in range(max(0, last - v.longest + 1), last):
            while at not in path:
                at -= int(v.length[self.kept[at]])
            common = min(common, at)
        return self._handed_out(common)

    def _handed_out(self, to: int) -> np.ndarray:
        ids, at = [], to
        while at:
            ids.append(self.kept[at])
            at -= int(self.vocabulary.length[self.kept[at]])
        self.kept, self.fresh = self.kept[to:], self.fresh and not to
        return np.array(ids[::-1], np.int32)

    def end(self) -> np.ndarray:
        """The rest; what is fed next is another sequence."""
        out = self._handed_out(len(self.kept) - 1)
        self._restart()
        return out


def _text(segment: bytes) -> str:
    return segment.decode("utf-8", "replace").replace(" ", BLANK)


class Encoder:
    """Encodes whole texts, remembering segments up to ``REMEMBERED`` bytes."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.kind = np.uint16 if vocabulary.size <= 1 << 16 else np.int32
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, bytes] = {}
        self.held = 0
        self.vocabulary.pairs.clear()

    def _ids(self, cut: list[list[bytes]]) -> list[np.ndarray]:
        """Ids of each list of segments."""
        wanted = set().union(*cut)
        fresh = list(wanted.difference(self.known))
        long = [s for s in fresh if len(s) > LONG]
        fresh = [s for s in fresh if len(s) <= LONG]
        if self.held > REMEMBERED:
            self.known = {s: self.known[s] for s in wanted.intersection(self.known)}
            self.held = sum(ENTRY + len(s) + len(x) for s, x in self.known.items())
        ends = np.cumsum([len(s) for s in fresh])
        at, kind = 0, self.kind
        while at < len(fresh):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + INDEXED, "right")))
            ids = self.vocabulary.encode([_text(s) for s in fresh[at:to]], kind)
            self.known.update(zip(fresh[at:to], ids))
            self.held += sum(map(len, ids)) + int(ends[to - 1] - (ends[at - 1] if at else 0)) + ENTRY * (to - at)
            at = to
        for s in long:
            stream = Stream(self.vocabulary)
            self.known[s] = b"".join(x.astype(kind).tobytes() for x in (*stream.feed(_text(s)), stream.end()))
        of = self.known.__getitem__
        out = [np.frombuffer(b"".join(map(of, segments)), kind).astype(np.int32) for segments in cut]
        for s in long:
            del self.known[s]
        return out

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        texts = [t.replace(_BLANK, b" ") for t in texts]
        if len(texts) == 1 and len(texts[0]) > STEP:
            return [np.concatenate([np.zeros(0, np.int32), *self._windows(texts[0])])]
        return self._ids([_SEGMENT.findall(b" " + t) if t else [] for t in texts])

    def _windows(self, text: bytes) -> Iterator[np.ndarray]:
        """Ids of a text in windows; a segment that crosses their border waits for its rest."""
        waiting, stream, blanks, decoder = b" ", None, False, None
        for at in range(0, len(text), STEP):
            part = text[at : at + STEP]
            if stream:
                on = _GOES_ON[blanks].match(part)[0]
                yield from stream.feed(decoder.decode(on).replace(" ", BLANK))
                blanks = blanks and not on.strip(b" ")
                part = part[len(on) :]
                if not part:
                    continue
                yield from stream.feed(decoder.decode(b"", True))
                yield stream.end()
                stream = None
            segments = _SEGMENT.findall(waiting + part)
            waiting = segments.pop() if segments and segments[-1] != b"\n" else b""
            yield from self._ids([segments])
            if len(waiting) > LONG:
                stream, blanks, decoder = Stream(self.vocabulary), not waiting.strip(b" "), codecs.getincrementaldecoder("utf-8")("replace")
                yield from stream.feed(decoder.decode(waiting).replace(" ", BLANK))
                waiting = b""
        if stream:
            yield from stream.feed(decoder.decode(b"", True))
            yield stream.end()
        yield from self._ids([[waiting] if waiting else []])

    def decoded(self, ids: np.ndarray) -> Iterator[bytes]:
        """The text of the ids, in parts."""
        of = self.vocabulary.decoded
        known = not len(ids) or (ids.min() >= 0 and ids.max() < len(of))
        for at in range(0, len(ids), STEP):
            part = ids[at : at + STEP].tolist()
            text = b"".join(map(of.__getitem__, part) if known else [of[i] if 0 <= i < len(of) else b"\xef\xbf\xbd" for i in part])
            yield text[1:] if not at and text[:1] == b" " else text

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.decoded(ids))

    def check(self, ids: np.ndarray, text: bytes) -> tuple[str, bool]:
        """SHA-256 of the decoded text, and whether it is ``text``."""
        seen, at, same = hashlib.sha256(), 0, True
        for part in self.decoded(ids):
            seen.update(part)
            same = same and text[at : at + len(part)] == part
            at += len(part)
        return seen.hexdigest(), same and at == len(text)


_encoders: dict[str, Encoder] = {}


def encoder_of(vocabulary: Vocabulary) -> Encoder:
    """This worker's encoder; what it remembers is forgotten at the end of each task."""
    if vocabulary.name not in _encoders:
        _encoders.clear()
        _encoders[vocabulary.name] = Encoder(vocabulary)
    return _encoders[vocabulary.name]


def _encode(model):
    def run(batches):
        encoder = encoder_of(model.value)
        try:
            for batch, texts in slices(batches, step=STEP):
                ids = encoder.encode(texts)
                checked = [encoder.check(x, t) for x, t in zip(ids, texts)]
                offsets = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array(np.diff(offsets).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))),
                        pa.array([sha for sha, _ in checked]),
                        pa.array([same for _, same in checked]),
                    ],
                    names=["doc_id", "n_pieces", "ids", "decoded_sha256", "round_trip"],
                )
        finally:
            encoder.forget()
            release()

    return run


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, ids, decoded_sha256, round_trip for each row of ``docs`` (doc_id, text)."""
    spark = store.prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(Vocabulary(load(model)))
    docs = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    return docs.mapInArrow(_encode(shared), "doc_id long, n_pieces long, ids array<int>, decoded_sha256 string, round_trip boolean")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, text for each row of ``encoded`` (doc_id, ids)."""
    spark = store.prepare(encoded.sparkSession)
    shared = spark.sparkContext.broadcast(Vocabulary(load(model)))

    def run(batches):
        encoder = encoder_of(shared.value)
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                ids = row.column("ids")[0].values
                text = encoder.decode(np.asarray(ids.fill_null(-1)) if ids is not None else np.zeros(0, np.int32))
                yield pa.RecordBatch.from_arrays([row.column("doc_id"), pa.array([text.decode("utf-8", "replace")])], names=["doc_id", "text"])

    return encoded.selectExpr("cast(doc_id as long) as doc_id", "cast(ids as array<int>) as ids").mapInArrow(run, "doc_id long, text string")
