"""SentencePiece encoding and decoding by suffix-array matching.

The distinct pre-tokens of a batch are concatenated and their suffixes sorted;
a binary search of every piece gives the range of its occurrences. The edges
found are sorted by where they end and relaxed position by position, for all
pre-tokens at once. For a merge-based (BPE) model, an edge relaxes its end if
its piece can stand beside the last piece of its start (one edge does, as a
prefix has one encoding); for a unigram model, the best sum of scores wins.
Words seen before are kept in a table of bounded size.

Defined results: null and empty texts have no tokens; characters without a
piece become their bytes, so that decoding gives back every text (the space
mark U+2581 as a space); ids outside of the vocabulary raise IndexError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm import kernel as K
from lodestone.llm.pieces import MODEL, SPACE, Pretokens, Vocabulary, pretokens

#: Text bytes handled at once, words that a worker remembers.
SLICE = 1 << 20
REMEMBERED = 400_000


def match(data: np.ndarray, offs: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every occurrence of a piece in the words: start, end, piece."""
    width = vocabulary.longest
    n = len(data)
    # words are kept apart by a zero byte, which no piece has
    at = np.arange(n) + np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    text = np.zeros(n + len(offs) + width, np.uint8)
    text[at] = data
    suffix = np.lib.stride_tricks.sliding_window_view(text, width)[at]
    suffix = suffix.reshape(-1).view(f"S{width}")
    order = np.argsort(suffix, kind="stable")
    suffix = suffix[order]
    raw = np.array([b for b, _ in vocabulary.words], f"S{width + 1}")
    low = np.searchsorted(suffix, raw)
    high = np.searchsorted(suffix, np.array([b + b"\xff" for b, _ in vocabulary.words], f"S{width + 1}"))
    count = high - low
    start = order[K.ranges(low, count)]
    size = np.repeat([len(b) for b, _ in vocabulary.words], count)
    return start, start + size, np.repeat([i for _, i in vocabulary.words], count)


class _Known:
    """Which pairs of pieces can be adjacent, as far as asked."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.code, self.ok = vocabulary, np.zeros(0, np.int64), np.zeros(0, bool)

    def __call__(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        if self.v.kind != "bpe":
            return np.ones(len(first), bool)
        n = len(self.v.pieces)
        code = first * n + second
        at = np.searchsorted(self.code, code)
        hit = at < len(self.code)
        hit[hit] = self.code[at[hit]] == code[hit]
        if not hit.all():
            new = np.unique(code[~hit])
            ok = self.v.adjacent(new // n, new % n)
            order = np.argsort(np.concatenate((self.code, new)), kind="stable")
            self.code, self.ok = np.concatenate((self.code, new))[order], np.concatenate((self.ok, ok))[order]
            at = np.searchsorted(self.code, code)
        return self.ok[at]


def relax(start: np.ndarray, end: np.ndarray, piece: np.ndarray, offs: np.ndarray, vocabulary: Vocabulary, known: _Known) -> tuple[np.ndarray, np.ndarray]:
    """Best last piece and score of each position (the end of a prefix of its word)."""
    n = int(offs[-1])
    word = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    base = offs[word[start]]
    depth = end - base
    order = np.lexsort((start - end, depth))
    start, end, piece, depth, base = start[order], end[order], piece[order], depth[order], base[order]
    last, best = np.full(n + 1, -1), np.full(n + 1, -np.inf)
    score = vocabulary.scores[piece]
    edge = np.searchsorted(depth, np.arange(1, int(depth[-1]) + 2)) if len(depth) else np.zeros(1, np.int64)
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        if a == b:
            continue
        s, e, p, z = start[a:b], end[a:b], piece[a:b], base[a:b]
        root = s == z
        # the state of a position is kept at the byte before it
        before = np.where(root, -1, last[s - 1])
        ok = root | (before >= 0)
        ok[ok & ~root] = known(before[ok & ~root], p[ok & ~root])
        total = np.where(root, 0, best[s - 1]) + score[a:b]
        s, e, p, total = s[ok], e[ok], p[ok], total[ok]
        if vocabulary.kind == "bpe":
            last[e - 1], best[e - 1] = p, total
        else:
            by = np.lexsort((total, e))
            e, p, total = e[by], p[by], total[by]
            top = np.append(e[1:] != e[:-1], True)
            last[e[top] - 1], best[e[top] - 1] = p[top], total[top]
    return last[:n], best[:n]


class Encoder:
    def __init__(self, vocabulary: Vocabulary, remembered: int = REMEMBERED):
        self.v, self.known, self.remembered = vocabulary, _Known(vocabulary), remembered
        self.size = np.array([len(p.encode()) for p in vocabulary.pieces])
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.count, self.tokens = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def words(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each word, and their number."""
        last, _ = relax(*match(data, offs, self.v), offs, self.v, self.known)
        at, live, found = offs[1:].copy(), np.arange(len(offs) - 1), []
        while len(live):
            p = last[at[live] - 1]
            found.append((live, p))
            at[live] -= self.size[p]
            live = live[at[live] > offs[:-1][live]]
        count = np.zeros(len(offs) - 1, np.int64)
        for live, _ in found:
            count[live] += 1
        first = np.concatenate(([0], np.cumsum(count)))
        out = np.empty(int(first[-1]), np.int32)
        for t, (live, p) in enumerate(found):
            out[first[live + 1] - 1 - t] = p
        return out, count

    def lookup(self, units: Pretokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word of the batch: where its tokens begin in ``self.tokens``, their number."""
        keys, example, inverse = units.distinct()
        if len(self.keys) + len(keys) > self.remembered:
            self.forget()
        at = np.searchsorted(self.keys, keys)
        hit = at < len(self.keys)
        hit[hit] = self.keys[at[hit]] == keys[hit]
        if not hit.all():
            tokens, count = self.words(*units.spell(example[~hit]))
            begin = len(self.tokens) + np.cumsum(count) - count
            self.tokens = np.concatenate((self.tokens, tokens))
            every = np.concatenate((self.keys, keys[~hit]))
            order = np.argsort(every, kind="stable")
            self.keys, self.at, self.count = every[order], np.concatenate((self.at, begin))[order], np.concatenate((self.count, count))[order]
            at = np.searchsorted(self.keys, keys)
        return self.at[at][inverse], self.count[at][inverse], inverse

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the texts, and offsets."""
        units = pretokens(data, offs, self.v)
        rows = len(offs) - 1
        word = np.flatnonzero(units.kind == 0)
        begin, count, _ = self.lookup(units) if len(word) else (np.zeros(0, np.int64), np.zeros(0, np.int64), None)
        space = self.v.pieces.index(SPACE)
        # a space that joins no word is one more of the run before it
        lone = units.spaced[word].copy()
        lone[lone] = self.tokens[begin[lone]] == space
        runs = units.count.copy()
        runs[units.kind != 1] = 0
        follows = np.zeros(len(units.kind), bool)
        follows[1:] = (units.kind[:-1] == 1) & (units.row[1:] == units.row[:-1])
        joined = lone & follows[word]
        runs[word[joined] - 1] += 1
        begin, count = begin + joined, count - joined
        length = np.ones(len(units.kind), np.int64)
        length[word] = count
        run = np.flatnonzero(units.kind == 1)
        coded = {n: self.v.spaces(n) for n in np.unique(runs[run]).tolist()}
        length[run] = [len(coded[n]) for n in runs[run].tolist()]
        first = np.concatenate(([0], np.cumsum(length)))
        out = np.empty(int(first[-1]), np.int32)
        out[K.ranges(first[word], count)] = self.tokens[K.ranges(begin, count)]
        raw = np.flatnonzero(units.kind == 2)
        out[first[raw]] = self.v.byte_ids[units.data[units.start[raw]]]
        for u in run.tolist():
            out[first[u] : first[u + 1]] = coded[int(runs[u])]
        return out, first[np.searchsorted(units.row, np.arange(rows + 1))]


_encoders: dict[int, Encoder] = {}


def worker_encoder(vocabulary: Vocabulary) -> Encoder:
    """The encoder of this worker process: later tasks find the words of earlier ones."""
    key = hash((tuple(vocabulary.pieces), vocabulary.scores.tobytes(), vocabulary.kind))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        raw = [p.replace(SPACE, " ").encode() for p in vocabulary.pieces]
        for b, i in enumerate(vocabulary.byte_ids.tolist()):
            raw[i] = bytes([b])
        self.size = np.array([len(x) for x in raw])
        self.first = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(raw), np.uint8)

    def __call__(self, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts, and offsets; the dummy prefix is gone."""
        size = self.size[ids]
        ends = np.concatenate(([0], np.cumsum(size)))
        data = self.data[K.ranges(self.first[ids], size)]
        at = ends[offs]
        some = np.diff(at) > 0
        drop = at[:-1][some]
        keep = np.ones(len(data), bool)
        keep[drop[data[drop] == 0x20]] = False
        return data[keep], np.concatenate(([0], np.cumsum(keep)))[at]


def encode(docs: DataFrame, vocabulary: Vocabulary | str = MODEL, decode: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): token ids of every whole text and, from them, the text again."""
    K.small_batches(docs.sparkSession)
    v = Vocabulary.load(vocabulary) if isinstance(vocabulary, str) else vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = worker_encoder(v), Decoder(v)
        for part in K.slices(batches, "text", SLICE):
            ids, offs = encoder(*K.texts(part.column("text")))
            cols = [part.column("doc_id"), pa.array(np.diff(offs)), pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids))]
            if decode:
                data, at = decoder(ids, offs)
                cols.append(pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids", "decoded"][: len(cols)])
            del cols, ids, offs
            K.tidy()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids array<int>" + ", decoded string" * decode)
