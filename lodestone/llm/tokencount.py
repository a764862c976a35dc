"""Token counts by dynamic programming over a trie of pre-tokens.

The distinct pre-tokens of a batch are sorted, so that neighbours show where a
prefix is new: those are the trie's nodes. Level by level, every node gets the
forward score of its prefix once, from the nodes at which a last piece can
begin; the score of a prefix that many pre-tokens share is computed once. A
node's token count is that of its best beginning plus one, and terminals keep
theirs. For a unigram model the best sum of scores wins. The vocabulary at hand
is merge-based, and best sums of its scores, which are merge ranks, aren't its
encoding; there a last piece is admitted if it can stand beside the last piece
of its beginning, which leaves one, and the counts are those of the tokenizer.
A pre-token of more than ``DEEPEST`` bytes is a path of its own: the same scores,
position by position, in stretches, so that one of a megabyte doesn't make a
level of the trie for each of its bytes.

Defined results: null and empty texts have no tokens; characters without a
piece count as their bytes; repeated rows are counted each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm import kernel as K
from lodestone.llm.pieces import MODEL, SPACE, Vocabulary, pretokens
from lodestone.llm.sentencepiece import _Known

#: Pre-tokens whose counts a worker remembers; bytes of those that are in the trie, and of a longer one that are handled at once.
REMEMBERED, DEEPEST, STRETCH = 1_000_000, 256, 1 << 16


class Trie:
    """Forward scores of all prefixes of some words (bytes and offsets)."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, vocabulary: Vocabulary, known: _Known):
        n = len(offs) - 1
        size = np.diff(offs)
        width = int(size.max(initial=1))
        head = min(width, 64)
        padded = np.concatenate((data, np.zeros(width + head, np.uint8)))
        # words in order of their bytes; longer ones are told apart beyond the first 64
        table = np.lib.stride_tricks.sliding_window_view(padded, head)[offs[:-1]].copy()
        table[np.arange(head) >= size[:, None]] = 0
        order = np.argsort(table.reshape(-1).view(f"S{head}"), kind="stable")
        if width > head:
            raw = data.tobytes()
            order = np.array(sorted(range(n), key=lambda i: raw[offs[i] : offs[i + 1]]))
        self.first, self.size = offs[:-1][order], size[order]
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        self.place = back
        common = np.zeros(n, np.int64)  # shared with the word before
        live = np.arange(1, n)
        for d in range(width):
            live = live[(self.size[live] > d) & (self.size[live - 1] > d)]
            live = live[padded[self.first[live] + d] == padded[self.first[live - 1] + d]]
            if not len(live):
                break
            common[live] += 1
        value = K._BYTE[data] * K._power(K._BASE, len(data))
        self.total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value)))
        self.inverse = K._power(K._BASE_INVERSE, len(data) + 1)
        hashes, pieces = vocabulary.hashes
        longest = vocabulary.longest
        # nodes of the last levels, by word: last piece, score and count of each prefix
        last = np.full((longest + 1, n), -1, np.int64)
        best, count = np.zeros((longest + 1, n)), np.zeros((longest + 1, n), np.int64)
        alone = np.zeros((longest + 1, n), bool)  # the first piece is a space mark alone
        space = vocabulary.pieces.index(SPACE)
        self.count, self.score, self.alone = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, bool)
        self.nodes, word = 0, np.arange(n)
        for d in range(1, width + 1):
            word = word[self.size[word] >= d]
            new = common[word] < d
            node = word[new]
            self.nodes += len(node)
            at = d % (longest + 1)
            best_, last_, count_ = np.full(len(node), -np.inf), np.full(len(node), -1, np.int64), np.zeros(len(node), np.int64)
            alone_ = np.zeros(len(node), bool)
            b = self.first[node] + d
            for length in range(1, min(d, longest) + 1):
                a = b - length
                h = K.mix((self.total[b] - self.total[a]) * self.inverse[a] + K.U64(length * 0xA0761D6478BD642F % 2**64))
                i = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                hit = np.flatnonzero(hashes[i] == h)
                if not len(hit):
                    continue
                piece, w = pieces[i[hit]], node[hit]
                if d > length:
                    row = (d - length) % (longest + 1)
                    before = last[row, w]
                    ok = before >= 0
                    ok[ok] = known(before[ok], piece[ok])
                    total, tokens, bare = best[row, w] + vocabulary.scores[piece], count[row, w] + 1, alone[row, w]
                else:
                    ok, total, tokens, bare = np.ones(len(hit), bool), vocabulary.scores[piece], np.ones(len(hit), np.int64), piece == space
                ok &= (total > best_[hit]) | (vocabulary.kind == "bpe")
                j = hit[ok]
                best_[j], last_[j], count_[j], alone_[j] = total[ok], piece[ok], tokens[ok], bare[ok]
            of = np.cumsum(new) - 1  # a shared prefix is the node of the word that has it first
            last[at, word], best[at, word], count[at, word], alone[at, word] = last_[of], best_[of], count_[of], alone_[of]
            done = word[self.size[word] == d]
            self.count[done], self.score[done], self.alone[done] = count[at, done], best[at, done], alone[at, done]

    def terminals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token count, forward score and whether a space mark stands alone, of each word in the order given."""
        return self.count[self.place], self.score[self.place], self.alone[self.place]


def path(word: np.ndarray, vocabulary: Vocabulary, known: _Known) -> tuple[int, float, bool]:
    """Token count, forward score and whether a space mark stands alone, of one long pre-token (bytes)."""
    hashes, pieces = vocabulary.hashes
    longest, bpe = vocabulary.longest, vocabulary.kind == "bpe"
    scores, space = vocabulary.scores.tolist(), vocabulary.pieces.index(SPACE)
    beside: dict[tuple[int, int], bool] = {}

    def admitted(a: int, b: int) -> bool:
        if (a, b) not in beside:
            beside[a, b] = not bpe or bool(known(np.array([a]), np.array([b]))[0])
        return beside[a, b]

    # last piece, score, count and whether the first piece is the mark alone, of the last prefixes; the empty one first
    state: list[tuple[int, float, int, bool] | None] = [(-1, 0.0, 0, False)]
    for a in range(0, len(word), STRETCH):
        beside.clear()
        low = max(0, a - longest)
        part = word[low : a + STRETCH]
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(K._BYTE[part] * K._power(K._BASE, len(part)))))
        inverse = K._power(K._BASE_INVERSE, len(part) + 1)
        ends, sizes, found = [], [], []
        for length in range(1, min(longest, len(part)) + 1):
            b = np.arange(max(a - low + 1, length), len(part) + 1)
            h = K.mix((total[b] - total[b - length]) * inverse[b - length] + K.U64(length * 0xA0761D6478BD642F % 2**64))
            i = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = np.flatnonzero(hashes[i] == h)
            ends.append(b[hit])
            sizes.append(np.full(len(hit), length))
            found.append(pieces[i[hit]])
        end, size, piece = (np.concatenate(x) for x in (ends, sizes, found))
        order = np.lexsort((size, end))
        end, size, piece = end[order], size[order], piece[order]
        at = np.searchsorted(end, np.arange(a - low + 1, len(part) + 2))
        if bpe:  # which pieces of this stretch can follow which, asked once
            before = end - size - (a - low + 1)
            inside = np.flatnonzero(before >= 0)
            n = np.diff(at)[before[inside]]
            code = np.unique(piece[K.ranges(at[before[inside]], n)] * len(scores) + np.repeat(piece[inside], n))
            beside.update(zip(zip((code // len(scores)).tolist(), (code % len(scores)).tolist(), strict=True), known(code // len(scores), code % len(scores)).tolist(), strict=True))
        first = at.tolist()
        size, piece = size.tolist(), piece.tolist()
        kept = len(state) - 1  # the prefix that ends where this stretch begins
        for k in range(len(first) - 1):
            best: tuple[int, float, int, bool] | None = None
            for e in range(first[k], first[k + 1]):
                before = state[kept + 1 + k - size[e]]
                if before is None or (before[0] >= 0 and not admitted(before[0], piece[e])):
                    continue
                score = before[1] + scores[piece[e]]
                if bpe or best is None or score > best[1]:
                    best = (piece[e], score, before[2] + 1, before[3] if before[2] else piece[e] == space)
            state.append(best)
        state = state[-longest - 1 :]
    end_ = state[-1] or (-1, -np.inf, 0, False)
    return end_[2], end_[1], end_[3]


def terminals(data: np.ndarray, offs: np.ndarray, vocabulary: Vocabulary, known: _Known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :meth:`Trie.terminals`, of words of any length."""
    size = np.diff(offs)
    short, long = np.flatnonzero(size <= DEEPEST), np.flatnonzero(size > DEEPEST)
    count, score, alone = np.zeros(len(size), np.int64), np.zeros(len(size)), np.zeros(len(size), bool)
    if len(short):
        count[short], score[short], alone[short] = Trie(data[K.ranges(offs[short], size[short])], np.append(0, np.cumsum(size[short])), vocabulary, known).terminals()
    for w in long.tolist():
        count[w], score[w], alone[w] = path(data[offs[w] : offs[w + 1]], vocabulary, known)
    return count, score, alone


class Counter:
    def __init__(self, vocabulary: Vocabulary, remembered: int = REMEMBERED):
        self.v, self.known, self.remembered = vocabulary, _Known(vocabulary), remembered
        self.forget()

    def forget(self) -> None:
        self.keys, self.count, self.score, self.lone = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool)

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pre-tokens, tokens and forward score of the words of each text."""
        rows = len(offs) - 1
        units = pretokens(data, offs, self.v)
        word = np.flatnonzero(units.kind == 0)
        count, score, lone = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool)
        if len(word):
            keys, example, inverse = units.distinct()
            if len(self.keys) + len(keys) > self.remembered:
                self.forget()
            at = np.searchsorted(self.keys, keys)
            hit = at < len(self.keys)
            hit[hit] = self.keys[at[hit]] == keys[hit]
            if not hit.all():
                spelt, o = units.spell(example[~hit])
                c, s, alone = terminals(spelt, o, self.v, self.known)
                every = np.concatenate((self.keys, keys[~hit]))
                order = np.argsort(every, kind="stable")
                self.keys = every[order]
                self.count, self.score, self.lone = (np.concatenate(x)[order] for x in ((self.count, c), (self.score, s), (self.lone, alone)))
                at = np.searchsorted(self.keys, keys)
            count, score, lone = self.count[at][inverse], self.score[at][inverse], self.lone[at][inverse]
        tokens = np.ones(len(units.kind), np.int64)
        tokens[word] = count
        runs = np.where(units.kind == 1, units.count, 0)
        maybe = np.zeros(len(units.kind), bool)
        maybe[1:] = (units.kind[:-1] == 1) & (units.row[1:] == units.row[:-1])
        # a space that joins no piece counts with the run of spaces before it
        check = np.flatnonzero(lone & maybe[word])
        runs[word[check] - 1] += 1
        tokens[word[check]] -= 1
        run = np.flatnonzero(units.kind == 1)
        size = {n: len(self.v.spaces(n)) for n in np.unique(runs[run]).tolist()}
        tokens[run] = [size[n] for n in runs[run].tolist()]
        of = np.zeros(rows + 1)
        np.add.at(of, units.row[word], score)
        return np.bincount(units.row, minlength=rows), np.bincount(units.row, tokens, rows).astype(np.int64), of[:rows]


_counters: dict[int, Counter] = {}


def worker_counter(vocabulary: Vocabulary) -> Counter:
    key = hash((tuple(vocabulary.pieces), vocabulary.scores.tobytes(), vocabulary.kind))
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(vocabulary)
    return _counters[key]


def count(docs: DataFrame, vocabulary: Vocabulary | str = MODEL) -> DataFrame:
    """(doc_id, n_bytes, n_pretokens, n_tokens, forward_score) of every whole text."""
    v = Vocabulary.load(vocabulary) if isinstance(vocabulary, str) else vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_counter(v)
        for part in K.slices(batches, "text"):
            data, offs = K.texts(part.column("text"))
            pre, tokens, score = counter(data, offs)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x) for x in (np.diff(offs), pre, tokens, score))], ["doc_id", "n_bytes", "n_pretokens", "n_tokens", "forward_score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_pretokens long, n_tokens long, forward_score double")
