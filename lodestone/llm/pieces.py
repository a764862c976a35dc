"""Piece vocabularies and their pre-tokens.

Under a piece model with a dummy prefix and escaped spaces, no piece crosses
from a non-space to a space, and none contains a character that isn't itself a
piece. So a text falls apart into pre-tokens, which can be encoded on their own:
runs of known characters, with the space before them if there is one;
characters without a piece, which become their bytes; and longer runs of
spaces. All functions work on a batch of texts as bytes.

Defined results: null and empty texts have no units; a text of spaces is one run
(with the dummy prefix); the space mark itself reads as a space; a word of any
length is one unit.
"""

from __future__ import annotations

import functools
import heapq
from dataclasses import dataclass

import numpy as np

from lodestone.llm import kernel as K

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_MARK = SPACE.encode()


@dataclass
class Vocabulary:
    """Pieces with their scores; picklable, so that only the driver needs the file."""

    pieces: list[str]
    scores: np.ndarray
    byte_ids: np.ndarray
    kind: str = "bpe"

    @classmethod
    def load(cls, path: str = MODEL, kind: str = "bpe") -> Vocabulary:
        """kind: "bpe" (pieces are merged by score) or "unigram" (the best sum of scores)."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.vocab_size()
        byte_ids = np.array([m.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        skip = {i for i in range(n) if m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)}
        return cls(["" if i in skip else m.id_to_piece(i) for i in range(n)], np.array([m.get_score(i) for i in range(n)]), byte_ids, kind)

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("pieces", "scores", "byte_ids", "kind")}

    @functools.cached_property
    def known(self) -> np.ndarray:
        """Code points that are a piece, sorted."""
        return np.sort(np.array([ord(p) for p in self.pieces if len(p) == 1 and p != SPACE]))

    @functools.cached_property
    def words(self) -> list[tuple[bytes, int]]:
        """Pieces other than runs of spaces, as bytes, sorted."""
        return sorted((p.encode(), i) for i, p in enumerate(self.pieces) if p and (p == SPACE or p.strip(SPACE)))

    @functools.cached_property
    def longest(self) -> int:
        return max(len(b) for b, _ in self.words)

    @functools.cached_property
    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted span hashes of the pieces, and the pieces."""
        raw = [b for b, _ in self.words]
        end = np.cumsum([len(b) for b in raw])
        h = K.span_hashes(np.frombuffer(b"".join(raw), np.uint8), end - [len(b) for b in raw], end, lower=False)
        order = np.argsort(h)
        return h[order], np.array([i for _, i in self.words])[order]

    # merge order: single characters first, then pieces by falling score
    @functools.cached_property
    def _ranked(self) -> tuple[np.ndarray, np.ndarray]:
        single = [i for _, i in self.words if len(self.pieces[i]) == 1]
        longer = sorted((i for _, i in self.words if len(self.pieces[i]) > 1), key=lambda i: -self.scores[i])
        ids = np.array(single + longer)
        rank = np.full(len(self.pieces), -1)
        rank[ids] = np.arange(len(ids))
        return ids, rank

    @functools.cached_property
    def _merges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each rank the parts that merge to it; sorted codes of those pairs and what they make."""
        ids, _ = self._ranked
        of = {self.pieces[i]: r for r, i in enumerate(ids.tolist())}
        left, right = np.arange(len(ids)), np.arange(len(ids))
        for r, i in enumerate(ids.tolist()):
            if len(self.pieces[i]) > 1 and len(parts := self._merge(self.pieces[i], of, r)) == 2:
                left[r], right[r] = parts
        made = np.flatnonzero(left != np.arange(len(ids)))
        code = left[made] * len(ids) + right[made]
        order = np.argsort(code)
        return left, right, code[order], made[order]

    @staticmethod
    def _merge(text: str, of: dict[str, int], below: int) -> list[int]:
        """Ranks left after all merges to ranks below the given one."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((of.get(a + b, below), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(below, 0))
            if best[0] >= below:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [of[p] for p in parts]

    def adjacent(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether two pieces (ids) can stand side by side in an encoding: no merge
        across their border comes before the merges that made them."""
        if self.kind != "bpe":
            return np.ones(len(first), bool)
        _, rank = self._ranked
        n = len(self._ranked[0])
        left, right, codes, made = self._merges
        a, b = rank[first], rank[second]
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), n + 1)
        while len(live):
            x, y = a[live], b[live]
            code = x * n + y
            at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            bad = (codes[at] == code) & (made[at] < limit[live])
            ok[live[bad]] = False
            live, x, y = live[~bad], x[~bad], y[~bad]
            # undo the later merge of the two; a character can't be undone, then the other's turn
            x2, y2 = right[x], left[y]
            first_ = np.where(x > y, x2 != x, y2 == y)
            stuck = (x2 == x) & (y2 == y)
            undo_left = first_ & ~stuck
            limit[live] = np.where(undo_left, x, y + 1)
            a[live] = np.where(undo_left, x2, x)
            b[live] = np.where(undo_left | stuck, y, y2)
            live = live[~stuck]
        return ok

    def spaces(self, n: int) -> tuple[int, ...]:
        """Encoding of a run of n spaces."""
        return _spaces(tuple((i, len(p), float(self.scores[i])) for i, p in enumerate(self.pieces) if p and not p.strip(SPACE)), n)


@functools.lru_cache(4096)
def _spaces(pieces: tuple, n: int) -> tuple[int, ...]:
    """Merges of the highest score first, of equal ones the leftmost."""
    of = {size: (i, score) for i, size, score in pieces}
    size, after, before = [1] * n, [*range(1, n), -1], list(range(-1, n - 1))
    heap: list = []

    def offer(k: int) -> None:
        j = after[k]
        if j >= 0 and size[k] + size[j] in of:
            heapq.heappush(heap, (-of[size[k] + size[j]][1], k, j, size[k], size[j]))

    for k in range(n - 1):
        offer(k)
    while heap:
        _, k, j, x, y = heapq.heappop(heap)
        if size[k] != x or size[j] != y or after[k] != j:
            continue
        size[k], size[j] = x + y, 0
        after[k] = after[j]
        if after[k] >= 0:
            before[after[k]] = k
        offer(k)
        if before[k] >= 0:
            offer(before[k])
    return tuple(of[s][0] for s in size if s)


@dataclass
class Pretokens:
    """Units of a batch in order: row of each; kind 0 is a word (text span, with or
    without a space before it), 1 a run of ``count`` spaces, 2 a byte without a piece."""

    row: np.ndarray
    kind: np.ndarray
    start: np.ndarray
    end: np.ndarray
    spaced: np.ndarray
    count: np.ndarray
    data: np.ndarray

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the distinct words, an example of each, and of each word its key's index."""
        w = np.flatnonzero(self.kind == 0)
        h = K.span_hashes(self.data, self.start[w], self.end[w], lower=False) * K.U64(2) + self.spaced[w].astype(np.uint64)
        keys, example, inverse = np.unique(h, return_index=True, return_inverse=True)
        return keys, w[example], inverse

    def spell(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' bytes with their space mark, and offsets."""
        size = self.end[units] - self.start[units]
        lead = np.where(self.spaced[units], len(_MARK), 0)
        offs = np.concatenate(([0], np.cumsum(size + lead)))
        out = np.empty(int(offs[-1]), np.uint8)
        out[K.ranges(offs[:-1] + lead, size)] = self.data[K.ranges(self.start[units], size)]
        for t, b in enumerate(_MARK):
            out[offs[:-1][lead > 0] + t] = b
        return out, offs


def pretokens(data: np.ndarray, offs: np.ndarray, vocabulary: Vocabulary) -> Pretokens:
    """Units of the texts; an empty text has none."""
    rows = len(offs) - 1
    mark = np.flatnonzero((data[:-2] == _MARK[0]) & (data[1:-1] == _MARK[1]) & (data[2:] == _MARK[2])) if len(data) > 2 else []
    if len(mark):  # the mark itself reads as a space
        keep = np.ones(len(data), bool)
        keep[mark + 1] = keep[mark + 2] = False
        data = data.copy()
        data[mark] = 0x20
        offs = np.concatenate(([0], np.cumsum(keep)))[offs]
        data = data[keep]
    n = len(data)
    # 0 space, 1 known character, 2 unknown
    cls = np.full(n, 2, np.int8)
    known = vocabulary.known
    ascii_ = np.zeros(256, np.int8)
    ascii_[:] = 2
    ascii_[known[known < 128]] = 1
    ascii_[0x20] = 0
    low = data < 0x80
    cls[low] = ascii_[data[low]]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        b = data[lead].astype(np.int64)
        size = np.where(b >= 0xF0, 4, np.where(b >= 0xE0, 3, 2))
        cp = np.where(size == 4, b & 7, np.where(size == 3, b & 15, b & 31))
        padded = np.concatenate((data, np.zeros(4, np.uint8))).astype(np.int64)
        for t in range(1, 4):
            cp = np.where(size > t, cp << 6 | padded[np.minimum(lead + t, n)] & 0x3F, cp)
        c = np.where(known[np.minimum(np.searchsorted(known, cp), len(known) - 1)] == cp, 1, 2).astype(np.int8)
        at = K.ranges(lead, np.minimum(size, n - lead))
        cls[at] = np.repeat(c, np.minimum(size, n - lead))
    row = np.repeat(np.arange(rows), np.diff(offs))
    if not n:
        e = np.zeros(0, np.int64)
        return Pretokens(e, e.astype(np.int8), e, e, e.astype(bool), e, data)
    cut = np.ones(n, bool)
    cut[1:] = (cls[1:] != cls[:-1]) | (row[1:] != row[:-1]) | (cls[1:] == 2)
    start = np.flatnonzero(cut)
    end = np.append(start[1:], n)
    kind, of = cls[start], row[start]
    first = np.concatenate(([True], of[1:] != of[:-1]))
    spaces = kind == 0
    before = np.concatenate(([False], spaces[:-1])) & ~first
    # a word takes one space; the dummy prefix is one more at the beginning
    spaced = (kind == 1) & (before | first)
    after = np.concatenate((spaced[1:] & ~first[1:], [False]))
    count = np.where(spaces, end - start + first - after, 0)
    # a dummy prefix before an unknown byte stands alone
    alone = first & (kind == 2)
    place = np.arange(len(start)) + np.cumsum(alone)
    size = len(start) + int(alone.sum())
    out = Pretokens(np.zeros(size, np.int64), np.ones(size, np.int8), np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, bool), np.ones(size, np.int64), data)
    out.row[place], out.kind[place], out.start[place], out.end[place], out.spaced[place], out.count[place] = of, np.array([1, 0, 2], np.int8)[kind], start, end, spaced, count
    out.row[place[alone] - 1] = of[alone]
    keep = (out.kind != 1) | (out.count > 0)
    for name in ("row", "kind", "start", "end", "spaced", "count"):
        setattr(out, name, getattr(out, name)[keep])
    return out
