"""Many strings looked for at once in many texts, on their UTF-8 bytes (numpy)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bits of the table by which most places are passed over; bytes that a place is known by.
BITS, WIDTH = 18, 8
#: Places that are looked at together, whatever a text's length.
WINDOW = 1 << 20
_MASK = [U64((1 << 8 * w) - 1) for w in range(WIDTH + 1)]


def _slot(x: np.ndarray) -> np.ndarray:
    return (x * U64(0x9E3779B97F4A7C15)) >> U64(64 - BITS)


def _grams(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number; there are eight more bytes than places."""
    x, n = data.astype(U64), len(data)
    for step in (1, 2, 4):
        n -= step
        x = x[:n] | (x[step : n + step] << U64(8 * step))
    return x


class Strings:
    """An index of distinct strings, none of them empty.

    A string is found by its first bytes (eight, or all of a shorter one); what
    follows is compared in steps of eight bytes, so that nothing is guessed.
    """

    def __init__(self, strings: list[str]) -> None:
        raw = [s.encode() for s in strings]
        self.size = np.array([len(b) for b in raw], np.int64)
        self.data = np.frombuffer(b"".join(b + b"\0" * WIDTH for b in raw), np.uint8)
        self.start = np.cumsum(self.size + WIDTH) - self.size - WIDTH
        self.grams = _grams(self.data) if raw else np.zeros(0, U64)
        width = np.minimum(self.size, WIDTH)
        self.groups = []
        for w in np.unique(width).tolist():
            of = np.flatnonzero(width == w)
            key = self.grams[self.start[of]] & _MASK[w]
            order = np.argsort(key, kind="stable")
            keys, first, count = np.unique(key[order], return_index=True, return_counts=True)
            table = np.zeros(1 << BITS, bool)
            table[_slot(keys)] = True
            self.groups.append((w, table, keys, first, count, of[order]))

    @staticmethod
    def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
        """The batch in parts of about ``most`` bytes of text; a longer text stands alone."""
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to

    def find(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, string) of all texts and strings that they contain, each once; nulls contain nothing."""
        raw = texts.cast(pa.large_binary()).to_pylist()
        begin = np.cumsum([0, *(len(b or b"") + 1 for b in raw)])
        # bytes that no text has stand between the texts
        longest = int(self.size.max(initial=0))
        data = np.frombuffer(b"\xff".join(b or b"" for b in raw) + b"\xff" * (longest + WIDTH), np.uint8)
        found = [np.zeros(0, np.int64)]
        for at in range(0, int(begin[-1]), WINDOW):
            grams = _grams(data[at : at + WINDOW + longest + WIDTH])
            for w, table, keys, first, count, of in self.groups:
                low = grams[:WINDOW] if w == WIDTH else grams[:WINDOW] & _MASK[w]
                place = np.flatnonzero(table[_slot(low)])
                key = np.searchsorted(keys, low[place])
                there = keys[np.minimum(key, len(keys) - 1)] == low[place]
                place, key = place[there], key[there]
                n = count[key]
                which = of[np.repeat(first[key] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                place = np.repeat(place, n)
                if w == WIDTH:
                    place, which = self._whole(grams, place, which)
                row = np.searchsorted(begin, place + at, "right") - 1
                found.append(np.unique(row * len(self.size) + which))
        pairs, most = np.unique(np.concatenate(found)), max(1, len(self.size))
        return pairs // most, pairs % most

    def _whole(self, grams: np.ndarray, place: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of places with the first eight bytes of a string, those with all of it."""
        at = WIDTH
        todo = np.flatnonzero(self.size[which] > at)
        good = np.ones(len(place), bool)
        while len(todo):
            # the last step goes back so far that it ends with the string
            off = np.minimum(at, self.size[which[todo]] - WIDTH)
            to = place[todo] + off
            same = to < len(grams)
            same[same] = grams[to[same]] == self.grams[self.start[which[todo[same]]] + off[same]]
            good[todo[~same]] = False
            at += WIDTH
            todo = todo[same]
            todo = todo[self.size[which[todo]] > at]
        return place[good], which[good]
