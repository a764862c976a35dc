"""Benchmark decontamination by a BM25 index of the items and block-max WAND.

The items of a benchmark are an inverted index: per term the items that have it,
with its BM25 weight as a share of the item's own score, in blocks of items, and
the largest weight of each block. Every training text is a query (one passage, as
whole documents are judged): the sum of its terms' weights is an item's score.

An item is contained in a document that has enough of its distinct 5-word
shingles, or enough of the question's shingles and of the answer's distinct
words. Whoever has those misses few words, and the most weight that so many words
can have gives each item its own threshold: what scores below it can't be
contained, so nothing is lost by retrieval. A text's terms are put in order of
their largest weight; those before the pivot, whose sum stays below the least
threshold of all, can't make an item alone, so only the blocks of the others are
looked at, and of these only the ones whose maxima reach their items' least
threshold are scored. All items above their threshold are retrieved, and question
and answer overlap verified on the whole document.

The index is broadcast; it takes about eight times the items' text. A benchmark
above ``PASS_BYTES`` is done in several passes over the documents, each with the
part of the items whose index has that bound; terms are counted over all items.
The answer of an item is what follows its last ". "; without one it has none.

Defined results: null or empty texts match nothing; items that are null, or
have fewer words than a shingle, match nothing; rows that repeat an id give
their pairs each; repeated items likewise. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import kernel as K
from lodestone.runtime import drop, materialize

WORDS = 5
#: Shares of an item's shingles, or of its question's, and of its answer's words that a document must have.
OVERLAP, ANSWER = 0.8, 0.8
K1, B = 1.2, 0.75
#: Items of a block, text of the items of one pass, and entries of the index that a batch of texts opens at once.
BLOCK, PASS_BYTES, OPEN = 16, 16 << 20, 2_000_000


#: Slack for sums of 32-bit weights.
SLACK = 1e-4


def _hash_words(text: str) -> np.ndarray:
    data, offs = K.texts(pa.array([text]))
    starts, ends, _ = K.words(data, offs)
    return K.span_hashes(data, starts, ends)


def _most(weight: np.ndarray, n: int) -> float:
    return float(np.sort(weight)[::-1][:n].sum())


class Item:
    """Distinct shingles and terms of an item, and which of them are the question's and the answer's."""

    def __init__(self, item_id: int, text: str):
        self.item_id = item_id
        question, _, answer = text.rpartition(". ")
        w = _hash_words(text)
        q, a = (_hash_words(question + "."), _hash_words(answer)) if question else (w, w[:0])
        self.size, self.asked_size = len(w), len(q)
        self.terms, self.tf = np.unique(w, return_counts=True)
        self.shingles = np.unique(K.window_hashes(w, WORDS))
        self.asked, self.told, self.of_question = np.isin(self.shingles, K.window_hashes(q, WORDS)), np.isin(self.terms, a), np.isin(self.terms, q)

    def threshold(self, weight: np.ndarray, overlap: float, answer: float) -> float:
        """The least score that a document that contains the item can have, of weights that add up to one."""

        def words(shingles: int, size: int) -> int:
            """Distinct words that can be missing where enough shingles are there. Each takes a place of
            its own along, where a shingle begins; a repeated shingle begins at several."""
            return int((1 - overlap) * shingles + 1e-9) + size - (WORDS - 1) - shingles

        in_all = _most(weight, words(len(self.shingles), self.size))
        asked = int(self.asked.sum())
        # a question of fewer words than a shingle asks for nothing
        in_question = _most(weight[self.of_question], words(asked, self.asked_size) if asked else len(weight))
        in_answer = _most(weight[self.told], int((1 - answer) * self.told.sum() + 1e-9))
        return 1 - max(in_all, in_question + in_answer)


def _offsets(parts: list[np.ndarray]) -> np.ndarray:
    return np.cumsum([0, *map(len, parts)])


class Index:
    """Postings by term and block of items, block maxima, thresholds, and what verification needs of each item."""

    def __init__(self, items: list[Item], idf: dict[int, float], mean: float, overlap: float = OVERLAP, answer: float = ANSWER):
        self.overlap, self.answer = overlap, answer
        self.ids = np.array([i.item_id for i in items], np.int64)
        if not items:
            return
        self.shingles, self.asked, self.shingle_at = np.concatenate([i.shingles for i in items]), np.concatenate([i.asked for i in items]), _offsets([i.shingles for i in items])
        hashes, self.told, self.term_at = np.concatenate([i.terms for i in items]), np.concatenate([i.told for i in items]), _offsets([i.terms for i in items])
        self.terms, of = np.unique(hashes, return_inverse=True)
        self.term = of.astype(np.int32)
        weight, theta = [], []
        for i in items:
            w = np.array([idf[t] for t in i.terms.tolist()]) * i.tf * (K1 + 1) / (i.tf + K1 * (1 - B + B * i.size / mean))
            weight.append(w / w.sum())
            theta.append(i.threshold(weight[-1], overlap, answer))
        item = np.repeat(np.arange(len(items)), np.diff(self.term_at))
        order = np.lexsort((item, of))
        self.posting, self.weight = item[order].astype(np.int32), np.concatenate(weight)[order].astype(np.float32)
        self.blocks = -(-len(items) // BLOCK)
        key = of[order] * self.blocks + self.posting // BLOCK
        self.begin = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key)).astype(np.int32)
        self.entry = key[self.begin[:-1]]
        self.most = np.maximum.reduceat(self.weight, self.begin[:-1])
        self.open = np.searchsorted(self.entry, np.arange(len(self.terms) + 1) * self.blocks).astype(np.int32)
        self.most_of_term = np.maximum.reduceat(self.most, self.open[:-1])
        self.theta = np.array(theta, np.float32) - SLACK
        self.theta_of_block = np.minimum.reduceat(self.theta, np.arange(0, len(items), BLOCK))

    def nbytes(self) -> int:
        return sum(x.nbytes for x in vars(self).values() if isinstance(x, np.ndarray))

    def _hits(self, hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, term) of the words that the index knows."""
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        hit = self.terms[at] == hashes
        key = np.unique(row[hit] * len(self.terms) + at[hit])
        return key // len(self.terms), key % len(self.terms)

    def retrieve(self, hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, score) of all items at their threshold or above."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        row, term = self._hits(hashes, row)
        if not len(row):
            return none
        order = np.lexsort((self.most_of_term[term], row))
        term = term[order]
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        size = np.diff(np.append(first, len(row)))
        rows, of = row[first], np.repeat(np.arange(len(first)), size)
        most = self.most_of_term[term].astype(np.float64)
        total = np.cumsum(most)
        upto = total - (total - most)[first][of]
        essential = upto >= self.theta.min()  # from the pivot on
        before = np.bincount(of, np.where(essential, 0.0, most), len(first))
        opened = np.where(essential, np.diff(self.open)[term], 0)
        found = []
        for a, z in _portions(np.add.reduceat(opened, first)):
            part = slice(first[a], first[z - 1] + size[z - 1])
            e = K.ranges(self.open[term[part]], opened[part])
            key, inverse = np.unique(np.repeat(of[part], opened[part]) * self.blocks + self.entry[e] % self.blocks, return_inverse=True)
            bound = np.bincount(inverse, self.most[e], len(key)) + before[key // self.blocks]
            live = key[bound >= self.theta_of_block[key % self.blocks]]
            for x, y in _portions(size[live // self.blocks]):
                q, block = live[x:y] // self.blocks, live[x:y] % self.blocks
                n = size[q]
                wanted = term[K.ranges(first[q], n)] * self.blocks + np.repeat(block, n)
                at = np.minimum(np.searchsorted(self.entry, wanted), len(self.entry) - 1)
                hit = self.entry[at] == wanted
                at, q = at[hit], np.repeat(q, n)[hit]
                n = self.begin[at + 1] - self.begin[at]
                p = K.ranges(self.begin[at], n)
                pair, inverse = np.unique(np.repeat(q, n) * len(self.ids) + self.posting[p], return_inverse=True)
                score = np.bincount(inverse, self.weight[p], len(pair))
                enough = score >= self.theta[pair % len(self.ids)]
                found.append((rows[pair[enough] // len(self.ids)], pair[enough] % len(self.ids), score[enough]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else none

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, float, float, float, float]]:
        """(row, item, score, overlap, question overlap, answer overlap) of what the texts contain."""
        starts, ends, row = K.words(data, offs)
        if not len(starts) or not len(self.ids):
            return []
        hashes = K.span_hashes(data, starts, ends)
        first = np.searchsorted(row, np.arange(len(offs)))
        out, of, words, grams = [], -1, None, None
        for r, i, score in sorted(zip(*(x.tolist() for x in self.retrieve(hashes, row)), strict=True)):
            if r != of:
                of, words = r, hashes[first[r] : first[r + 1]]
                words, grams = np.sort(words), np.sort(K.window_hashes(words, WORDS))
            s, t = slice(*self.shingle_at[i : i + 2]), slice(*self.term_at[i : i + 2])
            there = _known(self.shingles[s], grams)
            asked, told = self.asked[s], self.told[t]
            share = there.mean()
            of_question = there[asked].mean() if asked.any() else 1.0
            of_answer = _known(self.terms[self.term[t][told]], words).mean() if told.any() else 1.0
            if share >= self.overlap or (of_question >= self.overlap and of_answer >= self.answer):
                out.append((r, i, score, float(share), float(of_question), float(of_answer)))
        return out


def _portions(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of numbers that add up to ``OPEN`` at most; a larger one stands alone."""
    total, a = np.append(0, np.cumsum(sizes)), 0
    while a < len(sizes):
        z = max(a + 1, int(np.searchsorted(total, total[a] + OPEN, side="right")) - 1)
        yield a, z
        a = z


def _known(asked: np.ndarray, there: np.ndarray) -> np.ndarray:
    if not len(there):
        return np.zeros(len(asked), bool)
    return there[np.minimum(np.searchsorted(there, asked), len(there) - 1)] == asked


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each item and its size."""
    for batch in batches:
        items = [Item(0, t) for t in batch.column("text").to_pylist()]
        items = [i for i in items if len(i.shingles)]
        yield pa.RecordBatch.from_arrays([pa.array([i.terms.view(np.int64) for i in items], pa.list_(pa.int64())), pa.array([i.size for i in items], pa.int64())], ["terms", "size"])


def _idf(n: int, df: dict[int, int]) -> dict[int, float]:
    return {t: float(np.log(1 + (n - d + 0.5) / (d + 0.5))) for t, d in df.items()}


def _indexes(benchmark: DataFrame, overlap: float, answer: float, pass_bytes: int) -> Iterator[Index]:
    """An index of at most about ``pass_bytes`` of item text at a time; terms are counted over all items."""
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    passes = max(1, -(-(items.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0) // pass_bytes))
    terms = items.mapInArrow(_item_terms, "terms array<long>, size long")
    counted = total = None
    if passes > 1:
        total = terms.agg(F.count("*").alias("n"), F.avg("size").alias("mean")).first()
        counted = materialize(terms.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "terms")
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k)
        known = [i for i in (Item(*r) for r in sorted((r.item_id, r.text) for r in part.toLocalIterator())) if len(i.shingles)]
        if counted is None:
            every, df = np.unique(np.concatenate([np.zeros(0, np.uint64), *(i.terms for i in known)]), return_counts=True)
            n, mean = len(known), sum(i.size for i in known) / max(len(known), 1)
        else:  # of the part's terms only
            own = part.mapInArrow(_item_terms, "terms array<long>, size long").select(F.explode("terms").alias("term")).distinct()
            counts = counted.join(own, "term").toArrow()
            every, df, n, mean = counts.column("term").to_numpy().view(np.uint64), counts.column("df").to_numpy(), total.n, total.mean
        yield Index(known, _idf(n, dict(zip(every.tolist(), df.tolist(), strict=True))), mean, overlap, answer)
    if counted is not None:
        drop(counted)


def matches(docs: DataFrame, benchmark: DataFrame, overlap: float = OVERLAP, answer: float = ANSWER, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(doc_id, item_id, score, overlap, question_overlap, answer_overlap) of the items that documents contain."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = None
    for index in _indexes(benchmark, overlap, answer, pass_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for part in K.slices(batches, "text"):
                found = index(*K.texts(part.column("text")))
                ids = part.column("doc_id").take(pa.array([f[0] for f in found], pa.int64()))
                cols = [pa.array(index.ids[[f[1] for f in found]]), *(pa.array([f[k] for f in found], pa.float64()) for k in (2, 3, 4, 5))]
                yield pa.RecordBatch.from_arrays([ids, *cols], ["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap"])

        some = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, item_id long, score double, overlap double, question_overlap double, answer_overlap double")
        out = some if out is None else out.unionAll(some)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, overlap: float = OVERLAP, answer: float = ANSWER, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The documents that contain no item, with all their columns."""
    for index in _indexes(benchmark, overlap, answer, pass_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part in K.slices(batches, "text"):
                clean = np.ones(part.num_rows, bool)
                clean[[f[0] for f in shared.value(*K.texts(part.column("text")))]] = False
                yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
