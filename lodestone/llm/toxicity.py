"""Toxicity scoring by non-negative positive-unlabelled (nnPU) learning.

A linear classifier over hashed text features is trained in numpy on the
driver from a bounded sample of texts: confirmed toxic ones (P) and unlabelled
ones (U), drawn from all documents whatever their label. Labels 0 are never
used. The risk is the class-prior-corrected one of nnPU,

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)),

and where the bracket falls below zero the step descends along its negation,
so that the classifier can't overfit by pushing U to minus infinity. The prior
is a parameter; by default it is estimated from P and U alone: whatever set of
texts one takes, its rate in U is at least the prior times its rate in P, so
the least ratio of the rates over the sets above the thresholds of a classifier
that was fitted on other texts bounds the prior from above. Every whole text is then scored by Arrow batches on the
executors.

The features of the fitted texts stay on the executors until those whose
rates in P and U differ most are chosen by their counts; only these go to the
driver, at most ``MAX_FEATURES`` numbers of two bytes a text.

Defined results: a null or empty text has only the bias, so it gets the
score of a text without evidence; label rows with a null id or toxic value,
labels without a document, and repeated label rows (the largest value counts)
do no harm; without positive labels the score is the prior everywhere.
Input columns other than the id and the text are never read for a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import kernel as K
from lodestone.runtime import drop, materialize

#: Texts are mapped to this many hashed features.
DIMENSIONS = 1 << 18
#: Text bytes whose features are made at once.
SLICE = 1 << 20
#: Lengths in bytes of the beginnings of words that are features.
STEMS = (5, 7)
#: Bound on the confirmed toxic and on the unlabelled texts that are fitted (parameters of :func:`train`).
MAX_POSITIVE, MAX_UNLABELLED = 3000, 9000
#: A feature counts if so many positives have it and its rate in P and U differs by so many standard errors.
MIN_POSITIVE, MIN_Z = 3, 2.5
#: Features of the classifier at most: those that differ by the most standard errors.
MAX_FEATURES = 4096
#: Parts of P and U for the estimate of the prior, the share of P that a set must hold, a first guess, and the prior's range.
FOLDS, SUPPORT, GUESS, LEAST_PRIOR, MOST_PRIOR = 5, 0.5, 0.05, 1e-4, 0.9
#: Weight of the squared weights in the risk, times the number of positives.
PENALTY = 0.3


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def features(data: np.ndarray, offs: np.ndarray, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each row (CSR indices and offsets): lower-cased
    words of letters, with other ASCII characters as separators, and the words'
    beginnings of some lengths in bytes, which stand for their stems."""
    keep = data.copy()
    keep[_NOT_LETTER[data]] = 0x20
    starts, ends, row = K.words(keep, offs)
    keys = []
    for salt, length in enumerate((0, *STEMS)):
        cut = ends - starts > length if length else slice(None)
        s = starts[cut]
        h = K.span_hashes(keep, s, s + length if length else ends)
        feature = (K.seeded(h, salt) >> K.U64(40)).astype(np.int64) & (dimensions - 1)
        keys.append(row[cut] * dimensions + feature)
    key = np.unique(np.concatenate(keys))
    return (key & (dimensions - 1)).astype(np.int32), np.searchsorted(key, np.arange(len(offs)) * dimensions)


_NOT_LETTER = np.zeros(256, bool)
_NOT_LETTER[:128] = True
for _c in range(26):
    _NOT_LETTER[[65 + _c, 97 + _c]] = False


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    prior: float

    def logits(self, indices: np.ndarray, offs: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(self.weights[indices])))
        return total[offs[1:]] - total[offs[:-1]] + self.bias

    def score(self, indices: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(indices, offs), -30, 30)))


def _csr(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return (np.concatenate(rows) if rows else np.zeros(0, np.int32)), np.cumsum([0, *map(len, rows)])


def risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """nnPU risk (logistic loss) of the logits of P and U, and the direction of a step for each: its
    gradient, or where the corrected negative risk is below zero, the negation of that part's."""
    sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
    rest = np.mean(np.logaddexp(0, zu)) - prior * np.mean(np.logaddexp(0, zp))
    total = prior * np.mean(np.logaddexp(0, -zp)) + max(0.0, rest)
    if rest >= 0:
        return total, prior * (sp - 1) / len(sp) - prior * sp / len(sp), su / len(su)
    return total, prior * sp / len(sp), -su / len(su)


def differing(np_: np.ndarray, nu: np.ndarray, positives: int, unlabelled: int) -> np.ndarray:
    """Standard errors by which a feature's rates in P and U differ; 0 for those that don't count."""
    rp, ru = (np_ + 0.5) / (positives + 1), (nu + 0.5) / (unlabelled + 1)
    z = np.abs(rp - ru) / np.sqrt(rp / max(positives, 1) + ru / max(unlabelled, 1))
    return np.where((np_ >= MIN_POSITIVE) & (z >= MIN_Z), z, 0.0)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, dimensions: int = DIMENSIONS, steps: int = 300, rate: float = 0.05) -> Model:
    """nnPU by full-batch Adam on the logistic loss. Rows are arrays of distinct features."""
    prior = float(min(max(prior, LEAST_PRIOR), MOST_PRIOR))
    model = Model(np.zeros(dimensions), float(np.log(prior / (1 - prior))), prior)
    if not positive or not unlabelled:
        return model
    pi, po = _csr(positive)
    ui, uo = _csr(unlabelled)
    pr, ur = np.repeat(np.arange(len(positive)), np.diff(po)), np.repeat(np.arange(len(unlabelled)), np.diff(uo))
    # features that occur equally often in P and U only add noise
    used = np.flatnonzero(differing(np.bincount(pi, minlength=dimensions), np.bincount(ui, minlength=dimensions), len(positive), len(unlabelled)))
    if not len(used):
        return model
    pi, pr = pi[keep := np.isin(pi, used)], pr[keep]
    ui, ur = ui[keep := np.isin(ui, used)], ur[keep]
    po, uo = np.searchsorted(pr, np.arange(len(positive) + 1)), np.searchsorted(ur, np.arange(len(unlabelled) + 1))
    pi, ui = np.searchsorted(used, pi), np.searchsorted(used, ui)
    w, b = np.zeros(len(used)), model.bias
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    # near the border of the risk the steps go back and forth: the model is the mean of the last third
    last, mean_w, mean_b = -(-steps // 3), np.zeros_like(w), 0.0

    def back(g: np.ndarray, at: np.ndarray, row: np.ndarray) -> np.ndarray:
        return np.bincount(at, g[row], len(used))

    for t in range(1, steps + 1):
        local = Model(w, b, prior)
        _, gp, gu = risk(np.clip(local.logits(pi, po), -30, 30), np.clip(local.logits(ui, uo), -30, 30), prior)
        g = back(gp, pi, pr) + back(gu, ui, ur) + PENALTY / len(positive) * w
        gb = gp.sum() + gu.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        step = rate / (1 - 0.9**t)
        w -= step * m / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= step * mb / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
        if t > steps - last:
            mean_w, mean_b = mean_w + w / last, mean_b + b / last
    model.weights[used], model.bias = mean_w, float(mean_b)
    return model


def estimate_prior(positive: list[np.ndarray], unlabelled: list[np.ndarray], dimensions: int = DIMENSIONS) -> float:
    """The share of positives in U, from P and U alone (see the module's docstring).

    The classifiers need a prior themselves: a small guess first, then what it
    gave. Their numbers of texts are no guess, as both samples are of bounded size.
    """
    if len(positive) < FOLDS or len(unlabelled) < FOLDS:
        return LEAST_PRIOR
    found = MOST_PRIOR
    for guess in (GUESS, None):
        logits: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        for k in range(FOLDS):
            p, u = ([r for i, r in enumerate(rows) if i % FOLDS != k] for rows in (positive, unlabelled))
            model = fit(p, u, guess or found, dimensions, steps=60)
            for out, rows in zip(logits, (positive, unlabelled), strict=True):
                out.append(model.logits(*_csr(rows[k::FOLDS])))
        sp, su = (np.sort(np.concatenate(z)) for z in logits)
        at = np.unique(sp)
        rp, ru = (1 - np.searchsorted(s, at) / len(s) for s in (sp, su))
        known = rp >= SUPPORT
        found = min(found, max(float((ru[known] / rp[known]).min()), LEAST_PRIOR))
    return found


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in K.slices(batches, "text", SLICE):
        indices, offs = features(*K.texts(part.column("text")))
        rows = [indices[a:b].tobytes() for a, b in zip(offs[:-1], offs[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(rows, pa.binary())], ["y", "f"])


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition, how many texts of P and of U have each feature."""
    n = np.zeros((2, DIMENSIONS), np.int64)
    for batch in batches:
        for y, f in zip(batch.column("y").to_pylist(), batch.column("f"), strict=True):
            n[y, np.frombuffer(f.as_py(), np.int32)] += 1
    at = np.flatnonzero(n.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[1, at]), pa.array(n[0, at])], ["feature", "p", "u"])
    K.tidy()


def _chosen_features(used: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(DIMENSIONS, -1, np.int32)
        place[used] = np.arange(len(used))
        for batch in batches:
            rows = (place[np.frombuffer(f.as_py(), np.int32)] for f in batch.column("f"))
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([r[r >= 0].astype(np.uint16).tobytes() for r in rows], pa.binary())], ["y", "f"])
        K.tidy()

    return run


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, prior: float | None = None) -> Model:
    """Fit on rows outside the held-out fold: at most ``max_positive`` that are labelled toxic
    and ``max_unlabelled`` of all documents, chosen by a hash of the id."""
    open_ = lambda df: df.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    order = lambda k: [F.xxhash64("doc_id", F.lit(k)), F.col("doc_id")]
    p = open_(labels).where("toxic = 1").select("doc_id").distinct().join(docs.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_semi")
    p = p.orderBy(*order(0)).limit(max_positive).select("doc_id", F.lit(1).alias("y"))
    u = open_(docs.select("doc_id")).orderBy(*order(1)).limit(max_unlabelled).distinct().select("doc_id", F.lit(0).alias("y"))
    # at most max_positive + max_unlabelled rows of 12 bytes, whatever the input
    chosen = F.broadcast(p.unionAll(u))
    rows = materialize(docs.select("doc_id", "text").join(chosen, "doc_id").select("y", "text").mapInArrow(_feature_rows, "y int, f binary"), "features")
    # a row for each feature and each part of a bounded number of texts
    counted = rows.mapInArrow(_feature_counts, "feature long, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).toArrow()
    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n = np.zeros((2, DIMENSIONS))
    n[:, counted.column("feature").to_numpy()] = counted.column("p").to_numpy(), counted.column("u").to_numpy()
    z = differing(n[0], n[1], sizes.get(1, 0), sizes.get(0, 0))
    used = np.sort(np.argsort(-z, kind="stable")[: min(MAX_FEATURES, int((z > 0).sum()))])
    sets: dict[int, list[np.ndarray]] = {0: [], 1: []}
    texts = rows.mapInArrow(_chosen_features(used), "y int, f binary").toArrow().to_batches()
    drop(rows)
    for y, f in sorted((y, f.as_buffer().to_pybytes()) for b in texts for y, f in zip(b.column("y").to_pylist(), b.column("f"), strict=True)):
        sets[y].append(np.frombuffer(f, np.uint16).astype(np.int32))
    rng = np.random.default_rng(0)
    for y in sets:  # the order was that of the features
        sets[y] = [sets[y][i] for i in rng.permutation(len(sets[y]))]
    dimensions = max(len(used), 1)
    model = fit(sets[1], sets[0], estimate_prior(sets[1], sets[0], dimensions) if prior is None else prior, dimensions)
    weights = np.zeros(DIMENSIONS)
    weights[used] = model.weights[: len(used)]
    return Model(weights, model.bias, model.prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Append ``score`` (double) and ``predicted`` (int) to (doc_id, text)."""
    weights, bias, prior = model.weights.astype(np.float32), model.bias, model.prior

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(weights, bias, prior)
        for part in K.slices(batches, "text", SLICE):
            s = m.score(*features(*K.texts(part.column("text"))))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns."""
    model = train(docs, labels)
    weights, bias, prior = model.weights.astype(np.float32), model.bias, model.prior

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(weights, bias, prior)
        for part in K.slices(batches, "text", SLICE):
            yield part.filter(pa.array(m.score(*features(*K.texts(part.column("text")))) < threshold))

    return docs.mapInArrow(run, docs.schema)
