"""Toxicity by a classifier chain: linear models in sequence, each fed the probabilities of the categories before it.

A text's features are its hashed words (ASCII-lower-cased runs of letters and digits) as presence flags, each scaled by
the log ratio of its shares in positive and negative rows, so that rare words weigh little. Categories come in a fixed
order; the model of each is trained on the words and on the *out-of-fold* probabilities of the earlier ones: predictions
of models that didn't see the row, as rows to be scored weren't seen either. At scoring, earlier categories are
predicted by models fitted on all rows of the sample.

The sample is at most SAMPLE labelled rows, those with the least hash of their id (a documented
bound); it is fitted in one task. Scoring reads every text whole. The model is WEIGHTS
numbers a category: its size doesn't follow the data.

Defined results: null and empty texts have no words and get the model's prior; null ids are scored; labels that are null
or of unknown ids are left out; ids with several labels count once, with the greatest; without labels of both kinds
a category's probability is its share of positive labels (0 without labels); an empty table gives no rows; other columns
are kept by :func:`clean`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pavilion.llm.tables import unused
from pavilion.llm.words import ALNUM, Words, let_go, slices

CATEGORIES = ("quality", "toxic")
SAMPLE, FOLDS, BITS, ROUNDS, L2 = 12_000, 4, 18, 60, 3e-4
THRESHOLD = 0.5


def _features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed words of each row: feature numbers, row after row, and the offsets of rows."""
    words = Words(column, ALNUM, True)
    cells = (words.hashes() >> np.uint64(64 - BITS)).astype(np.int64)
    key = np.unique((words.rows.astype(np.int64) << BITS) | cells)
    rows = key >> BITS
    return key & ((1 << BITS) - 1), np.searchsorted(rows, np.arange(len(words.counts) + 1))


def _sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0.0, np.cumsum(values)][offs])


class Linear:
    """Logistic regression on flags and a few dense inputs, by full-batch Adam with an L2 penalty."""

    def __init__(self, cells: np.ndarray, offs: np.ndarray, dense: np.ndarray, y: np.ndarray):
        n, k = len(y), dense.shape[1]
        self.share = float(y.mean()) if n else 0.0
        self.w, self.v, self.b = np.zeros(1 << BITS), np.zeros(k), np.log((self.share + 1e-3) / (1 - self.share + 1e-3))
        self.constant = n == 0 or self.share in (0.0, 1.0)
        if self.constant:
            return
        used, at = np.unique(cells, return_inverse=True)
        rows = np.repeat(np.arange(n), np.diff(offs))
        weight = np.where(y > 0, 0.5 / max(self.share, 1e-9), 0.5 / max(1 - self.share, 1e-9))
        # A word's informative weight: naive-Bayes log ratio as the start, refined by descent.
        pos = np.bincount(at, (y * weight)[rows], len(used)) + 1
        neg = np.bincount(at, ((1 - y) * weight)[rows], len(used)) + 1
        ratio = np.log(pos / neg)
        w, v, b = np.zeros(len(used)), self.v, 0.0
        m1, m2 = np.zeros(len(used) + k + 1), np.zeros(len(used) + k + 1)
        for t in range(1, ROUNDS + 1):
            p = 1 / (1 + np.exp(-np.clip(_sums((w * ratio)[at], offs) + dense @ v + b, -30, 30)))
            d = (p - y) * weight / n
            g = np.r_[np.bincount(at, d[rows], len(used)) * ratio + L2 * w, dense.T @ d + L2 * v, d.sum()]
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
            step = 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
            w, v, b = w - step[: len(used)], v - step[len(used) : -1], b - step[-1]
        self.w[used], self.v, self.b = w * ratio, v, b

    def probability(self, cells: np.ndarray, offs: np.ndarray, dense: np.ndarray) -> np.ndarray:
        if self.constant:
            return np.full(len(offs) - 1, self.share)
        return 1 / (1 + np.exp(-np.clip(_sums(self.w[cells], offs) + dense @ self.v + self.b, -30, 30)))


class Chain:
    """A model for each category, in order."""

    def __init__(self, cells: np.ndarray, offs: np.ndarray, labels: np.ndarray, folds: np.ndarray):
        n, self.models = len(offs) - 1, []
        dense = np.zeros((n, 0))
        for k in range(labels.shape[1]):
            y = labels[:, k]
            known = y >= 0
            self.models.append(Linear(*_rows_of(cells, offs, known), dense[known], y[known]))
            if k + 1 == labels.shape[1]:
                break
            out = np.zeros(n)
            for f in range(FOLDS):
                train, rest = known & (folds != f), folds == f
                model = Linear(*_rows_of(cells, offs, train), dense[train], y[train])
                out[rest] = model.probability(*_rows_of(cells, offs, rest), dense[rest])
            dense = np.c_[dense, out]

    def probabilities(self, cells: np.ndarray, offs: np.ndarray) -> np.ndarray:
        dense = np.zeros((len(offs) - 1, 0))
        for model in self.models:
            dense = np.c_[dense, model.probability(cells, offs, dense)]
        return dense


def _rows_of(cells: np.ndarray, offs: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(offs)
    return cells[np.repeat(keep, sizes)], np.r_[0, np.cumsum(sizes[keep])]


def fitted(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, sample: int = SAMPLE) -> Chain:
    """The chain, trained in one task on a bounded sample of labelled documents, one row each."""
    chosen = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.max(c).cast("int").alias(f"y_{k}") for k, c in enumerate(categories)])
    # Labels of documents that aren't there don't use up the bound.
    chosen = chosen.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    names = [f"y_{k}" for k in range(len(categories))]
    # At most ``sample`` rows of a few numbers: small enough for a broadcast at any size of the corpus.
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                cells, offs = _features(part.column("text"))
                data = [cells[a:z].astype(np.int32).tobytes() for a, z in zip(offs, offs[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(data, pa.binary()), *[part.column(c) for c in names]], names=["doc_id", "cells", *names])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        rows = [r for b in batches for r in b.to_pylist()]
        rows.sort(key=lambda r: (r["doc_id"], r["cells"]))
        own = [np.frombuffer(r["cells"], np.int32) for r in rows]
        offs = np.r_[0, np.cumsum([len(x) for x in own])].astype(np.int64)
        cells = np.concatenate([*own, np.empty(0, np.int32)]).astype(np.int64)
        y = np.array([[-1 if r[c] is None else r[c] for c in names] for r in rows], float).reshape(len(rows), len(names))
        folds = np.array([r["doc_id"] * 2654435761 % (1 << 32) >> 16 for r in rows], np.int64) % FOLDS
        chain = Chain(cells, offs, y, folds)
        for model in chain.models:
            model.w = model.w.astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(chain)], pa.binary())], names=["model"])

    encoded = joined.mapInArrow(encode, "doc_id long, cells binary, " + ", ".join(f"{c} int" for c in names))
    # Of rows with equal ids one is learnt from, the same in each run.
    encoded = encoded.groupBy("doc_id").agg(F.min("cells").alias("cells"), *[F.max(c).alias(c) for c in names])
    import pickle

    return pickle.loads(encoded.repartition(1).mapInArrow(fit, "model binary").first().model)


def scored(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, threshold: float = THRESHOLD, prefix: str = "_tox") -> DataFrame:
    """``docs`` with ``_tox`` (a probability for each category, in order) and ``_toxic``: whether the last one is at least the threshold."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, categories))
    names = [prefix, prefix + "ic"]
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.ArrayType(T.DoubleType())), T.StructField(names[1], T.BooleanType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                p = model.value.probabilities(*_features(part.column("text")))
                new = [pa.array(list(p), pa.list_(pa.float64())), pa.array(p[:, -1] >= threshold)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *names])
        let_go()

    return docs.mapInArrow(score, schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, a probability for each category, and toxic."""
    rows = scored(docs.select("doc_id", "text"), labels)
    return rows.select("doc_id", *[F.col("_tox")[k].alias(f"p_{c}") for k, c in enumerate(CATEGORIES)], F.col("_toxic").alias("toxic"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't toxic, with all their columns."""
    prefix = unused("_tox", docs.columns)
    return scored(docs, labels, prefix=prefix).where(~F.col(prefix + "ic")).drop(prefix, prefix + "ic")
