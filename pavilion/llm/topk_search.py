"""Exact top-k by inner product with MaxScore over the components of integer vectors.

A component x becomes floor(1024 * x). A query's terms are its non-zero components; a shard's postings of a term are its
vectors' values there. With a shard's least and greatest value of each term, a term adds at most
max(q * least, q * greatest) to a score and at least the smaller of the two. Terms are sorted by how far these bounds are
apart. The threshold is the k-th best score of any shard that the task has searched before for the query, or the k-th best
lower bound so far among the shard's distinct ids, whichever is greater. The *essential* terms are the first ones after which the
rest could no longer lift a vector of the least partial sum to the threshold: they are traversed for all vectors. The
*non-essential* ones are probed in steps, only for vectors that are still competitive: whose partial sum plus what the rest
adds at most reaches the threshold, which rises at each step. Ties count as competitive, so results are exact. Scores are
integers: sums are taken in double precision where they are provably below 2**53, else in Python integers.

Vectors are packed in shards, queries in blocks, both of bounded size. Each block meets each shard once, in a Cartesian
product of the two tables' files: a stated query set (its share of the rows is fixed by the caller) against all rows. Nothing
is broadcast, however small the files are (repeated rows compress to nearly nothing), and no copy of a block crosses the
network. A shard returns k rows a query at most, those that its task's threshold leaves; shards merge by rank in two steps.

Defined results: vectors that are null, hold a null or a non-finite component take no part; components beyond a vector's
end are zero, so an empty vector scores 0; a candidate is any row but the query's own, by id: rows that share an id are one
candidate if equal, else the better, and are never candidates of their own id; rows without an id take no part; ties go
to the smaller id; scores beyond 64 bits are the nearest 64-bit number; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pavilion.llm.tables import written

K, SCALE, EVERY = 10, 1024, 100
#: Vectors of a shard and queries of a block.
SHARD, BLOCK = 8192, 1024
#: Terms that are traversed between two looks at the bounds, and queries whose thresholds a task keeps from shard to shard.
STEP, KEPT = 8, 1 << 16
_HITS = "query_id long, vec_id long, score long"


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows with only finite components, as floored integers in doubles padded with zeros; and which rows those are."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    flat = pc.list_flatten(column).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    with np.errstate(invalid="ignore", over="ignore"):
        out[rows, at] = np.floor(flat * SCALE)
    ok = column.is_valid().to_numpy(zero_copy_only=False) & np.isfinite(out).all(axis=1)
    return out[ok], ok


def _packed(vectors: DataFrame, size: int, name: str) -> DataFrame:
    """Rows (part, blob) of at most ``size`` vectors each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                values, ok = _matrix(part.column("embedding"))
                ids = part.column("vec_id").cast(pa.int64()).filter(pa.array(ok)).to_numpy()
                if len(ids):
                    blob = np.array([len(ids), values.shape[1]], np.int64).tobytes() + ids.astype(np.int64).tobytes() + values.tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([blob], pa.binary())], names=["part", "blob"])
                    n += 1

    # A row group for each few megabytes, so that a file can be read in several tasks.
    small = {"parquet.block.size": 4 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
    return written(vectors.mapInArrow(pack, "part long, blob binary"), name, **small)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, width = np.frombuffer(blob, np.int64, 2)
    return np.frombuffer(blob, np.int64, n, 16), np.frombuffer(blob, np.float64, n * width, 16 + 8 * n).reshape(n, width)


class Shard:
    """Vectors by component, with each component's least and greatest value."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids = ids
        names, self.name = np.unique(ids, return_inverse=True)
        self.names = len(names)
        self.postings = np.ascontiguousarray(values.T)
        self.least = self.postings.min(axis=1, initial=0) if values.size else np.zeros(values.shape[1])
        self.most = self.postings.max(axis=1, initial=0) if values.size else np.zeros(values.shape[1])

    def best(self, query_id: int, query: np.ndarray, k: int, threshold: float = -np.inf) -> tuple[np.ndarray, list[int]]:
        """Ids and scores of the k best vectors but the query's own, best first, ties by id; those below the threshold may be missing."""
        n = min(len(query), len(self.postings))
        query = query[:n]
        ends = np.stack([query * self.least[:n], query * self.most[:n]])
        low, high = ends.min(axis=0), ends.max(axis=0)
        if np.abs(ends).max(initial=0) * max(n, 1) >= 2.0**53:
            return self._by_integers(query_id, query, k)
        terms = np.argsort(low - high, kind="stable")
        fixed, terms = low[(high - low) == 0].sum(), terms[(high - low)[terms] > 0]  # a term that adds the same to all is no posting
        low_rest = np.r_[np.cumsum(low[terms][::-1])[::-1], 0.0]
        high_rest = np.r_[np.cumsum(high[terms][::-1])[::-1], 0.0]
        least = low_rest[0] - low_rest + high_rest + fixed  # what a vector of the least partial sum could still reach
        alive = np.flatnonzero(self.ids != query_id)
        sums, essential = np.full(len(alive), fixed), True
        for at in range(0, len(terms), STEP):
            step = terms[at : at + STEP]
            every = len(alive) == len(self.ids)
            sums += query[step] @ (self.postings[step] if every else self.postings[np.ix_(step, alive)])
            done = at + len(step)
            threshold = max(threshold, self._bar(alive, sums, k) + low_rest[done])
            essential = essential and least[done] >= threshold
            if not essential and len(alive) > 4 * k:
                keep = sums + high_rest[done] >= threshold
                if keep.sum() < 0.8 * len(alive):
                    alive, sums = alive[keep], sums[keep]
        return self._top(self.ids[alive], sums.astype(np.int64), k)

    def _bar(self, alive: np.ndarray, sums: np.ndarray, k: int) -> float:
        """The k-th best partial sum, that of an id's best row for each id: results are k ids, not k rows."""
        if self.names < len(self.ids):
            best = np.full(self.names, -np.inf)
            np.maximum.at(best, self.name[alive], sums)
            sums = best[best > -np.inf]
        return np.partition(sums, len(sums) - k)[len(sums) - k] if len(sums) >= k else -np.inf

    def _by_integers(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, list[int]]:
        """For values beyond what doubles hold exactly."""
        alive = np.flatnonzero(self.ids != query_id)
        q = [int(x) for x in query]
        scores = [sum(a * int(b) for a, b in zip(q, self.postings[: len(q), v], strict=True)) for v in alive]
        scores = [min(max(s, -(1 << 63)), (1 << 63) - 1) for s in scores]
        return self._top(self.ids[alive], np.array(scores, np.int64), k)

    def _top(self, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, list[int]]:
        order = np.lexsort((ids, np.bitwise_not(scores)))
        ids, scores = ids[order], scores[order]
        if len(ids) and (ids[1:] == ids[:-1]).any() or len(np.unique(ids[: 2 * k])) < len(ids[: 2 * k]):
            _, first = np.unique(ids, return_index=True)  # the best of each id
            first.sort()
            ids, scores = ids[first], scores[first]
        return ids[:k], scores[:k].tolist()


def top_k(queries: DataFrame, vectors: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score. Both frames have vec_id and embedding."""
    shards = _packed(vectors.where(F.col("vec_id").isNotNull()).select("vec_id", "embedding"), SHARD, "vectors")
    asked = queries.where(F.col("vec_id").isNotNull()).select("vec_id", "embedding").distinct()
    blocks = _packed(asked, BLOCK, "queries")
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard = None, None
        thresholds: dict[int, int] = {}
        for batch in batches:
            for part, blob, asked in zip(batch.column("part").to_pylist(), batch.column("blob"), batch.column("queries"), strict=True):
                if part != held:
                    held, shard = part, Shard(*_unpacked(blob.as_py()))
                if len(thresholds) > KEPT:
                    thresholds.clear()
                out: list[list] = [[], [], []]
                for q, query in zip(*_unpacked(asked.as_py()), strict=True):
                    key = int(q), hash(query.tobytes())  # rows of one id may hold several vectors
                    ids, scores = shard.best(int(q), query, k, thresholds.get(key, -np.inf))
                    known = thresholds.get(key, -np.inf)
                    if len(scores) == k:
                        thresholds[key] = max(scores[-1], known)
                    if scores and scores[-1] < known:  # k ids of another shard are better
                        scores = [x for x in scores if x >= known]
                        ids = ids[: len(scores)]
                    out[0] += [int(q)] * len(scores)
                    out[1] += ids.tolist()
                    out[2] += scores
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["query_id", "vec_id", "score"])

    # (shard, block) pairs, not pairs of rows; without the hint, files that compress well would be broadcast.
    pairs = shards.hint("shuffle_replicate_nl").crossJoin(blocks.select(F.col("blob").alias("queries")))
    hits = pairs.select("part", "blob", "queries").mapInArrow(search, _HITS)
    best = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digest(vectors: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """Queries are the rows whose id is divisible by ``every``."""
    return top_k(vectors.where(F.col("vec_id") % every == 0), vectors, k)
