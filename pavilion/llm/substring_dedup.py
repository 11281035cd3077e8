"""Substring dedup by fixed-block anchors, exact for windows of ``WINDOW`` words.

Every word that lies in a window whose words also begin in a document of a smaller id is removed. The steps:

1. *Anchors.* Blocks of BLOCK = (WINDOW + 1) // 2 words at multiples of BLOCK in each document are the index; every
   rolling run of BLOCK words probes it. Each window of WINDOW words contains a whole block wherever it lies, so two
   equal windows always share an anchor. What crosses the network is 46 bits of a run's hash and two flags (is a block
   somewhere in the group; occurs in several documents there); what comes back is one bit.
2. *Extension.* Only windows around a shared anchor are hashed whole (96 bits) and compared by the least document id
   that holds them; again the answer is one bit. Runs of such windows are the maximal exact repeats.
3. *Removal.* Covered words go; the others stay in order.

Documents travel once, in compressed groups of bounded size (:mod:`pavilion.llm.blobs`: rows that follow each other,
whatever their ids), and stay where they are for all three steps. A group sends a hash once however often it occurs there, so a passage that a third of all documents share
is one entry for each group. Equal 46-bit hashes of different runs only cost an extra comparison in step 2; for 96 bits
at 10**13 windows the chance of any wrong match is below 1 in 1000.

Defined results: null and empty texts have no words; a row without an id neither loses words nor is a reference; rows
of equal ids don't remove each other's words; texts shorter than a window lose nothing; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pavilion.llm.blobs import BUCKET_HASHES, GROUP_BYTES, bucket_ranges, from_planes, grouped, planes, sized, unpacked
from pavilion.llm.words import SPACED, Words, covered, let_go, slices

WINDOW = 13
_BITS = 46
_ROW = "bucket int, grp long, kind int, data binary"
#: Groups of a task on average.
TASK_GROUPS = 8


class _Group:
    """The documents of a group by id, with the words of all; rows without an id last."""

    def __init__(self, blobs: list[bytes], window: int):
        table = unpacked(blobs)
        order = pa.compute.sort_indices(table, [("doc_id", "ascending")], null_placement="at_end")
        self.table = table.take(order)
        ids = self.table.column("doc_id").combine_chunks()
        self.named = len(ids) - ids.null_count
        self.ids = ids.slice(0, self.named).to_numpy().astype(np.int64)
        self.parts = []
        self.window, self.block = window, (window + 1) // 2
        at = 0
        for batch in self.table.select(["text"]).combine_chunks().to_batches():
            for part in slices(batch):
                self.parts.append((at, Words(part.column("text"), SPACED, False)))
                at += part.num_rows
        self.hashes = [words.hashes() for _, words in self.parts]

    def runs(self, length: int, lane: int = 0) -> Iterator[tuple[int, Words, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each part: first row, words, hashes of its runs of ``length`` words, their rows, and which count."""
        for (at, words), hashes in zip(self.parts, self.hashes, strict=True):
            runs = words.windows(hashes, length, lane)
            rows = words.rows[: len(runs)] + np.int32(at)
            yield at, words, runs, rows, words.whole(length) & (rows < self.named)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct hashes of runs of a block's length, and for each its flags: 1 a block, 2 in several documents."""
        every, docs, block = [], [], []
        for at, words, runs, rows, ok in self.runs(self.block):
            begin = words.first[:-1][rows[ok] - at]
            every.append(runs[ok] >> np.uint64(64 - _BITS))
            docs.append(rows[ok])
            block.append((np.flatnonzero(ok) - begin) % self.block == 0)
        if not every:
            return np.empty(0, np.uint64), np.empty(0, np.uint8)
        every, docs, block = map(np.concatenate, (every, docs, block))
        order = np.argsort(every, kind="stable")  # stable: documents stay in order within a hash
        every, docs, block = every[order], docs[order], block[order]
        first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.empty(0, int)
        last = np.r_[first[1:], len(every)] - 1 if len(every) else first
        ids = self.ids
        many = ids[docs[first]] != ids[docs[last]] if len(every) else np.empty(0, bool)
        blocks = np.logical_or.reduceat(block, first) if len(every) else np.empty(0, bool)
        return every[first], blocks.astype(np.uint8) + 2 * many.astype(np.uint8)

    def candidates(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows around shared anchors: position (over all parts), row, and both lanes of the hash."""
        places, docs, lanes, base = [], [], ([], []), 0
        window = list(zip(self.runs(self.window, 0), self.runs(self.window, 1), strict=True))
        for (at, words, runs, _, ok), ((_, _, one, rows, whole), (_, _, two, _, _)) in zip(self.runs(self.block), window, strict=True):
            hit = np.zeros(len(words) + 1, np.int32)
            if len(runs) and len(shared):
                keys = runs >> np.uint64(64 - _BITS)
                near = np.minimum(np.searchsorted(shared, keys), len(shared) - 1)
                hit[: len(runs)] = (shared[near] == keys) & ok
            sums = np.cumsum(hit) - hit
            n, span = len(one), self.window - self.block + 1
            take = np.flatnonzero(whole & (sums[span : span + n] > sums[:n])) if n else np.empty(0, int)
            places.append(take + base)
            docs.append(rows[take])
            lanes[0].append(one[take])
            lanes[1].append(two[take])
            base += len(words)
        if not places:
            return (np.empty(0, int), np.empty(0, int), np.empty(0, np.uint64), np.empty(0, np.uint64))
        return tuple(map(np.concatenate, (places, docs, *lanes)))

    def distinct(self, shared: np.ndarray):
        """Candidates in hash order, where each distinct window begins, and the least row that holds it."""
        places, docs, one, two = self.candidates(shared)
        two = two >> np.uint64(32)
        order = np.lexsort((docs, two, one))
        places, docs, one, two = places[order], docs[order], one[order], two[order]
        first = np.flatnonzero(np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])]) if len(one) else np.empty(0, int)
        return places, docs, one, two, first


def _answers(table: pa.Table, kind: int) -> dict[int, bytes]:
    return {b: d for b, k, d in zip(table.column("bucket").to_pylist(), table.column("kind").to_pylist(), table.column("data").to_pylist(), strict=True) if k == kind}


def _marked(values: np.ndarray, bits: int, buckets: int, answers: dict[int, bytes]) -> np.ndarray:
    """The bits that buckets sent back, for sorted distinct values."""
    cuts, out = bucket_ranges(values, bits, buckets), np.zeros(len(values), bool)
    for b, data in answers.items():
        a, z = cuts[b], cuts[b + 1]
        out[a:z] = np.unpackbits(np.frombuffer(data, np.uint8))[: z - a]
    return out


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.table([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.binary())], names=["bucket", "grp", "kind", "data"])


def _freed(judge):
    """The judge's answers, once what it has held is gone."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        out = judge(table)
        let_go()
        return out

    return run


def _judge_anchors(table: pa.Table) -> pa.Table:
    """Of one bucket: for each group, a bit for each hash that is a block somewhere and in several documents."""
    bucket, groups = table.column("bucket")[0].as_py(), table.column("grp").to_pylist()
    parts = [from_planes(d, 6) for d in table.column("data").to_pylist()]
    every = np.concatenate(parts)
    order = np.argsort(every >> np.uint64(2), kind="stable")
    key, flags = every[order] >> np.uint64(2), every[order] & np.uint64(3)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    counts = np.diff(np.r_[first, len(key)])
    del key
    block = np.bitwise_or.reduceat(flags, first)
    good = ((block & np.uint64(1)) > 0) & ((counts > 1) | ((block & np.uint64(2)) > 0))
    back = np.empty(len(every), bool)
    back[order] = np.repeat(good, counts)
    cuts = np.cumsum([0, *map(len, parts)])
    return _rows([(bucket, g, 0, np.packbits(back[a:z]).tobytes()) for g, a, z in zip(groups, cuts, cuts[1:], strict=False) if back[a:z].any()])


def _judge_windows(table: pa.Table) -> pa.Table:
    """Of one bucket: for each group, a bit for each window that begins in a document of a smaller id elsewhere."""
    bucket, groups = table.column("bucket")[0].as_py(), table.column("grp").to_pylist()
    one, two, ids, sizes = [], [], [], []
    for data in table.column("data").to_pylist():
        n = len(data) // 20
        one.append(from_planes(data[: 8 * n], 8))
        two.append(from_planes(data[8 * n : 12 * n], 4))
        ids.append(from_planes(data[12 * n :], 8).view(np.int64))
        sizes.append(n)
    one, two, ids = map(np.concatenate, (one, two, ids))
    order = np.lexsort((ids, two, one))
    a, b, d = one[order], two[order], ids[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    least = np.repeat(d[first], np.diff(np.r_[first, len(a)]))
    back = np.empty(len(a), bool)
    back[order] = least < d
    cuts = np.cumsum([0, *sizes])
    return _rows([(bucket, g, 1, np.packbits(back[x:z]).tobytes()) for g, x, z in zip(groups, cuts, cuts[1:], strict=False) if back[x:z].any()])


def deduplicated(docs: DataFrame, emit, schema: str, window: int = WINDOW) -> DataFrame:
    """Calls ``emit(table, parts, gone)`` for each group: its rows by id, its words by part, a flag for each word to go."""
    _, size = sized(docs)
    groups = max(1, -(-size // GROUP_BYTES))
    buckets = max(1, size // 6 // BUCKET_HASHES)
    partitions = -(-groups // TASK_GROUPS)
    corpus = grouped(docs, partitions)

    def probe(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        values, flags = _Group(table.column("blob").to_pylist(), window).anchors()
        cuts = bucket_ranges(values, _BITS, buckets)
        sent = (values << np.uint64(2)) | flags.astype(np.uint64)
        let_go()
        return _rows([(b, key[0].as_py(), 0, planes(sent[cuts[b] : cuts[b + 1]], 6)) for b in np.flatnonzero(np.diff(cuts)).tolist()])

    def shared(group: _Group, answers: pa.Table) -> np.ndarray:
        values, _ = group.anchors()
        return values[_marked(values, _BITS, buckets, _answers(answers, 0))]

    def extend(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _rows([])
        group, out = _Group(left.column("blob").to_pylist(), window), []
        _, docs_of, one, two, first = group.distinct(shared(group, right))
        one, two, ids = one[first], two[first], group.ids[docs_of[first]]
        cuts = bucket_ranges(one, 64, buckets)
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            a, z = cuts[b], cuts[b + 1]
            out.append((b, key[0].as_py(), 1, planes(one[a:z], 8) + planes(two[a:z], 4) + planes(ids[a:z].view(np.uint64), 8)))
        del group
        let_go()
        return _rows(out)

    def remove(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return emit(None, [], [])
        group = _Group(left.column("blob").to_pylist(), window)
        gone = np.zeros(sum(len(words) for _, words in group.parts), bool)
        if right.num_rows:
            places, docs_of, one, _, first = group.distinct(shared(group, right))
            elsewhere = _marked(one[first], 64, buckets, _answers(right, 1))
            counts = np.diff(np.r_[first, len(one)])
            ids = group.ids[docs_of]
            bad = np.repeat(elsewhere, counts) | (ids > np.repeat(ids[first], counts))
            gone = covered(len(gone), places[bad], window)
        cuts = np.cumsum([0, *(len(words) for _, words in group.parts)])
        group.hashes = []
        let_go()
        return emit(group.table, [words for _, words in group.parts], [gone[a:z] for a, z in zip(cuts, cuts[1:], strict=False)])

    anchors = corpus.groupBy("grp").applyInArrow(probe, _ROW).repartition(max(1, min(buckets, 4 * partitions)), "bucket")
    first = anchors.groupBy("bucket").applyInArrow(_freed(_judge_anchors), _ROW)
    windows = corpus.groupBy("grp").cogroup(first.groupBy("grp")).applyInArrow(extend, _ROW)
    second = windows.groupBy("bucket").applyInArrow(_freed(_judge_windows), _ROW)
    return corpus.groupBy("grp").cogroup(first.unionByName(second).groupBy("grp")).applyInArrow(remove, schema)


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed and kept_sha256."""

    def emit(table: pa.Table | None, parts: list[Words], gone: list[np.ndarray]) -> pa.Table:
        n_words, n_removed, shas = [], [], []
        for words, out in zip(parts, gone, strict=True):
            data, keep = words.data.tobytes(), ~out
            removed = np.r_[0, np.cumsum(out)][words.first]
            n_words += words.counts.tolist()
            n_removed += np.diff(removed).tolist()
            own = [data[s:e] for s, e in zip(words.starts[keep].tolist(), words.ends[keep].tolist(), strict=True)]
            kept = np.r_[0, np.cumsum(keep)][words.first].tolist()
            shas += [hashlib.sha256(b" ".join(own[a:b])).hexdigest() for a, b in zip(kept, kept[1:], strict=False)]
        ids = table.column("doc_id").combine_chunks().cast(pa.int64()) if table is not None else pa.array([], pa.int64())
        return pa.table([ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(shas, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return deduplicated(docs.select("doc_id", "text"), emit, "doc_id long, n_words long, n_removed long, kept_sha256 string", window)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without repeated passages: texts that lose nothing are as they were, the others without those words."""
    names, text_at = docs.columns, docs.columns.index("text")
    schema = docs.schema

    def emit(table: pa.Table | None, parts: list[Words], gone: list[np.ndarray]) -> pa.Table:
        if table is None:
            return _empty(schema)
        texts = table.column("text").to_pylist()
        at = 0
        for words, out in zip(parts, gone, strict=True):
            if out.any():
                new = words.without(out)
                for r in np.unique(words.rows[out]).tolist():
                    texts[at + r] = new[r].decode("utf-8", "replace")
            at += len(words.counts)
        return table.set_column(text_at, "text", pa.array(texts, pa.string())).select(names)

    return deduplicated(docs, emit, schema, window)


def _empty(schema) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema).empty_table()

