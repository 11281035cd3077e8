"""Packing: first-fit decreasing by a tournament tree of bin capacities, in randomised groups of documents.

A document is its token ids and one end id. It is cut at every ``length`` ids from its start, so that all pieces but its
last are sequences of their own; the last is packed whole. Cuts are known before packing, so a piece's checksum is taken
where its text is read, and only small rows (no text, no ids) are shuffled: documents are dealt to random groups by hash,
of GROUP documents on average at any size, and each group is packed alone, largest piece first, each into the first bin
with room. The tree holds the largest room below each node, so finding that bin takes log2(bins) steps.

Defined results: a null or empty text is its end id alone; rows with equal or null ids are packed as documents of their
own; ties in length are taken in the order of id and start; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pavilion.llm.tokens import TOKENIZER, encoder
from pavilion.llm.words import let_go, slices

LENGTH, END_ID, GROUP, SEED = 4096, 2, 8192, 17
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def pieces(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document; with ``with_ids`` its ids too, as little-endian 32-bit integers.

    ``again`` is 0 but for repeated rows: it tells apart those that a task has, so that they are dealt like any others.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = encoder(tokenizer or default_tokenizer()), end_id.to_bytes(4, "little")
        seen, base = {}, (TaskContext.get().partitionId() + 1) << 32
        for batch in batches:
            for part in slices(batch):
                out: list[list] = [[], [], [], [], [], [], []]
                for doc, ids in zip(part.column("doc_id").to_pylist(), words.rows(part.column("text")), strict=True):
                    ids += end
                    for at in range(0, len(ids), 4 * length):
                        own = ids[at : at + 4 * length]
                        crc, again = zlib.crc32(own), 0
                        if len(own) < 4 * length:
                            key = hash((doc, at, crc))
                            again = seen.get(key, 0)
                            seen[key] = again + 1
                        for to, x in zip(out, (doc, at // 4, len(own) // 4, crc, len(ids) // 4, again and base + again, own if with_ids else None), strict=True):
                            to.append(x)
                arrays = [pa.array(x, pa.int64()) for x in out[:6]] + [pa.array(out[6], pa.binary())] * with_ids
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "again"] + ["ids"] * with_ids)
        let_go()

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES + ", again long" + ", ids binary" * with_ids)


class Bins:
    """Bins of equal capacity under a tournament tree: a node holds the largest room of the bins below it."""

    def __init__(self, most: int, capacity: int):
        self.size = 1 << max(0, most - 1).bit_length()
        self.room = [capacity] * (2 * self.size)

    def first_fit(self, need: int) -> tuple[int, int]:
        """Places ``need`` in the first bin with so much room; the bin and what was left of it before."""
        room, k = self.room, 1
        while k < self.size:
            k *= 2
            if room[k] < need:
                k += 1
        left, bin_no = room[k], k - self.size
        room[k] = left - need
        k //= 2
        while k:
            a, b = room[2 * k], room[2 * k + 1]
            most = a if a > b else b
            if room[k] == most:
                break
            room[k] = most
            k //= 2
        return bin_no, left


def packed_group(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """Bin and offset of each size, by first-fit decreasing; equal sizes in the order given."""
    out: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    bins = Bins(len(sizes), capacity)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        bin_no, left = bins.first_fit(sizes[k])
        out[k] = (bin_no, capacity - left)
    return out


def packed(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID, group: int = GROUP, seed: int = SEED) -> DataFrame:
    """Every piece with its sequence and its place there."""
    groups = max(1, -(-docs.count() // group))
    dealt = pieces(docs, tokenizer, length, end_id).withColumn("_group", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32", "again"), F.lit(groups))).drop("again")

    def pack(own: pa.Table) -> pa.Table:
        number = own.column("_group")[0].as_py() << 32
        own = own.drop_columns(["_group"]).sort_by([(c, "ascending") for c in ("doc_id", "start", "ids_crc32", "doc_tokens")])
        placed = packed_group(own.column("length").to_pylist(), length)
        own = own.append_column("sequence_id", pa.array([number + b for b, _ in placed], pa.int64()))
        return own.append_column("offset", pa.array([o for _, o in placed], pa.int64()))

    return dealt.groupBy("_group").applyInArrow(pack, PACKED)
