"""Documents in groups, and vectors of hashes dealt to buckets, as binary rows.

A shuffle row for each of billions of word windows would cost more than the windows. Here a row holds the sorted hashes
that one group of documents sends to one bucket, its bytes transposed to planes, so that the shuffle's codec removes the
leading bytes that sorted neighbours share. Both groups and buckets are of bounded size: their numbers follow the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pavilion.llm.tables import written
from pavilion.llm.words import buffers, slices

#: Text bytes and rows of a group of documents at most (a longer document is a group of its own), text bytes of one of its
#: rows here (objects of half a megabyte and more are a burden to a JVM's heap), and hashes of a bucket on average.
GROUP_BYTES, GROUP_ROWS, PIECE_BYTES, BUCKET_HASHES = 4 << 20, 1 << 14, 1 << 19, 1 << 20
_WRITE = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))


def sized(docs: DataFrame) -> tuple[int, int]:
    """Rows and bytes of text."""
    row = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    return row.n, row.b or 0


def packed_table(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=_WRITE) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(blobs: list[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in blobs])


def steady(docs: DataFrame) -> DataFrame:
    """The documents in an order that a task run again finds again: as files hold them, if need be in files made here."""
    plan = docs._jdf.queryExecution().executedPlan().toString()
    return docs if "Scan " in plan and "Exchange" not in plan else written(docs, "rows")


def grouped(docs: DataFrame, partitions: int) -> DataFrame:
    """Rows (grp, blob), some for each group: all columns of the documents, in groups of rows that follow each other, co-located by ``grp``."""
    most, rows, piece = GROUP_BYTES, GROUP_ROWS, PIECE_BYTES

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, n, grp = 0, 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, most=min(piece, most), rows=rows):
                own = len(buffers(part.column("text"))[0])
                if n and (size + own > most or n + part.num_rows > rows):
                    size, n, grp = 0, 0, grp + 1
                size, n = size + own, n + part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([grp], pa.int64()), pa.array([packed_table(part)], pa.binary())], names=["grp", "blob"])

    return steady(docs).mapInArrow(pack, "grp long, blob binary").repartition(partitions, "grp")


def planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of 64-bit values, a plane for each byte, the highest first."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width][:, ::-1].T).tobytes()


def from_planes(data: bytes, width: int) -> np.ndarray:
    n = len(data) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, n)[::-1].T
    return out.view("<u8").ravel()


def bucket_ranges(sorted_hashes: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Where each bucket's hashes begin among sorted hashes of ``bits`` bits; bucket b has those from b/buckets of the range."""
    edges = np.array([((b << bits) + buckets - 1) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_hashes, edges), [len(sorted_hashes)]])
