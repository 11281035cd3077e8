"""Token counts of flat, unindexed token files by a separator scan.

A token file is little-endian unsigned ids of two bytes, one document after another, each ended by the separator id; it has
no index and no length anywhere. Files are cut in blocks of BLOCK tokens without regard to documents. In each block one
vectorised comparison finds all separators. What a block can't know is where the document that is open at its start
began, and how many documents ended before; both follow from a prefix scan over one summary row a block (the last
separator so far, the separators so far), which stitches the blocks. Only separators' places are shuffled, never tokens.

The separator is the greatest number of two bytes, which no token of the vocabulary has: a text that spells a special token
out is still one document. Files are read whole, each in one task, by Spark's binary reader (2 GB at most);
:func:`write_token_files` ends a file after RUNS runs of RUN_BYTES bytes, so that it has 8 MB (a file is a row, of which a JVM makes several copies) or, where documents are longer
than a run, RUNS of those. Reading and writing go through Spark, so the folder may be in any store it knows.

Defined results: tokens after the last separator of a file are a document of their own with ``closed`` false; two
separators in a row enclose a document of no tokens; an empty file has no documents; a trailing odd byte is an error; null and
empty texts are written as documents of no tokens; other columns of the documents are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pavilion.llm.packing import default_tokenizer
from pavilion.llm.tables import new_path
from pavilion.llm.tokens import encoder
from pavilion.llm.words import let_go, slices

SEPARATOR, BLOCK, RUN_BYTES, RUNS = 0xFFFF, 1 << 19, 1 << 20, 8


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, separator: int = SEPARATOR) -> None:
    """Each partition's documents as token files, runs of documents at a time. Spark's line separator ends each run, as raw bytes."""
    end, most = separator.to_bytes(2, "little"), RUN_BYTES

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size = encoder(tokenizer or default_tokenizer(), 2), [], 0
        if separator < len(words.ends):
            raise ValueError(f"{separator} is a token's id")
        run = lambda docs: pa.RecordBatch.from_arrays([pa.array([end.join(docs)], pa.binary())], names=["ids"])
        for batch in batches:
            for part in slices(batch):
                for ids in words.rows(part.column("text")):
                    if held and size + len(ids) > most:
                        yield run(held)
                        held, size = [], 0
                    held.append(ids)
                    size += len(ids) + 2
        if held:
            yield run(held)
        let_go()

    ids = docs.select("text").mapInArrow(encode, "ids binary").select(F.col("ids").cast("string").alias("ids"))
    ids.write.option("encoding", "ISO-8859-1").option("lineSep", end.decode("latin-1")).option("maxRecordsPerFile", RUNS).text(folder)


def separators(files: DataFrame, separator: int = SEPARATOR, block: int = BLOCK) -> DataFrame:
    """Of each block: a row for each separator (idx from 0, pos in the file, the one before in this block), and one with its end (idx -1)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                data = content.as_buffer()
                if data.size % 2:
                    raise ValueError(f"{file} has an odd number of bytes")
                tokens = np.frombuffer(data, "<u2")
                for at in range(0, len(tokens), block):
                    own = tokens[at : at + block]
                    pos = np.flatnonzero(own == separator) + at
                    n = len(pos) + 1
                    columns = [
                        pa.array([file] * n, pa.string()), pa.array(np.full(n, at // block), pa.int64()), pa.array(np.r_[np.arange(len(pos)), -1], pa.int64()),
                        pa.array(np.r_[pos, at + len(own)], pa.int64()), pa.array(np.r_[-1, pos[:-1], -1] if len(pos) else np.array([-1]), pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["file", "block", "idx", "pos", "prev"])

    return files.mapInArrow(scan, "file string, block long, idx long, pos long, prev long")


def counted(spark: SparkSession, folder: str, separator: int = SEPARATOR, block: int = BLOCK) -> DataFrame:
    """A row for each document of each file: file, doc_no, start (its first token's place), n_tokens and closed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return stitched(separators(files.select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "content"), separator, block))


def stitched(found: DataFrame) -> DataFrame:
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("file")
    last = F.max(F.when(F.col("idx") >= 0, F.col("pos")))
    blocks = found.groupBy("file", "block").agg(last.alias("last"), F.count_if(F.col("idx") >= 0).alias("n"))
    carried = blocks.select("file", "block", F.coalesce(F.max("last").over(before), F.lit(-1)).alias("carry"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), (F.col("block") == F.max("block").over(ahead)).alias("final"), "n", "last")
    rows = found.join(carried, ["file", "block"])
    prev = F.when((F.col("idx") > 0), F.col("prev")).otherwise(F.when(F.col("idx") == 0, F.col("carry")).otherwise(F.coalesce("last", "carry")))
    number = F.col("base") + F.when(F.col("idx") >= 0, F.col("idx")).otherwise(F.col("n"))
    rows = rows.select("file", number.cast("long").alias("doc_no"), (prev + 1).alias("start"), (F.col("pos") - prev - 1).alias("n_tokens"), (F.col("idx") >= 0).alias("closed"), "final")
    return rows.where("closed or (final and n_tokens > 0)").drop("final")


def digest(docs: DataFrame) -> DataFrame:
    folder = new_path(docs.sparkSession, "tokens")
    write_token_files(docs, folder)
    return counted(docs.sparkSession, folder)
