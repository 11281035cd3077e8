"""Benchmark decontamination: a broadcast hash set of the benchmark's n-grams, scanned by every word window of the corpus.

Words are runs of letters, digits and non-ASCII characters of the text with A-Z lower-cased. The windows of a benchmark
item are its runs of ``n`` words; an item of fewer words is one window. A word of a document is *hit* if it lies inside
any occurrence of a window. A hash match is confirmed on the words themselves, so hits are exact.

Size of what is broadcast: items are dealt into blocks of at most ``BLOCK_BYTES`` of text (an item beyond that is a
block of its own), one broadcast and one pass each. A benchmark of any size is scanned whole, in as many passes.

Defined results: a null text has no words, no hits and is kept as it is; null, empty and wordless items have no windows;
items without an id still hit but aren't listed; items with equal ids are one; documents are judged row by row, so
repeated rows have repeated results; an empty table on either side gives rows without hits or no rows. Other columns
are kept as they are; working columns begin with ``_dc_``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pavilion.llm.tables import unused, written
from pavilion.llm.words import ALNUM, Words, covered, slices

N_WORDS = 10
BLOCK_BYTES = 4 << 20
_FILTER = np.uint64((1 << 20) - 1)


class NGrams:
    """The windows of a block of items, by length: sorted hashes, a bit filter before them, and the words themselves."""

    def __init__(self, items: list[tuple[object, str]], n: int):
        self.items: dict[bytes, list[str]] = {}
        found: dict[int, set[int]] = {}
        words = Words(pa.array([t for _, t in items], pa.large_string()), ALNUM, True)
        hashes = words.hashes()
        data = words.data.tobytes()
        own = [data[s:e] for s, e in zip(words.starts.tolist(), words.ends.tolist(), strict=True)]
        full = words.windows(hashes, n)
        for r, (item, _) in enumerate(items):
            a, b = int(words.first[r]), int(words.first[r + 1])
            if a == b:
                continue
            length = min(n, b - a)
            here = full[a : b - n + 1] if b - a >= n else words.windows(hashes[a:b], length)
            found.setdefault(length, set()).update(here.tolist())
            for k in range(a, b - length + 1):
                known = self.items.setdefault(b" ".join(own[k : k + length]), [])
                if item is not None and (not known or known[-1] != str(item)):
                    known.append(str(item))
        self.hashes = {k: np.sort(np.fromiter(v, np.uint64, len(v))) for k, v in sorted(found.items())}
        self.filters = {}
        for k, v in self.hashes.items():
            self.filters[k] = np.zeros(int(_FILTER) + 1, bool)
            self.filters[k][(v & _FILTER).astype(np.int64)] = True

    def scan(self, words: Words, hashes: np.ndarray) -> tuple[np.ndarray, dict[int, set[str]]]:
        """A flag for each word that is hit, and the items that occur in each row."""
        hit, by_row = np.zeros(len(words), bool), {}
        rows = words.rows
        for length, known in self.hashes.items():
            windows = words.windows(hashes, length)
            at = np.flatnonzero(self.filters[length][(windows & _FILTER).astype(np.int64)])
            at = at[np.isin(windows[at], known)]
            at = at[rows[at] == rows[at + length - 1]] if len(at) else at
            sure = []
            for k in at.tolist():
                text = b" ".join(words.data[s:e].tobytes() for s, e in zip(words.starts[k : k + length].tolist(), words.ends[k : k + length].tolist(), strict=True))
                if (items := self.items.get(text)) is not None:
                    sure.append(k)
                    by_row.setdefault(int(rows[k]), set()).update(items)
            if sure:
                hit |= covered(len(words), np.array(sure), length)
        return hit, by_row


def blocks(benchmark: DataFrame, n: int) -> Iterator[NGrams]:
    """The benchmark in blocks of bounded size, read one partition at a time."""
    held, size = [], 0
    for row in benchmark.where(F.col("text").isNotNull()).select("item_id", "text").toLocalIterator():
        if held and size + len(row.text) > BLOCK_BYTES:
            yield NGrams(held, n)
            held, size = [], 0
        held.append((row.item_id, row.text))
        size += len(row.text)
    if held:
        yield NGrams(held, n)


def flagged(docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS, prefix: str = "_dc_") -> DataFrame:
    """``docs`` with three columns that begin with ``prefix``: words, mask (a byte per word, 1 if hit; null if none is) and items."""
    kinds = (("words", T.LongType()), ("mask", T.BinaryType()), ("items", T.ArrayType(T.StringType())))
    schema = T.StructType([*docs.schema.fields, *[T.StructField(prefix + c, kind) for c, kind in kinds]])
    out = docs.select("*", *[F.lit(None).cast(kind).alias(prefix + c) for c, kind in kinds])

    def passed(rows: DataFrame, grams: NGrams) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(grams)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    yield _scanned(part, shared.value, prefix)

        found = rows.mapInArrow(scan, schema)
        if rows is out:
            return found
        found = written(found, "decontam")
        shared.unpersist()
        return found

    before = None
    for grams in blocks(benchmark, n):
        out, before = (passed(written(out, "decontam"), grams) if before else passed(out, grams)), True
        del grams  # the driver holds one block at a time
    return out if before else passed(out, NGrams([], n))


def _scanned(part: pa.RecordBatch, grams: NGrams, prefix: str) -> pa.RecordBatch:
    words = Words(part.column("text"), ALNUM, True)
    hit, by_row = grams.scan(words, words.hashes())
    masks, items = part.column(prefix + "mask").to_pylist(), part.column(prefix + "items").to_pylist()
    for r in np.unique(words.rows[hit]).tolist():
        mask = hit[words.first[r] : words.first[r + 1]]
        if masks[r] is not None:
            mask = mask | np.frombuffer(masks[r], np.uint8).astype(bool)
        masks[r] = mask.astype(np.uint8).tobytes()
        items[r] = sorted({*(items[r] or ()), *by_row.get(r, ())})
    new = {prefix + "words": pa.array(words.counts, pa.int64()), prefix + "mask": pa.array(masks, pa.binary()), prefix + "items": pa.array(items, pa.list_(pa.string()))}
    return pa.RecordBatch.from_arrays([new.get(c, own) for c, own in zip(part.schema.names, part.columns, strict=True)], names=part.schema.names)


def digest(docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    ones = F.length(F.replace(F.hex("_dc_mask"), F.lit("00"), F.lit(""))) / 2
    ids = F.coalesce(F.col("_dc_items"), F.array().cast("array<string>"))
    return flagged(docs.select("doc_id", "text"), benchmark, n).select(
        "doc_id",
        F.col("_dc_words").alias("n_words"),
        F.coalesce(ones.cast("long"), F.lit(0).cast("long")).alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(ids), ",").cast("binary"), 256).alias("items_sha256"),
        F.col("_dc_mask").isNotNull().alias("contaminated"),
    )


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS) -> DataFrame:
    """``docs`` with hit words cut out of their texts; all other documents are as they were."""
    prefix = unused("_dc_", docs.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                masks = part.column(prefix + "mask").to_pylist()
                at = [r for r, m in enumerate(masks) if m is not None]
                texts = part.column("text")
                if at:
                    words = Words(part.column("text"), ALNUM, True)
                    gone = np.zeros(len(words), bool)
                    for r in at:
                        gone[words.first[r] : words.first[r + 1]] = np.frombuffer(masks[r], np.uint8).astype(bool)
                    new, texts = words.without(gone), texts.to_pylist()
                    for r in at:
                        texts[r] = new[r].decode("utf-8", "replace")
                    texts = pa.array(texts, pa.string())
                names = [c for c in part.schema.names if not c.startswith(prefix)]
                yield pa.RecordBatch.from_arrays([texts if c == "text" else part.column(c) for c in names], names=names)

    return flagged(docs, benchmark, n, prefix).mapInArrow(cut, docs.schema)


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS) -> DataFrame:
    """``docs`` without those that hold any window."""
    prefix = unused("_dc_", docs.columns)
    return flagged(docs, benchmark, n, prefix).where(F.col(prefix + "mask").isNull()).drop(*[prefix + c for c in ("words", "mask", "items")])
