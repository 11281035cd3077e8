"""Sharding by histogram sort, in DataFrame functions alone.

Rows are ordered by (hash of the text, doc_id), so equal texts are neighbours. The exact bytes and rows below candidate
boundaries are counted across all partitions; only the intervals in which a shard's boundary still lies are split again,
2**PROBE_BITS ways a round, until each boundary is within tolerance of its ideal place. Then rows are exchanged once.

Law ``bytes``: boundary j is where j/shards of all bytes lie below. A group of equal texts stays whole if a boundary at
its edge is within TOLERANCE of a shard's ideal size; a larger group is split by doc_id, so that a text with a third of
all copies is dealt over a third of the shards. Within a shard, rows take slots in key order. The slots are numbered
within RANGES ranges a shard (whose exact row counts the same histogram has), so no task gets a whole shard.

What reaches the driver is the histogram: at most 2**PROBE_BITS numbers for each boundary and round.

Defined results: a null text has 8 bytes of size, checksum 0 and a key of its own; null ids come first among equal texts;
repeated rows are rows; an empty table gives no rows; other columns are ignored by :func:`assigned` and kept by
:func:`sharded`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pavilion.llm.tables import written

SHARDS, OVERHEAD = 24, 8
#: An interval is split 2**PROBE_BITS ways in a round; ranges of a shard, and share of a shard's size that whole groups may cost.
PROBE_BITS, RANGES, TOLERANCE = 10, 8, 0.01
_HALF, _MASK = 1 << 63, (1 << 64) - 1


@dataclass
class Cell:
    """Keys of a group that share their first ``bits`` bits; bytes and rows of all keys before, and of these."""

    group: int
    bits: int
    prefix: int
    below: int = 0
    rows_below: int = 0
    size: int = 0
    rows: int = 0


def keyed(docs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id, size, text_crc32 and the sort key: two numbers below 2**63 and 2**64 in signed order; if ``whole``, the row, too."""
    text = F.col("text")
    size = F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long")) + F.lit(OVERHEAD).cast("long")
    crc = F.coalesce(F.crc32(text.cast("binary")), F.lit(0).cast("long"))
    keys = ["doc_id", size.alias("size"), crc.alias("text_crc32"), F.xxhash64(text).alias("k1"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k2")]
    return docs.select(*keys, *([F.struct(*docs.columns).alias("row")] if whole else []))


def _refined(rows: DataFrame, width: int, cells: dict[int, Cell], targets: list[int]) -> dict[int, Cell]:
    """One round: counts the parts of all open cells, and gives for each target the part in which it lies.

    ``rows`` has g (group), u (a key of ``width`` bits) and size. A target beyond all rows gets the last part.
    """
    bits = next(iter(cells.values())).bits
    more = min(width, bits + PROBE_BITS)
    part = F.shiftrightunsigned("u", width - more) if width > more else F.col("u")
    if bits:
        rows = rows.where(F.shiftrightunsigned("u", width - bits).isin(sorted({c.prefix for c in cells.values()})))
    counted: dict[tuple[int, int], list] = {}
    for r in rows.groupBy("g", part.alias("p")).agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        prefix = (r.p & _MASK) >> (more - bits)
        counted.setdefault((r.g, prefix), []).append((r.p & _MASK, r.b, r.n))
    out = {}
    for t, c in cells.items():
        below, rows_below = c.below, c.rows_below
        for p, size, n in sorted(counted[c.group, c.prefix]):
            out[t] = Cell(c.group, more, p, below, rows_below, size, n)
            if below + size > targets[t]:
                break
            below, rows_below = below + size, rows_below + n
    return out


def _settled(cell: Cell, target: int, width: int, gap: int) -> tuple[int, int] | None:
    """The edge of the cell near the target and the rows below it, if they are no more than ``gap`` bytes apart."""
    low, high = abs(target - cell.below), abs(cell.below + cell.size - target)
    if min(low, high) > gap:
        return None
    return (cell.prefix << (width - cell.bits), cell.rows_below) if low <= high else (cell.prefix + 1 << (width - cell.bits), cell.rows_below + cell.rows)


def splitters(rows: DataFrame, targets: list[int], tolerance: int) -> list[tuple[int, int, int]]:
    """For each target (bytes below): the first key (k1, k2) above the boundary, and the rows below it.

    A boundary lies between two different keys. It is exact to the row, or between groups if that is within ``tolerance``.
    """
    if not targets or rows.isEmpty():
        return [(_HALF, -_HALF, 0) for _ in targets]
    found: dict[int, tuple[int, int, int]] = {}
    keys = rows.select(F.lit(0).cast("long").alias("g"), F.col("k1").bitwiseXOR(F.lit(-_HALF)).alias("u"), "size")
    open_, inner = {t: Cell(0, 0, 0) for t in range(len(targets))}, {}
    while open_:
        parts, open_ = _refined(keys, 64, open_, targets), {}
        for t, cell in parts.items():
            if edge := _settled(cell, targets[t], 64, tolerance if cell.bits == 64 else tolerance // 4):
                found[t] = (edge[0] - _HALF, -_HALF, edge[1])
            else:
                (inner if cell.bits == 64 else open_)[t] = cell
    if inner:  # boundaries inside groups of equal texts: by the second key, counted from the least one there
        wanted = sorted({c.prefix - _HALF for c in inner.values()})
        own = rows.where(F.col("k1").isin(wanted))
        least, most = own.agg(F.min("k2"), F.max("k2")).first()
        width = max(1, (most - least).bit_length())
        shifted = F.col("k2") - F.lit(least) if most - least < _HALF else F.col("k2").bitwiseXOR(F.lit(-_HALF))
        least = least if most - least < _HALF else -_HALF
        keys = own.select(F.col("k1").alias("g"), shifted.alias("u"), "size")
        open_ = {t: Cell(c.prefix - _HALF, 0, 0, c.below, c.rows_below) for t, c in inner.items()}
        while open_:
            parts, open_ = _refined(keys, width, open_, targets), {}
            for t, cell in parts.items():
                if cell.bits == width or _settled(cell, targets[t], width, 0):
                    edge, below = _settled(cell, targets[t], width, _MASK)
                    found[t] = (cell.group, edge + least, below)
                else:
                    open_[t] = cell
    return [found[t] for t in range(len(targets))]


def _beyond(points: list[tuple[int, int, int]]) -> Column:
    """How many of the points are at or below a row's key."""
    points = [(a, b) for a, b, _ in points if a < _HALF and b < _HALF]
    if not points:
        return F.lit(0)
    at = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in points])
    return F.size(F.filter(at, lambda p: (F.col("k1") > p.a) | ((F.col("k1") == p.a) & (F.col("k2") >= p.b))))


def assigned(docs: DataFrame, shards: int = SHARDS, ranges: int = RANGES, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law) of every row."""
    dealt = _dealt(written(keyed(docs), "shard-keys"), shards, ranges, tolerance)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _dealt(rows: DataFrame, shards: int, ranges: int, tolerance: float) -> DataFrame:
    """The keyed rows with shard and slot."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    ideal = total / shards
    cuts = splitters(rows, [round(ideal * j) for j in range(1, shards)], int(ideal * tolerance))
    fine = splitters(rows, [round(ideal * j / ranges) for j in range(1, shards * ranges) if j % ranges], int(ideal * tolerance / ranges))
    cuts, fine = sorted(cuts), sorted(fine)
    spread = rows.withColumn("shard", _beyond(cuts)).withColumn("_range", _beyond(fine))
    # The rows below a range in its shard follow from the histogram; a small table of (shards x ranges) numbers at most.
    first = spread.groupBy("shard", "_range").agg(F.count("*").alias("_n"))
    before = "sum(_n) over (partition by shard order by _range rows between unbounded preceding and 1 preceding)"
    first = first.select("shard", "_range", F.expr(f"coalesce({before}, 0)").alias("_before"))
    slot = F.expr("row_number() over (partition by shard, _range order by k1, k2, text_crc32, size)") - 1
    dealt = spread.select("*", slot.alias("_at")).join(F.broadcast(first), ["shard", "_range"])
    return dealt.withColumn("shard", F.col("shard").cast("int")).withColumn("slot", (F.col("_at") + F.col("_before")).cast("long"))


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Every row of the documents with its shard and slot, whatever ids it shares; columns of these names are replaced."""
    rows = _dealt(written(keyed(docs, whole=True), "shard-rows"), shards, RANGES, TOLERANCE)
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in ("shard", "slot")]
    return rows.select(*kept, "shard", "slot")
