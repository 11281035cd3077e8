"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

*Sketch.* A document's set (distinct word 5-shingles) is thrown into COORDS bins in rounds: in each of the first COORDS
rounds every element falls into one bin by that round's hash; in the rest, round COORDS + i, all elements fall into
bin i, so no bin stays empty. A bin keeps the least (round, hash). Large sets are done after a few rounds, and the share
of equal bins estimates the Jaccard similarity with concentration bounds as for independent samples.
(S. Dahlgaard, M. B. T. Knudsen, M. Thorup, *Fast similarity sketching*, FOCS 2017.)

*Banding.* BANDS bands of ROWS bins, of the first bins; two sets of similarity 0.75 share no band with probability
(1 - 0.75**4)**40 < 3e-7.

*Verification.* Sets with equal digests are one class, represented by its least id. While a chunk of documents is
sketched its sets are at hand, so within the chunk each set is compared with the least of every bucket that it is in, at
once and in full; what is linked is one local component, and leaves the chunk as one row (document, least of the
component) each. Between chunks, a bucket's leasts meet, and each local component is compared with the one that it shares
most buckets with. A pair whose sketches agree too little is ruled out: a pair of similarity 0.75 has
less than 0.58 of the banded bins, or less than 0.664 of all bins, equal with probability < 3e-7. The others are compared
on the full sets, and linked if 100 * intersection >= 75 * union. Components of these links are contracted; in buckets that
still hold several components, pairs *between* components are ruled out or compared in the same way. So every candidate
pair is compared, ruled out, or known to be connected, and of a group of copies only few pairs become rows.

Buckets are combined in each chunk before the exchange: a bucket that a third of all documents share is one entry for
each chunk. Components are found by least-label propagation with pointer jumping, in tables, never on the driver.

Defined results: null, empty and wordless texts have no set, are linked with nothing and kept; a text of fewer than five
words is one shingle; rows with equal ids are one document as far as links go and are kept or dropped together; a row
without an id is linked with nothing, kept, and has no component; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pavilion.llm.blobs import from_planes, planes
from pavilion.llm.tables import least_by, looked_up, trimmed, written
from pavilion.llm.words import SPACED, Words, let_go, mix, slices

SHINGLE, BANDS, ROWS, COORDS, NUMERATOR = 5, 40, 4, 640, 75
BANDED = BANDS * ROWS
#: Rows of a block of a bucket, and the shares of equal banded bins and of all bins (the likely links first) that a pair needs.
BLOCK, LEAST_BANDED, LEAST = 1024, 0.58, (0.75, 0.664)
#: Shingles of a side of a tile at most, or one set.
TILE_SHINGLES = 1 << 20
#: Rows whose sketches are made at once, and rows and shingles of a chunk.
SKETCHED, CHUNK_ROWS, CHUNK_SHINGLES = 2000, 8192, 4 << 20
#: Entries of a range of buckets on average.
BUCKET_ENTRIES = 1 << 17
_ROUND, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_SIGNED = "doc_id long, n long, cls binary, bands array<long>, fine binary, lead long, met boolean, bucket int, data binary"
_NAMES = [field.split(" ")[0] for field in _SIGNED.split(", ")]


def shingle_sets(column: pa.Array, length: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word counts, then hashes of each row's distinct shingles, row after row and sorted, with the offsets of rows."""
    words = Words(column, SPACED, True)
    hashes, counts = words.hashes(), words.counts
    runs, ok = words.windows(hashes, length), words.whole(length)
    every, rows = [runs[ok]], [words.rows[: len(runs)][ok]]
    for short in range(1, length):
        at = np.flatnonzero(counts == short)
        every.append(words.windows(hashes, short)[words.first[at]] if len(at) else np.empty(0, np.uint64))
        rows.append(at)
    every, rows = np.concatenate(every), np.concatenate(rows)
    order = np.lexsort((every, rows))
    every, rows = every[order], rows[order]
    keep = np.r_[True, (every[1:] != every[:-1]) | (rows[1:] != rows[:-1])] if len(every) else np.empty(0, bool)
    every, rows = every[keep], rows[keep]
    return counts, every, np.searchsorted(rows, np.arange(len(counts) + 1))


def sketches(sets: np.ndarray, offsets: np.ndarray, coords: int = COORDS) -> np.ndarray:
    """A row of ``coords`` values for each set, of 60 bits and the round's number in place of the rest by mixing."""
    n = len(offsets) - 1
    out = np.zeros(n * coords, np.uint64)
    sizes = np.diff(offsets)
    rows = np.repeat(np.arange(n), sizes)
    live = sizes > 0
    empty = np.ones(n * coords, bool)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for turn in range(2 * coords):
        if not live.any():
            break
        use = live[rows]
        if not use.all():
            sets, rows = sets[use], rows[use]
        value = mix(sets ^ np.uint64((turn + 1) * _ROUND & _MASK))
        if turn < coords:
            bins = ((value >> np.uint64(32)) * np.uint64(coords) >> np.uint64(32)).astype(np.int64)
            cell = rows * coords + bins
            value = mix(value)
        else:
            cell = rows * coords + (turn - coords)
        free = empty[cell]
        cell, value = cell[free], value[free]
        if len(cell):
            least = out  # cells are empty, so they may be written
            least[cell] = top
            np.minimum.at(least, cell, value)
            empty[cell] = False
        live &= empty.reshape(n, coords).any(axis=1) if turn % 4 == 3 or turn >= coords else live
    return out.reshape(n, coords)


def band_hashes(sketch: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A hash of each band of the first bins."""
    parts = sketch[:, : bands * ROWS].reshape(len(sketch), bands, ROWS)
    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(_ROUND), parts.shape[:2]).copy()
    for k in range(ROWS):
        acc = mix(acc ^ parts[:, :, k])
    return acc


def signatures(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows of two kinds, from one pass over the texts.

    Of each document: doc_id, n (size of the set), cls (a 128-bit digest of the set), bands (64-bit hashes), fine (a byte of
    each bin), lead (the least id of its local component) and met (whether it shares a bucket with others of its chunk).
    From cls on, these are null if the set is empty or the document has no id. Of each chunk and bucket: bucket and data.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for part in slices(batch, rows=SKETCHED):
                _, sets, offs = shingle_sets(part.column("text"))
                sizes = np.diff(offs)
                sums = [np.r_[np.uint64(0), np.cumsum(mix(sets + np.uint64(k)))][offs] for k in (1, 2)]
                cls = np.stack([mix(x[1:] - x[:-1] + sizes.astype(np.uint64)) for x in sums], axis=1)
                sketch = sketches(sets, offs)
                held.append((part.column("doc_id").cast(pa.int64()), sizes, cls, band_hashes(sketch), sketch.astype(np.uint8), sets))
                if sum(len(x[1]) for x in held) >= CHUNK_ROWS or sum(len(x[5]) for x in held) >= CHUNK_SHINGLES:
                    yield from signed(held)
                    held = []
        if held:
            yield from signed(held)
        let_go()

    def signed(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids = pa.concat_arrays([x[0] for x in held])
        sizes, cls, bands, fine, sets = (np.concatenate([x[k] for x in held]) for k in range(1, 6))
        offs, some = np.r_[0, np.cumsum(sizes)], (sizes > 0) & ids.is_valid().to_numpy(zero_copy_only=False)
        numbers = ids.fill_null(0).to_numpy().astype(np.int64)
        rows = np.flatnonzero(some)
        rows = rows[np.argsort(numbers[rows], kind="stable")]
        _, own, of = np.unique(np.ascontiguousarray(cls[rows]).view("V16").ravel(), return_index=True, return_inverse=True)
        rank = np.argsort(own)  # classes in the order of their least ids
        own, place = rows[own[rank]], np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        h, first, pairs = _stars(bands[own])
        roots = _linked(pairs, fine[own], [sets[offs[r] : offs[r + 1]] for r in own.tolist()])
        least, met = numbers[own[roots]], np.zeros(len(own), bool)
        met[pairs.ravel()] = True
        lead, shared = np.zeros(len(some), np.int64), np.zeros(len(some), bool)
        lead[rows], shared[rows] = least[place[of]], met[place[of]]
        listed = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * BANDS), pa.array(bands.view(np.int64).ravel()), mask=pa.array(~some))
        binary = lambda x: pa.array([r.tobytes() if ok else None for r, ok in zip(x, some, strict=True)], pa.binary())
        n = len(some)
        yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), binary(cls), listed, binary(fine), pa.array(lead, mask=~some), pa.array(shared, mask=~some), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=_NAMES)
        # A bucket is one entry: hash, id of its least, by how much the least of that one's component is less, size.
        d, c, s = numbers[own[first]].view(np.uint64), least[first].view(np.uint64), sizes[own[first]].astype(np.uint64)
        to = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        cuts = np.r_[np.flatnonzero(np.r_[True, to[1:] != to[:-1]]), len(to)] if len(to) else np.zeros(1, int)
        sent = [planes(h[x:z], 8) + planes(d[x:z], 8) + planes(d[x:z] - c[x:z], 8) + planes(s[x:z], 4) for x, z in zip(cuts, cuts[1:], strict=False)]
        n = len(sent)
        yield pa.RecordBatch.from_arrays([*[pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.bool_())], pa.array(to[cuts[:-1]], pa.int32()), pa.array(sent, pa.binary())], names=_NAMES)

    return docs.select("doc_id", "text").mapInArrow(sign, _SIGNED)


def _stars(bands: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sets in the order of their ids: the buckets in order, the least set of each, and the distinct pairs of other sets with it."""
    hashes, rows = bands.ravel(), np.repeat(np.arange(len(bands)), bands.shape[1])
    order = np.argsort(hashes, kind="stable")
    h, d = hashes[order], rows[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, int)
    lead = np.repeat(d[first], np.diff(np.r_[first, len(h)]))
    pair = lead != d
    keys = np.unique(d[pair] * len(bands) + lead[pair])
    return h[first], d[first], np.stack([keys // max(1, len(bands)), keys % max(1, len(bands))], axis=1)


def _linked(pairs: np.ndarray, fine: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """The least set of each set's component by links among the pairs, the likeliest ones compared first."""
    sizes, parent = np.array([len(s) for s in sets], np.int64), list(range(len(sets)))
    pairs = pairs[_able(sizes[pairs[:, 0]], sizes[pairs[:, 1]])]
    share = np.concatenate([(fine[p[:, 0], :BANDED] == fine[p[:, 1], :BANDED]).mean(axis=1) for p in np.split(pairs, range(1 << 14, len(pairs), 1 << 14))])
    order = np.argsort(-share, kind="stable")
    for x, y in pairs[order[share[order] >= LEAST_BANDED]].tolist():
        a, b = _root(parent, x), _root(parent, y)
        if a != b and _similar(sets[x], sets[y]):
            parent[max(a, b)] = min(a, b)
    return np.array([_root(parent, x) for x in range(len(sets))], np.int64)


def _root(parent: list[int] | dict[int, int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets of hashes are linked."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")  # two runs: merged
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return same > 0 and 100 * same >= NUMERATOR * (len(both) - same)


def _able(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sets whose sizes differ too much can't be linked."""
    return 100 * np.minimum(x, y) >= NUMERATOR * np.maximum(x, y)


def meetings(signed: DataFrame, parts: int) -> DataFrame:
    """Of chunks whose buckets meet: a row (a, null) of each set that is in a bucket with others, and rows (a, b).

    Among the leasts that chunks have sent for a bucket, each is paired with the least of all. Of all pairs that join a local
    component to others, the one to the component that it shares most buckets with goes on: it is the likeliest link, and
    what it leaves apart is compared between components later.
    """

    def meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        h, d, c, s = _columns(table, (8, 8, 8, 4))
        d, c, s = d.view(np.int64), (d - c).view(np.int64), s.astype(np.int64)
        order = np.lexsort((d, h))
        h, d, c, s = h[order], d[order], c[order], s[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        lead = np.repeat(first, np.diff(np.r_[first, len(h)]))
        pair = np.flatnonzero(lead != np.arange(len(h)))
        lead = lead[pair]
        met = np.unique(np.r_[d[pair], d[lead]])
        able = _able(s[pair], s[lead]) & (d[pair] != d[lead])
        pair, lead = pair[able], lead[able]
        every, counts = np.unique(np.stack([c[pair], c[lead], d[pair], d[lead]], axis=1), axis=0, return_counts=True)
        rows = [(0, *x) for x in _dealt(met, [met], (8,), parts)] + [(1, *x) for x in _dealt(every[:, 0], [*every.T, counts], (8, 8, 8, 8, 4), parts)]
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["kind", "part", "data"])

    def choose(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()
        met = np.unique(_columns(table.filter(pa.array(kinds == 0)), (8,))[0].view(np.int64))
        *four, w = (x.view(np.int64) for x in _columns(table.filter(pa.array(kinds == 1)), (8, 8, 8, 8, 4)))
        every, at = np.unique(np.stack(four, axis=1), axis=0, return_inverse=True)
        w = np.bincount(at.ravel(), w, len(every)).astype(np.int64)
        ends = np.flatnonzero(np.r_[(every[1:, :2] != every[:-1, :2]).any(axis=1), True]) if len(every) else np.empty(0, int)
        of = np.searchsorted(ends, np.arange(len(every)))  # pairs of the same two components
        order = np.lexsort((w, np.bincount(of, w, len(ends))[of] if len(every) else w, every[:, 0]))
        best = every[order][np.flatnonzero(np.r_[every[order[1:], 0] != every[order[:-1], 0], True])] if len(every) else every
        return pa.table([pa.array(np.r_[best[:, 2], met], pa.int64()), pa.concat_arrays([pa.array(best[:, 3], pa.int64()), pa.nulls(len(met), pa.int64())])], names=["a", "b"])

    met = signed.where("bucket is not null").select("bucket", "data").groupBy("bucket").applyInArrow(meet, "kind int, part int, data binary")
    return met.groupBy("part").applyInArrow(choose, "a long, b long")


def _columns(table: pa.Table, widths: tuple[int, ...]) -> list[np.ndarray]:
    """The columns of rows that :func:`_dealt` or a chunk has packed, one after another with so many bytes a value."""
    out: list[list[np.ndarray]] = [[np.empty(0, np.uint64)] for _ in widths]
    for data in table.column("data").to_pylist():
        n, at = len(data) // sum(widths), 0
        for to, width in zip(out, widths, strict=True):
            to.append(from_planes(data[at * n : (at + width) * n], width))
            at += width
    return [np.concatenate(x) for x in out]


def _dealt(key: np.ndarray, columns: list[np.ndarray], widths: tuple[int, ...], parts: int) -> Iterator[tuple[int, bytes]]:
    """The columns packed for each part that has rows, dealt by the hash of ``key``."""
    to = ((mix(key.astype(np.uint64) + np.uint64(1)) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
        if len(rows):
            yield int(to[rows[0]]), b"".join(planes(x[rows].astype(np.uint64), width) for x, width in zip(columns, widths, strict=True))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. ``texts``: doc_id and text of every document that is in a pair."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for outer in slices(batch, "ta", 2 << 20):
                for part in slices(outer, "tb", 2 << 20):
                    (_, x, ox), (_, y, oy) = shingle_sets(part.column("ta")), shingle_sets(part.column("tb"))
                    n = part.num_rows
                    row = np.concatenate([np.repeat(np.arange(n), np.diff(ox)), np.repeat(np.arange(n), np.diff(oy))])
                    both = np.concatenate([x, y])
                    order = np.lexsort((both, row))
                    both, row = both[order], row[order]
                    same = np.bincount(row[1:][(both[1:] == both[:-1]) & (row[1:] == row[:-1])], minlength=n) if len(row) else np.zeros(n, int)
                    union = np.diff(ox) + np.diff(oy) - same
                    ok = (100 * same >= NUMERATOR * union) & (same > 0)
                    yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(ok)) for c in ("a", "b")], names=["a", "b"])

    one = pairs.select("a", "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    two = looked_up(one, texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b", "a")
    return two.select("a", "b", "ta", "tb").mapInArrow(compare, "a long, b long")


def _kept(df: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """Written once the executors have let go of what the steps before left.

    These steps are many and short, of tasks whose sorts and sums take a page of memory however few rows they have: the
    garbage of some steps makes a heap grow to its bound, where the memory of an executor has no room for a moment's more.
    """
    trimmed(df.sparkSession)
    return written(df, name, most)


def components(links: DataFrame) -> DataFrame:
    """(v, comp): every vertex of the links with the least vertex that it reaches."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    n = 2 * links.count()
    edges = _kept(both.distinct(), "edges", n)
    labels = _kept(edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("l")).select("v", F.least("v", "l").alias("comp")), "labels", n)
    while True:
        heard = looked_up(edges, labels, "v", "u").groupBy("u").agg(F.min("comp").alias("m")).withColumnRenamed("u", "v")
        least = labels.join(heard, "v").select("v", F.col("comp").alias("was"), F.least("comp", "m").alias("comp"))
        roots = labels.select(F.col("v").alias("comp"), F.col("comp").alias("root"))
        new = _kept(looked_up(least, roots, "comp", "v", "left").select("v", "was", F.least("comp", F.coalesce("root", "comp")).alias("comp")), "labels", n)
        labels = new.select("v", "comp")
        if new.where("was <> comp").isEmpty():
            return labels


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose sketches agree in enough of the banded bins."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BANDED) for c in ("fa", "fb"))
            ok = pa.array((x == y).mean(axis=1) >= LEAST_BANDED) if batch.num_rows else pa.array([], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in ("a", "b")], names=["a", "b"])

    own = nodes.select("rep", F.substring("fine", 1, BANDED).alias("f"))
    one = pairs.join(own.select(F.col("rep").alias("a"), F.col("f").alias("fa")).hint("merge"), "a")
    two = looked_up(one, own.select(F.col("rep").alias("b"), F.col("f").alias("fb")), "b", "a")
    return two.select("a", "b", "fa", "fb").mapInArrow(keep, "a long, b long").distinct()


def between(nodes: DataFrame, labels: DataFrame, least: float, below: float) -> DataFrame:
    """Pairs of sets that share a bucket but no component and agree in ``least`` of all bins or more, but not in ``below``.

    A bucket of many rows is dealt in blocks, a task for each pair of blocks; a pair that shares several buckets comes from
    the first one alone, by the bands' own hashes: bands whose bins only agree in ``fine`` needn't share a bucket. Pairs are
    packed in tiles whose sets are of bounded size together: a row (tile, null, pairs), and a row (tile, v, null) for each set.
    """
    near = nodes.join(labels, nodes.rep == labels.v).select("rep", "n", "comp", F.posexplode("bands").alias("nth", "band"))
    mixed = near.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m")).where("lo <> hi")
    left = near.join(mixed.select("band", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "band")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = left.join(nodes.select("rep", "fine", "bands"), "rep").withColumn("block", block).select("*", F.explode(F.expr("sequence(0, blocks - 1)")).alias("_o"))
    dealt = dealt.select("band", "nth", "rep", "n", "comp", "fine", "bands", "block", F.least("block", "_o").alias("i"), F.greatest("block", "_o").alias("j"))
    most = TILE_SHINGLES

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, sizes, comps, blocks = (table.column(c).to_numpy().astype(np.int64) for c in ("rep", "n", "comp", "block"))
        fine = np.frombuffer(b"".join(table.column("fine").to_pylist()), np.uint8).reshape(len(ids), -1)
        bands, nth, one = pc.list_flatten(table.column("bands")).to_numpy().reshape(len(ids), BANDS), table.column("nth")[0].as_py(), key[1].as_py() == key[2].as_py()
        values, counts = np.unique(comps, return_counts=True)
        outside = comps != values[counts.argmax()]  # a pair between components has an end here
        rank = np.where(outside, np.arange(len(ids)), len(ids))
        found = [np.empty((0, 2), np.int64)]
        for x in np.flatnonzero(outside).tolist():
            y = np.flatnonzero((comps != comps[x]) & (rank > x) & (one | (blocks != blocks[x])) & _able(sizes, sizes[x]))
            share = (fine[y] == fine[x]).mean(axis=1) if len(y) else np.empty(0)
            y = y[(share >= least) & (share < below)]
            y = y[(bands[y] == bands[x]).argmax(axis=1) == nth] if len(y) else y
            found.append(np.stack([np.full(len(y), x), y], axis=1))
        found = np.concatenate(found)
        used = np.unique(found)
        tile = np.zeros(len(ids), np.int64)
        tile[used] = np.cumsum(sizes[used]) // most
        of = tile[found[:, 0]] * len(ids) + tile[found[:, 1]]
        order = np.argsort(of, kind="stable")
        tiles, sets, packs = [], [], []
        for rows in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
            if len(rows):
                name = _named(*[k.as_py() for k in key], int(of[rows[0]]))
                own = ids[np.unique(found[rows])]
                tiles += [name] * (len(own) + 1)
                sets += [None, *own.tolist()]
                packs += [planes(ids[found[rows, 0]].view(np.uint64), 8) + planes(ids[found[rows, 1]].view(np.uint64), 8), *[None] * len(own)]
        return pa.table([pa.array(tiles, pa.int64()), pa.array(sets, pa.int64()), pa.array(packs, pa.binary())], names=["tile", "v", "data"])

    return dealt.groupBy("band", "i", "j").applyInArrow(compare, "tile long, v long, data binary")


def _named(*parts: int) -> int:
    """A 64-bit name."""
    out = np.zeros(1, np.uint64)
    for part in parts:
        out = mix(out ^ np.uint64(part & _MASK))
    return int(out.view(np.int64)[0])


def linked_across(tiles: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) among the tiles' pairs, found on full sets; a pair that a tile's other links connect isn't compared."""

    def judge(table: pa.Table) -> pa.Table:
        x, y = (c.view(np.int64).tolist() for c in _columns(table.filter(pc.is_valid(table.column("data"))), (8, 8)))
        sets: dict[int, list[np.ndarray]] = {}
        for batch in table.filter(pc.is_valid(table.column("v"))).select(["v", "text"]).combine_chunks().to_batches():
            for part in slices(batch):
                _, own, offs = shingle_sets(part.column("text"))
                for k, v in enumerate(part.column("v").to_pylist()):
                    sets.setdefault(v, []).append(own[offs[k] : offs[k + 1]])
        parent, found = {v: v for v in sets}, []
        for a, b in zip(x, y, strict=True):
            r, s = _root(parent, a), _root(parent, b)
            if r != s and any(_similar(p, q) for p in sets[a] for q in sets[b]):
                parent[max(r, s)] = min(r, s)
                found.append((max(a, b), min(a, b)))
        let_go()
        return pa.table([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    sent = tiles.where("v is not null").join(texts.select(F.col("doc_id").alias("v"), "text"), "v").select("tile", "v", "data", "text")
    packs = tiles.where("v is null").select("tile", "v", "data", F.lit(None).cast("string").alias("text"))
    return sent.unionByName(packs).groupBy("tile").applyInArrow(judge, "a long, b long").distinct()


def clustered(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id and kept."""
    buckets = max(1, docs.count() * BANDS // BUCKET_ENTRIES)
    signed = _kept(signatures(docs, buckets), "signatures")
    named = signed.where("cls is not null")
    reps = least_by(named, ["cls"], "doc_id", "doc_id").select("cls", F.col("doc_id").alias("rep"))
    members = _kept(looked_up(named.select("doc_id", "n", "cls", "lead", "met"), reps, "cls", "doc_id").select("doc_id", "n", "rep", "lead", "met"), "members")
    found = _kept(meetings(signed, buckets), "meetings")
    n, far = members.count(), found.count()
    # Pairs of documents become pairs of their classes' representatives.
    of = members.select("doc_id", "rep").distinct()
    joined = found.where("b is not null").join(of.select(F.col("doc_id").alias("a"), F.col("rep").alias("ra")), "a")
    joined = looked_up(joined, of.select(F.col("doc_id").alias("b"), F.col("rep").alias("rb")), "b", "a")
    pairs = _kept(_pairs(joined.select("ra", "rb")), "pairs", far)
    local = looked_up(members.where("lead <> doc_id").select("lead", "rep"), of.select(F.col("doc_id").alias("lead"), F.col("rep").alias("rb")), "lead", "rep")
    several = of.groupBy("doc_id").agg(F.min("rep").alias("rb"), F.count("*").alias("m")).where("m > 1")
    known = _pairs(local.select(F.col("rep").alias("ra"), "rb").unionByName(looked_up(of, several, "doc_id", "rep").select(F.col("rep").alias("ra"), "rb")))
    away = found.select(F.explode(F.array("a", "b")).alias("doc_id")).where("doc_id is not null").distinct()
    # Merge joins whatever the sizes: what a run moves then follows the input, and no side has to fit a broadcast.
    ids = _kept(members.where("met").select("rep").unionByName(of.join(away.hint("merge"), "doc_id", "left_semi").select("rep")).distinct(), "touched", n)
    nodes = _kept(named.select(F.col("doc_id").alias("rep"), "n", "bands", "fine").join(ids.hint("merge"), "rep", "left_semi"), "nodes")
    texts = _kept(docs.where("text is not null").select("doc_id", "text").join(ids.withColumnRenamed("rep", "doc_id").hint("merge"), "doc_id", "left_semi"), "texts")
    close = _kept(likely(pairs, nodes), "likely", far)
    links = _kept(known.unionByName(verified(close, texts)).distinct(), "links", n + far)
    touched = ids.select(F.col("rep").alias("v"))
    labels = _labelled(links, touched)
    below = 2.0
    for least in LEAST:
        tiles = _kept(between(nodes, labels, least, below), "tiles")
        extra = _kept(linked_across(tiles, texts), "links", tiles.count())
        if not extra.isEmpty():
            links = links.unionByName(extra)
            labels = _labelled(links, touched)
        below = least
    comps = labels.select(F.col("v").alias("rep"), "comp")
    done = looked_up(members, comps, "rep", "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "rep").alias("component_id"))
    trimmed(docs.sparkSession)
    rest = signed.where("cls is null and bucket is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return done.unionByName(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _pairs(found: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of different representatives ra and rb, a the greater one."""
    return found.where("ra <> rb").select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct()


def _labelled(links: DataFrame, touched: DataFrame) -> DataFrame:
    """Components of the links; a touched vertex without a link is its own."""
    found = components(links)
    return found.unionByName(touched.join(found, "v", "left_anti").select("v", F.col("v").alias("comp")))


def digest(docs: DataFrame) -> DataFrame:
    return clustered(docs.select("doc_id", "text"))


def representatives(docs: DataFrame) -> DataFrame:
    """The documents that are kept, one of each component, with all their columns."""
    gone = clustered(docs.select("doc_id", "text")).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
