"""Decontamination, near and substring dedup, packing, toxicity and token counts against plain versions."""

import random
import zlib

import pytest
from tests.llm import brute

from pavilion.llm import blobs, decontam, near_dedup, packing, substring_dedup, token_counts, toxicity

SCHEMA = "doc_id long, text string, _salt string, bucket int"


def corpus(seed=1, n=60):
    """Random texts with nulls, empty and long ones, copies, near copies and shared passages."""
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "MI", "né", "st") for b in ("ra", "To", "x9", "ön", "")]
    text = lambda k: rng.choice([" ", "\n", "  \t"]).join(rng.choice(vocabulary) + rng.choice(["", "", ".", ",!"]) for _ in range(k))
    passage, rows = text(30), []
    for k in range(n):
        kind = k % 10
        if kind == 0:
            t = passage
        elif kind == 1 and rows:
            t = rng.choice(rows)[1]
        elif kind == 2 and rows:
            words = (rng.choice(rows)[1] or "a b").split()
            for _ in range(max(1, len(words) // 40)):
                words[rng.randrange(len(words))] = "changed"
            t = " ".join(words)
        elif kind == 3:
            t = text(20) + " " + passage + " " + text(15)
        else:
            t = text(rng.choice([1, 3, 5, 12, 13, 40, 200]))
        rows.append((k * 7 % n, t))
    return [*rows, (1000, None), (1001, ""), (1002, " \n\t "), (1003, text(6000)), (1004, "word"), (1004, "word"), (None, passage), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 7) for i, t in corpus()], SCHEMA).repartition(5)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_decontamination(spark, docs):
    passage = corpus()[0][1]
    items = [(3, passage), (11, None), (12, ""), (2, "word"), (2, "word"), (None, passage.upper()), (40, "not there at all"), (5, " ".join(passage.split()[:9]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = rows_of(decontam.digest(docs, benchmark), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(brute.decontaminated(corpus(), items), key=str)
    empty = benchmark.limit(0)
    assert not any(r.contaminated for r in decontam.digest(docs, empty).collect())
    assert decontam.digest(docs.limit(0), benchmark).count() == 0


def test_decontamination_in_blocks(spark, docs, monkeypatch):
    items = [(k, t) for k, (_, t) in enumerate(corpus()) if t][:12]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    whole = rows_of(decontam.digest(docs, benchmark), "doc_id", "n_words", "n_hit", "n_items", "items_sha256")
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 700)
    assert rows_of(decontam.digest(docs, benchmark), "doc_id", "n_words", "n_hit", "n_items", "items_sha256") == whole


def test_decontamination_holds_one_block(spark, docs, monkeypatch):
    """A block is scanned for, and let go, before the next one is made."""
    import gc
    import weakref

    held, most, made = weakref.WeakSet(), [], decontam.NGrams.__init__

    def counted(self, *args):
        gc.collect()
        made(self, *args)
        held.add(self)
        most.append(len(held))

    items = [(k, t) for k, (_, t) in enumerate(corpus()) if t][:12]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 700)
    monkeypatch.setattr(decontam.NGrams, "__init__", counted)
    decontam.flagged(docs, benchmark)
    assert len(most) > 2 and max(most) == 1


def test_decontamination_cuts_spans(spark, docs):
    benchmark = spark.createDataFrame([(1, corpus()[0][1])], "item_id long, text string")
    cut = decontam.remove_spans(docs, benchmark)
    assert cut.schema == docs.schema and cut.count() == docs.count()
    assert not any(r.contaminated for r in decontam.digest(cut, benchmark).collect())
    before = {r.doc_id for r in decontam.digest(docs, benchmark).collect() if not r.contaminated and r.doc_id is not None}
    old, new = ({(r.doc_id, r.text) for r in df.collect() if r.doc_id in before} for df in (docs, cut))
    assert old == new
    assert decontam.remove_documents(docs, benchmark).count() == sum(not r.contaminated for r in decontam.digest(docs, benchmark).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(spark, seed, monkeypatch):
    monkeypatch.setattr(substring_dedup, "GROUP_BYTES", 6000)
    monkeypatch.setattr(blobs, "GROUP_BYTES", 6000)
    monkeypatch.setattr(blobs, "PIECE_BYTES", 1500)
    monkeypatch.setattr(substring_dedup, "BUCKET_HASHES", 500)
    data = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in data], SCHEMA)
    got = rows_of(substring_dedup.digest(docs), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(brute.repeats(data), key=str)
    cut = substring_dedup.remove_repeats(docs)
    assert cut.schema.names == docs.schema.names
    removed = {r.doc_id for r in substring_dedup.digest(docs).collect() if r.n_removed}
    assert {(r.doc_id, r.text) for r in cut.collect() if r.doc_id not in removed} == {(i, t) for i, t in data if i not in removed}


def test_substring_dedup_of_nothing(spark, docs):
    assert substring_dedup.digest(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_near_dedup(spark, seed):
    data = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in data], SCHEMA)
    got = rows_of(near_dedup.clustered(docs), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(brute.components(data), key=str)


@pytest.mark.parametrize(("rows", "hashes"), [(5, 200), (40, 2 << 20)])
def test_near_dedup_of_many_chunks(spark, monkeypatch, rows, hashes):
    """Chunks of a few documents and many bucket ranges; rows that share an id are one document, whatever their texts."""
    monkeypatch.setattr(near_dedup, "CHUNK_ROWS", rows)
    monkeypatch.setattr(near_dedup, "SKETCHED", rows)
    monkeypatch.setattr(near_dedup, "BUCKET_ENTRIES", hashes)
    data = corpus(3, 90)
    data += [(3, data[7][1]), (3, "quite another text of more than five words"), (2000, "quite another text of more than five words")]
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in data], SCHEMA).repartition(3)
    got = rows_of(near_dedup.clustered(docs), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(brute.components(data), key=str)


def test_near_dedup_keeps_columns(spark, docs):
    kept = near_dedup.representatives(docs)
    assert kept.columns == docs.columns
    wanted = {r.doc_id for r in near_dedup.clustered(docs).collect() if r.kept}
    assert {r.doc_id for r in kept.collect()} == wanted
    assert near_dedup.clustered(docs.limit(0)).count() == 0


def test_near_dedup_collects_before_each_step(spark, docs, monkeypatch):
    """What one step leaves in the executors is gone before the next one writes, and before the caller does."""
    seen, trimmed, written = [], near_dedup.trimmed, near_dedup.written
    monkeypatch.setattr(near_dedup, "trimmed", lambda *a: seen.append("trim") or trimmed(*a))
    monkeypatch.setattr(near_dedup, "written", lambda *a, **b: seen.append("write") or written(*a, **b))
    near_dedup.clustered(docs)
    writes = [k for k, x in enumerate(seen) if x == "write"]
    assert len(writes) > 10 and all(seen[k - 1] == "trim" for k in writes) and seen[0] == seen[-1] == "trim"


def test_near_dedup_between_components(spark):
    """A chain of near copies around a hub, where stars alone don't find every link."""
    rng = random.Random(5)
    base, data = [f"w{k}" for k in range(160)], []
    for k in range(90):
        words = list(base)
        for _ in range(rng.choice([2, 4, 5, 6, 8])):
            words[rng.randrange(160)] = f"c{k}_{rng.random()}"
        data.append((k, " ".join(words)))
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in data], SCHEMA)
    got = rows_of(near_dedup.clustered(docs), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(brute.components(data), key=str)


@pytest.mark.parametrize(("block", "tile"), [(8, 1 << 20), (1024, 400), (8, 400)])
def test_near_dedup_in_small_tiles(spark, monkeypatch, block, tile):
    """The same chain, each set in a chunk of its own, so that all links lie between components."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "TILE_SHINGLES", tile)
    monkeypatch.setattr(near_dedup, "CHUNK_ROWS", 1)
    monkeypatch.setattr(near_dedup, "SKETCHED", 1)
    rng = random.Random(8)
    base, data = [f"w{k}" for k in range(160)], []
    for k in range(70):
        words = list(base)
        for _ in range(rng.choice([4, 5, 6, 7, 8])):
            words[rng.randrange(160)] = f"c{k}_{rng.random()}"
        data.append((k, " ".join(words)))
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in data], SCHEMA)
    got = rows_of(near_dedup.clustered(docs), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(brute.components(data), key=str)


@pytest.mark.parametrize("rows", [10000, 1])
def test_near_dedup_behind_longer_documents(spark, rows):
    """Short near copies whose buckets are all led by documents too long for a link, in one batch and each in its own."""
    passage = [f"w{k}" for k in range(100)]
    data = [(k, " ".join([*passage, *[f"l{k}_{j}" for j in range(54)]])) for k in range(120)]
    data += [(k, " ".join([*passage, *[f"s{k}_{j}" for j in range(12)]])) for k in (500, 501)]
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in data], SCHEMA).coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        got = rows_of(near_dedup.clustered(docs), "doc_id", "n_shingles", "component_id", "kept")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(brute.components(data), key=str)
    assert {c for i, _, c, _ in got if i >= 500} == {500}


def test_near_dedup_pairs_of_bands_alike_in_bytes(spark):
    """A first band of equal low bytes but another hash is no shared bucket; the second one is, and the third."""
    bands = {1: [10, 20, 30, *range(100, 137)], 2: [11, 20, 30, *range(200, 237)]}
    nodes = spark.createDataFrame([(k, 50, b, bytearray(near_dedup.COORDS)) for k, b in bands.items()], "rep long, n long, bands array<long>, fine binary")
    labels = spark.createDataFrame([(1, 1), (2, 2)], "v long, comp long")
    for least in near_dedup.LEAST:
        tiles = near_dedup.between(nodes, labels, least, 2.0).collect()
        assert sorted(r.v for r in tiles if r.v is not None) == [1, 2] and len({r.tile for r in tiles}) == 1 and len([r for r in tiles if r.data]) == 1


def test_sketch_estimates_similarity():
    import numpy as np

    rng = np.random.default_rng(3)
    for shared in (30, 60, 75, 90):
        own = rng.integers(1, 1 << 63, 200 - shared, dtype=np.uint64)
        both = rng.integers(1, 1 << 63, shared, dtype=np.uint64)
        half = len(own) // 2
        a, b = np.concatenate([both, own[:half]]), np.concatenate([both, own[half:]])
        s = near_dedup.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 2000)
        assert abs((s[0] == s[1]).mean() - shared / (shared + len(own))) < 0.06
        assert (s != 0).all()


def test_columns_that_clash(spark):
    """Extra columns of the names that operators use for their own come through unchanged."""
    names = ["_grp", "grp", "blob", "_tox", "_TOXIC", "_dc_mask", "_dc_words", "_salt", "rep", "band", "tile"]
    docs = spark.createDataFrame([(i, t, *["x"] * len(names)) for i, t in corpus()], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(0, 60, 2)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, corpus()[0][1])], "item_id long, text string")
    for out in (substring_dedup.remove_repeats(docs), toxicity.clean(docs, labels), decontam.remove_spans(docs, benchmark), decontam.remove_documents(docs, benchmark), near_dedup.representatives(docs)):
        assert out.columns == docs.columns
        assert {r[2:] for r in out.collect()} == {("x",) * len(names)}


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    data = corpus()
    length = 64
    got = packing.packed(docs, length=length).collect()
    by_doc, sequences = {}, {}
    for r in got:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    wanted = sorted((zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[at : at + length])), at, len(ids)) for ids in ([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for _, t in data) for at in range(0, len(ids), length))
    assert sorted((r.ids_crc32, r.start, r.doc_tokens) for r in got) == wanted
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    assert packing.packed(docs.limit(0)).count() == 0


def test_word_encoder_equals_the_tokenizer():
    """Letters whose lower case or normal form is two characters, marks that compose, special tokens and white space of all kinds."""
    import numpy as np
    import pyarrow as pa

    odd = ["\u0130", "\u0131", "\u03a3", "\u03c2", "\xe9", "A\u030a", "H\u0331", "\u0331", "\u0301", "\xdf", "\u0149", "\xd7", "\xf7", "\xb5", "\u0958", ",", ".", "!", "'", "'s", "'T", "\u2019", "\u2026", "\xa0", "\u2003", "\x85", "\x1c", "\x00", "9", "\u2167", "\u5b57", "\ud55c", "\u1100", "\u1161", "<|", "<|endoftext|>", "<|ENDOFTEXT|>", "_", "a", "Z", "the", "\xd1", "\u0153", "\u017d", "\u200d", "\u01c5", "\u212a", "\u0345", "x" * 70]
    plain = [x for x in odd if "<|" not in x and not "\u0300" <= x[-1] <= "\u036f"]
    words, rng = packing.encoder(packing.default_tokenizer()), random.Random(9)
    for at in range(40):
        pool = plain if at % 2 else odd
        texts = ["".join(rng.choice(pool) if rng.random() < 0.8 else rng.choice(" \n\t\x0b\x0c\r") for _ in range(rng.randint(0, 30))) for _ in range(300)]
        texts += [None, "", "\u0130.", "x\u0130!"]
        got = [np.frombuffer(x, "<u4").tolist() for x in words.rows(pa.array(texts))]
        assert got == [words.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_word_encoder_of_another_kind(tmp_path):
    import numpy as np
    import public_tokenizers
    import pyarrow as pa

    words = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not words.by_word
    texts = ["Two  words, and\nmore", "", None, " x "]
    assert [np.frombuffer(x, "<u4").tolist() for x in words.rows(pa.array(texts))] == [words.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_packing_pads_little(spark):
    """Under 2 % of the ids' number is padding, also where a third of all rows are one and have no id."""
    rng = random.Random(7)
    rows = [(k, " ".join(rng.choice(["one", "two", "three"]) for _ in range(rng.choice([5, 40, 300, 900]))), "x", 7) for k in range(600)]
    docs = spark.createDataFrame([*rows, *[(None, "one two " * 20, "x", 7)] * 300], SCHEMA).repartition(4)
    got = packing.packed(docs, group=100).collect()
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
    tokens = sum(r.length for r in got)
    assert max(len({(r.doc_id, r.start) for r in got if r.sequence_id >> 32 == g}) for g in {r.sequence_id >> 32 for r in got}) < 200
    assert sum(r.doc_tokens for r in got if r.start == 0) == tokens
    # A group may leave its last sequences half full: some two of them for each of the ten groups of this small table.
    assert len(sequences) * packing.LENGTH - tokens < 0.02 * tokens + 10 * 2 * packing.LENGTH


def test_first_fit_decreasing():
    rng = random.Random(2)
    sizes = [rng.randint(1, 100) for _ in range(300)]
    bins, wanted = [], {}
    for k in sorted(range(300), key=lambda k: -sizes[k]):
        b = next((b for b, room in enumerate(bins) if room >= sizes[k]), len(bins))
        bins[b:] = bins[b:] or [100]
        wanted[k] = (b, 100 - bins[b])
        bins[b] -= sizes[k]
    assert packing.packed_group(sizes, 100) == [wanted[k] for k in range(300)]


def test_token_counts(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    folder = f"file://{tmp_path}/tokens"
    token_counts.write_token_files(docs, folder)
    for block in (7, 64, 1 << 19):
        got = token_counts.counted(spark, folder, block=block).collect()
        assert all(r.closed for r in got)
        assert sorted(r.n_tokens for r in got) == sorted(len(tokenizer.encode(t or "", add_special_tokens=False).ids) for _, t in corpus())
        for file in {r.file for r in got}:
            own = sorted((r for r in got if r.file == file), key=lambda r: r.doc_no)
            assert [r.doc_no for r in own] == list(range(len(own)))
            assert all(b.start == a.start + a.n_tokens + 1 for a, b in zip(own, own[1:], strict=False))


def test_token_counts_of_special_tokens_and_many_files(spark, tmp_path, monkeypatch):
    """A text that spells a special token out is one document; runs and files of a few documents."""
    monkeypatch.setattr(token_counts, "RUN_BYTES", 20)
    monkeypatch.setattr(token_counts, "RUNS", 2)
    texts = ["one two <|endoftext|> three", "<|endoftext|>", None, "", *(" ".join(["word"] * k) for k in range(30))]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    folder = f"file://{tmp_path}/tokens"
    token_counts.write_token_files(docs, folder)
    got = token_counts.counted(spark, folder, block=5).collect()
    assert all(r.closed for r in got) and len({r.file for r in got}) > 6
    assert sorted(r.n_tokens for r in got) == sorted([4, 1, 0, 0, *range(30)])


def test_token_counts_of_an_open_document(spark, tmp_path):
    import numpy as np

    np.array([5, 6, token_counts.SEPARATOR, token_counts.SEPARATOR, 8], "<u2").tofile(tmp_path / "part-0")
    open(tmp_path / "part-1", "w").close()
    got = sorted((r.doc_no, r.start, r.n_tokens, r.closed) for r in token_counts.counted(spark, f"file://{tmp_path}", block=2).collect())
    assert got == [(0, 0, 2, True), (1, 3, 0, True), (2, 4, 1, False)]


def test_toxicity(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    data, labels = [], []
    for k in range(700):
        toxic = k % 8 == 0
        own = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        for _ in range(3 if toxic else 0):
            own.insert(rng.randrange(len(own)), rng.choice(["vileA", "vileB", "vileC"]))
        data.append((k, " ".join(own), "x", 7))
        if k % 2 == 0:
            labels.append((k, rng.randint(0, 1), int(toxic)))
    docs = spark.createDataFrame([*data, (9001, None, "x", 7), (9002, "", "x", 7), (None, "w1 w2", "x", 7)], SCHEMA)
    table = spark.createDataFrame([*labels, (None, 1, 1), (555555, 0, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.digest(docs, table).collect()}
    assert len(got) == 703
    held_out = [k for k in range(700) if k % 2]
    assert all(got[k].toxic == (k % 8 == 0) for k in held_out)
    assert not got[9001].toxic and not got[None].toxic and 0 <= got[9002].p_toxic <= 1
    assert toxicity.clean(docs, table).columns == docs.columns
    assert toxicity.digest(docs, table.limit(0)).where("toxic").count() == 0
    assert toxicity.digest(docs.limit(0), table).count() == 0


def test_toxicity_learns_from_documents_that_are_there(spark):
    """Labels of absent documents take no part in the bound, and rows of one id count once."""
    import numpy as np

    rng = random.Random(6)
    data = [(k, " ".join(rng.choice(["w1", "w2", "w3", "w4", *(["vile"] if k % 2 else [])]) for _ in range(40)), "x", 7) for k in range(60)]
    labels = [(k, k % 3 % 2, k % 2) for k in range(60)]
    docs, own = spark.createDataFrame(data, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    many = own.unionByName(spark.range(1000, 6000).selectExpr("id AS doc_id", "0 AS quality", "0 AS toxic"))
    again = docs.unionByName(spark.createDataFrame([data[1]] * 50, SCHEMA))
    want = toxicity.fitted(docs, own)
    for chain in (toxicity.fitted(docs, many, sample=60), toxicity.fitted(again, own)):
        assert [m.share for m in chain.models] == [m.share for m in want.models]
        assert all(np.array_equal(a.w, b.w) for a, b in zip(chain.models, want.models, strict=True))
