"""The corpus pipeline, stage by stage, against plain versions on a corpus with rows without an id, repeats and an empty table."""

import random
import zlib

import pytest
from tests.llm import brute
from tests.llm.test_text_operators import corpus

import corpus_pipeline
from pavilion.llm import decontam, packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, _grp string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables in which every eighth document is toxic by a word of its own."""
    at, rng = f"file://{tmp_path_factory.mktemp('tables')}", random.Random(2)
    rows = [(i, t, "en", "hot" if k % 3 else "cold", len(t or ""), "x") for k, (i, t) in enumerate(corpus(6, 80))]
    rows += [(2000 + k, " ".join(["vile" if k % 2 else "fine", *[f"w{rng.randrange(300)}" for _ in range(40)]]), "en", "s", 0, "x") for k in range(120)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(2000 + k, k % 3 % 2, k % 2) for k in range(100)] + [(i, 1, 0) for i in range(0, 80, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, " ".join(corpus(6, 80)[3][1].split()[:14])), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "packing"]
    before, columns = rows(docs), docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name == "packing":
            tokenizer = packing.encoder(packing.default_tokenizer()).tokenizer
            want = sorted(zlib.crc32(b"".join(i.to_bytes(4, "little") for i in [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2][:4096])) for _, t in before)
            assert sorted(r.ids_crc32 for r in out.where("start = 0").collect()) == want
            break
        assert out.columns == columns
        after = rows(out)
        if name == "toxicity":
            assert sorted(map(str, after)) == sorted(str(r) for r in before if not (r[1] or "").startswith("vile "))
        elif name == "near_dedup":
            kept = brute.components(before)
            assert sorted(map(str, after)) == sorted(str(r) for r, k in zip(before, kept, strict=True) if k[3])
            assert len(after) < len(before)
        elif name == "substring_dedup":
            lost = {d: n for d, _, n, _ in brute.repeats(before)}
            assert sorted(str(i) for i, _ in after) == sorted(str(i) for i, _ in before)
            assert [str(r) for r in sorted(after, key=str) if not lost[r[0]]] == [str(r) for r in sorted(before, key=str) if not lost[r[0]]]
            assert {i: len(brute.spaced(t)) for i, t in after} == {i: len(brute.spaced(t)) - lost[i] for i, t in before} and any(lost.values())
        else:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            found = {r[0]: r[2] for r in brute.decontaminated(before, items)}
            assert any(found.values())
            assert {i: len(brute.alnum(t)) for i, t in after} == {i: len(brute.alnum(t)) - found[i] for i, t in before}
            assert not any(r.contaminated for r in decontam.digest(out, spark.read.parquet(f"{folder}/benchmark.parquet")).collect())
        at = f"{folder}/after-{name}"
        out.write.mode("overwrite").parquet(at)
        docs, before = spark.read.parquet(at), after


def test_run_over_nothing(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
    assert corpus_pipeline.run(spark, folder).where("doc_id = 2000").count() == 1
