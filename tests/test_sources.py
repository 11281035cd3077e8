"""Documents, the ledger, published tables, state and small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from pavilion.functions import text
from pavilion.operators import profiles
from pavilion.sources import documents, tables
from pavilion.streaming import ledger

DOC = {
    "meta": {"v": 1},
    "info": {
        "match_type": "T20", "gender": "male", "season": "2024/25", "dates": [f"2024-01-0{k}" for k in range(1, 9)], "teams": ["A", "B"], "event": {"name": "E", "group": 3},
        "outcome": {"result": "tie", "eliminator": "B", "by": {"wickets": 3}}, "players": {"A": ["Al", "Bo"], "B": ["Cy", "Unknown"]}, "player_of_match": ["Al", "Al"], "officials": {"umpires": ["U1"]},
        "registry": {"people": {"Al": "p1", "Bo": "p2", "Cy": "p3"}},
    },
    "innings": [
        {"team": "A", "overs": [{"over": 3, "deliveries": [
            {"batter": "Al", "bowler": "Cy", "non_striker": "Bo", "runs": {"batter": 4, "extras": 0, "total": 4, "non_boundary": True}},
            {"batter": "Al", "bowler": "Nobody", "non_striker": "Bo", "runs": {"batter": 0, "extras": 1, "total": 1}, "extras": {"wides": 1}, "wickets": [{"playeer_out": "Al", "kind": "stumped", "fielders": [{"name": "Cy", "substitute": True}, {"name": "Zed"}]}, {"player_out": "Bo", "kind": "run out"}]},
        ]}]},
        {"team": "B", "super_over": True, "overs": []},
    ],
}


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "in"
    at.mkdir()
    (at / "one.json").write_text(json.dumps(DOC))
    (at / "bad.json").write_text('{"info": ')
    return at


def test_flattening(spark, folder):
    docs = documents.read(spark, str(folder))
    t = documents.tables(docs)
    m = t["matches"].first()
    assert (m.match_id, m.season_year_start, m.season_year_end, m.result_type, m.result_margin, m.result_margin_type, m.event_group, m.balls_per_over) == ("one", 2024, 2025, "tie (B)", 3, "wickets", "3", 6)
    assert str(m.match_date_6) == "2024-01-06" and [(r.day_number, str(r.match_date)) for r in t["match_dates_overflow"].orderBy("day_number").collect()] == [(7, "2024-01-07"), (8, "2024-01-08")]
    d = t["deliveries"].orderBy("ball_index").collect()
    assert [(r.over_number, r.ball_index, r.wicket_count, r.bowler_id, r.wides, r.is_not_boundary) for r in d] == [(3, 0, 0, "p3", None, True), (3, 1, 2, None, 1, None)]
    assert (d[1].player_out, d[1].player_out_id, d[1].wicket_kind) == ("Al", "p1", "stumped")
    assert [(r.wicket_index, r.player_out_id, r.kind) for r in t["wickets"].orderBy("wicket_index").collect()] == [(0, "p1", "stumped"), (1, "p2", "run out")]
    assert [(r.fielder_index, r.fielder_id, r.substitute) for r in t["wicket_fielders"].orderBy("fielder_index").collect()] == [(0, "p3", True), (1, None, False)]
    assert [(r.innings_number, r.super_over, r.declared) for r in t["innings"].orderBy("innings_number").collect()] == [(0, False, False), (1, True, False)]
    assert t["match_players"].count() == 3 and [r.player_name for r in documents.team_misses(docs.where("info is not null")).collect()] == ["Unknown"]
    assert t["match_player_of_match"].count() == 1
    first = documents.official_ids(t["officials"])
    assert [tuple(r) for r in first.collect()] == [("off_000001", "U1")]
    more = documents.official_ids(t["officials"].unionByName(t["officials"].withColumn("official_name", F.lit("U2"))), first)
    assert {tuple(r) for r in more.collect()} == {("off_000001", "U1"), ("off_000002", "U2")}


def test_ledger(spark, folder, tmp_path):
    root = f"{tmp_path}/out"
    assert ledger.ingest(spark, str(folder), root, "1") == 2
    assert ledger.pending(spark, str(folder), root) == ["bad.json"]  # stays pending until it can be read
    (folder / "two.json").write_text(json.dumps(DOC))
    (folder / "bad.json").unlink()
    assert ledger.ingest(spark, str(folder), root, "2") == 1 and ledger.ingest(spark, str(folder), root, "3") == 0
    store = ledger.opened(spark, root)
    assert store["matches"].count() == 2 and store["deliveries"].count() == 4 and store["players"].count() == 3


def test_unfinished_batch_is_not_read(spark, folder, tmp_path):
    root = f"{tmp_path}/out"
    assert ledger.opened(spark, root) == {}
    assert ledger.ingest(spark, str(folder), root, "1") == 2
    # A second run that died after its deliveries, before the ledger.
    spark.read.parquet(f"{root}/deliveries/batch=1").write.parquet(f"{root}/deliveries/batch=2")
    store = ledger.opened(spark, root)
    assert store["deliveries"].count() == 2 and "batch" not in store["deliveries"].columns


def test_alerts(spark, tmp_path):
    import datetime as dt

    from pavilion.operators.profiles import new_alerts
    from pavilion.sources.tables import StateStore

    state = StateStore(spark, str(tmp_path))
    day = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(days=k)
    named = lambda ids, k: sorted(r[0] for r in new_alerts(spark.createDataFrame([(i,) for i in ids], "player_id string"), state, day(k)).collect())
    assert named("ab", 0) == []  # the baseline
    assert named("abc", 1) == ["c"]
    assert named("abcd", 2) == [] and named("abcde", 8) == ["d", "e"]  # held back within the week, named after it
    assert named("abc", 9) == [] and named("abcd", 20) == ["d"]  # resolved, then back
    assert named("", 40) == [] and named("", 41) == []


def test_ledger_stream(spark, folder, tmp_path):
    root = f"{tmp_path}/stream"
    (folder / "bad.json").unlink()
    ledger.ingest_stream(spark, str(folder), root)
    ledger.ingest_stream(spark, str(folder), root)
    assert ledger.opened(spark, root)["matches"].count() == 1
    assert ledger.pending(spark, str(folder), root) == []


def test_publishing(spark, tmp_path):
    root = f"file://{tmp_path}/pub"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    with pytest.raises(tables.ManifestError) as e:
        tables.Catalog.open(spark, root)
    assert e.value.kind == "missing"
    tables.publish({"t": df}, root, {"t": ["k"]})
    with pytest.raises(tables.PublishError):
        tables.publish({"t": df.limit(1)}, root, {}, lambda opened: ["no"])
    catalog = tables.Catalog.open(spark, root)
    assert catalog.tables["t"].count() == 2 and catalog.manifest["files"]["t"]["rows"] == 2
    assert catalog.sql(spark, "SELECT count(*) AS n FROM t").first().n == 2
    tables.write_text(spark, f"{root}/manifest.json", "{")
    with pytest.raises(tables.ManifestError) as e:
        tables.Catalog.open(spark, root)
    assert e.value.kind == "unreadable"


def test_retries():
    tried, waits = [], []

    def fails_twice():
        tried.append(1)
        if len(tried) < 3:
            raise OSError("no")
        return "done"

    assert tables.retried(fails_twice, sleep=waits.append) == "done" and waits == [2, 4]
    with pytest.raises(OSError):
        tables.retried(lambda: (_ for _ in ()).throw(OSError("never")), sleep=waits.append)


def test_small_inputs(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id, name\n"123.0"," \'Al "\n7,\n', encoding="utf-8")
    got = tables.cleaned(tables.read_csv(spark, str(tmp_path / "a.csv")), ["id"]).collect()
    assert [tuple(r) for r in got] == [("123", "Al"), ("7", None)]
    (tmp_path / "log.txt").write_text("ok\nFAILED: x.json — bad thing\nErrors : 3\n", encoding="utf-8")
    assert {tuple(r) for r in tables.log_report(spark, str(tmp_path / "log.txt")).collect()} == {(None, "x.json", "bad thing"), (3, None, None)}
    state = tables.StateStore(spark, f"file://{tmp_path}/state")
    assert state.get("seen", []) == []
    state.put("seen", [1])
    assert state.get("seen") == [1]
    df = spark.createDataFrame([(k,) for k in range(5)], "k long")
    assert tables.in_list(df, "k", [1, 3, 9]).count() == 2
    tables.append_csv(df.limit(1), f"{tmp_path}/q")
    tables.append_csv(df.limit(1), f"{tmp_path}/q")
    assert tables.read_csv(spark, f"{tmp_path}/q").count() == 2


def test_source_resolver(spark, tmp_path):
    primary, good, seed = (tmp_path / n for n in ("p.csv", "g.csv", "s.csv"))
    primary.write_text("\ufeffa,b\n1,2\n")
    seed.write_text("a,b\n")
    waits = []
    r = tables.SourceResolver(spark, *(f"file://{p}" for p in (primary, good, seed)), ("a", "b"), sleep=waits.append)
    at = lambda day: r.resolve(day * 86400)
    assert at(1)["from"] == "primary" and not at(10)["stale"] and waits == []
    assert [(at(d)["stale"], at(d)["alert"]) for d in (40,)] == [(True, False)]  # the first call of the two had the alert
    assert not at(43)["alert"] and at(47)["alert"] and not at(48)["alert"]
    primary.write_text("a,b\n3,4\n")
    assert not at(49)["stale"] and good.read_text() == "a,b\n3,4\n"
    primary.write_text("x\n")
    assert at(50)["from"] == "last_good" and waits == [3, 6]
    primary.unlink()
    assert at(71)["alert"] and not at(72)["alert"]  # an unreachable sheet grows stale as well
    good.unlink()
    assert at(73)["from"] == "seed"
    seed.unlink()
    with pytest.raises(ValueError, match="nothing at"):
        at(74)


def test_archives(spark, tmp_path):
    import zipfile

    first, second, root = tmp_path / "one.zip", tmp_path / "two.zip", f"{tmp_path}/out"
    with zipfile.ZipFile(first, "w") as z:
        z.writestr("all/one.json", json.dumps(DOC))
        z.writestr("README.txt", "no document")
        z.writestr("bad.json", "{not json")
    with zipfile.ZipFile(second, "w") as z:
        z.writestr("one.json", json.dumps(DOC))
        z.writestr("two.json", json.dumps(DOC))
    assert ledger.ingest_archives(spark, str(first), root, "1") == 1
    assert ledger.ingest_archives(spark, str(second), root, "2") == 1  # the first one is known
    assert ledger.ingest_archives(spark, [str(first), str(second)], root, "3") == 0
    store = ledger.opened(spark, root)
    assert {r.match_id for r in store["matches"].collect()} == {"one", "two"} and store["deliveries"].count() == 4
    assert spark.read.parquet(f"{root}/quarantine").select("file_name").distinct().collect()[0][0] == "bad.json"


def test_bundles(spark, tmp_path):
    """Documents of bundles are taken once by name: from a stream in micro-batches, from a batch, and when both repeat."""
    root, bad = f"{tmp_path}/out", '{"info": '
    put = lambda *docs: documents.write_bundles(spark.createDataFrame(docs, "file_name string, text string").coalesce(1), f"{tmp_path}/in/{len(docs)}")
    put(("one.json", json.dumps(DOC)), ("bad.json", bad), ("one.json", json.dumps(DOC)))
    ledger.ingest_bundles_stream(spark, f"{tmp_path}/in/*", root)
    put(("one.json", json.dumps(DOC)), ("two.json", json.dumps(DOC)))
    ledger.ingest_bundles_stream(spark, f"{tmp_path}/in/*", root)
    store = ledger.opened(spark, root)
    assert sorted(r.match_id for r in store["matches"].collect()) == ["one", "two"] and store["deliveries"].count() == 4
    assert ledger.ingest_bundles(spark, f"{tmp_path}/in/*", root, "again") == 1  # the one that can't be read stays pending
    assert ledger.ingest_bundles(spark, f"{tmp_path}/in/2", root, "more") == 0
    assert ledger.opened(spark, root)["matches"].count() == 2
    assert spark.read.parquet(f"{root}/quarantine").select("file_name").distinct().collect()[0][0] == "bad.json"


def test_ledger_query_needs_no_file_a_document(spark, tmp_path, monkeypatch):
    """A file for each of many documents took most of the time."""
    from pathlib import Path

    from pavilion.queries import QUERIES, store_queries

    monkeypatch.setattr(store_queries, "shared_folder", lambda _: f"file://{tmp_path}")
    got = {r.name: r.n for r in QUERIES["incremental_ledger"](spark, "/root/testdata/sf0.001").collect()}
    landed = [p for p in Path(tmp_path).glob("ledger-*/in/*") if not p.name.startswith((".", "_"))]
    assert 0 < len(landed) <= 8 < got["ingested_files"]


def test_names(spark):
    df = spark.createDataFrame([("José-Ángel Ñ1",), ("---",), (None,)], "n string")
    assert [r.x for r in df.select(text.norm_alnum(F.col("n")).alias("x")).collect()] == ["joseangeln1", None, None]
    teams = spark.createDataFrame([("Mumbai Indians|X", ["mumbai"]), ("A", ["B"]), (None, ["B"]), ("A", None)], "s string, t array<string>")
    assert [r.x for r in teams.select(text.team_contains(F.col("s"), F.col("t")).alias("x")).collect()] == [True, False, False, False]
    lands = spark.createDataFrame([(["India ", None], "india"), ([], "india"), (["X"], None), (["X"], "y")], "t array<string>, c string")
    assert [r.x for r in lands.select(text.country_in(F.col("t"), F.col("c")).alias("x")).collect()] == [True, None, None, False]


def test_profiles_one_to_one(spark):
    bad = spark.createDataFrame([("p1", "s1"), ("p1", "s2")], "player_id string, sheet_player_id string")
    with pytest.raises(profiles.ProfileError):
        profiles.assert_one_to_one(bad)


def test_fuzzy(spark):
    people = spark.createDataFrame([("p1", "V Kohli", ["India"]), ("p2", "Jos Buttler", ["England"])], "player_id string, player_name string, intl_teams array<string>")
    sheet = spark.createDataFrame([("s1", "Virat Kohli", "India"), ("s2", "JOS BUTTLER", "England"), ("s3", "A Kohli", "India")], "sheet_player_id string, batting_name string, country_name string")
    got = {(r.player_id, r.sheet_player_id): r["rank"] for r in profiles.fuzzy(people, sheet).collect()}
    assert got == {("p1", "s1"): 2, ("p2", "s2"): 1, ("p1", "s3"): 3}


def test_buckets_are_filled_in_passes(spark, tmp_path):
    """Each pass writes whole buckets, a file each, so that it shuffles a part of the rows; every row is there once, without a key too."""
    rows = [(f"m{k}" if k % 50 else None, k) for k in range(1000)]
    got = tables.bucketed(spark.createDataFrame(rows, "match_id string, n long"), f"file://{tmp_path}/b", "match_id", ["n"], 16)
    assert sorted((r.n, r.match_id) for r in got.collect()) == [(n, m) for m, n in rows]
    names = [p.name.split("-", 2)[2] for p in (tmp_path / "b").glob("part-*")]
    write, bucket = zip(*[n.removesuffix(".c000.zstd.parquet").rsplit("_", 1) for n in names], strict=True)
    assert len(names) == len(set(bucket)) == 16 and sorted(write.count(w) for w in set(write)) == [4, 4, 4, 4]
