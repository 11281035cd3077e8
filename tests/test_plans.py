"""Specifications: pure transformations, scope rules and plan shapes."""

import datetime as dt

import pytest

from pavilion.functions.metrics import CATALOGUE, formatted, metric
from pavilion.plans import charts, line, presets, search
from pavilion.plans.leaderboard import grouped
from pavilion.plans.spec import Condition, Spec, Vs, _after, _integers, preset


def test_catalogue_is_complete():
    assert {k: len(v) for k, v in CATALOGUE.items()} == {"batting": 48, "bowling": 31, "matchup_batting": 29, "matchup_bowling": 35}
    assert all(m.namespace == ns for ns, ms in CATALOGUE.items() for m in ms.values())
    assert metric("batting", "out_run_out_pct").member == "run out"


def test_dates():
    assert _after("2024-12") == dt.date(2025, 1, 1) and _after("2024-02-28") == dt.date(2024, 2, 29)
    assert preset("12m", dt.date(2000, 1, 1), dt.date(2024, 2, 29)) == (dt.date(2023, 2, 28), dt.date(2024, 2, 29))
    assert preset("24m", dt.date(2023, 6, 1), dt.date(2024, 2, 29))[0] == dt.date(2023, 6, 1)
    assert preset("year", dt.date(2000, 1, 1), dt.date(2024, 5, 3))[0] == dt.date(2024, 1, 1)


def test_positions_are_whole_numbers():
    assert _integers((1, "2", 3.0, "x", None, 4.5)) == [1, 2, 3]


def test_spec_rules():
    spec = Spec(columns=("runs", "odi_pp_strike_rate", "pp_strike_rate", "nothing"), sort="odi_pp_strike_rate").pruned()
    assert spec.columns == ("runs", "pp_strike_rate") and spec.sort == "runs"
    assert not Spec(vs=Vs("hand", "x")).vs_active and Spec(vs=Vs("group", "Spin")).namespace == "matchup_batting"
    assert not Spec(gender="female", vs=Vs("group", "Spin")).vs_active
    own = Spec(groups=((Condition("runs", value=3),),), hands=("Right-hand bat",))
    bowling = own.switched("bowling")
    assert bowling.groups == () and bowling.hands == () and bowling.switched("batting").groups == own.groups
    filtered = Spec(groups=((Condition("dot_pct", "lte", 30),),)).with_filtered_columns()
    assert filtered.sort == "dot_pct" and not filtered.descending and "dot_pct" in filtered.columns
    assert not Condition("runs", "between", 3).complete() and not Condition("best", wickets=3).complete()
    assert "vs Spin" in Spec(vs=Vs("group", "Spin")).describe()


def test_presets():
    t20, odi, red = Spec(), Spec(formats=("50 Over",)), Spec(formats=("Red Ball",))
    assert presets.names("bowling") == ["core", "control", "wicket_types", "phases"]
    assert presets.columns(red, "phases") is None and presets.applied(red, "phases") is red
    assert "balls_per_dismissal" in presets.default(red) and "strike_rate" in presets.default(t20)
    assert presets.default(Spec(discipline="bowling", formats=("Red Ball",)))[-1] == "best"
    assert "comp_pace" in presets.default(Spec(vs=Vs("group", "Spin")))
    for spec in (t20, odi, Spec(discipline="bowling"), Spec(discipline="bowling", formats=("50 Over",))):
        for name in presets.names(spec.discipline):
            chosen = presets.applied(spec, name)
            assert chosen.columns == presets.columns(spec, name) and presets.active(chosen) == name
            assert all(k in CATALOGUE[spec.discipline] for k in chosen.columns)
    assert presets.active(Spec(columns=("runs", "innings"))) is None
    assert all(k in CATALOGUE[ns] for ns, keys in presets.DEFAULTS.items() for k in keys)


def test_chart_rules():
    assert charts.held("bar", 1) == 0 and charts.held("bar", 40) == 15 and charts.held("radar", 3) == 3
    runs, best = metric("batting", "runs"), metric("bowling", "best")
    assert charts.title("bar", charts.Roster(1, "games"), (runs,)) == "Runs — 1 most-capped player"
    assert charts.title("bar", charts.Roster(5, "best"), (runs,)) == "Runs — 5 players"  # a rank by nothing is no claim
    assert charts.title("line", charts.Roster(4, "worst", runs), (best,)).endswith("— Line — bottom 4 by runs")
    assert charts.title("benchmark", charts.Roster(1)) == "Choose an anchor player" and charts.title("pie", charts.Roster(1)) == "Untitled chart"
    assert charts._within("Strike Rate (first 10 balls) BBI") == "strike rate (first 10 balls) BBI"


def test_offered_dimensions():
    assert "vs_bowling" not in line.offered(Spec(vs=Vs("group", "Spin"))) and "position" not in line.offered(Spec(discipline="bowling"))
    assert "phase" not in line.offered(Spec(formats=("Red Ball",)))


@pytest.fixture(scope="module")
def marts(spark):
    from pavilion.queries import mart_tables

    return mart_tables(spark, "/root/testdata/sf0.001")


def test_refusal(marts):
    got = search.player_rows(Spec(discipline="bowling"), marts, "p17", "opposition", search.Overlay(opposition=("Team 1",)))
    assert got == search.Unsupported(("opposition",))


def test_no_formats_reads_nothing(marts):
    plan = grouped(Spec(formats=()), marts)._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation <empty>" in plan and "parquet" not in plan


def test_scan_is_pruned_and_filtered(marts):
    plan = grouped(Spec(columns=("runs",), sort="runs", date_from="1996-01"), marts)._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema:")[1].split("\n")[0]
    assert "dots" not in schema and "PushedFilters: [" in plan


def test_coverage_window_is_below_the_gate(marts):
    plan = grouped(Spec(vs=Vs("group", "Spin"), columns=("innings",), sort="innings"), marts)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.split("\n")
    window = next(i for i, x in enumerate(lines) if "Window" in x)
    assert any("Filter" in x and "_met" in x for x in lines[:window])


def test_formats(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(formatted(F.lit(1234.5), "dec2").alias("a"), formatted(F.lit(None).cast("double"), "pct1").alias("b"), formatted(F.lit(12.34), "pct1").alias("c")).first()
    assert (row.a, row.b, row.c) == ("1,234.50", "—", "12.3%")


def test_queries_store_no_marts_and_move_no_balls(spark, tmp_path, monkeypatch):
    """A query derives what it reads of the marts; the balls lie by match, so that what is grouped by match and more stays in place."""
    from pavilion import queries
    from pavilion.operators import marts

    monkeypatch.setattr(queries, "_stores", {})
    monkeypatch.setattr(queries, "_published", {})
    monkeypatch.setattr(queries, "shared_folder", lambda spark: f"file://{tmp_path}")
    assert queries.mart_tables(spark, "/root/testdata/sf0.001")["bowling"].count() > 0
    assert [p.name.partition("-")[0] for p in tmp_path.iterdir()] == ["balls"]
    store = queries.kept_store(spark, "/root/testdata/sf0.001")
    for df in (store["innings"], store["deliveries"].groupBy("match_id", "innings_number", "batter_id").count(), store["deliveries"].join(marts.kept_innings(store["innings"]).hint("merge"), marts.INNINGS)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_line_items_move_once(spark, monkeypatch):
    """They are dealt by match before they are numbered, and lie in buckets as dealt, whatever the number of shuffle partitions."""
    from pavilion import queries

    dealt = []
    monkeypatch.setattr(queries, "_stores", {})
    monkeypatch.setattr(queries, "bucketed", lambda df, path, key, order, buckets: dealt.append(df.repartition(buckets, key)) or df)
    monkeypatch.setattr(queries, "size_of", lambda spark, path: 5 * queries.BUCKET_BYTES)
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        queries.kept_store(spark, "/root/testdata/sf0.001")["deliveries"]
        plan = dealt[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    # The line items, and the matches that meet them.
    assert plan.count("Exchange hashpartitioning(match_id") == 2 and plan.count("REPARTITION_BY_NUM") == 1


def test_a_pass_shuffles_its_own_line_items(spark):
    """Of a pass over the buckets, line items are left out before they cross the network, not after."""
    from pavilion.sources import analogue, tables

    seen = []
    analogue.store(spark, "/root/testdata/sf0.001", lambda balls: seen.append(balls) or balls, 8)["deliveries"]
    parts = tables.in_passes(seen[0], "match_id", 8)
    for part in parts:
        items = [x for x in _exchanges(part._jdf.queryExecution().executedPlan()) if "l_orderkey" in str(x.output())]
        assert items and all("pmod(hash(" in str(x.child()) for x in items)
    assert len(parts) == 2 and sum(p.count() for p in parts) == seen[0].count()


def test_balls_dealt_by_match_are_the_same(spark):
    from pavilion.sources import analogue

    plain, dealt = (analogue.store(spark, "/root/testdata/sf0.001", None, parts)["deliveries"] for parts in (0, 3))
    assert plain.exceptAll(dealt).isEmpty() and dealt.exceptAll(plain).isEmpty()


def test_queries_without_balls_store_none(spark, tmp_path, monkeypatch):
    import __spark_entry__
    from pavilion import queries

    __spark_entry__.queries()  # reads the modules of queries

    monkeypatch.setattr(queries, "_stores", {})
    monkeypatch.setattr(queries, "_published", {})
    monkeypatch.setattr(queries, "shared_folder", lambda spark: f"file://{tmp_path}")
    for name in ("venue_options", "mart_profiles"):
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert not list(tmp_path.iterdir())


def test_wide_marts_stay_in_their_buckets(spark, tmp_path, monkeypatch):
    """Profiles and first appearances move to the balls and their sums; nothing wide is dealt anew to shuffle partitions."""
    import re

    from pavilion import queries

    monkeypatch.setattr(queries, "_stores", {})
    monkeypatch.setattr(queries, "_published", {})
    monkeypatch.setattr(queries, "shared_folder", lambda spark: f"file://{tmp_path}")
    monkeypatch.setattr(queries, "size_of", lambda spark, path: 5 * queries.BUCKET_BYTES)
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        made = queries.mart_tables(spark, "/root/testdata/sf0.001")
        plans = {n: made[n]._jdf.queryExecution() for n in ("batting", "matchup_batting", "matchup_bowling")}
        wide = {n: [len(re.findall(r"#", str(x.output()))) for x in _exchanges(q.executedPlan())] for n, q in plans.items()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    # A row of a match at most, which has ten columns: balls that meet their match have more, and marts far more.
    assert all(max(n) <= 10 for n in wide.values()), wide


def _exchanges(plan):
    plan = plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    found = [plan] if plan.nodeName() == "Exchange" else []
    children = plan.children()
    return found + [x for k in range(children.size()) for x in _exchanges(children.apply(k))]


def test_filled_months_reads_its_values_once(spark, tmp_path):
    rows = [("p1", "A", "202311", 202311, 1.5, 2), ("p1", "A", "202401", 202401, None, 1), ("p2", "B", "202402", 202402, 3.0, 4)]
    spark.createDataFrame(rows, "player_id string, player_name string, bucket string, bucket_ord long, value double, sample long").write.parquet(f"{tmp_path}/v")
    got = line.filled_months(spark.read.parquet(f"{tmp_path}/v"))
    assert sorted(tuple(r) for r in got.collect()) == [rows[0], ("p1", "A", "202312", 202312, None, None), rows[1], rows[2]]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1


def test_every_pin_keeps_its_rows(spark):
    """A pin that only played outside the filters, and misses the condition, keeps its own figures; one that didn't play in the core scope has none."""
    from pavilion.plans.leaderboard import leaderboard

    rows = [("p1", "Team 1", "T20", 40), ("p2", "Team 9", "T20", 90), ("p3", "Team 1", "T20", 31), ("p9999", "Team 9", "T20", 13), ("p14", "Team 1", "ODI", 50), ("p5", "Team 1", "T20", 29)]
    batting = spark.createDataFrame([(p, p.upper(), team, kind, "male", runs) for p, team, kind, runs in rows], "batter_id string, batter_name string, bowling_team string, match_type string, gender string, runs long")
    spec = Spec(columns=("innings", "runs"), sort="runs", opposition=("Team 1",), groups=((Condition("runs", "gte", 30),),), pins=("p3", "p14", "p9999"))
    got = leaderboard(spec, {"batting": batting, "matches": spark.createDataFrame([], "match_id string")})
    assert [tuple(r) for r in got.select("player_id", "player_name", "innings", "runs", "pinned").collect()] == [("p3", "P3", 1, 31, True), ("p9999", "P9999", 1, 13, True), ("p14", None, None, None, True), ("p1", "P1", 1, 40, False)]
