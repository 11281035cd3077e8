"""Marts and summaries over a small store with the odd cases of the game."""

import datetime as dt

import pytest

from pavilion.operators import gates, marts, summaries

MATCH = "match_id string, match_type string, gender string, team_type string, match_date_1 date, team_1 string, team_2 string, balls_per_over int, venue string, city string, event_name string, winner string, result_type string"
BALL = "match_id string, innings_number int, over_number int, ball_index int, batter string, batter_id string, bowler string, bowler_id string, non_striker string, non_striker_id string, runs_batter int, wides int, noballs int, byes int, legbyes int, is_not_boundary boolean"
WICKET = "match_id string, innings_number int, over_number int, ball_index int, wicket_index int, player_out string, player_out_id string, kind string"


def ball(match, innings, over, index, batter, bowler, partner, runs=0, wides=None, noballs=None, inb=None):
    return (match, innings, over, index, batter.upper(), batter, bowler.upper(), bowler, partner.upper(), partner, runs, wides, noballs, None, None, inb)


@pytest.fixture(scope="module")
def store(spark):
    day = dt.date(2024, 2, 29)
    matches = [("m1", "T20", "male", "club", day, "A", "B", 6, "v", "c", None, "A", None), ("h", "T20", "male", "club", day, "A", "B", 5, None, None, "", None, "tie")]
    balls = [ball("m1", 0, 0, k, "a1", "b1", "a2") for k in range(6)]  # a maiden
    balls += [ball("m1", 0, 1, 0, "a2", "b2", "a1", 4), ball("m1", 0, 1, 1, "a2", "b2", "a1", 4, inb=True), ball("m1", 0, 1, 2, "a2", "b2", "a1", 0, wides=2), ball("m1", 0, 1, 3, "a2", "b2", "a1", 6, noballs=1), ball("m1", 0, 1, 4, "a2", "b2", "a1"), ball("m1", 0, 1, 5, "a1", "b2", "a4", 1)]
    balls += [ball("m1", 0, 5, 0, "a1", "b1", "a4", 2), ball("m1", 0, 6, 0, "a1", "b1", "a4", 3)]
    balls += [ball("m1", 2, 0, 0, "a1", "b1", "a2", 6)]  # super over
    # Five balls an over: the first ball is a wide, and 101 legal balls follow.
    balls += [ball("h", 0, 0, 0, "a1", "b1", "a2", wides=1)] + [ball("h", 0, k // 5, k % 5 + (k < 5), "a1", "b1", "a2", 1) for k in range(101)]
    wickets = [("m1", 0, 1, 4, 0, "A2", "a2", "caught"), ("m1", 0, 1, 4, 1, "A3", "a3", "run out"), ("m1", 0, 6, 0, 0, "A1", "a1", "retired hurt"), ("m1", 2, 0, 0, 0, "A1", "a1", "bowled")]
    innings = [("m1", 0, "A", None), ("m1", 2, "A", True), ("h", 0, "A", False)]
    players = [(f"{t}{k}", f"{t}{k}".upper()) for t in "ab" for k in range(1, 5)]
    return {
        "matches": spark.createDataFrame(matches, MATCH),
        "deliveries": spark.createDataFrame(balls, BALL),
        "wickets": spark.createDataFrame(wickets, WICKET),
        "innings": spark.createDataFrame(innings, "match_id string, innings_number int, batting_team string, super_over boolean"),
        "match_players": spark.createDataFrame([("m1", "A", "A1", "a1"), ("m1", "B", "A1", "a1"), ("m1", "B", "B1", "b1"), ("m1", "B", "B9", "b9")], "match_id string, team string, player_name string, player_id string"),
        "players": spark.createDataFrame(players, "player_id string, player_name string"),
        "profiles": spark.createDataFrame([("b1", "Off-spin", "Spin", None), ("b2", None, "Pace", "Left-hand bat"), ("a2", None, None, "Left-hand bat")], "player_id string, bowling_type string, bowling_group string, batting_style string"),
    }


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_batting(store):
    rows = by(marts.batting(store, marts.delivery_facts(store)), "match_id", "batter_id")
    assert {b for m, b in rows if m == "m1"} == {"a1", "a2", "a3", "a4"}
    a1, a2, a3, a4 = (rows["m1", f"a{k}"] for k in range(1, 5))
    assert (a1.runs, a1.balls_faced, a1.dots, a1.dismissed, a1.dismissal_kind) == (6, 9, 6, 0, "retired hurt")
    assert (a2.runs, a2.balls_faced, a2.fours_hit, a2.sixes_hit, a2.dismissed, a2.dismissal_kind) == (14, 4, 1, 1, 1, "caught")
    assert (a3.balls_faced, a3.runs, a3.dismissed, a3.dismissal_kind) == (0, 0, 1, "run out")
    assert [a1.batting_position, a2.batting_position, a3.batting_position, a4.batting_position] == [1, 2, 3, 4]
    assert (a1.pp_runs, a1.mid_runs, a1.odi_pp_runs) == (3, 3, 6)
    h = rows["h", "a1"]
    assert (h.pp_balls, h.mid_balls, h.death_balls, h.odi_pp_balls, h.odi_pp_dismissals) == (25, 50, 26, None, None)
    assert (h.fb1_10_balls, h.fb11_20_balls, h.fb21p_balls) == (10, 10, 81)


def test_bowling(store):
    rows = by(marts.bowling(store, marts.delivery_facts(store)), "match_id", "bowler_id")
    b1, b2 = rows["m1", "b1"], rows["m1", "b2"]
    assert (b1.balls, b1.runs_conceded, b1.maidens, b1.wickets) == (8, 5, 1, 0)
    assert (b2.balls, b2.runs_conceded, b2.wides_runs, b2.noball_runs, b2.wickets, b2.wickets_caught) == (4, 18, 2, 1, 1, 1)
    assert (b2.fours_conceded, b2.sixes_conceded) == (1, 1)
    assert rows["h", "b1"].odi_mid_runs_conceded is None


def test_matchups_roll_up(store):
    facts = marts.delivery_facts(store)
    bat = by(marts.matchup_batting(store, facts), "match_id", "batter_id", "bowling_type")
    assert bat["m1", "a2", "Pace"].dismissals == 1 and ("m1", "a3", "Pace") not in bat
    assert bat["m1", "a1", "Off-spin"].runs == 5
    bowl = by(marts.matchup_bowling(store, facts), "match_id", "bowler_id", "batting_hand", "batting_position")
    assert bowl["m1", "b2", "Left-hand bat", 2].wickets == 1
    assert gates.failures({"matchup_batting": marts.matchup_batting(store, facts), "batting": marts.batting(store, facts), "matchup_bowling": marts.matchup_bowling(store, facts), "bowling": marts.bowling(store, facts), "player_matches": marts.player_matches(store), "matches": marts.matches(store), "players": marts.players(store), "profiles": store["profiles"]}) == []


def test_player_matches(store):
    rows = by(marts.player_matches(store), "match_id", "player_id")
    assert rows["m1", "a1"].team == "A"  # the least of two
    assert rows["m1", "b9"].team == "B" and rows["m1", "a3"].team == "A" and rows["m1", "b2"].team == "B"


def test_gates_find_faults(store):
    from pyspark.sql import functions as F

    facts = marts.delivery_facts(store)
    batting = marts.batting(store, facts).withColumn("runs", F.col("runs") + 1)
    assert any("progression" in r.gate for r in gates.check_rows({"batting": batting}) if not r.ok)
    twice = batting.unionByName(batting.limit(1))
    assert [r.ok for r in gates.check_keys({"batting": twice})] == [False]
    assert not all(r.ok for r in gates.sanity({"a": batting}, {"a": 1, "b": 1}))
    total = gates.check_totals({n: f(store, facts) for n, f in (("batting", marts.batting), ("bowling", marts.bowling), ("matchup_batting", marts.matchup_batting), ("matchup_bowling", marts.matchup_bowling))}, facts, store["wickets"])
    assert all(r.ok for r in total)


def test_summaries(store):
    bat = by(summaries.batters(store), "match_id", "batter")
    a1 = bat["m1", "A1"]
    assert (a1.entry, a1.exit, a1.partners, a1.status) == (1, 14, 2, "retired hurt")
    assert bat["m1", "A2"].fours_run == 1
    bowl = by(summaries.bowlers(store), "match_id", "bowler")
    assert (bowl["m1", "B1"].overs, bowl["m1", "B1"].spells, bowl["m1", "B1"].maidens) == (1.2, 2, 1)
    assert {(r.bowler, r.spell) for r in summaries.spells(store).where("match_id = 'm1'").collect()} == {("B1", 1), ("B1", 2), ("B2", 1)}
