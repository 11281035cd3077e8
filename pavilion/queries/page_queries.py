"""Queries of pages around the leaderboard: scope rules, presets, searches, career and player pages, charts, small sources."""

from __future__ import annotations

import uuid
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pavilion.functions.metrics import CATALOGUE, formatted, metric
from pavilion.plans import charts, presets, search
from pavilion.plans.compare import selected
from pavilion.plans.leaderboard import grouped, leaderboard, name_order, page
from pavilion.plans.spec import Condition, Spec, Vs, preset
from pavilion.queries import longs, on_marts, query
from pavilion.queries import catalog as opened
from pavilion.queries.oracle_marts import sql
from pavilion.queries.serve_queries import BAT, BOWL, MEN_T20, board_sql, metric_sql, rate_sql, whole
from pavilion.sources.tables import append_csv, cleaned, in_list, log_report, missing_tables, read_csv, shared_folder

Marts = dict[str, DataFrame]
WOMEN_T20 = "gender = 'female' AND match_type IN ('T20', 'IT20')"
BATTER, BOWLER = "batter_id AS player_id, batter_name AS player_name", "bowler_id AS player_id, bowler_name AS player_name"


# ---- scope ----------------------------------------------------------------------------------------------------------
@on_marts("own_team_filter", sql(f"""SELECT b.*, p.matches FROM (SELECT {BATTER}, {whole('sum(runs)')} AS runs FROM batting WHERE {MEN_T20} AND batting_team IN ('Team 0', 'Team 1', 'Team 2') GROUP BY 1, 2) b
 LEFT JOIN (SELECT player_id, count(DISTINCT match_id) AS matches FROM player_matches WHERE {MEN_T20} AND team IN ('Team 0', 'Team 1', 'Team 2') GROUP BY 1) p USING (player_id)"""))
def _(m: Marts):
    return grouped(replace(BAT, teams=("Team 0", "Team 1", "Team 2"), columns=("matches", "runs"), sort="runs"), m)


@on_marts("inapplicable_dropped", sql(f"SELECT {BATTER}, count(*) AS innings, {whole('sum(runs)')} AS runs FROM batting WHERE {MEN_T20} GROUP BY 1, 2 HAVING sum(runs) >= 50"))
def _(m: Marts):
    """A bowler's column and condition, a phase of another format and a condition without a value have no effect; the sort falls back."""
    groups = ((Condition("wickets", value=3), Condition("runs", value=50)), (Condition("odi_pp_strike_rate", value=100),), (Condition("innings"),))
    return grouped(replace(BAT, columns=("innings", "economy", "runs", "odi_pp_strike_rate"), sort="economy", groups=groups).pruned(), m)


@on_marts("phase_eligibility", sql(f"SELECT {BATTER}, {rate_sql('odi_pp_runs', '100.0', 'odi_pp_balls')} AS odi_pp_strike_rate, {rate_sql('odi_death_runs', '100.0', 'odi_death_balls')} AS odi_death_strike_rate, {whole('sum(runs)')} AS runs FROM batting WHERE gender = 'male' AND match_type IN ('ODI', 'ODM') GROUP BY 1, 2"))
def _(m: Marts):
    return grouped(replace(BAT, formats=("50 Over",), columns=("pp_strike_rate", "odi_pp_strike_rate", "odi_death_strike_rate", "runs"), sort="pp_strike_rate").pruned(), m)


@on_marts("vs_activation", f"SELECT * FROM ({board_sql(WOMEN_T20)}) a UNION ALL SELECT * FROM ({board_sql()}) b")
def _(m: Marts):
    """An opponent restriction has no effect for women, nor a batting hand for batters."""
    return grouped(replace(BAT, gender="female", vs=Vs("group", "Spin")), m).unionByName(grouped(replace(BAT, vs=Vs("hand", "Left-hand bat")), m))


@on_marts("condition_swap", board_sql(having="sum(runs) >= 60"))
def _(m: Marts):
    """To bowling and back: the batting conditions return, the filter on batting hands doesn't."""
    there = replace(BAT, groups=((Condition("runs", value=60),),), hands=("Left-hand bat",)).switched("bowling")
    back = replace(there, groups=((Condition("wickets", value=2),),)).switched("batting")
    return grouped(back, m)


@on_marts("date_preset", board_sql(f"{MEN_T20} AND match_date >= (SELECT greatest(min(match_date), max(match_date) - INTERVAL 24 MONTH) FROM matches) AND match_date <= (SELECT max(match_date) FROM matches)"))
def _(m: Marts):
    span = m["matches"].agg(F.min("match_date").alias("a"), F.max("match_date").alias("z")).first()
    first, last = preset("24m", span.a, span.z)
    return grouped(replace(BAT, date_from=first.isoformat(), date_to=last.isoformat()), m)


_DOTS = rate_sql("dots", "100.0", "balls_faced")


@on_marts("filtered_metric_sort", sql(f"SELECT {BATTER}, {whole('sum(runs)')} AS runs, {_DOTS} AS dot_pct FROM batting WHERE {MEN_T20} GROUP BY 1, 2 HAVING sum(runs) >= 20 AND {_DOTS} <= 60 AND {_DOTS} <> 0 ORDER BY dot_pct ASC NULLS LAST, player_id, player_name LIMIT 20"))
def _(m: Marts):
    spec = replace(BAT, columns=("runs",), groups=((Condition("dot_pct", "lte", 60), Condition("runs", value=20)),)).with_filtered_columns()
    return leaderboard(replace(spec, limit=20), m)


@on_marts("name_sorted", f"SELECT * FROM ({board_sql()}) z ORDER BY lower(strip_accents(player_name)), player_id LIMIT 20 OFFSET 20")
def _(m: Marts):
    return page(grouped(BAT, m).orderBy(name_order(), "player_id"), 1, 20)


# ---- presets and display --------------------------------------------------------------------------------------------
def _preset(discipline: str, name: str, formats: tuple[str, ...], types: str) -> None:
    spec = Spec(discipline=discipline, formats=formats)
    keys = presets.columns(spec, name)
    ident = BATTER if discipline == "batting" else BOWLER
    title = f"preset_{discipline}_{name}" + ("" if formats == ("T20",) else "_50_over")

    @on_marts(title, sql(f"SELECT {ident}, {metric_sql(discipline, keys)} FROM {discipline} WHERE gender = 'male' AND match_type IN ({types}) GROUP BY 1, 2"))
    def _(m: Marts):
        chosen = presets.applied(replace(spec, sort="innings"), name)
        return grouped(chosen, m)


for _discipline, _sets in presets.SETS.items():
    for _name in _sets:
        _preset(_discipline, _name, ("T20",), "'T20', 'IT20'")
    _preset(_discipline, "phases", ("50 Over",), "'ODI', 'ODM'")


@on_marts("preset_core_red_ball", sql(f"""SELECT b.*, p.matches FROM (SELECT {BATTER}, {metric_sql('batting', presets.RED_BALL_BATTING[1:])} FROM batting WHERE gender = 'male' AND match_type IN ('Test', 'MDM') GROUP BY 1, 2) b
 LEFT JOIN (SELECT player_id, count(DISTINCT match_id) AS matches FROM player_matches WHERE gender = 'male' AND match_type IN ('Test', 'MDM') GROUP BY 1) p USING (player_id)"""))
def _(m: Marts):
    return grouped(presets.applied(Spec(formats=("Red Ball",)), "core"), m)


@on_marts("display_values", f"SELECT player_id, format('{{:,}}', innings) AS innings, format('{{:,}}', runs) AS runs, CASE WHEN coalesce(strike_rate, 0) <> 0 THEN format('{{:,.2f}}', strike_rate) ELSE '—' END AS strike_rate, CASE WHEN coalesce(average, 0) <> 0 THEN format('{{:,.2f}}', average) ELSE '—' END AS average FROM ({board_sql()}) z")
def _(m: Marts):
    """Values as they are shown; a dash where a rate has no data."""
    rows, known = grouped(BAT, m), CATALOGUE["batting"]
    shown = lambda k: formatted(F.when(known[k].has_data(F.col(k)), F.col(k)), known[k].fmt).alias(k)
    return rows.select("player_id", *map(shown, ("innings", "runs", "strike_rate", "average")))


_TITLES = {
    "bar": "Runs — 12 most-capped players",
    "donut": "Runs — top 7",
    "scatter": "Batting Average vs Strike Rate",
    "radar": "Radar — bottom 5 by batting average",
    "phases": "Strike rate by phase — 1 player",
    "slope": "Strike Rate — 1995 vs 1996 — top 3 by runs",
    "line": "Strike Rate — Line — 2 players",
    "dumbbell": "Strike Rate — pick both windows — 4 players",
    "benchmark": "Player 14 vs the field",
}


@query("chart_titles", "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{t}')" for c, t in _TITLES.items()) + ") v(chart, title)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, average, rate = (metric("batting", k) for k in ("runs", "average", "strike_rate"))
    r = charts.Roster
    made = {
        "bar": charts.title("bar", r(12, "games"), (runs,)),
        "donut": charts.title("donut", r(7, "best", runs), (runs,)),
        "scatter": charts.title("scatter", r(60, "games"), (average, rate)),
        "radar": charts.title("radar", r(5, "worst", average), (runs, average, rate)),
        "phases": charts.title("phases", r(1), (), family="Strike rate by phase"),
        "slope": charts.title("slope", r(3, "best", runs), (rate,), ("1995", "1996")),
        "line": charts.title("line", r(2), (rate,)),
        "dumbbell": charts.title("dumbbell", r(4), (rate,)),
        "benchmark": charts.title("benchmark", r(15, "games"), anchor="Player 14"),
    }
    return spark.createDataFrame([*made.items()], "chart string, title string")


# ---- searches and one player ----------------------------------------------------------------------------------------
@on_marts("roster_search", sql(f"SELECT {BOWLER}, count(*) AS n FROM bowling WHERE {MEN_T20} AND contains(lower(bowler_name), 'r 1') GROUP BY 1, 2 ORDER BY n DESC, player_name, player_id LIMIT 25"))
def _(m: Marts):
    return search.roster(BOWL, m, " R 1 ")


def _two(num: str, scale: int, den: str) -> str:
    """A ratio of whole sums to two places, half up, in whole numbers."""
    n, d = f"CAST(sum({num}) AS BIGINT) * {scale}", f"NULLIF(CAST(sum({den}) AS BIGINT), 0)"
    return f"CAST((200 * {n} + {d}) // (2 * {d}) AS DOUBLE) / 100"


@on_marts("career_batting", sql(f"""SELECT {BATTER}, count(*) AS innings, {', '.join(f'{whole(f"sum({c})")} AS {a}' for c, a in (('runs', 'runs'), ('balls_faced', 'balls_faced'), ('dismissed', 'dismissals'), ('fours_hit', 'fours'), ('sixes_hit', 'sixes')))}, max(runs) AS high_score,
 {_two('runs', 1, 'dismissed')} AS average, {_two('runs', 100, 'balls_faced')} AS strike_rate FROM batting WHERE {MEN_T20} AND contains(lower(batter_name), 'er 1') GROUP BY 1, 2 ORDER BY runs DESC, player_id, player_name LIMIT 20"""))
def _(m: Marts):
    return search.career(BAT, m, "er 1")


@on_marts("career_bowling", sql(f"""SELECT {BOWLER}, count(*) AS innings, {', '.join(f'{whole(f"sum({c})")} AS {c}' for c in ('balls', 'runs_conceded', 'wickets'))}, max(wickets) AS best,
 {_two('runs_conceded', 1, 'wickets')} AS average, {_two('runs_conceded', 6, 'balls')} AS economy FROM bowling WHERE {MEN_T20} AND contains(lower(bowler_name), 'er 1') GROUP BY 1, 2 ORDER BY wickets DESC, player_id, player_name LIMIT 20"""))
def _(m: Marts):
    return search.career(BOWL, m, "er 1")


@on_marts("profile_lookup", sql("SELECT player_id, registry_name, role_group, batting_style, bowling_type, bowling_group, teams_played_for FROM a_profiles WHERE player_id = 'p14'"))
def _(m: Marts):
    return search.profile(m, "p14").select("player_id", "registry_name", "role_group", "batting_style", "bowling_type", "bowling_group", "teams_played_for")


@on_marts("player_gender", sql("SELECT arg_max(gender, CAST(match_date AS VARCHAR) || match_id) AS gender FROM player_matches WHERE player_id = 'p14' UNION ALL SELECT NULL"))
def _(m: Marts):
    return search.gender_of(m, "p14").unionByName(search.gender_of(m, "nobody"))


_HANDS = tuple(k for k, x in CATALOGUE["matchup_bowling"].items() if x.form in ("sum", "ratio", "innings"))


@on_marts("player_hands", sql(f"SELECT batting_hand, {metric_sql('matchup_bowling', _HANDS)} FROM matchup_bowling WHERE bowler_id = 'p17' AND match_type IN ('T20', 'IT20') GROUP BY 1"))
def _(m: Marts):
    return search.hands(search.player_rows(BOWL, m, "p17", "matchups"))


# ---- charts ---------------------------------------------------------------------------------------------------------
@on_marts("bars_best_first", sql(f"SELECT * FROM (SELECT {BOWLER}, {rate_sql('runs_conceded', '6.0', 'balls')} AS economy FROM bowling WHERE {MEN_T20} GROUP BY 1, 2) q WHERE economy <> 0 ORDER BY economy, player_id LIMIT 15"))
def _(m: Marts):
    return charts.bar_of_best(BOWL, m, "economy")


_AXES = "SELECT batter_id AS player_id, batter_name AS player_name, " + ", ".join(f"{rate_sql(n, s, d)} AS {k}" for k, n, s, d in (("sr", "runs", "100.0", "balls_faced"), ("av", "runs", "1.0", "dismissed"), ("dot", "dots", "100.0", "balls_faced"), ("pp", "pp_runs", "100.0", "pp_balls"), ("mid", "mid_runs", "100.0", "mid_balls"), ("death", "death_runs", "100.0", "death_balls")))
_HAS = lambda *keys, how="AND": f" {how} ".join(f"coalesce({k}, 0) <> 0" for k in keys)
_ALL = f"({_AXES} FROM batting WHERE {MEN_T20} GROUP BY 1, 2)"
_BY_ID = f"(SELECT batter_id AS player_id, {rate_sql('pp_runs', '100.0', 'pp_balls')} AS pp, {rate_sql('mid_runs', '100.0', 'mid_balls')} AS mid, {rate_sql('death_runs', '100.0', 'death_balls')} AS death FROM batting WHERE {MEN_T20} GROUP BY 1)"
_SPAN = lambda a, z: f"(SELECT player_id FROM ({_AXES} FROM batting WHERE {MEN_T20} AND match_date >= DATE '{a}-01-01' AND match_date < DATE '{z}-01-01' GROUP BY 1, 2) q WHERE {_HAS('sr')})"
_DRAWABLE = {
    "bar": f"SELECT player_id FROM {_ALL} q WHERE {_HAS('sr')}",
    "scatter": f"SELECT player_id FROM {_ALL} q WHERE {_HAS('sr', 'av')}",
    "radar": f"SELECT player_id FROM {_ALL} q WHERE {_HAS('sr', 'av', 'dot')}",
    "phases": f"SELECT player_id FROM {_ALL} q WHERE {_HAS('pp', 'mid', 'death')}",
    "benchmark": f"SELECT player_id FROM {_ALL} q WHERE {_HAS('sr', 'av', 'dot', 'pp', how='OR')}",
    "slope": f"SELECT player_id FROM {_SPAN(1993, 1996)} a WHERE player_id IN {_SPAN(1996, 1999)}",
    "dumbbell": f"SELECT player_id FROM {_SPAN(1992, 1994)} a WHERE player_id IN {_SPAN(1997, 1999)}",
    "line": f"SELECT player_id FROM (SELECT batter_id AS player_id, year, {rate_sql('runs', '100.0', 'balls_faced')} AS sr FROM batting WHERE {MEN_T20} GROUP BY 1, 2) q WHERE {_HAS('sr')} GROUP BY 1 HAVING count(*) >= 2",
    "line by phase": f"SELECT player_id FROM {_BY_ID} q WHERE {_HAS('pp', 'mid', 'death')}",
}


@on_marts("drawable_players", sql(" UNION ALL ".join(f"SELECT DISTINCT '{chart}' AS chart, player_id FROM ({text}) x_{k}" for k, (chart, text) in enumerate(_DRAWABLE.items()))))
def _(m: Marts):
    """Whom each chart can draw; a radar of two metrics and a benchmark of three draw nobody."""
    phases = ["pp_strike_rate", "mid_strike_rate", "death_strike_rate"]
    rows = {
        "bar": charts.drawable("bar", BAT, m, ["strike_rate"]),
        "scatter": charts.drawable("scatter", BAT, m, ["strike_rate", "average"]),
        "radar": charts.drawable("radar", BAT, m, ["strike_rate", "average", "dot_pct"]),
        "phases": charts.drawable("phases", BAT, m, phases),
        "benchmark": charts.drawable("benchmark", BAT, m, ["strike_rate", "average", "dot_pct", "pp_strike_rate"]),
        "slope": charts.drawable("slope", BAT, m, ["strike_rate"], (("1993-01", "1995-12"), ("1996-01", "1998-12"))),
        "dumbbell": charts.drawable("dumbbell", BAT, m, ["strike_rate"], (("1992-01", "1993-12"), ("1997-01", "1998-12"))),
        "line": charts.drawable("line", BAT, m, ["strike_rate"]),
        "line by phase": charts.drawable("line", BAT, m, ["strike_rate"], dim="phase"),
        "radar of two": charts.drawable("radar", BAT, m, ["strike_rate", "average"]),
        "benchmark of three": charts.drawable("benchmark", BAT, m, ["strike_rate", "average", "dot_pct"]),
    }
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("chart"), "player_id") for name, df in rows.items()])


@on_marts("compare_selected", sql(f"SELECT {BATTER}, {whole('sum(runs)')} AS runs, {rate_sql('runs', '1.0', 'dismissed')} AS average FROM batting WHERE {MEN_T20} AND batter_id IN ('p3', 'p14', 'p17') GROUP BY 1, 2"))
def _(m: Marts):
    """Chosen players, whatever conditions the board has."""
    return selected(replace(BAT, groups=((Condition("runs", value=10**9),),)), m, ["p3", "p14", "p17"], ["runs", "average"])


# ---- small sources --------------------------------------------------------------------------------------------------
def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("csv_appended", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation UNION ALL SELECT CAST(r_regionkey AS VARCHAR), r_name, NULL FROM region")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends to one folder, read as text."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    append_csv(_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    append_csv(_table(spark, sf_dir, "region").select("r_regionkey", "r_name", F.lit(None).cast("string").alias("none")), path)
    return read_csv(spark, path)


@query("csv_cleaned", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS segment FROM customer")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells as spreadsheets leave them: decimals on ids, quotes inside quotes, blanks."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    key = F.col("c_custkey")
    rough = _table(spark, sf_dir, "customer").select(F.concat(key.cast("string"), F.lit(".0")).alias("id"), F.concat(F.lit("' "), "c_name", F.lit("'")).alias("name"), F.when(key % 3 == 0, "  ").otherwise(F.col("c_mktsegment")).alias("segment"))
    append_csv(rough, path)
    return cleaned(read_csv(spark, path), ["id"])


@query("in_memory_list", "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(in_list(_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", ["BUILDING", "MACHINERY", "none of them"]))


@query("log_scan", "SELECT CAST(NULL AS BIGINT) AS errors, 'm' || n_nationkey || '.json' AS file, 'bad ' || n_name AS error FROM nation WHERE n_regionkey = 1 UNION ALL SELECT count(*), NULL, NULL FROM nation WHERE n_regionkey = 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    nation = _table(spark, sf_dir, "nation")
    failed = F.col("n_regionkey") == 1
    lines = nation.select(F.when(failed, F.format_string("10:00 FAILED: m%d.json — bad %s", F.col("n_nationkey"), F.col("n_name"))).otherwise(F.concat(F.lit("took "), "n_name")).alias("value"))
    lines.unionByName(nation.where(failed).agg(F.concat(F.lit("Errors : "), F.count("*").cast("string")).alias("value"))).write.text(path)
    return log_report(spark, path)


_COUNTED = ("batting", "bowling", "matches", "matchup_batting", "matchup_bowling", "player_matches", "players", "profiles")


@query("manifest_rows", sql(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows FROM {'a_profiles' if t == 'profiles' else t}" for t in _COUNTED)))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the published manifest says of each table."""
    files = opened(spark, sf_dir).manifest["files"]
    return spark.createDataFrame([(n, f["rows"]) for n, f in files.items()], "name string, rows long")


@query("console_sql", sql(f"SELECT batter_name, {whole('sum(runs)')} AS runs FROM batting GROUP BY batter_id, batter_name ORDER BY runs DESC, batter_id, batter_name LIMIT 200"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free SQL over the marts, the first rows only."""
    return opened(spark, sf_dir).sql(spark, "SELECT batter_name, CAST(sum(runs) AS BIGINT) AS runs FROM batting GROUP BY batter_id, batter_name ORDER BY runs DESC, batter_id, batter_name")


@query("catalogue_missing", "SELECT 'wickets_of_nobody' AS name")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the tables that a run needs the session doesn't have."""
    found = opened(spark, sf_dir)
    found.register(spark)
    return spark.createDataFrame([(n,) for n in missing_tables(spark, [*found.tables, "wickets_of_nobody"])], "name string")
