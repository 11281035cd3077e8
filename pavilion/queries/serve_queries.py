"""Queries of the serving layer over the marts."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pavilion.functions.metrics import CATALOGUE
from pavilion.plans import compare, line, search
from pavilion.plans.leaderboard import grouped, leaderboard, ordered
from pavilion.plans.spec import Condition, Spec, Vs, regular_position
from pavilion.queries import on_marts
from pavilion.queries.oracle_marts import sql

Marts = dict[str, DataFrame]
MEN_T20 = "gender = 'male' AND match_type IN ('T20', 'IT20')"
BAT = Spec(columns=("innings", "runs", "balls_faced", "average", "strike_rate", "high_score"), sort="runs")
BOWL = Spec(discipline="bowling", columns=("innings", "wickets", "average", "economy", "best"), sort="wickets")


def rate_sql(num: str, scale: str, den: str) -> str:
    return f"CAST(sum({num}) AS DOUBLE) * {scale} / NULLIF(CAST(sum({den}) AS DOUBLE), 0)"


def whole(value: str) -> str:
    return f"CAST({value} AS BIGINT)"


_BAT_COLS = f"""count(*) AS innings, {whole('sum(runs)')} AS runs, {whole('sum(balls_faced)')} AS balls_faced, {rate_sql('runs', '1.0', 'dismissed')} AS average, {rate_sql('runs', '100.0', 'balls_faced')} AS strike_rate, max(runs) AS high_score"""
_BAT_ID, _BOWL_ID = "batter_id AS player_id, batter_name AS player_name", "bowler_id AS player_id, bowler_name AS player_name"
_RANK = "wickets * 1000 - runs_conceded"
_BOWL_COLS = f"""count(*) AS innings, {whole('sum(wickets)')} AS wickets, {rate_sql('runs_conceded', '1.0', 'wickets')} AS average, {rate_sql('runs_conceded', '6.0', 'balls')} AS economy,
 arg_max(CAST(wickets AS VARCHAR) || '-' || CAST(runs_conceded AS VARCHAR), {_RANK}) AS best, {whole(f'max({_RANK})')} AS best__sort"""


def board_sql(where: str = MEN_T20, having: str = "TRUE", cols: str = _BAT_COLS, ident: str = _BAT_ID, mart: str = "batting") -> str:
    return sql(f"SELECT {ident}, {cols} FROM {mart} WHERE {where} GROUP BY 1, 2 HAVING {having}")


# ---- leaderboards ---------------------------------------------------------------------------------------------------
@on_marts("leaderboard_core", board_sql(f"{MEN_T20} AND match_date >= DATE '1996-01-01' AND match_date < DATE '2000-07-01'"))
def _(m: Marts):
    return leaderboard(replace(BAT, date_from="1996-01-01", date_to="2000-06"), m)


@on_marts("leaderboard_bowling", board_sql(cols=_BOWL_COLS, ident=_BOWL_ID, mart="bowling"))
def _(m: Marts):
    return leaderboard(BOWL, m)


@on_marts("leaderboard_women_odi", board_sql("gender = 'female' AND match_type IN ('ODI', 'ODM') AND team_type = 'club'"))
def _(m: Marts):
    return leaderboard(replace(BAT, gender="female", formats=("50 Over",), team_type="club"), m)


@on_marts("leaderboard_conditions", board_sql(having="sum(runs) >= 60 AND CAST(sum(runs) AS DOUBLE) * 100.0 / NULLIF(sum(balls_faced), 0) <= 200 AND CAST(sum(runs) AS DOUBLE) * 100.0 / NULLIF(sum(balls_faced), 0) <> 0"))
def _(m: Marts):
    return leaderboard(replace(BAT, groups=((Condition("runs", "gte", 60), Condition("strike_rate", "lte", 200), Condition("average", "gte")),)), m)


@on_marts("leaderboard_between_or_groups", board_sql(having="(sum(runs) BETWEEN 40 AND 90 AND count(*) >= 2) OR (max(runs) = 30)"))
def _(m: Marts):
    return leaderboard(replace(BAT, groups=((Condition("runs", "between", 90, 40), Condition("innings", "gte", 2)), (Condition("high_score", "eq", 30),))), m)


@on_marts("best_figures_condition", board_sql(cols=_BOWL_COLS, ident=_BOWL_ID, mart="bowling", having=f"max({_RANK}) >= 2 * 1000 - 20"))
def _(m: Marts):
    return leaderboard(replace(BOWL, groups=((Condition("best", wickets=2, runs=20),),)), m)


_PINS = ("p3", "p14", "p9999")


@on_marts("pin_exemption", sql(f"""SELECT {_BAT_ID}, {_BAT_COLS}, batter_id IN ('p3', 'p14') AS pinned FROM batting
 WHERE {MEN_T20} AND (bowling_team IN ('Team 1', 'Team 2', 'Team 3') OR batter_id IN ('p3', 'p14')) GROUP BY 1, 2 HAVING sum(runs) >= 30 OR batter_id IN ('p3', 'p14')
 UNION ALL SELECT p, NULL, NULL, NULL, NULL, NULL, NULL, NULL, TRUE FROM (VALUES ('p9999'), ('p3'), ('p14')) x(p) WHERE p NOT IN (SELECT batter_id FROM batting WHERE {MEN_T20})"""))
def _(m: Marts):
    return leaderboard(replace(BAT, opposition=("Team 1", "Team 2", "Team 3"), groups=((Condition("runs", "gte", 30),),), pins=_PINS), m)


@on_marts("matches_side_join", sql(f"SELECT b.*, p.matches FROM (SELECT {_BAT_ID}, {whole('sum(runs)')} AS runs FROM batting WHERE {MEN_T20} GROUP BY 1, 2) b LEFT JOIN (SELECT player_id, count(DISTINCT match_id) AS matches FROM player_matches WHERE {MEN_T20} GROUP BY 1) p USING (player_id)"))
def _(m: Marts):
    return leaderboard(replace(BAT, columns=("matches", "runs")), m)


@on_marts("matches_over_innings", sql(f"SELECT {_BAT_ID}, {whole('sum(runs)')} AS runs, count(DISTINCT match_id) AS matches FROM batting WHERE {MEN_T20} AND batting_position IN (1, 2, 3) GROUP BY 1, 2"))
def _(m: Marts):
    return leaderboard(replace(BAT, columns=("matches", "runs"), positions=(1, "2", 3.0, "x", 4.5)), m)


@on_marts("event_venue_semi", board_sql(f"{MEN_T20} AND match_id IN (SELECT match_id FROM matches WHERE gender = 'male' AND event_name IN ('Event 1', 'Event 2', 'Event 3', 'Event 4', 'Event 5') AND venue <> 'Venue 3' AND venue IN ('Venue 1', 'Venue 2', 'Venue 4', 'Venue 5', 'Venue 6', 'Venue 7', 'Venue 8', 'Venue 9'))"))
def _(m: Marts):
    return leaderboard(replace(BAT, events=tuple(f"Event {k}" for k in range(1, 6)), venues=tuple(f"Venue {k}" for k in (1, 2, 4, 5, 6, 7, 8, 9))), m)


@on_marts("profile_semi_join", board_sql(f"{MEN_T20} AND batter_id IN (SELECT player_id FROM profiles WHERE role_group IN ('Batter', 'Allrounder') AND batting_style = 'Right-hand bat' AND (list_contains(string_split(teams_played_for, '|'), 'Club 1') OR list_contains(string_split(teams_played_for, '|'), 'Team 4')))"))
def _(m: Marts):
    return leaderboard(replace(BAT, role_groups=("Batter", "Allrounder"), hands=("Right-hand bat",), played_for=("Club 1", "Team 4")), m)


_MODE = f"SELECT batter_id, CAST(batting_position AS BIGINT) AS r_pos FROM (SELECT batter_id, batting_position, row_number() OVER (PARTITION BY batter_id ORDER BY count(*) DESC, batting_position) AS n FROM batting WHERE {MEN_T20} GROUP BY 1, 2) q WHERE n = 1"


@on_marts("modal_position", sql(_MODE.replace("SELECT batter_id,", "SELECT batter_id AS _player,", 1)))
def _(m: Marts):
    return regular_position(BAT, m)


@on_marts("modal_position_filter", board_sql(f"{MEN_T20} AND batter_id IN (SELECT batter_id FROM ({_MODE}) z WHERE r_pos IN (1, 2, 5))"))
def _(m: Marts):
    return leaderboard(replace(BAT, regular_positions=(1, 2, 5)), m)


@on_marts("modal_position_column", sql(f"SELECT b.*, z.r_pos FROM (SELECT {_BAT_ID}, {whole('sum(runs)')} AS runs FROM batting WHERE {MEN_T20} GROUP BY 1, 2) b LEFT JOIN ({_MODE}) z ON z.batter_id = b.player_id"))
def _(m: Marts):
    return leaderboard(replace(BAT, columns=("runs", "r_pos")), m)


@on_marts("empty_scope_false", sql("SELECT count(*) AS n FROM batting WHERE FALSE"))
def _(m: Marts):
    return grouped(replace(BAT, formats=()), m).agg(F.count("*").alias("n"))


@on_marts("name_search", board_sql(f"{MEN_T20} AND contains(lower(batter_name), '_1%') OR ({MEN_T20} AND contains(lower(batter_name), 'er 1'))"))
def _(m: Marts):
    special = grouped(replace(BAT, search="_1%"), m)
    return special.unionByName(grouped(replace(BAT, search="ER 1"), m))


def metric_sql(ns: str, keys: tuple[str, ...] | None = None) -> str:
    """Every metric of a namespace (or those of ``keys``) that is an aggregate of its own."""
    out = []
    for k, m in ((k, m) for k, m in CATALOGUE[ns].items() if keys is None or k in keys):
        match m.form:
            case "sum":
                out.append(f"{whole('sum(' + '+'.join(m.num) + ')')} AS {k}")
            case "max":
                out.append(f"max({m.num[0]}) AS {k}")
            case "ratio":
                out.append(f"{rate_sql('+'.join(m.num), str(m.scale), '+'.join(m.den))} AS {k}")
            case "per_innings":
                out.append(f"CAST(sum({m.num[0]}) AS DOUBLE) * {m.scale} / count(*) AS {k}")
            case "matches":
                out.append(f"count(DISTINCT match_id) AS {k}")
            case "innings":
                out.append(f"count(*) AS {k}" if not ns.startswith("matchup") else f"count(DISTINCT match_id || ':' || innings_number) AS {k}")
            case "not_out":
                out.append(f"CAST(sum(CASE WHEN dismissed = 0 THEN 1 ELSE 0 END) AS DOUBLE) * 100.0 / count(*) AS {k}")
            case "kind":
                out.append(f"{whole(f'''sum(CASE WHEN dismissal_kind = '{m.member}' THEN 1 ELSE 0 END)''')} AS {k}")
            case "kind_share":
                out.append(f"CAST(sum(CASE WHEN dismissal_kind = '{m.member}' THEN 1 ELSE 0 END) AS DOUBLE) * 100.0 / NULLIF(sum(dismissed), 0) AS {k}")
    return ", ".join(out)


for _ns, _id in (("batting", "batter"), ("bowling", "bowler")):

    @on_marts(f"metrics_{_ns}", sql(f"SELECT {_id}_id AS player_id, {_id}_name AS player_name, {metric_sql(_ns)} FROM {_ns} WHERE {MEN_T20} GROUP BY 1, 2"))
    def _(m: Marts, ns=_ns, who=_id):
        rows = m[ns].where("gender = 'male' and match_type in ('T20', 'IT20')")
        own = [F.col(f"{who}_id").alias("player_id"), F.col(f"{who}_name").alias("player_name")]
        return rows.groupBy(*own).agg(*[x.expr().alias(k) for k, x in CATALOGUE[ns].items() if x.form not in ("position", "best")])


@on_marts("metrics_odi_phases", sql(f"SELECT {_BOWL_ID}, {', '.join(f'''{rate_sql(f'odi_{p}_runs_conceded', '6.0', f'odi_{p}_balls')} AS odi_{p}_economy, {whole(f'sum(odi_{p}_wickets)')} AS odi_{p}_wickets''' for p in ('pp', 'mid', 'death'))} FROM bowling WHERE gender = 'male' AND match_type IN ('ODI', 'ODM') GROUP BY 1, 2"))
def _(m: Marts):
    keys = tuple(f"odi_{p}_{x}" for p in ("pp", "mid", "death") for x in ("economy", "wickets"))
    return grouped(Spec(discipline="bowling", formats=("50 Over",), columns=keys, sort=keys[1]).pruned(), m)


# ---- versus ---------------------------------------------------------------------------------------------------------
SPIN = replace(BAT, vs=Vs("group", "Spin"), columns=("matches", "innings", "balls", "runs", "strike_rate", "average", "dot_pct"), sort="runs")
_IN = "bowling_group = 'Spin'"


def _vs_cols(inside: str) -> str:
    f = f" FILTER (WHERE {inside})"
    return f"""count(DISTINCT match_id){f} AS matches, count(DISTINCT match_id || ':' || innings_number){f} AS innings, {whole('sum(balls_faced)' + f)} AS balls, {whole('sum(runs)' + f)} AS runs,
 CAST(sum(runs){f} AS DOUBLE) * 100.0 / NULLIF(sum(balls_faced){f}, 0) AS strike_rate, CAST(sum(runs){f} AS DOUBLE) / NULLIF(sum(dismissals){f}, 0) AS average, CAST(sum(dots){f} AS DOUBLE) * 100.0 / NULLIF(sum(balls_faced){f}, 0) AS dot_pct"""


_VS = f"""SELECT q.* EXCLUDE (_all, _known), {whole('sum(_all) OVER (PARTITION BY player_id)')} AS balls_in_scope, {whole('coalesce(sum(_known) OVER (PARTITION BY player_id), 0)')} AS balls_mapped
 FROM (SELECT {_BAT_ID}, {_vs_cols(_IN)}, sum(balls_faced) AS _all, sum(balls_faced) FILTER (WHERE bowling_group <> '(unmapped)') AS _known FROM matchup_batting WHERE {MEN_T20} GROUP BY 1, 2) q"""


@on_marts("vs_bucket", sql(f"SELECT * FROM ({_VS}) z WHERE innings >= 1"))
def _(m: Marts):
    return leaderboard(SPIN, m)


@on_marts("vs_conditions", sql(f"SELECT * FROM ({_VS}) z WHERE innings >= 1 AND (runs >= 20 AND strike_rate >= 100)"))
def _(m: Marts):
    return leaderboard(replace(SPIN, groups=((Condition("runs", "gte", 20), Condition("strike_rate", "gte", 100)),)), m)


@on_marts("vs_coverage", sql(f"SELECT player_id, player_name, innings, balls_in_scope, balls_mapped FROM ({_VS}) z WHERE innings >= 1"))
def _(m: Marts):
    return grouped(replace(SPIN, columns=("innings",), sort="innings"), m)


_HAND = f"SELECT bowler_id AS player_id, bowler_name AS player_name, count(DISTINCT match_id || ':' || innings_number) FILTER (WHERE batting_hand = 'Left-hand bat') AS innings, sum(balls) AS a, sum(balls) FILTER (WHERE batting_hand = 'Right-hand bat') AS r, sum(balls) FILTER (WHERE batting_hand = 'Left-hand bat') AS l, sum(balls) FILTER (WHERE batting_hand = '(unmapped)') AS u FROM matchup_bowling WHERE {MEN_T20} GROUP BY 1, 2"


@on_marts("vs_composition", sql(f"""SELECT player_id, player_name, innings, {whole('ta')} AS balls_in_scope, {whole('coalesce(tr, 0) + coalesce(tl, 0)')} AS balls_mapped, CAST(coalesce(tr, 0) AS DOUBLE) * 100.0 / NULLIF(ta, 0) AS comp_rhb, CAST(coalesce(tl, 0) AS DOUBLE) * 100.0 / NULLIF(ta, 0) AS comp_lhb, CAST(coalesce(tu, 0) AS DOUBLE) * 100.0 / NULLIF(ta, 0) AS comp_uncat
 FROM (SELECT *, sum(a) OVER w AS ta, sum(r) OVER w AS tr, sum(l) OVER w AS tl, sum(u) OVER w AS tu FROM ({_HAND}) q WINDOW w AS (PARTITION BY player_id)) z WHERE innings >= 1"""))
def _(m: Marts):
    return grouped(Spec(discipline="bowling", vs=Vs("hand", "Left-hand bat"), columns=("innings", "comp_rhb", "comp_lhb", "comp_uncat"), sort="innings"), m)


_MET = "_met AS (SELECT bowler_id AS player_id, bowler_name AS player_name, count(DISTINCT match_id || ':' || innings_number) FILTER (WHERE batting_hand = 'Right-hand bat') AS innings, sum(balls) AS _all, sum(balls) FILTER (WHERE batting_hand <> '(unmapped)') AS _known FROM matchup_bowling WHERE " + MEN_T20 + " GROUP BY 1, 2)"


@on_marts("vs_peak_best", sql(f"""SELECT q.player_id, q.player_name, q.innings, {whole('sum(_all) OVER (PARTITION BY q.player_id)')} AS balls_in_scope, {whole('coalesce(sum(_known) OVER (PARTITION BY q.player_id), 0)')} AS balls_mapped, p.best, p.best__sort FROM _met q
 LEFT JOIN (SELECT bowler_id AS player_id, arg_max(CAST(w AS VARCHAR) || '-' || CAST(r AS VARCHAR), w * 1000 - r) AS best, {whole('max(w * 1000 - r)')} AS best__sort FROM (SELECT bowler_id, match_id, innings_number, {whole('sum(wickets)')} AS w, {whole('sum(runs_conceded)')} AS r FROM matchup_bowling WHERE {MEN_T20} AND batting_hand = 'Right-hand bat' GROUP BY 1, 2, 3) x GROUP BY 1) p ON p.player_id = q.player_id
 WHERE TRUE QUALIFY innings >= 1""", _MET))
def _(m: Marts):
    return grouped(Spec(discipline="bowling", vs=Vs("hand", "Right-hand bat"), columns=("innings", "best"), sort="best"), m)


@on_marts("vs_peak_high", sql(f"""SELECT z.player_id, z.player_name, z.innings, z.balls_in_scope, z.balls_mapped, p.high_score FROM ({_VS}) z
 LEFT JOIN (SELECT batter_id, {whole('max(r)')} AS high_score FROM (SELECT batter_id, match_id, innings_number, sum(runs) AS r FROM matchup_batting WHERE {MEN_T20} AND {_IN} GROUP BY 1, 2, 3) x GROUP BY 1) p ON p.batter_id = z.player_id WHERE innings >= 1"""))
def _(m: Marts):
    return grouped(replace(SPIN, columns=("innings", "high_score"), sort="high_score"), m)


@on_marts("matchup_coarse", sql(f"SELECT bowling_group, {whole('sum(balls_faced)')} AS balls, {whole('sum(runs)')} AS runs, {rate_sql('runs', '1.0', 'dismissals')} AS average, {rate_sql('runs', '100.0', 'balls_faced')} AS strike_rate FROM matchup_batting WHERE batter_id = 'p14' AND match_type IN ('T20', 'IT20') GROUP BY 1"))
def _(m: Marts):
    return search.matchups(search.player_rows(replace(BAT, gender=None), m, "p14", "matchups"), "batting", fine=False)


# ---- lines ----------------------------------------------------------------------------------------------------------
_EPOCH = "CAST(datediff('day', DATE '1970-01-01', match_date) AS BIGINT)"


def _line(bucket: str, order: str, source: str = "batting b", extra: str = "TRUE", value: str = rate_sql("runs", "100.0", "balls_faced"), sample: str = "count(*)") -> str:
    inner = f"SELECT *, {bucket} AS bucket FROM {source} WHERE {MEN_T20} AND {extra}"
    return sql(f"SELECT batter_id AS player_id, max(batter_name) AS player_name, bucket, {whole(order)} AS bucket_ord, {value} AS value, {sample} AS sample FROM ({inner}) q WHERE bucket IS NOT NULL GROUP BY batter_id, bucket")


_WITH_MATCH = "(SELECT b.*, x.event_name, x.venue, x.winner, x.result_type FROM batting b JOIN matches x USING (match_id)) b"
_RESULT = "CASE WHEN winner = batting_team THEN 'Won' WHEN winner IS NOT NULL THEN 'Lost' WHEN lower(result_type) LIKE 'tie%' THEN 'Tie' WHEN result_type = 'no result' THEN 'No result' WHEN result_type = 'draw' THEN 'Draw' END"
_LINES = {
    "month": _line("CAST(year * 100 + month AS VARCHAR)", "min(year * 100 + month)"),
    "year": _line("CAST(year AS VARCHAR)", "min(year)"),
    "event": _line("NULLIF(event_name, '')", f"min({_EPOCH})", _WITH_MATCH),
    "venue": _line("NULLIF(venue, '')", f"min({_EPOCH})", _WITH_MATCH),
    "position": _line("CAST(batting_position AS VARCHAR)", "min(batting_position)"),
    "opposition": _line("bowling_team", f"min({_EPOCH})"),
    "innings_of_match": _line("CAST(innings_number AS VARCHAR)", "min(innings_number)"),
    "result": _line(_RESULT, "min(list_position(['Won', 'Lost', 'Tie', 'No result', 'Draw'], bucket))", _WITH_MATCH),
    "vs_bowling": _line("NULLIF(bowling_group, '(unmapped)')", "min(CASE WHEN bowling_group = 'Pace' THEN 0 ELSE 1 END)", "matchup_batting b", sample="count(DISTINCT match_id || ':' || innings_number)"),
    "innings": _line("CAST(row_number() OVER (PARTITION BY batter_id ORDER BY match_date, innings_number, match_id) AS VARCHAR)", "min(CAST(bucket AS BIGINT))"),
    "phase": sql(f"""SELECT player_id, player_name, sample, unnest(['pp', 'mid', 'death']) AS bucket, unnest([0::BIGINT, 1::BIGINT, 2::BIGINT]) AS bucket_ord, unnest([pp, mid, death]) AS value
 FROM (SELECT batter_id AS player_id, max(batter_name) AS player_name, count(*) AS sample, {', '.join(f"{rate_sql(f'{p}_runs', '100.0', f'{p}_balls')} AS {p}" for p in ('pp', 'mid', 'death'))} FROM batting WHERE {MEN_T20} GROUP BY 1) q"""),
}
for _dim, _text in _LINES.items():
    on_marts(f"line_{_dim}", _text)(lambda m, dim=_dim: line.line(BAT, m, dim, "strike_rate", None))


@on_marts("line_month_filled", sql(f"""SELECT s.player_id, s.player_name, strftime(s.m, '%Y%m') AS bucket, CAST(strftime(s.m, '%Y%m') AS BIGINT) AS bucket_ord, v.value, v.sample
 FROM (SELECT player_id, player_name, unnest(generate_series(a, z, INTERVAL 1 MONTH)) AS m FROM (SELECT batter_id AS player_id, max(batter_name) AS player_name, min(date_trunc('month', match_date)) AS a, max(date_trunc('month', match_date)) AS z FROM batting WHERE {MEN_T20} GROUP BY 1) q) s
 LEFT JOIN (SELECT batter_id AS player_id, year * 100 + month AS ym, {rate_sql('runs', '100.0', 'balls_faced')} AS value, count(*) AS sample FROM batting WHERE {MEN_T20} GROUP BY 1, 2) v ON v.player_id = s.player_id AND v.ym = CAST(strftime(s.m, '%Y%m') AS BIGINT)"""))
def _(m: Marts):
    return line.filled_months(line.line(BAT, m, "month", "strike_rate", None))


@on_marts("line_vs_phase_wickets", sql(f"""SELECT player_id, player_name, sample, unnest(['pp', 'mid', 'death']) AS bucket, unnest([0::BIGINT, 1::BIGINT, 2::BIGINT]) AS bucket_ord, unnest([pp, mid, death]) AS value
 FROM (SELECT bowler_id AS player_id, max(bowler_name) AS player_name, count(DISTINCT match_id || ':' || innings_number) AS sample, {', '.join(f"CAST(sum({p}_wickets) AS DOUBLE) AS {p}" for p in ('pp', 'mid', 'death'))} FROM matchup_bowling WHERE {MEN_T20} AND batting_hand = 'Right-hand bat' GROUP BY 1) q"""))
def _(m: Marts):
    return line.line(Spec(discipline="bowling", vs=Vs("hand", "Right-hand bat")), m, "phase", "wickets", None)


@on_marts("phase_unpivot", sql(f"""SELECT player_id, player_name, unnest(['pp_strike_rate', 'mid_strike_rate', 'death_strike_rate']) AS metric, unnest([a, b, c]) AS value FROM (SELECT batter_id AS player_id, batter_name AS player_name, {rate_sql('pp_runs', '100.0', 'pp_balls')} AS a, {rate_sql('mid_runs', '100.0', 'mid_balls')} AS b, {rate_sql('death_runs', '100.0', 'death_balls')} AS c
 FROM batting WHERE {MEN_T20} GROUP BY 1, 2) q WHERE coalesce(a, 0) <> 0 OR coalesce(b, 0) <> 0 OR coalesce(c, 0) <> 0"""))
def _(m: Marts):
    return compare.grouped_bars(BAT, m, "strike_rate", None)


# ---- comparisons ----------------------------------------------------------------------------------------------------
def _window(a: str, z: str) -> str:
    return f"SELECT player_id, min(player_name) AS player_name, max(v) AS v FROM (SELECT {_BAT_ID}, {rate_sql('runs', '100.0', 'balls_faced')} AS v FROM batting WHERE {MEN_T20} AND match_date >= DATE '{a}' AND match_date < DATE '{z}' GROUP BY 1, 2) q WHERE coalesce(v, 0) <> 0 GROUP BY 1"


@on_marts("slope_two_windows", sql(f"SELECT a.player_id, a.player_name, a.v AS before, z.v AS after, z.v - a.v AS change FROM ({_window('1995-01-01', '1998-01-01')}) a JOIN ({_window('1998-01-01', '2002-01-01')}) z USING (player_id)"))
def _(m: Marts):
    return compare.two_windows(BAT, m, "strike_rate", ("1995-01", "1997-12"), ("1998-01", "2001-12"))


_AXES = f"{rate_sql('runs', '100.0', 'balls_faced')} AS strike_rate, {rate_sql('runs', '1.0', 'dismissed')} AS average, {rate_sql('dots', '100.0', 'balls_faced')} AS dot_pct"
_POOL = f"_pool AS (SELECT {_BAT_ID}, {_AXES} FROM batting WHERE {MEN_T20} GROUP BY 1, 2)"
_LONG = "_long AS (SELECT player_id, player_name, 'strike_rate' AS metric, strike_rate AS value, strike_rate AS good FROM _pool UNION ALL SELECT player_id, player_name, 'average', average, average FROM _pool UNION ALL SELECT player_id, player_name, 'dot_pct', dot_pct, -dot_pct FROM _pool)"
_AXIS_KEYS = ["strike_rate", "average", "dot_pct"]


@on_marts("radar_percentile", sql("SELECT player_id, player_name, metric, value, cume_dist() OVER (PARTITION BY metric ORDER BY good) * 100 AS percentile FROM _long WHERE player_id || player_name IN (SELECT player_id || player_name FROM _pool WHERE coalesce(strike_rate, 0) <> 0 AND coalesce(average, 0) <> 0 AND coalesce(dot_pct, 0) <> 0)", _POOL, _LONG))
def _(m: Marts):
    return compare.radar(BAT, m, _AXIS_KEYS)


@on_marts("benchmark_rows", sql("""SELECT l.metric, o.value, count(CASE WHEN l.player_id <> 'p14' AND l.good > o.good THEN 1 END) + 1 AS rank, count(DISTINCT l.player_id) AS pool,
 first(l.player_id ORDER BY l.good DESC, l.player_id, l.value) FILTER (WHERE l.player_id <> 'p14') AS best_id, first(l.value ORDER BY l.good DESC, l.player_id, l.value) FILTER (WHERE l.player_id <> 'p14') AS best_value,
 CASE WHEN l.metric = 'dot_pct' THEN first(l.value ORDER BY l.good DESC, l.player_id, l.value) FILTER (WHERE l.player_id <> 'p14') / o.value ELSE o.value / first(l.value ORDER BY l.good DESC, l.player_id, l.value) FILTER (WHERE l.player_id <> 'p14') END * 100 AS ratio_pct
 FROM _ok l JOIN (SELECT metric, max(value) AS value, max(good) AS good FROM _ok WHERE player_id = 'p14' GROUP BY 1) o USING (metric) GROUP BY l.metric, o.value""", _POOL, _LONG, "_ok AS (SELECT * FROM _long WHERE coalesce(value, 0) <> 0)"))
def _(m: Marts):
    return compare.benchmark(BAT, m, _AXIS_KEYS, "p14")


@on_marts("scatter_median", sql("SELECT median(strike_rate) AS median_x, median(average) AS median_y, count(*) AS points FROM _pool WHERE strike_rate IS NOT NULL AND average IS NOT NULL", _POOL))
def _(m: Marts):
    return compare.medians(compare.selected(BAT, m, None, _AXIS_KEYS), "strike_rate", "average")


@on_marts("donut_topk_other", sql("""SELECT CASE WHEN rn <= 7 THEN player_name ELSE 'Other (' || sum(1) || ' players)' END AS label, CAST(sum(runs) AS BIGINT) AS value, sum(runs) * 100.0 / sum(sum(runs)) OVER () AS share
 FROM (SELECT *, row_number() OVER (ORDER BY runs DESC, player_id) AS rn FROM _runs WHERE runs > 0) q GROUP BY rn <= 7, CASE WHEN rn <= 7 THEN player_id END, CASE WHEN rn <= 7 THEN player_name END, CASE WHEN rn <= 7 THEN rn END""".replace("CASE WHEN rn <= 7 THEN player_name ELSE", "CASE WHEN any_value(rn) <= 7 THEN any_value(player_name) ELSE"),
    f"_runs AS (SELECT batter_id AS player_id, min(batter_name) AS player_name, CAST(sum(runs) AS BIGINT) AS runs FROM batting WHERE {MEN_T20} GROUP BY 1)"))
def _(m: Marts):
    rows = compare.selected(BAT, m, None, ["runs"]).groupBy("player_id").agg(F.min("player_name").alias("player_name"), F.sum("runs").alias("runs"))
    return compare.shares(rows, "runs")


@on_marts("usability_predicate", sql("SELECT player_id, coalesce(strike_rate, 0) <> 0 AND coalesce(average, 0) <> 0 AND coalesce(dot_pct, 0) <> 0 AS on_all_axes, coalesce(strike_rate, 0) <> 0 OR coalesce(average, 0) <> 0 OR coalesce(dot_pct, 0) <> 0 AS on_any_axis FROM _pool", _POOL))
def _(m: Marts):
    return compare.usable(compare.selected(BAT, m, None, _AXIS_KEYS), BAT, _AXIS_KEYS)


_GAMES = "_games AS (SELECT player_id, count(DISTINCT match_id) AS games FROM player_matches GROUP BY 1)"


@on_marts("auto_select_topnames", sql("SELECT p.player_id, p.player_name, p.runs, g.games FROM _runs2 p LEFT JOIN _games g USING (player_id) ORDER BY g.games DESC NULLS LAST, player_id LIMIT 12", _GAMES, f"_runs2 AS (SELECT batter_id AS player_id, min(batter_name) AS player_name, {whole('sum(runs)')} AS runs FROM batting WHERE {MEN_T20} GROUP BY 1)"))
def _(m: Marts):
    rows = compare.selected(BAT, m, None, ["runs"]).groupBy("player_id").agg(F.min("player_name").alias("player_name"), F.sum("runs").alias("runs"))
    return compare.auto_select(rows, "topnames", "runs", 12, games=search.career_games(m))


@on_marts("auto_select_worst", sql(f"SELECT {_BOWL_ID}, {rate_sql('runs_conceded', '6.0', 'balls')} AS economy FROM bowling WHERE {MEN_T20} GROUP BY 1, 2 ORDER BY economy DESC NULLS LAST, player_id LIMIT 10"))
def _(m: Marts):
    return compare.auto_select(compare.selected(BOWL, m, None, ["economy"]), "worst", "economy", 10, higher_is_better=False)


# ---- search, options, one player ------------------------------------------------------------------------------------
@on_marts("career_games", sql("SELECT * FROM _games", _GAMES))
def _(m: Marts):
    return search.career_games(m)


@on_marts("search_tiered", sql("""SELECT h.player_id, h.tier, f.games, f.last_match, f.player_name, f.gender, r.role_group FROM (SELECT player_id, CAST(min(CASE WHEN lower(player_name) = 'player 2' THEN 0 WHEN starts_with(lower(player_name), 'player 2') THEN 1 WHEN contains(lower(player_name), 'player 2') THEN 2 END) AS BIGINT) AS tier
 FROM (SELECT player_id, player_name FROM players UNION SELECT player_id, player_name FROM player_matches) n WHERE contains(lower(player_name), 'player 2') GROUP BY 1) h
 JOIN (SELECT player_id, count(DISTINCT match_id) AS games, max(match_date) AS last_match, first(player_name ORDER BY match_date DESC, match_id DESC) AS player_name, first(gender ORDER BY match_date DESC, match_id DESC) AS gender FROM player_matches GROUP BY 1) f USING (player_id) LEFT JOIN profiles r USING (player_id)
 ORDER BY tier, games DESC, player_name, player_id LIMIT 25"""))
def _(m: Marts):
    return search.players(m, "Player 2")


@on_marts("team_options", sql("SELECT option, count(DISTINCT match_id) AS games, max(match_date) AS latest, CAST(0 AS BIGINT) AS tier FROM (SELECT match_id, match_date, team_1 AS option FROM matches WHERE gender = 'male' UNION ALL SELECT match_id, match_date, team_2 FROM matches WHERE gender = 'male') q WHERE option <> '' GROUP BY 1"))
def _(m: Marts):
    return search.options(m, "team", "male")


@on_marts("event_options", sql("SELECT event_name AS option, count(DISTINCT match_id) AS games, max(match_date) AS latest, CAST(CASE WHEN lower(event_name) = 'event 1' THEN 0 ELSE 1 END AS BIGINT) AS tier FROM matches WHERE gender = 'male' AND starts_with(lower(event_name), 'event 1') GROUP BY 1"))
def _(m: Marts):
    return search.options(m, "event_name", "male", "event 1")


@on_marts("venue_options", sql("SELECT venue AS option, count(DISTINCT match_id) AS games, max(match_date) AS latest, CAST(0 AS BIGINT) AS tier FROM matches WHERE gender = 'female' AND venue <> '' GROUP BY 1"))
def _(m: Marts):
    return search.options(m, "venue", "female")


@on_marts("distinct_options", sql("SELECT DISTINCT bowling_type FROM profiles WHERE bowling_type IS NOT NULL"))
def _(m: Marts):
    return search.distinct_options(m["profiles"], "bowling_type")


@on_marts("vocabulary_order", sql("SELECT bowling_type, count(*) AS n FROM matchup_batting GROUP BY 1"))
def _(m: Marts):
    return search.by_vocabulary(m["matchup_batting"].groupBy("bowling_type").agg(F.count("*").alias("n")), "bowling_type", ["Off-spin", "Leg-spin", "Fast"])


@on_marts("player_core", sql(f"SELECT {_BAT_COLS} FROM batting WHERE batter_id = 'p14' AND match_type IN ('T20', 'IT20') AND match_date >= DATE '1996-01-01'"))
def _(m: Marts):
    rows = search.player_rows(replace(BAT, gender=None), m, "p14", "core", search.Overlay(date_from="1996-01"))
    return search.core(rows, "batting", ["innings", "runs", "balls_faced", "average", "strike_rate", "high_score"])


@on_marts("player_positions", sql(f"SELECT batting_position, count(*) AS innings, {whole('sum(runs)')} AS runs FROM batting WHERE batter_id = 'p14' AND match_type IN ('T20', 'IT20') AND bowling_team IN ('Team 2', 'Team 3', 'Team 4', 'Team 5') GROUP BY 1"))
def _(m: Marts):
    rows = search.player_rows(replace(BAT, gender=None), m, "p14", "positions", search.Overlay(opposition=("Team 2", "Team 3", "Team 4", "Team 5")))
    return search.section(rows, "batting", "batting_position", ["innings", "runs"])


@on_marts("player_opposition", sql(f"SELECT batting_team, count(*) AS innings, {whole('sum(wickets)')} AS wickets FROM bowling WHERE bowler_id = 'p17' AND match_type IN ('T20', 'IT20') GROUP BY 1"))
def _(m: Marts):
    return search.section(search.player_rows(replace(BOWL, gender=None), m, "p17", "opposition"), "bowling", "batting_team", ["innings", "wickets"])


@on_marts("player_matchups", sql(f"SELECT batting_hand, {whole('sum(balls)')} AS balls, {whole('sum(runs_conceded)')} AS runs_conceded, {whole('sum(wickets)')} AS wickets, {rate_sql('runs_conceded', '1.0', 'wickets')} AS average, {rate_sql('runs_conceded', '6.0', 'balls')} AS economy FROM matchup_bowling WHERE bowler_id = 'p17' AND match_type IN ('T20', 'IT20') GROUP BY 1"))
def _(m: Marts):
    return search.matchups(search.player_rows(replace(BOWL, gender=None), m, "p17", "matchups"), "bowling")


@on_marts("player_coverage", sql(f"SELECT {whole('coalesce(sum(balls_faced), 0)')} AS balls, {whole('''coalesce(sum(CASE WHEN bowling_group <> '(unmapped)' THEN balls_faced END), 0)''')} AS mapped_balls FROM matchup_batting WHERE batter_id = 'p14' AND match_type IN ('T20', 'IT20')"))
def _(m: Marts):
    return search.coverage(search.player_rows(replace(BAT, gender=None), m, "p14", "matchups"), "balls_faced", "bowling_group")


@on_marts("dismissal_bars", sql(f"SELECT dismissal_kind, count(*) AS n, CAST(count(*) AS DOUBLE) * 100.0 / sum(count(*)) OVER () AS pct FROM batting WHERE {MEN_T20} AND dismissal_kind IS NOT NULL GROUP BY 1"))
def _(m: Marts):
    rows = m["batting"].where(BAT.core()).where("dismissal_kind is not null").groupBy("dismissal_kind").agg(F.count("*").alias("n"))
    return search.bars(rows, "dismissal_kind", "n")


# ---- ordering -------------------------------------------------------------------------------------------------------
_TOP = f"SELECT {_BAT_ID}, {whole('sum(runs)')} AS runs FROM batting WHERE {MEN_T20} GROUP BY 1, 2"


@on_marts("order_preserving_merge", sql(f"SELECT player_id, player_name, runs, CAST(row_number() OVER (ORDER BY CASE WHEN runs % 3 = 0 THEN runs END DESC NULLS LAST, runs DESC, player_id, player_name) AS BIGINT) AS place FROM ({_TOP}) q"))
def _(m: Marts):
    from pyspark.sql import Window

    rows = grouped(replace(BAT, columns=("runs",)), m)
    kept = rows.where("runs % 3 = 0").select("player_id", "player_name", "runs")
    # A rank over one page of results, not over the corpus.
    ranked = kept.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("runs"), "player_id", "player_name")))
    both = rows.join(ranked.select("player_id", "player_name", "rank"), ["player_id", "player_name"], "left")
    place = F.row_number().over(Window.orderBy(F.col("rank").asc_nulls_last(), F.desc("runs"), "player_id", "player_name"))
    return both.select("player_id", "player_name", "runs", place.alias("place"))


@on_marts("pinned_float", sql("SELECT * FROM (SELECT *, player_id IN ('p3', 'p14') AS pinned FROM (SELECT * FROM _top UNION ALL SELECT pin, NULL, NULL FROM (VALUES ('p3'), ('p14')) v(pin) WHERE pin NOT IN (SELECT player_id FROM _top)) q) z ORDER BY pinned DESC, runs DESC NULLS LAST, player_id, player_name LIMIT 30", f"_top AS ({_TOP})"))
def _(m: Marts):
    spec = replace(BAT, columns=("runs",), pins=("p3", "p14"), limit=30)
    return ordered(spec, grouped(replace(spec, pins=()), m))


@on_marts("best_batters_page", sql(f"SELECT * FROM ({_TOP} HAVING count(*) >= 2) q ORDER BY runs DESC, player_id, player_name LIMIT 10 OFFSET 10"))
def _(m: Marts):
    from pavilion.plans.leaderboard import page

    rows = ordered(replace(BAT, columns=("runs", "innings")), grouped(replace(BAT, columns=("runs", "innings"), groups=((Condition("innings", "gte", 2),),)), m))
    return page(rows, 1, 10).select("player_id", "player_name", "runs")


