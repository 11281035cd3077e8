"""The marts in plain SQL, written for the oracle's dialect independently of the builders."""

from __future__ import annotations

from pavilion.sources import analogue

KINDS = ("bowled", "lbw", "caught", "caught and bowled", "stumped", "hit wicket")
_CREDITED = "(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
_NB = "coalesce(is_not_boundary, FALSE) = FALSE"
_CONCEDED = "runs_batter + coalesce(wides, 0) + coalesce(noballs, 0)"
CONTEXT = "match_type, gender, team_type, match_date, year, month"


def _sums(parts: dict[str, str]) -> str:
    """``parts``: name -> value of a row (0 where it doesn't count)."""
    out = []
    for family, column in (("", "ph"), ("odi_", "oph")):
        for p in ("pp", "mid", "death"):
            for name, value in parts.items():
                total = f"CAST(coalesce(sum(CASE WHEN {column} = '{p}' THEN {value} ELSE 0 END), 0) AS BIGINT)"
                out.append(f"{f'CASE WHEN max(bpo) = 5 THEN NULL ELSE {total} END' if family else total} AS {family}{p}_{name}")
    return ", ".join(out)


def _n(value: str, name: str) -> str:
    return f"CAST(coalesce(sum({value}), 0) AS BIGINT) AS {name}"


def _if(condition: str, value: str = "1") -> str:
    return f"CASE WHEN {condition} THEN {value} ELSE 0 END"


_FACED, _LEGAL = "wides IS NULL", "wides IS NULL AND noballs IS NULL"
_BAT = {"runs": "runs_batter", "balls": _if(_FACED), "dots": _if(f"{_FACED} AND runs_batter = 0"), "fours": _if(f"runs_batter = 4 AND {_NB}"), "sixes": _if(f"runs_batter = 6 AND {_NB}")}
_BOWL = {"balls": _if(_LEGAL), "runs_conceded": _CONCEDED, "dots": _if(f"{_LEGAL} AND runs_batter = 0"), "fours_conceded": _BAT["fours"], "sixes_conceded": _BAT["sixes"]}
_PHASED = [f"{f}{p}" for f in ("", "odi_") for p in ("pp", "mid", "death")]

CTES = {
    "f": f"""
        SELECT *, CASE WHEN bpo = 5 THEN CASE WHEN ord <= 25 THEN 'pp' WHEN ord <= 75 THEN 'mid' ELSE 'death' END
                       WHEN over_number < 6 THEN 'pp' WHEN over_number < 15 THEN 'mid' WHEN over_number < 20 THEN 'death' END AS ph,
               CASE WHEN bpo <> 5 THEN CASE WHEN over_number < 10 THEN 'pp' WHEN over_number < 40 THEN 'mid' WHEN over_number < 50 THEN 'death' END END AS oph
        FROM (SELECT d.*, i.batting_team, CASE WHEN m.team_1 = i.batting_team THEN m.team_2 ELSE m.team_1 END AS bowling_team, m.match_type, m.gender, m.team_type, m.match_date_1 AS match_date,
                     CAST(year(m.match_date_1) AS BIGINT) AS year, CAST(month(m.match_date_1) AS BIGINT) AS month, m.balls_per_over AS bpo,
                     CASE WHEN {_LEGAL} THEN sum({_if(_LEGAL)}) OVER w ELSE sum({_if(_LEGAL)}) OVER w + 1 END AS ord
              FROM a_deliveries d JOIN a_innings i ON i.match_id = d.match_id AND i.innings_number = d.innings_number AND i.super_over IS NOT TRUE
              JOIN a_matches m ON m.match_id = d.match_id WINDOW w AS (PARTITION BY d.match_id, d.innings_number ORDER BY d.over_number, d.ball_index ROWS UNBOUNDED PRECEDING)) z""",
    "crease": """
        SELECT match_id, innings_number, player AS batter_id, name AS batter_name, CAST(row_number() OVER (PARTITION BY match_id, innings_number ORDER BY rk) AS BIGINT) AS batting_position
        FROM (SELECT e.match_id, e.innings_number, player, min(name) AS name, min(over_number * 1000 + ball_index * 10 + role) AS rk
              FROM (SELECT match_id, innings_number, over_number, ball_index, 0 AS role, batter_id AS player, batter AS name FROM a_deliveries
                    UNION ALL SELECT match_id, innings_number, over_number, ball_index, 1, non_striker_id, non_striker FROM a_deliveries
                    UNION ALL SELECT match_id, innings_number, over_number, ball_index, 2, player_out_id, player_out FROM a_wickets) e
              JOIN a_innings i ON i.match_id = e.match_id AND i.innings_number = e.innings_number AND i.super_over IS NOT TRUE
              WHERE player IS NOT NULL GROUP BY ALL) q""",
    "bat_sums": f"""
        SELECT match_id, innings_number, batter_id, {_n("runs_batter", "runs")}, {_n(_BAT["balls"], "balls_faced")}, {_n(_BAT["dots"], "dots")}, {_n(_BAT["fours"], "fours_hit")}, {_n(_BAT["sixes"], "sixes_hit")}, {_sums(_BAT)},
               {", ".join(_n(_if(f"{_FACED} AND nth {c}", v), f"fb{b}_{w}") for b, c in (("1_10", "<= 10"), ("11_20", "BETWEEN 11 AND 20"), ("21p", "> 20")) for w, v in (("runs", "runs_batter"), ("balls", "1")))}
        FROM (SELECT *, sum({_if(_FACED)}) OVER (PARTITION BY match_id, innings_number, batter_id ORDER BY over_number, ball_index ROWS UNBOUNDED PRECEDING) AS nth FROM f WHERE batter_id IS NOT NULL) q GROUP BY 1, 2, 3""",
    "gone": """
        SELECT match_id, innings_number, player_out_id AS batter_id, max(CASE WHEN kind NOT IN ('retired hurt', 'retired not out') THEN 1 ELSE 0 END) AS dismissed,
               coalesce(min(CASE WHEN kind NOT IN ('retired hurt', 'retired not out') THEN kind END), min(kind)) AS dismissal_kind FROM a_wickets WHERE player_out_id IS NOT NULL GROUP BY 1, 2, 3""",
    "gone_phase": f"""
        SELECT w.match_id, w.innings_number, w.player_out_id AS batter_id, {_sums({"dismissals": "1"})}
        FROM a_wickets w JOIN f ON f.match_id = w.match_id AND f.innings_number = w.innings_number AND f.over_number = w.over_number AND f.ball_index = w.ball_index
        WHERE w.kind NOT IN ('retired hurt', 'retired not out') AND w.player_out_id IS NOT NULL GROUP BY 1, 2, 3""",
    "batting": f"""
        SELECT c.match_id, c.innings_number, c.batter_id, c.batter_name, i.batting_team, CASE WHEN m.team_1 = i.batting_team THEN m.team_2 ELSE m.team_1 END AS bowling_team, m.match_type, m.gender, m.team_type,
               m.match_date_1 AS match_date, CAST(year(m.match_date_1) AS BIGINT) AS year, CAST(month(m.match_date_1) AS BIGINT) AS month, c.batting_position, CAST(coalesce(g.dismissed, 0) AS BIGINT) AS dismissed, g.dismissal_kind,
               {", ".join(f"coalesce(s.{x}, 0) AS {x}" for x in ("runs", "balls_faced", "dots", "fours_hit", "sixes_hit", *[f"fb{b}_{w}" for b in ("1_10", "11_20", "21p") for w in ("runs", "balls")]))},
               {", ".join((f"CASE WHEN m.balls_per_over = 5 THEN NULL ELSE coalesce({t}.{p}_{x}, 0) END" if p.startswith("odi") else f"coalesce({t}.{p}_{x}, 0)") + f" AS {p}_{x}" for p in _PHASED for t, x in (("s", "runs"), ("s", "balls"), ("s", "dots"), ("s", "fours"), ("s", "sixes"), ("h", "dismissals")))}
        FROM crease c JOIN a_innings i USING (match_id, innings_number) JOIN a_matches m USING (match_id) LEFT JOIN bat_sums s USING (match_id, innings_number, batter_id)
        LEFT JOIN gone g USING (match_id, innings_number, batter_id) LEFT JOIN gone_phase h USING (match_id, innings_number, batter_id)""",
    "maiden": f"""
        SELECT match_id, innings_number, bowler_id, count(*) AS maidens FROM (SELECT match_id, innings_number, bowler_id, over_number FROM f WHERE bowler_id IS NOT NULL GROUP BY 1, 2, 3, 4
               HAVING sum({_if(_LEGAL)}) = max(bpo) AND sum({_CONCEDED}) = 0) q GROUP BY 1, 2, 3""",
    "taken": f"""
        SELECT f.match_id, f.innings_number, f.bowler_id, count(*) AS wickets, {", ".join(_n(_if(f"w.kind = '{k}'"), "wickets_" + k.replace(" ", "_")) for k in KINDS)}, {_sums({"wickets": "1"})}
        FROM a_wickets w JOIN f ON f.match_id = w.match_id AND f.innings_number = w.innings_number AND f.over_number = w.over_number AND f.ball_index = w.ball_index
        WHERE w.kind IN {_CREDITED} AND f.bowler_id IS NOT NULL GROUP BY 1, 2, 3""",
    "bowl_sums": f"""
        SELECT match_id, innings_number, bowler_id, min(bowler) AS bowler_name, min(bowling_team) AS bowling_team, min(batting_team) AS batting_team, {", ".join(f"min({c}) AS {c}" for c in CONTEXT.split(", "))}, max(bpo) AS bpo1,
               {_n(_BOWL["balls"], "balls")}, {_n(_CONCEDED, "runs_conceded")}, {_n(_BOWL["dots"], "dots")}, {_n(_BAT["fours"], "fours_conceded")}, {_n(_BAT["sixes"], "sixes_conceded")}, {_n("wides", "wides_runs")}, {_n("noballs", "noball_runs")}, {_sums(_BOWL)}
        FROM f WHERE bowler_id IS NOT NULL GROUP BY 1, 2, 3""",
    "bowling": f"""
        SELECT s.* EXCLUDE (bpo1), {", ".join(f"CAST(coalesce(t.{x}, 0) AS BIGINT) AS {x}" for x in ("wickets", *["wickets_" + k.replace(" ", "_") for k in KINDS]))},
               {", ".join((f"CASE WHEN s.bpo1 = 5 THEN NULL ELSE coalesce(t.{p}_wickets, 0) END" if p.startswith("odi") else f"coalesce(t.{p}_wickets, 0)") + f" AS {p}_wickets" for p in _PHASED)}, CAST(coalesce(x.maidens, 0) AS BIGINT) AS maidens
        FROM bowl_sums s LEFT JOIN taken t USING (match_id, innings_number, bowler_id) LEFT JOIN maiden x USING (match_id, innings_number, bowler_id)""",
    "ball_w": f"""
        SELECT match_id, innings_number, over_number, ball_index, count(*) AS w, {", ".join(_n(_if(f"kind = '{k}'"), "w_" + k.replace(" ", "_")) for k in KINDS)} FROM a_wickets WHERE kind IN {_CREDITED} GROUP BY 1, 2, 3, 4""",
    "matchup_batting": f"""
        SELECT f.match_id, f.innings_number, f.batter_id, coalesce(p.bowling_type, p.bowling_group, '(unmapped)') AS bowling_type, coalesce(p.bowling_group, '(unmapped)') AS bowling_group, min(f.batter) AS batter_name, min(batting_team) AS batting_team,
               min(bowling_team) AS bowling_team, {", ".join(f"min({c}) AS {c}" for c in CONTEXT.split(", "))}, {_n("runs_batter", "runs")}, {_n(_BAT["balls"], "balls_faced")}, {_n(_BAT["dots"], "dots")}, {_n(_BAT["fours"], "fours_hit")}, {_n(_BAT["sixes"], "sixes_hit")},
               {_n("b.w", "dismissals")}, {", ".join(_n("b.w_" + k.replace(" ", "_"), "dis_" + k.replace(" ", "_")) for k in KINDS)}, {_sums(_BAT | {"dismissals": "coalesce(b.w, 0)"})}, min(c.batting_position) AS batting_position
        FROM f LEFT JOIN a_profiles p ON p.player_id = f.bowler_id LEFT JOIN ball_w b USING (match_id, innings_number, over_number, ball_index) LEFT JOIN crease c ON c.match_id = f.match_id AND c.innings_number = f.innings_number AND c.batter_id = f.batter_id
        WHERE f.batter_id IS NOT NULL GROUP BY 1, 2, 3, 4, 5""",
    "matchup_bowling": f"""
        SELECT f.match_id, f.innings_number, f.bowler_id, coalesce(p.batting_style, '(unmapped)') AS batting_hand, c.batting_position, min(f.bowler) AS bowler_name, min(bowling_team) AS bowling_team, min(batting_team) AS batting_team,
               {", ".join(f"min({c}) AS {c}" for c in CONTEXT.split(", "))}, {_n(_BOWL["balls"], "balls")}, {_n(_CONCEDED, "runs_conceded")}, {_n("b.w", "wickets")}, {_n(_BOWL["dots"], "dots")}, {_n(_BAT["fours"], "fours_conceded")}, {_n(_BAT["sixes"], "sixes_conceded")},
               {", ".join(_n("b.w_" + k.replace(" ", "_"), "wkt_" + k.replace(" ", "_")) for k in KINDS)}, {_sums(_BOWL | {"wickets": "coalesce(b.w, 0)"})}
        FROM f LEFT JOIN a_profiles p ON p.player_id = f.batter_id LEFT JOIN ball_w b USING (match_id, innings_number, over_number, ball_index) LEFT JOIN crease c ON c.match_id = f.match_id AND c.innings_number = f.innings_number AND c.batter_id = f.batter_id
        WHERE f.bowler_id IS NOT NULL GROUP BY 1, 2, 3, 4, 5""",
    "acts": """
        SELECT d.match_id, d.innings_number, batter_id AS player_id, batter AS player_name, 1 AS side FROM a_deliveries d UNION ALL SELECT match_id, innings_number, non_striker_id, non_striker, 1 FROM a_deliveries
        UNION ALL SELECT match_id, innings_number, bowler_id, bowler, 2 FROM a_deliveries UNION ALL SELECT match_id, innings_number, player_out_id, player_out, 1 FROM a_wickets""",
    "player_matches": """
        SELECT q.*, m.match_type, m.gender, m.team_type, m.match_date_1 AS match_date, CAST(year(m.match_date_1) AS BIGINT) AS year, CAST(month(m.match_date_1) AS BIGINT) AS month
        FROM (SELECT match_id, player_id, min(player_name) AS player_name, min(team) AS team FROM a_match_players WHERE player_id IS NOT NULL GROUP BY 1, 2
              UNION ALL SELECT a.match_id, a.player_id, min(a.player_name), coalesce(min(CASE WHEN side = 1 THEN i.batting_team END), min(CASE WHEN i.batting_team = m.team_1 THEN m.team_2 ELSE m.team_1 END))
              FROM acts a JOIN a_innings i ON i.match_id = a.match_id AND i.innings_number = a.innings_number AND i.super_over IS NOT TRUE JOIN a_matches m ON m.match_id = a.match_id
              WHERE a.player_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a_match_players x WHERE x.match_id = a.match_id AND x.player_id = a.player_id) GROUP BY 1, 2) q JOIN a_matches m ON m.match_id = q.match_id""",
    "matches": """
        SELECT match_id, match_type, gender, team_type, match_date_1 AS match_date, CAST(year(match_date_1) AS BIGINT) AS year, CAST(month(match_date_1) AS BIGINT) AS month, venue, city, event_name, team_1, team_2, winner, result_type FROM a_matches""",
    "players": "SELECT player_id, player_name FROM a_players WHERE player_id IN (SELECT player_id FROM a_match_players)",
    "profiles": "SELECT * FROM a_profiles",
}


def sql(select: str, *extra: str) -> str:
    """The statement with every table that it needs, and any further ``name AS (...)`` parts."""
    import re

    text, need = " ".join([select, *extra]), set()
    todo = {n for n in (*CTES, *analogue.TABLES) if re.search(rf"\b{n}\b", text)}
    while todo - need:
        need |= todo
        body = " ".join(CTES.get(n) or analogue.TABLES[n] for n in need)
        todo = {n for n in (*CTES, *analogue.TABLES) if re.search(rf"(FROM|JOIN) {n}\b", body)} | need
    parts = [f"{n} AS MATERIALIZED ({t})" for n, t in analogue.TABLES.items() if n in need] + [f"{n} AS MATERIALIZED ({t})" for n, t in CTES.items() if n in need]
    return "WITH " + ",\n".join([*parts, *extra]) + "\n" + select
