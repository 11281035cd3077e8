"""A ball-by-ball store derived from relational tables (orders, lineitem, customer).

Every 32 orders are a match of two innings (16 orders each; some matches have a super over), a line item is a delivery,
and customers are players, eleven to a team: players, teams, matches and deliveries all grow with the tables. A match's
teams follow from its first and last customer, low numbers far more often: some players play a lot, most a little. The text is SQL that both Spark and other engines read, so that one
definition of the input serves the engine and its checks; nothing of the engine's logic is in it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from pavilion.sources.tables import Lazily

SOURCES = ("orders", "lineitem", "customer")

#: A line item's columns as a ball, its number within the innings, and all of a ball.
_ITEMS = """SELECT l_orderkey, l_linenumber, l_suppkey, l_shipdate, CAST(l_partkey AS INT) AS pk, CAST(l_quantity AS INT) AS q, CAST(floor(l_orderkey / 32) AS INT) AS n,
                           CASE WHEN floor(l_orderkey / 32) % 11 = 0 AND l_orderkey % 16 = 15 THEN 2 ELSE CAST(floor(l_orderkey / 16) AS INT) % 2 END AS inn FROM lineitem"""
_SEQ = "CAST(row_number() OVER (PARTITION BY {}, x.inn ORDER BY l_orderkey, l_linenumber, pk, l_suppkey, l_shipdate) - 1 AS INT) AS seq"
_BALLS = """
        SELECT *, CAST(floor(seq / 6) AS INT) AS over_number, CAST(seq % 6 AS INT) AS ball_index,
               CASE WHEN inn = 1 THEN t2 ELSE t1 END AS bat, CASE WHEN inn = 1 THEN t1 ELSE t2 END AS bowl,
               CASE WHEN pk % 17 = 0 THEN 1 + q % 2 END AS wides, CASE WHEN pk % 29 = 0 AND pk % 17 <> 0 THEN 1 END AS noballs,
               CASE WHEN pk % 37 = 0 THEN 1 END AS byes, CASE WHEN pk % 41 = 0 THEN 2 END AS legbyes,
               CASE WHEN pk % 17 = 0 OR (floor(seq / 6) % 8 = 5 AND n % 2 = 0) THEN 0 ELSE CASE q % 8 WHEN 1 THEN 1 WHEN 2 THEN 4 WHEN 4 THEN 2 WHEN 5 THEN 6 WHEN 6 THEN 1 WHEN 7 THEN 3 ELSE 0 END END AS runs_batter,
               CAST((floor(seq / 7) + q % 2) % 11 AS INT) AS striker, CAST((floor(seq / 7) + 1 - q % 2) % 11 AS INT) AS partner,
               CAST(6 + (floor(seq / 6) + CASE WHEN pk % 43 = 0 THEN 1 ELSE 0 END) % 5 AS INT) AS bowler_slot
        FROM (SELECT x.*, m.t1, m.t2{more}
              FROM ({items}) x
              JOIN a_matches m ON {on}) y"""

TABLES = {
    "a_players": """
        SELECT 'p' || CAST(c_custkey AS STRING) AS player_id, 'Player ' || CAST(c_custkey AS STRING) AS player_name,
               CAST(floor(c_custkey / 11) AS INT) AS team_no, CAST(c_custkey AS INT) AS number
        FROM customer""",
    "a_matches": """
        SELECT 'm' || CAST(n AS STRING) AS match_id, n, t1, t2, 'Team ' || CAST(t1 AS STRING) AS team_1, 'Team ' || CAST(t2 AS STRING) AS team_2,
               CASE WHEN n % 3 = 0 THEN 'female' ELSE 'male' END AS gender,
               CASE WHEN n % 10 < 4 THEN 'T20' WHEN n % 10 < 6 THEN 'IT20' WHEN n % 10 = 6 THEN 'ODI' WHEN n % 10 = 7 THEN 'ODM' WHEN n % 10 = 8 THEN 'Test' ELSE 'MDM' END AS match_type,
               CASE WHEN n % 10 < 4 AND n % 7 = 0 THEN 5 ELSE 6 END AS balls_per_over, CASE WHEN n % 2 = 0 THEN 'international' ELSE 'club' END AS team_type,
               CAST(o_orderdate AS DATE) AS match_date_1, 'City ' || CAST(n % 13 AS STRING) AS city,
               CASE WHEN n % 31 = 0 THEN NULL WHEN n % 37 = 0 THEN '' ELSE 'Venue ' || CAST(n % 29 AS STRING) END AS venue,
               CASE WHEN n % 19 = 0 THEN NULL WHEN n % 23 = 0 THEN '' ELSE 'Event ' || CAST(n % 17 AS STRING) END AS event_name,
               CASE WHEN o_orderstatus = 'F' THEN 'Team ' || CAST(t1 AS STRING) WHEN o_orderstatus = 'O' THEN 'Team ' || CAST(t2 AS STRING) END AS winner,
               CASE WHEN o_orderstatus = 'P' THEN CASE n % 4 WHEN 0 THEN 'draw' WHEN 1 THEN 'tie' WHEN 2 THEN 'no result' ELSE 'tie (eliminator)' END END AS result_type
        FROM (SELECT o.*, CAST(CASE WHEN first_team <> last_team THEN last_team WHEN first_team + 1 < k THEN first_team + 1 ELSE 0 END AS INT) AS t2
              FROM (SELECT n, o_orderdate, o_orderstatus, k, CAST(floor(a * a / m * a / m / 11) % k AS INT) AS t1, floor(a * a / m * a / m / 11) % k AS first_team, floor(z * z / m * z / m / 11) % k AS last_team
                    FROM (SELECT CAST(floor(o_orderkey / 32) AS INT) AS n, min_by(o_orderdate, o_orderkey) AS o_orderdate, min_by(o_orderstatus, o_orderkey) AS o_orderstatus,
                                 CAST(min_by(o_custkey, o_orderkey) AS DOUBLE) AS a, CAST(max_by(o_custkey, o_orderkey) AS DOUBLE) AS z FROM orders GROUP BY CAST(floor(o_orderkey / 32) AS INT)) g
                    CROSS JOIN (SELECT floor(max(c_custkey) / 11) AS k, CAST(max(c_custkey) AS DOUBLE) AS m FROM customer) c) o) p""",
    "a_balls": _BALLS.format(items=_ITEMS, more=f", m.match_id, {_SEQ.format('x.n')}", on="m.n = x.n"),
    "a_deliveries": """
        SELECT match_id, inn AS innings_number, over_number, ball_index,
               'Player ' || CAST(bat * 11 + striker AS STRING) || CASE WHEN n % 13 = 0 AND (bat * 11 + striker) % 7 = 0 THEN ' Jr' ELSE '' END AS batter,
               CASE WHEN l_suppkey % 53 = 5 THEN NULL ELSE 'p' || CAST(bat * 11 + striker AS STRING) END AS batter_id,
               'Player ' || CAST(bowl * 11 + bowler_slot AS STRING) AS bowler, 'p' || CAST(bowl * 11 + bowler_slot AS STRING) AS bowler_id,
               'Player ' || CAST(bat * 11 + partner AS STRING) AS non_striker, 'p' || CAST(bat * 11 + partner AS STRING) AS non_striker_id,
               CAST(runs_batter AS INT) AS runs_batter, CAST(wides AS INT) AS wides, CAST(noballs AS INT) AS noballs, CAST(byes AS INT) AS byes, CAST(legbyes AS INT) AS legbyes,
               CASE WHEN l_suppkey % 19 = 3 AND runs_batter IN (4, 6) THEN TRUE END AS is_not_boundary
        FROM a_balls""",
    "a_wickets": """
        SELECT match_id, innings_number, over_number, ball_index, CAST(row_number() OVER (PARTITION BY match_id, innings_number, over_number, ball_index ORDER BY w) - 1 AS INT) AS wicket_index, player_out, player_out_id, kind
        FROM (SELECT *, row_number() OVER (PARTITION BY match_id, innings_number, player_out_id ORDER BY over_number, ball_index, w) AS nth FROM (
        SELECT b.match_id, inn AS innings_number, over_number, ball_index, w,
               CASE WHEN w = 1 OR k = 3 THEN 'Player ' || CAST(bat * 11 + partner AS STRING) ELSE 'Player ' || CAST(bat * 11 + striker AS STRING) END AS player_out,
               CASE WHEN w = 1 OR k = 3 THEN 'p' || CAST(bat * 11 + partner AS STRING) ELSE 'p' || CAST(bat * 11 + striker AS STRING) END AS player_out_id,
               CASE WHEN w = 1 THEN 'run out' ELSE CASE k WHEN 1 THEN 'caught' WHEN 2 THEN 'lbw' WHEN 3 THEN 'run out' WHEN 4 THEN 'stumped' WHEN 5 THEN 'caught and bowled'
                    WHEN 6 THEN 'hit wicket' WHEN 7 THEN 'retired hurt' WHEN 8 THEN 'caught' WHEN 9 THEN 'retired not out' WHEN 10 THEN 'retired out' WHEN 11 THEN 'obstructing the field' ELSE 'bowled' END END AS kind
        FROM (SELECT *, CAST(floor(pk / 13) AS INT) % 12 AS k, 0 AS w FROM a_balls WHERE pk % 13 = 0
              UNION ALL SELECT *, 0 AS k, 1 AS w FROM a_balls WHERE pk % 91 = 0) b) c) d WHERE nth = 1""",
    "a_innings": """
        SELECT match_id, inn AS innings_number, 'Team ' || CAST(min(bat) AS STRING) AS batting_team, CASE WHEN inn = 2 THEN TRUE END AS super_over FROM a_balls GROUP BY match_id, inn""",
    "a_match_players": """
        SELECT m.match_id, 'Team ' || CAST(p.team_no AS STRING) AS team, p.player_name, p.player_id FROM a_matches m JOIN a_players p ON p.team_no = m.t1 WHERE p.number % 11 <> 10
        UNION ALL SELECT m.match_id, 'Team ' || CAST(p.team_no AS STRING) AS team, p.player_name, p.player_id FROM a_matches m JOIN a_players p ON p.team_no = m.t2 WHERE p.number % 11 <> 9""",
    "a_profiles": """
        SELECT player_id, player_name AS registry_name, CASE number % 3 WHEN 0 THEN 'Batter' WHEN 1 THEN 'Bowler' ELSE 'Allrounder' END AS role_group,
               CASE WHEN number % 5 < 3 THEN 'Right-hand bat' WHEN number % 5 = 3 THEN 'Left-hand bat' END AS batting_style,
               CASE number % 9 WHEN 0 THEN 'Off-spin' WHEN 1 THEN 'Leg-spin' WHEN 2 THEN 'Fast' WHEN 3 THEN 'Fast-medium' WHEN 4 THEN 'Medium' END AS bowling_type,
               CASE WHEN number % 9 IN (0, 1, 5) THEN 'Spin' WHEN number % 9 IN (2, 3, 4, 6) THEN 'Pace' END AS bowling_group,
               'Team ' || CAST(team_no AS STRING) || '|Club ' || CAST(number % 8 AS STRING) AS teams_played_for
        FROM a_players WHERE number % 10 <> 7""",
    "a_sheet": """
        SELECT 's' || CAST(number AS STRING) AS sheet_player_id, CASE WHEN number % 20 = 3 THEN 'Player ' || CAST(number - 1 AS STRING) ELSE player_name END AS batting_name, 'Full ' || player_name AS full_name,
               CASE WHEN number % 7 = 0 THEN 'Nowhere' ELSE 'TEAM ' || CAST(team_no AS STRING) END AS country_name, '19' || CAST(60 + number % 40 AS STRING) || '-0' || CAST(1 + number % 9 AS STRING) || '-1' || CAST(number % 10 AS STRING) || 'T00:00' AS date_of_birth,
               CASE number % 8 WHEN 0 THEN 'Batter' WHEN 1 THEN 'Opening batter' WHEN 2 THEN 'Wicketkeeper batter' WHEN 3 THEN 'Bowling allrounder' WHEN 4 THEN 'Bowler' WHEN 5 THEN 'Top-order batter' WHEN 6 THEN 'Allrounder' ELSE 'Unknown' END AS position_name,
               CASE WHEN number % 2 = 0 THEN 'Right-hand bat' ELSE 'Left-hand bat' END AS batting_style,
               CASE number % 12 WHEN 0 THEN 'Right-arm offbreak' WHEN 1 THEN 'Legbreak googly' WHEN 2 THEN 'Slow left-arm orthodox' WHEN 3 THEN 'Right-arm fast-medium' WHEN 4 THEN 'Left-arm fast' WHEN 5 THEN 'Right-arm medium' WHEN 6 THEN 'Right-arm slow' WHEN 7 THEN 'Left-arm slow-medium'
                    WHEN 8 THEN 'Right-arm bowler' WHEN 9 THEN ' ' WHEN 10 THEN 'Left-arm wrist-spin' END AS bowling_style,
               CASE WHEN number % 3 = 0 THEN 'Elsewhere XI' ELSE 'team-' || CAST(team_no AS STRING) || ' Reserves|Club ' || CAST(number % 8 AS STRING) END AS major_team_names,
               CASE WHEN number % 4 = 0 THEN '' ELSE 'https://example.org/' || CAST(number AS STRING) END AS headshot_url
        FROM a_players WHERE number % 9 <> 8""",
}


def oracle(names: tuple[str, ...] = tuple(TABLES)) -> list[str]:
    """The tables as common table expressions, in order."""
    return [f"{name} AS ({text})" for name, text in TABLES.items() if name in names]


def store(spark: SparkSession, sf_dir: str, keep: Callable[[DataFrame], DataFrame] | None = None, parts: int = 0) -> Mapping[str, DataFrame]:
    """The normalized store as DataFrames: matches, deliveries, wickets, innings, match_players, players and profiles.

    ``keep`` may store the balls, from which deliveries, wickets and innings follow row by row or within an innings; it is
    called when one of these is first asked for. With ``parts``, line items are dealt to so many partitions by match before
    they are numbered, so that the balls come dealt by match, and so do the wickets.
    """
    read: dict[str, DataFrame] = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in SOURCES}

    def made(name: str) -> DataFrame:
        if name in read:
            return read[name]
        text = TABLES[name]
        if parts and name == "a_balls":
            # Numbered before the join, so that the join keeps this dealing whatever the number of shuffle partitions.
            items = _sql(spark, f"SELECT *, 'm' || CAST(n AS STRING) AS match_id FROM ({_ITEMS}) i", read).repartition(parts, "match_id")
            numbered = f"SELECT x.*, {_SEQ.format('x.match_id')} FROM items x"
            df = _sql(spark, _BALLS.format(items=numbered, more="", on="m.match_id = x.match_id"), {"items": items, "a_matches": tables["a_matches"]})
        else:
            df = _sql(spark, text, {name: tables[name] for name in (*SOURCES, *TABLES) if re.search(rf"\b{name}\b", text)})
        if parts and name == "a_wickets":
            df = df.repartition(parts, "match_id")  # a union isn't known to lie by match
        return keep(df) if keep and name == "a_balls" else df

    tables = Lazily({name: partial(made, name) for name in (*SOURCES, *TABLES)})
    return Lazily({name.removeprefix("a_"): partial(tables.__getitem__, name) for name in TABLES if name != "a_balls"})


def _sql(spark: SparkSession, text: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Table names are parameters of ``spark.sql``, so that no view has to be registered."""
    named = re.sub(r"\b(FROM|JOIN) (" + "|".join(tables) + r")\b", r"\1 {\2}", text)
    return spark.sql(named, **{k: v for k, v in tables.items() if f"{{{k}}}" in named})
