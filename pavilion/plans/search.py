"""Search and option lists: relevance tiers, counts of matches, career games, and sections of one player."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pavilion.functions.metrics import CATALOGUE, metric, ratio
from pavilion.functions.rules import UNMAPPED
from pavilion.plans.spec import Spec, scoped


def tier(column: str, text: str) -> Column:
    """0 the same, 1 begins with it, 2 holds it, else null; case doesn't count and no character is special."""
    value, wanted = F.lower(F.col(column)), F.lit(text.lower())
    return F.when(value == wanted, 0).when(F.startswith(value, wanted), 1).when(F.contains(value, wanted), 2)


def career_games(marts: dict[str, DataFrame]) -> DataFrame:
    return marts["player_matches"].groupBy("player_id").agg(F.count_distinct("match_id").alias("games"))


def players(marts: dict[str, DataFrame], text: str, limit: int = 25) -> DataFrame:
    """Players by any name they have had: best tier first, then most games. Only hits are counted and looked up."""
    every = marts["players"].select("player_id", "player_name").unionByName(marts["player_matches"].select("player_id", "player_name")).distinct()
    hits = every.withColumn("tier", tier("player_name", text)).where("tier is not null").groupBy("player_id").agg(F.min("tier").alias("tier"))
    own = marts["player_matches"].join(hits, "player_id", "left_semi")
    facts = own.groupBy("player_id").agg(F.count_distinct("match_id").alias("games"), F.max("match_date").alias("last_match"), F.max_by("player_name", F.struct("match_date", "match_id")).alias("player_name"), F.max_by("gender", F.struct("match_date", "match_id")).alias("gender"))
    roles = marts["profiles"].select("player_id", "role_group")
    return hits.join(facts, "player_id").join(roles, "player_id", "left").orderBy("tier", F.desc("games"), "player_name", "player_id").limit(limit)


def roster(spec: Spec, marts: dict[str, DataFrame], text: str = "", limit: int = 25) -> DataFrame:
    """Players of a scope by part of their name, those with most innings first."""
    rows = scoped(replace(spec, search=text.strip()), marts).groupBy(F.col(spec.id_column).alias("player_id"), F.col(spec.name_column).alias("player_name")).agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "player_name", "player_id").limit(limit)


def career(spec: Spec, marts: dict[str, DataFrame], text: str, limit: int = 20) -> DataFrame:
    """Career totals of players by part of their name, with rates to two places; the most runs or wickets first."""
    keys = {"batting": ("innings", "runs", "balls_faced", "average", "strike_rate", "fours", "sixes", "high_score"), "bowling": ("innings", "balls", "runs_conceded", "wickets", "average", "economy")}[spec.discipline]
    rows = scoped(replace(spec, search=text.strip()), marts).groupBy(F.col(spec.id_column).alias("player_id"), F.col(spec.name_column).alias("player_name"))
    values = [F.round(m.expr(), 2).alias(m.key) if m.kind == "rate" else m.expr().alias(m.key) for m in (metric(spec.discipline, k) for k in keys)]
    extra = F.sum("dismissed").alias("dismissals") if spec.discipline == "batting" else F.max("wickets").alias("best")
    return rows.agg(*values, extra).orderBy(F.desc("runs" if spec.discipline == "batting" else "wickets"), "player_id", "player_name").limit(limit)


def options(marts: dict[str, DataFrame], column: str, gender: str, text: str = "") -> DataFrame:
    """Values of ``column`` (``team``, ``event_name`` or ``venue``) with matches and the latest date, most relevant first."""
    rows = marts["matches"].where(F.col("gender") == gender)
    if column == "team":
        rows = rows.select("match_id", "match_date", F.explode(F.array_distinct(F.array("team_1", "team_2"))).alias("team"))
    rows = rows.where(F.col(column) != "").groupBy(F.col(column).alias("option")).agg(F.count_distinct("match_id").alias("games"), F.max("match_date").alias("latest"))
    if text:
        rows = rows.withColumn("tier", tier("option", text)).where("tier is not null")
    else:
        rows = rows.withColumn("tier", F.lit(0))
    return rows.orderBy("tier", F.desc("games"), *([F.desc("latest")] if column == "event_name" else []), "option")


def distinct_options(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def by_vocabulary(rows: DataFrame, column: str, preferred: list[str], last: tuple[str, ...] = (UNMAPPED,)) -> DataFrame:
    """Known values in their order, then others by name, then the buckets of ``last``."""
    known = F.array_position(F.array(*map(F.lit, preferred)), F.col(column))
    return rows.orderBy(F.col(column).isin(*last), F.when(known > 0, known).otherwise(len(preferred) + 1), column)


# ---- one player -----------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Overlay:
    """A narrowing of one player's page; not every section can be narrowed by everything."""

    date_from: str | None = None
    date_to: str | None = None
    positions: tuple[int, ...] = ()
    opposition: tuple[str, ...] = ()
    vs: str | None = None


@dataclass(frozen=True)
class Unsupported:
    """What a section can't be narrowed by."""

    unsupported: tuple[str, ...]


#: What each section of a discipline can be narrowed by.
SUPPORT = {
    ("batting", "core"): {"dates", "positions", "opposition", "vs"},
    ("batting", "positions"): {"dates", "opposition", "vs"},
    ("batting", "opposition"): {"dates", "positions", "vs"},
    ("batting", "matchups"): {"dates", "positions", "opposition"},
    ("bowling", "core"): {"dates", "opposition"},
    ("bowling", "opposition"): {"dates"},
    ("bowling", "matchups"): {"dates", "positions", "opposition"},
}


def player_rows(spec: Spec, marts: dict[str, DataFrame], player: str, section: str, overlay: Overlay = Overlay()) -> DataFrame | Unsupported:
    asked = {n for n, on in (("dates", overlay.date_from or overlay.date_to), ("positions", overlay.positions), ("opposition", overlay.opposition), ("vs", overlay.vs)) if on}
    if bad := asked - SUPPORT[spec.discipline, section]:
        return Unsupported(tuple(sorted(bad)))
    mart = f"matchup_{spec.discipline}" if section == "matchups" or overlay.vs else spec.discipline
    fixed = Spec(discipline=spec.discipline, gender=None, formats=spec.formats, date_from=overlay.date_from or spec.date_from, date_to=overlay.date_to or spec.date_to, team_type=spec.team_type)
    rows = scoped(replace(fixed), marts, mart).where(F.col(spec.id_column) == player)
    if overlay.positions:
        rows = rows.where(F.col("batting_position").isin(*overlay.positions))
    if overlay.opposition:
        rows = rows.where(F.col(spec.other_team).isin(*overlay.opposition))
    if overlay.vs:
        rows = rows.where(F.col("bowling_group" if overlay.vs in ("Pace", "Spin") else "bowling_type") == overlay.vs)
    return rows


def profile(marts: dict[str, DataFrame], player: str) -> DataFrame:
    """A player's profile: a row, or none."""
    return marts["profiles"].where(F.col("player_id") == player)


def gender_of(marts: dict[str, DataFrame], player: str) -> DataFrame:
    """The gender of a player's latest match: a row, null for someone who never played."""
    return marts["player_matches"].where(F.col("player_id") == player).agg(F.max_by("gender", F.struct("match_date", "match_id")).alias("gender"))


def hands(rows: DataFrame) -> DataFrame:
    """A bowler's record against each batting hand: every metric that sums over an innings' parts, most balls first."""
    keys = [k for k, m in CATALOGUE["matchup_bowling"].items() if m.form in ("sum", "ratio", "innings")]
    return rows.groupBy("batting_hand").agg(*[metric("matchup_bowling", k).expr().alias(k) for k in keys]).orderBy(F.desc("balls"), "batting_hand")


def core(rows: DataFrame, namespace: str, keys: list[str]) -> DataFrame:
    """One row, whatever there is."""
    return rows.agg(*[metric(namespace, k).expr().alias(k) for k in keys])


def section(rows: DataFrame, namespace: str, by: str, keys: list[str]) -> DataFrame:
    return rows.groupBy(by).agg(*[metric(namespace, k).expr().alias(k) for k in keys]).orderBy(by)


def coverage(rows: DataFrame, balls: str, bucket: str) -> DataFrame:
    """Balls in all and those against opponents of a known kind."""
    known = F.sum(F.when(F.col(bucket) != UNMAPPED, F.col(balls)))
    return rows.agg(F.coalesce(F.sum(balls), F.lit(0)).alias("balls"), F.coalesce(known, F.lit(0)).alias("mapped_balls"))


def matchups(rows: DataFrame, discipline: str, fine: bool = True) -> DataFrame:
    """A player's record against each kind of opponent: Pace, Spin, then unmapped; fine rows by balls within a group."""
    namespace, balls = f"matchup_{discipline}", "balls_faced" if discipline == "batting" else "balls"
    keys = ["runs", "average", "strike_rate"] if discipline == "batting" else ["runs_conceded", "wickets", "average", "economy"]
    by = (["bowling_group", "bowling_type"] if fine else ["bowling_group"]) if discipline == "batting" else ["batting_hand"]
    out = rows.groupBy(*by).agg(F.sum(balls).cast("long").alias("balls"), *[metric(namespace, k).expr().alias(k) for k in keys])
    order = F.array_position(F.array(*map(F.lit, ("Pace", "Spin", "Right-hand bat", "Left-hand bat", UNMAPPED))), F.col(by[0]))
    return out.orderBy(order, F.desc("balls"), *by)


def bars(rows: DataFrame, label: str, count: str) -> DataFrame:
    """Counts without zeros, largest first, with their share of all."""
    total = F.sum(count).over(Window.partitionBy())
    return rows.where(F.col(count) > 0).select(label, count, ratio(F.col(count), 100, total).alias("pct")).orderBy(F.desc(count), label)
