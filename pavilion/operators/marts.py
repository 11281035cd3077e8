"""Marts: eight denormalized tables built from the normalized store.

Each builder is a function of DataFrames. All aggregates of a mart share the grouping (match, innings, player), so their
left joins reuse one partitioning; dimensions (matches, innings, profiles) are joined without hints, and the optimizer
broadcasts them while they are small. Components by phase are generated from rules, not written out.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pavilion.functions import rules as R
from pavilion.sources.tables import Lazily

INNINGS = ["match_id", "innings_number"]
BALL = [*INNINGS, "over_number", "ball_index"]
CONTEXT = ["match_type", "gender", "team_type", "match_date", "year", "month"]
#: Primary key and clustering of each mart.
KEYS = {
    "players": ["player_id"],
    "matches": ["match_id"],
    "batting": [*INNINGS, "batter_id"],
    "bowling": [*INNINGS, "bowler_id"],
    "player_matches": ["match_id", "player_id"],
    "profiles": ["player_id"],
    "matchup_batting": [*INNINGS, "batter_id", "bowling_type"],
    "matchup_bowling": [*INNINGS, "bowler_id", "batting_hand", "batting_position"],
}


def _sum(condition: Column, value: Column | int = 1) -> Column:
    value = F.lit(value) if isinstance(value, int) else value
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0)).cast("long")


def _by_phase(components: dict[str, tuple[Column, Column | int]]) -> list[Column]:
    """The sums of all components in each phase of both families; those of the longer one are null in the short format."""
    out = []
    for family, phase in (("", "phase"), ("odi_", "odi_phase")):
        for p in R.PHASES:
            for name, (condition, value) in components.items():
                total = _sum(condition & (F.col(phase) == p), value)
                out.append((F.when(F.first(R.hundred()), F.lit(None)).otherwise(total) if family else total).alias(f"{family}{p}_{name}"))
    return out


def match_context(matches: DataFrame) -> DataFrame:
    return matches.select("match_id", "match_type", "gender", "team_type", F.col("match_date_1").alias("match_date"), F.year("match_date_1").alias("year"), F.month("match_date_1").alias("month"), "team_1", "team_2", "balls_per_over")


def kept_innings(innings: DataFrame) -> DataFrame:
    return innings.where(~R.is_true("super_over")).select(*INNINGS, "batting_team")


def delivery_facts(store: dict[str, DataFrame]) -> DataFrame:
    """Deliveries of kept innings with match context, opposing team, legal ordinal and both phases."""
    joined = store["deliveries"].join(kept_innings(store["innings"]), INNINGS).join(match_context(store["matches"]), "match_id")
    order = Window.partitionBy(*INNINGS).orderBy("over_number", "ball_index")
    count = F.when(R.legal(), 1).otherwise(0)
    upto = F.sum(count).over(order.rowsBetween(Window.unboundedPreceding, 0))
    # A ball that doesn't count has the ordinal of the next one that does; the first ball of an innings has no ball before it.
    before = F.coalesce(F.sum(count).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = joined.withColumn("legal_ordinal", F.when(R.legal(), upto).otherwise(before + 1)).withColumn("bowling_team", R.other_team())
    return numbered.withColumn("phase", R.t20_phase()).withColumn("odi_phase", R.odi_phase())


def first_appearances(store: dict[str, DataFrame]) -> DataFrame:
    """Every player who was at the crease in a kept innings, with name and batting position by first appearance.

    Within a ball, the striker comes before the non-striker before a player out.
    """
    if "crease" in store:
        return store["crease"]
    kept = kept_innings(store["innings"]).select(*INNINGS)
    d, w = store["deliveries"], store["wickets"]
    seen = [
        d.select(*BALL, F.lit(0).alias("role"), F.col("batter_id").alias("player"), F.col("batter").alias("name")),
        d.select(*BALL, F.lit(1).alias("role"), F.col("non_striker_id").alias("player"), F.col("non_striker").alias("name")),
        w.select(*BALL, F.lit(2).alias("role"), F.col("player_out_id").alias("player"), F.col("player_out").alias("name")),
    ]
    # Each kind of row is reduced to its first before they meet, and to kept innings after that.
    least = lambda df, *columns: df.groupBy(*INNINGS, "player").agg(*[F.min(c).alias(n) for n, c in columns])
    at = F.struct("over_number", "ball_index", "role")
    firsts = [least(df.where("player is not null"), ("first", at), ("name", F.col("name"))) for df in seen]
    every = firsts[0].unionByName(firsts[1]).unionByName(firsts[2])
    first = least(every, ("first", F.col("first")), ("name", F.col("name"))).join(kept, INNINGS)
    position = F.row_number().over(Window.partitionBy(*INNINGS).orderBy("first"))
    return first.select(*INNINGS, F.col("player").alias("batter_id"), F.col("name").alias("batter_name"), position.alias("batting_position"))


def credited_wickets(facts: DataFrame, wickets: DataFrame) -> DataFrame:
    """A row for each wicket that counts for the bowler, with its delivery's columns."""
    return wickets.where(R.credited()).select(*BALL, "kind").join(facts, BALL)


def batting(store: dict[str, DataFrame], facts: DataFrame) -> DataFrame:
    keys = [*INNINGS, "batter_id"]
    runs = F.col("runs_batter")
    faced, zero, four, six = R.faced(), R.faced() & (runs == 0), R.boundary(4), R.boundary(6)
    counter = F.sum(F.when(R.faced(), 1).otherwise(0)).over(Window.partitionBy(*keys).orderBy("over_number", "ball_index").rowsBetween(Window.unboundedPreceding, 0))
    balls = facts.where("batter_id is not null").withColumn("nth", counter)
    buckets = {"fb1_10": F.col("nth") <= 10, "fb11_20": F.col("nth").between(11, 20), "fb21p": F.col("nth") > 20}
    components = {"runs": (F.lit(True), runs), "balls": (faced, 1), "dots": (zero, 1), "fours": (four, 1), "sixes": (six, 1)}
    totals = balls.groupBy(*keys).agg(
        F.sum("runs_batter").cast("long").alias("runs"), _sum(faced).alias("balls_faced"), _sum(zero).alias("dots"), _sum(four).alias("fours_hit"), _sum(six).alias("sixes_hit"),
        *_by_phase(components),
        *[_sum(faced & inside, value).alias(f"{name}_{what}") for name, inside in buckets.items() for what, value in (("runs", runs), ("balls", 1))],
    )
    out = store["wickets"].where("player_out_id is not null")
    real = F.when(R.dismissal(), F.col("kind"))
    gone = out.groupBy(*INNINGS, F.col("player_out_id").alias("batter_id")).agg(F.max(F.when(R.dismissal(), 1).otherwise(0)).alias("dismissed"), F.coalesce(F.min(real), F.min("kind")).alias("dismissal_kind"))
    by_phase = out.where(R.dismissal()).select(*BALL, F.col("player_out_id").alias("out_id")).join(facts.select(*BALL, "phase", "odi_phase", "balls_per_over"), BALL)
    by_phase = by_phase.groupBy(*INNINGS, F.col("out_id").alias("batter_id")).agg(*_by_phase({"dismissals": (F.lit(True), 1)}))
    crease = first_appearances(store)
    context = kept_innings(store["innings"]).join(match_context(store["matches"]), "match_id").withColumn("bowling_team", R.other_team())
    joined = crease.join(totals, keys, "left").join(gone, keys, "left").join(by_phase, keys, "left").join(context, INNINGS)
    nulls = lambda c: F.when(R.hundred(), F.lit(None)).otherwise(F.coalesce(c, F.lit(0).cast("long"))) if c.startswith("odi_") else F.coalesce(c, F.lit(0).cast("long"))
    sums = [c for c in [*totals.columns, *by_phase.columns] if c not in keys]
    return joined.select(*keys, "batter_name", "batting_team", "bowling_team", *CONTEXT, "batting_position", F.coalesce("dismissed", F.lit(0)).alias("dismissed"), "dismissal_kind", *[nulls(c).alias(c) for c in sums])


def maidens(facts: DataFrame) -> DataFrame:
    """Overs in which one bowler bowled all legal balls of a full over and conceded nothing."""
    keys = [*INNINGS, "bowler_id"]
    overs = facts.groupBy(*keys, "over_number").agg(_sum(R.legal()).alias("legal"), F.sum(R.bowler_runs()).alias("runs"), F.first("balls_per_over").alias("full"))
    return overs.where("legal = full and runs = 0").groupBy(*keys).agg(F.count("*").alias("maidens"))


def bowling(store: dict[str, DataFrame], facts: DataFrame) -> DataFrame:
    keys = [*INNINGS, "bowler_id"]
    runs, balls = F.col("runs_batter"), facts.where("bowler_id is not null")
    zero = R.legal() & (runs == 0)
    components = {"balls": (R.legal(), 1), "runs_conceded": (F.lit(True), R.bowler_runs()), "dots": (zero, 1), "fours_conceded": (R.boundary(4), 1), "sixes_conceded": (R.boundary(6), 1)}
    totals = balls.groupBy(*keys).agg(
        F.min("bowler").alias("bowler_name"), *[F.first(c).alias(c) for c in ("bowling_team", "batting_team", *CONTEXT)], F.first(R.hundred()).alias("_hundred"),
        _sum(R.legal()).alias("balls"), F.sum(R.bowler_runs()).cast("long").alias("runs_conceded"), _sum(zero).alias("dots"), _sum(R.boundary(4)).alias("fours_conceded"), _sum(R.boundary(6)).alias("sixes_conceded"),
        _sum(F.col("wides").isNotNull(), F.col("wides")).alias("wides_runs"), _sum(F.col("noballs").isNotNull(), F.col("noballs")).alias("noball_runs"), *_by_phase(components),
    )
    taken = credited_wickets(balls, store["wickets"]).groupBy(*keys).agg(F.count("*").alias("wickets"), *[_sum(F.col("kind") == k).alias(f"wickets_{R.slug(k)}") for k in R.CREDITED_KINDS], *_by_phase({"wickets": (F.lit(True), 1)}))
    joined = totals.join(taken, keys, "left").join(maidens(balls), keys, "left")
    sums = [c for c in taken.columns if c not in keys] + ["maidens"]
    filled = [(F.when(F.col("_hundred"), F.lit(None)).otherwise(F.coalesce(c, F.lit(0).cast("long"))) if c.startswith("odi_") else F.coalesce(c, F.lit(0).cast("long"))).alias(c) for c in sums]
    return joined.select(*[c for c in totals.columns if c != "_hundred"], *filled)


def _mapped(profiles: DataFrame, player: str) -> DataFrame:
    kind = F.coalesce("bowling_type", "bowling_group", F.lit(R.UNMAPPED))
    return profiles.select(F.col("player_id").alias(player), kind.alias("bowling_type"), F.coalesce("bowling_group", F.lit(R.UNMAPPED)).alias("bowling_group"), F.coalesce("batting_style", F.lit(R.UNMAPPED)).alias("batting_hand"))


def _with_profile(balls: DataFrame, store: Mapping[str, DataFrame], player: str, columns: list[str]) -> DataFrame:
    """The balls with columns of a player's profile. Profiles meet each match's players, not its balls, which stay where they are."""
    known = _mapped(store["profiles"], player).select(player, *columns)
    of_match = store["deliveries"].select("match_id", player).distinct().join(known, player).repartition("match_id")  # a side that moves anyway: the other stays
    return balls.join(of_match, ["match_id", player], "left").fillna(R.UNMAPPED, columns)


def _wickets_per_ball(wickets: DataFrame) -> DataFrame:
    """Credited wickets of each ball, in all and by kind."""
    return wickets.where(R.credited()).groupBy(*BALL).agg(F.count("*").alias("w"), *[_sum(F.col("kind") == k).alias(f"w_{R.slug(k)}") for k in R.CREDITED_KINDS])


def matchup_batting(store: dict[str, DataFrame], facts: DataFrame) -> DataFrame:
    """A batter's record against each style of bowling in an innings."""
    keys = [*INNINGS, "batter_id", "bowling_type"]
    runs, faced, zero = F.col("runs_batter"), R.faced(), R.faced() & (F.col("runs_batter") == 0)
    w = F.coalesce("w", F.lit(0))
    balls = _with_profile(facts.where("batter_id is not null"), store, "bowler_id", ["bowling_type", "bowling_group"]).join(_wickets_per_ball(store["wickets"]), BALL, "left")
    components = {"runs": (F.lit(True), runs), "balls": (faced, 1), "dots": (zero, 1), "fours": (R.boundary(4), 1), "sixes": (R.boundary(6), 1), "dismissals": (F.lit(True), w)}
    kinds = [_sum(F.lit(True), F.coalesce(f"w_{R.slug(k)}", F.lit(0))).alias(f"dis_{R.slug(k)}") for k in R.CREDITED_KINDS]
    out = balls.groupBy(*keys, "bowling_group").agg(
        F.min("batter").alias("batter_name"), *[F.first(c).alias(c) for c in ("batting_team", "bowling_team", *CONTEXT)],
        F.sum("runs_batter").cast("long").alias("runs"), _sum(faced).alias("balls_faced"), _sum(zero).alias("dots"), _sum(R.boundary(4)).alias("fours_hit"), _sum(R.boundary(6)).alias("sixes_hit"),
        _sum(F.lit(True), w).alias("dismissals"), *kinds, *_by_phase(components),
    )
    return out.join(first_appearances(store).drop("batter_name"), [*INNINGS, "batter_id"], "left")


def matchup_bowling(store: dict[str, DataFrame], facts: DataFrame) -> DataFrame:
    """A bowler's record against each hand and batting position of the striker in an innings."""
    keys = [*INNINGS, "bowler_id", "batting_hand", "batting_position"]
    runs, w = F.col("runs_batter"), F.coalesce("w", F.lit(0))
    zero = R.legal() & (runs == 0)
    balls = _with_profile(facts.where("bowler_id is not null"), store, "batter_id", ["batting_hand"])
    balls = balls.join(first_appearances(store).drop("batter_name"), [*INNINGS, "batter_id"], "left").join(_wickets_per_ball(store["wickets"]), BALL, "left")
    components = {"balls": (R.legal(), 1), "runs_conceded": (F.lit(True), R.bowler_runs()), "wickets": (F.lit(True), w), "dots": (zero, 1), "fours_conceded": (R.boundary(4), 1), "sixes_conceded": (R.boundary(6), 1)}
    kinds = [_sum(F.lit(True), F.coalesce(f"w_{R.slug(k)}", F.lit(0))).alias(f"wkt_{R.slug(k)}") for k in R.CREDITED_KINDS]
    return balls.groupBy(*keys).agg(
        F.min("bowler").alias("bowler_name"), *[F.first(c).alias(c) for c in ("bowling_team", "batting_team", *CONTEXT)],
        _sum(R.legal()).alias("balls"), F.sum(R.bowler_runs()).cast("long").alias("runs_conceded"), _sum(F.lit(True), w).alias("wickets"), _sum(zero).alias("dots"), _sum(R.boundary(4)).alias("fours_conceded"), _sum(R.boundary(6)).alias("sixes_conceded"),
        *kinds, *_by_phase(components),
    )


def player_matches(store: dict[str, DataFrame]) -> DataFrame:
    """Everyone who played: the teams as named, and whoever was on a ball without being named."""
    context = match_context(store["matches"]).drop("team_1", "team_2", "balls_per_over")
    named = store["match_players"].where("player_id is not null").groupBy("match_id", "player_id").agg(F.min("player_name").alias("player_name"), F.min("team").alias("team"))
    sides = kept_innings(store["innings"]).join(store["matches"].select("match_id", "team_1", "team_2"), "match_id").withColumn("bowling_team", R.other_team()).select(*INNINGS, "batting_team", "bowling_team")
    d, w = store["deliveries"], store["wickets"]
    acts = [(d, "batter", "batting_team"), (d, "non_striker", "batting_team"), (d, "bowler", "bowling_team"), (w, "player_out", "batting_team")]
    least = lambda df: df.groupBy("match_id", "player_id").agg(*[F.min(c).alias(c) for c in ("player_name", "as_bat", "any_side")])
    active = None
    for frame, who, side in acts:
        own = frame.where(f"{who}_id is not null").join(sides, INNINGS).select("match_id", F.col(f"{who}_id").alias("player_id"), F.col(who).alias("player_name"), F.when(F.lit(side == "batting_team"), F.col(side)).alias("as_bat"), F.col(side).alias("any_side"))
        own = least(own)  # a row a player before the kinds meet
        active = own if active is None else active.unionByName(own)
    extra = least(active).join(named, ["match_id", "player_id"], "left_anti").select("match_id", "player_id", "player_name", F.coalesce("as_bat", "any_side").alias("team"))
    return named.unionByName(extra).join(context, "match_id")


def matches(store: dict[str, DataFrame]) -> DataFrame:
    date = F.col("match_date_1")
    return store["matches"].select("match_id", "match_type", "gender", "team_type", date.alias("match_date"), F.year(date).alias("year"), F.month(date).alias("month"), "venue", "city", "event_name", "team_1", "team_2", "winner", "result_type")


def players(store: dict[str, DataFrame]) -> DataFrame:
    return store["players"].select("player_id", "player_name").join(store["match_players"].where("player_id is not null"), "player_id", "left_semi")


def build(store: Mapping[str, DataFrame], keep: Callable[[str, DataFrame], DataFrame] = lambda _, df: df) -> Mapping[str, DataFrame]:
    """All marts, each made when it is first asked for. ``keep`` may store what several of them read: the deliveries' facts
    and first appearances. These move to what they are joined with, which is wider."""
    shared = Lazily({name: partial(store.__getitem__, name) for name in store} | {"facts": lambda: keep("facts", delivery_facts(store)), "crease": lambda: keep("crease", first_appearances(store).repartition("match_id"))})
    return Lazily({
        "players": lambda: players(shared),
        "matches": lambda: matches(shared),
        "batting": lambda: batting(shared, shared["facts"]),
        "bowling": lambda: bowling(shared, shared["facts"]),
        "player_matches": lambda: player_matches(shared),
        "profiles": lambda: shared["profiles"],
        "matchup_batting": lambda: matchup_batting(shared, shared["facts"]),
        "matchup_bowling": lambda: matchup_bowling(shared, shared["facts"]),
    })
