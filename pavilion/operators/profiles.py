"""Player profiles: matching a sheet of people to player ids by evidence, owner overrides, and the taxonomy of styles."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pavilion.functions.text import country_in, plain, team_contains
from pavilion.sources.tables import StateStore

#: Roles of the sheet by group and subgroup.
ROLE_GROUPS = {
    "Batter": ("Batter", "Top-order batter", "Middle-order batter", "Opening batter", "Wicketkeeper", "Wicketkeeper batter"),
    "Allrounder": ("Allrounder", "Bowling allrounder", "Batting allrounder"),
    "Bowler": ("Bowler",),
}
ROLE_SUBGROUPS = {
    "Wicketkeeper": ("Wicketkeeper", "Wicketkeeper batter"),
    "Opening": ("Opening batter",),
    "Top-order": ("Top-order batter",),
    "Middle-order": ("Middle-order batter",),
    "Batting allrounder": ("Batting allrounder",),
    "Bowling allrounder": ("Bowling allrounder",),
}
#: Styles named in full, and words that tell a style, the more specific first.
STYLE_NAMES = {"Right-arm offbreak": "Off-spin", "Legbreak": "Leg-spin", "Legbreak googly": "Leg-spin", "Slow left-arm orthodox": "Slow left-arm orthodox", "Left-arm wrist-spin": "Left-arm wrist-spin"}
STYLE_WORDS = {"slow-medium": "Slow-medium", "medium-fast": "Medium-fast", "fast-medium": "Fast-medium", "medium": "Medium", "fast": "Fast"}
SPIN_WORDS, PACE_WORDS, BARE_SLOW = ("offbreak", "legbreak", "orthodox", "wrist-spin", "googly"), ("medium", "fast"), ("Right-arm slow", "Left-arm slow")
RIGHT_ARM_BY_DEFINITION = ("Legbreak", "Legbreak googly")
#: Precedence of override sources, the strongest first.
PRECEDENCE = ("manual", "reviewed", "ambiguous")


def _looked_up(column: Column, table: dict[str, tuple[str, ...]]) -> Column:
    out = F.lit(None).cast("string")
    for value, names in table.items():
        out = F.when(column.isin(*names), value).otherwise(out)
    return out


def _holds(text: Column, words: Iterable[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found |= F.contains(text, F.lit(w))
    return found


def bowling_type(style: Column) -> Column:
    low, out = F.lower(style), F.lit(None).cast("string")
    for word, value in reversed(STYLE_WORDS.items()):
        out = F.when(F.contains(low, F.lit(word)), value).otherwise(out)
    return F.coalesce(*[F.when(style == k, v) for k, v in STYLE_NAMES.items()], out)


def bowling_group(style: Column) -> Column:
    low = F.lower(style)
    return F.when(_holds(low, SPIN_WORDS), "Spin").when(_holds(low, PACE_WORDS), "Pace").when(style.isin(*BARE_SLOW), "Spin")


def bowling_arm(style: Column) -> Column:
    low = F.lower(style)
    return F.when(F.contains(low, F.lit("right-arm")), "Right").when(F.contains(low, F.lit("left-arm")), "Left").when(style.isin(*RIGHT_ARM_BY_DEFINITION), "Right")


def taxonomy(sheet: DataFrame, default_headshot: str = "") -> DataFrame:
    """The sheet's own words with role, arm, type and group derived from them."""
    style, url = F.nullif(F.trim("bowling_style"), F.lit("")), F.col("headshot_url")
    return sheet.withColumns({
        "role_group": _looked_up(F.col("position_name"), ROLE_GROUPS), "role_subgroup": _looked_up(F.col("position_name"), ROLE_SUBGROUPS),
        "bowling_arm": bowling_arm(style), "bowling_type": bowling_type(style), "bowling_group": bowling_group(style),
        "dob": F.col("date_of_birth").substr(1, 10).try_cast("date"), "has_real_headshot": F.coalesce((F.trim(url) != "") & (url != default_headshot), F.lit(False)),
    })


def universe(match_players: DataFrame, matches: DataFrame, players: DataFrame) -> DataFrame:
    """Everyone who was named in a team: flags, last match, matches and the teams they played for."""
    rows = match_players.where("player_id is not null").join(matches.select("match_id", "gender", "team_type", "match_date_1"), "match_id")
    flag = lambda c, v: F.max(F.when(F.col(c) == v, 1).otherwise(0))
    facts = rows.groupBy("player_id").agg(
        flag("gender", "male").alias("is_male"), flag("gender", "female").alias("is_female"), flag("team_type", "international").alias("is_intl"), flag("team_type", "club").alias("is_club"),
        F.max("match_date_1").alias("last_match"), F.count_distinct("match_id").alias("n_matches"), F.array_sort(F.collect_set("team")).alias("all_teams"),
        F.array_sort(F.collect_set(F.when(F.col("team_type") == "international", F.col("team")))).alias("intl_teams"),
    )
    return facts.join(players.select("player_id", "player_name"), "player_id")


def auto_matches(people: DataFrame, registry: DataFrame, sheet: DataFrame, held: Iterable[str] = ()) -> DataFrame:
    """player_id, sheet_player_id and tier: the same name, unique on both sides, with evidence.

    1a: an international whose country is among their teams; 1b: a club player with a club in common. Men only; held ids
    are left out.
    """
    once = lambda df, c: df.withColumn("_n", F.count("*").over(Window.partitionBy(c))).where("_n = 1").drop("_n")
    names = once(registry.select("player_id", "player_name"), "player_name").select("player_id")
    rows = once(sheet.where("batting_name is not null"), "batting_name")
    joined = people.join(names, "player_id", "left_semi").join(rows, people.player_name == rows.batting_name).where("is_male = 1")
    if held := [*held]:
        joined = joined.where(~F.col("player_id").isin(*held))
    first = (F.col("is_intl") == 1) & F.coalesce(country_in(F.col("intl_teams"), F.lower(F.trim("country_name"))), F.lit(False))
    second = (F.col("is_intl") == 0) & (F.col("is_club") == 1) & team_contains(F.col("major_team_names"), F.col("all_teams"))
    return joined.where(first | second).select("player_id", "sheet_player_id", F.when(F.col("is_intl") == 1, "1a").otherwise("1b").alias("match_tier"))


class ProfileError(ValueError):
    pass


def assert_one_to_one(matched: DataFrame) -> None:
    for key in ("player_id", "sheet_player_id"):
        bad = matched.groupBy(key).count().where("count > 1").limit(5).collect()
        if bad:
            raise ProfileError(f"{key} matched more than once: {', '.join(str(r[0]) for r in bad)}")


def overrides(sources: dict[str, DataFrame]) -> DataFrame:
    """One decision a player: of the strongest source, the last within it; with the number of decisions it overrules.

    Each source has player_id, sheet_player_id, action (match, no_match, no_profile) and row (its order). Of decisions of one
    row the first by action and sheet_player_id stands.
    """
    every = None
    for rank, name in enumerate(PRECEDENCE):
        if name in sources:
            own = sources[name].select("player_id", "sheet_player_id", "action", F.col("row").cast("long").alias("row"), F.lit(rank).alias("rank"), F.lit(name).alias("source"))
            every = own if every is None else every.unionByName(own)
    best = F.min_by(F.struct("sheet_player_id", "action", "source"), F.struct("rank", (-F.col("row")).alias("r"), "action", "sheet_player_id"))
    return every.groupBy("player_id").agg(best.alias("d"), (F.count("*") - 1).alias("shadowed")).select("player_id", "d.*", "shadowed")


def combined(auto: DataFrame, decided: DataFrame, sheet: DataFrame) -> DataFrame:
    """Automatic matches with decisions applied: forbidden pairs go, decided matches stand (if the sheet has the person), and those without a profile go."""
    forbid = decided.where("action = 'no_match'").select("player_id", "sheet_player_id")
    # A refusal without a person refuses every one.
    left = auto.join(forbid.where("sheet_player_id is not null"), ["player_id", "sheet_player_id"], "left_anti").join(forbid.where("sheet_player_id is null").select("player_id"), "player_id", "left_anti")
    forced = decided.where("action = 'match'").join(sheet.select("sheet_player_id"), "sheet_player_id", "left_semi").select("player_id", "sheet_player_id", F.col("source").alias("match_tier"))
    taken = forced.select("sheet_player_id")
    left = left.join(forced.select("player_id"), "player_id", "left_anti").join(taken, "sheet_player_id", "left_anti").select("player_id", "sheet_player_id", "match_tier")
    return left.unionByName(forced).join(decided.where("action = 'no_profile'").select("player_id"), "player_id", "left_anti")


def profiles(matched: DataFrame, sheet: DataFrame, registry: DataFrame) -> DataFrame:
    rows = taxonomy(sheet)
    joined = matched.join(rows, "sheet_player_id").join(registry.select("player_id", F.col("player_name").alias("registry_name")), "player_id")
    return joined.select("player_id", "registry_name", "full_name", F.col("country_name").alias("country"), "dob", F.col("position_name").alias("playing_role"), "role_group", "role_subgroup", "batting_style", "bowling_style", "bowling_arm", "bowling_type", "bowling_group", F.col("major_team_names").alias("teams_played_for"), "headshot_url", "has_real_headshot", "match_tier", "sheet_player_id")


def both_genders(people: DataFrame, known: Iterable[str] = ()) -> DataFrame:
    """Ids seen in men's and women's matches that nobody has looked at yet."""
    out = people.where("is_male = 1 and is_female = 1").select("player_id", "player_name")
    return out.where(~F.col("player_id").isin(*known)) if (known := [*known]) else out


def unmatched(people: DataFrame, matched: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """People without a profile, and not in an earlier report."""
    out = people.join(matched.select("player_id"), "player_id", "left_anti")
    return out if seen is None else out.join(seen.select("player_id"), "player_id", "left_anti")


def review_candidates(people: DataFrame, sheet: DataFrame) -> DataFrame:
    """For each person, every sheet row of the same name, or one row without; with the teams of each type."""
    rows = sheet.select(F.col("batting_name").alias("player_name"), "sheet_player_id", "country_name")
    return people.join(rows, "player_name", "left").select("player_id", "player_name", "n_matches", "last_match", F.size("intl_teams").cast("long").alias("n_intl_teams"), F.array_join("all_teams", "|").alias("teams"), "sheet_player_id", "country_name")


def fuzzy(people: DataFrame, sheet: DataFrame) -> DataFrame:
    """Weak candidates for a report, never matched by themselves: F1 the same normalised name, F2 surname and country, F3 with initials."""
    words = lambda c: F.split(F.trim(plain(F.col(c))), "\\s+")
    parts = lambda df, c: df.withColumns({"_last": F.element_at(words(c), -1), "_initials": F.array_join(F.transform(F.slice(words(c), 1, F.size(words(c)) - 1), lambda w: F.substring(w, 1, 1)), ""), "_all": F.array_join(words(c), " ")})
    own = parts(people, "player_name").select("player_id", "_last", "_initials", "_all", F.explode_outer(F.transform("intl_teams", lambda t: F.lower(t))).alias("_country"))
    rows = parts(sheet.where("batting_name is not null"), "batting_name").select("sheet_player_id", F.col("_last").alias("s_last"), F.col("_initials").alias("s_initials"), F.col("_all").alias("s_all"), F.lower("country_name").alias("s_country"))
    same = own.join(rows, F.col("_all") == F.col("s_all")).select("player_id", "sheet_player_id", F.lit("F1").alias("tier"))
    near = own.join(rows, (F.col("_last") == F.col("s_last")) & (F.col("_country") == F.col("s_country"))).select("player_id", "sheet_player_id", F.when(F.col("_initials") == F.col("s_initials"), "F3").otherwise("F2").alias("tier"))
    return same.unionByName(near).groupBy("player_id", "sheet_player_id").agg(F.min(F.when(F.col("tier") == "F1", 1).when(F.col("tier") == "F3", 2).otherwise(3)).alias("rank"))


def coverage_report(people: DataFrame, matched: DataFrame, years: int = 3) -> DataFrame:
    """Players and matched players by segment, the active ones counted to ``years`` before the newest match."""
    newest = people.agg(F.max("last_match").alias("newest"))
    rows = people.join(matched.select("player_id", F.lit(1).alias("m")), "player_id", "left").crossJoin(F.broadcast(newest))  # one row
    active = F.col("last_match") >= F.add_months("newest", -12 * years)
    segments = {"all": F.lit(True), "male": F.col("is_male") == 1, "female": F.col("is_female") == 1, "international": F.col("is_intl") == 1, "club only": (F.col("is_club") == 1) & (F.col("is_intl") == 0), "active": active}
    tagged = rows.withColumn("segment", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in segments.items()]))))
    return tagged.groupBy("segment").agg(F.count("*").alias("players"), F.coalesce(F.sum("m"), F.lit(0)).cast("long").alias("matched"))


#: Where a name of a ball, a wicket or a fielder stands, and what it is called in reports.
NAMED = (("deliveries", "batter", "batter"), ("deliveries", "bowler", "bowler"), ("deliveries", "non_striker", "non-striker"), ("deliveries", "player_out", "dismissed batter"), ("wickets", "player_out", "dismissed batter"), ("wicket_fielders", "fielder", "fielder"))


def registry_misses(store: dict[str, DataFrame], top: int = 50) -> DataFrame:
    """Names without an id by table, field and match, the most frequent of each field first; tables without a field are passed over."""
    every = None
    for table, name, field in NAMED:
        if table in store and {name, f"{name}_id"} <= set(store[table].columns):
            own = store[table].where(F.col(name).isNotNull() & F.col(f"{name}_id").isNull()).groupBy("match_id", F.col(name).alias("name")).agg(F.count("*").alias("n"))
            own = own.orderBy(F.desc("n"), "match_id", "name").limit(top).select(F.lit(table).alias("table"), F.lit(field).alias("field"), "match_id", "name", "n")
            every = own if every is None else every.unionByName(own)
    return every


def new_alerts(current: DataFrame, state: StateStore, now: dt.datetime, name: str = "unmatched", days: int = 7) -> DataFrame:
    """Whom to name in an alert now: ids of ``current`` that no alert has named, at most once in ``days``.

    The first run takes everyone as known and names nobody. Ids that are resolved are forgotten, so they are new if they
    come back; ids that a pause holds back stay new until an alert names them. The ids named so far are a table beside
    the state, a new one each run, and the state points at it last.
    """
    spark, before = current.sparkSession, state.get(name, {})
    ids = current.select("player_id").distinct()
    table = f"{state.root}/{name}-{uuid.uuid4().hex}"
    if not before:
        ids.write.parquet(table)
        state.put(name, {"alerted": table})
        return ids.limit(0)
    known = spark.read.parquet(before["alerted"]).join(ids, "player_id", "left_semi")
    fresh = ids.join(known, "player_id", "left_anti")
    last = before.get("last_alert_at")
    due = last is None or now - dt.datetime.fromisoformat(last) >= dt.timedelta(days=days)
    if not due or fresh.isEmpty():
        known.write.parquet(table)
        state.put(name, before | {"alerted": table})
        return ids.limit(0)
    known.withColumn("new", F.lit(False)).unionByName(fresh.withColumn("new", F.lit(True))).write.parquet(table)
    state.put(name, {"alerted": table, "last_alert_at": now.isoformat()})
    return spark.read.parquet(table).where("new").select("player_id")
