"""Rules of the game as Column builders. Every mart and summary uses these and states none of its own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Closed vocabularies.
CREDITED_KINDS = ("bowled", "lbw", "caught", "caught and bowled", "stumped", "hit wicket")
NON_DISMISSAL_KINDS = ("retired hurt", "retired not out")
UNMAPPED = "(unmapped)"
BOWLING_TYPES = ("Off-spin", "Leg-spin", "Slow left-arm orthodox", "Left-arm wrist-spin", "Medium", "Medium-fast", "Fast-medium", "Fast", "Slow-medium", "Pace", "Spin", UNMAPPED)
BATTING_HANDS = ("Right-hand bat", "Left-hand bat", UNMAPPED)
BOWLING_GROUPS = ("Pace", "Spin", UNMAPPED)
T20_TYPES, ODI_TYPES = ("T20", "IT20"), ("ODI", "ODM")
HUNDRED_BALLS = 5
PHASES = ("pp", "mid", "death")
#: First over after each phase, by family; for the short format, last legal ball of each.
T20_ENDS, ODI_ENDS, HUNDRED_ENDS = (6, 15, 20), (10, 40, 50), (25, 75)


def is_true(flag: str) -> Column:
    return F.coalesce(F.col(flag), F.lit(False))


def legal() -> Column:
    """A ball that counts in the over."""
    return F.col("wides").isNull() & F.col("noballs").isNull()


def faced() -> Column:
    """A ball that the striker faced: no-balls count, wides don't."""
    return F.col("wides").isNull()


def boundary(runs: int) -> Column:
    return (F.col("runs_batter") == runs) & ~is_true("is_not_boundary")


def bowler_runs() -> Column:
    """What a bowler concedes: no byes or leg byes."""
    return F.coalesce("runs_batter", F.lit(0)) + F.coalesce("noballs", F.lit(0)) + F.coalesce("wides", F.lit(0))


def hundred() -> Column:
    return F.col("balls_per_over") == HUNDRED_BALLS


def _phase(ends: tuple[int, ...], over: Column) -> Column:
    out = F.when(over < ends[0], PHASES[0])
    out = out.when(over < ends[1], PHASES[1])
    return out.when(over < ends[2], PHASES[2]) if len(ends) == 3 else out.otherwise(PHASES[2])


def t20_phase() -> Column:
    """pp, mid or death by over; where overs have five balls, by the ordinal of the legal ball."""
    by_ball = F.when(F.col("legal_ordinal") <= HUNDRED_ENDS[0], PHASES[0]).when(F.col("legal_ordinal") <= HUNDRED_ENDS[1], PHASES[1]).otherwise(PHASES[2])
    return F.when(hundred(), by_ball).otherwise(_phase(T20_ENDS, F.col("over_number")))


def odi_phase() -> Column:
    return F.when(~F.coalesce(hundred(), F.lit(False)), _phase(ODI_ENDS, F.col("over_number")))


def credited(kind: str = "kind") -> Column:
    return F.col(kind).isin(*CREDITED_KINDS)


def dismissal(kind: str = "kind") -> Column:
    return ~F.col(kind).isin(*NON_DISMISSAL_KINDS)


def ratio(numerator: Column, scale: float, denominator: Column) -> Column:
    """A double, null where the denominator is zero or null."""
    return numerator.cast("double") * F.lit(float(scale)) / F.nullif(denominator, F.lit(0).cast("long")).cast("double")


def other_team(team: str = "batting_team") -> Column:
    return F.when(F.col("team_1") == F.col(team), F.col("team_2")).otherwise(F.col("team_1"))


def slug(kind: str) -> str:
    return kind.replace(" ", "_")
