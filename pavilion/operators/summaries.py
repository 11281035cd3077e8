"""Summaries of an innings: batters, bowlers and spells, each relative to the team and to the time at the crease.

These follow the rules of the ingestion summaries, which differ from the marts': positions count strikers of balls that
aren't wides, a maiden is an over of six balls that aren't wides, and overs are written as complete.balls.

Sums over a batter's time at the crease are differences of running totals at its two ends, so they cost one window and
no join of balls with balls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pavilion.functions import rules as R
from pavilion.operators.marts import BALL, INNINGS, kept_innings

#: Fixed value: overs between two of a bowler's that begin a new spell.
SPELL_GAP = 3


def _pct(a: Column, b: Column) -> Column:
    return R.ratio(a, 1, b) * 100


def _n(condition: Column, value: Column | int = 1) -> Column:
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0)).cast("long")


def _kept(store: dict[str, DataFrame]) -> DataFrame:
    return store["deliveries"].join(kept_innings(store["innings"]).select(*INNINGS), INNINGS).withColumn("seq", F.row_number().over(Window.partitionBy(*INNINGS).orderBy("over_number", "ball_index")))


def _team_parts() -> dict[str, Column]:
    """Of a ball, what it adds to each team total; wides add nothing."""
    runs, on = F.coalesce("runs_batter", F.lit(0)), R.faced()
    hit = R.boundary(4) | R.boundary(6)
    value = lambda c, v: F.when(c, v).otherwise(0)
    return {"balls": value(on, 1), "runs": value(on, runs), "dots": value(on & (runs == 0), 1), "bb": value(on & hit, 1), "bnd": value(on & hit, runs)}


def _rates(p: str) -> dict[str, Column]:
    c = lambda n: F.col(f"{p}{n}")
    return {"sr": _pct(c("runs"), c("balls")), "dpt": _pct(c("dots"), c("balls")), "bpb": R.ratio(c("balls"), 1, c("bb")), "nbsr": _pct(c("runs") - c("bnd"), c("balls") - c("bb"))}


def batters(store: dict[str, DataFrame]) -> DataFrame:
    """One row for each batter of an innings who faced a ball that wasn't a wide."""
    balls = _kept(store)
    upto = Window.partitionBy(*INNINGS).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*INNINGS)
    parts = _team_parts()
    run = balls.withColumns({k: v for k, v in parts.items()})
    run = run.withColumns({f"r_{k}": F.sum(k).over(upto) for k in parts} | {f"t_{k}": F.sum(k).over(whole) for k in parts})
    keys = [*INNINGS, "batter"]
    runs, on = F.coalesce("runs_batter", F.lit(0)), R.faced()
    scored = lambda k: _n(on & (runs == k))
    inb = R.is_true("is_not_boundary")
    faced = run.where(F.col("batter").isNotNull()).groupBy(*keys).agg(
        F.min(F.when(on, F.col("seq"))).alias("first_faced"), F.min_by("batter_id", F.when(on, F.col("seq"))).alias("batter_id"),
        _n(on, runs).alias("runs"), _n(on).alias("balls_faced"), scored(0).alias("dots"), scored(1).alias("ones"), scored(2).alias("twos"), scored(3).alias("threes"), scored(5).alias("fives"),
        _n(on & R.boundary(4)).alias("fours"), _n(on & (runs == 4) & inb).alias("fours_run"), _n(on & R.boundary(6)).alias("sixes"), _n(on & (runs == 6) & inb).alias("sixes_run"),
        *[F.first(f"t_{k}").alias(f"t_{k}") for k in parts],
    ).where("first_faced is not null")
    at = run.select(*INNINGS, "seq", *[f"r_{k}" for k in parts], *parts, F.explode(F.array_distinct(F.array("batter", "non_striker"))).alias("batter")).where("batter is not null")
    ends = at.groupBy(*keys).agg(F.min("seq").alias("entry"), F.max("seq").alias("exit"), *[(F.max_by(f"r_{k}", "seq") - F.min_by(F.col(f"r_{k}") - F.col(k), "seq")).alias(f"w_{k}") for k in parts])
    kinds = store["wickets"].where("player_out is not null").groupBy(*INNINGS, F.col("player_out").alias("batter")).agg(F.max_by("kind", F.struct("over_number", "ball_index", "wicket_index")).alias("dismissal_kind"))
    joined = faced.join(ends, keys).join(kinds, keys, "left").join(partners(store), keys, "left")
    joined = joined.withColumn("batting_position", F.row_number().over(Window.partitionBy(*INNINGS).orderBy("first_faced")))
    joined = joined.withColumns({"bb": F.col("fours") + F.col("sixes"), "bnd": F.col("fours") * 4 + F.col("sixes") * 6, "balls": F.col("balls_faced")})
    own, team, window = _rates(""), _rates("t_"), _rates("w_")
    status = F.when(F.col("dismissal_kind").isNull(), "not out").when(F.col("dismissal_kind").isin("retired hurt", "retired out", "retired not out"), F.col("dismissal_kind")).otherwise("dismissed")
    return joined.select(
        *INNINGS, "batting_position", "batter", "batter_id", "entry", "exit", status.alias("status"), "dismissal_kind", F.coalesce("partners", F.lit(0)).cast("long").alias("partners"),
        "runs", "balls_faced", "dots", "ones", "twos", "threes", "fours", "fours_run", "fives", "sixes", "sixes_run", (F.col("runs") - F.col("bnd")).alias("non_boundary_runs"),
        own["sr"].alias("strike_rate"), own["dpt"].alias("dot_pct"), _pct(F.col("bnd"), F.col("runs")).alias("boundary_run_pct"), _pct(F.col("runs") - F.col("bnd"), F.col("runs")).alias("non_boundary_run_pct"),
        own["nbsr"].alias("non_boundary_sr"), own["bpb"].alias("balls_per_boundary"), R.ratio(F.col("balls_faced"), 1, F.col("fours")).alias("balls_per_four"), R.ratio(F.col("balls_faced"), 1, F.col("sixes")).alias("balls_per_six"), _pct(F.col("balls_faced"), F.col("t_balls")).alias("balls_faced_pct"),
        *[(own[k] - team[k]).alias(f"team_rel_{k}") for k in own], *[(own[k] - window[k]).alias(f"window_rel_{k}") for k in own],
    )


def partners(store: dict[str, DataFrame]) -> DataFrame:
    """Other players at the crease between a batter's first and last ball there.

    A range join within an innings: each name's appearances are cut to one (name, ball) row, and both ends are bounds.
    """
    balls = _kept(store).select(*INNINGS, "seq", F.explode(F.array_distinct(F.array("batter", "non_striker"))).alias("name")).where("name is not null")
    spans = balls.groupBy(*INNINGS, F.col("name").alias("batter")).agg(F.min("seq").alias("a"), F.max("seq").alias("z"))
    return spans.join(balls, INNINGS).where("seq between a and z and name <> batter").groupBy(*INNINGS, "batter").agg(F.count_distinct("name").alias("partners"))


def overs_notation(complete: Column, balls: Column) -> Column:
    """3 complete overs and 4 balls are 3.4; 0 and 10 are 0.10: the text, read as a number."""
    return F.concat_ws(".", complete.cast("string"), balls.cast("string")).cast("double")


def _per_over(balls: DataFrame, keys: list[str]) -> DataFrame:
    conceded = R.bowler_runs()
    return balls.groupBy(*keys, "over_number").agg(
        _n(R.legal()).alias("legal"), _n(R.faced()).alias("not_wide"), F.sum(conceded).cast("long").alias("runs"), _n(F.col("wides").isNotNull(), F.col("wides")).alias("wides_runs"), _n(F.col("noballs").isNotNull(), F.col("noballs")).alias("noball_runs"),
        _n(R.legal() & (F.coalesce("runs_batter", F.lit(0)) == 0)).alias("dots"), _n(R.legal() & R.boundary(4)).alias("fours"), _n(R.legal() & R.boundary(6)).alias("sixes"),
        *[_n(R.legal(), F.coalesce(f"k_{R.slug(k)}", F.lit(0))).alias(f"k_{R.slug(k)}") for k in R.CREDITED_KINDS], F.min("bowler_id").alias("bowler_id"),
    )


def _rollup(overs: DataFrame, keys: list[str]) -> DataFrame:
    """Totals of an innings or a spell from its overs."""
    edge = lambda c, f: f(c, F.col("over_number"))
    kinds = [f"k_{R.slug(k)}" for k in R.CREDITED_KINDS]
    out = overs.groupBy(*keys).agg(
        F.min("bowler_id").alias("bowler_id"), F.min("over_number").alias("first"), F.max("over_number").alias("last"), edge("legal", F.min_by).alias("first_legal"), edge("legal", F.max_by).alias("last_legal"),
        F.count_if(F.col("legal") == 6).alias("complete"), F.coalesce(F.sum(F.when(F.col("legal") < 6, F.col("legal"))), F.lit(0)).cast("long").alias("loose"),
        F.count_if((F.col("not_wide") == 6) & (F.col("runs") == 0)).alias("maidens"), *[F.sum(c).cast("long").alias(c) for c in ("runs", "wides_runs", "noball_runs", "dots", "fours", "sixes", *kinds)], F.sum("legal").cast("long").alias("balls"),
    )
    wickets = sum((F.col(k) for k in kinds), F.lit(0).cast("long"))
    mark = lambda over, legal: F.when(F.col(legal) == 6, F.col(over).cast("double")).otherwise(overs_notation(F.col(over), F.col(legal)))
    overs_col = overs_notation(F.col("complete"), F.col("loose"))
    base = out.withColumns({"overs": overs_col, "wickets": wickets, "first_over": mark("first", "first_legal"), "last_over": mark("last", "last_legal")})
    own = {"economy": F.when(F.col("overs") > 0, F.col("runs") / F.col("overs")), "per_ball": R.ratio(F.col("runs"), 1, F.col("balls")), "strike_rate": R.ratio(F.col("balls"), 1, F.col("wickets")), "dot_pct": _pct(F.col("dots"), F.col("balls")), "boundary_pct": _pct(F.col("fours") * 4 + F.col("sixes") * 6, F.col("runs"))}
    return base.withColumns(own).drop("first", "last", "first_legal", "last_legal", "complete", "loose")


def _bowled_overs(store: dict[str, DataFrame]) -> DataFrame:
    kinds = store["wickets"].where(R.credited()).groupBy(*BALL).agg(*[_n(F.col("kind") == k).alias(f"k_{R.slug(k)}") for k in R.CREDITED_KINDS])
    balls = _kept(store).join(kinds, BALL, "left").where("bowler is not null")
    overs = _per_over(balls, [*INNINGS, "bowler"])
    order = Window.partitionBy(*INNINGS, "bowler").orderBy("over_number")
    starts = F.when(F.col("over_number") - F.lag("over_number").over(order) >= SPELL_GAP, 1).otherwise(0)
    return overs.withColumn("_new", starts).withColumn("spell", (F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)) + 1).cast("long")).drop("_new")


def bowlers(store: dict[str, DataFrame]) -> DataFrame:
    """One row for each bowler of an innings, with overs, spells and rates relative to the whole team's."""
    overs = _bowled_overs(store)
    own = _rollup(overs, [*INNINGS, "bowler"]).join(overs.groupBy(*INNINGS, "bowler").agg(F.max("spell").alias("spells")), [*INNINGS, "bowler"])
    team = overs.groupBy(*INNINGS).agg(*[F.sum(c).cast("long").alias(f"t_{c}") for c in ("legal", "runs", "dots")], *[F.sum(f"k_{R.slug(k)}").alias(f"t_{R.slug(k)}") for k in R.CREDITED_KINDS])
    wickets = sum((F.col(f"t_{R.slug(k)}") for k in R.CREDITED_KINDS), F.lit(0).cast("long"))
    rel = {
        "team_rel_economy": F.col("economy") - R.ratio(F.col("t_runs"), 1, F.col("t_legal")) * 6,
        "team_rel_per_ball": F.col("per_ball") - R.ratio(F.col("t_runs"), 1, F.col("t_legal")),
        "team_rel_dot_pct": F.col("dot_pct") - _pct(F.col("t_dots"), F.col("t_legal")),
        "team_rel_strike_rate": F.col("strike_rate") - R.ratio(F.col("t_legal"), 1, wickets),
    }
    return own.join(team, INNINGS).withColumns(rel).drop(*[c for c in team.columns if c.startswith("t_")])


def spells(store: dict[str, DataFrame]) -> DataFrame:
    """Runs of a bowler's overs with fewer than SPELL_GAP overs from one to the next."""
    return _rollup(_bowled_overs(store), [*INNINGS, "bowler", "spell"])
