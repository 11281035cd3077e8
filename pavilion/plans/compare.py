"""Comparisons: two date windows, percentile radars, one player against a pool, medians, shares and phase families."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pavilion.functions.metrics import CATALOGUE, metric
from pavilion.functions.rules import PHASES
from pavilion.plans.leaderboard import grouped
from pavilion.plans.spec import Spec


def selected(spec: Spec, marts: dict[str, DataFrame], players: list[str] | None, keys: list[str]) -> DataFrame:
    """Metrics of chosen players (all, if None), conditions left out."""
    rows = grouped(replace(spec, columns=tuple(keys), sort=keys[0], groups=()), marts)
    return rows if players is None else rows.where(F.col("player_id").isin(*players) if players else F.lit(False))


def two_windows(spec: Spec, marts: dict[str, DataFrame], key: str, first: tuple[str, str], second: tuple[str, str], players: list[str] | None = None) -> DataFrame:
    """A metric before and after, for players with data in both windows (slope and dumbbell)."""
    m = metric(spec.namespace, key)
    sides = []
    for name, (a, z) in (("before", first), ("after", second)):
        rows = selected(replace(spec, date_from=a, date_to=z), marts, players, [key])
        sides.append(rows.where(m.has_data(F.col(key))).groupBy("player_id").agg(F.min("player_name").alias(f"name_{name}"), F.max(key).alias(name)))
    return sides[0].join(sides[1], "player_id").select("player_id", F.col("name_before").alias("player_name"), "before", "after", (F.col("after") - F.col("before")).alias("change"))


def long_form(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select("player_id", "player_name", *[F.col(k).cast("double").alias(k) for k in keys]).unpivot(["player_id", "player_name"], keys, "metric", "value")


def radar(spec: Spec, marts: dict[str, DataFrame], keys: list[str], players: list[str] | None = None) -> DataFrame:
    """Percentile of each metric within the pool of players who have data on every axis."""
    pool = selected(spec, marts, None, keys)
    known = CATALOGUE[spec.namespace]
    pool = pool.where(reduce(lambda a, b: a & b, [known[k].has_data(F.col(k)) for k in keys]))
    lower = [k for k in keys if known[k].higher_is_better is False]
    signed = F.when(F.col("metric").isin(*lower), -F.col("value")).otherwise(F.col("value")) if lower else F.col("value")
    ranked = long_form(pool, keys).withColumn("percentile", F.cume_dist().over(Window.partitionBy("metric").orderBy(signed)) * 100)
    return ranked if players is None else ranked.where(F.col("player_id").isin(*players))


def benchmark(spec: Spec, marts: dict[str, DataFrame], keys: list[str], anchor: str) -> DataFrame:
    """For each metric: the anchor's value, its rank, the pool's size, the best other player and the ratio to them in %.

    The ratio is turned so that above 100 is better for the anchor; it is null where a side is zero.
    """
    known = CATALOGUE[spec.namespace]
    rows = long_form(selected(spec, marts, None, keys), keys)
    lower = F.col("metric").isin(*[k for k in keys if known[k].higher_is_better is False] or [""])
    drop_zero = F.col("metric").isin(*[k for k in keys if not known[k].zero_is_data] or [""])
    rows = rows.where(F.col("value").isNotNull() & ~(drop_zero & (F.col("value") == 0))).withColumn("good", F.when(lower, -F.col("value")).otherwise(F.col("value")))
    own = rows.where(F.col("player_id") == anchor).groupBy("metric").agg(F.max("value").alias("value"), F.max("good").alias("own"))
    others = F.col("player_id") != anchor
    joined = rows.join(F.broadcast(own.select("metric", "own", F.col("value").alias("anchor_value"))), "metric")  # a row a metric
    best = F.min(F.when(others, F.struct((-F.col("good")).alias("o"), F.col("player_id").alias("id"), F.col("value").alias("v"))))
    out = joined.groupBy("metric").agg(F.first("anchor_value").alias("value"), (F.count_if(others & (F.col("good") > F.col("own"))) + 1).alias("rank"), F.count_distinct("player_id").alias("pool"), best.alias("b"))
    a, b = F.col("value"), F.col("b.v")
    return out.select("metric", "value", "rank", "pool", F.col("b.id").alias("best_id"), b.alias("best_value"), F.when((a != 0) & (b != 0), F.when(lower, b / a).otherwise(a / b) * 100).alias("ratio_pct"))


def medians(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Medians of both axes over the plotted points (both values known)."""
    return rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.median(F.col(x).cast("double")).alias("median_x"), F.median(F.col(y).cast("double")).alias("median_y"), F.count("*").alias("points"))


def shares(rows: DataFrame, key: str, top: int = 7) -> DataFrame:
    """The largest ``top`` players and all others together, with their share."""
    # Only the leaders need a global order: a top-k, not a sort of everyone.
    leaders = rows.where(F.col(key) > 0).orderBy(F.desc(key), "player_id").limit(top).select("player_id", F.lit(True).alias("_top"))
    named = rows.where(F.col(key) > 0).join(F.broadcast(leaders), "player_id", "left")
    parts = named.groupBy(F.when(F.col("_top"), F.col("player_id")).alias("player_id")).agg(F.min("player_name").alias("n"), F.count("*").alias("players"), F.sum(key).alias("value"))
    total = F.sum("value").over(Window.partitionBy())
    label = F.when(F.col("player_id").isNotNull(), F.col("n")).otherwise(F.concat(F.lit("Other ("), F.col("players").cast("string"), F.lit(" players)")))
    return parts.select(label.alias("label"), F.col("value").cast("long").alias("value"), (F.col("value") * F.lit(100.0) / total).alias("share"))


#: Families of grouped bars; middle overs have bars only for batters.
FAMILIES = {"batting": {"strike_rate": PHASES}, "bowling": {"economy": ("pp", "death"), "wickets": ("pp", "death")}}


def grouped_bars(spec: Spec, marts: dict[str, DataFrame], family: str, players: list[str]) -> DataFrame:
    """A family's metric in each phase; players with data in any of them stay."""
    prefix = "odi_" if spec.formats == ("50 Over",) else ""
    keys = [f"{prefix}{p}_{family}" for p in FAMILIES[spec.discipline][family]]
    rows = selected(spec, marts, players, keys)
    any_data = reduce(lambda a, b: a | b, [metric(spec.namespace, k).has_data(F.col(k)) for k in keys])
    return long_form(rows.where(any_data), keys)


def usable(rows: DataFrame, spec: Spec, axes: list[str]) -> DataFrame:
    """Whether each player can be drawn: data on every axis, and on any."""
    flags = [metric(spec.namespace, k).has_data(F.col(k)) for k in axes]
    return rows.select("player_id", reduce(lambda a, b: a & b, flags).alias("on_all_axes"), reduce(lambda a, b: a | b, flags).alias("on_any_axis"))


def auto_select(rows: DataFrame, mode: str, key: str, cap: int, higher_is_better: bool | None = True, games: DataFrame | None = None) -> DataFrame:
    """The first ``cap`` players: best or worst by a metric, or those with most career games."""
    if mode == "topnames":
        rows, order = rows.join(games, "player_id", "left"), F.col("games").desc_nulls_last()
    else:
        up = (mode == "best") == (higher_is_better is not False)
        order = F.col(key).desc_nulls_last() if up else F.col(key).asc_nulls_last()
    return rows.orderBy(order, "player_id").limit(cap)
