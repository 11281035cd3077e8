"""Leaderboards: a specification compiled to one grouped plan, plain or versus a kind of opponent."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pavilion.functions.metrics import CATALOGUE, Metric, best_rank, figures, metric, ratio
from pavilion.plans.spec import VS_COLUMNS, Spec, gate, regular_position, scoped

INNINGS = ["match_id", "innings_number"]


def _wanted(spec: Spec) -> list[Metric]:
    """Columns, the sort and every metric under a condition, each once."""
    keys = [*spec.columns, spec.sort, *(c.key for g in spec.groups for c in g if c.complete())]
    return [CATALOGUE[spec.namespace][k] for k in dict.fromkeys(keys) if k in CATALOGUE[spec.namespace]]


def grouped(spec: Spec, marts: dict[str, DataFrame]) -> DataFrame:
    """player_id, player_name and every metric asked for (``<key>__sort`` for figures), conditions applied, unordered."""
    return _versus(spec, marts) if spec.vs_active else _plain(spec, marts)


def _plain(spec: Spec, marts: dict[str, DataFrame]) -> DataFrame:
    wanted = _wanted(spec)
    rows = scoped(spec, marts)
    own = [F.col(spec.id_column).alias("player_id"), F.col(spec.name_column).alias("player_name")]
    # Matches come from who played, not from who batted or bowled, unless a filter is about innings.
    side = any(m.key == "matches" for m in wanted) and not (spec.positions or spec.opposition)
    aggregates = [m.expr().alias(m.key) for m in wanted if m.form != "position" and not (side and m.key == "matches")]
    aggregates += [m.sort_expr().alias(f"{m.key}__sort") for m in wanted if m.is_text]
    out = rows.groupBy(*own).agg(*aggregates or [F.count("*").alias("_rows")])
    if side:
        played = marts["player_matches"].where(spec.core())
        if spec.teams:
            at = F.col("team").isin(*spec.teams)
            played = played.where(at | F.col("player_id").isin(*spec.pins) if spec.pins else at)
        if spec.events or spec.venues:
            played = played.join(rows.select("match_id").distinct(), "match_id", "left_semi")
        out = out.join(played.groupBy("player_id").agg(F.count_distinct("match_id").alias("matches")), "player_id", "left")
    if any(m.form == "position" for m in wanted):
        out = out.join(regular_position(spec, marts).withColumnRenamed("_player", "player_id"), "player_id", "left")
    test = gate(spec, {m.key: F.col(f"{m.key}__sort" if m.is_text else m.key) for m in wanted})
    return out.where(test) if test is not None else out


def _versus(spec: Spec, marts: dict[str, DataFrame]) -> DataFrame:
    """One scan gives the restricted metrics, their coverage and the composition: the restriction is inside the aggregates.

    Coverage sums all names of a player, so it is a window over the groups, and it stands *below* the filter for
    players who met the opponent at all, which would otherwise cut other names' balls.
    """
    rows = scoped(spec, marts)
    dim, balls = VS_COLUMNS[spec.vs.dim], "balls_faced" if spec.discipline == "batting" else "balls"
    group = "bowling_group" if spec.discipline == "batting" else "batting_hand"
    inside = F.col(dim) == spec.vs.value
    own = [F.col(spec.id_column).alias("player_id"), F.col(spec.name_column).alias("player_name")]
    wanted = _wanted(spec)
    peaks = [m for m in wanted if m.kind == "peak"]
    compositions = [m for m in wanted if m.kind == "composition"]
    partials = [F.sum(balls).alias("_all"), F.sum(F.when(F.col(group) != "(unmapped)", F.col(balls))).alias("_known"), metric(spec.namespace, "innings").expr(inside).alias("_met")]
    partials += [F.sum(F.when(F.col(group) == m.member, F.col(balls))).alias(f"_c_{m.key}") for m in compositions]
    out = rows.groupBy(*own).agg(*[m.expr(inside).alias(m.key) for m in wanted if m.kind not in ("peak", "composition", "position")], *partials)
    person = Window.partitionBy("player_id")
    total = lambda c: F.sum(c).over(person)
    out = out.withColumns({"balls_in_scope": total("_all"), "balls_mapped": F.coalesce(total("_known"), F.lit(0).cast("long")), **{m.key: ratio(F.coalesce(total(f"_c_{m.key}"), F.lit(0)), 100, total("_all")) for m in compositions}})
    for m in peaks:
        best = peak(rows.where(inside), m, spec)
        out = out.join(best, ["player_id"], "left")
    if any(m.form == "position" for m in wanted):
        out = out.join(regular_position(spec, marts).withColumnRenamed("_player", "player_id"), "player_id", "left")
    met = F.col("_met") >= 1
    out = out.where(met | F.col("player_id").isin(*spec.pins) if spec.pins else met)
    test = gate(spec, {m.key: F.col(f"{m.key}__sort" if m.is_text else m.key) for m in wanted})
    out = out.where(test) if test is not None else out
    return out.drop("_all", "_known", "_met", *[f"_c_{m.key}" for m in compositions])


def peak(rows: DataFrame, m: Metric, spec: Spec) -> DataFrame:
    """The best innings: rows of an innings (several positions or styles) are summed first."""
    inner = rows.groupBy(F.col(spec.id_column).alias("player_id"), *INNINGS).agg(*[F.sum(c).alias(c) for c in m.num])
    if m.is_text:
        rank = best_rank("wickets", "runs_conceded")
        return inner.groupBy("player_id").agg(F.max_by(figures("wickets", "runs_conceded"), rank).alias(m.key), F.max(rank).alias(f"{m.key}__sort"))
    return inner.groupBy("player_id").agg(F.max(m.num[0]).alias(m.key))


def ordered(spec: Spec, rows: DataFrame) -> DataFrame:
    """Pins first (missing ones as rows without data), then the sort with nulls last either way, ties by id."""
    if spec.pins:
        pins = rows.sparkSession.createDataFrame([(p,) for p in spec.pins], "player_id string")
        lost = pins.join(rows.select("player_id"), "player_id", "left_anti")
        rows = rows.unionByName(lost, allowMissingColumns=True).withColumn("pinned", F.col("player_id").isin(*spec.pins))
    key = F.col(f"{spec.sort}__sort" if f"{spec.sort}__sort" in rows.columns else spec.sort)
    order = key.desc_nulls_last() if spec.descending else key.asc_nulls_last()
    out = rows.orderBy(*([F.desc("pinned")] if spec.pins else []), order, "player_id", "player_name")
    return out.limit(spec.limit) if spec.limit else out


def leaderboard(spec: Spec, marts: dict[str, DataFrame]) -> DataFrame:
    return ordered(spec, grouped(spec, marts))


def name_order(column: str = "player_name") -> Column:
    """Case and accents don't count; blank names come last."""
    plain = F.regexp_replace(F.lower(F.col(column)), "[\\s]+", " ")
    return F.when(F.trim(column) != "", F.collate(plain, "UNICODE_CI_AI")).asc_nulls_last()


def page(rows: DataFrame, number: int, size: int = 50) -> DataFrame:
    return rows.offset(number * size).limit(size)


def kept_order(new: DataFrame, previous: DataFrame, sort: Iterable[Column]) -> DataFrame:
    """``new`` with the rows of ``previous`` (player_id, rank) first and in their order, and the others after by ``sort``."""
    return new.join(previous.select("player_id", F.col("rank").alias("_rank")), "player_id", "left").orderBy(F.col("_rank").asc_nulls_last(), *sort).drop("_rank")
