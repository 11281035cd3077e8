"""One metric along one dimension for a roster of players: (player_id, player_name, bucket, bucket_ord, value, sample)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pavilion.functions.metrics import Metric, metric
from pavilion.functions.rules import PHASES, UNMAPPED
from pavilion.plans.spec import Spec, scoped

EPOCH = "1970-01-01"


@dataclass(frozen=True)
class Dimension:
    bucket: Callable[[Spec], Column]
    order: Callable[[Spec], Column]
    joins_matches: bool = False
    aggregated_order: bool = False


def _day(column: str = "match_date") -> Column:
    return F.datediff(F.col(column), F.lit(EPOCH).cast("date"))


def _result(spec: Spec) -> Column:
    """Of a match, as the player's own team saw it."""
    text = F.lower(F.coalesce("result_type", F.lit("")))
    out = F.when(F.col("winner") == F.col(spec.own_team), "Won").when(F.col("winner").isNotNull(), "Lost")
    return out.when(text.startswith("tie"), "Tie").when(text == "no result", "No result").when(text == "draw", "Draw")


def _result_order(spec: Spec) -> Column:
    return F.array_position(F.array(*map(F.lit, ("Won", "Lost", "Tie", "No result", "Draw"))), F.col("bucket"))


def _named(column: str) -> Callable[[Spec], Column]:
    return lambda _: F.when(F.col(column) != "", F.col(column))


DIMENSIONS = {
    "month": Dimension(lambda _: (F.col("year") * 100 + F.col("month")).cast("string"), lambda _: F.min(F.col("year") * 100 + F.col("month")), aggregated_order=True),
    "year": Dimension(lambda _: F.col("year").cast("string"), lambda _: F.min("year"), aggregated_order=True),
    "event": Dimension(_named("event_name"), lambda _: F.min(_day()), True, True),
    "venue": Dimension(_named("venue"), lambda _: F.min(_day()), True, True),
    "position": Dimension(lambda _: F.col("batting_position").cast("string"), lambda _: F.min("batting_position"), aggregated_order=True),
    "vs_bowling": Dimension(lambda _: F.when(F.col("bowling_group") != UNMAPPED, F.col("bowling_group")), lambda _: F.min(F.when(F.col("bowling_group") == "Pace", 0).otherwise(1)), aggregated_order=True),
    "opposition": Dimension(lambda s: F.col(s.other_team), lambda _: F.min(_day()), aggregated_order=True),
    "innings_of_match": Dimension(lambda _: F.col("innings_number").cast("string"), lambda _: F.min("innings_number"), aggregated_order=True),
    "result": Dimension(_result, _result_order, True),
}


def offered(spec: Spec) -> list[str]:
    """The dimensions that make sense: styles of bowling only for batters without a versus filter, and so on."""
    out = ["innings", "month", "year", "event", "phase", "position", "vs_bowling", "opposition", "venue", "innings_of_match", "result"]
    drop = set()
    if spec.discipline == "bowling":
        drop |= {"position", "vs_bowling"}
    if spec.vs_active:
        drop |= {"innings", "vs_bowling"}
    if spec.formats not in (("T20",), ("50 Over",)):
        drop.add("phase")
    return [d for d in out if d not in drop]


def allowed(m: Metric) -> bool:
    return m.kind in ("total", "rate", "percent") and m.source != "player_matches"


def _rows(spec: Spec, marts: dict[str, DataFrame], players: list[str] | None, mart: str | None = None) -> DataFrame:
    rows = scoped(spec, marts, mart)
    if spec.vs_active:
        from pavilion.plans.spec import VS_COLUMNS

        rows = rows.where(F.col(VS_COLUMNS[spec.vs.dim]) == spec.vs.value)
    if players is not None:
        rows = rows.where(F.col(spec.id_column).isin(*players) if players else F.lit(False))
    return rows.withColumns({"player_id": F.col(spec.id_column), "player_name": F.col(spec.name_column)})


def line(spec: Spec, marts: dict[str, DataFrame], dim: str, key: str, players: list[str] | None) -> DataFrame:
    """A metric of the players (all, if None) along a dimension."""
    if dim == "phase":
        return by_phase(spec, marts, key, players)
    mart = "matchup_batting" if dim == "vs_bowling" else spec.namespace
    m = metric(mart, key)
    if not allowed(m):
        raise ValueError(f"{key} has no line")
    rows = _rows(spec, marts, players, mart)
    if dim == "innings":
        rows = rows.withColumn("bucket", _sequence())
        return _values(rows, m, F.min("bucket")).withColumn("bucket", F.col("bucket").cast("string"))
    d = DIMENSIONS[dim]
    if d.joins_matches:
        rows = rows.join(marts["matches"].select("match_id", "event_name", "venue", "winner", "result_type"), "match_id")
    rows = rows.withColumn("bucket", d.bucket(spec)).where("bucket is not null")
    return _values(rows, m, d.order(spec) if d.aggregated_order else F.min(d.order(spec)))


def _sequence() -> Column:
    return F.row_number().over(Window.partitionBy("player_id").orderBy("match_date", "innings_number", "match_id"))


def _values(rows: DataFrame, m: Metric, order: Column) -> DataFrame:
    sample = metric(m.namespace, "innings").expr()
    return rows.groupBy("player_id", "bucket").agg(F.max("player_name").alias("player_name"), order.cast("long").alias("bucket_ord"), m.expr().cast("double").alias("value"), sample.alias("sample")).select("player_id", "player_name", "bucket", "bucket_ord", "value", "sample")


def by_phase(spec: Spec, marts: dict[str, DataFrame], key: str, players: list[str] | None) -> DataFrame:
    """A metric in each phase: computed side by side in one aggregate, then turned to rows."""
    family = "odi_" if spec.formats == ("50 Over",) else ""
    base = metric(spec.namespace, key)
    wide = _rows(spec, marts, players).groupBy("player_id").agg(F.max("player_name").alias("player_name"), metric(spec.namespace, "innings").expr().alias("sample"), *[base.for_phase(family + p).expr().cast("double").alias(p) for p in PHASES])
    order = F.array_position(F.array(*map(F.lit, PHASES)), F.col("bucket")) - 1
    return wide.unpivot(["player_id", "player_name", "sample"], list(PHASES), "bucket", "value").select("player_id", "player_name", "bucket", order.alias("bucket_ord"), "value", "sample")


def filled_months(values: DataFrame) -> DataFrame:
    """Every month between each player's first and last, with null where nothing happened."""
    # A player's months lie in one row meanwhile, so that the values are derived once and not joined with themselves.
    first = lambda c: F.to_date(c, "yyyyMM")
    there = F.map_from_entries(F.collect_list(F.struct("bucket", F.struct("value", "sample"))))
    span = values.groupBy("player_id").agg(F.max("player_name").alias("player_name"), first(F.min("bucket")).alias("a"), first(F.max("bucket")).alias("z"), there.alias("there"))
    months = span.select("player_id", "player_name", "there", F.explode(F.expr("sequence(a, z, interval 1 month)")).alias("m")).withColumn("bucket", F.date_format("m", "yyyyMM"))
    at = F.try_element_at("there", F.col("bucket"))
    return months.select("player_id", "player_name", "bucket", F.col("bucket").cast("long").alias("bucket_ord"), at["value"].alias("value"), at["sample"].alias("sample"))
