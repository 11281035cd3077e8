"""A query's specification: what is asked, over which scope, under which conditions; and its compilation to Columns.

A specification is immutable; every transformation returns a new one. Compilation produces Columns and semi-joins, which
the optimizer orders, prunes and pushes down to the scans.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pavilion.functions.metrics import CATALOGUE, GATES, Metric

#: Match types of each format.
FORMATS = {"Red Ball": ("Test", "MDM"), "50 Over": ("ODI", "ODM"), "T20": ("T20", "IT20")}
VS_COLUMNS = {"hand": "batting_hand", "type": "bowling_type", "group": "bowling_group"}


@dataclass(frozen=True)
class Condition:
    """A condition on a metric: gte, lte, eq or between. ``wickets``/``runs`` for best figures."""

    key: str
    op: str = "gte"
    value: float | None = None
    upper: float | None = None
    wickets: int | None = None
    runs: int | None = None

    def complete(self) -> bool:
        if self.wickets is not None or self.runs is not None:
            return self.wickets is not None and self.runs is not None
        return self.value is not None and (self.op != "between" or self.upper is not None)


@dataclass(frozen=True)
class Vs:
    """A restriction to opponents: by hand, type or group."""

    dim: str
    value: str


@dataclass(frozen=True)
class Spec:
    discipline: str = "batting"
    gender: str | None = "male"
    formats: tuple[str, ...] = ("T20",)
    date_from: str | None = None
    date_to: str | None = None
    team_type: str | None = None
    teams: tuple[str, ...] = ()
    opposition: tuple[str, ...] = ()
    events: tuple[str, ...] = ()
    venues: tuple[str, ...] = ()
    positions: tuple[object, ...] = ()
    regular_positions: tuple[object, ...] = ()
    role_groups: tuple[str, ...] = ()
    hands: tuple[str, ...] = ()
    bowling_types: tuple[str, ...] = ()
    played_for: tuple[str, ...] = ()
    search: str = ""
    vs: Vs | None = None
    columns: tuple[str, ...] = ("matches", "innings", "runs")
    sort: str = "runs"
    descending: bool = True
    groups: tuple[tuple[Condition, ...], ...] = ()  # conditions of a group are joined by AND, groups by ``join``
    join: str = "or"
    pins: tuple[str, ...] = ()
    limit: int | None = None
    archived: dict = field(default_factory=dict, hash=False, compare=False)

    # ---- what applies -------------------------------------------------------------------------------------------
    @property
    def vs_active(self) -> bool:
        """Opponent restrictions are for men's cricket, by hand for bowlers and by style for batters."""
        return self.vs is not None and self.gender == "male" and (self.vs.dim == "hand") == (self.discipline == "bowling")

    @property
    def namespace(self) -> str:
        return f"matchup_{self.discipline}" if self.vs_active else self.discipline

    @property
    def id_column(self) -> str:
        return "batter_id" if self.discipline == "batting" else "bowler_id"

    @property
    def name_column(self) -> str:
        return "batter_name" if self.discipline == "batting" else "bowler_name"

    @property
    def own_team(self) -> str:
        return "batting_team" if self.discipline == "batting" else "bowling_team"

    @property
    def other_team(self) -> str:
        return "bowling_team" if self.discipline == "batting" else "batting_team"

    def eligible(self, metric: Metric) -> bool:
        """Metrics of a phase need exactly the format of that phase."""
        return metric.gate is None or self.formats == (GATES[metric.gate],)

    def pruned(self) -> Spec:
        """Without columns, sort and conditions that don't exist here; the sort falls back to the first column."""
        known = CATALOGUE[self.namespace]
        ok = lambda k: k in known and self.eligible(known[k])
        columns = tuple(k for k in dict.fromkeys(self.columns) if ok(k))
        groups = tuple(g for g in (tuple(c for c in g if ok(c.key)) for g in self.groups) if g)
        sort = self.sort if ok(self.sort) and known[self.sort].kind != "composition" else next((k for k in columns if known[k].kind != "composition"), "innings")
        return replace(self, columns=columns, groups=groups, sort=sort)

    def with_filtered_columns(self) -> Spec:
        """Metrics under a condition become columns, and the first of them the sort (ascending where lower is better)."""
        keys = [c.key for g in self.groups for c in g if c.complete() and c.key in CATALOGUE[self.namespace]]
        if not keys:
            return self
        best = CATALOGUE[self.namespace][keys[0]].higher_is_better
        return replace(self, columns=tuple(dict.fromkeys([*self.columns, *keys])), sort=keys[0], descending=best is not False)

    def switched(self, discipline: str) -> Spec:
        """The other discipline, with the conditions last used there; a batting-hand filter is left behind."""
        if discipline == self.discipline:
            return self
        archived = self.archived | {self.discipline: self.groups}
        return replace(self, discipline=discipline, groups=archived.get(discipline, ()), hands=(), vs=None, archived=archived)

    def describe(self) -> str:
        parts = [self.gender or "all", ", ".join(self.formats) or "no format", self.team_type or "all teams", f"{self.date_from or 'start'} to {self.date_to or 'now'}"]
        named = {"for": self.teams, "against": self.opposition, "in": self.events, "at": self.venues, "batting at": self.positions, "usually at": self.regular_positions, "role": self.role_groups}
        parts += [f"{word} {', '.join(map(str, values))}" for word, values in named.items() if values]
        return "; ".join([*parts, *([f"vs {self.vs.value}"] if self.vs_active else []), *([f"plus {len(self.pins)} pinned"] if self.pins else [])])

    # ---- scope --------------------------------------------------------------------------------------------------
    def core(self, with_gender: bool = True) -> Column:
        """Gender, format, dates and team type. No format means no rows."""
        types = [t for f in self.formats for t in FORMATS.get(f, ())]
        out = F.col("match_type").isin(types) if types else F.lit(False)
        if with_gender and self.gender:
            out &= F.col("gender") == self.gender
        if self.date_from:
            out &= F.col("match_date") >= F.lit(_first_day(self.date_from))
        if self.date_to:
            out &= F.col("match_date") < F.lit(_after(self.date_to))
        if self.team_type:
            out &= F.col("team_type") == self.team_type
        return out

    def extra(self) -> Column | None:
        """Filters beyond the core that are plain predicates on mart rows."""
        parts = []
        if self.teams:
            parts.append(F.col(self.own_team).isin(*self.teams))
        if self.opposition:
            parts.append(F.col(self.other_team).isin(*self.opposition))
        if self.positions and self.vs_active:
            parts.append(F.col("batting_position").isin(_integers(self.positions)))
        elif self.positions and self.discipline == "batting":
            parts.append(F.col("batting_position").isin(_integers(self.positions)))
        return reduce(lambda a, b: a & b, parts) if parts else None


def _integers(values: tuple[object, ...]) -> list[int]:
    out = []
    for v in values:
        try:
            if float(v) == int(float(v)):
                out.append(int(float(v)))
        except (TypeError, ValueError):
            continue
    return out


def _first_day(text: str) -> dt.date:
    return dt.date.fromisoformat(text if len(text) == 10 else f"{text}-01")


def _after(text: str) -> dt.date:
    """The first day that is out: the next day, or the first day of the next month."""
    if len(text) == 10:
        return dt.date.fromisoformat(text) + dt.timedelta(days=1)
    year, month = map(int, text.split("-"))
    return dt.date(year + month // 12, month % 12 + 1, 1)


def preset(name: str, first: dt.date, last: dt.date) -> tuple[dt.date, dt.date]:
    """Date windows that end at the newest data: '12m', '24m', 'year' or 'all', within the data's bounds."""
    if name == "all":
        return first, last
    if name == "year":
        return max(first, dt.date(last.year, 1, 1)), last
    months = last.year * 12 + last.month - 1 - int(name.removesuffix("m"))
    year, month = divmod(months, 12)
    for day in (last.day, 30, 29, 28):
        try:
            return max(first, dt.date(year, month + 1, day)), last
        except ValueError:
            continue
    return first, last


# ---- semi-joins -----------------------------------------------------------------------------------------------------
def eligible_players(spec: Spec, marts: dict[str, DataFrame]) -> DataFrame | None:
    """Players by profile: role, hand, style and teams. No effect where there are no profiles (women)."""
    if spec.gender == "female" or not (spec.role_groups or spec.hands or spec.bowling_types or spec.played_for):
        return None
    out = marts["profiles"]
    for values, column in ((spec.role_groups, "role_group"), (spec.hands, "batting_style"), (spec.bowling_types, "bowling_type")):
        if values:
            out = out.where(F.col(column).isin(*values))
    if spec.played_for:
        out = out.where(F.arrays_overlap(F.split("teams_played_for", "\\|"), F.array(*map(F.lit, spec.played_for))))
    return out.select(F.col("player_id").alias("_player"))


def regular_position(spec: Spec, marts: dict[str, DataFrame]) -> DataFrame:
    """Each batter's most frequent position in the core scope, the lower one on a tie."""
    counted = marts["batting"].where(spec.core()).groupBy("batter_id", "batting_position").count()
    order = Window.partitionBy("batter_id").orderBy(F.desc("count"), "batting_position")
    return counted.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(F.col("batter_id").alias("_player"), F.col("batting_position").cast("int").alias("r_pos"))


def scoped(spec: Spec, marts: dict[str, DataFrame], mart: str | None = None) -> DataFrame:
    """The mart rows that a query reads. Pinned players skip every filter but the core."""
    rows = marts[mart or spec.namespace].where(spec.core())
    extra, flags = spec.extra(), []
    matches = marts["matches"]
    if spec.events or spec.venues:
        wanted = matches.where(F.col("gender") == spec.gender) if spec.gender else matches
        if spec.events:
            wanted = wanted.where(F.col("event_name").isin(*spec.events))
        if spec.venues:
            wanted = wanted.where(F.col("venue").isin(*spec.venues))
        flags.append((wanted.select("match_id").distinct(), "match_id", "match_id"))
    if (players := eligible_players(spec, marts)) is not None:
        flags.append((players, "_player", spec.id_column))
    if spec.regular_positions and spec.discipline == "batting":
        usual = regular_position(spec, marts).where(F.col("r_pos").isin(_integers(spec.regular_positions))).select("_player")
        flags.append((usual, "_player", spec.id_column))
    if spec.search:
        has = F.contains(F.lower(F.col(spec.name_column)), F.lit(spec.search.lower()))
        extra = has if extra is None else extra & has
    if not spec.pins:
        rows = rows.where(extra) if extra is not None else rows
        for side, right, left in flags:
            rows = rows.join(side.withColumnRenamed(right, f"_k_{left}"), F.col(left) == F.col(f"_k_{left}"), "left_semi")
        return rows
    ok = F.lit(True) if extra is None else extra
    for k, (side, right, left) in enumerate(flags):
        rows = rows.join(side.select(F.col(right).alias(f"_k{k}")).distinct(), F.col(left) == F.col(f"_k{k}"), "left")
        ok &= F.col(f"_k{k}").isNotNull()
    return rows.where(F.coalesce(ok, F.lit(False)) | F.col(spec.id_column).isin(*spec.pins)).drop(*[f"_k{k}" for k in range(len(flags))])


# ---- conditions -----------------------------------------------------------------------------------------------------
def condition(c: Condition, metric: Metric, value: Column) -> Column:
    """A condition on a finished aggregate. Zero is no data for rates, so it never meets one."""
    if c.wickets is not None:
        return value >= c.wickets * 1000 - c.runs
    low, high = (c.value, c.upper) if c.op != "between" else sorted((c.value, c.upper))
    test = {"gte": lambda: value >= low, "lte": lambda: value <= low, "eq": lambda: value == low, "between": lambda: value.between(low, high)}[c.op]()
    return test if metric.zero_is_data else test & (value != 0)


def gate(spec: Spec, values: dict[str, Column]) -> Column | None:
    """All complete conditions that apply, as one predicate; with pins exempt."""
    known = CATALOGUE[spec.namespace]
    groups = []
    for g in spec.groups:
        parts = [condition(c, known[c.key], values[c.key]) for c in g if c.complete() and c.key in values and known[c.key].kind not in ("composition", "position") and (c.wickets is None) == (known[c.key].form != "best")]
        if parts:
            groups.append(reduce(lambda a, b: a & b, parts))
    if not groups:
        return None
    out = F.coalesce(reduce((lambda a, b: a | b) if spec.join == "or" else (lambda a, b: a & b), groups), F.lit(False))
    return out | F.col("player_id").isin(*spec.pins) if spec.pins else out
