"""What charts need of players, how many they hold, in which order, and titles that claim no more than what is drawn."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pavilion.functions.metrics import Metric, metric
from pavilion.plans import compare, line
from pavilion.plans.spec import Spec

#: The fewest and the most players of each chart, and the fewest metrics where one won't do.
CAPS = {"bar": (2, 15), "radar": (1, 6), "scatter": (5, 60), "phases": (2, 8), "slope": (2, 12), "line": (1, 6), "dumbbell": (2, 12), "benchmark": (1, 15)}
LEAST_METRICS = {"radar": 3, "benchmark": 4}


def held(chart: str, wanted: int) -> int:
    """How many of the wanted players a chart draws; 0 below its minimum."""
    low, high = CAPS[chart]
    return min(wanted, high) if wanted >= low else 0


def best_first(rows: DataFrame, m: Metric, cap: int = CAPS["bar"][1]) -> DataFrame:
    """Players with data, the best first: ascending only where lower is better."""
    value = F.col(m.key)
    return rows.where(m.has_data(value)).orderBy(value.asc() if m.higher_is_better is False else value.desc(), "player_id").limit(cap)


def drawable(chart: str, spec: Spec, marts: dict[str, DataFrame], keys: list[str], windows: tuple[tuple[str, str], ...] = (), dim: str = "year", players: list[str] | None = None) -> DataFrame:
    """player_id of those whom a chart of the metrics ``keys`` can draw.

    Bar, scatter, phases and radar need data of every metric, a benchmark of any; slope and dumbbell need the first
    metric in both windows; a line needs two points of it, and all of them by phase. Too few metrics draw nobody.
    """
    if len(keys) < LEAST_METRICS.get(chart, 1):
        return compare.selected(spec, marts, [], keys).select("player_id")
    if chart in ("slope", "dumbbell"):
        return compare.two_windows(spec, marts, keys[0], *windows, players).select("player_id").distinct()
    if chart == "line":
        points = line.line(spec, marts, dim, keys[0], players)
        real = F.count_if(metric(spec.namespace, keys[0]).has_data(F.col("value")))
        needed = F.count("*") if dim == "phase" else F.lit(2)
        return points.groupBy("player_id").agg(real.alias("real"), needed.alias("needed")).where("real >= needed and real >= 2").select("player_id")
    flags: list[Column] = [metric(spec.namespace, k).has_data(F.col(k)) for k in keys]
    test = reduce((lambda a, b: a | b) if chart == "benchmark" else (lambda a, b: a & b), flags)
    return compare.selected(spec, marts, players, keys).where(test).select("player_id").distinct()


# ---- titles ---------------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Roster:
    """The players drawn, and where they come from: ``hand``, ``games`` (most capped), ``best`` or ``worst`` by a metric."""

    count: int
    source: str = "hand"
    by: Metric | None = None

    def phrase(self, shown: Metric | None = None) -> str:
        """A claim of rank only where the choice was one; the metric isn't named twice."""
        if self.source in ("best", "worst") and self.by:
            place = f"{'top' if self.source == 'best' else 'bottom'} {self.count}"
            return place if shown and shown.key == self.by.key else f"{place} by {_within(self.by.label)}"
        return f"{self.count} {'most-capped ' if self.source == 'games' else ''}player{'' if self.count == 1 else 's'}"


def _within(label: str) -> str:
    """A label inside a sentence: plain words in lower case, abbreviations as they are."""
    return re.sub(r"(?<!\S)[A-Z](?=[a-z])", lambda m: m[0].lower(), label)


def title(chart: str, roster: Roster, shown: tuple[Metric, ...] = (), windows: tuple[str, ...] = (), family: str = "", anchor: str = "") -> str:
    first = shown[0] if shown else None
    match chart:
        case "scatter":
            return " vs ".join(m.label for m in shown[:2])
        case "benchmark":
            return f"{anchor} vs the field" if anchor else "Choose an anchor player"
        case "radar" | "phases":
            return f"{family or 'Radar'} — {roster.phrase()}"
        case "slope" | "dumbbell":
            base = f"{first.label} — {' vs '.join(windows) if len(windows) == 2 else 'pick both windows'}"
        case "line":
            base = f"{first.label} — Line"
        case "bar" | "donut":
            base = first.label
        case _:
            return "Untitled chart"
    return f"{base} — {roster.phrase(first)}"


def bar_of_best(spec: Spec, marts: dict[str, DataFrame], key: str, cap: int = CAPS["bar"][1]) -> DataFrame:
    return best_first(compare.selected(replace(spec, groups=()), marts, None, [key]), metric(spec.namespace, key), cap)
