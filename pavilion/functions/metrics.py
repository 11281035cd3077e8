"""The metric catalogue: typed aggregates over mart rows.

A metric is built from sums over mart columns, so a "versus" restriction is a condition inside each aggregate
(:meth:`Metric.expr` with ``where``), a phase is a column prefix (:meth:`Metric.for_phase`), and a peak is an inner aggregate per
innings with an outer one. Nothing is text that has to be rewritten.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from pavilion.functions.rules import CREDITED_KINDS, PHASES, ratio, slug

NAMESPACES = ("batting", "bowling", "matchup_batting", "matchup_bowling")
#: Kinds of dismissal that have metrics of their own.
DISMISSAL_KINDS = ("caught", "bowled", "lbw", "run out", "stumped", "caught and bowled", "hit wicket", "retired out", "obstructing the field", "handled the ball", "timed out", "hit the ball twice")
GATES = {"t20": "T20", "odi": "50 Over"}
_FAMILIES = (("", "t20", ""), ("odi_", "odi", "ODI "))
_PHASE_NAMES = {"pp": "Powerplay", "mid": "Middle Overs", "death": "Death Overs"}


def _if(where: Column | None, value: Column) -> Column:
    return value if where is None else F.when(where, value)


@dataclass(frozen=True)
class Metric:
    """``num``/``den``: names of summed columns; ``form`` says how they make a value."""

    key: str
    label: str
    kind: str  # total, rate, percent, peak, position, composition
    fmt: str
    form: str
    num: tuple[str, ...] = ()
    den: tuple[str, ...] = ()
    scale: float = 1.0
    higher_is_better: bool | None = None
    additive: bool = False
    gate: str | None = None
    namespace: str = ""
    member: str | None = None
    derived: bool = False

    @property
    def zero_is_data(self) -> bool:
        """Rates of zero are no data; totals of zero are."""
        return self.kind not in ("rate", "percent")

    @property
    def source(self) -> str:
        return "player_matches" if self.key == "matches" and not self.namespace.startswith("matchup") else self.namespace

    @property
    def is_text(self) -> bool:
        return self.form == "best"

    def _sum(self, names: tuple[str, ...], where: Column | None) -> Column:
        value = F.col(names[0])
        for name in names[1:]:
            value = value + F.col(name)
        return F.sum(_if(where, value))

    def _innings(self, where: Column | None) -> Column:
        if self.namespace.startswith("matchup"):
            return F.count_distinct(_if(where, F.struct("match_id", "innings_number")))
        return F.count(_if(where, F.lit(1)))

    def expr(self, where: Column | None = None) -> Column:
        """The aggregate over rows of a mart, restricted to rows that meet ``where``."""
        match self.form:
            case "sum":
                return self._sum(self.num, where).cast("long")
            case "max":
                return F.max(_if(where, F.col(self.num[0])))
            case "ratio":
                return ratio(self._sum(self.num, where), self.scale, self._sum(self.den, where))
            case "per_innings":
                return ratio(self._sum(self.num, where), self.scale, self._innings(where))
            case "matches":
                return F.count_distinct(_if(where, F.col("match_id")))
            case "innings":
                return self._innings(where)
            case "not_out":
                return ratio(F.sum(_if(where, F.when(F.col("dismissed") == 0, 1).otherwise(0))), 100, self._innings(where))
            case "kind":
                return self._kind(where).cast("long")
            case "kind_share":
                return ratio(self._kind(where), 100, self._sum(("dismissed",), where))
            case "best":
                return F.max_by(_if(where, figures("wickets", "runs_conceded")), _if(where, best_rank("wickets", "runs_conceded")))
        raise ValueError(f"{self.namespace}.{self.key} is not an aggregate of its own")

    def _kind(self, where: Column | None) -> Column:
        return F.sum(_if(where, F.when(F.col("dismissal_kind") == self.member, 1).otherwise(0)))

    def sort_expr(self, where: Column | None = None) -> Column:
        """A number to sort by: figures of wickets and runs sort by their rank."""
        return F.max(_if(where, best_rank("wickets", "runs_conceded"))) if self.form == "best" else self.expr(where)

    def for_phase(self, prefix: str) -> Metric:
        """The same metric over the columns of one phase (``pp``, ``odi_mid`` and so on)."""
        names = {"balls_faced": "balls", "fours_hit": "fours", "sixes_hit": "sixes", "dismissed": "dismissals"}
        own = lambda columns: tuple(f"{prefix}_{names.get(c, c)}" for c in columns)
        return replace(self, key=f"{prefix}_{self.key}", num=own(self.num), den=own(self.den), derived=True)

    def has_data(self, value: Column) -> Column:
        return value.isNotNull() if self.zero_is_data else value.isNotNull() & (value != 0)


def best_rank(wickets: str, runs: str) -> Column:
    return F.col(wickets) * 1000 - F.col(runs)


def figures(wickets: str, runs: str) -> Column:
    return F.concat_ws("-", F.col(wickets).cast("int").cast("string"), F.col(runs).cast("int").cast("string"))


def _total(key: str, label: str, column: str, better: bool | None = None, gate: str | None = None) -> Metric:
    return Metric(key, label, "total", "int", "sum", (column,), additive=True, higher_is_better=better, gate=gate)


def _rate(key: str, label: str, num: str, den: str, scale: float, better: bool | None, fmt: str = "dec2", gate: str | None = None) -> Metric:
    kind = "percent" if fmt == "pct1" else "rate"
    return Metric(key, label, kind, fmt, "ratio", tuple(num.split("+")), tuple(den.split("+")), scale, better, gate=gate)


def _phases(make: Callable[[str, str, str, str], Metric]) -> list[Metric]:
    return [make(f"{family}{p}", f"{label}{_PHASE_NAMES[p]}", gate, p) for family, gate, label in _FAMILIES for p in PHASES]


def _batting() -> list[Metric]:
    out = [
        Metric("matches", "Matches", "total", "int", "matches", additive=True),
        Metric("innings", "Innings", "total", "int", "innings", additive=True),
        _total("runs", "Runs", "runs", True),
        _total("balls_faced", "Balls Faced", "balls_faced"),
        Metric("high_score", "High Score", "peak", "int", "max", ("runs",), higher_is_better=True),
        _rate("average", "Batting Average", "runs", "dismissed", 1, True),
        _rate("strike_rate", "Strike Rate", "runs", "balls_faced", 100, True),
        _rate("balls_per_dismissal", "Balls per Dismissal", "balls_faced", "dismissed", 1, True, "dec1"),
        _rate("dot_pct", "Dot Ball %", "dots", "balls_faced", 100, False, "pct1"),
        _rate("boundary_pct", "Boundary %", "fours_hit+sixes_hit", "balls_faced", 100, True, "pct1"),
        _rate("balls_per_boundary", "Balls per Boundary", "balls_faced", "fours_hit+sixes_hit", 1, False, "dec1"),
        _total("fours", "Fours", "fours_hit", True),
        _total("sixes", "Sixes", "sixes_hit", True),
        Metric("not_out_pct", "Not Out %", "percent", "pct1", "not_out"),
        _rate("sr_first10", "Strike Rate (first 10 balls)", "fb1_10_runs", "fb1_10_balls", 100, True),
        _rate("sr_11_20", "Strike Rate (balls 11–20)", "fb11_20_runs", "fb11_20_balls", 100, True),
        _rate("sr_21plus", "Strike Rate (21+ balls)", "fb21p_runs", "fb21p_balls", 100, True),
        *_phases(lambda p, label, gate, _: _rate(f"{p}_strike_rate", f"{label} Strike Rate", f"{p}_runs", f"{p}_balls", 100, True, gate=gate)),
        Metric("r_pos", "R. Pos.", "position", "int", "position"),
    ]
    for kind in DISMISSAL_KINDS:
        out.append(Metric(f"out_{slug(kind)}", f"Out {kind.title()}", "total", "int", "kind", additive=True, member=kind))
        out.append(Metric(f"out_{slug(kind)}_pct", f"Out {kind.title()} %", "percent", "pct1", "kind_share", member=kind))
    return out


def _bowling(prefix: str = "") -> list[Metric]:
    """``prefix``: of the columns of wickets by kind."""
    wickets = [_total(f"wkt_{slug(k)}", k.title(), f"{prefix}{slug(k)}", True) for k in CREDITED_KINDS]
    return [
        Metric("matches", "Matches", "total", "int", "matches", additive=True),
        Metric("innings", "Innings", "total", "int", "innings", additive=True),
        _total("wickets", "Wickets", "wickets", True),
        _total("balls", "Balls Bowled", "balls"),
        _total("runs_conceded", "Runs Conceded", "runs_conceded"),
        _rate("average", "Bowling Average", "runs_conceded", "wickets", 1, False),
        _rate("economy", "Economy Rate", "runs_conceded", "balls", 6, False),
        _rate("strike_rate", "Bowling Strike Rate", "balls", "wickets", 1, False),
        _rate("dot_pct", "Dot Ball %", "dots", "balls", 100, True, "pct1"),
        _rate("boundary_pct_conceded", "Boundary % Conceded", "fours_conceded+sixes_conceded", "balls", 100, False, "pct1"),
        Metric("wickets_per_innings", "Wickets per Innings", "rate", "dec2", "per_innings", ("wickets",), higher_is_better=True),
        Metric("best", "Best Bowling (Innings)", "peak", "str", "best", ("wickets", "runs_conceded"), higher_is_better=True),
        *wickets,
        *_phases(lambda p, label, gate, _: _rate(f"{p}_economy", f"{label} Economy", f"{p}_runs_conceded", f"{p}_balls", 6, False, gate=gate)),
        *_phases(lambda p, label, gate, _: _total(f"{p}_wickets", f"{label} Wickets", f"{p}_wickets", True, gate)),
    ]


def _compositions(members: dict[str, tuple[str, str]]) -> list[Metric]:
    return [Metric(key, label, "composition", "pct1", "composition", member=member) for key, (label, member) in members.items()]


def _matchup_batting() -> list[Metric]:
    same = {m.key: m for m in _batting()}
    keep = ("matches", "innings", "runs", "high_score", "strike_rate", "dot_pct", "boundary_pct", "fours", "sixes", "balls_per_boundary")
    return [
        *[same[k] for k in keep],
        _total("balls", "Balls Faced", "balls_faced"),
        _rate("average", "Batting Average", "runs", "dismissals", 1, True),
        _total("dismissals", "Dismissals", "dismissals", False),
        _rate("balls_per_dismissal", "Balls per Dismissal", "balls_faced", "dismissals", 1, True, "dec1"),
        *[_total(f"dis_{slug(k)}", f"Out {k.title()}", f"dis_{slug(k)}") for k in CREDITED_KINDS],
        *[m for m in same.values() if m.gate],
        *_compositions({"comp_pace": ("Pace BF %", "Pace"), "comp_spin": ("Spin BF %", "Spin"), "comp_uncat": ("Uncategorised BF %", "(unmapped)")}),
    ]


def _matchup_bowling() -> list[Metric]:
    return [
        *_bowling("wkt_"),
        _total("fours_conceded", "Fours Conceded", "fours_conceded", False),
        _total("sixes_conceded", "Sixes Conceded", "sixes_conceded", False),
        *_compositions({"comp_rhb": ("RHB %", "Right-hand bat"), "comp_lhb": ("LHB %", "Left-hand bat"), "comp_uncat": ("Uncategorised %", "(unmapped)")}),
    ]


def _catalogue() -> dict[str, dict[str, Metric]]:
    bowling = [*_bowling("wickets_"), _total("maidens", "Maidens", "maidens", True)]
    every = {"batting": _batting(), "bowling": bowling, "matchup_batting": _matchup_batting(), "matchup_bowling": _matchup_bowling()}
    return {ns: {m.key: replace(m, namespace=ns) for m in metrics} for ns, metrics in every.items()}


CATALOGUE = _catalogue()


def metric(namespace: str, key: str) -> Metric:
    return CATALOGUE[namespace][key]


def sortable(namespace: str) -> list[Metric]:
    return [m for m in CATALOGUE[namespace].values() if m.kind != "composition"]


def formatted(value: Column, fmt: str) -> Column:
    """The display form of a value; an em dash where there is none."""
    shown = {"int": lambda: F.format_number(value, 0), "dec1": lambda: F.format_number(value, 1), "dec2": lambda: F.format_number(value, 2), "pct1": lambda: F.concat(F.format_number(value, 1), F.lit("%")), "str": lambda: value.cast("string")}[fmt]()
    return F.coalesce(shown, F.lit("—"))
