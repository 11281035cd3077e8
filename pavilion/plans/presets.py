"""Sets of columns by name: the defaults of a discipline, and sets that answer one question."""

from __future__ import annotations

from dataclasses import replace

from pavilion.plans.spec import Spec

#: Default columns, those of red-ball batting, and the sets of one click.
DEFAULTS = {
    "batting": ("matches", "innings", "runs", "average", "strike_rate", "high_score", "fours", "sixes"),
    "bowling": ("matches", "innings", "wickets", "average", "economy", "strike_rate", "best"),
    "matchup_batting": ("innings", "balls", "runs", "strike_rate", "average", "dismissals", "dot_pct", "boundary_pct", "comp_pace", "comp_spin", "comp_uncat"),
    "matchup_bowling": ("innings", "balls", "wickets", "runs_conceded", "economy", "average", "strike_rate", "dot_pct", "comp_rhb", "comp_lhb", "comp_uncat"),
}
RED_BALL_BATTING = ("matches", "innings", "runs", "average", "balls_per_dismissal", "high_score", "fours", "sixes")
SETS = {
    "batting": {
        "boundaries": ("innings", "runs", "fours", "sixes", "boundary_pct", "balls_per_boundary", "dot_pct"),
        "dismissals": ("innings", "runs", "average", "out_caught_pct", "out_bowled_pct", "out_lbw_pct", "out_run_out_pct", "out_stumped_pct", "out_caught_and_bowled_pct", "out_hit_wicket_pct"),
        "phases": ("innings", "runs", "strike_rate", "{}pp_strike_rate", "{}mid_strike_rate", "{}death_strike_rate"),
        "progression": ("innings", "runs", "strike_rate", "sr_first10", "sr_11_20", "sr_21plus"),
    },
    "bowling": {
        "control": ("innings", "wickets", "economy", "dot_pct", "boundary_pct_conceded", "maidens"),
        "wicket_types": ("innings", "wickets", "wkt_bowled", "wkt_lbw", "wkt_caught", "wkt_caught_and_bowled", "wkt_stumped", "wkt_hit_wicket"),
        "phases": ("innings", "wickets", "{}pp_economy", "{}death_economy", "{}pp_wickets", "{}death_wickets"),
    },
}
#: The columns' prefix of a format's phases; other scopes have no phases.
PHASE_PREFIX = {("T20",): "", ("50 Over",): "odi_"}


def default(spec: Spec) -> tuple[str, ...]:
    red = spec.formats and set(spec.formats) == {"Red Ball"} and spec.namespace == "batting"
    return RED_BALL_BATTING if red else DEFAULTS[spec.namespace]


def names(discipline: str) -> list[str]:
    return ["core", *SETS[discipline]]


def columns(spec: Spec, name: str) -> tuple[str, ...] | None:
    """A set's columns under the specification's formats; None where it can't be had."""
    if name == "core":
        return default(replace(spec, vs=None))
    if name == "phases" and spec.formats not in PHASE_PREFIX:
        return None
    return tuple(c.format(PHASE_PREFIX.get(spec.formats, "")) for c in SETS[spec.discipline][name])


def applied(spec: Spec, name: str) -> Spec:
    wanted = columns(spec, name)
    return spec if wanted is None else replace(spec, columns=wanted).pruned()


def active(spec: Spec) -> str | None:
    """The set whose columns are shown, in its order; None for a choice of one's own."""
    return next((n for n in names(spec.discipline) if columns(spec, n) == tuple(spec.columns)), None)
