"""The marts themselves, whole, and parts of their builders as queries."""

from __future__ import annotations

from pavilion.queries import on_marts
from pavilion.queries.oracle_marts import sql

_WIDE = " REPLACE (CAST(innings_number AS BIGINT) AS innings_number)"
_BY_INNINGS = ("batting", "bowling", "matchup_batting", "matchup_bowling")

for _name in ("batting", "bowling", "matchup_batting", "matchup_bowling", "player_matches", "matches", "players", "profiles"):
    _query = {"batting": "innings_batting", "bowling": "innings_bowling", "matchup_batting": "matchup_fine", "matchup_bowling": "matchup_grain5", "player_matches": "player_matches_complete"}.get(_name, f"mart_{_name}")
    on_marts(_query, sql(f"SELECT *{_WIDE if _name in _BY_INNINGS else ''} FROM {_name}"))(lambda marts, name=_name: marts[name])
