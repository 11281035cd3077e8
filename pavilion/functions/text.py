"""Names, teams, seasons and outcomes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and the plain ones they become, and letters that become two.
_MARKED = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
_PLAIN = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz"


def plain(value: Column) -> Column:
    """Lower case without marks on letters (composed or combining)."""
    return F.translate(F.regexp_replace(F.lower(value), "\\p{M}", ""), _MARKED, _PLAIN)


def norm_alnum(value: Column) -> Column:
    """Only letters a-z and digits, without marks; null if nothing is left."""
    return F.nullif(F.regexp_replace(plain(value), "[^a-z0-9]", ""), F.lit(""))


def team_contains(names: Column, teams: Column) -> Column:
    """Whether any name of a pipe-separated list holds, or is held by, any team's name; both normalised."""
    own = F.filter(F.transform(F.split(names, "\\|"), norm_alnum), lambda x: x.isNotNull())
    theirs = F.filter(F.transform(teams, norm_alnum), lambda x: x.isNotNull())
    return F.coalesce(F.exists(own, lambda s: F.exists(theirs, lambda d: F.contains(s, d) | F.contains(d, s))), F.lit(False))


def country_in(teams: Column, country: Column) -> Column:
    """Whether a lower-case country is among the teams; null if either is missing."""
    known = F.transform(F.filter(teams, lambda t: t.isNotNull() & (t != "")), lambda t: F.lower(F.trim(t)))
    return F.when((F.size(teams) > 0) & (F.coalesce(country, F.lit("")) != ""), F.array_contains(known, country))


def season_start(season: Column) -> Column:
    return F.when(F.trim(season).rlike("^\\d{4}(/\\d{2})?$"), F.substring(F.trim(season), 1, 4).cast("int"))


def season_end(season: Column) -> Column:
    """The second year keeps the first one's century, also across its turn."""
    s = F.trim(season)
    start = season_start(season)
    second = F.try_to_number(F.substring(s, 6, 2), F.lit("99")).cast("int")
    return F.when(s.rlike("^\\d{4}$"), start).when(s.rlike("^\\d{4}/\\d{2}$"), F.floor(start / 100).cast("int") * 100 + second)


def result_type(result: Column, eliminator: Column) -> Column:
    """The result, with the eliminator in brackets; the eliminator alone if there is no result."""
    return F.when(eliminator.isNotNull() & result.isNotNull(), F.concat(result, F.lit(" ("), eliminator, F.lit(")"))).otherwise(F.coalesce(eliminator, result))


def margin(by: Column) -> tuple[Column, Column]:
    """The first of runs, wickets and innings that an outcome is by: number and kind."""
    kinds = ("runs", "wickets", "innings")
    number = F.coalesce(*[by[k] for k in kinds]).cast("int")
    kind = F.coalesce(*[F.when(by[k].isNotNull(), F.lit(k)) for k in kinds])
    return number, kind
