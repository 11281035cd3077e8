"""Validation gates: invariants that marts must meet before they are published.

Gates on rows are predicates for bad rows; all those of a mart are counted in one aggregate, one scan a mart. Gates on totals
compare a mart's sums with sums over the deliveries, derived independently of the builders. The rest are joins.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pavilion.functions import rules as R
from pavilion.operators.marts import INNINGS, KEYS


#: Gates that run at a time.
AT_ONCE = 4


@dataclass(frozen=True)
class Result:
    gate: str
    ok: bool
    detail: str = ""


def _add(columns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in columns])


def _splits(name: str, family: str, total: str) -> Column:
    return _add([f"{family}{p}_{name}" for p in R.PHASES]) != F.col(total)


def row_gates() -> dict[str, dict[str, Column]]:
    """For each mart, predicates of bad rows by gate."""
    t20, odi = F.col("match_type").isin(*R.T20_TYPES), F.col("match_type").isin(*R.ODI_TYPES)
    either = lambda cs: reduce(lambda a, b: a | b, cs)
    out: dict[str, dict[str, Column]] = {name: {} for name in KEYS}
    measures = {
        "batting": {"runs": "runs", "balls": "balls_faced"},
        "bowling": {"balls": "balls", "runs_conceded": "runs_conceded", "wickets": "wickets"},
        "matchup_batting": {"runs": "runs", "balls": "balls_faced"},
        "matchup_bowling": {"balls": "balls", "runs_conceded": "runs_conceded", "wickets": "wickets"},
    }
    parts = {"batting": {"dots": "dots", "fours": "fours_hit", "sixes": "sixes_hit"}, "bowling": {"dots": "dots", "fours_conceded": "fours_conceded", "sixes_conceded": "sixes_conceded"}}
    parts |= {"matchup_batting": parts["batting"], "matchup_bowling": parts["bowling"]}
    for mart, pairs in measures.items():
        gates = out[mart]
        # In the long format overs may pass the last phase's end only by error; the short one has all balls in a phase.
        gates[f"{mart} T20 phase splits sum to totals"] = t20 & either([_splits(p, "", t) for p, t in pairs.items()])
        gates[f"{mart} ODI phase splits sum to totals"] = odi & either([_splits(p, "odi_", t) for p, t in pairs.items()])
        for family in ("", "odi_"):
            gates[f"{mart} {family}phase parts <= overall"] = either([_add([f"{family}{p}_{name}" for p in R.PHASES]) > F.col(total) for name, total in parts[mart].items()])
        gates[f"{mart} T20 phase parts == overall"] = t20 & either([_splits(name, "", total) for name, total in parts[mart].items()])
        odi_columns = [f"odi_{p}_{name}" for p in R.PHASES for name in (*pairs, *parts[mart])]
        gates[f"{mart} odi columns all null or none"] = F.size(F.array_compact(F.array(*map(F.col, odi_columns)))).between(1, len(odi_columns) - 1)
        gates[f"{mart} odi columns null only in the short format"] = F.col(odi_columns[0]).isNull() & ~F.col("match_type").isin("T20")
    out["batting"] |= {
        "batting position never null": F.col("batting_position").isNull(),
        "progression buckets sum to totals": (_add([f"fb{b}_runs" for b in ("1_10", "11_20", "21p")]) != F.col("runs")) | (_add([f"fb{b}_balls" for b in ("1_10", "11_20", "21p")]) != F.col("balls_faced")),
        "batting T20 phase dismissals <= dismissed": t20 & (_add([f"{p}_dismissals" for p in R.PHASES]) > F.col("dismissed")),
        "batting ODI phase dismissals <= dismissed": odi & (_add([f"odi_{p}_dismissals" for p in R.PHASES]) > F.col("dismissed")),
    }
    out["bowling"]["wickets by kind sum to wickets"] = _add([f"wickets_{R.slug(k)}" for k in R.CREDITED_KINDS]) != F.col("wickets")
    out["matchup_batting"] |= {
        "matchup_batting kinds sum to dismissals": _add([f"dis_{R.slug(k)}" for k in R.CREDITED_KINDS]) != F.col("dismissals"),
        "matchup_batting position in 1..12": ~F.coalesce(F.col("batting_position").between(1, 12), F.lit(False)),
        "matchup_batting T20 phase dismissals == dismissals": t20 & _splits("dismissals", "", "dismissals"),
        "matchup_batting ODI phase dismissals == dismissals": odi & _splits("dismissals", "odi_", "dismissals"),
        "bowling_group in vocabulary": ~F.coalesce(F.col("bowling_group").isin(*R.BOWLING_GROUPS), F.lit(False)),
        "bowling_type in vocabulary": ~F.coalesce(F.col("bowling_type").isin(*R.BOWLING_TYPES), F.lit(False)),
    }
    out["matchup_bowling"] |= {
        "matchup_bowling kinds sum to wickets": _add([f"wkt_{R.slug(k)}" for k in R.CREDITED_KINDS]) != F.col("wickets"),
        # A striker without an id has no position.
        "matchup_bowling position in 1..12": (F.col("batting_position").isNull() & (F.col("batting_hand") != R.UNMAPPED)) | ~F.coalesce(F.col("batting_position").between(1, 12), F.lit(True)),
        "batting_hand in vocabulary": ~F.coalesce(F.col("batting_hand").isin(*R.BATTING_HANDS), F.lit(False)),
    }
    return out


def check_rows(marts: dict[str, DataFrame]) -> list[Result]:
    out = []
    for name, gates in row_gates().items():
        if name not in marts:
            continue
        names = [*gates]
        row = marts[name].agg(F.count("*").alias("n"), *[F.count_if(gates[g]).alias(f"g{k}") for k, g in enumerate(names)]).first()
        out.append(Result(f"{name} has rows", row.n > 0, f"{row.n} rows"))
        out += [Result(g, not row[f"g{k}"], f"{row[f'g{k}']} bad rows") for k, g in enumerate(names)]
    return out


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def check_keys(marts: dict[str, DataFrame]) -> list[Result]:
    return [Result(f"{name} key is unique", duplicates(marts[name], key).isEmpty()) for name, key in KEYS.items() if name in marts]


def _total(df: DataFrame, **sums: Column) -> dict[str, int]:
    row = df.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(k) for k, c in sums.items()]).first()
    return row.asDict()


def _flag(c: Column) -> Column:
    return F.when(c, 1).otherwise(0)


def check_totals(marts: dict[str, DataFrame], facts: DataFrame, wickets: DataFrame) -> list[Result]:
    """Sums of marts against sums over deliveries of kept innings."""
    bat, bowl = facts.where("batter_id is not null"), facts.where("bowler_id is not null")
    zero = F.col("runs_batter") == 0
    batting = _total(bat, runs=F.col("runs_batter"), balls_faced=_flag(R.faced()), dots=_flag(R.faced() & zero), fours_hit=_flag(R.boundary(4)), sixes_hit=_flag(R.boundary(6)))
    bowling = _total(bowl, runs_conceded=R.bowler_runs(), balls=_flag(R.legal()), dots=_flag(R.legal() & zero), fours_conceded=_flag(R.boundary(4)), sixes_conceded=_flag(R.boundary(6)), wides_runs=F.coalesce("wides", F.lit(0)), noball_runs=F.coalesce("noballs", F.lit(0)))
    balls = [*INNINGS, "over_number", "ball_index"]
    taken = wickets.where(R.credited()).join(facts.select(*balls, "bowler_id", "batter_id"), balls)
    credit = _total(taken, wickets=_flag(F.col("bowler_id").isNotNull()), dismissals=_flag(F.col("batter_id").isNotNull()))
    wanted = {"batting": batting, "bowling": bowling | {"wickets": credit["wickets"]}}
    wanted["matchup_batting"] = batting | {"dismissals": credit["dismissals"]}
    wanted["matchup_bowling"] = {k: v for k, v in wanted["bowling"].items() if not k.endswith(("wides_runs", "noball_runs"))}
    out = []
    for mart, sums in wanted.items():
        got = _total(marts[mart], **{k: F.col(k) for k in sums})
        out += [Result(f"{mart}.{k} == deliveries", got[k] == v, f"{got[k]} and {v}") for k, v in sums.items()]
    return out


def rollup_mismatches(fine: DataFrame, base: DataFrame, key: list[str], measures: list[str]) -> DataFrame:
    """Keys where the fine mart, summed to the base mart's grain, differs from it or isn't there."""
    rolled = fine.groupBy(*key).agg(*[F.sum(m).alias(f"f_{m}") for m in measures])
    joined = rolled.join(base.select(*key, *measures), key, "left")
    return joined.where(reduce(lambda a, b: a | b, [~F.col(f"f_{m}").eqNullSafe(F.col(m)) for m in measures]))


def check_rollups(marts: dict[str, DataFrame]) -> list[Result]:
    bat, bowl = [*INNINGS, "batter_id"], [*INNINGS, "bowler_id"]
    found = {
        "matchup_batting rolls up to batting": rollup_mismatches(marts["matchup_batting"], marts["batting"], bat, ["runs", "balls_faced", "dots", "fours_hit", "sixes_hit"]),
        "matchup_bowling rolls up to bowling": rollup_mismatches(marts["matchup_bowling"], marts["bowling"], bowl, ["balls", "runs_conceded", "wickets", "dots", "fours_conceded", "sixes_conceded"]),
        "matchup_batting positions equal batting's": marts["matchup_batting"].select(*bat, F.col("batting_position").alias("p")).join(marts["batting"].select(*bat, "batting_position"), bat).where("p <> batting_position"),
        "player_matches covers batting": marts["batting"].select("match_id", F.col("batter_id").alias("player_id")).join(marts["player_matches"], ["match_id", "player_id"], "left_anti"),
        "player_matches covers bowling": marts["bowling"].select("match_id", F.col("bowler_id").alias("player_id")).join(marts["player_matches"], ["match_id", "player_id"], "left_anti"),
    }
    return [Result(name, df.isEmpty()) for name, df in found.items()]


def check_coverage(marts: dict[str, DataFrame], men: float = 0.7, women: float = 0.01) -> list[Result]:
    """Shares of balls against bowlers of a known style; for stores whose profiles are of men only."""
    share = F.sum(_flag(F.col("bowling_type") != R.UNMAPPED) * F.col("balls_faced")) / F.nullif(F.sum("balls_faced"), F.lit(0))
    by = {r.gender: r.s or 0.0 for r in marts["matchup_batting"].groupBy("gender").agg(share.alias("s")).collect()}
    return [Result("men's mapped share", by.get("male", 0.0) > men), Result("women's mapped share", by.get("female", 0.0) < women)]


def except_both(one: DataFrame, two: DataFrame) -> DataFrame:
    """Rows of either side that the other doesn't have, as sets."""
    two = two.select(one.columns)
    return one.subtract(two).withColumn("side", F.lit("left")).unionByName(two.subtract(one).withColumn("side", F.lit("right")))


def failures(marts: dict[str, DataFrame], store: dict[str, DataFrame] | None = None, facts: DataFrame | None = None, floors: dict[str, int] | None = None) -> list[str]:
    """Gates that marts don't meet: of their rows, keys and roll-ups, and, with the store they came from, of its sizes and sums.

    The gates are independent jobs of a scan or a join each, so some run at a time.
    """
    checks = [lambda name=name: check_rows({name: marts[name]}) + check_keys({name: marts[name]}) for name in marts] + [lambda: check_rollups(marts)]
    if store is not None:
        checks += [lambda: check_totals(marts, facts, store["wickets"]), lambda: sanity(store, floors or {name: 1 for name in store})]
    with ThreadPoolExecutor(AT_ONCE) as pool:
        results = [r for found in pool.map(lambda check: check(), checks) for r in found]
    return [f"{r.gate} ({r.detail})" for r in results if not r.ok]


def spot_check(marts: dict[str, DataFrame], discipline: str, player: str, where: Column, expect: dict[str, int]) -> Result:
    """Sums of one player's rows against known numbers."""
    got = _total(marts[discipline].where((F.col("batter_name" if discipline == "batting" else "bowler_name") == player) & where), **{k: F.col(k) for k in expect})
    return Result(f"{player} {discipline}", got == expect, f"{got}")


def sanity(spark_tables: dict[str, DataFrame], floors: dict[str, int]) -> list[Result]:
    """Tables that must be there with so many rows before anything is written."""
    out = []
    for name, floor in floors.items():
        n = spark_tables[name].limit(floor).count() if name in spark_tables else 0
        out.append(Result(f"{name} >= {floor} rows", n >= floor, f"{n}"))
    return out
