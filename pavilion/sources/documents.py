"""Scorecard documents (nested JSON, a file a match) flattened to the normalized store.

One explicit schema, tolerant of missing parts; every table is a projection or an explosion of the same scan. Positions
of innings, balls, wickets and fielders count from 0; an over's number is its own field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pavilion.functions import text
from pavilion.sources.tables import CODEC

DATES = 6


def _struct(spec: str) -> T.StructType:
    return T._parse_datatype_string(spec)


_WICKET = "struct<player_out:string,playeer_out:string,kind:string,fielders:array<struct<name:string,substitute:boolean>>>"
_BALL = f"""struct<batter:string,bowler:string,non_striker:string,runs:struct<batter:int,extras:int,total:int,non_boundary:boolean>,
 extras:struct<wides:int,noballs:int,byes:int,legbyes:int,penalty:int>,wickets:array<{_WICKET}>,review:struct<by:string,umpire:string,batter:string,decision:string,type:string,umpires_call:boolean>,replacements:string>"""
SCHEMA_TEXT = f"""meta string, info struct<match_type:string,gender:string,season:string,city:string,venue:string,dates:array<string>,balls_per_over:int,overs:int,team_type:string,teams:array<string>,
 toss:struct<winner:string,decision:string,uncontested:boolean>,event:struct<name:string,match_number:int,`group`:string,stage:string,sub_name:string>,
 outcome:struct<winner:string,result:string,method:string,eliminator:string,by:struct<runs:int,wickets:int,innings:int>,bowl_out:string>,players:map<string,array<string>>,player_of_match:array<string>,
 officials:map<string,array<string>>,registry:struct<people:map<string,string>>,supersubs:string,missing:string>,
 innings array<struct<team:string,declared:boolean,forfeited:boolean,super_over:boolean,target:struct<runs:int,overs:float>,penalty_runs:struct<pre:int,post:int>,miscounted_overs:string,absent_hurt:string,
 powerplays:array<struct<`from`:float,`to`:float,type:string>>,overs:array<struct<`over`:int,deliveries:array<{_BALL}>>>>>, _corrupt string"""


def schema() -> T.StructType:
    return _struct(SCHEMA_TEXT)


def read(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row a file: match_id (the file's stem), file_name and the document; unreadable files keep their text in _corrupt."""
    raw = spark.read.schema(schema()).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return named(raw)


#: Members of an archive that are passed on at a time.
MEMBERS = 64


def archived(spark: SparkSession, path: str | list[str], done: DataFrame | None = None) -> DataFrame:
    """The same of the .json members of ZIP archives, an archive a task; members whose file_name is in ``done`` are left out.

    A member that isn't JSON keeps its text in _corrupt. An archive that can't be opened fails the job.
    """

    def members(batches):
        import io
        import zipfile

        import pyarrow as pa

        for batch in batches:
            for content in batch.column("content"):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as archive:
                    names = [n for n in archive.namelist() if n.endswith(".json")]
                    for k in range(0, len(names), MEMBERS):
                        part = names[k : k + MEMBERS]
                        texts = [archive.read(n).decode("utf-8-sig", "replace") for n in part]
                        yield pa.record_batch([pa.array([n.rsplit("/", 1)[-1] for n in part]), pa.array(texts)], names=["file_name", "text"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(members, "file_name string, text string")
    if done is not None:
        rows = rows.join(done.select("file_name").distinct(), "file_name", "left_anti")
    return parsed(rows)


#: Documents of a bundle file at most: some 25 MB of text, or 2 MB as written.
BUNDLE = 1000
BUNDLE_SCHEMA = "file_name string, text string"


def write_bundles(docs: DataFrame, path: str) -> None:
    """Named documents (``file_name``, ``text``) as Parquet files of many, since a file each costs more than its text."""
    docs.select("file_name", "text").write.option("compression", CODEC).option("maxRecordsPerFile", BUNDLE).parquet(path)


def parsed(rows: DataFrame) -> DataFrame:
    """Rows of ``file_name`` and ``text`` as :func:`read` gives them; a text that isn't JSON is kept in _corrupt."""
    read_as = F.from_json("text", schema(), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return rows.select(F.regexp_replace("file_name", "\\.json$", "").alias("match_id"), "file_name", read_as.alias("d")).select("match_id", "file_name", "d.*")


def named(raw: DataFrame) -> DataFrame:
    name = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1)
    return raw.select(F.regexp_replace(F.url_decode(name), "\\.json$", "").alias("match_id"), F.url_decode(name).alias("file_name"), *raw.columns)


def _id(people: Column, name: Column) -> Column:
    return F.when(name.isNotNull(), F.try_element_at(people, name))


def _date(k: int) -> Column:
    return F.get("info.dates", F.lit(k)).try_cast("date")


def _innings(docs: DataFrame) -> DataFrame:
    return docs.select("match_id", F.col("info.registry.people").alias("people"), F.posexplode("innings").alias("innings_number", "i"))


def _balls(docs: DataFrame) -> DataFrame:
    overs = _innings(docs).select("match_id", "innings_number", "people", F.explode("i.overs").alias("o"))
    return overs.select("match_id", "innings_number", "people", F.col("o.over").alias("over_number"), F.posexplode("o.deliveries").alias("ball_index", "d"))


def _wickets(docs: DataFrame) -> DataFrame:
    return _balls(docs).select("match_id", "innings_number", "over_number", "ball_index", "people", F.posexplode("d.wickets").alias("wicket_index", "w"))


def _out(w: str) -> Column:
    """The player out, also where the field's name is misspelt."""
    return F.coalesce(f"{w}.player_out", f"{w}.playeer_out")


def tables(docs: DataFrame) -> dict[str, DataFrame]:
    """All normalized tables of the documents. A name that the registry doesn't have keeps a null id (in teams: the row is left out)."""
    docs = docs.where("_corrupt is null and info is not null")
    people, info = F.col("people"), "info"
    number, kind = text.margin(F.col("info.outcome.by"))
    matches = docs.select(
        "match_id", f"{info}.match_type", f"{info}.gender", f"{info}.season", text.season_start(F.col("info.season")).alias("season_year_start"), text.season_end(F.col("info.season")).alias("season_year_end"),
        f"{info}.city", f"{info}.venue", *[_date(k).alias(f"match_date_{k + 1}") for k in range(DATES)], F.coalesce("info.balls_per_over", F.lit(6)).alias("balls_per_over"), f"{info}.overs", f"{info}.team_type",
        F.get("info.teams", F.lit(0)).alias("team_1"), F.get("info.teams", F.lit(1)).alias("team_2"), F.col("info.toss.winner").alias("toss_winner"), F.col("info.toss.decision").alias("toss_decision"), F.coalesce("info.toss.uncontested", F.lit(False)).alias("toss_uncontested"),
        F.col("info.event.name").alias("event_name"), F.col("info.event.match_number").alias("event_match_number"), F.col("info.event.group").alias("event_group"), F.col("info.event.stage").alias("event_stage"), F.col("info.event.sub_name").alias("event_sub_name"),
        F.col("info.outcome.winner").alias("winner"), text.result_type(F.col("info.outcome.result"), F.col("info.outcome.eliminator")).alias("result_type"), number.alias("result_margin"), kind.alias("result_margin_type"), F.col("info.outcome.method").alias("method"),
        F.col("info.outcome.bowl_out").alias("bowl_out"), F.col("info.supersubs").alias("supersubs"), F.col("info.missing").alias("missing"), "meta",
    )
    i = "i."
    innings = _innings(docs).select(
        "match_id", "innings_number", F.col(i + "team").alias("batting_team"), *[F.coalesce(i + c, F.lit(False)).alias(c) for c in ("declared", "forfeited", "super_over")],
        F.col(i + "target.runs").alias("target_runs"), F.col(i + "target.overs").alias("target_overs"), F.col(i + "penalty_runs.pre").alias("penalty_runs_pre"), F.col(i + "penalty_runs.post").alias("penalty_runs_post"), i + "miscounted_overs", i + "absent_hurt",
    )
    d, n_wickets = "d.", F.coalesce(F.size("d.wickets"), F.lit(0))
    wicket_count = F.when(F.col("d.wickets").isNull(), 0).otherwise(n_wickets)
    first = F.get("d.wickets", F.lit(0))
    first_out = F.coalesce(first["player_out"], first["playeer_out"])
    names = [c for who in ("batter", "bowler", "non_striker") for c in (F.col(d + who).alias(who), _id(people, F.col(d + who)).alias(f"{who}_id"))]
    deliveries = _balls(docs).select(
        "match_id", "innings_number", "over_number", "ball_index", *names, *[F.col(f"d.runs.{c}").alias(f"runs_{c}") for c in ("batter", "extras", "total")], F.col("d.runs.non_boundary").alias("is_not_boundary"),
        *[F.col(f"d.extras.{c}").alias(c) for c in ("wides", "noballs", "byes", "legbyes", "penalty")], wicket_count.cast("tinyint").alias("wicket_count"), first["kind"].alias("wicket_kind"), first_out.alias("player_out"), _id(people, first_out).alias("player_out_id"),
        F.when(wicket_count > 2, "more than two wickets").alias("data_quality_flag"), *[F.col(f"d.review.{c}").alias(f"review_{c}") for c in ("by", "umpire", "batter", "decision", "type", "umpires_call")], F.col("d.replacements").alias("replacements"),
    )
    ball = ["match_id", "innings_number", "over_number", "ball_index"]
    wickets = _wickets(docs).select(*ball, "wicket_index", _out("w").alias("player_out"), _id(people, _out("w")).alias("player_out_id"), F.col("w.kind").alias("kind"))
    fielders = _wickets(docs).select(*ball, "wicket_index", "people", F.posexplode("w.fielders").alias("fielder_index", "f")).select(*ball, "wicket_index", "fielder_index", F.col("f.name").alias("fielder"), _id(people, F.col("f.name")).alias("fielder_id"), F.coalesce("f.substitute", F.lit(False)).alias("substitute"))
    named_players = docs.select("match_id", F.col("info.registry.people").alias("people"), F.explode("info.players").alias("team", "names")).select("match_id", "team", "people", F.explode("names").alias("player_name"))
    best = docs.select("match_id", F.col("info.registry.people").alias("people"), F.explode("info.player_of_match").alias("player_name")).select("match_id", "player_name", _id(people, F.col("player_name")).alias("player_id"))
    officials = docs.select("match_id", F.explode("info.officials").alias("role", "names")).select("match_id", "role", F.explode("names").alias("official_name"))
    return {
        "matches": matches,
        "innings": innings,
        "deliveries": deliveries,
        "wickets": wickets,
        "wicket_fielders": fielders,
        "powerplays": _innings(docs).select("match_id", "innings_number", F.posexplode("i.powerplays").alias("powerplay_index", "p")).select("match_id", "innings_number", "powerplay_index", "p.from", "p.to", "p.type"),
        "match_dates_overflow": docs.where(F.size("info.dates") > DATES).select("match_id", F.posexplode("info.dates").alias("day", "date")).where(F.col("day") >= DATES).select("match_id", (F.col("day") + 1).alias("day_number"), F.col("date").try_cast("date").alias("match_date")),
        "match_players": named_players.select("match_id", "team", "player_name", _id(people, F.col("player_name")).alias("player_id")).where("player_id is not null"),
        "match_player_of_match": best.where("player_id is not null").dropDuplicates(["match_id", "player_id"]),
        "officials": officials,
        "player_registry": docs.select("match_id", F.explode("info.registry.people").alias("player_name", "player_id")).groupBy("player_id").agg(F.min_by("player_name", F.struct("match_id", "player_name")).alias("player_name")),
        "ingested_files": docs.select("file_name", "match_id"),
    }


def team_misses(docs: DataFrame) -> DataFrame:
    """Players named in a team whom the registry doesn't have."""
    rows = docs.select("match_id", F.col("info.registry.people").alias("people"), F.explode("info.players").alias("team", "names")).select("match_id", "team", "people", F.explode("names").alias("player_name"))
    return rows.where(_id(F.col("people"), F.col("player_name")).isNull()).select("match_id", "team", "player_name")


def official_ids(officials: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """official_id (off_000001 and on) by first appearance, after those that are known."""
    from pyspark.sql import Window

    start = known.count() if known is not None else 0
    new = officials.groupBy("official_name").agg(F.min(F.struct("match_id", "role")).alias("first"))
    if known is not None:
        new = new.join(known.select("official_name"), "official_name", "left_anti")
    # Distinct officials only (thousands), so one global order is small whatever the number of matches.
    number = F.row_number().over(Window.orderBy("first", "official_name")) + start
    made = new.select(F.format_string("off_%06d", number).alias("official_id"), "official_name")
    return made if known is None else known.select("official_id", "official_name").unionByName(made)
