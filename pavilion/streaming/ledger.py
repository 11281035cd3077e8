"""Incremental ingestion: every document once, by file name.

Two ways to the same end. *Batch*: list files, take those the ledger doesn't name, flatten, append, and write the ledger
last, so a run that dies leaves files to be taken again; rows of a batch are replaced, not doubled, as each batch writes to
a folder of its own, and readers see the batches that the ledger names. The names of a folder pass through the driver, as
they do in any file source; a folder that only grows is better taken as a stream. *Stream*: a file source with ``availableNow`` and a checkpoint; each micro-batch is written under its
number with overwrite, which makes its retry harmless. Documents may come as files of their own, in ZIP archives or in
bundles, Parquet files of many named documents; the ledger names documents in any case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pavilion.sources import documents
from pavilion.sources.tables import CODEC, file_names

#: Bytes of bundles in a micro-batch, some 15 times that as text: what is parsed once and read for every table stays in memory.
BATCH_BYTES = 24 << 20


def _written(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{table}")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    found = spark.read.parquet(f"{root}/{table}")
    return found.withColumn("batch", F.col("batch").cast("string"))


def ledger(spark: SparkSession, root: str) -> DataFrame | None:
    return _written(spark, root, "ingested_files")


def pending(spark: SparkSession, folder: str, root: str) -> list[str]:
    """Files that no run has finished. A file that changed under its old name isn't taken again."""
    names = file_names(spark, folder)
    done = ledger(spark, root)
    if done is None or not names:
        return names
    listed = spark.createDataFrame([(n,) for n in names], "file_name string")
    return sorted(r.file_name for r in listed.join(done, "file_name", "left_anti").collect())


def write_batch(docs: DataFrame, root: str, batch: str) -> None:
    """All tables of a batch, the ledger last; unreadable documents go to ``quarantine`` and aren't in the ledger."""
    docs = docs.persist()
    try:
        for name, df in sorted(documents.tables(docs).items(), key=lambda t: t[0] == "ingested_files"):
            df.write.mode("overwrite").option("compression", CODEC).parquet(f"{root}/{name}/batch={batch}")
        bad = docs.where("_corrupt is not null or info is null").select("file_name", F.substring("_corrupt", 1, 2000).alias("text"))
        bad.write.mode("overwrite").parquet(f"{root}/quarantine/batch={batch}")
    finally:
        docs.unpersist()


def ingest(spark: SparkSession, folder: str, root: str, batch: str) -> int:
    """Takes all pending files; how many there were."""
    files = pending(spark, folder, root)
    if files:
        write_batch(documents.read(spark, [f"{folder.rstrip('/')}/{f}" for f in files]), root, batch)
    return len(files)


def ingest_archives(spark: SparkSession, path: str | list[str], root: str, batch: str) -> int:
    """Takes the documents of ZIP archives that the ledger doesn't name; how many there were."""
    write_batch(documents.archived(spark, path, ledger(spark, root)), root, batch)
    taken = ledger(spark, root)
    return taken.where(F.col("batch") == batch).count()


def ingest_stream(spark: SparkSession, folder: str, root: str) -> None:
    """The same as a stream that ends when all files there are have been taken."""
    raw = spark.readStream.schema(documents.schema()).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(folder)
    _stream(documents.named(raw), root)


def _stream(docs: DataFrame, root: str, prepared=lambda df, batch: df) -> None:
    def write(df: DataFrame, n: int) -> None:
        write_batch(prepared(df, f"stream-{n}"), root, f"stream-{n}")

    docs.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{root}/checkpoint").foreachBatch(write).start().awaitTermination()


def _first_seen(rows: DataFrame, done: DataFrame | None) -> DataFrame:
    """Each document once, without those in ``done``. Only names are compared; texts move if a name is indeed there twice."""
    names = rows.select("file_name")
    known = names.limit(0) if done is None else names.join(done.select("file_name"), "file_name", "left_semi")
    if names.groupBy("file_name").count().where("count > 1").select("file_name").unionByName(known).isEmpty():
        return rows
    return (rows if done is None else rows.join(done.select("file_name"), "file_name", "left_anti")).dropDuplicates(["file_name"])


def ingest_bundles(spark: SparkSession, folder: str, root: str, batch: str) -> int:
    """Takes the documents of bundles that the ledger doesn't name; how many there were."""
    rows, done = spark.read.schema(documents.BUNDLE_SCHEMA).parquet(folder), ledger(spark, root)
    names = rows.select("file_name").distinct()
    n = (names if done is None else names.join(done.select("file_name"), "file_name", "left_anti")).count()
    if n:
        write_batch(documents.parsed(_first_seen(rows, done)), root, batch)
    return n


def ingest_bundles_stream(spark: SparkSession, folder: str, root: str) -> None:
    """The same as a stream that ends when all bundles there are have been taken, in micro-batches of bounded size."""

    def prepared(rows: DataFrame, batch: str) -> DataFrame:
        done = ledger(rows.sparkSession, root)
        # A batch that is taken again may find itself in the ledger.
        return documents.parsed(_first_seen(rows, None if done is None else done.where(F.col("batch") != batch)))

    _stream(spark.readStream.schema(documents.BUNDLE_SCHEMA).option("maxBytesPerTrigger", BATCH_BYTES).parquet(folder), root, prepared)


def opened(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The store's tables so far, of finished batches only; of the registry, the first name of each id.

    A batch that died halfway has rows but no entry in the ledger: its folders are left out until it is taken again.
    """
    names = ("matches", "innings", "deliveries", "wickets", "wicket_fielders", "powerplays", "match_dates_overflow", "match_players", "match_player_of_match", "officials", "ingested_files", "player_registry")
    done = ledger(spark, root)
    if done is None:
        return {}
    finished = done.select("batch").distinct()
    out = {n: df.join(finished, "batch", "left_semi") for n in names if (df := _written(spark, root, n)) is not None}
    if "player_registry" in out:
        out["players"] = out["player_registry"].groupBy("player_id").agg(F.min_by("player_name", F.struct("batch", "player_name")).alias("player_name"))
    return {n: df.drop("batch") for n, df in out.items()}
