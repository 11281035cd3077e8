"""Published tables: sinks, the manifest that makes a snapshot current, state, and scans of small inputs."""

from __future__ import annotations

import gc
import hashlib
import json
import re
import tempfile
import threading
import time
import uuid
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a file at most, and the codec: fixed values of the mart format.
FILE_ROWS, CODEC = 5_000_000, "zstd"
DISPLAY_ROWS = 200


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``); a local one only where all is on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="pavilion-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Lazily(Mapping):
    """A mapping whose values are made when they are first asked for."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        self._makers, self._made, self._lock = makers, {}, threading.RLock()

    def __getitem__(self, name: str) -> DataFrame:
        with self._lock:
            if name not in self._made:
                self._made[name] = self._makers[name]()
            return self._made[name]

    def __iter__(self):
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


# ---- file systems ---------------------------------------------------------------------------------------------------
def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    at, fs = _fs(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replaces the file in one step: readers see the old or the new text."""
    at, fs = _fs(spark, path)
    temporary, _ = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(temporary, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    jvm = spark._jvm
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(temporary, at, how)


# ---- sinks ----------------------------------------------------------------------------------------------------------
def write_clustered(df: DataFrame, path: str, cluster: list[str]) -> None:
    """Parquet sorted by the clustering columns within files, and each month's rows together: date filters skip files and row groups.

    A month that is too large for a task is split, and small ones share a task.
    """
    if {"year", "month"} <= set(df.columns):
        df = df.hint("rebalance", F.col("year"), F.col("month"))
    out = df.sortWithinPartitions(*cluster) if cluster else df
    out.write.mode("overwrite").option("compression", CODEC).option("maxRecordsPerFile", FILE_ROWS).parquet(path)


#: Bytes of input for each bucket of :func:`bucketed`.
BUCKET_BYTES = 8 << 20


def size_of(spark: SparkSession, path: str) -> int:
    at, fs = _fs(spark, path)
    return fs.getContentSummary(at).getLength()


#: Passes in which :func:`bucketed` fills its buckets at most, and buckets that a pass has at least.
PASSES, PASS_BUCKETS = 4, 4


def in_passes(df: DataFrame, key: str, buckets: int) -> list[DataFrame]:
    """The frame in parts that have whole buckets of ``key`` each: together every row once, those without a key too."""
    passes = max(1, min(PASSES, buckets // PASS_BUCKETS))
    bucket = F.pmod(F.hash(key), F.lit(buckets))
    return [df.where(bucket % passes == k) for k in range(passes)] if passes > 1 else [df]


def bucketed(df: DataFrame, path: str, key: str, order: list[str], buckets: int) -> DataFrame:
    """The frame as Parquet in buckets of ``key``, each a file sorted by ``order``: what is grouped or joined by the key and
    more doesn't cross the network again. Joins by more than the key need the setting, which holds from here on.

    Many buckets are filled in passes, each of which reads the input anew: what one shuffles is deleted before the next begins."""
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    for part in in_passes(df, key, buckets):
        part.repartition(buckets, key).sortWithinPartitions(*order).write.mode("append").option("compression", CODEC).option("path", path).bucketBy(buckets, key).saveAsTable(name)
        gc.collect()  # Spark deletes shuffle files when their owner is collected as garbage on the driver
        spark._jvm.System.gc()
    return spark.table(name)


def insert_new(df: DataFrame, existing: DataFrame | None, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key (by ``order``) that ``existing`` doesn't have: an upsert that does nothing on conflict."""
    first = df.groupBy(*key).agg(F.min(F.struct(*order, *[c for c in df.columns if c not in [*key, *order]])).alias("_f")).select(*key, "_f.*").select(df.columns)
    return first if existing is None else first.join(existing.select(*key), key, "left_anti")


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


#: Marts that are written or read at a time.
AT_ONCE = 4


class PublishError(RuntimeError):
    pass


def retried(action: Callable[[], object], attempts: int = 3, waits: tuple[float, ...] = (2, 4), sleep: Callable[[float], None] = time.sleep):
    for k in range(attempts):
        try:
            return action()
        except Exception:
            if k == attempts - 1:
                raise
            sleep(waits[min(k, len(waits) - 1)])


def publish(marts: Mapping[str, DataFrame], root: str, clusters: dict[str, list[str]], checks: Callable[[dict[str, DataFrame]], list[str]] | None = None, now: str | None = None) -> dict:
    """Writes every mart to a new snapshot folder, checks what was written, and only then points the manifest at it."""
    spark = next(iter(marts.values())).sparkSession
    snapshot = f"{root}/snapshot-{uuid.uuid4().hex}"
    with ThreadPoolExecutor(AT_ONCE) as pool:
        list(pool.map(lambda name: retried(lambda: write_clustered(marts[name], f"{snapshot}/{name}", clusters.get(name, []))), marts))
    opened = {name: spark.read.parquet(f"{snapshot}/{name}") for name in marts}
    if checks and (failed := checks(opened)):
        raise PublishError("; ".join(failed))
    def entry(name: str) -> dict:
        df = opened[name]
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
        return {"path": f"{snapshot}/{name}", "rows": row.n, "sha256_12": hashlib.sha256(f"{row.n}:{row.h}".encode()).hexdigest()[:12]}

    with ThreadPoolExecutor(AT_ONCE) as pool:
        files = dict(zip(opened, pool.map(entry, opened), strict=True))
    manifest = {"generated_at": now or time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "snapshot": snapshot, "files": files}
    if "matches" in opened and "match_date" in opened["matches"].columns:
        row = opened["matches"].agg(F.min("match_date").alias("a"), F.max("match_date").alias("z"), F.count("*").alias("n")).first()
        manifest["data"] = {"min": str(row.a), "max": str(row.z), "count": row.n}
    retried(lambda: write_text(spark, f"{root}/manifest.json", json.dumps(manifest, sort_keys=True)))
    return manifest


class ManifestError(RuntimeError):
    """kind: missing, unreadable or incomplete."""

    def __init__(self, kind: str, what: str):
        super().__init__(f"{kind}: {what}")
        self.kind = kind


@dataclass
class Catalog:
    """A snapshot's tables as DataFrames; queries keep reading it while newer ones are published."""

    manifest: dict
    tables: dict[str, DataFrame]

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Catalog:
        text = read_text(spark, f"{root}/manifest.json")
        if text is None:
            raise ManifestError("missing", root)
        try:
            manifest = json.loads(text)
            paths = {name: f["path"] for name, f in manifest["files"].items()}
        except (ValueError, KeyError, TypeError) as e:
            raise ManifestError("unreadable", str(e)) from e
        if not paths:
            raise ManifestError("incomplete", "no files")
        return cls(manifest, {name: spark.read.parquet(path) for name, path in paths.items()})

    def register(self, spark: SparkSession) -> None:
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)

    def sql(self, spark: SparkSession, text: str, display: bool = True) -> DataFrame:
        """Free SQL over the views; a console shows the first rows only."""
        self.register(spark)
        out = spark.sql(text)
        return out.limit(DISPLAY_ROWS) if display else out


def missing_tables(spark: SparkSession, names: Iterable[str]) -> list[str]:
    return [n for n in names if not spark.catalog.tableExists(n)]


# ---- small inputs ---------------------------------------------------------------------------------------------------
def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, trimmed names, no inference."""
    df = spark.read.option("header", True).option("inferSchema", False).option("encoding", "UTF-8").csv(path)
    return df.toDF(*[c.removeprefix("﻿").strip() for c in df.columns])


def cleaned(df: DataFrame, ids: Iterable[str] = ()) -> DataFrame:
    """Cells without quotes or surrounding space, empty ones null; ids without the decimals that spreadsheets add."""
    ids = set(ids)
    cell = lambda c: F.nullif(F.trim(F.regexp_replace(F.trim(F.col(c)), "^[\"'﻿]+|[\"']+$", "")), F.lit(""))
    return df.select(*[(F.regexp_replace(cell(c), r"^(\d+)\.0+$", "$1") if c in ids else cell(c)).alias(c) for c in df.columns])


def in_list(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose column is in an in-memory list, as a semi-join."""
    kind = df.schema[column].dataType
    own = df.sparkSession.createDataFrame([(v,) for v in values], T.StructType([T.StructField(column, kind)]))
    return df.join(own, column, "left_semi")


def log_report(spark: SparkSession, path: str) -> DataFrame:
    """What an ingestion log says: number of errors, and each failed file with its error."""
    lines = spark.read.text(path)
    failed = F.regexp_extract("value", r"FAILED:\s*(\S+)\s+[—-]\s*(.*)$", 1)
    return lines.select(
        F.when(F.col("value").rlike(r"Errors\s*:\s*\d+"), F.regexp_extract("value", r"Errors\s*:\s*(\d+)", 1).cast("long")).alias("errors"),
        F.nullif(failed, F.lit("")).alias("file"),
        F.nullif(F.regexp_extract("value", r"FAILED:\s*(\S+)\s+[—-]\s*(.*)$", 2), F.lit("")).alias("error"),
    ).where("errors is not null or file is not null")


class StateStore:
    """JSON blobs by name, for baselines that later runs are compared with."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def get(self, name: str, default=None):
        text = read_text(self.spark, f"{self.root}/{name}.json")
        return default if text is None else json.loads(text)

    def put(self, name: str, value) -> None:
        write_text(self.spark, f"{self.root}/{name}.json", json.dumps(value, sort_keys=True))


@dataclass
class SourceResolver:
    """A sheet from its primary place, else the last good copy, else the seed; with the age of its content.

    All places are paths of any file system that the session knows. A copy is good if its first line has the columns of
    ``header``. ``alert`` says that somebody should be told that the content hasn't changed for ``stale_days``: once, and
    again every ``alert_days`` while that lasts.
    """

    spark: SparkSession
    primary: str
    last_good: str
    seed: str
    header: tuple[str, ...] = ()
    stale_days: int = 21
    alert_days: int = 7
    sleep: Callable[[float], None] = time.sleep

    def _fetched(self) -> str:
        text = read_text(self.spark, self.primary)
        if text is None:
            raise ValueError(f"nothing at {self.primary}")
        first = text.removeprefix("\ufeff").split("\n", 1)[0]
        if lacking := [h for h in self.header if h not in [c.strip().strip('"') for c in first.split(",")]]:
            raise ValueError(f"columns missing: {', '.join(lacking)}")
        return text

    def resolve(self, today: float | None = None) -> dict:
        today = time.time() if today is None else today
        at = f"{self.last_good}.meta.json"
        meta = json.loads(read_text(self.spark, at) or "{}")
        out = {}
        try:
            text = retried(self._fetched, waits=(3, 6), sleep=self.sleep)
            sha = hashlib.sha256(text.encode()).hexdigest()
            if sha != meta.get("sha"):
                write_text(self.spark, self.last_good, text)
                meta = {"sha": sha, "changed_at": today}
            meta["fetched_at"] = today
            out = {"path": self.last_good, "from": "primary"}
        except Exception as e:  # whatever goes wrong there, an older copy serves
            where = next(((p, n) for p, n in ((self.last_good, "last_good"), (self.seed, "seed")) if read_text(self.spark, p) is not None), None)
            if where is None:
                raise
            out = {"path": where[0], "from": where[1], "error": str(e)}
        out["stale"] = today - meta.get("changed_at", today) > self.stale_days * 86400
        out["alert"] = out["stale"] and today - meta.get("alerted_at", -float("inf")) >= self.alert_days * 86400
        if out["alert"]:
            meta["alerted_at"] = today
        elif not out["stale"]:
            meta.pop("alerted_at", None)
        write_text(self.spark, at, json.dumps(meta, sort_keys=True))
        return meta | out


def file_names(spark: SparkSession, folder: str, pattern: str = r"\.(json|txt)$") -> list[str]:
    at, fs = _fs(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if re.search(pattern, s.getPath().getName()))
