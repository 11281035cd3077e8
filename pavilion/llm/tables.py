"""Intermediate tables in the folder that the cluster shares, and joins that don't send one key's rows to one task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A hot key's rows are dealt to so many tasks.
SALTS = 64
#: Small rows of a file.
FILE_ROWS = 1 << 19


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Only where it is unset, as in tests on one machine, a local folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="pavilion-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/pavilion/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, most: int | None = None, **options) -> DataFrame:
    """The frame as a Parquet table in the shared folder: lineage ends here, and a lost executor loses nothing of it.

    Of a frame of ``most`` rows at most, all small ones, no more files are made than these rows need.
    """
    path = new_path(df.sparkSession, name)
    df = df if most is None else df.coalesce(1 + most // FILE_ROWS)
    df.write.option("compression", "zstd").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def trimmed(spark: SparkSession) -> None:
    """Has the executors' JVMs give back memory that holds garbage only.

    A JVM keeps what its heap has grown to, and Python workers live beside it in the executor's memory: between stages
    that are heavy on both, a collection (some tenths of a second) leaves the next one all but what is in use. A stage of
    many short steps has one before each of them.
    """
    tasks = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).selectExpr("java_method('java.lang.System', 'gc') AS done").write.format("noop").mode("overwrite").save()


def dropped(df: DataFrame) -> None:
    """Deletes a table of :func:`written` that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def unused(prefix: str, columns: list[str]) -> str:
    """The prefix, with as many more underscores as no column begins with; Spark doesn't tell capitals apart."""
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def salt(*of: str | Column) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(SALTS)).cast("int")


def looked_up(left: DataFrame, right: DataFrame, key: str, spread: str, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right`` on ``key``, which is unique in ``right``, however many rows of ``left`` share a key.

    The rows of a key are dealt by the hash of column ``spread``; ``right`` is sent once for each key and salt there is.
    """
    left = left.withColumn("_salt", salt(spread))
    keys = left.select(key, "_salt").distinct()
    return left.join(keys.join(right, key), [key, "_salt"], how).drop("_salt")


def least_by(df: DataFrame, key: list[str], value: str, spread: str) -> DataFrame:
    """The least ``value`` of each key by two partial sums, so that a hot key has SALTS rows at most at the end."""
    first = df.groupBy(*key, salt(spread).alias("_salt")).agg(F.min(value).alias(value), F.count("*").alias("n"))
    return first.groupBy(*key).agg(F.min(value).alias(value), F.sum("n").alias("n"))
