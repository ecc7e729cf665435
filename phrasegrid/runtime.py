"""Session helpers: reading tables, and tables written once to the folder all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A single-JVM session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("phrasegrid")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(SCAN_TASKS, str(partitions))
        .getOrCreate()
    )


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a single-JVM session may fall back to a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _fallback()


@cache
def _fallback() -> str:
    """One temporary folder a process; the setting itself cannot be changed once a session runs."""
    base = tempfile.mkdtemp(prefix="phrasegrid-")
    atexit.register(shutil.rmtree, base, True)
    return f"file://{base}"


def hadoop_path(spark: SparkSession, path: str):
    """The JVM's ``Path`` and the file system it lies in."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


_roots: dict[tuple[str, str], str] = {}


def scratch_root(spark: SparkSession) -> str:
    """This application's own folder below the shared one, removed when the driver's JVM ends, whatever the file system."""
    key = spark.sparkContext.applicationId, shared_dir(spark)
    if key not in _roots:
        root = f"{key[1]}/phrasegrid/{uuid.uuid4().hex}"
        where, files = hadoop_path(spark, root)
        files.mkdirs(where)
        files.deleteOnExit(where)  # takes only what exists
        _roots[key] = root
    return _roots[key]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below ``scratch_root``."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove what the application has written so far; for a session that goes on after its results are stored."""
    where, files = hadoop_path(spark, scratch_root(spark))
    files.delete(where, True)
    files.mkdirs(where)


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def materialize(df: DataFrame, name: str, partition_by: str | None = None, path: str | None = None) -> DataFrame:
    """Write ``df`` once and read it back: later passes start from files that outlive any executor.

    With ``partition_by`` (few distinct values) each task keeps one writer per value instead of sorting.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        with _setting(spark, "spark.sql.maxConcurrentOutputFileWriters", "32"):
            writer.partitionBy(partition_by).parquet(path)
    else:
        writer.parquet(path)
    schema = T.StructType([f for f in df.schema.fields if f.name != partition_by])
    if partition_by:
        schema.add(df.schema[partition_by])
    return spark.read.schema(schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def broadcast_limit(spark: SparkSession) -> int:
    """Bytes up to which the session broadcasts a side of a join; negative: never."""
    return spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def row_bytes(df: DataFrame) -> Column:
    """Bytes that a row takes in memory: 8 a field and 24 a row, and what strings, arrays, maps and structs hold beside."""
    size = F.lit(24 + 8 * len(df.columns)).cast("bigint")
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0))
    return size


def measured(df: DataFrame) -> tuple[int, int]:
    """Rows of ``df`` (a stored table, or cheap to make twice) and the bytes that they take in memory."""
    r = df.select(row_bytes(df).alias("b")).agg(F.count("b").alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    return r["n"], r["b"]


def fitting(df: DataFrame, what: str, most: int = 64 << 20) -> DataFrame:
    """``df`` if its measured bytes may go to the driver and to every task (64 MB: a catalog of half a million phrases); raises otherwise."""
    rows, size = measured(df)
    if size > most:
        raise ValueError(f"{what}: {rows} rows of {size} bytes, but only {most} may be sent to every task")
    return df


def held(df: DataFrame, name: str, size: int) -> DataFrame:
    """A table of at most ``size`` bytes (a bound that was measured), computed once: by way of the driver if it may be
    broadcast, else ``materialize``d."""
    if size > broadcast_limit(df.sparkSession):
        return materialize(df, name)
    return df.sparkSession.createDataFrame(df.toArrow())


def join_small(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", size: int | None = None, salts: int = 32) -> DataFrame:
    """Null-safe equi-join (inner, left or left_semi) of rows with a table that is small as a rule, on like-named ``keys``.

    The bytes of ``small`` are measured, unless ``size`` tells a bound that was measured before. Up to the session's broadcast limit it is broadcast, and ``big`` does not move.
    Beyond it both sides are shuffled, with every row of ``small`` copied to ``salts`` places, so that a key that holds a
    third of ``big`` is spread over as many tasks; the optimizer may still split those.
    """
    spark = big.sparkSession
    names = {k: f"__on{i}" for i, k in enumerate(keys)}
    right = small.withColumnsRenamed(names)
    on = F.lit(True)
    for k, n in names.items():
        on = on & big[k].eqNullSafe(right[n])
    if (measured(small)[1] if size is None else size) <= broadcast_limit(spark):
        return big.join(F.broadcast(right), on, how).drop(*names.values())
    left = big.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    right = right.withColumn("__place", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    on = left["__salt"] == right["__place"]
    for k, n in names.items():
        on = on & left[k].eqNullSafe(right[n])
    return left.join(right.hint("merge"), on, how).drop("__salt", "__place", *names.values())


#: Session setting: the number of tasks that scans ahead of costly work are spread over. Unset on a cluster, where tables
#: have many files and row groups; a single machine sets it for tables that are one row group, which Spark cannot split.
SCAN_TASKS = "spark.phrasegrid.scan.tasks"


def spread(df: DataFrame) -> DataFrame:
    """``df`` (a scan with projections) over as many tasks as the session asks for, whatever its size; as it is without the setting."""
    tasks = df.sparkSession.conf.get(SCAN_TASKS, None)
    return df.repartition(int(tasks)) if tasks else df
