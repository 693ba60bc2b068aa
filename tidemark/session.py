"""Session set-up and the few places where the library needs shared storage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


class TidemarkError(ValueError):
    """A contract of the library was broken by its input."""


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Joins whose output feeds a window on the same key must still be split when skewed.
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        # HotSpot never compiles methods above 8000 bytes; wide generated stages would run interpreted.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    A temporary folder is only used in local mode with nothing configured.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    named = named or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise TidemarkError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(named)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage through reliable shared storage, so a lost executor cannot change the rows.

    Order and partitions stay, and so does the planner's estimate of the size. A loop that joins a table with what was
    made from it would multiply these estimates with every round: use ``written`` there.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table to the shared folder and read it back: lineage and size estimates are cut, readers take single columns."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """Rows dealt by their keys to tasks of about ``rows`` rows each, however few files or large partitions they came in.

    For steps that make much of little input: a task's share then stays the same while the table grows. The rows are
    counted first, so ``df`` should be cheap to read or written. Adaptive execution keeps a number that was asked for.
    """
    return df.repartition(max(1, -(-df.count() // rows)), *[F.col(k) for k in keys])


# A table of at most so many bytes, measured on its rows, is sent to every executor.
SMALL_BYTES = 32 << 20


def measured_bytes(df: DataFrame) -> int:
    """Bytes of a table's values: sixteen for every fixed-width one, the contents of texts and nested values besides."""
    held = []
    for field in df.schema:
        kind = field.dataType.typeName()
        if kind in ("string", "binary", "char", "varchar"):
            held.append(F.octet_length(field.name))
        elif kind in ("array", "map", "struct"):
            held.append(F.octet_length(F.to_json(field.name)))
    more = [F.sum(F.coalesce(h.cast("bigint"), F.lit(0))) for h in held]
    row = df.agg(F.count("*"), *more).first()
    return 16 * len(df.columns) * row[0] + sum(x or 0 for x in row[1:])


def small(df: DataFrame, limit: int = SMALL_BYTES) -> DataFrame:
    """A rolled-up side of a join: written once, measured, and broadcast only when it proved small.

    Beyond the limit the join shuffles, with skewed partitions split at run time.
    """
    settled = settle(df)
    return F.broadcast(settled) if measured_bytes(settled) <= limit else settled


def _hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system that Spark knows, sorted; none where there is no such folder."""
    files, place = _hadoop(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(place)) if files.exists(place) else []


def stored_bytes(spark: SparkSession, path: str) -> int:
    files, place = _hadoop(spark, path)
    return files.getContentSummary(place).getLength() if files.exists(place) else 0


def remove(spark: SparkSession, path: str) -> None:
    files, place = _hadoop(spark, path)
    files.delete(place, True)
