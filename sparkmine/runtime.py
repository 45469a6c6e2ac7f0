"""Session helpers shared by all operators: names, shared-folder tables, sizes."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def col(name: str) -> Column:
    """A column by its exact name, dots and blanks in it included."""
    return F.col("`" + name.replace("`", "``") + "`")


def in_one_process(master: str) -> bool:
    """Whether this master runs everything in the driver's process, so that its own disk is the shared one."""
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the session's checkpoint folder where one was set.

    Only a local master may do without either and gets a temporary folder; on a cluster that folder would be a different
    one on each machine, so a missing setting is an error there.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not in_one_process(sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="sparkmine-"))
    return sc.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession) -> str:
    """A place of its own in the shared folder, removed when the session's Python ends or by ``drop_stored``."""
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(drop_stored)
    _written.append((spark, path))
    return path


def stored(df: DataFrame, *partition_by: str, path: str | None = None) -> DataFrame:
    """Cut the lineage: write df as a table into the shared folder (at ``path``, if given) and read it back.

    The job runs at once. A written table survives the loss of executors, is columnar (later reads prune and push down)
    and is removed when the session's Python ends.
    """
    path = path or new_path(df.sparkSession)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system named, as programs other than Spark read it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    name = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file://" + name.removeprefix("file:") if name.startswith("file:/") and not name.startswith("file://") else name


def drop_stored(keep: int = 0) -> None:
    """Remove the tables written by ``stored``, but for the first ``keep``; the frames read from them can't be used afterwards."""
    while len(_written) > keep:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended
            pass


@contextmanager
def scratch() -> Iterator[None]:
    """Tables stored within the block are removed at its end: for sessions that run many queries and write each result."""
    before = len(_written)
    try:
        yield
    finally:
        drop_stored(before)


def parts_for(spark: SparkSession, rows: int, rows_per_part: int, least: int | None = None) -> int:
    """Partitions that hold about rows_per_part rows each; at least ``least``, by default as many as the session is set to."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions")) if least is None else least
    return max(least, math.ceil(rows / max(1, rows_per_part)))


#: Rows up to which a side with a few plain columns may be broadcast (some tens of MB).
FEW = 200_000


def sent_if_few(df: DataFrame, rows: int, few: int = FEW) -> DataFrame:
    """A join side of so many rows (counted, or bounded by a parameter): marked for broadcast only if they are few."""
    return F.broadcast(df) if rows <= few else df
