"""Written intermediates in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a local session that names none gets a temporary folder; a cluster must name one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


_written: list[str] = []

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go when it is written, not when the driver next collects its garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the reread table. Cuts the lineage."""
    path = f"{shared_dir(df.sparkSession)}/auctra-{name}-{uuid.uuid4().hex}"
    with swept(df.sparkSession):
        df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder, for files that are not one table; ``release`` deletes it."""
    path = f"{shared_dir(spark)}/auctra-{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def _read_by(df: DataFrame) -> list[str]:
    """The tables of ``materialise`` that ``df`` reads."""
    plain = lambda x: re.sub("/+", "/", x.removeprefix("file:"))  # noqa: E731  one spelling of local paths
    folders = {plain(f.rpartition("/")[0]) for f in df.inputFiles()}
    return [x for x in _written if plain(x) in folders]


def discard(table: DataFrame) -> None:
    """Deletes a table of ``materialise`` whose every reader has been written."""
    remove(table.sparkSession, _read_by(table))


def keep_for(df: DataFrame, paths: list[str]) -> None:
    """Deletes those of ``paths`` that ``df`` does not read."""
    read = set(_read_by(df))
    remove(df.sparkSession, [x for x in paths if x not in read])


@contextmanager
def recorded() -> Iterator[list[str]]:
    """Paths of the tables that are written inside and still there at the end."""
    before, paths = set(_written), []
    yield paths
    paths += [x for x in _written if x not in before]


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes the tables at these paths, if they are still there."""
    for path in [x for x in paths if x in _written]:
        _written.remove(path)
        _delete(spark, path)


def release(spark: SparkSession) -> int:
    """Deletes the tables that this process has written; call it when no result is read any more."""
    n = 0
    while _written:
        n += _delete(spark, _written.pop())
    return n
