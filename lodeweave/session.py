"""Session helpers: a default local session, the shared work folder, lineage cuts and checked broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a side may have to be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lodeweave")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def work_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where it is unset a local session gets a folder of its own,
    which goes with the process; on a cluster that would be another folder on every machine, so it raises."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        made = tempfile.mkdtemp(prefix="lodeweave-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        shared = "file://" + made
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


#: Paths of the stages written, newest last, for those who delete them.
_written: list[str] = []


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; `stages` deletes what is written there."""
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


#: With it Spark deletes the shuffle files of a query when it ends; else they stay until the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str = "stage", rows_a_file: int = 0) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts the lineage, survives lost executors.
    The shuffle files of the write are deleted. rows_a_file bounds the rows of a file, so that few rows are read by several tasks, too."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    kept = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("maxRecordsPerFile", rows_a_file).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, kept) if kept else spark.conf.unset(_CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*stages_: DataFrame) -> None:
    """Deletes what was materialized as these, where nothing reads it any more."""
    for df in stages_:
        names = {f.rsplit("/", 2)[-2] for f in df.inputFiles()}
        for path in [p for p in _written if p.rsplit("/", 1)[-1] in names]:
            _delete(df.sparkSession, path)
            _written.remove(path)


@contextlib.contextmanager
def stages(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end all that was materialized inside; results must be written or collected by then."""
    before = len(_written)
    try:
        yield
    finally:
        for path in _written[before:]:
            _delete(spark, path)
        del _written[before:]


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting that df has at most `limit` rows."""
    few = df.limit(limit + 1).count() <= limit
    return F.broadcast(df) if few else df
