"""Session defaults, table access and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "tallyloom", master: str | None = None) -> SparkSession:
    """A session with the settings the operators assume; an active session is reused as it is."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    return builder.getOrCreate()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``root``."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate results that all executors share: the one in ``spark.checkpoint.dir``. Where that is
    unset a local master gets a temporary folder (one machine, so it is shared); a cluster must name one."""
    sc = spark.sparkContext
    if known := sc.getCheckpointDir():
        return known
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not named:
        named = tempfile.mkdtemp(prefix="tallyloom-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


_written: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """``df`` computed once and written as a Parquet table in the shared folder, so that several consumers read it,
    pruned and filtered in the scan, instead of computing it again. It survives the loss of executors. Compressed
    columns take a fraction of the space of Spark's own checkpoint, and the planner sees the table's real size; after a few
    rounds of checkpointed joins its estimates would be numbers of millions of digits. The table goes with the folder,
    with :func:`discard`, or at the end of the :func:`workspace` it was written in."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    if path.startswith("file:") or path.startswith("/"):
        shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
        return
    target = spark._jvm.org.apache.hadoop.fs.Path(path)  # PySpark has no call of its own for this
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Removes written tables that no plan reads any more, such as those of a loop's earlier rounds."""
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if any(path.endswith(own.rpartition("/")[2]) for own in _written):
                _remove(df.sparkSession, path)


@contextmanager
def workspace(spark: SparkSession) -> Iterator[None]:
    """Removes what is written inside, at the end. What a query returns has to be consumed inside."""
    before = len(_written)
    try:
        yield
    finally:
        for path in _written[before:]:
            _remove(spark, path)
        del _written[before:]
