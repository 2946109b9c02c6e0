"""What the operators of this package share: intermediate tables and names."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_folders: dict[str, tuple[SparkSession, str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where the setting is absent (tests on one machine) a temporary folder stands in;
    off one machine that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + tempfile.gettempdir()


def work_folder(spark: SparkSession) -> str:
    """This application's own folder for intermediate tables; removed when the driver's Python ends."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = spark, f"{shared_folder(spark)}/rowsight-{app}-{uuid.uuid4().hex[:8]}"
    return _folders[app][1]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, folder in _folders.values():
        with contextlib.suppress(Exception):  # the JVM may be gone
            _delete(spark, folder)


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold texts of about 4 MB rather than 10,000 texts of any length, unless the session has its own limits."""
    prefix = "spark.sql.execution.arrow."
    if int(spark.conf.get(prefix + "maxRecordsPerBatch")) == 10_000:  # the default
        spark.conf.set(prefix + "maxRecordsPerBatch", "2000")
    # the default is no limit; sizes may carry a unit
    if len(re.sub(r"\D", "", spark.conf.get(prefix + "maxBytesPerBatch"))) > 9:
        spark.conf.set(prefix + "maxBytesPerBatch", str(4 << 20))


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder: later readers neither
    repeat its work nor depend on the executors that did it.

    A table rather than a checkpoint, because a checkpoint keeps the size estimate of
    its plan: over rounds of joins these products of products grow to numbers of
    many thousand digits. A table has the size of its files. Shuffle files go once the
    table is written: nothing reads them again.
    """
    path = f"{work_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    before = df.sparkSession.conf.get(CLEANUP)
    df.sparkSession.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        df.sparkSession.conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a settled table that nothing reads any more."""
    for file in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if "/rowsight-" in file:
            _delete(df.sparkSession, file)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores added until no column of ``df`` has the name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
