"""Lineage cuts: steps as Parquet files in the shared folder, which go when nothing reads them any more."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; where none is set, a temporary one in local mode and
    an error elsewhere."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="tracewell-"))
    return _LOCAL[0]


def by_rows(df: DataFrame, most: int, *keys: str) -> DataFrame:
    """df in tasks of about so many rows each (with keys: by them): for steps that make much of rows of few bytes, which Spark, going by bytes, would
    leave to a few tasks. Rows are counted first; df should be cheap to read twice."""
    return df.repartition(max(1, -(-df.count() // most)), *keys)


def materialize(df: DataFrame, what: str = "step", codec: str | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends here, so a lost executor costs no more
    than the tasks that read the files. The shuffle files of the step go when it has ended, its own with drop() or when the
    driver ends. codec: how the files are compressed, if not as the session has it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracewell/{what}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        (df.write.option("compression", codec) if codec else df.write).parquet(path)
    except BaseException:
        discard(spark, path)
        raise
    finally:
        spark.conf.set(CLEANUP, before)
    atexit.register(discard, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tracewell_path = path
    return out


def drop(*steps: DataFrame) -> None:
    """Remove the files of materialised steps that nothing reads any more."""
    for df in steps:
        if path := getattr(df, "_tracewell_path", None):
            discard(df.sparkSession, path)


def discard(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session has ended; the folder's owner cleans up
        return
