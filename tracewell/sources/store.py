"""Tables as folders of Parquet files, replaced together or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, base: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{base}/{n}") for n in names}


def replace(spark: SparkSession, base: str, tables: dict[str, DataFrame]) -> None:
    """Write all tables beside the ones in place, then move the old ones aside and the new ones in, by renames alone. A failure
    before the last rename puts the old tables back."""
    jvm = spark.sparkContext._jvm
    path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join((base, *parts)))
    fs = path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    mark = uuid.uuid4().hex
    new, old = f"_new-{mark}", f"_old-{mark}"
    done: list[str] = []
    try:
        for name, df in tables.items():
            df.write.parquet(f"{base}/{new}/{name}")
        fs.mkdirs(path(old))
        for name in tables:
            if fs.exists(path(name)) and not fs.rename(path(name), path(old, name)):
                raise OSError(f"{name} could not be moved aside")
            done.append(name)
            if not fs.rename(path(new, name), path(name)):
                raise OSError(f"{name} could not be moved in")
    except BaseException:
        for name in done:
            if fs.exists(path(old, name)):
                fs.delete(path(name), True)
                fs.rename(path(old, name), path(name))
        raise
    finally:
        fs.delete(path(new), True)
        if fs.exists(path(old)):
            fs.delete(path(old), True)
