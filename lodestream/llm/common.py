"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z as a-z, in bytes.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Paths that this driver has given out.
_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master that names none (tests on one machine) gets a temporary folder; on a
    cluster a missing setting is an error, as no machine's own folder would do.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        named = "file://" + tempfile.mkdtemp(prefix="lodestream-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession, *keep: str) -> Iterator[None]:
    """On leaving, deletes what was written to the shared folder meanwhile, but for paths that hold
    one of the names. Only for code that has written its result by then."""
    before = len(_made)
    try:
        yield
    finally:
        for path in _made[before:]:
            if not any(f"/{name}-" in path for name in keep):
                delete(spark, path)
        del _made[before:]


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage in a way that survives the loss of executors, and a later
    sort-merge join with the table has an exchange on this side, which lets adaptive
    execution split skewed keys.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The result of ``make`` as a written table; the tables that it has written for itself go."""
    with scratch(spark, name):
        return written(make(), name)


def whole_text(column: str = "text") -> Column:
    """The text as a string that is never null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df
