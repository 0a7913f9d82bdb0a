"""Cutting lineage with tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from gleaner.operators.shared import _BATCH, BATCH_BYTES, shared_dir, small_batches  # noqa: F401  operators have them from here


#: Folders of the tables that were written within scratch().
_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that operators write for themselves within this are removed at its end. What is to stay must be written by then:

        with scratch(spark):
            dedup_documents(docs).write.parquet(folder)
    """
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


#: Has Spark drop the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df once and read it back, so that a lost executor costs no more
    than the tasks after this point. What was shuffled for it is dropped: only the table is read from then on."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gleaner-{name}-{uuid.uuid4().hex}"
    for folders in _scratch[-1:]:
        folders.append(path)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Remove tables of materialize() that nothing reads any more."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            folder = file.rpartition("/")[0]
            if folder.rpartition("/")[2].startswith("gleaner-"):
                _remove(df.sparkSession, folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
