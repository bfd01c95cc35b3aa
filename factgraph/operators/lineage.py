"""Cutting the lineage of iterative plans, and tables that are read more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint in spark.checkpoint.dir, which all executors share. Where that is unset, a single machine takes a folder of
    its own; a cluster has none that all its executors see, so that is an error.

    A checkpoint keeps the size that the optimizer guessed for its plan, from the size of the files read: for rows that were parsed or
    exploded that is far too little, and tables of any size would be broadcast through the driver. So the checkpoint's rows are taken
    as a table of unknown size: only joins whose input was measured, after its shuffle, become broadcasts."""
    spark = df.sparkSession
    _folder(spark)
    kept = df.checkpoint()._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), spark)


def _folder(spark: SparkSession) -> str:
    """The application's own folder in spark.checkpoint.dir."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="factgraph-"))
    return context.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the folder of checkpoints: a reader takes the columns that it needs, however often it is read, and plans
    over it stay small.

    Values are written plain, so the files are about as large as the rows: the optimizer, which takes a table for as large as its
    files, does not broadcast through the driver what was only small when compressed."""
    path = f"{_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Written(dict):
    """Tables by name, each written when it is first asked for."""

    def __init__(self, tables: dict[str, DataFrame]):
        super().__init__()
        self._tables = tables

    def __missing__(self, name: str) -> DataFrame:
        self[name] = written(self._tables[name])
        return self[name]
