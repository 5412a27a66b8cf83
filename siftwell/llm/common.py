"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and the controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables; Spark reads the path, so any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and read it from there.

    The rows then survive lost executors and are computed once.  The folder is
    the session's ``spark.checkpoint.dir``; only where none is set and Spark
    runs in one process (local tests) a temporary folder is taken.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def discard(*frames: DataFrame) -> None:
    """Delete the checkpoints that ``cut`` wrote for ``frames``; nothing may need them any more."""
    for frame in frames:
        file = frame._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            jvm = frame.sparkSession.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(frame.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tasks(rows: int, each: int = 50_000, least: int = 8) -> int:
    """Tasks for lean rows: so many partitions that each holds ``each`` rows, but ``least`` of them."""
    return max(least, -(-rows // each))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str | Column) -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def sql_text(text: str) -> str:
    """``text`` as a SQL string literal without escapes of the session's parser."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
