"""Cutting lineage, so that work which must not be repeated is not repeated."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    A cluster names a shared folder in ``spark.checkpoint.dir``. Only where
    neither that nor a folder on the context is set, as in local tests, a
    temporary one is made.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("Set spark.checkpoint.dir to a folder all executors share.")
        folder = tempfile.mkdtemp(prefix="tallymark-checkpoint-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """Compute a table once: into ``path`` as Parquet, or into a checkpoint."""
    if path is not None:
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.parquet(path)
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there; any other fault is raised."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def read_small(spark: SparkSession, path: str) -> str | None:
    """Text of a small file; None if there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(hadoop):
        return None
    stream = files.open(hadoop)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file so that it is there as a whole or not at all; it must not exist yet."""
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    draft = jvm.org.apache.hadoop.fs.Path(hadoop.getParent(), f"_draft-{uuid.uuid4().hex}")
    stream = files.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    if files.exists(hadoop) or not files.rename(draft, hadoop):
        files.delete(draft, False)
        raise FileExistsError(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
