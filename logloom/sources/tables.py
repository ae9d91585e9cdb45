"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

#: Tables written inside the innermost `scratch`.
_MADE: contextvars.ContextVar[list[DataFrame] | None] = contextvars.ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one is made only where none is set, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="logloom-"))
        base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return base


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends there, so a lost
    executor costs a re-read and not a re-computation, and a later pass sees the same rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    made = _MADE.get()
    if made is not None:
        made.append(out)
    return out


def discard(df: DataFrame) -> None:
    """Delete a materialized table that nothing reads any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables materialized inside are deleted at its end, but for those given to the function that it yields."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []
    outer = _MADE.get()
    token = _MADE.set(made)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        _MADE.reset(token)
        for t in made:
            if not any(t is k for k in kept):
                discard(t)
            elif outer is not None:
                outer.append(t)
