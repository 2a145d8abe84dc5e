"""Written tables: what a plan reads more than once, or what a loop's next round starts from, as Parquet in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. On a local master, as in tests, a temporary one where it is unset; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="orrery-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings (dots as double underscores) that hold for what runs inside; afterwards the session's own are back."""
    own = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to a table in the shared folder and read it: cuts the lineage, survives lost executors, has a known size. Nothing reads the shuffles of the write again, so they are deleted with it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._orrery_path = path
    if (held := _scratch.get()) is not None:
        held.append(out)
    return out


def drop_written(*tables: DataFrame) -> None:
    """Delete tables that written() made; the caller knows that nothing reads them any more."""
    for df in tables:
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._orrery_path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


_scratch: ContextVar[list[DataFrame] | None] = ContextVar("_scratch", default=None)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside are deleted at its end, also after an error, but for those that are handed to what this gives: a result reads them. Such a
    table goes with an enclosing scratch(), if there is one, and else stays in the shared folder."""
    held: list[DataFrame] = []
    kept: list[DataFrame] = []
    outer = _scratch.set(held)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        _scratch.reset(outer)
        drop_written(*[t for t in held if all(t is not k for k in kept)])
        if (above := _scratch.get()) is not None:
            above.extend(kept)
