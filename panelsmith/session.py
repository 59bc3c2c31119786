"""Session construction and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(app_name: str = "panelsmith", cores: str | int | None = None) -> SparkSession:
    """Local session for tests and benchmarks; on a cluster ``spark-submit`` supplies the master."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if cores is not None:
        builder = (
            builder.master(f"local[{cores}]")
            .config("spark.sql.shuffle.partitions", str(cores))
            .config("spark.driver.memory", os.environ.get("PANELSMITH_DRIVER_MEMORY", "12g"))
        )
    return builder.getOrCreate()


#: Temporary folders of local sessions, by application.
_LOCAL: dict[str, str] = {}
_SCOPE = "panelsmith.scratch.scope"


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Where the cluster names none, a local master gets a temporary folder; any other master is an
    error, because a machine-local folder would not survive the loss of that machine.
    """
    context = spark.sparkContext
    folder = (
        spark.conf.get("spark.checkpoint.dir", None)
        or context.getConf().get("spark.checkpoint.dir")
        or context.getCheckpointDir()
    )
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = _LOCAL.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="panelsmith-")
        _LOCAL[context.applicationId] = folder
    return folder


def _tables(spark: SparkSession, scope: str | None) -> str:
    return f"{shared_folder(spark).rstrip('/')}/panelsmith-tables" + (f"/{scope}" if scope else "")


def scratch_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A fresh path for a written table below the shared folder; ``keep``: outside any scope."""
    scope = None if keep else spark.sparkContext.getLocalProperty(_SCOPE)
    return f"{_tables(spark, scope)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Tables written inside (also by threads that inherit Spark's local properties) go at the end."""
    context = spark.sparkContext
    outer, scope = context.getLocalProperty(_SCOPE), uuid.uuid4().hex
    context.setLocalProperty(_SCOPE, scope)
    try:
        yield
    finally:
        context.setLocalProperty(_SCOPE, outer)
        drop_table(spark, _tables(spark, scope))


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a written table (or a folder of them) that no later job reads."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def cut_lineage(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it from there.

    Later jobs depend on the files only, so the loss of an executor repeats no earlier work; and they
    read just the columns they need, which a checkpointed RDD of whole rows would not allow. A table
    written inside a ``scratch_scope`` goes with it, unless it is to ``keep``.
    """
    path = scratch_path(df.sparkSession, "cut", keep)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the table behind a DataFrame that :func:`cut_lineage` returned."""
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        drop_table(df.sparkSession, folder)
