"""Session helpers: the settings every operator assumes, and the shared
checkpoint folder used to cut long lineages."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tablesight") -> SparkSession:
    """Build (or reuse) a session with UTC time, ANSI mode and AQE on.

    On a cluster, pass ``master=None`` and let spark-submit decide; the
    shuffle partition count should then follow the data size (about 128 MB per
    partition after the largest shuffle) rather than the default 200.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
        "spark.driver.memory": os.environ.get("TABLESIGHT_DRIVER_MEMORY", "16g"),
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster sets it to a shared file system.  Where it is unset, only a
    local session (tests) may use a scratch folder of its own: on a cluster a
    folder of one machine would hold a part of the rows only.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder shared by driver and executors ({master})")
        path = tempfile.mkdtemp(prefix="tablesight-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


#: Paths of the scratch tables of the open scopes, the innermost last.
_OPEN_SCOPES: list[list[str]] = []


def own_scratch(path: str) -> None:
    """Let the innermost open scope drop ``path`` at its end."""
    if _OPEN_SCOPES:
        _OPEN_SCOPES[-1].append(path)


def scratch_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back, so that
    later passes neither recompute it nor depend on any one executor.  Inside a
    :func:`scratch_scope` the table lasts until the scope ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    own_scratch(path)   # before the write: a failed one leaves files too
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Own the scratch tables written inside, and drop them at the end, failed or
    not.  Results have to be written or collected before the scope ends; frames
    that read its tables are of no use after it.  Scopes nest; they belong to the
    process, so runs of several threads should share one."""
    owned: list[str] = []
    _OPEN_SCOPES.append(owned)
    try:
        yield
    finally:
        _OPEN_SCOPES.remove(owned)
        hadoop = spark._jsc.hadoopConfiguration()
        for path in owned:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(hadoop).delete(at, True)
