"""Session settings shared by the bench, the tests and local runs."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that every run of this package relies on. Sizes that depend on the
#: cluster (executors, memory, shuffle partitions) are left to the submitter;
#: adaptive execution coalesces and splits shuffle partitions at run time.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}
#: Tasks that Python work on a scan is spread over, by one exchange. Set for local sessions on tables of
#: one file and row group; unset on a cluster, where a scan has splits enough and nothing is moved.
LOCAL_TASKS = "spark.formflow.localTasks"


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("formflow")
    settings = {
        **BASE_CONF,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.shuffle.partitions": str(cores if cores != "*" else 8),
        LOCAL_TASKS: str(cores if cores != "*" else 8),
        **conf,
    }
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only in local mode (tests, a laptop) a folder of this machine is made where
    the setting is absent; a cluster without the setting is refused, for its
    executors share no such folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if folder is None:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), f"formflow-{uuid.uuid4().hex}")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return folder


def tasks(spark: SparkSession) -> int:
    """Partitions for work whose cost isn't its bytes: twice the cores, or the shuffle setting if larger.

    A number given to ``repartition`` is kept by adaptive execution, which
    would join partitions of few bytes into one task. Give no columns with it
    after an aggregate on the same ones: the planner drops such an exchange.
    """
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many tasks as the session's ``LOCAL_TASKS`` says; where it is unset, ``df`` as it is.

    The plan depends on this setting only, never on the size of the input.
    """
    n = df.sparkSession.conf.get(LOCAL_TASKS, None)
    return df.repartition(int(n)) if n else df


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and drop its lineage.

    Used where one result feeds several branches: the rows are computed once
    and survive the loss of an executor.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the Parquet tables of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
