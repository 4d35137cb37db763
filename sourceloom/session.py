"""Session settings used by the tests, the benchmark and the driver entry."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: The temporary folder of this process, once it is needed.
_LOCAL: list[str] = []


def build_session(app: str = "sourceloom", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: the cluster's ``spark.checkpoint.dir``.

    Where that setting is missing, a temporary folder serves if driver and tasks are one process (master ``local``, as in
    tests); it is deleted at the end. On a cluster a machine's own folder would lose rows, so there the setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="sourceloom-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return tempfile.mkdtemp(dir=_LOCAL[0])


def saved(df: DataFrame) -> DataFrame:
    """The rows, computed once and written to the shared checkpoint folder, so that a lost executor repeats nothing before them."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()
