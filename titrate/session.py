"""Session settings the jobs rely on."""

from __future__ import annotations

import hashlib
import os
import tempfile

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def build_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings every job assumes: UTC and adaptive execution with skew handling.

    Joins carry no broadcast hints: Spark compares each side's measured size with
    ``autoBroadcastJoinThreshold`` (statically and again at run time) and falls back to a shuffled join whose
    skewed partitions adaptive execution splits.
    """
    builder = (
        SparkSession.builder.appName("titrate")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        # Noting the line of every Column call takes most of the time in which a wide plan is made.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Where none is named, a scratch folder stands in on a local master, whose executors share the driver's disk; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        if not os.path.isdir(_scratch.get(spark.sparkContext.applicationId, "")):
            _scratch[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        named = _scratch[spark.sparkContext.applicationId]
    return named


_scratch: dict[str, str] = {}  # application -> folder; the setting itself cannot be changed while a session runs
_written: dict[tuple[str, str], str] = {}


def _state_of_inputs(df) -> str:
    """One number over path, length and time of change of every file that the rows come from."""
    files = df.inputFiles()
    if not files:
        return "none"
    listed = df.sparkSession.read.format("binaryFile").load(files).select("path", "length", "modificationTime")
    return str(listed.agg(F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()[0])


def written_table(spark: SparkSession, name: str, build):
    """A small derived table, written once for each state of its inputs to the shared folder and read back from there.

    Its files give the optimizer real sizes, and any executor can read them again after a loss. Input files that were changed, added or removed
    give a new table.
    """
    rows = build()
    key = (spark.sparkContext.applicationId, f"{name} {_state_of_inputs(rows)}")
    if key in _written:
        try:
            return spark.read.parquet(_written[key])
        except AnalysisException:
            del _written[key]  # the shared folder was cleared: write the table again
    digest = hashlib.sha256(key[1].encode()).hexdigest()[:16]
    path = f"{checkpoint_dir(spark)}/titrate-{spark.sparkContext.applicationId}/{digest}"
    rows.write.mode("overwrite").parquet(path)
    _written[key] = path
    return spark.read.parquet(path)
