"""Session set-up, shared scratch space and size-checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table (in rows) that is ever sent to every executor.
BROADCAST_ROWS = 200_000
#: Rows below which one more task costs an iterative fit more than it gains.
ROWS_PER_TASK = 20_000

_LOCAL_SCRATCH: tempfile.TemporaryDirectory | None = None


# Run-time settings the operators rely on. A hot key's join partition is split
# even where that costs one more shuffle later. Generated methods beyond 8000
# bytes are never compiled by the JVM: better to run such stages operator by operator.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to an existing session."""
    for name, value in RUNTIME_CONF.items():
        spark.conf.set(name, value)
    return spark


def build_session(master: str | None = None, app: str = "accountscope", **conf: object) -> SparkSession:
    """Create (or reuse) a session with the settings the operators are tuned for."""
    builder = SparkSession.builder.appName(app)
    builder = builder.config("spark.serializer", "org.apache.spark.serializer.KryoSerializer")
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), str(value))
    return tune(builder.getOrCreate())


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for tables that cut lineage.

    ``spark.checkpoint.dir`` names it, with or without a scheme: whether a path
    is shared is for the cluster to say, a mounted folder looks like any other.
    Without it, a cluster's tables lie in the warehouse, the other folder that
    Spark itself takes for shared. Only a local master uses a private temporary
    folder: on a cluster that would vanish with the machine that holds it.
    """
    global _LOCAL_SCRATCH
    set_already = spark.sparkContext._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or (set_already.get() if set_already.isDefined() else None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    if _LOCAL_SCRATCH is None:
        _LOCAL_SCRATCH = tempfile.TemporaryDirectory(prefix="accountscope-", ignore_cleanup_errors=True)
    return _LOCAL_SCRATCH.name


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in this application's own part of the shared folder."""
    return f"{scratch_root(spark)}/accountscope/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder; its tables can't be read any more."""
    own = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/accountscope/{spark.sparkContext.applicationId}")
    own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)


def materialise(df: DataFrame, name: str = "table", by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts lineage, survives executor loss, and fixes every non-deterministic
    column, so that several branches of a plan see the same rows. A filter on
    the ``by`` columns then reads only the files of its values.
    """
    path = scratch_path(df.sparkSession, name)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written.scratch = path
    return written


def release(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialise` has written, once nothing reads them or plans on them any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when a count proves ``df`` has at most ``limit`` rows.

    ``df`` is written down first, so that it is computed once and what was
    counted is what gets joined. A larger table comes back without the hint: the
    join is then a shuffle join whose skewed partitions adaptive execution splits.
    """
    written = materialise(df, "join-side")
    return F.broadcast(written) if written.count() <= limit else written


def spread_scan(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a scan of few, dense file splits over all cores before heavy per-row work.

    A scan that already has a split per core is left as it is. Only for plain
    scans: asking a shuffled plan for its partitions would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def compact(df: DataFrame, rows: int, per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Few tasks for few rows: an iterative fit pays for every task in every round.

    Only ever merges partitions, so a large table keeps the ones it has.
    """
    return df.coalesce(max(1, -(-rows // per_task)))
