"""Session helpers: the shared scratch folder, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import os
import sys
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Small lookup tables (levels, coefficients, per-coverage parameters) are
# broadcast only when a count proves them below this many rows; above it the
# join is left to the planner (sort-merge, or AQE's own size check).
BROADCAST_MAX_ROWS = 200_000

# Rows that one task of a sort, join or window over whole tables gets, and the number of tasks up to
# which Spark's own choice is left alone. Sizes in bytes say little here: rows that compress well in the
# shuffle take many times as much in a sort.
TASK_ROWS = 250_000
FEW_TASKS = 8

_LOCAL_SCRATCH: dict = {}


def get_spark(master: str = "local[*]", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; a cluster job brings its own."""
    spark = (
        SparkSession.builder.master(master)
        .appName("ratewise")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    Only when the setting is unset and the master is local (tests, the bench)
    is a private temporary folder created; a cluster job without the setting
    is refused rather than writing to a machine-local folder.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        path = conf
    else:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder for this job")
        key = (id(spark), spark.conf.get("spark.app.id", None))
        if key not in _LOCAL_SCRATCH:
            _LOCAL_SCRATCH[key] = tempfile.mkdtemp(prefix="ratewise-", dir="/tmp")
        path = _LOCAL_SCRATCH[key]
    try:
        spark.sparkContext.setCheckpointDir(path)
    except Exception:  # Spark Connect has no SparkContext
        pass
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet under the shared scratch folder and read it back.

    Cuts the lineage (a lost executor re-reads the files instead of re-running
    the fits) and computes the plan once however many consumers follow.
    """
    spark = df.sparkSession
    path = os.path.join(scratch_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    t = time.time()
    df.write.mode("overwrite").parquet(path)
    if os.environ.get("RATEWISE_TRACE"):
        print(f"[materialize] {name}: {time.time() - t:.2f}s", file=sys.stderr)
    return settled(spark.read.schema(df.schema).parquet(path))  # a known schema saves the job that would look for it


def tasks_for(rows: int) -> int:
    """Tasks of about ``TASK_ROWS`` rows each."""
    return -(-rows // TASK_ROWS)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, which has about ``rows`` rows, dealt by ``keys`` so that a task gets about ``TASK_ROWS`` whatever the table's size.

    Up to ``FEW_TASKS`` such tasks the table is left to the planner.
    """
    n = tasks_for(rows)
    return df if n <= FEW_TASKS else df.repartition(n, *keys)


def settled(df: DataFrame) -> DataFrame:
    """Mark a table read, or computed in one step, from written files: Spark bounds its bytes by theirs and
    broadcasts it if they are few, so ``small`` adds nothing."""
    df._rw_settled = True
    return df


def _checked(df: DataFrame, n: int, max_rows: int) -> DataFrame:
    out = F.broadcast(df) if n <= max_rows else df
    out._rw_rows = n  # the check is done; ``small`` will not count again
    return out


def known_small(df: DataFrame, n: int, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast hint for a table built on the driver from ``n`` rows."""
    return _checked(df, n, max_rows)


def keep(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Cache a small, deterministic summary table, compute it now, and mark it
    for broadcast when its row count is within the bound.

    Used for per-coverage/per-tier tables whose inputs are already cut by
    ``materialize``: a lost executor recomputes them cheaply from those files.
    The broadcast hint survives later ``select``/``filter`` calls.
    """
    df = df.cache()
    return _checked(df, df.count(), max_rows)


def small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast hint behind a row-count check.

    A table written by ``materialize`` is left as it is: its bytes are known to Spark, which
    broadcasts it within ``spark.sql.autoBroadcastJoinThreshold``. Tables from
    ``keep``/``small`` carry their count already; others are counted.
    Above the bound the table is returned unhinted and the planner decides
    (sort-merge join, or AQE's runtime size check).
    """
    if getattr(df, "_rw_settled", False) or getattr(df, "_rw_rows", None) is not None:
        return df
    return _checked(df, df.count(), max_rows)
