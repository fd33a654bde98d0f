"""Spark session defaults for the reports.

On a cluster the session comes from the platform; ``build_session`` is for
tests, the bench and local runs.  Settings are chosen for the shape of the
workload: a large ledger fact joined to small dimensions and aggregated to a
handful of report rows.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings that matter at scale, independent of the local test harness.
SCALE_CONF = {
    # Runtime re-planning: coalesce small shuffle partitions, split skewed
    # join partitions, and turn a sort-merge join into a broadcast join only
    # once the measured size of a side is known to be small.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    # Partition sizing.  Scan splits and post-shuffle partitions of ~256 MB
    # keep a task's working set well inside an executor core's memory share.
    # spark.sql.shuffle.partitions is the upper bound AQE coalesces from: set
    # it (per cluster) to about the largest shuffle / 256 MB -- e.g. ~400 for
    # a daily report over a ~100 GB ledger day, a few thousand for a full
    # rebuild of the side tables -- and AQE merges the small ones.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    # Bloom-filter runtime filters prune the ledger side of selective joins.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    # Checkpointed relations are removed once no DataFrame refers to them.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}


def build_session(master: str | None = None, app: str = "tallyspark",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the report defaults.

    ``spark.checkpoint.dir`` is left alone when the cluster sets it; only a
    local run without one gets a private scratch folder.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(SCALE_CONF)
    conf["spark.ui.enabled"] = "false"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster owns that setting and Spark registers it at start-up.  Only
    a ``local`` session (one process, as in tests) without the setting gets a
    fresh scratch folder; on a cluster executors could not read each other's,
    so there the missing setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tallyspark-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path
