"""Spark session helpers.

The library never creates its own cluster settings beyond what a job needs:
AQE on, UTC session time zone (trace stamps are plain nanosecond counts, but
the test adapters derive them from ``timestamp_ntz`` columns), and a
checkpoint directory taken from ``spark.checkpoint.dir`` when the cluster
names one.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # transformWithState (streaming pairing) needs the RocksDB provider.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",  # see ROCKSDB
}


def scale_conf(input_bytes: int, target_partition_bytes: int = 256 << 20) -> dict:
    """Settings sized for the input volume of a job (e.g. 100 TB of events).

    Shuffle partitions are chosen so that one partition holds about
    ``target_partition_bytes`` of shuffled data (AQE coalesces them when
    filters shrink the data, and splits skewed ones in joins); file splits
    use the same size, so a scan task and a reduce task fit the same
    executor memory."""
    parts = max(200, min(200_000, input_bytes // target_partition_bytes + 1))
    size = f"{target_partition_bytes // (1 << 20)}m"
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": size,
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": size,
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": f"{4 * target_partition_bytes // (1 << 20)}m",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    }


def get_spark(master: str | None = None, app: str = "tracelat",
              shuffle_partitions: int | None = None, **conf) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k.replace("_", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the session-level settings the operators rely on (idempotent)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ensure_stateful_streaming(spark: SparkSession) -> None:
    """``transformWithState`` keeps several state variables per operator,
    which only the RocksDB state store supports; select it unless the
    session already names a provider other than the default one."""
    key = "spark.sql.streaming.stateStore.providerClass"
    cur = spark.conf.get(key, None)
    if not cur or cur.endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(key, ROCKSDB)


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir``.  Only a local-mode session (tests)
    gets a private scratch folder when the setting is absent; on a cluster a
    machine-local folder would be lost with its executor, so it is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not _is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        d = tempfile.mkdtemp(prefix="tracelat-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d
