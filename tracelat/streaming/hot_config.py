"""Streaming ingest whose settings can change while it runs.

The reference applies a parameter update from the moment it is made, without
restarting the probe.  A stateful operator cannot read a changing table, so
this variant runs every micro-batch through ``foreachBatch`` as ordinary
Spark batch jobs:

1. the batch's raw events get the settings in force at their time
   (:func:`tracelat.operators.asof.asof_join` against the config table as it
   is *now* — it is re-read per batch) and are written to the shared folder
   once.  That is the only read of the source; the same pass counts rows, entries,
   exits and the newest stamp (``Observation``);
2. entries still pending from earlier batches, of the keys that the batch has
   (already filtered when they arrived, so their settings are "off"), are
   worked out once, written beside the batch and unioned in, and the union is paired with
   :func:`tracelat.operators.pairing.pair` — one shuffle by key, skew-safe
   chunking as in batch;
3. the rows go to the batch's own folder of the probe's table
   (``sources/traces.py``), so a re-run of the same batch after a failure
   replaces its own output (exactly once); the counts go to a progress table,
   one row per batch;
4. what the batch changes of the pending table goes to a version of its own,
   in hash buckets of the key: per key, the last surviving event if it is an
   entry, else that nothing is pending.  So a batch writes as many rows as it has
   keys, however many are pending, and reads only buckets that its keys are
   in.  After ``COMPACT_AFTER`` versions they are merged into a full one;
   entries more than ``ttl_ns`` older than the newest event so far are left
   out of what is read, and dropped there.

The settings log is pinned: the first try of a batch writes what it read to
``state/config/batch_id=<id>``, and a re-run reads that.

All state lives in tables under the checkpoint root (a shared folder), so
the query survives executor and driver loss like any file-sink query.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.asof import asof_join
from ..operators.catalog import table_exists
from ..operators.pairing import _raw_needs, pair, prepare
from ..sources.traces import batch_path, write_batch
from ..specs import spec as get_spec


PROGRESS = "batch long, rows_in long, rows_written long, entries long, exits long, newest long"
#: Hash buckets of the pending table, and how many versions are read before they are merged.
BUCKETS, COMPACT_AFTER = 64, 16


def _children(spark: SparkSession, base: str, prefix: str) -> list[int]:
    """Numbers of the finished folders ``base/<prefix>=<number>``, ascending."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(base)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [st.getPath().getName() for st in fs.listStatus(p) if st.isDirectory()]
    return sorted(int(n.split("=", 1)[1]) for n in names if n.startswith(f"{prefix}=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{base}/{n}/_SUCCESS")))


def _versions(spark: SparkSession, base: str, batch_id: int) -> tuple[int | None, list[int]]:
    """The newest full version of the pending table below a batch, and the batches' versions after it."""
    full = [n for n in _children(spark, base, "full") if n < batch_id][-1:]
    return (full[0] if full else None), [n for n in _children(spark, base, "batch_id") if n < batch_id and n > (full[0] if full else -1)]


def _pending_versions(spark: SparkSession, base: str, batch_id: int, schema) -> DataFrame | None:
    """All rows of the versions that hold the pending table before a batch: its columns, ``_bucket``, ``_live``, ``_version``."""
    full, batches = _versions(spark, base, batch_id)
    parts = ([] if full is None else [(full, f"{base}/full={full}")]) + [(n, f"{base}/batch_id={n}") for n in batches]
    out = None
    for n, path in parts:
        rows = spark.read.schema(schema).parquet(path).withColumn("_version", F.lit(n).cast("long"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _latest(rows: DataFrame, keys, since: int | None) -> DataFrame:
    """Of each key the newest version, if an entry is pending there (of stamps from ``since`` on)."""
    held = [c for c in rows.columns if c != "_version"]
    last = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max_by(F.struct(*held), "_version").alias("e")).select("e.*")
    return last.where(F.col("_live") if since is None else F.col("_live") & (F.col("ts_ns") >= since))


def process_batch(batch: DataFrame, batch_id: int, probe: str, root: str, state_root: str,
                  run_id: str, config: DataFrame | None, params, fixed: dict | None = None,
                  ttl_ns: int | None = None) -> None:
    """One micro-batch of the hot-settings ingest (also usable directly).
    ``fixed`` holds settings that do not change (literal values); pending
    entries more than ``ttl_ns`` older than the newest event are given up."""
    spark = batch.sparkSession
    s = get_spec(probe)
    need = [c for c in _raw_needs(s) if c in batch.columns]
    ev = batch.select(*need)
    if config is not None:
        ev = asof_join(ev, config, params)
    else:
        for p in params:
            ev = ev.withColumn(f"_p_{p}", F.lit(None).cast("string"))
    # the one read of the source
    seen, work = Observation(), f"{state_root}/work/batch_id={batch_id}"
    of_kind = lambda kind: F.coalesce(F.sum((F.col("kind") == kind).cast("long")), F.lit(0))
    ev = ev.withColumn("_bucket", F.pmod(F.xxhash64(*s.key_cols), F.lit(BUCKETS)).cast("int"))
    ev.observe(seen, F.count(F.lit(1)).alias("rows_in"), of_kind("entry").alias("entries"), of_kind("exit").alias("exits"), F.max("ts_ns").alias("newest")).write.mode("overwrite").parquet(work)
    count, ev = seen.get, spark.read.schema(ev.schema).parquet(work)

    progress = f"{state_root}/progress"
    before = None
    if table_exists(spark, progress):
        before = spark.read.schema(PROGRESS).parquet(progress).where(F.col("batch") < batch_id).agg(F.max("newest")).first()[0]
    pending_base = os.path.join(state_root, "pending")
    schema = spark.createDataFrame([], ev.schema).select(*need, "_bucket").withColumn("_live", F.lit(True)).schema
    held = _pending_versions(spark, pending_base, batch_id, schema)
    both, total = ev.withColumn("_new", F.lit(True)), count["rows_in"]
    if held is not None:
        touched = [r[0] for r in ev.select("_bucket").distinct().collect()]   # BUCKETS at most
        mine = ev.select(*[F.col(k).alias(f"_m{i}") for i, k in enumerate(s.key_cols)]).distinct()
        same = [F.col(k).eqNullSafe(F.col(f"_m{i}")) for i, k in enumerate(s.key_cols)]
        held = held.where(F.col("_bucket").isin(touched)).join(mine, same, "left_semi")
        carried = _latest(held, s.key_cols, None if ttl_ns is None or before is None else before - ttl_ns).drop("_live").withColumn("_new", F.lit(False))
        for p in params:
            carried = carried.withColumn(f"_p_{p}", F.lit(None).cast(ev.schema[f"_p_{p}"].dataType))
        # worked out once; the pairing and the pending table both read it
        number = Observation()
        carried.observe(number, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{work}-carried")
        both, total = both.unionByName(spark.read.schema(carried.schema).parquet(f"{work}-carried")), total + number.get["rows"]
    settings = {p: F.col(f"_p_{p}") for p in params}
    settings.update(fixed or {})
    written = Observation()
    write_batch(pair(both, s, settings, total=total).observe(written, F.count(F.lit(1)).alias("rows")), root, probe, run_id, f"{batch_id:09d}")
    # what changes of the pending table: per key of the batch, the last event that survived the entry filters
    kept, _, _ = prepare(both, s, settings, extra_cols=("_new", "_bucket"))
    last = kept.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(s.key_cols)]).agg(
        F.max_by(F.struct(*need, "_bucket", "_new"), F.struct("ts_ns", "seq")).alias("e")).select("e.*")
    (last.where("_new").drop("_new").withColumn("_live", F.col("kind") == "entry")
     .write.mode("overwrite").partitionBy("_bucket").parquet(f"{pending_base}/batch_id={batch_id}"))
    newest = max((n for n in (before, count["newest"]) if n is not None), default=None)
    (spark.createDataFrame([(batch_id, count["rows_in"], written.get["rows"], count["entries"], count["exits"], newest)], PROGRESS).coalesce(1)
     .write.mode("overwrite").parquet(f"{progress}/batch_id={batch_id}"))
    _compact_pending(spark, pending_base, batch_id, schema, s.key_cols, None if ttl_ns is None or newest is None else newest - ttl_ns)
    for path in (work, f"{work}-carried"):
        _delete(spark, path)


def _compact_pending(spark: SparkSession, base: str, batch_id: int, schema, keys, since: int | None) -> None:
    """Merge the versions up to a batch into a full one if they are many.  A re-run of the batch needs the full version
    before it and those after; older ones go."""
    full, batches = _versions(spark, base, batch_id + 1)
    if len(batches) < COMPACT_AFTER:
        return
    rows = _latest(_pending_versions(spark, base, batch_id + 1, schema), keys, since)
    rows.write.mode("overwrite").partitionBy("_bucket").parquet(f"{base}/full={batch_id}")
    if full is not None:
        for n in _children(spark, base, "full"):
            if n < full:
                _delete(spark, f"{base}/full={n}")
        for n in _children(spark, base, "batch_id"):
            if n <= full:
                _delete(spark, f"{base}/batch_id={n}")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _drop_versions_before(spark: SparkSession, base: str, keep: str | None) -> None:
    """Remove pending versions older than ``keep`` (the one this batch read):
    a re-run of this batch needs ``keep``, nothing needs the older ones."""
    if keep is None:
        return
    keep_id = int(keep.rsplit("=", 1)[1])
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(base)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith("batch_id=") and int(name.split("=", 1)[1]) < keep_id:
            fs.delete(st.getPath(), True)


def state_root(checkpoint_root: str, probe: str, run_id: str) -> str:
    return os.path.join(checkpoint_root, f"{probe}-{run_id}-state")


def _pinned(spark: SparkSession, path: str, schema, state: str, batch_id: int) -> DataFrame:
    """The settings log as the batch's first try read it."""
    mine = f"{state}/config/batch_id={batch_id}"
    if not table_exists(spark, f"{mine}/_SUCCESS"):
        (spark.read.schema(schema) if schema is not None else spark.read).parquet(path).write.mode("overwrite").parquet(mine)
    _drop_versions_before(spark, f"{state}/config", mine)
    return spark.read.parquet(mine)


def start_ingest_hot(raw_stream: DataFrame, probe: str, root: str, checkpoint_root: str, run_id: str,
                     config_path: str | None = None, config_schema=None, params=None,
                     fixed: dict | None = None, trigger_seconds: float | None = None,
                     available_now: bool = False, ttl_ns: int | None = None) -> StreamingQuery:
    """Start the hot-settings ingest of one probe.  ``config_path`` holds the
    settings log (``from_ns`` + one column per parameter), re-read at every
    micro-batch so that updates written while the query runs take effect."""
    s = get_spec(probe)
    fixed = dict(fixed or {})
    params = [p for p in (params if params is not None else s.filters) if p not in fixed]
    state = state_root(checkpoint_root, probe, run_id)

    def on_batch(batch, batch_id):
        spark = batch.sparkSession
        cfg = None if config_path is None else _pinned(spark, config_path, config_schema, state, batch_id)
        process_batch(batch, batch_id, probe, root, state, run_id, cfg, params, fixed, ttl_ns)

    w = (raw_stream.writeStream.foreachBatch(on_batch)
         .option("checkpointLocation", os.path.join(checkpoint_root, f"{probe}-{run_id}-hot"))
         .queryName(f"hot_{probe}_{run_id.replace('-', '_')}"))
    if available_now:
        w = w.trigger(availableNow=True)
    elif trigger_seconds:
        w = w.trigger(processingTime=f"{trigger_seconds} seconds")
    return w.start()
