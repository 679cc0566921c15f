"""Trace tables on storage: scan, stream, append, run ids, compaction.

Layout: ``root/probe=<name>/run_id=<run>/batch_id=<batch>/``, plain Parquet
files.  Every writer owns its batch folders: a batch append writes one named
by a random id, a streaming query one per micro-batch (a re-run of the
micro-batch replaces it).  No folder has a sink commit log, so runs written
by appends, by streams and by restarted streams lie side by side and one scan
reads them all; a scan of one probe opens only its folder and a scan of one
run prunes the others.

Compaction writes a run's batches into one new folder and then publishes the
next version of the run's manifest (``root/_manifests/probe=/run_id=/v=``),
which names the compacted folders that count and the batches that they replace.
A reader takes each run's newest version when it is planned and keeps to it:
it lists its files then, and a replaced batch's files stay for ``retention``
seconds after that, so a DataFrame planned before a compaction still reads what it
saw.  :func:`vacuum` (also each compaction) deletes what is older and takes it off
the manifest, so a plan names the replaced batches that are still
there, not those of all compactions ever made.  Every reader sees each row once,
wherever a compaction broke off.
"""

from __future__ import annotations

import time
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.catalog import table_exists
from ..specs import RAW_SCHEMA, spec as get_spec

PART_COLS = ("run_id", "batch_id")
COMPACT = "compact-"
MANIFEST = "run_id string, version long, shown array<string>, retired array<struct<batch:string,at:double>>"
#: Seconds that replaced batches stay for readers planned before.
RETENTION = 7 * 86400.0


def probe_path(root: str, probe: str) -> str:
    return f"{root.rstrip('/')}/probe={probe}"


def run_id_of(started_at: datetime | None = None) -> str:
    """SNK-2: second-resolution stamp that keeps each session's rows apart."""
    t = started_at or datetime.now(timezone.utc)
    return t.strftime("%Y%m%d-%H%M%S")


def batch_path(root: str, probe: str, run_id: str, batch_id: str) -> str:
    return f"{probe_path(root, probe)}/run_id={run_id}/batch_id={batch_id}"


def table_schema(probe: str) -> T.StructType:
    s = get_spec(probe)
    return T.StructType(list(s.schema.fields) + [T.StructField(c, T.StringType()) for c in PART_COLS])


def _fs(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(where).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _listed(spark: SparkSession, where: str) -> list[str]:
    """Names of the folders in ``where``; none if it isn't there."""
    fs, path = _fs(spark, where)
    return [st.getPath().getName() for st in fs.listStatus(path(where)) if st.isDirectory()] if fs.exists(path(where)) else []


def _manifests(spark: SparkSession, root: str, probe: str, run_id: str | None = None) -> list:
    """The newest manifest of each run of a probe that has one."""
    base = f"{root.rstrip('/')}/_manifests/probe={probe}"
    fs, path = _fs(spark, base)
    newest = []
    for run in ([f"run_id={run_id}"] if run_id is not None else _listed(spark, base)):
        done = [int(v[2:]) for v in _listed(spark, f"{base}/{run}") if v.startswith("v=") and fs.exists(path(f"{base}/{run}/{v}/_SUCCESS"))]
        if done:
            newest.append(f"{base}/{run}/v={max(done)}")
    return spark.read.schema(MANIFEST).json(newest).collect() if newest else []


def _publish(spark: SparkSession, root: str, probe: str, run_id: str, version: int, shown, retired) -> None:
    """Write a manifest version; an error if another writer has written it.  Older versions go."""
    base = f"{root.rstrip('/')}/_manifests/probe={probe}/run_id={run_id}"
    spark.createDataFrame([(run_id, version, list(shown), [tuple(r) for r in retired])], MANIFEST).coalesce(1).write.json(f"{base}/v={version}")
    fs, path = _fs(spark, base)
    for v in _listed(spark, base):
        if v.startswith("v=") and int(v[2:]) < version - 1:
            fs.delete(path(f"{base}/{v}"), True)


def _visible(spark: SparkSession, root: str, probe: str, run_id: str | None = None) -> DataFrame:
    """The probe's rows with their partition columns: no unpublished compaction, no replaced batch."""
    if not table_exists(spark, probe_path(root, probe)):
        raise ValueError(f"table does not exist: {probe} under {root}")
    manifests = _manifests(spark, root, probe, run_id)   # before the files are listed: what a later one replaces is still there
    df = spark.read.schema(table_schema(probe)).parquet(probe_path(root, probe))
    if run_id is not None:
        df = df.where(F.col("run_id") == run_id)
    shown = [b for m in manifests for b in m["shown"]]
    gone = [f"{m['run_id']}/{r['batch']}" for m in manifests for r in m["retired"]]
    df = df.where(~F.col("batch_id").startswith(COMPACT) | F.col("batch_id").isin(shown))
    return df.where(~F.concat("run_id", F.lit("/"), "batch_id").isin(gone)) if gone else df


def batch_names(spark: SparkSession, root: str, probe: str, run_id: str | None = None) -> list[tuple[str, str]]:
    """Run and name of the finished batches that count now."""
    base = probe_path(root, probe)
    if not table_exists(spark, base):
        raise ValueError(f"table does not exist: {probe} under {root}")
    fs, path = _fs(spark, base)
    manifests = _manifests(spark, root, probe, run_id)
    shown = {(m["run_id"], b) for m in manifests for b in m["shown"]}
    gone = {(m["run_id"], r["batch"]) for m in manifests for r in m["retired"]}
    out = []
    for run in ([f"run_id={run_id}"] if run_id is not None else _listed(spark, base)):
        for name in _listed(spark, f"{base}/{run}"):
            b = (run.split("=", 1)[1], name.split("=", 1)[1])
            if (b in shown if b[1].startswith(COMPACT) else b not in gone) and fs.exists(path(f"{base}/{run}/{name}/_SUCCESS")):
                out.append(b)
    return sorted(out)


def scan_trace(spark: SparkSession, root: str, probe: str, run_id: str | None = None) -> DataFrame:
    """SRC-1: one probe table with its fixed schema (partition-pruned); an
    error if the table does not exist."""
    return _visible(spark, root, probe, run_id).drop("batch_id").withColumn("probe", F.lit(probe))


def stream_trace(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA,
                 fmt: str = "parquet", max_files_per_trigger: int | None = None,
                 glob: str | None = None) -> DataFrame:
    """SRC-2: raw events arriving as files (any file source format)."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path)


def write_batch(df: DataFrame, root: str, probe: str, run_id: str, batch_id: str) -> None:
    """Write one batch folder; a folder of that name is replaced."""
    df.select(*get_spec(probe).names).write.mode("overwrite").parquet(batch_path(root, probe, run_id, batch_id))


def append_trace(df: DataFrame, root: str, probe: str, run_id: str) -> None:
    """SNK-1: append rows of one probe run (the dataset is created on first write)."""
    write_batch(df, root, probe, run_id, f"append-{uuid.uuid4().hex}")


def drain(query) -> dict:
    """SNK-3/STR-2: flush everything available, then stop; returns the last progress."""
    query.processAllAvailable()
    last = query.lastProgress
    query.stop()
    return last or {}


def compact_run(spark: SparkSession, root: str, probe: str, run_id: str, files: int | None = None,
                file_bytes: int = 256 << 20, retention: float = RETENTION) -> str:
    """SNK-4: rewrite the finished batches of one run into few files.

    Works on any run, also while a stream writes to it (batches that appear
    meanwhile stay as they are).  ``files`` is taken from the bytes read if
    not given.  The new folder counts only from the moment the manifest that
    names it is published, the old ones only until then; they are deleted
    ``retention`` seconds later, by :func:`vacuum` or the next compaction."""
    base = f"{probe_path(root, probe)}/run_id={run_id}"
    fs, path = _fs(spark, base)
    names = [n.split("=", 1)[1] for n in _listed(spark, base) if fs.exists(path(f"{base}/{n}/_SUCCESS"))]
    before = next(iter(_manifests(spark, root, probe, run_id)), None)
    rows = _visible(spark, root, probe, run_id).where(F.col("batch_id").isin(names))
    replaced = [r["batch_id"] for r in rows.select("batch_id").distinct().collect()]
    if not files:
        size = sum(fs.getContentSummary(path(f"{base}/batch_id={b}")).getLength() for b in replaced)
        files = max(1, -(-size // file_bytes))
    new = COMPACT + uuid.uuid4().hex
    write_batch(rows.repartition(files), root, probe, run_id, new)
    shown = [b for b in (before["shown"] if before else []) if b not in replaced]
    now = time.time()
    _publish(spark, root, probe, run_id, (before["version"] if before else 0) + 1, [*shown, new],
             [*(before["retired"] if before else []), *((b, now) for b in replaced)])
    from .sketch_store import pass_on
    pass_on(spark, root, probe, run_id, replaced, new)
    vacuum(spark, root, probe, run_id, retention)
    return f"{base}/batch_id={new}"


def vacuum(spark: SparkSession, root: str, probe: str, run_id: str, retention: float = RETENTION) -> list[str]:
    """Delete a run's batches that were replaced at least ``retention`` seconds
    ago, and take them off the manifest; returns them.  Readers planned before
    they were replaced fail from then on.  The retention must be longer than a
    stream may take to re-run its last micro-batch, which the list hides until then."""
    m = next(iter(_manifests(spark, root, probe, run_id)), None)
    if m is None:
        return []
    old = [r["batch"] for r in m["retired"] if time.time() - r["at"] >= retention]
    fs, path = _fs(spark, root)
    for b in old:
        fs.delete(path(f"{probe_path(root, probe)}/run_id={run_id}/batch_id={b}"), True)
    if old:
        _publish(spark, root, probe, run_id, m["version"] + 1, m["shown"], [r for r in m["retired"] if r["batch"] not in old])
    return old
