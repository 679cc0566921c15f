"""Quantile sketches of trace tables, stored per batch and merged without reading rows.

``root/_sketches/probe=<name>/part=<id>/`` holds the sketches
(:mod:`..operators.sketches`) of the batches that one call of
:func:`store_sketches` found without one: it reads their latency column once.
Summaries of a run, of all runs or per run then merge those (at most some
thousands of rows a batch, however large the batch is).  A part counts from its
``_SUCCESS`` marker on; of two parts with the same batch (two writers at once)
the one whose name comes first counts.  After ``MAX_PARTS`` parts the sketches of
all batches that count are written as one full part; from then on only the newest full part
and younger ones are read, and what is older goes ``retention`` seconds later.  Batches without a sketch yet are read,
so a summary always covers exactly the rows that :func:`.traces.scan_trace`
returns at that moment.  A compaction passes on the sketches of the
batches that it replaces, merged, if all of them have one.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sketches import merge_sketches, quantile_sketch
from ..operators.stats import summary_of_sketch
from ..specs import spec as get_spec
from .traces import PART_COLS, RETENTION, _fs, _listed, _visible, batch_names


def _folder(root: str, probe: str) -> str:
    return f"{root.rstrip('/')}/_sketches/probe={probe}"


#: Parts beside the newest full one before they are merged.
MAX_PARTS = 16


def _write(rows: DataFrame, root: str, probe: str, kind: str = "some") -> None:
    rows.write.parquet(f"{_folder(root, probe)}/part={kind}-{int(time.time() * 1000):014d}-{uuid.uuid4().hex}")


def _parts(spark: SparkSession, root: str, probe: str) -> tuple[list[str], list[str]]:
    """Folders of the parts that count (the newest full one first, if any), and of finished ones before that."""
    base = _folder(root, probe)
    fs, path = _fs(spark, base)
    age = lambda p: p.split("-", 1)[1]
    done = sorted((p for p in _listed(spark, base) if fs.exists(path(f"{base}/{p}/_SUCCESS"))), key=age)
    full = max((i for i, p in enumerate(done) if p.startswith("part=full-")), default=0)
    return done[full:], done[:full]


def _stored(spark: SparkSession, root: str, probe: str) -> DataFrame | None:
    """The stored sketches; each batch once."""
    base, (parts, _) = _folder(root, probe), _parts(spark, root, probe)
    if not parts:
        return None
    rows = spark.read.option("basePath", base).parquet(*[f"{base}/{p}" for p in parts])
    first = rows.groupBy(*PART_COLS).agg(F.min("part").alias("part"))
    return rows.join(first, [*PART_COLS, "part"]).drop("part")


def merge_parts(spark: SparkSession, root: str, probe: str, retention: float = RETENTION) -> list[str]:
    """Write the sketches of all batches that count as one full part; delete (and return) the parts before a full one
    that is at least ``retention`` seconds old.  Summaries planned on those fail from then on."""
    stored, have, _ = _split(spark, root, probe, None)
    if have:
        _write(_of(stored, have), root, probe, "full")
    base, (parts, before) = _folder(root, probe), _parts(spark, root, probe)
    fs, path = _fs(spark, base)
    stamps = [int(p.split("-")[1]) for p in [*before, *parts[:1]] if p.startswith("part=full-") and time.time() * 1000 - int(p.split("-")[1]) >= retention * 1000]
    old = [p for p in before if stamps and int(p.split("-")[1]) < max(stamps)]
    for p in old:
        fs.delete(path(f"{base}/{p}"), True)
    return old


def _sketch_rows(rows: DataFrame, probe: str) -> DataFrame:
    return quantile_sketch(rows, get_spec(probe).latency_col, PART_COLS)


def _split(spark: SparkSession, root: str, probe: str, run_id: str | None):
    """The stored sketches, and the visible batches that have one and that have none."""
    stored, batches = _stored(spark, root, probe), batch_names(spark, root, probe, run_id)
    have = {(r.run_id, r.batch_id) for r in stored.select(*PART_COLS).distinct().collect()} if stored is not None else set()
    return stored, [b for b in batches if b in have], [b for b in batches if b not in have]


def _of(rows: DataFrame, batches) -> DataFrame:
    """The rows of the batches (their folders' names are partition values: others aren't opened)."""
    return rows.where(F.concat("run_id", F.lit("/"), "batch_id").isin([f"{r}/{b}" for r, b in batches]))


def store_sketches(spark: SparkSession, root: str, probe: str, run_id: str | None = None) -> int:
    """Sketch the finished batches that have no sketch; returns how many there were."""
    _, _, missing = _split(spark, root, probe, run_id)
    if missing:
        _write(_sketch_rows(_of(_visible(spark, root, probe, run_id), missing), probe), root, probe)
        if len(_parts(spark, root, probe)[0]) > MAX_PARTS:
            merge_parts(spark, root, probe)
    return len(missing)


def pass_on(spark: SparkSession, root: str, probe: str, run_id: str, replaced, new: str) -> bool:
    """Store the merged sketches of ``replaced`` batches for the batch that replaces them, if all have one."""
    stored = _stored(spark, root, probe)
    if stored is None:
        return False
    mine = _of(stored, [(run_id, b) for b in replaced])
    if not replaced or mine.select("batch_id").distinct().count() < len(replaced):
        return False
    _write(merge_sketches(mine.withColumn("batch_id", F.lit(new)), PART_COLS).select(stored.columns).coalesce(1), root, probe)
    return True


def stored_summary(spark: SparkSession, root: str, probe: str, run_id: str | None = None, by_run: bool = False) -> DataFrame:
    """AGG-5 approximate over runs: the latency summary of a run, of all runs
    together or (``by_run``) of each, from the stored sketches; an error if the
    table doesn't exist.  Columns as in :func:`..operators.stats.latency_summary`."""
    rows = _visible(spark, root, probe, run_id)
    stored, kept, missing = _split(spark, root, probe, run_id)
    sketch = _sketch_rows(_of(rows, missing), probe)
    if kept:
        sketch = _of(stored, kept).unionByName(sketch) if missing else _of(stored, kept)
    keys = ["run_id"] if by_run else []
    return summary_of_sketch(merge_sketches(sketch, keys), get_spec(probe).schema[get_spec(probe).latency_col].dataType, keys)
