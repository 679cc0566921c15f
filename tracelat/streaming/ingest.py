"""STR-1..3: continuous ingest, one independent streaming query per probe.

``start_ingest`` runs every micro-batch as batch jobs (``hot_config.py``,
settings fixed): filters, pairing with the entries still pending from earlier
batches, one folder of the probe's table per batch, its own checkpoint - so
several probes run side by side, stop independently, and no Python runs per
key.  ``stop_ingest`` drains (``processAllAvailable``) before stopping; a
restart uses a new ``run_id``, whose rows lie beside the earlier runs'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.catalog import table_exists
from ..sources.traces import drain
from .hot_config import PROGRESS, start_ingest_hot, state_root


def start_ingest(raw_stream: DataFrame, probe: str, root: str, checkpoint_root: str, run_id: str,
                 params: dict | None = None, trigger_seconds: float | None = None,
                 ttl_ms: int | None = None, available_now: bool = False) -> StreamingQuery:
    """``ttl_ms``: pending entries that much older than a batch's newest event
    are given up, which bounds the pending table."""
    return start_ingest_hot(raw_stream, probe, root, checkpoint_root, run_id, params=[], fixed=params,
                            trigger_seconds=trigger_seconds, available_now=available_now,
                            ttl_ns=ttl_ms * 1_000_000 if ttl_ms else None)


def stop_ingest(query: StreamingQuery) -> dict:
    return drain(query)


def flush(query: StreamingQuery) -> None:
    """SNK-3: write everything that has arrived, keep the query running."""
    query.processAllAvailable()


def flush_all(queries) -> dict:
    """SNK-3: flush every running ingest query; returns the first error per
    query name (the others still get flushed)."""
    errors = {}
    for q in queries:
        try:
            q.processAllAvailable()
        except Exception as e:  # report per query, go on with the rest
            errors[q.name] = str(e)
    return errors


def ingest_progress(spark: SparkSession, checkpoint_root: str, probe: str, run_id: str,
                    query: StreamingQuery | None = None) -> dict:
    """STR-3: batches, rows in, rows written and the program's hits (entries
    and exits) of a run from its first batch on (from the run's progress table,
    one row per batch), and the query's last error."""
    path = f"{state_root(checkpoint_root, probe, run_id)}/progress"
    sums = ("rows_in", "rows_written", "entries", "exits")
    done = {"batches": 0, **dict.fromkeys(sums, 0)}
    if table_exists(spark, path):
        rows = spark.read.schema(PROGRESS).parquet(path)
        done = rows.agg(F.count(F.lit(1)).alias("batches"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums]).first().asDict()
    exc = None if query is None else query.exception()
    return {"name": probe, **done, "last_error": None if exc is None else str(exc)}
