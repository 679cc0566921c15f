"""PAIR-9: run-time settings with as-of semantics.

A parameter update takes effect from the moment it is made: each event sees
the latest value of each parameter at or before its time.  Updates are
partial: a null leaves the value in force as it is.  Updates of one stamp
apply in the order of ``seq_col`` (if the log has it).  Two plans, chosen by a
size check on the config side, give the same rows:

* **small config** (at most ``max_broadcast_rows`` updates, read once with
  that bound): each parameter is carried forward along the log, and the
  updates become intervals ``[from, to)``.  The log is cut into ranges of
  equally many updates (at most ``RANGES``).  An event finds its range by a
  binary search in the constant, sorted array of the ranges' bounds - one
  projection a step, at most 12, all in one generated stage - and joins the
  range's intervals as a *broadcast equi-join* plus the interval predicate.
  The event side is never shuffled and an event meets at most ``n / RANGES``
  intervals and one more, however the updates bunch up in time.
* **large config**: events and updates are unioned and the settings are
  carried forward with :func:`carry_even` over chunks of equal count, so no
  task holds the whole timeline.

Both return the event rows with one ``_p_<param>`` column per parameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .carry import AUTO_CHUNK_ROWS, carry_even, carry_last, chunk_of

MAX_BROADCAST_ROWS = 200_000
RANGES = 4096
MIN_CHUNK_ROWS = 10_000


def asof_join(events: DataFrame, config: DataFrame, params, ts_col: str = "ts_ns",
              from_col: str = "from_ns", max_broadcast_rows: int = MAX_BROADCAST_ROWS,
              chunk_ns: int | None = None, seq_col: str = "seq") -> DataFrame:
    params = list(params)
    config = config.select(F.col(from_col), (F.col(seq_col) if seq_col in config.columns else F.lit(0)).cast("long").alias("_seq"), *params)
    # the one read of the log: a bounded table, which a broadcast would bring here anyway
    head = config.limit(max_broadcast_rows + 1).toArrow()
    n = head.num_rows
    if n == 0:
        out = events
        for p in params:
            out = out.withColumn(f"_p_{p}", F.lit(None).cast(config.schema[p].dataType))
        return out
    if n <= max_broadcast_rows:
        config = events.sparkSession.createDataFrame(head, config.schema)
        return _broadcast_range_join(events, config, params, ts_col, from_col, n)
    return _union_carry(events, config, params, ts_col, from_col, chunk_ns)


def intervals(config: DataFrame, params, from_col: str, n: int) -> DataFrame:
    """_from, _to and the settings in force there, with the range (``_range``,
    from 0) each stands in.  ``config`` has ``n`` rows, counted: windows over
    all of it are bounded."""
    w = Window.orderBy(from_col, "_seq", *params)
    cfg = config.select(F.col(from_col).alias("_from"), F.lead(from_col).over(w).alias("_to"),
                        *[F.last(p, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(f"_p_{p}") for p in params],
                        F.row_number().over(w).alias("_n"))
    cfg = cfg.where(F.col("_to").isNull() | (F.col("_to") > F.col("_from")))   # of one stamp's updates the last stays
    cfg = cfg.withColumn("_range", F.floor((F.col("_n") - 1) / F.lit(-(-n // RANGES))))
    return cfg.withColumn("_range", F.dense_rank().over(Window.orderBy("_range")) - 1).drop("_n")


def with_place(df: DataFrame, col: str, bounds: list[int], out: str) -> DataFrame:
    """``df`` with ``out``: how many of the ascending ``bounds`` are at or below ``col``, less one (0 at least, also for
    a null).  A binary search: each step is a projection of its own, since the next one uses its result twice."""
    at = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<long>")   # folded to one constant
    step = 1 << max(0, (len(bounds) - 1).bit_length() - 1)
    df = df.withColumn(out, F.lit(0))
    while step and len(bounds) > 1:
        df = df.withColumn(out, F.col(out) + F.when(F.get(at, F.col(out) + step) <= F.col(col), step).otherwise(0))
        step //= 2
    return df


def _broadcast_range_join(events, config, params, ts_col, from_col, n):
    cfg = intervals(config, params, from_col, n)
    # RANGES rows at most.  The last update at or before an event stands in the last range that begins at or before it.
    bounds = [r["b"] for r in cfg.groupBy("_range").agg(F.min("_from").alias("b")).orderBy("_range").collect()]
    ts = F.col(ts_col)
    ev = with_place(events, ts_col, bounds, "_erange")
    cond = ((F.col("_erange") == F.col("_range")) & (ts >= F.col("_from"))
            & (F.col("_to").isNull() | (ts < F.col("_to"))))
    j = ev.join(F.broadcast(cfg), cond, "left")
    return j.drop("_erange", "_range", "_from", "_to")


def _union_carry(events, config, params, ts_col, from_col, chunk_ns):
    # Updates sort before events of the same stamp (an update applies from
    # its own time on).  Events carry no values, so their order among
    # themselves does not change any result.
    ev = events.withColumn("_src", F.lit(1))
    for p in params:
        ev = ev.withColumn(f"_v_{p}", F.lit(None).cast(config.schema[p].dataType))
    cf = config.select(F.col(from_col).alias(ts_col), F.col("_seq"), *[F.col(p).alias(f"_v_{p}") for p in params]) \
               .withColumn("_src", F.lit(0))
    u = ev.withColumn("_seq", F.lit(0).cast("long")).unionByName(cf, allowMissingColumns=True)
    values = {f"_p_{p}": F.col(f"_v_{p}") for p in params}
    order = [ts_col, "_src", "_seq", *[f"_v_{p}" for p in params]]
    if chunk_ns:
        out = carry_last(u, [], order, values, chunk=chunk_of(ts_col, chunk_ns), inclusive=True, keep=F.col("_src") == 1)
    else:
        tasks = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
        total = u.count()
        target = min(AUTO_CHUNK_ROWS, max(MIN_CHUNK_ROWS, total // tasks))
        out = carry_even(u, [], order, values, target, inclusive=True, keep=F.col("_src") == 1, total=total)
    return out.drop("_src", "_seq", *[f"_v_{p}" for p in params])


def apply_config_asof(raw: DataFrame, config: DataFrame, probe: str, params=None, **kw) -> DataFrame:
    """Pair ``raw`` events of ``probe`` with the settings in force at each
    event (see :func:`tracelat.operators.pairing.pair`)."""
    from .pairing import pair
    params = params or [c for c in config.columns if c.startswith("filter_")]
    pair_kw = {k: kw.pop(k) for k in ("effect", "extra_cols", "chunk_ns") if k in kw}
    joined = asof_join(raw, config, params, **kw)
    return pair(joined, probe, params={p: F.col(f"_p_{p}") for p in params}, **pair_kw)
