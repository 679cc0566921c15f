"""Latency statistics, exemplar rows, top keys and counts over trace tables.

All operators take any trace table and a column name, so they work on every
probe (``lat`` / ``latency`` / ``duration``).  Counting operators are single
``agg`` passes with ``count_if``; top-k uses ``orderBy().limit()`` which
Spark plans as a per-partition top-k (``TakeOrderedAndProject``), never a
global sort.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import pid_of
from .catalog import require_column
from pyspark import StorageLevel

from .quantiles import _FLOATING, _INTEGRAL, _cut_lineage, _unscaled, _value, exact_quantiles, exact_quantiles_by
from .sketches import quantile_sketch, sketch_quantiles

QUANTILES = (0.50, 0.90, 0.95, 0.99)
QNAMES = ("p50_latency", "p90_latency", "p95_latency", "p99_latency")


def _avg_exact(df: DataFrame, col: str) -> Column:
    """Average in double: the exact (decimal) sum divided by the count; of doubles the plain average."""
    c, t = F.col(col), df.schema[col].dataType
    if isinstance(t, _FLOATING):
        return F.avg(c)
    return F.sum(c.cast(f"decimal(38,{getattr(t, 'scale', 0)})")).cast("double") / F.count(c).cast("double")


def latency_summary(df: DataFrame, latency_col: str, method: str = "auto") -> DataFrame:
    """Count, min, max, avg (3 decimals) and p50/p90/p95/p99 of one column.

    Only non-null rows take part.  ``method``: ``'auto'`` (radix selection,
    or one sorted list when the first pass finds at most 1M values),
    ``'exact'`` (always radix selection, bounded memory), ``'percentile'``
    (Spark's exact aggregate, value map on one reducer) or ``'approx'`` (one
    pass into a mergeable sketch, :mod:`.sketches`: quantiles within 1/256 of themselves,
    the rest exact).
    """
    require_column(df, latency_col)
    c = F.col(latency_col)
    nn = df.where(c.isNotNull())
    base = [F.count(F.lit(1)).alias("total_rows"), F.count(c).alias("non_null_latency_rows"),
            F.min(c).alias("min_latency"), F.max(c).alias("max_latency"),
            F.round(_avg_exact(df, latency_col), 3).alias("avg_latency")]
    if method in ("auto", "exact"):
        # every number comes from the passes over the persisted column; the
        # result is their one-row answer (the input is not scanned again)
        st: dict = {}
        n, vals = exact_quantiles(nn, latency_col, QUANTILES, stats=st,
                                  **({} if method == "auto" else {"small_rows": 0}))
        t = df.schema[latency_col].dataType
        avg = float(st["sum"]) / n if n else None
        cols = [F.lit(n).cast("long").alias("total_rows"), F.lit(n).cast("long").alias("non_null_latency_rows"),
                F.lit(st.get("min")).cast(t).alias("min_latency"), F.lit(st.get("max")).cast(t).alias("max_latency"),
                F.round(F.lit(avg).cast("double"), 3).alias("avg_latency")]
        cols += [F.round(F.lit(v).cast("double"), 3).alias(q) for v, q in zip(vals, QNAMES)]
        return df.sparkSession.range(1).select(*cols)
    if method == "approx":
        return summary_of_sketch(quantile_sketch(df, latency_col), df.schema[latency_col].dataType)
    if method != "percentile":
        raise ValueError(method)
    agg = nn.agg(*base, F.percentile(c, F.array(*[F.lit(q) for q in QUANTILES])).alias("_p"))
    return agg.select(*[F.col(x) for x in ("total_rows", "non_null_latency_rows", "min_latency",
                                             "max_latency", "avg_latency")],
                      *[F.round(F.col("_p")[i], 3).alias(n) for i, n in enumerate(QNAMES)])


def summary_of_sketch(sketch: DataFrame, value_type, keys=()) -> DataFrame:
    """The summary that a :func:`.sketches.quantile_sketch` of a column of ``value_type`` gives."""
    r = sketch_quantiles(sketch, value_type, QUANTILES, keys)
    least, most = (_value(F.col(c), value_type) if isinstance(value_type, _FLOATING) else _unscaled(F.col(c), value_type) for c in ("low", "high"))
    return r.select(*keys, F.col("n").alias("total_rows"), F.col("n").alias("non_null_latency_rows"),
                    least.alias("min_latency"), most.alias("max_latency"),
                    F.round(F.col("total").cast("double") / F.when(F.col("n") > 0, F.col("n")).cast("double"), 3).alias("avg_latency"),
                    *[F.round(F.col(f"q{i}"), 3).alias(n) for i, n in enumerate(QNAMES)])


PERCENTILE_MAX_GROUP = 1_000_000


def _summary_by_sorted_lists(df: DataFrame, latency_col: str, keys) -> DataFrame:
    """Per-group summary from one sorted list per group (only used after a
    check that no group exceeds :data:`PERCENTILE_MAX_GROUP` values); the
    interpolation is the same as the radix path's."""
    c = F.col(latency_col)
    g = df.where(c.isNotNull()).groupBy(*keys).agg(
        F.count(c).alias("n"), F.min(c).alias("min_latency"), F.max(c).alias("max_latency"),
        F.round(_avg_exact(df, latency_col), 3).alias("avg_latency"), F.sort_array(F.collect_list(c)).alias("_a"))
    cols = []
    for q, name in zip(QUANTILES, QNAMES):
        h = (F.col("n") - 1).cast("double") * F.lit(q)
        lo, hi = F.floor(h).cast("long"), F.ceil(h).cast("long")
        a = F.element_at("_a", (lo + 1).cast("int")).cast("double")
        b = F.element_at("_a", (hi + 1).cast("int")).cast("double")
        cols.append(F.round(F.when(lo == hi, a).otherwise(a + (h - lo) * (b - a)), 3).alias(name))
    return g.select(*keys, F.col("n").alias("total_rows"), F.col("n").alias("non_null_latency_rows"),
                    "min_latency", "max_latency", "avg_latency", *cols)


def latency_summary_by(df: DataFrame, latency_col: str, keys, method: str = "auto") -> DataFrame:
    """:func:`latency_summary` per group.

    ``'exact'`` runs the grouped radix selection of
    :func:`exact_quantiles_by`: memory per task is bounded by the histogram
    width however large one group is.  ``'percentile'`` is Spark's exact
    aggregate (a value map per group, merged on one reducer); ``'approx'``
    is one pass into a mergeable sketch per group.  ``'auto'`` (default) counts the largest
    group first and takes one sorted list a group when none exceeds
    :data:`PERCENTILE_MAX_GROUP` rows, the radix path otherwise.
    """
    require_column(df, latency_col)
    keys = [keys] if isinstance(keys, str) else list(keys)
    c = F.col(latency_col)
    if method == "auto":
        # one persisted projection serves the size check and the aggregate
        vals = df.select(*keys, latency_col).where(c.isNotNull()).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            biggest = vals.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
            if biggest > PERCENTILE_MAX_GROUP:
                return latency_summary_by(vals, latency_col, keys, method="exact")
            return _cut_lineage(_summary_by_sorted_lists(vals, latency_col, keys))
        finally:
            vals.unpersist()
    if method == "exact":
        r = exact_quantiles_by(df, keys, latency_col, QUANTILES)
        t = df.schema[latency_col].dataType
        return r.select(*keys, F.col("n").alias("total_rows"), F.col("n").alias("non_null_latency_rows"),
                        F.col("min").cast(t).alias("min_latency"), F.col("max").cast(t).alias("max_latency"),
                        F.round(F.col("sum").cast("double") / F.col("n").cast("double"), 3).alias("avg_latency"),
                        *[F.round(F.col(f"q{i}"), 3).alias(n) for i, n in enumerate(QNAMES)])
    if method == "approx":
        return summary_of_sketch(quantile_sketch(df, latency_col, keys), df.schema[latency_col].dataType, keys)
    p = F.percentile(c, F.array(*[F.lit(q) for q in QUANTILES]))
    agg = (df.where(c.isNotNull()).groupBy(*keys)
           .agg(F.count(F.lit(1)).alias("total_rows"), F.count(c).alias("non_null_latency_rows"),
                F.min(c).alias("min_latency"), F.max(c).alias("max_latency"),
                F.round(_avg_exact(df, latency_col), 3).alias("avg_latency"), p.alias("_p")))
    return agg.select(*keys, "total_rows", "non_null_latency_rows", "min_latency", "max_latency",
                      "avg_latency", *[F.round(F.col("_p")[i], 3).alias(n) for i, n in enumerate(QNAMES)])


def quantile_value(df: DataFrame, latency_col: str, q: float = 0.99, small_rows: int | None = None) -> float | None:
    kw = {} if small_rows is None else {"small_rows": small_rows}
    _, (v,) = exact_quantiles(df, latency_col, [q], **kw)
    return v


def p99_row(df: DataFrame, latency_col: str, q: float = 0.99, tie_cols=None) -> DataFrame:
    """The first row whose latency is at least the q-quantile (smallest
    latency first, then every other column as tie-break).

    The one-row quantile is computed first and enters the plan as a literal,
    so the ``>=`` predicate is pushed to the Parquet scan instead of a
    nested-loop join, and the top-1 is a per-partition ``TakeOrderedAndProject``.
    """
    require_column(df, latency_col)
    v = quantile_value(df, latency_col, q)
    c = F.col(latency_col)
    ties = list(tie_cols) if tie_cols is not None else [x for x in df.columns if x != latency_col]
    if v is None:
        return df.limit(0)
    if isinstance(df.schema[latency_col].dataType, _INTEGRAL):
        # for integers, lat >= v  <=>  lat >= ceil(v): a plain literal bound
        # that Parquet can use (row-group statistics, pushed filter)
        cond = c >= F.lit(math.ceil(v))
    else:
        cond = c >= F.lit(v)
    return df.where(c.isNotNull() & cond).orderBy(c, *ties).limit(1)


def top_keys(df: DataFrame, key: str = "syscall_id", k: int = 10, count_name: str = "cnt") -> DataFrame:
    """Rows per key, largest first (ties by key), first ``k``."""
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias(count_name))
            .orderBy(F.col(count_name).desc(), F.col(key)).limit(k))


def latest(df: DataFrame, n: int = 5, ts_col: str = "time_stamp", cols=("comm", "pid")) -> DataFrame:
    """``ORDER BY ts DESC LIMIT n`` projected to ``cols`` (+ ts), ties broken
    by the projected columns."""
    proj = list(cols) + [ts_col]
    return df.select(*proj).orderBy(F.col(ts_col).desc(), *[F.col(c) for c in cols]).limit(n)


def count_where(df: DataFrame, **predicates: Column) -> DataFrame:
    """One row: ``total`` plus one ``count_if`` per named predicate."""
    return df.agg(F.count(F.lit(1)).alias("total"),
                  *[F.count_if(p).alias(name) for name, p in predicates.items()])


def filter_delta(df: DataFrame, at, ts_col: str = "time_stamp", group: str = "comm") -> DataFrame:
    """Rows per group before and after a parameter change at ``at``."""
    ts = F.col(ts_col)
    return (df.groupBy(group)
            .agg(F.count_if(ts < F.lit(at)).alias("before"), F.count_if(ts >= F.lit(at)).alias("after"))
            .withColumn("increase", F.col("after") - F.col("before")))


def filter_leak(df: DataFrame, pid: int, pid_col: str = "pid", packed: bool = False,
                factor: int = 10) -> DataFrame:
    """Rows of the wanted process vs all others, and the leak flag
    ``others > factor * wanted``."""
    p = pid_of(F.col(pid_col)) if packed else F.col(pid_col)
    return (df.agg(F.count_if(p == F.lit(pid)).alias("target_rows"),
                   F.count_if(p != F.lit(pid)).alias("other_rows"))
            .withColumn("leak", F.col("other_rows") > F.col("target_rows") * factor))


def row_validity(df: DataFrame, pid_col: str = "pid", comm_col: str = "comm",
                 ts_col: str | None = "enter_time_stamp") -> DataFrame:
    """Counts of rows breaking each validity rule over the whole table
    (pid != 0, comm != '', stamp != 0)."""
    aggs = [F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col(pid_col) == 0).alias("zero_pid"),
            F.count_if(F.coalesce(F.col(comm_col), F.lit("")) == "").alias("empty_comm")]
    bad = (F.col(pid_col) == 0) | (F.coalesce(F.col(comm_col), F.lit("")) == "")
    if ts_col:
        aggs.append(F.count_if(F.col(ts_col) == 0).alias("zero_stamp"))
        bad = bad | (F.col(ts_col) == 0)
    aggs.append(F.count_if(bad).alias("invalid_rows"))
    return df.agg(*aggs)


def sample_rows(df: DataFrame, n: int = 5) -> DataFrame:
    """``LIMIT n`` without order (any n rows), as the reference's spot checks."""
    return df.limit(n)


def trigger_vs_written(raw: DataFrame, written: DataFrame, probe_col: str = "probe") -> DataFrame:
    """Program hits (entries + exits) per probe against rows written."""
    hits = raw.groupBy(probe_col).agg(F.count(F.lit(1)).alias("hits"))
    rows = written.groupBy(probe_col).agg(F.count(F.lit(1)).alias("written"))
    return (hits.join(rows, probe_col, "full")
            .select(probe_col, F.coalesce("hits", F.lit(0)).alias("hits"),
                    F.coalesce("written", F.lit(0)).alias("written"))
            .withColumn("written_per_hit",
                        F.round(F.col("written") / F.when(F.col("hits") > 0, F.col("hits")), 6)))
