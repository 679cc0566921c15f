"""Exact continuous quantiles (linear interpolation) that scale.

``percentile`` over an ungrouped column keeps a value -> count map that is
merged on a single reducer; with nearly unique nanosecond latencies that map
grows with the data.  Here the order statistics are found by *radix
selection* instead:

1. one aggregate gives ``n``, ``min`` and ``max``;
2. each target rank ``r`` (the floor and ceiling of ``(n-1)*q``) keeps an
   interval ``[lo, hi]`` and the number of rows below it.  A pass splits every
   active interval into at most ``NBUCKETS`` equal buckets and counts rows per
   bucket (a map-side combined ``groupBy``; at most ``NBUCKETS`` rows per
   interval reach the driver, as one Arrow batch), then narrows each interval
   to the bucket that holds its rank.  When a bucket is one value wide the value is found.

Integral columns need ``ceil(log_B(max - min + 1))`` passes over the
(persisted) column, with ``B`` between 4096 and 65536 buckets chosen from the
row count: with 65536, 2 passes for ranges up to 4e9 and 4 for the whole
64-bit range.  Memory per task and on the driver is bounded by ``B``
regardless of the data size or of how skewed the values are.  The result is
``v[lo] + (h - lo) * (v[hi] - v[lo])`` with ``h = (n-1)*q``, the definition
used by SQL ``quantile_cont`` / ``percentile``.
"""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NBUCKETS = 1 << 16          # upper bound of buckets per interval and pass
MIN_BUCKETS = 1 << 12


def buckets_for(n: int) -> int:
    """Histogram width: ~n/100 rounded to a power of two, in [4096, 65536].
    Small inputs get cheap passes, large ones fewer passes over the data."""
    want = max(MIN_BUCKETS, min(NBUCKETS, n // 100))
    return 1 << (want - 1).bit_length()

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATING = (T.FloatType, T.DoubleType)


def _bits(values: np.ndarray) -> np.ndarray:
    """Doubles to integers in the same order (-0.0 as 0.0, NaN above all)."""
    n = (np.where(np.isnan(values), np.nan, values) + 0.0).view(np.int64)
    return n ^ ((n >> 63) & np.int64((1 << 63) - 1))


def _unbits(keys: np.ndarray) -> np.ndarray:
    return (keys ^ ((keys >> 63) & np.int64((1 << 63) - 1))).view(np.float64)


def order_key(df: DataFrame, col: str):
    """An integer column in the order of ``col`` — what the radix passes
    split — and a function that takes such integers back to values.

    Integers are their own key, decimals their unscaled value (64 bits, or a
    decimal without scale for more digits), doubles their bits: no built-in function
    gives those, so an Arrow-batched function does."""
    t, c = df.schema[col].dataType, F.col(col)
    if isinstance(t, _INTEGRAL):
        return c.cast("long"), int
    if isinstance(t, T.DecimalType):
        if t.precision + t.scale + 1 > 38:
            raise ValueError(f"{col}: quantiles of decimals take at most 37 digits, those after the point counted twice")
        plain = c if not t.scale else c * F.lit(Decimal(10 ** t.scale))
        return plain.cast("long" if t.precision <= 18 else f"decimal({t.precision},0)"), lambda k: Decimal(int(k)).scaleb(-t.scale)
    if isinstance(t, _FLOATING):
        @F.pandas_udf("long")
        def key(x: pd.Series) -> pd.Series:
            return pd.Series(_bits(x.to_numpy(np.float64)))

        return F.when(c.isNotNull(), key(c.cast("double"))), lambda k: float(_unbits(np.array([k], np.int64))[0])
    raise TypeError(f"{col}: no quantiles of {t.simpleString()}")


def _number(n: int):
    return F.expr(f"({n})")


def _targets(n: int, qs):
    out = []
    for q in qs:
        h = (n - 1) * q
        lo = math.floor(h)
        hi = math.ceil(h)
        out.append((h, lo, hi))
    return out


def _select_ranks(vals: DataFrame, ranks: set[int], vmin: int, vmax: int,
                  nbuckets: int = NBUCKETS) -> dict[int, int]:
    """Exact values at 0-based ``ranks`` of the integral column ``v``."""
    NB = nbuckets
    state = {r: (vmin, vmax, 0) for r in ranks}   # rank -> (lo, hi, rows below lo)
    found: dict[int, int] = {}
    v = F.col("v")
    while len(found) < len(ranks):
        intervals = sorted({(lo, hi) for r, (lo, hi, _) in state.items() if r not in found})
        exprs, preds, tgt_rows = [], [], []
        widths = {}
        for i, (lo, hi) in enumerate(intervals):
            width = -(-(hi - lo + 1) // NB)
            widths[i] = width
            inside = v.between(_number(lo), _number(hi))
            preds.append(inside)
            # integer division: exact; distances beyond 64 bits as decimals
            v_ = "v" if hi - lo < 1 << 63 else "cast(v AS decimal(38,0))"
            bucket = F.expr(f"({v_} - ({lo})) div {width}") if width > 1 else (v - _number(lo)).cast("long")
            exprs.append(F.when(inside, F.lit(i).cast("long") * NB + bucket))
            for r, (rlo, rhi, below) in state.items():
                if r not in found and (rlo, rhi) == (lo, hi):
                    tgt_rows.append((i, r, below))
        pred = preds[0]
        for p in preds[1:]:
            pred = pred | p
        hist = (vals.where(pred).select(F.explode(F.array_compact(F.array(*exprs))).alias("k"))
                .groupBy("k").count())                       # <= NB rows per interval
        # the bounded histogram comes back as one Arrow batch
        h = hist.toPandas()
        k = h["k"].to_numpy(dtype=np.int64)
        cnt = h["count"].to_numpy(dtype=np.int64)
        for i, r, below in tgt_rows:
            sel = (k // NB) == i
            b = np.sort(k[sel] % NB)
            c = cnt[sel][np.argsort(k[sel] % NB)]
            cum = below + np.cumsum(c)
            j = int(np.searchsorted(cum, r, side="right"))
            if j >= len(b):     # cannot happen when counts are consistent
                raise RuntimeError("rank outside the column's value range")
            lo, hi = intervals[i]
            width = widths[i]
            nlo = lo + int(b[j]) * width
            nhi = min(hi, nlo + width - 1)
            if nlo == nhi:
                found[r] = nlo
            state[r] = (nlo, nhi, int(cum[j] - c[j]))
    return found


SMALL_EXACT_ROWS = 1_000_000


def exact_quantiles(df: DataFrame, col: str, qs, persist: bool = True, stats: dict | None = None,
                    small_rows: int = SMALL_EXACT_ROWS):
    """Exact ``quantile_cont`` values of ``col`` (nulls ignored), plus n.

    Returns ``(n, [value per q])``; values are None when ``n == 0``.
    ``stats`` (a dict) receives ``n, min, max, sum`` of the same pass.
    When the first pass finds at most ``small_rows`` values, the order
    statistics are read from one sorted list of the persisted column (one
    bounded aggregate); above that, radix selection.  ``small_rows=0``
    forces radix.  Both share the interpolation below.
    Decimals and doubles go by a key in the same order (:func:`order_key`).
    """
    qs = list(qs)
    key, back = order_key(df, col)
    of_doubles = isinstance(df.schema[col].dataType, _FLOATING)
    # of doubles the sum isn't the keys'
    vals = df.where(F.col(col).isNotNull()).select(key.alias("v"), *([F.col(col).cast("double").alias("x")] if of_doubles else []))
    if persist:
        vals = vals.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        st = vals.agg(F.count("v").alias("n"), F.min("v").alias("mn"), F.max("v").alias("mx"),
                      (F.sum("x") if of_doubles else F.sum(F.col("v").cast("decimal(38,0)"))).alias("sm")).first()
        n = st["n"]
        if stats is not None and n:
            stats.update(n=n, min=back(st["mn"]), max=back(st["mx"]), sum=st["sm"] if of_doubles else back(st["sm"]))
        if n == 0:
            return 0, [None] * len(qs)
        tg = _targets(n, qs)
        ranks = {lo for _, lo, _ in tg} | {hi for _, _, hi in tg}
        if n <= small_rows:
            srt = F.sort_array(F.collect_list("v"))
            row = vals.agg(srt.alias("a")).select(
                *[F.element_at("a", r + 1).alias(f"r{r}") for r in sorted(ranks)]).first()
            vals_at = {r: row[f"r{r}"] for r in ranks}
        else:
            vals_at = _select_ranks(vals, ranks, int(st["mn"]), int(st["mx"]), buckets_for(n))
    finally:
        if persist:
            vals.unpersist()
    out = []
    for h, lo, hi in tg:
        a, b = back(vals_at[lo]), back(vals_at[hi])
        out.append(float(a) if lo == hi else float(a) + (h - lo) * (float(b) - float(a)))
    return n, out


# --- grouped -------------------------------------------------------------------

SMALL_STATE_ROWS = 200_000
#: Intervals with at most this many rows are read from a sorted list.
LIST_ROWS = 1 << 16
#: A cell is hot above this share of all rows, so there are fewer hot cells than that.
HOT_CELLS = 10_000


def _cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise a result in the shared checkpoint folder named by
    ``spark.checkpoint.dir`` (reliable ``checkpoint()``, survives executor
    loss; never a machine-local folder on a cluster)."""
    from ..session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _join_on(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Join on ``keys`` treating null keys as equal (a null group is a group)."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"_r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])


def _key_type(df: DataFrame, col: str) -> str:
    t = df.schema[col].dataType
    if isinstance(t, T.DecimalType) and t.precision > 18:
        if t.precision > 22:
            raise ValueError(f"{col}: grouped quantiles of decimals take at most 22 digits")
        return f"decimal({t.precision},0)"
    return "long"


def _unscaled(key, t):
    """The value of a key, for integers and decimals."""
    scale = getattr(t, "scale", 0)
    return (key if not scale else key / F.lit(Decimal(10 ** scale))).cast(t)


def _value(key, t):
    """The value of a key as a double."""
    if not isinstance(t, _FLOATING):
        return key.cast("double") / F.lit(10.0 ** t.scale) if getattr(t, "scale", 0) else key.cast("double")

    @F.pandas_udf("double")
    def back(x: pd.Series) -> pd.Series:
        return pd.Series(_unbits(x.fillna(0).to_numpy(np.int64)))

    return F.when(key.isNotNull(), back(key.cast("long")))


def _ranks(n, qs):
    """The ranks that the quantiles of ``n`` values lie between."""
    hs = F.array(*[(n - 1).cast("double") * F.lit(q) for q in qs])
    return F.array_distinct(F.flatten(F.transform(hs, lambda h: F.array(F.floor(h).cast("long"), F.ceil(h).cast("long")))))


def _rows_of(rows: DataFrame, cells: DataFrame, wanted: DataFrame, at, total: int, count: int) -> DataFrame:
    """The rows in the wanted cells, with those cells' columns.

    Up to ``SMALL_STATE_ROWS`` cells are broadcast.  Beyond, cells with more than
    1 / ``HOT_CELLS`` of all rows (so fewer than ``HOT_CELLS``) are broadcast; what
    lies in none of them is joined by shuffle, where no key has more rows than that."""
    if count <= SMALL_STATE_ROWS:
        return _join_on(rows, F.broadcast(wanted), at)
    is_hot = F.col("_cnt") > total // HOT_CELLS + 1
    hot = F.broadcast(cells.where(is_hot).select(*at))
    return (_join_on(rows, F.broadcast(wanted.where(is_hot)), at)
            .unionByName(_join_on(_join_on(rows, hot, at, "left_anti"), wanted.where(~is_hot), at)))


def exact_quantiles_by(df: DataFrame, keys, col: str, qs, nbuckets: int | None = None, list_rows: int = LIST_ROWS) -> DataFrame:
    """Exact ``quantile_cont`` per group, by radix selection per group.

    Returns one row per group: ``keys, n, min, max, sum`` and one ``q<i>``
    column per quantile.

    1. Rows are counted per group and log-linear bucket
       (:func:`.sketches.bucket_of`; map-side combined, so a hot group costs
       its buckets, not its rows), with each bucket's least and greatest value.
       A running count over a group's buckets (a bounded number) finds those
       that hold the wanted ranks; where least and greatest are equal the value is found.
    2. Only the rows of the others go on (:func:`_rows_of`: by broadcast, or by
       a shuffle join without hot keys).  A bucket with at most ``list_rows``
       rows is sorted as one list; a larger one is split into ``nbuckets``
       equal parts, counted like before, and so on.

    Each pass works on the rows of the pass before, kept by ``persist`` (what a
    lost executor held is worked out again); nothing but the result is written."""
    from .sketches import bucket_of
    keys = [keys] if isinstance(keys, str) else list(keys)
    qs = list(qs)
    key, _ = order_key(df, col)
    t, wide = df.schema[col].dataType, _key_type(df, col) != "long"
    of_doubles = isinstance(t, _FLOATING)
    held: list[DataFrame] = []

    def hold(x: DataFrame) -> DataFrame:
        held.append(x.persist(StorageLevel.MEMORY_AND_DISK))
        return held[-1]

    cell = [*keys, "_i", "_b"]          # _i: rows below the parent interval, its number within the group
    counts = [F.count(F.lit(1)).alias("_cnt"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    vals = df.where(F.col(col).isNotNull()).select(*keys, key.alias("_v"), *([F.col(col).cast("double").alias("_x")] if of_doubles else []))
    rows = hold(vals.withColumns({"_i": F.lit(0).cast("long"), "_b": bucket_of(F.col("_v"), wide)}))
    try:
        cells = hold(rows.groupBy(*cell).agg(*counts, (F.sum("_x") if of_doubles else F.sum(F.col("_v").cast("decimal(38,0)"))).alias("_sm")))
        st = cells.groupBy(*keys).agg(F.sum("_cnt").alias("n"), F.min("_lo").alias("mn"), F.max("_hi").alias("mx"), F.sum("_sm").alias("sm"))
        total = cells.agg(F.sum("_cnt")).first()[0] or 0
        nb = nbuckets or buckets_for(total)
        ranked = cells.withColumn("_rs", _ranks(F.sum("_cnt").over(Window.partitionBy(*keys)), qs))
        found = []
        while True:
            below = F.sum("_cnt").over(Window.partitionBy(*keys, "_i").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
            wanted = hold(ranked.withColumn("_below", F.col("_i") + F.coalesce(below, F.lit(0)))
                          .withColumn("_rs", F.expr("filter(_rs, r -> r >= _below AND r < _below + _cnt)"))
                          .where(F.size("_rs") > 0).select(*cell, "_cnt", "_lo", "_hi", "_below", "_rs"))
            found.append(wanted.where(F.col("_lo") == F.col("_hi")).select(*keys, F.explode("_rs").alias("_r"), F.col("_lo").alias("_v")))
            left = wanted.where(F.col("_lo") < F.col("_hi"))
            info = left.agg(F.count(F.lit(1)).alias("n"), F.max("_cnt").alias("most")).first()
            if not info["n"]:
                break
            side = left.select(*cell, F.col("_below"), F.col("_cnt"), F.col("_lo"), F.expr(f"((_hi - _lo) div {nb}) + 1").alias("_w"))
            inside = hold(_rows_of(rows.select(*cell, "_v"), cells, side, cell, total, info["n"]).drop("_i", "_b"))
            lists = (inside.where(F.col("_cnt") <= list_rows).groupBy(*keys, "_below").agg(F.sort_array(F.collect_list("_v")).alias("_a")))
            found.append(_join_on(left.select(*keys, "_below", "_rs"), lists, [*keys, "_below"])
                         .select(*keys, "_below", "_a", F.explode("_rs").alias("_r"))
                         .select(*keys, "_r", F.expr("element_at(_a, cast(_r - _below + 1 AS int))").alias("_v")))
            if info["most"] <= list_rows:
                break
            rows = (inside.where(F.col("_cnt") > list_rows)
                    .select(*keys, "_v", F.col("_below").alias("_i"), F.expr("(_v - _lo) div _w").alias("_b")))
            cells = hold(rows.groupBy(*cell).agg(*counts))
            ranked = _join_on(cells, left.select(*keys, F.col("_below").alias("_i"), "_rs"), [*keys, "_i"])
        values = found[0]
        for f in found[1:]:
            values = values.unionByName(f)
        vals_at = values.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("m"))
        out = _join_on(st, vals_at, keys, "left")
        cols = []
        for i, q in enumerate(qs):
            h = (F.col("n") - 1).cast("double") * F.lit(q)
            lo_r, hi_r = F.floor(h).cast("long"), F.ceil(h).cast("long")
            a, b = (_value(F.element_at("m", r), t) for r in (lo_r, hi_r))
            cols.append(F.when(lo_r == hi_r, a).otherwise(a + (h - lo_r) * (b - a)).alias(f"q{i}"))
        total_of = F.col("sm") if of_doubles else F.col("sm").cast("double") / F.lit(10.0 ** getattr(t, "scale", 0))
        least, most = (_value(F.col(x), t) if of_doubles else _unscaled(F.col(x), t) for x in ("mn", "mx"))
        return _cut_lineage(out.select(*keys, "n", least.alias("min"), most.alias("max"), total_of.alias("sum"), *cols))
    finally:
        for x in held:
            x.unpersist()
