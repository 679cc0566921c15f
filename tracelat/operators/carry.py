"""Segmented "last value before this row" per key — the scan behind pairing,
control-log replay and as-of settings.

A plain ``Window.partitionBy(key).orderBy(t)`` puts every row of a key in
one task; a key holding a third of the data would then serialise a third of
the job.  :func:`carry_even` cuts such keys into chunks:

1. keys are counted; those with more than ``target`` rows are heavy.  Fewer
   than ``HEAVY`` keys can be, because ``target`` is at least a ``HEAVY``-th of all
   rows, so what follows for them is broadcast;
2. a mergeable quantile sketch of the order column per heavy key gives bounds
   of equal count, whatever the spread of the stamps (an outlier, a burst).
   Chunks that are still too large (the sketch's precision, many rows of one
   stamp) are cut again, then by the next order column;
3. one exchange by (key, chunk): the value is carried within the chunk, and
   the chunk's last row keeps the chunk's last value.  What is kept is written
   to the shared folder once, and both the rows and the chunks' summary are
   read from there;
4. the summary (one row a chunk of a heavy key) is carried from chunk to chunk
   and fills rows that found nothing inside their own.

Without a heavy key it is the plain window.  :func:`carry_last` has the plain
window, and chunks of a given width of the order column whose summary is
worked out in the same plan; these read their input twice.
All equal the single-window scan exactly.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bound of heavy keys; bounds that one sketch gives a key, and its precision; factor of the target that is still let be.
HEAVY, FANOUT, ACCURACY, SLACK = 200_000, 256, 10_000, 1.5


def carry_last(df: DataFrame, keys, order, values: dict[str, Column],
               chunk: Column | None = None, inclusive: bool = False,
               keep: Column | None = None) -> DataFrame:
    """Add one column per ``values`` entry: the last non-null value of that
    expression among earlier rows of the same key (and the row itself when
    ``inclusive``), in ``order``.  ``order`` must be a total order per key."""
    keys = list(keys)
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    end = Window.currentRow if inclusive else -1
    names = list(values)
    tmp = {n: f"_cv_{n}" for n in names}
    base = df
    for n in names:
        base = base.withColumn(tmp[n], values[n])
    if chunk is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
        out = base
        for n in names:
            out = out.withColumn(n, F.last(tmp[n], ignorenulls=True).over(w))
        if keep is not None:
            out = out.where(keep)
        return out.drop(*tmp.values())

    base, sk = _surrogates(base, keys)
    base = base.withColumn("_chunk", chunk)
    w1 = Window.partitionBy(*sk, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    local = base
    for n in names:
        local = local.withColumn(f"_cl_{n}", F.last(tmp[n], ignorenulls=True).over(w1))

    ordkey = F.struct(*order)
    summary = local.groupBy(*sk, "_chunk").agg(
        *[F.max_by(F.col(tmp[n]), F.when(F.col(tmp[n]).isNotNull(), ordkey)).alias(f"_cs_{n}")
          for n in names])
    w2 = Window.partitionBy(*sk).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *sk, "_chunk", *[F.last(f"_cs_{n}", ignorenulls=True).over(w2).alias(f"_cc_{n}") for n in names])
    kept = local if keep is None else local.where(keep)
    joined = kept.join(carry, sk + ["_chunk"], "left")
    out = joined
    for n in names:
        out = out.withColumn(n, F.coalesce(F.col(f"_cl_{n}"), F.col(f"_cc_{n}")))
    drop = (list(tmp.values()) + [f"_cl_{n}" for n in names] + [f"_cc_{n}" for n in names]
            + sk + ["_chunk"])
    return out.drop(*drop)


def _surrogates(df: DataFrame, keys) -> tuple[DataFrame, list[str]]:
    """Non-null surrogate keys (value or a placeholder, plus a null flag):
    windows, summaries and joins then all use the same hash partitioning (a
    null-safe join would be planned on different key expressions)."""
    sk = []
    for i, k in enumerate(keys):
        dt = df.schema[k].dataType.simpleString()
        placeholder = F.lit("") if dt == "string" else F.lit(0).cast(dt)
        df = df.withColumn(f"_sk{i}", F.coalesce(F.col(k), placeholder)).withColumn(f"_sn{i}", F.col(k).isNull())
        sk += [f"_sk{i}", f"_sn{i}"]
    return df, sk


def _cut(df: DataFrame, group, order, target: int, col: str) -> DataFrame | None:
    """The groups with more than ``SLACK * target`` rows, with the bounds that cut them by ``col`` evenly; None if
    there is none.  Groups in which an order column before ``col`` varies, or ``col`` doesn't, are left."""
    before = order[:order.index(col)]
    stats = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.min(col).cast("long").alias("_lo"), F.max(col).cast("long").alias("_hi"),
                                   *[(F.min(c) != F.max(c)).alias(f"_v{i}") for i, c in enumerate(before)])
    large = stats.where((F.col("_n") > int(SLACK * target)) & (F.col("_lo") < F.col("_hi")))
    for i in range(len(before)):
        large = large.where(~F.col(f"_v{i}"))
    large = large.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_n", "_lo").toArrow()   # fewer than HEAVY rows
    if not large.num_rows:
        return None
    large = df.sparkSession.createDataFrame(large)
    same = [F.col(g) == F.col(f"_g{i}") for i, g in enumerate(group)]
    names = [f"_g{i}" for i in range(len(group))]
    every = [(i + 1) / FANOUT for i in range(FANOUT - 1)]
    # on distances from the group's first value: the sketch works with doubles
    sketch = (df.join(F.broadcast(large), same).groupBy(*names, "_n", "_lo")
              .agg(F.percentile_approx(F.coalesce(F.try_subtract(F.col(col).cast("long"), F.col("_lo")), F.lit((1 << 63) - 1)), every, ACCURACY).alias("_q")))
    parts = F.least(F.ceil(F.col("_n") / F.lit(target)), F.lit(FANOUT)).cast("int")   # of the group
    some = F.filter("_q", lambda _, i: F.floor((i + 1) * parts / FANOUT) > F.floor(i * parts / FANOUT))
    bounds = F.array_remove(F.transform(F.array_sort(F.array_distinct(some)), lambda q: q + F.col("_lo")), F.col("_lo"))
    # mostly one value, the first: then that alone
    bounds = F.when(F.size(bounds) == 0, F.array(F.col("_lo") + 1)).otherwise(bounds)
    return df.sparkSession.createDataFrame(sketch.select(*names, bounds.alias("_bounds")).toArrow())


def even_chunks(df: DataFrame, keys, order, target: int, total: int | None = None) -> DataFrame | None:
    """``df`` with ``_chunk``: 0 for keys of at most about ``target`` rows; heavy keys' rows are cut into chunks of about as
    many, in ``order`` (names of integral columns), numbered from 1 without regard to gaps.  None if no key is heavy.
    ``keys`` have no nulls."""
    total = df.count() if total is None else total
    if total <= target:
        return None
    target, group, cut = max(target, total // HEAVY), list(keys), False
    df = df.withColumn("_chunk", F.lit(0).cast("long"))
    for col in order:
        while (bounds := _cut(df, [*group, "_chunk"], order, target, col)) is not None:
            cut = True
            same = [F.col(g) == F.col(f"_g{i}") for i, g in enumerate([*group, "_chunk"])]
            df = df.join(F.broadcast(bounds), same, "left")
            df = _placed(df, col).withColumn("_chunk", F.col("_chunk") * F.lit(FANOUT + 1) + F.when(F.col("_bounds").isNull(), 0).otherwise(F.col("_at") + 1))
            df = df.drop("_at", "_bounds", *[f"_g{i}" for i in range(len(group) + 1)])
    return df if cut else None


def _placed(df: DataFrame, col: str) -> DataFrame:
    """``df`` with ``_at``: how many of the row's ``_bounds`` are at or below ``col``, by a binary search; each step is a
    projection of its own, since the next one uses its result twice."""
    df, step = df.withColumn("_at", F.lit(0)), FANOUT // 2
    while step:
        df = df.withColumn("_at", F.col("_at") + F.when(F.get("_bounds", F.col("_at") + (step - 1)) <= F.col(col), step).otherwise(0))
        step //= 2
    return df


def carry_even(df: DataFrame, keys, order, values: dict[str, Column], target: int, inclusive: bool = False,
               keep: Column | None = None, total: int | None = None) -> DataFrame:
    """:func:`carry_last` with chunks of heavy keys of about ``target`` rows each, in ``order`` (names of columns; those
    after the first that isn't integral only break ties; ``total``: the rows, if they are counted).  The result is read from a table in the shared folder, unless no
    key is heavy."""
    from ..session import checkpoint_dir

    order = list(order)
    names, columns = list(values), df.columns
    whole = [c for c in order if df.schema[c].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")]
    whole = whole[:next((i for i, c in enumerate(order) if c not in whole), len(order))]
    keyed, sk = _surrogates(df, keys)
    if not sk:
        keyed, sk = keyed.withColumn("_sk0", F.lit(0)), ["_sk0"]
    chunked = even_chunks(keyed, sk, whole, target, total)
    if chunked is None:
        return carry_last(df, keys, order, values, inclusive=inclusive, keep=keep)
    for n in names:
        chunked = chunked.withColumn(f"_cv_{n}", values[n])
    w = Window.partitionBy(*sk, "_chunk").orderBy(*order)
    end = Window.currentRow if inclusive else -1
    chunked = chunked.withColumns({
        **{n: F.last(f"_cv_{n}", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, end)) for n in names},
        **{f"_cs_{n}": F.last(f"_cv_{n}", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) for n in names},
        "_end": F.lead(F.lit(True)).over(w).isNull() & (F.col("_chunk") > 0), "_keep": F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))})
    rows = chunked.where(F.col("_keep") | F.col("_end")).select(
        *[c for c in columns if c not in names], *names, *sk, "_chunk", "_keep", "_end", *[F.when(F.col("_end"), F.col(f"_cs_{n}")).alias(f"_cs_{n}") for n in names])
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tracelat-carry/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    per_key = Window.partitionBy(*sk).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.where("_end").select(*[F.col(k).alias(f"_c{k}") for k in sk], F.col("_chunk").alias("_c_chunk"),
                                      *[F.last(f"_cs_{n}", ignorenulls=True).over(per_key).alias(f"_cc_{n}") for n in names])
    carry = spark.createDataFrame(carry.toArrow(), carry.schema)   # a row for each chunk of a heavy key
    same = [F.col(k) == F.col(f"_c{k}") for k in sk] + [F.col("_chunk") == F.col("_c_chunk")]
    out = rows.where("_keep").join(F.broadcast(carry), same, "left")
    for n in names:
        out = out.withColumn(n, F.coalesce(F.col(n), F.col(f"_cc_{n}")))
    return out.select(*[c for c in columns if c not in names], *names)


def chunk_of(col: str, width: int | None) -> Column | None:
    """``col div width`` (None when chunking is off)."""
    if not width:
        return None
    return F.expr(f"`{col}` div {int(width)}")


AUTO_CHUNK_ROWS = 2_000_000


def auto_chunk_width(df: DataFrame, col: str, rows_per_chunk: int = AUTO_CHUNK_ROWS) -> int | None:
    """Chunk width for :func:`carry_last` from one count/min/max pass.

    ``None`` (a single window level) when the whole input has at most
    ``rows_per_chunk`` rows; otherwise the width that cuts the order
    column's span into ``count / rows_per_chunk`` chunks, so that even a key
    holding every row is split into tasks of about ``rows_per_chunk`` rows
    (for events spread over time)."""
    st = df.agg(F.count(F.lit(1)).alias("n"), F.min(col).alias("mn"), F.max(col).alias("mx")).first()
    n = st["n"]
    if not n or n <= rows_per_chunk or st["mn"] is None:
        return None
    span = int(st["mx"]) - int(st["mn"]) + 1
    return max(1, span * rows_per_chunk // n)
