"""Mergeable quantile sketches: a histogram with log-linear buckets.

A bucket holds the integers that share their sign, their bit length and the
``SUB_BITS`` bits after the leading one (numbers below ``2 ** (SUB_BITS + 1)``
have one each), so its width is at most ``2 ** -SUB_BITS`` of its values and
there are at most ``2 * 64 * 2 ** SUB_BITS`` buckets a group, however many
rows.  Each bucket keeps its rows' count, least and greatest value and sum.
Two sketches merge by adding up equal buckets: the result is that of one
sketch over all rows, in any order and any number of steps (no random or
order-dependent compaction), so re-run tasks change nothing.

Built by one map-side combined ``groupBy``.  Ranks are exact, only the value
inside the bucket is estimated: a quantile is off by less than ``2 **
-SUB_BITS`` (1/256) of itself; count, least, greatest and average are exact.

Nulls don't take part; a group without values has no row; decimals of up to
22 digits and doubles go by an integer key in the same order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUB_BITS = 8
#: Keys of more than 64 bits lose their last 14 bits in the bucket's number.
WIDE = 1 << 14


def bucket_of(key: Column, wide: bool = False) -> Column:
    """The bucket number of an integer key; rises with the key.

    A logarithm that rounding takes over a power of two gives the same number
    (the last bucket of a bit length and the next length's number before its first are one)."""
    v = F.call_function("div", key, F.lit(WIDE)) if wide else key
    m = F.when(v >= 0, v).otherwise(F.bitwise_not(v))
    shift = F.greatest(F.floor(F.log2(F.greatest(m, F.lit(1)).cast("double"))).cast("int") - SUB_BITS, F.lit(0))
    n = shift.cast("long") * (1 << SUB_BITS) + F.call_function("shiftright", m, shift)
    return F.when(v >= 0, n).otherwise(-n - 1)


def quantile_sketch(df: DataFrame, col: str, keys=()) -> DataFrame:
    """The sketch of ``col``: rows ``keys, bucket, cnt, low, high, total``
    (``low`` and ``high`` as integer keys, ``total`` the sum of the values)."""
    from .quantiles import _FLOATING, _key_type, order_key
    t = df.schema[col].dataType
    key, _ = order_key(df, col)
    wide = _key_type(df, col) != "long"
    value = F.col("_x") if isinstance(t, _FLOATING) else F.col("_x").cast(f"decimal(38,{getattr(t, 'scale', 0)})")
    rows = df.where(F.col(col).isNotNull()).select(*keys, key.alias("_k"), F.col(col).alias("_x"))
    return (rows.groupBy(*keys, bucket_of(F.col("_k"), wide).alias("bucket"))
            .agg(F.count(F.lit(1)).alias("cnt"), F.min("_k").alias("low"), F.max("_k").alias("high"), F.sum(value).alias("total")))


def merge_sketches(sketches: DataFrame, keys=()) -> DataFrame:
    """One sketch per ``keys`` of many (of any number of runs, batches or tables)."""
    total = sketches.schema["total"].dataType
    return (sketches.groupBy(*keys, "bucket")
            .agg(F.sum("cnt").alias("cnt"), F.min("low").alias("low"), F.max("high").alias("high"),
                 F.sum("total").cast(total).alias("total")))


def sketch_quantiles(sketch: DataFrame, value_type: T.DataType, qs, keys=()) -> DataFrame:
    """Per ``keys``: ``n, low, high, total`` and an estimate ``q<i>`` of each quantile.

    The two ranks that a quantile lies between are found by a running count
    over the group's buckets (a bounded number); a rank's value is
    interpolated between the least and the greatest of its bucket."""
    from .quantiles import _value
    by = list(keys)     # without keys one task sorts the one sketch's buckets
    whole, before = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    rows = sketch.select("*", F.sum("cnt").over(whole).alias("_n"), F.coalesce(F.sum("cnt").over(before), F.lit(0)).alias("_below"),
                         _value(F.col("low"), value_type).alias("_lo"), _value(F.col("high"), value_type).alias("_hi"))

    def at(rank):
        step = (F.col("_hi") - F.col("_lo")) * (rank - F.col("_below")) / F.greatest(F.col("cnt") - 1, F.lit(1))
        return F.max(F.when((rank >= F.col("_below")) & (rank < F.col("_below") + F.col("cnt")), F.col("_lo") + step))

    places, ends = [], []
    for i, q in enumerate(qs):
        h = (F.col("_n") - 1).cast("double") * F.lit(q)
        places += [F.max(h).alias(f"_h{i}"), at(F.floor(h)).alias(f"_a{i}"), at(F.ceil(h)).alias(f"_b{i}")]
        ends.append((F.col(f"_a{i}") + (F.col(f"_h{i}") - F.floor(f"_h{i}")) * (F.col(f"_b{i}") - F.col(f"_a{i}"))).alias(f"q{i}"))
    found = rows.groupBy(*keys).agg(F.sum("cnt").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
                                    F.sum("total").alias("total"), *places)
    return found.select(*keys, F.coalesce("n", F.lit(0)).alias("n"), "low", "high", "total", *ends)
