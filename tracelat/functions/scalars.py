"""Scalar column expressions (all JVM-side, codegen friendly).

Every function takes and returns a :class:`pyspark.sql.Column` so they
compose inside ``select``/``where`` and stay in whole-stage codegen.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Unsigned 64-bit wrap modulus and 32-bit mask.
TWO_64 = 18446744073709551616
TWO_63 = 9223372036854775808
MASK32 = 0xFFFFFFFF
# Kernel task names are at most 15 bytes plus a terminating NUL.
KERNEL_COMM_MAX = 15

U64_DEC = T.DecimalType(20, 0)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pid_of(pid_tgid) -> Column:
    """Process id (tgid) of a packed ``(tgid << 32) | tid`` value."""
    return F.shiftrightunsigned(_c(pid_tgid), 32)


def tid_of(pid_tgid) -> Column:
    """Thread id: the low 32 bits of a packed value."""
    return _c(pid_tgid).bitwiseAND(F.lit(MASK32))


def ntohl(x) -> Column:
    """Swap the four low bytes of a 32-bit value (network <-> host order)."""
    x = _c(x).cast("long")
    b0 = x.bitwiseAND(F.lit(0xFF))
    b1 = F.shiftright(x, 8).bitwiseAND(F.lit(0xFF))
    b2 = F.shiftright(x, 16).bitwiseAND(F.lit(0xFF))
    b3 = F.shiftright(x, 24).bitwiseAND(F.lit(0xFF))
    return (F.shiftleft(b0, 24).bitwiseOR(F.shiftleft(b1, 16))
            .bitwiseOR(F.shiftleft(b2, 8)).bitwiseOR(b3))


def byte_cap(s, nbytes: int) -> Column:
    """Keep at most ``nbytes`` UTF-8 bytes of a string."""
    s = _c(s)
    return F.when(F.octet_length(s) <= nbytes, s).otherwise(
        F.substring(s.cast("binary"), 1, nbytes).cast("string"))


def cstr(s, buf_len: int, kernel_name: bool = False) -> Column:
    """C string out of a ``char[buf_len]``: cut at the first NUL and keep
    at most ``buf_len - 1`` bytes (the terminator takes the last byte).
    Task names (``kernel_name``) are additionally capped at 15 bytes."""
    cap = buf_len - 1
    if kernel_name:
        cap = min(cap, KERNEL_COMM_MAX)
    cut = F.substring_index(_c(s), "\u0000", 1)
    return byte_cap(cut, cap)


def latency(start, end) -> Column:
    """``end - start`` in ns, 0 when there is no start."""
    start = _c(start)
    return F.when(start.isNotNull() & (start != 0), _c(end) - start).otherwise(F.lit(0).cast("long"))


def as_u64(x) -> Column:
    """Reinterpret a signed 64-bit value as unsigned (``-5`` -> 2^64-5)."""
    d = _c(x).cast(U64_DEC)
    return F.when(_c(x) < 0, (d + F.lit(Decimal(TWO_64))).cast(U64_DEC)).otherwise(d)


def as_s64(x) -> Column:
    """Inverse of :func:`as_u64` for a ``decimal(20,0)`` value."""
    d = _c(x).cast(T.DecimalType(21, 0))
    return F.when(d >= F.lit(Decimal(TWO_63)), d - F.lit(Decimal(TWO_64))).otherwise(d).cast("long")


def to_u32(x) -> Column:
    """Wrap to 32 bits (syscall id parameter)."""
    return _c(x).cast("long").bitwiseAND(F.lit(MASK32))


def fixed_bytes(s, n: int) -> Column:
    """String parameter copied into a ``char[n]``: at most ``n`` bytes."""
    return byte_cap(s, n)


def round3(x) -> Column:
    return F.round(_c(x), 3)


def outcome(ret) -> Column:
    """0 or positive = success, negative = error code."""
    return F.when(_c(ret) < 0, F.lit("error")).otherwise(F.lit("ok"))


def json_report(*cols) -> Column:
    """JSON object of the given columns; null fields are left out."""
    return F.to_json(F.struct(*[_c(c) for c in cols]))


# --- parameter coercion over VARIANT values -------------------------------

_INTEGRAL = ("TINYINT", "SMALLINT", "INT", "BIGINT")


def variant_type(v) -> Column:
    return F.schema_of_variant(_c(v))


def to_uint64(v) -> Column:
    """Numeric parameter coercion: integers as they are, floats truncated,
    negative -> ``NEGATIVE_VALUE``, anything else -> ``UNSUPPORTED_TYPE``.

    ``v`` is a VARIANT (``parse_json`` of the parameter object).  Returns
    ``struct(value decimal(20,0), error string)``.
    """
    v = _c(v)
    t = F.schema_of_variant(v)
    numeric = t.isin(*_INTEGRAL) | t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT")
    num = F.try_variant_get(v, "$", "decimal(38,6)")
    val = F.when(numeric & (num >= 0), F.floor(num).cast(U64_DEC))
    err = (F.when(v.isNull(), F.lit(None))
           .when(~numeric, F.lit("UNSUPPORTED_TYPE"))
           .when(num < 0, F.lit("NEGATIVE_VALUE"))
           .when(num >= F.lit(Decimal(TWO_64)), F.lit("UNSUPPORTED_TYPE")))
    return F.struct(val.alias("value"), err.alias("error"))


def to_fixed_string(v, n: int) -> Column:
    """String parameter coercion: strings cut to ``n`` bytes, other JSON
    types are rejected.  Returns ``struct(value string, error string)``."""
    v = _c(v)
    is_str = F.schema_of_variant(v) == F.lit("STRING")
    val = F.when(is_str, fixed_bytes(F.variant_get(v, "$", "string"), n))
    err = F.when(v.isNull(), F.lit(None)).when(~is_str, F.lit("UNSUPPORTED_TYPE"))
    return F.struct(val.alias("value"), err.alias("error"))
