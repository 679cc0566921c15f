"""SRC-3: decode binary event samples (fixed-layout little-endian records).

Each probe's record layout is a list of ``(column, offset, kind, width)``.
Decoding is pure SQL expressions (no UDF): the record is turned into one hex
string, the digits of each integer field are re-ordered most-significant
first and parsed with ``conv`` (base -10 gives the signed 64-bit value for
``bigint`` columns, base 10 the unsigned one for ``decimal(20,0)``);
``char[N]`` fields are cut at the first NUL.  Records shorter than the layout
are dropped; trailing bytes are ignored.

:func:`encode_rows` is the inverse (used to build samples from tables).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import as_s64
from ..specs import spec as get_spec

# Record layouts (column, byte offset, kind, width) and sizes.
_RW = [("pid", 0, "u", 4), ("lat", 8, "u", 8), ("time_stamp", 16, "u", 8), ("size", 24, "u", 8),
       ("comm", 32, "c", 32), ("file", 64, "c", 16)]
_NFSD_RW = [("pid", 0, "u", 8), ("lat", 8, "u", 8), ("time_stamp", 16, "u", 8), ("size", 24, "u", 8),
            ("offset", 32, "u", 8), ("xid", 40, "u", 4), ("comm", 44, "c", 32)]
_NFSD_META = [("pid", 0, "u", 8), ("lat", 8, "u", 8), ("time_stamp", 16, "u", 8), ("xid", 24, "u", 4),
              ("comm", 28, "c", 32)]
LAYOUTS = {
    "nfs_file_read": (_RW, 80),
    "nfs_file_write": (_RW, 80),
    "nfs_getattr": ([("pid", 0, "u", 8), ("lat", 8, "u", 8), ("time_stamp", 16, "u", 8), ("ret", 24, "s", 8),
                     ("comm", 32, "c", 32), ("file", 64, "c", 16)], 80),
    "nfs_setattr": ([("pid", 0, "u", 8), ("lat", 8, "u", 8), ("time_stamp", 16, "u", 8), ("ret", 24, "s", 8),
                     ("comm", 32, "c", 32)], 64),
    "nfsd4_read": (_NFSD_RW, 80),
    "nfsd4_write": (_NFSD_RW, 80),
    "nfsd4_access": (_NFSD_META, 64),
    "nfsd4_getattr": (_NFSD_META, 64),
    "rpc_task_latency": ([("pid", 0, "u", 4), ("xid", 4, "u", 4), ("proc_name", 8, "c", 16),
                          ("latency", 24, "u", 8), ("start_timestamp", 32, "u", 8), ("status", 40, "s", 4)], 48),
    "svc_rqst_latency": ([("xid", 0, "u", 4), ("latency", 8, "u", 8), ("start_timestamp", 16, "u", 8)], 24),
    "sys_call_trace": ([("pid", 0, "u", 8), ("syscall_id", 8, "u", 4), ("ret", 16, "s", 8),
                        ("duration", 24, "u", 8), ("enter_time_stamp", 32, "u", 8), ("comm", 40, "c", 16)], 56),
    "block_io_latency": ([("pid", 0, "u", 8), ("latency", 8, "u", 8), ("time_stamp", 16, "u", 8),
                          ("comm", 24, "c", 16)], 40),
}


def _hex_le(h: Column, off: int, width: int) -> Column:
    """Most-significant-first hex digits of a little-endian field, cut from
    the record's hex string (two digits per byte)."""
    return F.concat(*[F.substring(h, 2 * (off + i) + 1, 2) for i in reversed(range(width))])


def _field(h: Column, off: int, kind: str, width: int, dtype) -> Column:
    if kind == "c":
        return F.substring_index(F.unhex(F.substring(h, 2 * off + 1, 2 * width)).cast("string"), "\u0000", 1)
    x = _hex_le(h, off, width)
    if width == 8 and dtype.typeName() == "long":
        # 64-bit field stored as bigint: negative base gives the signed
        # (two's complement) value, i.e. the bits are kept
        return F.conv(x, 16, -10).cast("long")
    if width == 8:   # full-range unsigned 64-bit
        return F.conv(x, 16, 10).cast("decimal(20,0)")
    u = F.conv(x, 16, 10).cast("long")
    if kind == "s":
        u = F.when(u >= F.lit(2 ** (8 * width - 1)), u - F.lit(2 ** (8 * width))).otherwise(u)
    return u.cast(dtype)


def decode_samples(df: DataFrame, probe: str, col: str = "sample", engine: str = "arrow") -> DataFrame:
    """Binary records of ``probe`` -> its typed trace table.

    ``engine='arrow'`` (default): ``mapInArrow``; each Arrow batch's binary
    buffer is gathered into an ``(n, size)`` byte matrix with numpy and every
    field is a typed view of its byte columns — vectorised, no per-row
    Python.  ``engine='sql'``: the same decoding as JVM expressions only.
    """
    if engine == "arrow":
        return _decode_arrow(df, probe, col)
    s = get_spec(probe)
    layout, size = LAYOUTS[probe]
    types = dict(s.columns)
    b = F.col(col)
    rec = df.where(F.length(b) >= size).select(F.hex(F.substring(b, 1, size)).alias("_h"))
    h = F.col("_h")
    by_name = {name: _field(h, off, kind, w, types[name]) for name, off, kind, w in layout}
    return rec.select(*[by_name[n].alias(n) for n in s.names])


def _le_bytes(x: Column, width: int) -> Column:
    parts = [F.unhex(F.lpad(F.hex(F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(255))), 2, "0"))
             for i in range(width)]
    return F.concat(*parts)


def _cbytes(s: Column, width: int) -> Column:
    return F.substring(F.rpad(F.coalesce(s, F.lit("")).cast("binary"), width, F.unhex(F.lit("00"))), 1, width)


def encode_rows(df: DataFrame, probe: str, col: str = "sample", engine: str = "arrow") -> DataFrame:
    """Trace rows of ``probe`` -> binary records (inverse of decode).

    ``engine='arrow'``: numpy fills an ``(n, size)`` byte matrix per Arrow
    batch; ``engine='sql'``: JVM expressions only."""
    if engine == "arrow":
        return _encode_arrow(df, probe, col)
    layout, size = LAYOUTS[probe]
    pieces = []
    pos = 0
    for name, off, kind, w in layout:
        if off > pos:
            pieces.append(F.unhex(F.lit("00" * (off - pos))))
        c = F.col(name)
        if kind == "c":
            pieces.append(_cbytes(c, w))
        else:
            v = as_s64(c) if str(df.schema[name].dataType).startswith("Decimal") else c.cast("long")
            pieces.append(_le_bytes(F.coalesce(v, F.lit(0).cast("long")), w))   # null -> zero bytes
        pos = off + w
    if size > pos:
        pieces.append(F.unhex(F.lit("00" * (size - pos))))
    return df.select(F.concat(*pieces).alias(col))


def _arrow_decoder(layout, size, names, types):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            arr = batch.column(0)
            keep = pc.and_(pc.is_valid(arr), pc.greater_equal(pc.binary_length(arr), size))
            arr = arr.filter(keep)
            n = len(arr)
            off_t = np.int64 if pa.types.is_large_binary(arr.type) else np.int32
            offsets = np.frombuffer(arr.buffers()[1], dtype=off_t)[arr.offset:arr.offset + n + 1]
            data = np.frombuffer(arr.buffers()[2], dtype=np.uint8) if n else np.zeros(0, np.uint8)
            recs = data[offsets[:-1, None].astype(np.int64) + np.arange(size)[None, :]] if n \
                else np.zeros((0, size), np.uint8)
            cols = {}
            for name, off, kind, w in layout:
                sub = np.ascontiguousarray(recs[:, off:off + w])
                t = types[name]
                if kind == "c":
                    is_nul = sub == 0
                    length = np.where(is_nul.any(axis=1), is_nul.argmax(axis=1), w).astype(np.int32)
                    flat = sub[np.arange(w)[None, :] < length[:, None]]
                    offs = np.zeros(n + 1, dtype=np.int32)
                    np.cumsum(length, out=offs[1:])
                    cols[name] = pa.StringArray.from_buffers(n, pa.py_buffer(offs), pa.py_buffer(flat.tobytes()))
                    continue
                code = {(8, "u"): "<u8", (8, "s"): "<i8", (4, "u"): "<u4", (4, "s"): "<i4"}[(w, kind)]
                v = sub.view(code).reshape(n)
                if t == "decimal(20,0)":
                    cols[name] = pc.cast(pa.array(v.astype(np.uint64)), pa.decimal128(20, 0))
                elif t == "bigint":
                    cols[name] = pa.array(v.astype(np.uint64).view(np.int64) if w == 8 else v.astype(np.int64))
                else:
                    cols[name] = pa.array(v.astype(np.int32))
            yield pa.RecordBatch.from_arrays([cols[c] for c in names], names=names)
    return run


def _decode_arrow(df: DataFrame, probe: str, col: str) -> DataFrame:
    s = get_spec(probe)
    layout, size = LAYOUTS[probe]
    types = {n: t.simpleString() for n, t in s.columns}
    return df.select(col).mapInArrow(_arrow_decoder(layout, size, s.names, types), s.schema)


def _arrow_encoder(layout, size, col):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            n = batch.num_rows
            recs = np.zeros((n, size), dtype=np.uint8)
            for name, off, kind, w in layout:
                arr = batch.column(name)
                if kind == "c":
                    arr = arr.fill_null("")
                    if n and pc.all(pc.string_is_ascii(arr)).as_py():
                        # one byte per character: cut/pad to w bytes, view as (n, w)
                        fixed = pc.utf8_rpad(pc.utf8_slice_codeunits(arr, 0, w), width=w, padding="\x00")
                        buf = fixed.cast(pa.binary()).buffers()[2]
                        recs[:, off:off + w] = np.frombuffer(buf, dtype=np.uint8)[:n * w].reshape(n, w)
                    else:
                        for i, v in enumerate(arr.to_pylist()):      # non-ASCII: byte-exact cut
                            b = v.encode("utf-8")[:w]
                            recs[i, off:off + len(b)] = np.frombuffer(b, dtype=np.uint8)
                    continue
                if pa.types.is_decimal(arr.type):
                    ints = pc.cast(arr, pa.uint64(), safe=False).fill_null(0).to_numpy(zero_copy_only=False)
                else:
                    ints = arr.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                le = ints.astype("<u8").view(np.uint8).reshape(n, 8)
                recs[:, off:off + w] = le[:, :w]
            offsets = (np.arange(n + 1, dtype=np.int32) * size)
            out = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(recs.tobytes())])
            yield pa.RecordBatch.from_arrays([out], names=[col])
    return run


def _encode_arrow(df: DataFrame, probe: str, col: str) -> DataFrame:
    from pyspark.sql import types as T
    layout, size = LAYOUTS[probe]
    names = [n for n, *_ in layout]
    return df.select(*names).mapInArrow(_arrow_encoder(layout, size, col),
                                        T.StructType([T.StructField(col, T.BinaryType())]))
