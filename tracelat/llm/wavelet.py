"""Token ids of a corpus as wavelet matrices, one compressed file for each shard.

Shards follow ascending ids: documents are dealt to ranges of ids and sorted there; each range becomes shards of about
``SHARD`` tokens, cut between documents (one longer document is a shard of its own).  A shard's file holds its
documents' ids and token counts and the matrix: plane k has bit k (from the highest) of every token, the tokens ordered
stably by the planes before.  Counts of ones before each block of 512 bits give rank in constant time and select by
bisection, so one file answers what token stands at a place, how often a token occurs up to a place, and where its
occurrences are, without unpacking all tokens; ``tokens`` unpacks them all.

Files are rows of a Parquet table in the shared folder (Spark commits them, so they survive lost executors and any
store that Spark writes to will do); the file's bytes are one binary value.

Nulls: a null text is empty, a null id comes before all others.  Rows with equal ids follow the order of their texts.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelat.llm.base import partitions, stored, texts
from tracelat.llm.encode import chunks, encoder

SHARD, BLOCK, MAGIC = 1 << 20, 512, b"TWM1"
FILES = "part int, seq int, start long, n_tokens long, n_docs long, file binary"


class WaveletMatrix:
    def __init__(self, n: int, zeros: list[int], planes: list[np.ndarray]):
        self.n, self.zeros, self.planes, self._before = n, zeros, planes, [None] * len(planes)

    @classmethod
    def build(cls, ids: np.ndarray) -> "WaveletMatrix":
        bits = max(1, int(ids.max(initial=0)).bit_length())
        a, zeros, planes = ids.astype(np.uint16 if bits <= 16 else np.uint32), [], []
        for level in range(bits - 1, -1, -1):
            one = (a & a.dtype.type(1 << level)) != 0
            planes.append(np.packbits(one))
            a = np.concatenate([np.compress(~one, a), np.compress(one, a)]) if level else a
            zeros.append(len(ids) - int(np.count_nonzero(one)))
        return cls(len(ids), zeros, planes)

    def tokens(self) -> np.ndarray:
        """All ids in order: values are put together from the last plane to the first."""
        v = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for k in range(len(self.planes) - 1, -1, -1):
            one = np.unpackbits(self.planes[k], count=self.n).view(bool)
            up = np.empty_like(v)
            up[np.flatnonzero(~one)] = v[: self.zeros[k]]
            up[np.flatnonzero(one)] = v[self.zeros[k] :] | v.dtype.type(1 << (len(self.planes) - 1 - k))
            v = up
        return v

    def _ones(self, k: int, i: int) -> int:
        """Ones among the first i bits of plane k."""
        plane = self.planes[k]
        if self._before[k] is None:
            padded = np.concatenate([plane, np.zeros(-len(plane) % (BLOCK // 8), np.uint8)])
            self._before[k] = np.concatenate([[0], np.cumsum(np.bitwise_count(padded).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.int64))])
        block, whole = i // BLOCK, i // 8
        ones = int(self._before[k][block]) + int(np.bitwise_count(plane[block * BLOCK // 8 : whole]).sum())
        return ones + (int(plane[whole]) >> (8 - i % 8)).bit_count() if i % 8 else ones

    def _down(self, k: int, i: int, bit: int) -> int:
        ones = self._ones(k, i)
        return self.zeros[k] + ones if bit else i - ones

    def access(self, i: int) -> int:
        """The token at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(len(self.planes)):
            bit = int(self.planes[k][i // 8]) >> (7 - i % 8) & 1
            value = value << 1 | bit
            i = self._down(k, i, bit)
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where the token's occurrences among the first i places stand below the last plane."""
        if token >> len(self.planes):
            return 0, 0
        low, high = 0, i
        for k in range(len(self.planes)):
            bit = token >> (len(self.planes) - 1 - k) & 1
            low, high = self._down(k, low, bit), self._down(k, high, bit)
        return low, high

    def rank(self, token: int, i: int) -> int:
        """Occurrences of the token before place i."""
        low, high = self._range(token, min(max(i, 0), self.n))
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _up(self, k: int, i: int, bit: int) -> int:
        """The place in plane k of its bit number i (from 0) of the given value: bisection over the counts."""
        self._ones(k, 0)
        before = self._before[k] if bit else np.minimum(np.arange(len(self._before[k])) * BLOCK, self.n) - self._before[k]
        block = int(np.searchsorted(before, i, "right")) - 1
        span = np.unpackbits(self.planes[k][block * BLOCK // 8 : (block + 1) * BLOCK // 8])
        return block * BLOCK + int(np.nonzero(span == bit)[0][i - int(before[block])])

    def select(self, token: int, j: int) -> int:
        """The place of the token's occurrence number j (from 0)."""
        low, high = self._range(token, self.n)
        if not 0 <= j < high - low:
            raise IndexError(j)
        i = low + j
        for k in range(len(self.planes) - 1, -1, -1):
            bit = token >> (len(self.planes) - 1 - k) & 1
            i = self._up(k, i - self.zeros[k] if bit else i, bit)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, j) for j in range(self.count(token))]


def to_file(doc_ids: list, counts: list[int], ids: np.ndarray) -> bytes:
    """A shard's file: its documents' ids (None where null) and token counts, and all their tokens."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    matrix = WaveletMatrix.build(ids)
    null = np.packbits([d is None for d in doc_ids]) if doc_ids else np.empty(0, np.uint8)
    named = np.diff(np.array([d or 0 for d in doc_ids], np.int64), prepend=0)
    parts = [null, named, np.array(counts, np.uint32), np.array(matrix.zeros, np.uint32), *matrix.planes]
    packed = [squeeze(p.tobytes()) for p in parts]
    return MAGIC + struct.pack("<IQQ", len(matrix.planes), len(ids), len(doc_ids)) + b"".join(struct.pack("<I", len(p)) + p for p in packed)


def from_file(raw: bytes) -> tuple[list, np.ndarray, WaveletMatrix]:
    """Ids and token counts of a file's documents, and its matrix."""
    import zstandard

    if raw[:4] != MAGIC:
        raise ValueError("not a token file")
    planes, n, docs = struct.unpack_from("<IQQ", raw, 4)
    at, parts, loose = 24, [], zstandard.ZstdDecompressor().decompress
    for _ in range(4 + planes):
        (size,) = struct.unpack_from("<I", raw, at)
        parts.append(loose(raw[at + 4 : at + 4 + size]))
        at += 4 + size
    null = np.unpackbits(np.frombuffer(parts[0], np.uint8), count=docs)
    named = np.cumsum(np.frombuffer(parts[1], np.int64)).tolist()
    zeros = np.frombuffer(parts[3], np.uint32).tolist()
    matrix = WaveletMatrix(n, zeros, [np.frombuffer(p, np.uint8) for p in parts[4:]])
    return [None if x else d for d, x in zip(named, null)], np.frombuffer(parts[2], np.uint32).astype(np.int64), matrix


def write_shards(docs: DataFrame, path: str, *, closing: int = 0, shard: int = SHARD) -> DataFrame:
    """The corpus as token files (``FILES``), written to the shared folder: each document's ids, then ``closing``.
    start counts the tokens before a shard within its range ``part``; ranges follow ascending ids."""

    def run(batches):
        from pyspark import TaskContext

        own, part = encoder(path), TaskContext.get().partitionId()
        seq = start = size = 0
        names, counts, held = [], [], []

        def full():
            columns = (part, seq, start, size, len(names), to_file(names, counts, np.concatenate(held)))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                                              [c.split()[0] for c in FILES.split(", ")])

        for batch, text in chunks(batches):
            ids, lengths = own.encode(text)
            ends = np.cumsum(lengths)
            ids = np.insert(ids, ends, closing)  # the closing id stands after each document
            ends = ends + np.arange(1, len(ends) + 1)
            for doc, end, n in zip(batch.column(0).to_pylist(), ends.tolist(), (lengths + 1).tolist()):
                if size and size + n > shard:
                    yield full()
                    seq, start, size, names, counts, held = seq + 1, start + size, 0, [], [], []
                names.append(doc)
                counts.append(n)
                held.append(ids[end - n : end])
                size += n
        if names:
            yield full()

    dealt = texts(docs).repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    small = {"compression": "none", "parquet.block.size": str(32 << 20), "parquet.page.size.row.check.min": "1",
             "parquet.page.size.row.check.max": "1", "parquet.enable.dictionary": "false"}  # a row may be large: groups are checked row by row
    return stored(dealt.mapInArrow(run, FILES), "token-files", **small)


def read_shards(files: DataFrame) -> DataFrame:
    """From the files: doc_id, start (tokens of all documents before), n_tokens (with the closing id), ids_crc32."""
    whole = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row a range, as many as shuffle partitions
    before = whole.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    def run(batches):
        for batch in batches:
            for part, start, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                names, counts, matrix = from_file(raw)
                ids, ends = matrix.tokens().astype("<u4"), np.cumsum(counts)
                crc = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(names), pa.int32()), pa.array(names, pa.int64()), pa.array(start + ends - counts),
                                                  pa.array(counts), pa.array(crc, pa.int64())], ["part", "doc_id", "start", "n_tokens", "ids_crc32"])

    rows = files.select("part", "start", "file").mapInArrow(run, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
