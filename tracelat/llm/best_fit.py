"""Packing documents into sequences by vector best-fit.

A document's ids are the library's, and a closing id.  Only longer ones are cut, into pieces of the full length; each
piece of the full length is a sequence of its own.  The others are packed whole, longest first: every sequence has
three capacities - tokens, documents and attention cost (the sum of the pieces' squared lengths) - and a piece goes to
the open sequence that can take it under every one of them and that

* ``rule="residual"``: is left with the smallest weighted norm of its residual capacities, or
* ``rule="dot"``: has the largest weighted dot product of residual capacities and the piece's needs.

Residuals and needs are counted in shares of the capacities.  With none fitting, a sequence is opened.

Texts are read once and only lengths and checksums go on.  Map tasks pack their own pieces, ``GROUP`` at a time, so
nothing is shuffled and no group can be hot; pieces of sequences that stay below ``FULL`` of the tokens are packed once
more, in groups drawn from all tasks, so that few groups end with a sequence partly filled.

Nulls and empty texts are the closing id alone.  Rows that repeat an id are pieces of their own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelat.llm.base import stored, texts
from tracelat.llm.encode import chunks, encoder

TOKENS, CLOSING, GROUP, FULL = 2048, 0, 16_384, 0.98
#: A piece; length 0 < length <= TOKENS.
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECE}, task int, bin long, offset long, fill long"


def best_fit(lengths: np.ndarray, *, tokens: int = TOKENS, docs: int | None = None, cost: int | None = None,
             weights: tuple[float, float, float] = (1.0, 0.25, 0.5), rule: str = "residual") -> tuple[np.ndarray, np.ndarray]:
    """The sequence (from 0) and the offset of each piece."""
    docs, cost = docs or tokens, cost or tokens * tokens
    capacity = np.array([tokens, docs, cost], float)
    weight = np.array(weights)
    if len(lengths) and (lengths.max() > tokens or int(lengths.max()) ** 2 > cost):
        raise ValueError("a piece is longer than a sequence may be")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    least = int(lengths.min()) if len(lengths) else 0
    room = np.empty((len(lengths) + 1, 3))  # of open sequences
    name = np.empty(len(lengths) + 1, np.int64)
    made = is_open = 0
    for i in order:
        n = int(lengths[i])
        need = np.array([n, 1, n * n], float)
        best = -1
        if is_open:
            left = room[:is_open] - need
            fits = left.min(axis=1) >= 0
            if fits.any():
                if rule == "residual":
                    score = ((left / capacity) ** 2) @ -weight
                else:
                    score = (room[:is_open] / capacity * (need / capacity)) @ weight
                best = int(np.argmax(np.where(fits, score, -np.inf)))
        if best < 0:
            best, name[is_open], room[is_open] = is_open, made, capacity
            is_open += 1
            made += 1
        bins[i], offsets[i] = name[best], tokens - room[best, 0]
        room[best] -= need
        if room[best, 0] < least or room[best, 1] < 1 or room[best, 2] < least * least:  # closed: the last open one takes its row
            is_open -= 1
            room[best], name[best] = room[is_open], name[is_open]
    return bins, offsets


def pieces(docs: DataFrame, path: str, *, tokens: int = TOKENS, closing: int = CLOSING) -> DataFrame:
    """The pieces of each row's ids (``PIECE``)."""
    return texts(docs).mapInArrow(_cutting(path, tokens, closing), PIECE)


def _cutting(path: str, tokens: int, closing: int):
    def run(batches):
        own = encoder(path)
        for part, text in chunks(batches):
            yield _cut(part.column(0).to_pylist(), *own.encode(text), tokens, closing)

    return run


def _cut(doc_ids: list, ids: np.ndarray, counts: np.ndarray, tokens: int, closing: int) -> pa.RecordBatch:
    rows = []
    for doc, own in zip(doc_ids, np.split(ids, np.cumsum(counts)[:-1])):
        own = np.append(own, closing).astype("<u4")
        rows += [(doc, k, at, min(tokens, len(own) - at), zlib.crc32(own[at : at + tokens].tobytes())) for k, at in enumerate(range(0, len(own), tokens))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                                      ["doc_id", "piece", "start", "length", "ids_crc32"])


def _packing(limits: dict):
    """A map function that packs the rows it gets, ``GROUP`` at a time; bins are numbered within the task."""

    def pack(rows: list[pa.RecordBatch], made: int):
        from pyspark import TaskContext

        table = pa.Table.from_batches(rows).select([c.split()[0] for c in PIECE.split(", ")])
        lengths = table["length"].to_numpy()
        bins, offsets = best_fit(lengths, **limits)
        fill = np.bincount(bins, lengths)[bins].astype(np.int64)
        out = table.append_column("task", pa.array(np.full(len(bins), TaskContext.get().partitionId(), np.int32)))
        out = out.append_column("bin", pa.array(bins + made)).append_column("offset", pa.array(offsets)).append_column("fill", pa.array(fill))
        return out.to_batches(), made + int(bins.max()) + 1

    def run(batches):
        rows, n, made = [], 0, 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, GROUP - n)
                batch = batch.slice(part.num_rows)
                rows.append(part)
                n += part.num_rows
                if n == GROUP:
                    out, made = pack(rows, made)
                    yield from out
                    rows, n = [], 0
        if n:
            yield from pack(rows, made)[0]

    return run


def pack(docs: DataFrame, path: str, *, tokens: int = TOKENS, closing: int = CLOSING, full: float = FULL, **limits) -> DataFrame:
    """Each piece (``PIECE``), its sequence_id and its offset there; ``limits`` are those of ``best_fit``."""
    limits = {"tokens": tokens, **limits}
    cut, packing = _cutting(path, tokens, closing), _packing(limits)
    first = stored(texts(docs).mapInArrow(lambda batches: packing(cut(batches)), PACKED), "packed")
    done = first.filter(F.col("fill") >= full * tokens)
    columns = [c.split()[0] for c in PIECE.split(", ")]
    rest = first.filter(F.col("fill") < full * tokens).select(*columns)
    groups = -(-rest.count() // GROUP) or 1
    last = stored(rest.repartition(groups).mapInArrow(packing, PACKED), "repacked")  # dealt evenly, by no key
    number = lambda second: (F.col("bin") * 2 + second) * (1 << 24) + F.col("task")  # noqa: E731  tasks are fewer than 2 ** 24
    return (done.select(*columns, number(0).alias("sequence_id"), "offset")
            .unionByName(last.select(*columns, number(1).alias("sequence_id"), "offset")))
