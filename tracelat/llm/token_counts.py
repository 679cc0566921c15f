"""Token counts by a two-tier lookup in the map tasks; no pre-token is shuffled.

Tier one: token counts of frequent pieces (a word with the space before it), found in a bounded sample of documents,
packed in one string and one array of 16-bit counts and broadcast; their number is bounded too.  Tier two: pieces that
it misses are encoded by the library once a worker and cached there.  The sample decides only how many pieces tier one
answers; every count is the library's.

Nulls and empty texts have no tokens.
"""

from __future__ import annotations

import collections

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelat.llm.base import texts
from tracelat.llm.encode import LIMIT, Cached, Library, Whole, chunks, cut, kept

#: Documents that tier one is drawn from, characters of each that are looked at for it, and its most pieces.
SAMPLE_DOCS, SAMPLE_CHARS, FREQUENT = 2_000, 10_000, 50_000


def frequent_pieces(docs: DataFrame, path: str) -> tuple[str, bytes]:
    """Tier one: frequent pieces, joined by spaces, and their token counts as 16-bit numbers.  The sample is drawn from
    all partitions, about ``SAMPLE_DOCS`` documents."""
    seen, own, n = collections.Counter(), Library(path), docs.count()
    if not own.known or not n:
        return "", b""
    sample = texts(docs) if n <= SAMPLE_DOCS else texts(docs).sample(SAMPLE_DOCS / n, seed=10)
    for row in sample.select(F.substring("text", 1, SAMPLE_CHARS).alias("text")).collect():
        seen.update(p for p in cut(row["text"])[1:] if p and " " not in p)
    pieces = [p for p, n in seen.most_common(FREQUENT) if n > 1 and not any(s in p for s in own.specials)]
    _, counts = own.encode_new([" " + p for p in pieces])
    kept = [i for i, n in enumerate(counts) if n < 65536]
    return " ".join(pieces[i] for i in kept), np.array([counts[i] for i in kept], np.uint16).tobytes()


class Counts(dict):
    """Piece to token count; a piece that tier one lacks is encoded and cached, ``LIMIT`` of them at most."""

    def __init__(self, own, lead: str, known=()):
        super().__init__(known)
        self.own, self.lead, self.known = own, lead, dict(known)

    def __missing__(self, piece: str) -> int:
        if len(self) > len(self.known) + LIMIT:
            self.clear()
            self.update(self.known)
        n = self[piece] = self.own.encode_new([self.lead + piece])[1][0] if piece or self.lead else 0
        return n


def _tiers(path: str, pieces: str, counts: bytes):
    def make():
        library = Library(path)
        if not library.known:
            return Whole(library.tokenizer)
        own = Cached(library.encode_new, library.specials)
        known = dict(zip(pieces.split(" "), np.frombuffer(counts, np.uint16).tolist())) if counts else {}
        return own, Counts(own, ""), Counts(own, " ", known)

    return kept(("tiers", path, hash(pieces)), make)


def count_text(text: str, tiers) -> int:
    own, first, rest = tiers
    if own.split and any(s in text for s in own.specials):
        return sum(1 if part in own.specials else count_text(part, tiers) for part in own.split.split(text))
    if not text:
        return 0
    pieces = cut(text)
    return first[pieces[0]] + sum(map(rest.__getitem__, pieces[1:]))


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens (the library's for the vocabulary file) and over_limit (more than ``limit``)."""
    spark = docs.sparkSession
    tier_one = spark.sparkContext.broadcast(frequent_pieces(docs, path))

    def run(batches):
        tiers = _tiers(path, *tier_one.value)
        for part, text in chunks(batches):
            n = tiers.encode(text)[1] if isinstance(tiers, Whole) else np.array([count_text(t, tiers) for t in text], np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t.encode()) for t in text], pa.int64()), pa.array(n),
                                              pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
