"""Quality rules: word and line measures of each document, and cross-document line frequency.

Lines are normalised (lower case, runs of digits to one 0, white space runs to one space, ends stripped) and hashed to
64 bits.  For each host (``source``) the distinct documents that hold a line are counted; exact copies of one text
count as one document, so a document isn't lost because it was fetched often.  A line in more than ``MAX_DOCS`` documents
of its host and more than ``MAX_SHARE`` of them is boilerplate: of a host of 100 or of 10 000 documents that is a line in 11
or more, of a host of ten million one in more than 10 000, where a short natural line is on many pages by chance.  It stays in
the document with the smallest id on that host and is removed from all others.  A document of which fewer than ``MIN_WORDS`` words, or
less than ``MIN_LEFT`` of its words, remain is depleted and rejected; so is one that fails the base rules.

The text is read once, in map tasks; only hashes of lines move.  Counts are pre-aggregated before the shuffle.  In the
join back to lines fewer than ``HEAVY`` lines can each be more than a ``HEAVY``-th of all rows with such lines: these are broadcast,
however many rows have them, so no key of the shuffled join is hot.

Nulls: a null text is empty (no words: it fails the base rules), a null host is a host of its own.  A document without
an id loses no lines; only the base rules judge it.  Rows that repeat an id are judged each by its own text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelat.llm.base import stored, texts
from tracelat.llm.encode import chunks, forget

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
MAX_DOCS, MAX_SHARE, MIN_LEFT, HEAVY = 10, 0.001, 0.2, 100_000
SYMBOLS = b"#*$%&|<>"

_DIGITS, _BLANK = re.compile(r"[0-9]+"), re.compile(r"[\x20\x09-\x0D]+")
PROFILE = ("doc_id long, host string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
           "n_repeat_words long, lines array<struct<i:int,hash:long,words:int>>")


def line_hash(line: str) -> int:
    import xxhash

    plain = _BLANK.sub(" ", _DIGITS.sub("0", line.lower())).strip(" ")
    return xxhash.xxh3_64_intdigest(plain.encode()) - (1 << 63)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of ``WINDOW`` words found twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(number) == len(words):
        return 0
    span = 1
    while span < WINDOW:  # windows of twice the length get numbers from pairs of numbers
        _, ids = np.unique(ids[:-span] * (len(words) + 1) + ids[span:], return_inverse=True)
        span *= 2
    again = np.bincount(ids)[ids] > 1
    if not again.any():
        return 0
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.nonzero(again)[0]
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(cover)[:-1]))


def text_hash(raw: bytes) -> int:
    """Spark's ``xxhash64`` of a string column."""
    import xxhash

    n = xxhash.xxh64_intdigest(raw, 42)
    return n - (n >> 63 << 64)


def measure(text: str) -> tuple:
    """text_hash, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the lines with words."""
    raw = text.encode()
    words, seen, lines, dup = raw.split(), set(), [], 0  # bytes.split() cuts at space, tab to carriage return
    for i, line in enumerate(text.split("\n")):
        n = len(line.encode().split())
        if n:
            dup += line in seen
            seen.add(line)
            lines.append({"i": i, "hash": line_hash(line), "words": n})
    chars = len(text) - sum(map(raw.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    return (text_hash(raw), len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), dup,
            repeated_words(words), lines)


def profile(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row for each document row: measures and hashed lines (``PROFILE``)."""
    names = [c.split()[0] for c in PROFILE.split(", ")]
    types = [pa.int64(), *[pa.int64()] * 6, pa.list_(pa.struct([("i", pa.int32()), ("hash", pa.int64()), ("words", pa.int32())]))]

    def run(batches):
        forget()
        for part, text in chunks(batches):
            columns = list(zip(*map(measure, text)))
            arrays = [pa.array(c, t) for c, t in zip(columns, types[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *arrays], names)

    return texts(docs, F.col(host_col).cast("string").alias("host"), id_col=id_col, text_col=text_col).mapInArrow(run, PROFILE)


def frequent_lines(profiles: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """host, hash, first (the smallest id that holds the line there), n_docs and n_rows of lines above the limits."""
    rows = profiles.select("host", "doc_id", "text_hash", F.explode(F.array_distinct("lines.hash")).alias("hash"))
    once = rows.groupBy("host", "hash", "text_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    lines = once.groupBy("host", "hash").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first"), F.sum("n").alias("n_rows")).filter(F.col("n_docs") > max_docs)
    hosts = (profiles.select("host", "text_hash").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
             .withColumnRenamed("host", "h"))
    return (lines.join(hosts, F.col("host").eqNullSafe(F.col("h")))
            .filter(F.col("n_docs") > max_share * F.col("host_docs")).select("host", "hash", "first", "n_docs", "n_rows"))


def removed_lines(profiles: DataFrame, frequent: DataFrame) -> DataFrame:
    """doc_id, text_hash, removed (indexes of its lines to remove) and removed_words, of documents that lose lines."""
    rows = profiles.select("host", "doc_id", "text_hash", F.explode("lines").alias("line")).select("host", "doc_id", "text_hash", "line.*")
    frequent = stored(frequent, "frequent-lines")
    every = frequent.agg(F.sum("n_rows")).first()[0] or 0
    known = frequent.select(F.col("host").alias("h"), F.col("hash").alias("k"), "first", (F.col("n_rows") * HEAVY > every).alias("heavy"))
    same = F.col("host").eqNullSafe(F.col("h")) & (F.col("hash") == F.col("k"))
    heavy = F.broadcast(known.filter("heavy"))  # fewer than HEAVY lines
    hit = rows.join(heavy, same).unionByName(rows.join(heavy, same, "left_anti").join(known.filter(~F.col("heavy")), same))
    hit = hit.filter(F.col("doc_id") != F.col("first"))
    gone = hit.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("i", "words"))).alias("gone"))
    words = F.aggregate("gone", F.lit(0).cast("long"), lambda n, line: n + line["words"])
    return gone.select("doc_id", "text_hash", F.col("gone.i").alias("removed"), words.alias("removed_words"))


def judge(docs: DataFrame, *, host_col: str = "source", max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE,
          min_left: float = MIN_LEFT) -> DataFrame:
    """For each row: the base measures, base_failed, kept, and removed and removed_words (lines above the limits)."""
    profiles = stored(profile(docs, host_col=host_col), "profiles")
    gone = removed_lines(profiles, frequent_lines(profiles, max_docs, max_share))
    rows = profiles.drop("lines", "host").join(gone, ["doc_id", "text_hash"], "left").fillna(0, ["removed_words"])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    depleted = (F.col("removed_words") > 0) & ((left < MIN_WORDS) | (left < min_left * F.col("n_words")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                       (~failed & ~depleted).alias("kept"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
                       "removed_words", "text_hash")


def without_lines(text, removed):
    """The text without the lines of the given indexes."""
    lines = F.split(text, "\n", -1)
    return F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(removed, i)), "\n")


def clean(docs: DataFrame, *, host_col: str = "source", **limits) -> DataFrame:
    """The columns of ``docs``: kept documents, their text without lines above the limits, ``n_chars`` (if there)
    set anew where lines went.  Only the ids and line indexes of documents that lose lines or go are joined."""
    verdict = judge(docs, host_col=host_col, **limits)
    acts = verdict.filter(~F.col("kept") | (F.size("removed") > 0)).groupBy(F.col("doc_id").alias("__lf_id"), F.col("text_hash").alias("__lf_hash"))
    acts = stored(acts.agg(F.max("kept").alias("__lf_kept"), F.first("removed").alias("__lf_removed")), "line-verdicts")
    text = F.coalesce("text", F.lit(""))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__lf_id")) & (F.xxhash64(text) == F.col("__lf_hash"))
    rows = docs.join(acts, same, "left").filter(F.coalesce("__lf_kept", F.lit(True)))
    loses = F.size("__lf_removed") > 0
    out = rows.withColumn("text", F.when(loses, without_lines(text, F.col("__lf_removed"))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(loses, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
