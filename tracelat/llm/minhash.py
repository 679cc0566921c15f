"""MinHash near-duplicates by tensored banding, confirmed on full sets.

A document's set: its distinct shingles of ``width`` words (lower-cased in A-Z); with fewer words, the whole sequence as
one; without words, empty and linked with nothing.  Documents are linked if 100 * intersection >= ``percent`` * union.

1. Documents with equal sets are one class; the smallest id stands for it.
2. Two collections of ``SIDE`` half-keys each, of ``ROWS`` minhashes a half-key.  Table (i, j) is keyed by half-key i of
   the first and j of the second collection: SIDE * SIDE tables of 2 * ROWS minhashes from only 2 * SIDE * ROWS of them.
   Two sets share a table if they agree on some half-key of either collection; at a similarity of 0.8 that fails once
   in about 600 times (less than once in 10 000 at 0.85).
3. Of each bucket the class with the smallest id is the pivot; its pairs with the others are verified on full sets and
   the verified links give components.
4. In buckets that still hold several components, every pair of members from different components is tried too, so no
   link between colliding sets is lost.  Such pairs meet on half-keys in a join whose condition compares their sets, as
   31 bits of each hash, so only pairs that may be close enough leave it, and they are verified on full sets.  Of hashes
   that two sets share, no more can coincide in these bits than coincide within either set: that number is added to the
   intersection, so no pair is lost, however large the sets are.
5. Components of all links: every id gets the smallest one that is reachable.

Nothing is capped.  Half-keys and sets come from map tasks; buckets and pairs are joins that adaptive execution splits.
A null text is empty; rows without an id get null ids back.  Rows that repeat an id share its component; where their
sets differ and none of them has a smaller id, links of the set with the smallest hash count.  Tables of steps that
are done are deleted.
"""

from __future__ import annotations

import contextlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelat.llm.base import scratch, stored, texts
from tracelat.llm.encode import chunks, forget

SIDE, ROWS = 10, 3
#: Words of a shingle, and the similarity in percent.
WIDTH, PERCENT = 5, 80
#: Words whose hashes a task keeps (about 30 MB).
WORDS = 200_000
SKETCH = "doc_id long, n_shingles long, set_hash binary, a array<long>, b array<long>"


class Hashes(dict):
    """Word to its 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(text: str, width: int = WIDTH, hashes: Hashes | None = None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles."""
    words = text.encode().lower().split()  # bytes: lower() changes A-Z only, split() cuts at space, tab to carriage return
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map((Hashes() if hashes is None else hashes).__getitem__, words), np.uint64, len(words))
    n, width = max(1, len(h) - width + 1), min(width, len(h))
    every = _mixed(h[:n])
    for k in range(1, width):
        every = _mixed(every + h[k : k + n])
    return np.unique(every)


def _multipliers() -> np.ndarray:
    """Odd multipliers, one for each minhash function."""
    return _mixed(np.arange(1, 2 * SIDE * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def half_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Half-keys of non-empty sets: one row a set and one column a half-key, for both collections."""
    starts = np.cumsum([0, *map(len, sets[:-1])])
    every = np.concatenate(sets)
    lows = np.empty((len(sets), 2 * SIDE * ROWS), np.uint64)
    for k, m in enumerate(_multipliers()):
        x = every * m
        x ^= x >> np.uint64(32)
        lows[:, k] = np.minimum.reduceat(x * m, starts)
    keys = np.zeros((len(sets), 2 * SIDE), np.uint64)
    for r in range(ROWS):
        keys = _mixed(keys + lows[:, r :: ROWS] + np.uint64(r))
    return keys[:, :SIDE], keys[:, SIDE:]


def sketch(docs: DataFrame, *, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document row (``SKETCH``); without words both key arrays and the set's hash are empty."""
    import hashlib

    def run(batches):
        forget()
        hashes = Hashes()
        for part, text in chunks(batches):
            sets = [shingle_hashes(t, width, hashes) for t in text]
            full = [i for i, s in enumerate(sets) if len(s)]
            a, b = [[]] * len(sets), [[]] * len(sets)
            if full:
                for i, x, y in zip(full, *(k.view(np.int64).tolist() for k in map(np.ascontiguousarray, half_keys([sets[i] for i in full])))):
                    a[i], b[i] = x, y
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else b"" for s in sets]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, sets), pa.int64()), pa.array(digest, pa.binary()), pa.array(a, pa.list_(pa.int64())),
                                              pa.array(b, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_hash", "a", "b"])

    return texts(docs, id_col=id_col, text_col=text_col).mapInArrow(run, SKETCH)


def full_sets(docs: DataFrame, *, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, set_hash and shingles (sorted array of long)."""
    import hashlib

    def run(batches):
        forget()
        hashes = Hashes()
        for part, text in chunks(batches):
            sets = [shingle_hashes(t, width, hashes) for t in text]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else b"" for s in sets], pa.binary()),
                                              pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["doc_id", "set_hash", "shingles"])

    return texts(docs, id_col=id_col, text_col=text_col).mapInArrow(run, "doc_id long, set_hash binary, shingles array<long>")


def classes(sketches: DataFrame) -> DataFrame:
    """One row for each distinct non-empty set: rep (smallest id), set_hash, n, a, b."""
    rows = sketches.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    reps = rows.groupBy("set_hash").agg(F.min("doc_id").alias("rep")).groupBy("rep").agg(F.min("set_hash").alias("set_hash"))
    own = rows.join(reps.withColumnRenamed("set_hash", "s"), (F.col("doc_id") == F.col("rep")) & (F.col("set_hash") == F.col("s")))
    return own.groupBy("rep", "set_hash").agg(F.first("n_shingles").alias("n"), F.first("a").alias("a"), F.first("b").alias("b"))


def table_rows(reps: DataFrame) -> DataFrame:
    """key, rep, n: a row for each class and table."""
    halves = reps.select("rep", F.col("n").cast("int").alias("n"), F.posexplode("a").alias("i", "x"), "b")
    return halves.select("rep", "n", "i", "x", F.posexplode("b").alias("j", "y")).select(F.xxhash64("i", "x", "j", "y").alias("key"), "rep", "n")


def _could_link(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def linked(inter: Column, union: Column, percent: int) -> Column:
    return 100 * inter >= percent * union


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of the pairs (u, v) whose full sets are similar enough."""
    left = sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("su"))
    right = sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("sv"))
    both = pairs.join(left, "u").join(right, "v")
    inter = F.size(F.array_intersect("su", "sv"))
    return both.filter(linked(inter, F.size("su") + F.size("sv") - inter, percent)).select("u", "v")


def components(edges: DataFrame) -> DataFrame:
    """id and component (its smallest id) of every node of the edges (u, v): each node's neighbours are tied to the
    smallest of them, larger and smaller neighbours in turn, until nothing changes.  Edges are written each time."""
    def shape(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    spark = edges.sparkSession
    with contextlib.ExitStack() as before:
        before.enter_context(scratch(spark))
        edges = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        now = shape(edges)
        while True:
            last = before.pop_all()
            before.enter_context(scratch(spark))
            # larger neighbours of u go to u's smallest neighbour (or u)
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
            large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
            # then u and its smaller neighbours go to the smallest of them
            low = large.groupBy("u").agg(F.min("v").alias("low"))
            small = large.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.select("u", F.col("low").alias("v")))
            edges = stored(small.filter("u <> v").distinct(), "edges")
            last.close()
            was, now = now, shape(edges)
            if now == was:
                low = edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
                return stored(low.unionByName(low.select(F.col("component").alias("id"), "component").distinct()), "components", keep=True)


def links(docs: DataFrame, sketches: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Verified links (u, v) between classes that span each component (see the steps above)."""
    reps = stored(classes(sketches), "classes")
    rows = table_rows(reps)
    buckets = rows.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("rep", "n")).alias("p")).filter("size > 1")
    members = stored(rows.join(buckets.select("key", F.col("p.rep").alias("pivot"), F.col("p.n").alias("pivot_n")), "key"), "members")
    met = members.select(F.col("rep").alias("doc_id")).distinct().join(reps.select(F.col("rep").alias("doc_id"), "set_hash"), "doc_id")
    some = docs.join(stored(met.select(F.col("doc_id").alias("__mh_id")), "met"), F.col("doc_id") == F.col("__mh_id"), "left_semi")
    sets = stored(full_sets(some, width=width).join(met, ["doc_id", "set_hash"], "left_semi").groupBy("doc_id").agg(F.first("shingles").alias("shingles")), "sets")

    first = members.filter((F.col("rep") != F.col("pivot")) & _could_link(F.col("n"), F.col("pivot_n"), percent)).select(F.col("rep").alias("u"), F.col("pivot").alias("v")).distinct()
    found = stored(verified(first, sets, percent), "links")
    part = components(found)

    # buckets that still hold several components
    labelled = members.join(part.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    labelled = stored(labelled.select("key", "rep", "n", "pivot", "component"), "labelled")
    mixed = labelled.groupBy("key", "component").count().groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("count", "component")).alias("m"))
    mixed = labelled.join(mixed.filter("parts > 1").select("key", F.col("m.component").alias("main")), "key")  # main: the largest component
    # of two members from different components one at least is outside the bucket's main component
    there = mixed.groupBy("rep", "n", "component").agg(F.max(F.col("component") != F.col("main")).alias("outside"))
    short = sets.select(F.col("doc_id").alias("rep"), F.array_distinct(F.transform("shingles", lambda s: s.bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))).alias("short"))
    there = there.join(reps.select("rep", "a", F.transform("b", lambda y, j: F.xxhash64(j, y)).alias("b")), "rep").join(short, "rep")
    there = there.withColumn("alike", F.col("n") - F.size("short"))  # of its hashes, those that coincide with another in 31 bits
    halves = stored(there.select("rep", "n", "alike", "component", "outside", "b", "short", F.posexplode("a").alias("i", "half")), "halves")
    x = halves.filter("outside").select("i", "half", *[F.col(c).alias(f"x_{c}") for c in ("rep", "n", "alike", "component", "b", "short")])
    once = ~F.col("outside") | (F.col("rep") < F.col("x_rep"))
    most = F.size(F.array_intersect("short", "x_short")) + F.least("alike", "x_alike")  # that the sets can share
    close = linked(most, F.col("n") + F.col("x_n") - most, percent)
    rest = x.join(halves, ["i", "half"]).filter((F.col("component") != F.col("x_component")) & once & _could_link(F.col("n"), F.col("x_n"), percent)
                                                & F.arrays_overlap("b", "x_b") & close)
    rest = rest.select(F.greatest("rep", "x_rep").alias("u"), F.least("rep", "x_rep").alias("v")).distinct()
    return found.unionByName(verified(rest, sets, percent))


def near_duplicates(docs: DataFrame, *, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """For each row: doc_id, n_shingles, component_id (smallest id that is reachable by links, itself included),
    kept (whether that is its own) and class_id (smallest id with an equal set)."""
    sketches = stored(sketch(docs, width=width), "sketches")
    with scratch(docs.sparkSession):
        every = stored(links(docs, sketches, width, percent), "all-links", keep=True)
    part = components(every)
    reps = sketches.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).groupBy("set_hash").agg(F.min("doc_id").alias("class_id"))
    reps = reps.join(part.withColumnRenamed("id", "class_id"), "class_id", "left").select("set_hash", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    rows = sketches.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_hash")).alias("set_hash")).join(reps, "set_hash", "left")
    own = F.coalesce("component_id", "doc_id")
    return rows.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"),
                       F.coalesce("class_id", "doc_id").alias("class_id"))


def deduplicate(docs: DataFrame, *, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The columns of ``docs``: of each component the document with the smallest id; documents without words or id stay.
    Rows that repeat an id stay once for each of its texts: of those with one text the first by the other columns."""
    groups = near_duplicates(docs, width=width, percent=percent)
    gone = stored(groups.filter(~F.col("kept")).select(F.col("doc_id").alias("__mh_id")).distinct(), "gone")
    rows = docs.join(gone, F.col("doc_id") == F.col("__mh_id"), "left_anti")
    again = groups.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").count().filter("count > 1")
    if not again.limit(1).count():
        return rows
    again = stored(again.select(F.col("doc_id").alias("__mh_id")), "repeated")
    same = F.col("doc_id") == F.col("__mh_id")
    others = [c for c, kind in docs.dtypes if c not in ("doc_id", "text") and "map<" not in kind and "variant" not in kind]
    # pre-aggregated, so an id that very many rows repeat isn't one task's work
    one = rows.join(again, same, "left_semi").groupBy(F.col("doc_id").alias("__mh_id"), F.col("text").alias("__mh_text")).agg(
        F.min_by(F.struct(*docs.columns), F.struct(*others, F.lit(0))).alias("__mh_row"))
    return rows.join(again, same, "left_anti").unionByName(one.select("__mh_row.*"))
