"""SimHash fingerprints and the search for all fingerprints within a Hamming radius.

Terms are a text's 2-word shingles (words lower-cased; with one word, that word), each weighted by how often it occurs.
Every term's 128-bit hash votes on every bit: for it if the bit is set, against it if not; a fingerprint has the bits
that most of the weight voted for.  A text without words has the fingerprint 0.  Votes are sums of long columns of two
32-bit counters each, so one pass of a hash aggregation adds up all bits, for texts of any length.

Search: the bits are cut into blocks, and block i has a radius r_i, with the sum of all r_i + 1 at radius + 1.  Two
fingerprints at most ``radius`` bits apart are at most r_i bits apart in some block i: else they would differ in more.
So the table of block i is keyed by that block's bits, and a query looks under every key within r_i bits of its own
(multi-probe).  The join's condition checks the distance and lets a pair pass in the first block that can show it, so
only results leave the join, each once.  The search is exact for every radius.  Equal fingerprints are one row of the
tables, with the number of their documents and the smallest id of them, their representative.

The radius comes from a similarity (``radius_for``): texts of that Jaccard similarity of 2-word shingles are expected
at most so many bits apart, ``SPREAD`` standard deviations included.

A null text is empty.  Rows that repeat an id with its text are one document; rows with one id (or none) and different
texts are documents of their own.  A document without an id has no next one.
"""

from __future__ import annotations

import functools
import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelat.llm.base import SPACES, partitions, stored, texts

BITS, RADIUS = 128, 3
#: Near copies are texts of this similarity or more; standard deviations that the radius has beyond the expected distance.
SIMILARITY, SPREAD = 0.8, 2.0
#: A fingerprint is hot from this fraction of the asked rows on.
HOT_CLASSES = 1_000
#: Bit 0 and bit 32: the two counters of a vote column.
PAIR = (1 << 32) + 1
LOW = (1 << 32) - 1


def terms(text: Column) -> Column:
    """The hashes (long) of all shingles of a text, in order; null without words."""
    words = F.filter(F.split(F.lower(text), f"[{SPACES}]+"), lambda w: w != "")
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), F.slice(words, 2, F.size(words)),
                       lambda a, b: F.xxhash64(a, b))  # with one word its partner is null
    return F.when(F.size(words) > 0, pairs)


def fingerprints(rows: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys``, and the fingerprint of the text as two longs, fp0 (bits 0 to 63) and fp1; one row for each key."""
    votes = rows.select(*keys, F.explode_outer(terms(F.col(text_col))).alias("__h0")).withColumn(
        "__h1", F.when(F.col("__h0").isNotNull(), F.xxhash64(F.lit(BITS), "__h0")))
    sums = [F.sum(F.shiftrightunsigned(f"__h{w}", g).bitwiseAND(F.lit(PAIR))).alias(f"__v{w}_{g}") for w in (0, 1) for g in range(32)]
    counted = votes.groupBy(*keys).agg(F.count("__h0").alias("__n"), *sums)

    def word(w: int) -> Column:
        bits = []
        for g in range(32):
            total = F.col(f"__v{w}_{g}")
            bits.append(F.when(2 * total.bitwiseAND(F.lit(LOW)) > F.col("__n"), F.lit(1 << g)).otherwise(F.lit(0).cast("long")))
            bits.append(F.when(2 * F.shiftrightunsigned(total, 32) > F.col("__n"), F.lit((1 << g + 32) - (g == 31) * (1 << 64))).otherwise(F.lit(0).cast("long")))
        return functools.reduce(lambda a, b: a.bitwiseOR(b), bits)

    return counted.select(*keys, word(0).alias("fp0"), word(1).alias("fp1"))


def told(fp0: Column, fp1: Column) -> Column:
    """A fingerprint as 32 hexadecimal digits, the highest bit first."""
    return F.lower(F.concat(F.lpad(F.hex(fp1), 16, "0"), F.lpad(F.hex(fp0), 16, "0")))


def distance(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.bit_count(a0.bitwiseXOR(b0)) + F.bit_count(a1.bitwiseXOR(b1))


def likeness(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """The share of bits that agree."""
    return 1 - distance(a0, a1, b0, b1) / F.lit(float(BITS))


def radius_for(similarity: float = SIMILARITY, spread: float = SPREAD) -> int:
    """Bits that texts of a Jaccard similarity may be apart: with shingles of equal weight their cosine is 2 j / (1 + j),
    a bit differs with a probability of angle / pi, and ``spread`` standard deviations are added."""
    differs = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return math.ceil(BITS * differs + spread * math.sqrt(BITS * differs * (1 - differs)))


def block_radii(radius: int) -> list[int]:
    """The radius of each block (-1: no table); wide blocks for small radii, where few probes do."""
    if not 0 <= radius < BITS:
        raise ValueError("the radius must be from 0 to 127")
    blocks = 4 if radius < 8 else 8
    each, more = divmod(radius + 1, blocks)
    return [each + (i < more) - 1 for i in range(blocks)]


def _block(fp0: Column, fp1: Column, i: int, size: int) -> Column:
    return F.shiftrightunsigned((fp0, fp1)[i * size // 64], i * size % 64).bitwiseAND(F.lit((1 << size) - 1))


def _ball(size: int, radius: int) -> Column:
    """All numbers of ``size`` bits with at most ``radius`` of them set, as an array of long."""
    masks = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in itertools.combinations(range(size), k)]
    return F.split(F.lit(",".join(map(str, masks))), ",").cast("array<long>")  # a constant


def table_keys(fp0: Column, fp1: Column, radii: list[int], probes: bool = False) -> Column:
    """A fingerprint's key in each block table, as an array of long (the block's number above its bits); with
    ``probes``, all keys within the blocks' radii."""
    size = BITS // len(radii)
    balls = {r: _ball(size, r if probes else 0) for r in radii}
    own = [(F.lit(i << size) + _block(fp0, fp1, i, size), r) for i, r in enumerate(radii) if r >= 0]
    return F.flatten(F.array(*[F.transform(balls[r], key.bitwiseXOR) for key, r in own]))


def within(queries: DataFrame, all_rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct fingerprints of ``queries`` (fp0, fp1) with every distinct fingerprint of ``all_rows`` (doc_id, fp0,
    fp1) within the radius: fp0, fp1, other0, other1, distance, n (rows of ``all_rows`` that have it) and id (the
    smallest of these rows)."""
    radii = block_radii(radius)
    size = BITS // len(radii)
    asked = queries.select("fp0", "fp1").distinct()
    there = all_rows.groupBy(F.col("fp0").alias("other0"), F.col("fp1").alias("other1")).agg(F.count("*").alias("n"), F.min("doc_id").alias("id"))
    left = asked.select("fp0", "fp1", F.explode(table_keys(F.col("fp0"), F.col("fp1"), radii, True)).alias("key"))
    right = there.select("other0", "other1", "n", "id", F.explode(table_keys(F.col("other0"), F.col("other1"), radii)).alias("key"))
    apart = distance(F.col("fp0"), F.col("fp1"), F.col("other0"), F.col("other1"))
    x0, x1 = F.col("fp0").bitwiseXOR(F.col("other0")), F.col("fp1").bitwiseXOR(F.col("other1"))
    first = F
    for i, r in enumerate(radii):
        if r >= 0:
            first = first.when(F.bit_count(_block(x0, x1, i, size)) <= r, F.lit(i).cast("long"))
    # merged, never broadcast: a query's thousands of probes aren't in the estimated size
    met = left.withColumnRenamed("key", "probe").hint("merge").join(right, (F.col("probe") == F.col("key")) & (apart <= radius) & (first == F.shiftright("key", size)))
    return met.select("fp0", "fp1", "other0", "other1", apart.alias("distance"), "n", "id")


def followers(ids: DataFrame) -> DataFrame:
    """doc_id and next_id: the next smaller id, or after the smallest the largest.  Ids are dealt to ranges; each
    range's first id looks to the range before, in a table of one row a range."""
    spark = ids.sparkSession
    # a written table: the ranges must not be drawn anew
    ranged = stored(ids.filter(F.col("doc_id").isNotNull()).select("doc_id").distinct().repartitionByRange(partitions(spark), "doc_id")
                    .withColumn("part", F.spark_partition_id()), "ranges")
    ends = ranged.groupBy("part").agg(F.max("doc_id").alias("last"))
    w = Window.orderBy("part")
    ends = ends.select("part", F.coalesce(F.lag("last").over(w), F.max("last").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    rows = ranged.withColumn("next_id", F.lag("doc_id").over(Window.partitionBy("part").orderBy("doc_id")))
    return rows.join(F.broadcast(ends), "part").select("doc_id", F.coalesce("next_id", "before").alias("next_id"))  # one row a range


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_chars, next_id and edited: the text with its last third (rounded down) replaced by as many
    characters from the start of the next document's text.  Texts move once; then only those starts."""
    rows = texts(docs)
    named = rows.filter("doc_id IS NOT NULL")
    lengths = stored(named.select("doc_id", F.char_length("text").alias("n")), "lengths")
    nexts = followers(lengths)
    third = F.floor(F.col("n") / 3).cast("int")
    # who needs how many characters of a document's start; of rows that repeat an id, as many as the longest needs
    needs = lengths.groupBy("doc_id").agg(F.max(third).alias("k")).join(nexts, "doc_id").select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("asks"), "k")
    # both joins read one exchange of the texts
    starts = named.join(needs, "doc_id").select(F.col("asks").alias("doc_id"), F.expr("substring(text, 1, k)").alias("start"), F.col("doc_id").alias("next_id"))
    if lengths.groupBy("doc_id").count().filter("count > 1").limit(1).count():  # ids are repeated: the smallest text counts
        named, rows = named.distinct(), rows.distinct()
        starts = starts.groupBy("doc_id", "next_id").agg(F.min("start").alias("start"))
    both = named.join(starts, "doc_id")
    alone = rows.filter("doc_id IS NULL").select("doc_id", "text", F.lit("").alias("start"), F.lit(None).cast("long").alias("next_id"))
    both = both.select("doc_id", "text", "start", "next_id").unionByName(alone).withColumn("n_chars", F.char_length("text"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    new = F.concat(F.expr("substring(text, 1, n_chars - floor(n_chars / 3))"), F.substr("start", F.lit(1), cut))
    return both.select("doc_id", "text", F.col("n_chars").cast("long").alias("n_chars"), "next_id", new.alias("edited"))


def attached(rows: DataFrame, near: DataFrame, asked: DataFrame) -> DataFrame:
    """``rows`` with n_near and near_ids of their fingerprints, where these were asked for; null elsewhere.

    A fingerprint that more than 1 / ``HOT_CLASSES`` of the asked rows share (so there are fewer such ones than that: they are
    broadcast) is dealt to as many parts as it has such shares of rows, and its ids are repeated for each: less
    than once for every row that they go to.  Rows that weren't asked for are dealt by their own hash."""
    share = asked.count() // HOT_CLASSES + 1
    hot = asked.groupBy(F.col("fp0").alias("h0"), F.col("fp1").alias("h1")).count().filter(F.col("count") > share)
    hot = F.broadcast(stored(hot.select("h0", "h1", F.ceil(F.col("count") / share).cast("int").alias("parts")), "hot-fingerprints"))
    mine = rows.join(hot, (F.col("fp0") == F.col("h0")) & (F.col("fp1") == F.col("h1")), "left")
    spread = F.xxhash64("doc_id", "own")
    mine = mine.withColumn("part", F.when(F.col("asked"), F.pmod(spread, F.coalesce("parts", F.lit(1)))).otherwise(spread)).drop("h0", "h1", "parts")
    ids = near.join(hot, (F.col("q0") == F.col("h0")) & (F.col("q1") == F.col("h1")), "left")
    ids = ids.select("q0", "q1", "n_near", "near_ids", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)).cast("long") - 1)).alias("q_part"))
    # merged, never broadcast: lists of ids shrink much in a shuffle's files, whose size adaptive execution goes by
    return mine.join(ids.hint("merge"), (F.col("fp0") == F.col("q0")) & (F.col("fp1") == F.col("q1")) & (F.col("part") == F.col("q_part")) & F.col("asked"), "left")


def report(docs: DataFrame, query: Column | None = None, radius: int = RADIUS) -> DataFrame:
    """For each document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (the
    likeness to the edited text and to the next document) and, for rows that ``query`` chooses (all by default),
    n_near (documents other than itself within ``radius`` bits of its fingerprint) and near_ids (of each fingerprint
    there, its own included, the smallest id, if that isn't its own id; ascending)."""
    # texts that differ only where they are edited have equal edited texts, so the text's own hash is a key too
    keys = ["doc_id", "next_id", "n_chars", "sha", "own", "which"]
    rows = edited(docs).select("doc_id", "next_id", "n_chars", F.unhex(F.sha2("edited", 256)).alias("sha"), F.unhex(F.md5("text")).alias("own"),
                               F.explode(F.array(F.struct(F.lit(0).alias("which"), "text"), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")))).alias("t"))
    rows = rows.select("doc_id", "next_id", "n_chars", "sha", "own", "t.which", "t.text")
    votes = fingerprints(rows, keys)
    side = lambda c, which: F.max(F.when(F.col("which") == which, F.col(c)))
    own = votes.groupBy(*keys[:-1]).agg(side("fp0", 0).alias("fp0"), side("fp1", 0).alias("fp1"), side("fp0", 1).alias("e0"), side("fp1", 1).alias("e1"))
    own = stored(own, "fingerprints")
    after = own.groupBy(F.col("doc_id").alias("next_id")).agg(F.min(F.struct("fp0", "fp1")).alias("a"))
    own = own.withColumn("asked", F.coalesce(F.lit(True) if query is None else query, F.lit(False)))
    asked = own.filter("asked")
    near = within(asked, own, radius).groupBy(F.col("fp0").alias("q0"), F.col("fp1").alias("q1")).agg((F.sum("n") - 1).alias("n_near"), F.sort_array(F.collect_list("id")).alias("near_ids"))
    out = attached(own.join(after, "next_id", "left"), near, asked)
    return out.select("doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), told(F.col("fp0"), F.col("fp1")).alias("fingerprint"),
                      told(F.col("e0"), F.col("e1")).alias("edited_fingerprint"), likeness(F.col("fp0"), F.col("fp1"), F.col("e0"), F.col("e1")).alias("near_edited"),
                      likeness(F.col("fp0"), F.col("fp1"), F.col("a.fp0"), F.col("a.fp1")).alias("near_next"),
                      "n_near", F.filter("near_ids", lambda i: ~i.eqNullSafe(F.col("doc_id"))).alias("near_ids"))
