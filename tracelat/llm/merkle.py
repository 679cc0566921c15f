"""Merkle manifest of a dataset: a hash tree of three-way runs for each source, and one over the sources' roots.

H is the lowercase hexadecimal SHA-256 of its inputs one after the other (digests as text).  A row's leaf is H of its
columns, each ``-`` if null, else its UTF-8 byte count, ``:`` and the value.  Within a source leaves ascend by id (of equal
ids by leaf; no id first); while several nodes remain, every three consecutive ones become their H, the last run fewer,
even one.  What remains is the source's subroot; subroots, by source (null first, bytewise), give the root likewise.

Each level is one pass of lag and lead columns.  Nodes of level k stand on the rows of their first leaves, so siblings are
``3 ** k`` and ``2 * 3 ** k`` rows away: a node's place in its run (slot) and the ends of the run decide which of the four
columns are its siblings, and rows of first children hash the parents.  Windows are blocks of ``3 ** LEVELS`` leaves,
which no run crosses, so a source of any size is spread over tasks; the blocks' nodes are the leaves of the next
round, with ``3 ** LEVELS`` times fewer rows.  On the way back every node takes its parent's path from the row of the
first child and puts its own siblings before it.  All levels of a round share one exchange and one sort.

Positions come from ranges of (source, id): counts of ranges, one row for each range and source, give the offsets.  Texts
never move: leaves are hashed where the texts are read.

A path is an array of (before, after): the digests of the run's others on either side, from the leaf's level to the root's.
Nulls are told apart from empty values; rows that repeat an id are leaves of their own; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelat.llm.base import stored

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of a round: its blocks are of 243 rows.
LEVELS = 5
_PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns=COLUMNS, **other: Column) -> Column:
    """The leaf of a row; ``other`` values stand in for columns of these names."""
    return digest(*[field(other.get(c, F.col(c))) for c in columns])


def positions(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` (from 0, within the group) and ``n`` (rows of the group); the group's column has no nulls."""
    ranges = [F.col(c).asc_nulls_first() for c in [group, *order]]
    # written tables: the rows aren't worked out a second time to draw ranges, and ranges must not be drawn anew
    rows = stored(rows, "keyed")
    # no count: small ranges that follow each other are read as one, so few rows make few files, whatever the shuffle partitions
    dealt = stored(rows.repartitionByRange(*ranges).withColumn("__part", F.spark_partition_id()), "dealt")
    by_group = Window.partitionBy(group)
    counts = dealt.groupBy(group, "__part").agg(F.count("*").alias("__c")).select(
        group, "__part", F.sum("__c").over(by_group).alias("n"),
        (F.sum("__c").over(by_group.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__c")).alias("__before"))
    place = F.row_number().over(Window.partitionBy(group, "__part").orderBy(*ranges[1:]))
    return dealt.join(counts, [group, "__part"]).withColumn("pos", F.col("__before") + place - 1).drop("__part", "__before")


def _up(nodes: DataFrame, levels: int) -> DataFrame:
    """``nodes`` (g, pos, n, d) with ``block``, ``d`` of the block's node on its first row, and ``s0`` to the last level's:
    the siblings of the level's node that stands on the row."""
    rows = nodes.withColumn("block", F.floor(F.col("pos") / F.lit(3**levels)).cast("long"))
    w = Window.partitionBy("g", "block").orderBy("pos")
    for k in range(levels):
        step = 3**k
        several = F.ceil(F.col("n") / F.lit(step)) > 1
        slot = F.floor(F.col("pos") / F.lit(step)) % 3
        rows = rows.withColumns({"__b2": F.lag("d", 2 * step).over(w), "__b1": F.lag("d", step).over(w),
                                 "__a1": F.lead("d", step).over(w), "__a2": F.lead("d", 2 * step).over(w)})
        # what isn't in the run is masked by the slot; rows after the run's end aren't there (null)
        before = F.when(slot == 0, "").when(slot == 1, F.col("__b1")).otherwise(F.concat("__b2", "__b1"))
        after = F.concat(F.when(slot < 2, F.coalesce("__a1", F.lit(""))).otherwise(""), F.when(slot == 0, F.coalesce("__a2", F.lit(""))).otherwise(""))
        parent = F.when(slot == 0, digest("d", F.coalesce("__a1", F.lit("")), F.coalesce("__a2", F.lit(""))))
        rows = rows.withColumn(f"s{k}", F.when(several & F.col("d").isNotNull(), F.struct(before.alias("before"), after.alias("after"))))
        rows = rows.withColumn("d", F.when(several, parent).otherwise(F.col("d"))).drop("__b2", "__b1", "__a1", "__a2")
    return rows


def _down(rows: DataFrame, levels: int) -> DataFrame:
    """``rows`` of ``_up`` with ``up`` (path, root, sub) of the block's node on its first row: the same of every row's own node."""
    w = Window.partitionBy("g", "block").orderBy("pos")
    for k in reversed(range(levels)):
        step = 3**k
        slot = F.floor(F.col("pos") / F.lit(step)) % 3
        rows = rows.withColumns({"__u1": F.lag("up", step).over(w), "__u2": F.lag("up", 2 * step).over(w)})
        rows = rows.withColumn("__u", F.when(slot == 0, F.col("up")).when(slot == 1, F.col("__u1")).otherwise(F.col("__u2")))
        own = F.when(F.col(f"s{k}").isNull(), F.array().cast(_PATH)).otherwise(F.array(f"s{k}"))
        path = F.struct(F.concat(own, "__u.path").alias("path"), F.col("__u.root").alias("root"), F.col("__u.sub").alias("sub"))
        rows = rows.withColumn("up", F.when(F.col("pos") % step == 0, path)).drop("__u1", "__u2", "__u", f"s{k}")
    return rows


def paths(nodes: DataFrame, over: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``nodes`` (g, pos, n, d and others) with ``up``: path, root and sub.  ``over`` takes the groups' roots (g, d) to
    their own (g, up)."""
    most = nodes.agg(F.max("n")).first()[0] or 1
    levels = 0
    while levels < LEVELS and 3**levels < most:
        levels += 1
    rows = stored(_up(nodes, levels), "merkle-up")
    heads = rows.filter(F.col("pos") % 3**levels == 0).select("g", F.col("block").alias("pos"), F.ceil(F.col("n") / F.lit(3**levels)).cast("long").alias("n"), "d")
    if most > 3**levels:
        above = paths(heads, over).select("g", F.col("pos").alias("block"), "up")
    else:
        above = over(heads.select("g", "d")).select("g", F.lit(0).cast("long").alias("block"), "up")
    return _down(rows.drop("d").join(above, ["g", "block"]).withColumn("up", F.when(F.col("pos") % 3**levels == 0, F.col("up"))), levels).drop("block")


def _over_sources(roots: DataFrame) -> DataFrame:
    """The way from each source's subroot to the root."""
    def top(last: DataFrame) -> DataFrame:
        return last.select("g", F.struct(F.array().cast(_PATH).alias("path"), F.col("d").alias("root"), F.lit("").alias("sub")).alias("up"))

    named = positions(roots.select(F.lit("").alias("g"), F.col("g").alias("source_key"), "d", F.col("d").alias("own")), "g", ["source_key"])
    return paths(named, top).select(F.col("source_key").alias("g"), F.struct("up.path", "up.root", F.col("own").alias("sub")).alias("up"))


def manifest(leaves: DataFrame, *, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``leaves`` (an id, a source, ``leaf`` and others) with subroot, root and path."""
    keyed = leaves.select(F.struct(*leaves.columns).alias("row"), F.coalesce(F.concat(F.lit("+"), F.col(source_col)), F.lit("")).alias("g"),
                          F.col(id_col).alias("id"), F.col("leaf").alias("d"))
    out = paths(positions(keyed, "g", ["id", "d"]), _over_sources)
    return out.select("row.*", F.col("up.sub").alias("subroot"), F.col("up.root").alias("root"), F.col("up.path").alias("path"))


def proof(path: Column) -> Column:
    """H of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf leads to along a path."""
    return F.aggregate(path, start, lambda d, s: digest(s["before"], d, s["after"]))


def audit(docs: DataFrame) -> DataFrame:
    """For each row: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified.  Where 2 divides the CRC-32 of the
    decimal id, the root is folded from the row without the line ends of its text, else from the row as it is."""
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    tampered = F.when(even, leaf(text=F.translate("text", "\n", ""))).otherwise(F.col("leaf"))
    leaves = docs.select(*COLUMNS).withColumn("leaf", leaf()).select("doc_id", "source", "leaf", tampered.alias("now"))
    rows = manifest(leaves).withColumn("folded_root", folded(F.col("now"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def audit_sql(levels: int = 14, source_levels: int = 8) -> str:
    """``audit`` in DuckDB's SQL, for up to ``3 ** levels`` rows of a source and ``3 ** source_levels`` sources."""
    def row(text: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in [*COLUMNS[:-1], text]) + ")"

    def level(name: str, k: int, group: str) -> str:
        by = f"PARTITION BY {group}p // 3 ORDER BY p"
        return f"""{name}{k}s AS (SELECT *, coalesce(lag(d, 2) OVER ({by}), '') || coalesce(lag(d) OVER ({by}), '') AS b,
            coalesce(lead(d) OVER ({by}), '') || coalesce(lead(d, 2) OVER ({by}), '') AS a FROM {name}{k}),
          {name}{k + 1} AS (SELECT {group}p // 3 AS p, (m + 2) // 3 AS m, CASE WHEN m > 1 THEN sha256(string_agg(d, '' ORDER BY p)) ELSE any_value(d) END AS d
            FROM {name}{k} GROUP BY {group}p // 3, m)"""

    def fold(name: str, k: int, before: str, match: str, out: str) -> str:
        return f"""{out}{k + 1} AS (SELECT f.* REPLACE (f.p // 3 AS p, CASE WHEN t.m > 1 THEN sha256(b || now || a) ELSE now END AS now, f.proof || t.b || t.a AS proof)
            FROM {before} f JOIN {name}{k}s t ON {match} t.p = f.p)"""

    same = "t.source IS NOT DISTINCT FROM f.source AND"
    # the CRC-32's table entry of a byte: eight steps
    entry = "x"
    for _ in range(8):
        entry = f"list_transform([{entry}], lambda c: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))[1]"
    crc = f"""xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, 1 + length(CAST(doc_id AS VARCHAR))), lambda i: CAST(ord(CAST(doc_id AS VARCHAR)[i]) AS BIGINT))),
        lambda c, b: xor(c >> 8, list_transform([xor(c, b) & 255], lambda x: {entry})[1])), CAST(4294967295 AS BIGINT))"""
    parts = [f"l AS (SELECT doc_id, source, {row('text')} AS leaf, CASE WHEN {crc} % 2 = 0 THEN {row('replace(text, chr(10), \'\')')} ELSE {row('text')} END AS now FROM documents)",
             "r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY source) AS m FROM l)",
             "n0 AS (SELECT source, p, m, leaf AS d FROM r)"]
    parts += [level("n", k, "source, ") for k in range(levels)]
    parts += [f"z0 AS (SELECT row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS p, count(*) OVER () AS m, d, source FROM n{levels})"]
    parts[-1] = parts[-1].replace("z0 AS (", "y AS (") + ", z0 AS (SELECT p, m, d FROM y)"
    parts += [level("z", k, "") for k in range(source_levels)]
    parts += ["f0 AS (SELECT doc_id, source, leaf, now, p, '' AS proof FROM r)"]
    parts += [fold("n", k, f"f{k}", same, "f") for k in range(levels)]
    parts += [f"g0 AS (SELECT f.* REPLACE (y.p AS p), y.d AS subroot FROM f{levels} f JOIN y ON y.source IS NOT DISTINCT FROM f.source)"]
    parts += [fold("z", k, f"g{k}", "", "g") for k in range(source_levels)]
    return "WITH " + ",\n".join(parts) + f"""
        SELECT doc_id, leaf, subroot, z.d AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = z.d AS verified FROM g{source_levels} CROSS JOIN z{source_levels} z"""
