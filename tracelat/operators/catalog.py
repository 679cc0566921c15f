"""Catalogue and schema operators (CAT-1..5, JOIN-2..4, SET-1..2).

The catalogue is a dimension table with one row per probe; it is joined to
the (large) control log and status tables with a broadcast hint only after
its row count has been checked against :data:`BROADCAST_MAX_ROWS`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_MAX_ROWS = 100_000


def require_column(df: DataFrame, col: str) -> None:
    """CAT-2: the column exists, else an error listing the columns."""
    if col not in df.columns:
        raise ValueError(f"latency column not found: {col}; columns are: {', '.join(df.columns)}")


def table_exists(spark: SparkSession, path_or_name: str) -> bool:
    """CAT-1: a catalog table or a readable path."""
    if "/" not in path_or_name and spark.catalog.tableExists(path_or_name):
        return True
    jvm = spark.sparkContext._jvm
    jsc = spark.sparkContext._jsc
    p = jvm.org.apache.hadoop.fs.Path(path_or_name)
    fs = p.getFileSystem(jsc.hadoopConfiguration())
    return fs.exists(p)


def maybe_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast hint only for a side whose size was checked."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def dedupe_catalog(cat: DataFrame) -> DataFrame:
    """SET-2: one row per ``type``; the last file (name order) and, inside
    it, the last entry wins."""
    w = Window.partitionBy("type").orderBy(F.col("source_file").desc(), F.col("pos").desc())
    return cat.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def catalog_params(cat: DataFrame) -> DataFrame:
    """CAT-3: one row per declared parameter."""
    return cat.select("type", F.posexplode("params").alias("param_pos", "p")).select(
        "type", "param_pos", "p.name", "p.type", "p.description", "p.optional", "p.example"
    ).toDF("type", "param_pos", "name", "param_type", "description", "optional", "example")


def catalog_outputs(cat: DataFrame) -> DataFrame:
    """CAT-3: one row per declared output column."""
    return cat.select("type", F.posexplode("outputs.fields").alias("field_pos", "f")).select(
        "type", "field_pos", F.col("f.name").alias("name"), F.col("f.type").alias("field_type"),
        F.col("f.description").alias("description"))


def _empty(c):
    return c.isNull() | (F.trim(c) == "")


def catalog_integrity(cat: DataFrame) -> DataFrame:
    """CAT-4: per probe, the list of missing or empty required fields."""
    checks = [(_empty(F.col(c)), c) for c in ("type", "title", "layer", "level", "scene", "risks")]
    checks += [
        (F.coalesce(F.size("entrypoints"), F.lit(0)) <= 0, "entrypoints"),
        (F.exists(F.coalesce("entrypoints", F.array()), lambda e: _empty(e)), "entrypoint"),
        (F.exists(F.coalesce("params", F.array()), lambda p: _empty(p["name"])), "param.name"),
        (F.exists(F.coalesce("params", F.array()), lambda p: _empty(p["type"])), "param.type"),
        (F.exists(F.coalesce("params", F.array()), lambda p: _empty(p["description"])), "param.description"),
        (F.coalesce(F.size("outputs.fields"), F.lit(0)) <= 0, "outputs"),
        (F.exists(F.coalesce("outputs.fields", F.array()), lambda o: _empty(o["name"])), "output.name"),
        (F.exists(F.coalesce("outputs.fields", F.array()), lambda o: _empty(o["type"])), "output.type"),
    ]
    issues = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in checks]))
    return cat.select("type", issues.alias("issues")).withColumn("ok", F.size("issues") == 0)


def schema_conformance(df: DataFrame, cat: DataFrame, probe: str) -> DataFrame:
    """CAT-5: declared outputs of ``probe`` vs the columns of ``df``."""
    actual = F.array(*[F.lit(c) for c in df.columns])
    declared = F.transform("outputs.fields", lambda f: f["name"])
    return cat.where(F.col("type") == probe).select(
        "type", F.array_sort(F.array_except(declared, actual)).alias("missing"),
        F.array_sort(F.array_except(actual, declared)).alias("extra"))


def all_probe_names(a: DataFrame, b: DataFrame, col: str = "name") -> DataFrame:
    """SET-1: union without duplicates of two name sets."""
    return a.select(F.col(col).alias("name")).union(b.select(F.col(col).alias("name"))).distinct()


def missing_implementation(cat: DataFrame, implemented: DataFrame, col: str = "name") -> DataFrame:
    """JOIN-4: described in the catalogue but without a data producer."""
    return cat.select("type").join(implemented, F.col("type") == implemented[col], "left_anti")


def status_precedence(remembered: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """JOIN-3: per probe, the live status (attached probes) beats the
    remembered one; probes in neither get the default later."""
    cols = ["probe", "state", "loaded", "last_error"]
    if live is None:
        return remembered.select(*cols)
    lv = live.select(*[F.col(c).alias(f"_l_{c}") for c in cols])
    j = remembered.select(*cols).join(lv, F.col("probe") == F.col("_l_probe"), "full")
    has_live = F.col("_l_probe").isNotNull()
    return j.select(F.coalesce("_l_probe", "probe").alias("probe"),
                    *[F.when(has_live, F.col(f"_l_{c}")).otherwise(F.col(c)).alias(c) for c in cols[1:]])


def catalog_status(cat: DataFrame, status: DataFrame, probe: str | None = None,
                   live: DataFrame | None = None) -> DataFrame:
    """JOIN-2/3: every catalogued probe with its status when known, else
    ``unloaded`` / not loaded; sorted by type, with the total count.

    ``status`` has ``probe, state, loaded, last_error`` (e.g. from
    :func:`tracelat.operators.control.latest_status`); ``live`` (same
    columns) takes precedence over it.  With ``probe`` only that probe is
    returned (an empty result means "not found").
    """
    cat = dedupe_catalog(cat)
    c = cat if probe is None else cat.where(F.col("type") == probe)
    status = status_precedence(status, live)
    st = status.select(F.col("probe").alias("type"), "state", "loaded", "last_error")
    total = c.count()      # the catalogue is metadata: one number, attached as a literal
    out = (c.join(st, "type", "left")
           .select("type", "title", "layer", "level",
                   F.coalesce("state", F.lit("unloaded")).alias("state"),
                   F.coalesce("loaded", F.lit(False)).alias("loaded"),
                   F.col("last_error"), F.lit(total).cast("long").alias("count")))
    return out.orderBy("type")


class ProbeNotFound(LookupError):
    """``PROBE_NOT_FOUND``: no catalogue entry for the probe."""


def probe_info(cat: DataFrame, status: DataFrame, probe: str, live: DataFrame | None = None) -> DataFrame:
    """JOIN-2, one probe: its metadata and status; raises
    :class:`ProbeNotFound` when the catalogue has no entry for it."""
    out = catalog_status(cat, status, probe=probe, live=live)
    if out.limit(1).count() == 0:
        raise ProbeNotFound(f"PROBE_NOT_FOUND: {probe}")
    return out
