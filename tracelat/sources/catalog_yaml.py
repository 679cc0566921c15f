"""SRC-4: probe catalogue from ``*.yaml`` / ``*.yml`` files into a nested table.

Files are read with ``spark.read.text(wholetext=True)`` (one row per file,
spread over tasks); the files that come with the library are read by the
driver, since executors needn't have its folder.  Each document is parsed inside ``mapInPandas`` into the
explicit nested schema below.  Subdirectories are not read, entries with an
empty ``type`` are skipped, unknown keys are dropped.  ``source_file`` and
``pos`` (entry position inside its file) let :func:`dedupe_catalog` apply the
"last file, last entry wins" rule.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARAM = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("optional", T.BooleanType()),
    T.StructField("example", T.StringType()),
])
OUTPUT = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("description", T.StringType()),
])
CATALOG_SCHEMA = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("layer", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("scene", T.StringType()),
    T.StructField("entrypoints", T.ArrayType(T.StringType())),
    T.StructField("params", T.ArrayType(PARAM)),
    T.StructField("outputs", T.StructType([T.StructField("fields", T.ArrayType(OUTPUT))])),
    T.StructField("risks", T.StringType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("pos", T.IntegerType()),
])

BUILTIN_DIR = os.path.join(os.path.dirname(os.path.dirname(__file__)), "catalog")


def _s(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return "true" if v else "false"
    return str(v)


def _entries(text: str, source: str):
    import yaml
    doc = yaml.safe_load(text) or {}
    probes = doc.get("probes") if isinstance(doc, dict) else None
    for pos, p in enumerate(probes or []):
        if not isinstance(p, dict) or not p.get("type"):
            continue
        params = [{"name": _s(x.get("name")), "type": _s(x.get("type")),
                   "description": _s(x.get("description")), "optional": bool(x.get("optional", False)),
                   "example": _s(x.get("example"))} for x in (p.get("params") or []) if isinstance(x, dict)]
        outs = (p.get("outputs") or {}).get("fields") or []
        fields = [{"name": _s(x.get("name")), "type": _s(x.get("type")),
                   "description": _s(x.get("description"))} for x in outs if isinstance(x, dict)]
        yield {"type": _s(p.get("type")), "title": _s(p.get("title")), "layer": _s(p.get("layer")),
               "level": _s(p.get("level")), "scene": _s(p.get("scene")),
               "entrypoints": [_s(e) for e in (p.get("entrypoints") or [])],
               "params": params, "outputs": {"fields": fields}, "risks": _s(p.get("risks")),
               "source_file": source, "pos": pos}


def _parse_batches(it):
    import pandas as pd
    for pdf in it:
        rows = []
        for text, path in zip(pdf["value"], pdf["path"]):
            rows.extend(_entries(text, os.path.basename(path)))
        yield pd.DataFrame(rows, columns=[f.name for f in CATALOG_SCHEMA.fields])


def scan_catalog(spark: SparkSession, directory: str | None = None) -> DataFrame:
    """Nested catalogue table of every probe described under ``directory``
    (default: the catalogue shipped with the library)."""
    if directory is None:
        shipped = [os.path.join(BUILTIN_DIR, f) for f in sorted(os.listdir(BUILTIN_DIR)) if f.endswith((".yaml", ".yml"))]
        texts = []
        for path in shipped:
            with open(path, encoding="utf-8") as f:
                texts.append((f.read(), path))
        files = spark.createDataFrame(texts, "value string, path string")
    else:
        files = (spark.read.text(os.path.join(directory, "*.{yaml,yml}"), wholetext=True)
                 .select("value", F.col("_metadata.file_path").alias("path")))
    return files.mapInPandas(_parse_batches, CATALOG_SCHEMA)
