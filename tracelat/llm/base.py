"""What the operators share: reading a table, scratch tables, word splitting.

Conventions of all operators here: they select the columns they need first, so other columns of the input (also
ones whose names equal an operator's output) never clash; a null text counts as an empty one; an empty table gives
an empty result; a repeated row is treated as a row of its own unless the operator says otherwise.
"""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelat.session import checkpoint_dir

#: Code points that separate words: space and tab to carriage return.
SPACES = "\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id as ``doc_id``, the text as ``text`` (null: empty) and ``more`` columns as they are."""
    # left as it is where it may be: a renamed column would keep two joins from sharing one exchange
    as_is = id_col == "doc_id" and docs.schema["doc_id"].dataType.simpleString() == "bigint"
    return docs.select(F.col("doc_id") if as_is else F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def stored(df: DataFrame, name: str, keep: bool = False, **options: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder (``spark.checkpoint.dir``) and read it again: later jobs start
    from files that outlive executors, and nothing before them runs twice.  Within ``scratch`` the table is deleted at
    its end (with ``keep``: at the end of the scope around it, if any)."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tracelat-llm/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    for scope in (_scopes[:-1] if keep else _scopes)[-1:]:
        scope.append(path)
    return spark.read.schema(df.schema).parquet(path)


_scopes: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that are stored within are deleted at its end; what is read later must be stored with ``keep``."""
    mine: list[str] = []
    _scopes.append(mine)
    try:
        yield
    finally:
        _scopes[:] = [x for x in _scopes if x is not mine]
        for path in mine:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
