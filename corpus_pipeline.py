"""A corpus pipeline of the training-data operators: quality rules, near-duplicates, pseudonyms, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``.  All but the last return the columns of ``documents`` (any other column of theirs stays too).

* quality: documents that the rules reject go; lines above the limits go from the others' texts.
* near_dedup: one document of each group of near-duplicates (80 % of 5-word shingles) stays, the one with the smallest id.
* pii: validated numbers, dates and addresses become keyed pseudonyms.
* packing: each piece of a document, its sequence and its place there.

A stage's text changes set ``n_chars`` anew.  Null texts count as empty; an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelat.llm import best_fit, line_frequency, minhash, pseudonyms
from tracelat.llm.base import scratch, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_frequency.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicate(docs, width=5, percent=80)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from tracelat.llm.queries import KEY

    columns = docs.columns
    out = pseudonyms.pseudonymise(docs, KEY)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(*columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("pii", pii), ("packing", packing)]

#: Feistel permutations, BPE and best-fit packing aren't expressible in SQL: the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
