"""The operators' registered queries: each over its whole table, with the parameters used in production."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelat.llm import (alignment, best_fit, bpe, line_frequency, merkle, minhash, pseudonyms, secret_index, shard_table, simhash,
                          token_counts, toxicity, wavelet)
from tracelat.llm.base import table


#: The pseudonyms' key here; in production it comes from a store of secrets.
KEY = "corpus-key-1"


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_frequency(spark, sf_dir):
    rows = line_frequency.judge(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                       F.size("removed").cast("long").alias("removed_lines"), "removed_words")


def op2_pseudonyms(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(docs, KEY, counts=True)


def op3_secret_index(spark, sf_dir):
    return secret_index.report(table(spark, sf_dir, "documents"))


def op4_shard_table(spark, sf_dir):
    return shard_table.place(table(spark, sf_dir, "documents"), [f"shard-{i:03d}" for i in range(64)])


def op5_wavelet_files(spark, sf_dir):
    return wavelet.read_shards(wavelet.write_shards(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json")))


def op6_best_fit(spark, sf_dir):
    return best_fit.pack(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op7_simhash(spark, sf_dir):
    # searches take every fiftieth id as a query, against all documents, for near copies of the stated similarity
    return simhash.report(table(spark, sf_dir, "documents"), query=F.col("doc_id") % 50 == 0, radius=simhash.radius_for())


def op8_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2)  # as the contract says


def op9_bpe_round_trip(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op10_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op11_factorization(spark, sf_dir):
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_alignment(spark, sf_dir):
    return alignment.report(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), _vocabulary("piece_bpe_32k.model"))


def op13_merkle_manifest(spark, sf_dir):
    return merkle.audit(table(spark, sf_dir, "documents"))


def queries():
    return {f.__name__: f for f in (op1_line_frequency, op2_pseudonyms, op3_secret_index, op4_shard_table, op5_wavelet_files, op6_best_fit, op7_simhash,
                                    op8_minhash, op9_bpe_round_trip, op10_token_counts, op11_factorization, op12_alignment, op13_merkle_manifest)}


def oracle_sql() -> dict[str, str]:
    return {"op13_merkle_manifest": merkle.audit_sql()}
