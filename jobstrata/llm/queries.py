"""The operators of this package as named queries over the test tables, with SQL where it can say the same."""

import public_tokenizers
from pyspark.sql import functions as F

from jobstrata.llm import (byte_bpe, html_extraction, language_id, near_dedup, packing, periodic_runs, quality_rules, sharding,
                           simhash_dedup, suffix_dedup, token_counts, topk_search, vector_codes)
from jobstrata.llm.oracles import ORACLES  # noqa: F401

#: Vocabulary files; every machine has them at the same place.
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD_MERGES = public_tokenizers.path("word_bpe_49k.json")


def _table(name):
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


documents, labels, pages, embeddings = map(_table, ("documents", "labels", "pages", "embeddings"))


def op1_token_counts(spark, sf_dir):
    return token_counts.count_tokens(documents(spark, sf_dir), WORD_PIECES)


def op2_suffix_dedup(spark, sf_dir):
    return suffix_dedup.repeated_passages(documents(spark, sf_dir))


def op3_minhash_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op4_quality_rules(spark, sf_dir):
    return quality_rules.judge(documents(spark, sf_dir), labels(spark, sf_dir))


def op5_html_extraction(spark, sf_dir):
    return html_extraction.extract(pages(spark, sf_dir))


def op6_byte_bpe(spark, sf_dir):
    encoded = byte_bpe.encode(documents(spark, sf_dir), BYTE_RANKS)
    return byte_bpe.digests(byte_bpe.decode(encoded, BYTE_RANKS))


def op7_sharding(spark, sf_dir):
    return sharding.shard_documents(documents(spark, sf_dir))


def op8_topk_search(spark, sf_dir):
    return topk_search.top_k(embeddings(spark, sf_dir))


def op9_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir), WORD_MERGES)


def op10_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    found = language_id.identify(docs, language_id.learn(docs))
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_simhash_near_dedup(spark, sf_dir):
    return simhash_dedup.near_copies(documents(spark, sf_dir))


def op12_periodic_runs(spark, sf_dir):
    return periodic_runs.digests(periodic_runs.find_runs(periodic_runs.with_periodic_tails(documents(spark, sf_dir))))


def op13_vector_codes(spark, sf_dir):
    return vector_codes.compress(embeddings(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    op1_token_counts, op2_suffix_dedup, op3_minhash_near_dedup, op4_quality_rules, op5_html_extraction, op6_byte_bpe,
    op7_sharding, op8_topk_search, op9_packing, op10_language_id, op11_simhash_near_dedup, op12_periodic_runs, op13_vector_codes)}
