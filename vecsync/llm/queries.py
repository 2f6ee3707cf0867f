"""Registered queries of this subpackage: (spark, sf_dir) -> DataFrame, and their SQL."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from vecsync.llm import (bpe, crf, decontam, divergence, exact_dedup, huffman, kdshard, langid,
                         lexical, lzprint, ppm, simhash, tokencount)
from vecsync.llm.common import documents


def op1_ppm(spark, sf_dir):
    return ppm.scores(documents(spark, sf_dir))


def op2_kd_shards(spark, sf_dir):
    return kdshard.assign(documents(spark, sf_dir), 40, ["n_chars", "source", "lang", "doc_id"])


def op3_simhash(spark, sf_dir):
    return simhash.near_duplicates(documents(spark, sf_dir), shingle=4, radius=4)


def op4_language_mixture(spark, sf_dir):
    docs = documents(spark, sf_dir)
    langs, model = langid.learn(docs, ~langid.held_out())
    return langid.identify(docs, langs, model, langid.held_out())


def op5_byte_bpe(spark, sf_dir):
    return bpe.encode(documents(spark, sf_dir),
                      public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                      public_tokenizers.PATTERN, ids=False)


def op6_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(documents(spark, sf_dir), keep="max")


def op7_line_crf(spark, sf_dir):
    docs = documents(spark, sf_dir)
    field = crf.learn(docs, documents(spark, sf_dir, "labels"), ~crf.held_out())
    return crf.score(docs, field, 0.3, held_out=crf.held_out())


def op8_section_tokens(spark, sf_dir):
    return tokencount.section_counts(documents(spark, sf_dir),
                                     public_tokenizers.path("byte_bpe_50k.json"))


def op9_string_tiling(spark, sf_dir):
    pairs = decontam.leaks(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"),
                           threshold=0.8, shortest=5)
    return pairs.withColumn("n_tiles", F.size("tiles").cast("long")).drop("tiles")


def op10_huffman_ids(spark, sf_dir):
    return huffman.round_trip(documents(spark, sf_dir),
                              public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op11_lexical_search(spark, sf_dir):
    return lexical.search(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"), k=10)


def op12_lz_fingerprint(spark, sf_dir):
    return lzprint.edited_neighbours(documents(spark, sf_dir))


def op13_source_divergence(spark, sf_dir):
    return divergence.divergence(documents(spark, sf_dir), least_docs=30, top=50)


QUERIES = {f.__name__: f for f in (
    op1_ppm, op2_kd_shards, op3_simhash, op4_language_mixture, op5_byte_bpe, op6_exact_dedup,
    op7_line_crf, op8_section_tokens, op9_string_tiling, op10_huffman_ids, op11_lexical_search,
    op12_lz_fingerprint, op13_source_divergence)}
ORACLE = {"op6_exact_dedup": exact_dedup.ORACLE, "op11_lexical_search": lexical.ORACLE,
          "op13_source_divergence": divergence.ORACLE}
