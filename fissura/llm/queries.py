"""Queries of the operators, one each, over the driver's tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from fissura.llm.cover_tree import link_vectors
from fissura.llm.jaccard_join import join_similar
from fissura.llm.language import identify
from fissura.llm.lexicon import encode_documents
from fissura.llm.packing import pack_documents
from fissura.llm.secrets import find_secrets
from fissura.llm.shared import table
from fissura.llm.syncmers import fingerprint_documents
from fissura.llm.toxicity import score_toxicity
from fissura.llm.token_counts import count_tokens
from fissura.llm import hard_negatives, merkle, mixing, url_templates


def op1_token_counts(spark, sf_dir):
    return count_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024
    )


def op2_bpe_lexicon(spark, sf_dir):
    return encode_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )


def op9_secret_scan(spark, sf_dir):
    return find_secrets(table(spark, sf_dir, "documents")).drop("redacted")


def op10_pattern_packing(spark, sf_dir):
    return pack_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), size=2048
    )


def op7_ngram_jaccard(spark, sf_dir):
    return join_similar(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op4_language_id(spark, sf_dir):
    return identify(
        table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    )


def op6_toxicity(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_url_templates(spark, sf_dir):
    return url_templates.judge_urls(table(spark, sf_dir, "pages"))


def op8_closed_syncmers(spark, sf_dir):
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op5_cover_tree(spark, sf_dir):
    return link_vectors(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op11_hard_negatives(spark, sf_dir):
    """Rows whose id is divisible by 7 stand for mislabelled ones."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10)
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.coalesce(moved, F.col("label")))
    return hard_negatives.mine_negatives(rows, F.col("vec_id") % 50 == 0)


def op12_merkle_manifest(spark, sf_dir):
    """Every seventh document, by a checksum of its id, is tampered with."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered)


def op13_source_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).documents.drop("source")


ALL = {
    "op1_token_counts": op1_token_counts,
    "op2_bpe_lexicon": op2_bpe_lexicon,
    "op3_url_templates": op3_url_templates,
    "op4_language_id": op4_language_id,
    "op5_cover_tree": op5_cover_tree,
    "op6_toxicity": op6_toxicity,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_closed_syncmers": op8_closed_syncmers,
    "op9_secret_scan": op9_secret_scan,
    "op10_pattern_packing": op10_pattern_packing,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_source_mixing": op13_source_mixing,
}

#: SQL of those that it can express.
ORACLES: dict[str, str] = {
    "op3_url_templates": url_templates.SQL,
    "op11_hard_negatives": hard_negatives.SQL,
    "op12_merkle_manifest": merkle.SQL,
    "op13_source_mixing": mixing.SQL,
}
