"""The registered queries of this subpackage. Each reads its whole table and takes its rows from the operator named."""

from __future__ import annotations

from . import count_tree, divergence, exact_dedup, license_scan, mixing, near_dedup, packing, pii, suffix_tree, syncmers, token_counts, toxicity, vector_codes
from .common import table


def op7_exact_dedup(spark, folder):
    return exact_dedup.exact_groups(table(spark, folder, "documents"))


def op8_mixing(spark, folder):
    return mixing.mix_counts(table(spark, folder, "documents"))


def op1_pii(spark, folder):
    return pii.pii_counts(table(spark, folder, "documents"))


def op2_near_dedup(spark, folder):
    return near_dedup.near_groups(table(spark, folder, "documents"))


def op3_packing(spark, folder):
    return packing.pack_documents(table(spark, folder, "documents"))


def op4_toxicity(spark, folder):
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_suffix_tree(spark, folder):
    return suffix_tree.lm_scores(table(spark, folder, "documents"))


def op6_license_scan(spark, folder):
    return license_scan.licence_labels(table(spark, folder, "documents"))


def op9_token_counts(spark, folder):
    return token_counts.token_counts(table(spark, folder, "documents"))


def op10_syncmers(spark, folder):
    return syncmers.fingerprints(table(spark, folder, "documents"))


def op11_source_divergence(spark, folder):
    return divergence.source_divergence(table(spark, folder, "documents"))


def op12_ngram_join(spark, folder):
    return count_tree.ngram_groups(table(spark, folder, "documents"))


def op13_vector_codes(spark, folder):
    return vector_codes.vector_codes(table(spark, folder, "embeddings"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_near_dedup": op2_near_dedup,
    "op3_packing": op3_packing,
    "op4_toxicity": op4_toxicity,
    "op5_suffix_tree": op5_suffix_tree,
    "op6_license_scan": op6_license_scan,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_mixing": op8_mixing,
    "op9_token_counts": op9_token_counts,
    "op10_syncmers": op10_syncmers,
    "op11_source_divergence": op11_source_divergence,
    "op12_ngram_join": op12_ngram_join,
    "op13_vector_codes": op13_vector_codes,
}
