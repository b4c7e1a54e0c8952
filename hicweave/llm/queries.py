"""The registered queries of this folder and the SQL that checks them."""

from __future__ import annotations

from . import bpe, jaccard, manifest, merkle, packing, quality, secrets, sharding, substrings, suffixes, tokencounts, urls, whitening

QUERIES = {
    "op1_quality_rules": quality.query,
    "op2_packing": packing.query,
    "op3_substring_dedup": substrings.query,
    "op4_token_counts": tokencounts.query,
    "op5_url_filters": urls.query,
    "op6_ngram_jaccard_join": jaccard.query,
    "op7_bpe_encoding": bpe.query,
    "op8_sharding": sharding.query,
    "op9_secret_scans": secrets.query,
    "op10_document_fingerprints": merkle.query,
    "op11_embedding_whitening": whitening.query,
    "op12_suffix_array_dedup": suffixes.query,
    "op13_merkle_manifest": manifest.query,
}
ORACLE_SQL = {
    "op1_quality_rules": quality.ORACLE,
    "op3_substring_dedup": substrings.ORACLE,
    "op5_url_filters": urls.ORACLE,
    "op6_ngram_jaccard_join": jaccard.ORACLE,
    "op9_secret_scans": secrets.ORACLE,
    "op10_document_fingerprints": merkle.ORACLE,
    "op12_suffix_array_dedup": suffixes.ORACLE,
    "op13_merkle_manifest": manifest.ORACLE,
}
