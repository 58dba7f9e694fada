"""Queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import (
    bpe,
    collocations,
    itq,
    langid,
    minhash,
    negatives,
    oracles,
    packing,
    pii,
    quality,
    suffix,
    tokenfile,
    toxicity,
    url_filter,
)


def queries() -> dict:
    return {
        "op1_minhash_dedup": minhash.query,
        "op2_best_fit_packing": packing.query,
        "op3_language_id": langid.query,
        "op4_quality_rules": quality.query,
        "op5_token_files": tokenfile.query,
        "op6_suffix_dedup": suffix.query,
        "op7_bpe": bpe.query,
        "op8_embedding_dedup": itq.query,
        "op9_url_filters": url_filter.query,
        "op10_toxicity": toxicity.query,
        "op11_collocations": collocations.query,
        "op12_hard_negatives": negatives.query,
        "op13_pii": pii.query,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
