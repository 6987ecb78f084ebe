"""The registered queries of this folder and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import op1_bpe, op2_simhash, op3_token_files, op4_url_filters, op5_pii, op6_embedding, op7_quality, op8_mixing, op9_quality_rules, op10_token_counts, op11_divergence, op12_clicks, op13_language


def queries() -> dict:
    return {
        "op1_bpe": op1_bpe.query,
        "op2_simhash": op2_simhash.query,
        "op3_token_files": op3_token_files.query,
        "op4_url_filters": op4_url_filters.query,
        "op5_pii": op5_pii.query,
        "op6_embedding": op6_embedding.query,
        "op7_quality": op7_quality.query,
        "op8_mixing": op8_mixing.query,
        "op9_quality_rules": op9_quality_rules.query,
        "op10_token_counts": op10_token_counts.query,
        "op11_divergence": op11_divergence.query,
        "op12_clicks": op12_clicks.query,
        "op13_language": op13_language.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    sql = {"op4_url_filters": op4_url_filters.SQL, "op8_mixing": op8_mixing.SQL, "op9_quality_rules": op9_quality_rules.SQL, "op11_divergence": op11_divergence.SQL}
    return sql | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
