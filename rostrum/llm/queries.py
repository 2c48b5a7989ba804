"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, embedding_dedup, importance, langid, line_dedup, minhash_dedup, mixing, secrets, substring_dedup, suffix_dedup, token_counts, toxicity, whitening

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_embedding_dedup": embedding_dedup.op4_embedding_dedup,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_mixing": mixing.op6_mixing,
    "op7_language_id": langid.op7_language_id,
    "op8_minhash_dedup": minhash_dedup.op8_minhash_dedup,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_secret_scan": secrets.op10_secret_scan,
    "op11_embedding_whitening": whitening.op11_embedding_whitening,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_importance_resampling": importance.op13_importance_resampling,
}
SQL = {"op6_mixing": mixing.OP6_SQL, "op13_importance_resampling": importance.OP13_SQL}
