"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import byte_bpe, decontaminate, exact_dedup, html_text, language_id, line_dedup, minhash_dedup, pseudonyms, secrets, token_counts

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_html_text": html_text.op2_html_text,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_secrets": secrets.op5_secrets,
    "op6_pseudonyms": pseudonyms.op6_pseudonyms,
    "op7_language_id": language_id.op7_language_id,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_minhash_dedup": minhash_dedup.op9_minhash_dedup,
    "op10_byte_bpe": byte_bpe.op10_byte_bpe,
}

ORACLE_SQL = {"op1_exact_dedup": exact_dedup.OP1_SQL, "op4_line_dedup": line_dedup.OP4_SQL, "op9_minhash_dedup": minhash_dedup.OP9_SQL}
