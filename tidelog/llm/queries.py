"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import ann, bpe, exact_dedup, jaccard, licenses, lines, mixing, quality, substring, token_file

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_jaccard": jaccard.op2_jaccard,
    "op3_substring": substring.op3_substring,
    "op4_mixing": mixing.op4_mixing,
    "op5_ann": ann.op5_ann,
    "op6_line_dedup": lines.op6_line_dedup,
    "op7_licenses": licenses.op7_licenses,
    "op8_bpe": bpe.op8_bpe,
    "op9_token_file": token_file.op9_token_file,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}

ORACLE_SQL = {"op6_line_dedup": lines.OP6_SQL, "op10_exact_dedup": exact_dedup.OP10_SQL}
