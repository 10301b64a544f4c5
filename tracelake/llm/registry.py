"""Queries of this subpackage and, where SQL can express them, their SQL."""

from tracelake.llm import alignment, bpe, decontaminate, jaccard_join, katz, kneser_ney, language_id, line_dedup, media, neighbours, pii, substring_dedup, whitening

QUERIES = {
    "op1_decontaminate": decontaminate.query,
    "op2_media_gif": media.query,
    "op3_quality_classifier": kneser_ney.query,
    "op4_katz_scoring": katz.query,
    "op5_jaccard_join": jaccard_join.query,
    "op6_personal_data": pii.query,
    "op7_bpe": bpe.query,
    "op8_language_id": language_id.query,
    "op9_substring_dedup": substring_dedup.query,
    "op10_line_dedup": line_dedup.query,
    "op11_alignment": alignment.query,
    "op12_whitening": whitening.query,
    "op13_neighbours": neighbours.query,
}

ORACLES = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
}
