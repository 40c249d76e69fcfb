"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import language, lines, mixing, neighbours, packing, phrases, quality, simhash, substring, topk, toxicity, urls, whitening

QUERIES = {
    "op1_posting_lists": neighbours.query,
    "op2_simhash": simhash.query,
    "op3_url_filter": urls.query,
    "op4_mixing": mixing.query,
    "op5_language": language.query,
    "op6_toxicity": toxicity.query,
    "op7_exact_top_k": topk.query,
    "op8_packing": packing.query,
    "op9_quality": quality.query,
    "op10_substring_dedup": substring.query,
    "op11_line_dedup": lines.query,
    "op12_collocations": phrases.query,
    "op13_whitening": whitening.query,
}
ORACLES = {"op3_url_filter": urls.ORACLE, "op4_mixing": mixing.ORACLE, "op7_exact_top_k": topk.ORACLE, "op10_substring_dedup": substring.ORACLE, "op11_line_dedup": lines.ORACLE, "op12_collocations": phrases.ORACLE}
