"""The queries of this subpackage and the SQL to hold them against."""

from __future__ import annotations

from . import conversations, decontaminate, lines, pieces, quality, resample, secrets, simhash, substrings, tokens, topk, urls, warc

QUERIES = {
    "op1_line_dedup": lines.op1_line_dedup,
    "op2_token_files": tokens.op2_token_files,
    "op3_simhash": simhash.op3_simhash,
    "op4_substring_dedup": substrings.op4_substring_dedup,
    "op5_warc": warc.op5_warc,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_sentencepiece": pieces.op8_sentencepiece,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_url_filter": urls.op10_url_filter,
    "op11_top_k": topk.op11_top_k,
    "op12_importance_resampling": resample.op12_importance_resampling,
    "op13_conversation_repair": conversations.op13_conversation_repair,
}
ORACLES = {
    "op6_quality_rules": quality.ORACLE,
    "op10_url_filter": urls.ORACLE,
    "op11_top_k": topk.ORACLE,
    "op12_importance_resampling": resample.ORACLE,
    "op13_conversation_repair": conversations.ORACLE,
}
