"""Queries of the operators, and the SQL that gives the same rows where there is one."""

from __future__ import annotations

from lambertlake.llm.bpe_codec import op7_bpe_codec
from lambertlake.llm.chat_format import op10_chat_format
from lambertlake.llm.divergence import OP13_SQL, op13_divergence
from lambertlake.llm.filter_audit import OP11_SQL, op11_filter_audit
from lambertlake.llm.fingerprint import op2_fingerprints
from lambertlake.llm.html_text import op1_html_text
from lambertlake.llm.mixing import OP3_SQL, op3_mixing
from lambertlake.llm.near_dedup import op8_near_dedup
from lambertlake.llm.ngram_join import op12_ngram_join
from lambertlake.llm.pii import op6_pii
from lambertlake.llm.token_counts import op5_token_counts
from lambertlake.llm.topk import OP4_SQL, op4_topk
from lambertlake.llm.toxicity import op9_toxicity

QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_fingerprints": op2_fingerprints,
    "op3_mixing": op3_mixing,
    "op4_topk": op4_topk,
    "op5_token_counts": op5_token_counts,
    "op6_pii": op6_pii,
    "op7_bpe_codec": op7_bpe_codec,
    "op8_near_dedup": op8_near_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_chat_format": op10_chat_format,
    "op11_filter_audit": op11_filter_audit,
    "op12_ngram_join": op12_ngram_join,
    "op13_divergence": op13_divergence,
}
ORACLES: dict[str, str] = {
    "op3_mixing": OP3_SQL,
    "op4_topk": OP4_SQL,
    "op11_filter_audit": OP11_SQL,
    "op13_divergence": OP13_SQL,
}
