"""Registered queries of this package and their SQL."""

from __future__ import annotations

from .alignment import op11_token_alignment
from .bpe_chunks import op8_bpe_chunks
from .conversation_repair import op13_conversation_repair
from .licenses import op9_license_scan
from .licenses import oracle_sql as license_sql
from .packing import op4_packing
from .pii import op6_pii
from .product_quantiser import op2_product_quantiser
from .quality_classifier import op1_quality_classifier
from .quality_rules import op3_quality_rules
from .sentence_spans import op5_sentence_spans
from .simhash import op7_simhash
from .line_dedup import op12_line_dedup
from .line_dedup import oracle_sql as line_sql
from .token_file import op10_token_file

QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_product_quantiser": op2_product_quantiser,
    "op3_quality_rules": op3_quality_rules,
    "op4_packing": op4_packing,
    "op5_sentence_spans": op5_sentence_spans,
    "op6_pii": op6_pii,
    "op7_simhash": op7_simhash,
    "op8_bpe_chunks": op8_bpe_chunks,
    "op9_license_scan": op9_license_scan,
    "op10_token_file": op10_token_file,
    "op11_token_alignment": op11_token_alignment,
    "op12_line_dedup": op12_line_dedup,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLE_SQL = {"op9_license_scan": license_sql(), "op12_line_dedup": line_sql()}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE_SQL)
