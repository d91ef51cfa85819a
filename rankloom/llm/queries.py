"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .code_search import OP8_SQL, op8_code_search
from .exact_dedup import OP4_SQL, op4_exact_dedup
from .filter_audit import OP13_SQL, op13_filter_audit
from .line_dedup import op6_line_dedup
from .mixing import OP10_SQL, op10_source_mix
from .packing import op2_pack
from .phrases import OP11_SQL, op11_phrases
from .pii import op9_pii
from .secrets import op7_secrets
from .simhash import op1_simhash
from .suffix_tree_lm import op3_suffix_tree_lm
from .toxicity import op5_toxicity
from .warc import OP12_SQL, op12_warc


def queries():
    return {
        "op1_simhash": op1_simhash,
        "op2_pack": op2_pack,
        "op3_suffix_tree_lm": op3_suffix_tree_lm,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_toxicity": op5_toxicity,
        "op6_line_dedup": op6_line_dedup,
        "op7_secrets": op7_secrets,
        "op8_code_search": op8_code_search,
        "op9_pii": op9_pii,
        "op10_source_mix": op10_source_mix,
        "op11_phrases": op11_phrases,
        "op12_warc": op12_warc,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql():
    return {
        "op4_exact_dedup": OP4_SQL,
        "op8_code_search": OP8_SQL,
        "op10_source_mix": OP10_SQL,
        "op11_phrases": OP11_SQL,
        "op12_warc": OP12_SQL,
        "op13_filter_audit": OP13_SQL,
    }
