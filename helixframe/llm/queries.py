"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .bpe import op7_bpe
from .decontaminate import op2_decontamination
from .licenses import op9_licenses
from .line_dedup import OP10_SQL, op10_line_dedup
from .pii import op8_pii
from .secrets_scan import op6_secrets
from .simhash import op4_simhash
from .topk import OP3_SQL, op3_topk
from .toxicity import op5_toxicity
from .url_filters import OP1_SQL, op1_url_filters

QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_decontamination": op2_decontamination,
    "op3_topk": op3_topk,
    "op4_simhash": op4_simhash,
    "op5_toxicity": op5_toxicity,
    "op6_secrets": op6_secrets,
    "op7_bpe": op7_bpe,
    "op8_pii": op8_pii,
    "op9_licenses": op9_licenses,
    "op10_line_dedup": op10_line_dedup,
}
ORACLES = {
    "op1_url_filters": OP1_SQL,
    "op3_topk": OP3_SQL,
    "op10_line_dedup": OP10_SQL,
}
