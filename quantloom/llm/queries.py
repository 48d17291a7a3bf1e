"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from .bpe import op8_cdc_bpe
from .chat import op9_chat_prefix
from .decontaminate import op3_simhash_decontam
from .embedding_dedup import op7_itq_dedup
from .filter_audit import op11_filter_orders
from .fim import op13_fim_checkpoints
from .gru_lm import op1_gru_lm
from .host_trust import op2_host_trust
from .minhash import op5_minhash_dedup
from .oracles import ORACLES
from .outliers import op12_mcd_rules
from .quality import op6_ri_quality
from .token_counts import op4_fst_token_counts
from .token_ids import op10_pfor_tokens

__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    "op1_gru_lm": op1_gru_lm,
    "op2_host_trust": op2_host_trust,
    "op3_simhash_decontam": op3_simhash_decontam,
    "op4_fst_token_counts": op4_fst_token_counts,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_ri_quality": op6_ri_quality,
    "op7_itq_dedup": op7_itq_dedup,
    "op8_cdc_bpe": op8_cdc_bpe,
    "op9_chat_prefix": op9_chat_prefix,
    "op10_pfor_tokens": op10_pfor_tokens,
    "op11_filter_orders": op11_filter_orders,
    "op12_mcd_rules": op12_mcd_rules,
    "op13_fim_checkpoints": op13_fim_checkpoints,
}
