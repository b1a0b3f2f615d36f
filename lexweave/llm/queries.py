"""Registered queries of the operators, and SQL for those that it can express."""

from __future__ import annotations

from .best_fit import op12_best_fit_packing
from .bpe import op4_byte_bpe
from .chat import OP2_SQL, op2_chat_prefix_targets
from .embedding_dedup import op6_embedding_dedup
from .exact_dedup import OP5_SQL, op5_exact_dedup
from .hard_negatives import op11_hard_negatives
from .language_id import op9_language_id
from .packing import op3_packing
from .pii import op10_pii
from .prefix_trie import op13_prefix_trie
from .sharding import op1_sharding
from .simhash import op8_simhash
from .url_filter import op7_url_templates

QUERIES = {f.__name__: f for f in (op1_sharding, op2_chat_prefix_targets, op3_packing, op4_byte_bpe, op5_exact_dedup, op6_embedding_dedup, op7_url_templates, op8_simhash, op9_language_id, op10_pii, op11_hard_negatives, op12_best_fit_packing, op13_prefix_trie)}
ORACLE = {"op2_chat_prefix_targets": OP2_SQL, "op5_exact_dedup": OP5_SQL}
