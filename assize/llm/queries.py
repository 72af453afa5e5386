"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from .byte_bpe import op9_byte_bpe
from .collocations import OP13_SQL, op13_collocations
from .conversation_trie import OP12_SQL, op12_prefix_trie
from .packing import op4_residual_packing
from .perplexity import op8_perplexity
from .preference import OP5_SQL, op5_preferences
from .quality_rules import OP3_SQL, op3_rule_ledger
from .sharding import op1_ring_shards
from .simhash import op6_simhash
from .substring_dedup import op2_substring_dedup
from .token_counts import op7_token_counts
from .warc import OP11_SQL, op11_capture_index
from .winnowing import op10_winnowing

QUERIES = {
    "op1_ring_shards": op1_ring_shards,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_rule_ledger": op3_rule_ledger,
    "op4_residual_packing": op4_residual_packing,
    "op5_preferences": op5_preferences,
    "op6_simhash": op6_simhash,
    "op7_token_counts": op7_token_counts,
    "op8_perplexity": op8_perplexity,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_winnowing": op10_winnowing,
    "op11_capture_index": op11_capture_index,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_collocations": op13_collocations,
}
ORACLE_SQL = {"op3_rule_ledger": OP3_SQL, "op5_preferences": OP5_SQL, "op11_capture_index": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_collocations": OP13_SQL}
