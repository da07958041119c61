"""The queries of the corpus operators, and the SQL that states their results where SQL can."""

from __future__ import annotations

from lectern.llm.block_search import OP13_SQL, op13_block_search
from lectern.llm.byte_bpe import op3_byte_bpe
from lectern.llm.fertility import op1_fertility
from lectern.llm.kmeans_tree import op11_kmeans_tree
from lectern.llm.mixing import OP10_SQL, op10_mix
from lectern.llm.resampling import OP12_SQL, op12_resampling
from lectern.llm.ring import op7_ring
from lectern.llm.search import OP2_SQL, op2_search
from lectern.llm.simhash import op4_simhash_dedup
from lectern.llm.token_files import op5_token_files
from lectern.llm.token_counts import op6_token_counts
from lectern.llm.toxicity import op9_toxicity
from lectern.llm.url_templates import OP8_SQL, op8_url_templates

QUERIES = {
    "op1_fertility": op1_fertility,
    "op2_search": op2_search,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_simhash_dedup": op4_simhash_dedup,
    "op5_token_files": op5_token_files,
    "op6_token_counts": op6_token_counts,
    "op7_ring": op7_ring,
    "op8_url_templates": op8_url_templates,
    "op9_toxicity": op9_toxicity,
    "op10_mix": op10_mix,
    "op11_kmeans_tree": op11_kmeans_tree,
    "op12_resampling": op12_resampling,
    "op13_block_search": op13_block_search,
}
ORACLE_SQL: dict[str, str] = {
    "op2_search": OP2_SQL,
    "op8_url_templates": OP8_SQL,
    "op10_mix": OP10_SQL,
    "op12_resampling": OP12_SQL,
    "op13_block_search": OP13_SQL,
}
