"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from trendloom.llm.bpe import op9_bpe
from trendloom.llm.chat import OP5_SQL, op5_chat
from trendloom.llm.decontaminate import OP1_SQL, op1_decontaminate
from trendloom.llm.divergence import OP13_SQL, op13_divergence
from trendloom.llm.html_text import op7_html
from trendloom.llm.jaccard import op10_jaccard
from trendloom.llm.language import op2_language
from trendloom.llm.packing import op11_packing
from trendloom.llm.prefix_trie import OP12_SQL, op12_prefix_trie
from trendloom.llm.quality import op4_quality
from trendloom.llm.token_counts import op3_token_counts
from trendloom.llm.token_files import op8_token_files
from trendloom.llm.toxicity import op6_toxicity

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_language": op2_language,
    "op3_token_counts": op3_token_counts,
    "op4_quality": op4_quality,
    "op5_chat": op5_chat,
    "op6_toxicity": op6_toxicity,
    "op7_html": op7_html,
    "op8_token_files": op8_token_files,
    "op9_bpe": op9_bpe,
    "op10_jaccard": op10_jaccard,
    "op11_packing": op11_packing,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_divergence": op13_divergence,
}
SQL = {"op1_decontaminate": OP1_SQL, "op5_chat": OP5_SQL, "op12_prefix_trie": OP12_SQL, "op13_divergence": OP13_SQL}
