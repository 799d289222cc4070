"""The queries of this subpackage, by name, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from .chaining import op10_collinear_chaining
from .fingerprints import op5_fingerprints
from .hard_negatives import OP12_SQL, op12_hard_negatives
from .line_dedup import OP11_SQL, op11_line_dedup
from .mixing import op1_mixing
from .near_vectors import op3_embedding_near_dedup
from .ngram_lm import op8_ngram_lm_scores
from .ngram_join import op4_ngram_jaccard_join
from .packing import op6_packing
from .pii import op9_pii
from .prefix_trie import OP13_SQL, op13_prefix_trie
from .suffix_array import op7_suffix_array_repeats
from .toxicity import op2_toxicity

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_toxicity": op2_toxicity,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_fingerprints": op5_fingerprints,
    "op6_packing": op6_packing,
    "op7_suffix_array_repeats": op7_suffix_array_repeats,
    "op8_ngram_lm_scores": op8_ngram_lm_scores,
    "op9_pii": op9_pii,
    "op10_collinear_chaining": op10_collinear_chaining,
    "op11_line_dedup": op11_line_dedup,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_prefix_trie": op13_prefix_trie,
}

SQL: dict[str, str] = {"op11_line_dedup": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_prefix_trie": OP13_SQL}
