"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from lakehaul.llm import exact_dedup, hard_negatives, voronoi_knn
from lakehaul.llm.exact_dedup import op6_exact_dedup
from lakehaul.llm.hard_negatives import op11_hard_negatives
from lakehaul.llm.language_id import op3_language_id
from lakehaul.llm.ngram_join import op4_ngram_join
from lakehaul.llm.packing import op5_best_fit_packing
from lakehaul.llm.pii import op2_pii
from lakehaul.llm.source_mix import op9_source_mix
from lakehaul.llm.substring_dedup import op8_substring_dedup
from lakehaul.llm.suffix_dedup import op1_suffix_dedup
from lakehaul.llm.token_files import op10_token_files
from lakehaul.llm.tokenizer_alignment import op12_tokenizer_alignment
from lakehaul.llm.url_filters import op13_url_filters
from lakehaul.llm.voronoi_knn import op7_voronoi_knn

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_pii": op2_pii,
    "op3_language_id": op3_language_id,
    "op4_ngram_join": op4_ngram_join,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_voronoi_knn": op7_voronoi_knn,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_source_mix": op9_source_mix,
    "op10_token_files": op10_token_files,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_url_filters": op13_url_filters,
}

SQL = {
    "op6_exact_dedup": exact_dedup.SQL,
    "op7_voronoi_knn": voronoi_knn.SQL,
    "op11_hard_negatives": hard_negatives.SQL,
}
