"""The queries of this subpackage, by name, and SQL for those that SQL can express on whole tables."""

from .bpe import op6_bpe
from .clustering import OP13_SQL, op13_centroid_clustering
from .language_id import op3_language_id
from .mixing import OP9_SQL, op9_mix_sources
from .near_dedup import op4_near_dedup
from .packing import op12_best_fit_packing
from .quality_rules import OP10_SQL, op10_quality_rules
from .secret_scan import op7_secret_scan
from .spelling import op11_spelling_variants
from .substring_dedup import op1_substring_dedup
from .token_counts import op5_edit_token_counts
from .topk import OP2_SQL, op2_top_k
from .toxicity import op8_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_top_k, op3_language_id, op4_near_dedup, op5_edit_token_counts,
        op6_bpe, op7_secret_scan, op8_toxicity, op9_mix_sources, op10_quality_rules,
        op11_spelling_variants, op12_best_fit_packing, op13_centroid_clustering,
    )
}
ORACLE_SQL = {"op2_top_k": OP2_SQL, "op9_mix_sources": OP9_SQL, "op10_quality_rules": OP10_SQL, "op13_centroid_clustering": OP13_SQL}
