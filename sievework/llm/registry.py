"""The queries and their SQL, where SQL can express them."""

from __future__ import annotations

from .ann import op4_nearest
from .best_fit import op12_best_fit
from .enrichment import OP13_SQL, op13_enrichment
from .exact_dedup import OP2_SQL, op2_exact_dedup
from .jaccard import OP8_SQL, op8_jaccard_join
from .language_id import op1_language_id
from .license_scan import op5_license_scan
from .merkle import OP11_SQL, op11_manifest
from .mixing import OP9_SQL, op9_source_mix
from .packing import op7_pack_sequences
from .quality import op6_quality
from .suffix_dedup import OP3_SQL, op3_suffix_dedup
from .substring_dedup import OP10_SQL, op10_window_dedup

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_nearest": op4_nearest,
    "op5_license_scan": op5_license_scan,
    "op6_quality": op6_quality,
    "op7_pack_sequences": op7_pack_sequences,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_source_mix": op9_source_mix,
    "op10_window_dedup": op10_window_dedup,
    "op11_manifest": op11_manifest,
    "op12_best_fit": op12_best_fit,
    "op13_enrichment": op13_enrichment,
}
ORACLES = {"op2_exact_dedup": OP2_SQL, "op3_suffix_dedup": OP3_SQL, "op8_jaccard_join": OP8_SQL, "op9_source_mix": OP9_SQL, "op10_window_dedup": OP10_SQL, "op11_manifest": OP11_SQL, "op13_enrichment": OP13_SQL}
