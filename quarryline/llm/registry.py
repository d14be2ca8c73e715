"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from quarryline.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from quarryline.llm.language_id import op4_language_id
from quarryline.llm.merkle_manifest import OP11_SQL, op11_merkle_manifest
from quarryline.llm.near_dedup import op2_near_dedup
from quarryline.llm.nearest_neighbours import op3_nearest_neighbours
from quarryline.llm.packing import op10_packing
from quarryline.llm.quality_rules import op8_quality
from quarryline.llm.secret_scan import op7_secret_scan
from quarryline.llm.sentencepiece_codec import op1_sentencepiece
from quarryline.llm.sharding import OP12_SQL, op12_sharding
from quarryline.llm.spot_signatures import op5_fingerprints
from quarryline.llm.substring_dedup import OP9_SQL, op9_substring_dedup
from quarryline.llm.url_filter import OP6_SQL, op6_url_filter

QUERIES = {
    f.__name__: f
    for f in (
        op1_sentencepiece,
        op2_near_dedup,
        op3_nearest_neighbours,
        op4_language_id,
        op5_fingerprints,
        op6_url_filter,
        op7_secret_scan,
        op8_quality,
        op9_substring_dedup,
        op10_packing,
        op11_merkle_manifest,
        op12_sharding,
        op13_hard_negatives,
    )
}
ORACLE_SQL: dict[str, str] = {"op6_url_filter": OP6_SQL, "op9_substring_dedup": OP9_SQL, "op11_merkle_manifest": OP11_SQL, "op12_sharding": OP12_SQL, "op13_hard_negatives": OP13_SQL}
