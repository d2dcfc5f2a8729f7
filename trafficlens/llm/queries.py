"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .archives import op5_arc_to_warc
from .centroids import OP11_SQL, op11_pca_centroids
from .cotraining import op1_cotraining_quality
from .langid import op7_language_id
from .manifest import OP12_SQL, op12_merkle_manifest
from .neighbours import op4_permutation_index
from .pieces import op9_unigram_pieces
from .sharding import op8_shard_slots
from .simhash import op2_simhash_groups
from .spans import op6_sentence_spans
from .tiling import op10_string_tiling
from .tokenfiles import op3_token_blocks
from .urlfilter import OP13_SQL, op13_url_filter

QUERIES = {
    "op1_cotraining_quality": op1_cotraining_quality,
    "op2_simhash_groups": op2_simhash_groups,
    "op3_token_blocks": op3_token_blocks,
    "op4_permutation_index": op4_permutation_index,
    "op5_arc_to_warc": op5_arc_to_warc,
    "op6_sentence_spans": op6_sentence_spans,
    "op7_language_id": op7_language_id,
    "op8_shard_slots": op8_shard_slots,
    "op9_unigram_pieces": op9_unigram_pieces,
    "op10_string_tiling": op10_string_tiling,
    "op11_pca_centroids": op11_pca_centroids,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_url_filter": op13_url_filter,
}
#: The others are fingerprints, models, file formats and searches; they are tested against brute force instead.
ORACLE: dict[str, str] = {
    "op11_pca_centroids": OP11_SQL,
    "op12_merkle_manifest": OP12_SQL,
    "op13_url_filter": OP13_SQL,
}
