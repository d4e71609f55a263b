"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import jaccard, language, lines, mixing, pieces, quality, secrets, vectors, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_line_dedup": lines.op2_line_dedup,
    "op3_mixing": mixing.op3_mixing,
    "op4_pieces": pieces.op4_pieces,
    "op5_near_vectors": vectors.op5_near_vectors,
    "op6_exact_topk": vectors.op6_exact_topk,
    "op7_jaccard_join": jaccard.op7_jaccard_join,
    "op8_language_id": language.op8_language_id,
    "op9_quality": quality.op9_quality,
    "op10_secret_scan": secrets.op10_secret_scan,
}

#: The others are held against brute force, round trips or held-out accuracy in tests.
SQL = {
    "op1_warc": warc.OP1_SQL,
    "op2_line_dedup": lines.OP2_SQL,
    "op3_mixing": mixing.OP3_SQL,
    "op5_near_vectors": vectors.OP5_SQL,
    "op6_exact_topk": vectors.OP6_SQL,
}
