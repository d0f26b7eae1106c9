"""The queries of this package and, where DuckDB can express them, their SQL."""

from __future__ import annotations

from shoalgrid.llm import decontamination, embedding_dedup, importance, line_dedup, mixing, nearest, quality, sentencepiece_codec, sharding, simhash, spelling, toxicity, url_filter

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_embedding_near_dedup": embedding_dedup.op2_embedding_near_dedup,
    "op3_source_mixing": mixing.op3_source_mixing,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_sentencepiece": sentencepiece_codec.op5_sentencepiece,
    "op6_simhash_near_dedup": simhash.op6_simhash_near_dedup,
    "op7_quality": quality.op7_quality,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_nearest_neighbours": nearest.op10_nearest_neighbours,
    "op11_decontamination": decontamination.op11_decontamination,
    "op12_spelling": spelling.op12_spelling,
    "op13_importance": importance.op13_importance,
}
SQL = {
    "op2_embedding_near_dedup": embedding_dedup.OP2_SQL,
    "op8_url_filter": url_filter.OP8_SQL,
    "op9_line_dedup": line_dedup.OP9_SQL,
    "op11_decontamination": decontamination.OP11_SQL,
    "op12_spelling": spelling.OP12_SQL,
    "op13_importance": importance.OP13_SQL,
}
