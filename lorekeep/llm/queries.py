"""The training-data queries: name -> (spark, sf_dir) -> DataFrame, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from lorekeep.llm import chat, chunk_dedup, decontaminate, jaccard, language, mixing, quality, quality_rules, spelling, suffix_dedup, url_filter, vectors, whitening
from lorekeep.llm.common import table

QUERIES = {
    "op1_language_id": lambda s, d: language.op1(s, table(s, d, "documents")),
    "op2_mix_sources": lambda s, d: mixing.op2(s, table(s, d, "documents")),
    "op3_decontaminate": lambda s, d: decontaminate.op3(s, table(s, d, "documents"), table(s, d, "benchmark")),
    "op4_quality": lambda s, d: quality.op4(s, table(s, d, "documents"), table(s, d, "labels")),
    "op5_chat_perspectives": lambda s, d: chat.rotate_perspectives(table(s, d, "conversations")),
    "op6_suffix_dedup": lambda s, d: suffix_dedup.op6(s, table(s, d, "documents")),
    "op7_url_filter": lambda s, d: url_filter.op7(s, table(s, d, "pages")),
    "op8_jaccard_join": lambda s, d: jaccard.op8(s, table(s, d, "documents")),
    "op9_nearest_vectors": lambda s, d: vectors.op9(s, table(s, d, "embeddings")),
    "op10_chunk_dedup": lambda s, d: chunk_dedup.op10(s, table(s, d, "documents")),
    "op11_quality_rules": lambda s, d: quality_rules.op11(s, table(s, d, "documents"), table(s, d, "labels")),
    "op12_whiten": lambda s, d: whitening.op12(s, table(s, d, "embeddings")),
    "op13_spelling": lambda s, d: spelling.op13(s, table(s, d, "documents")),
}

ORACLES = {
    "op3_decontaminate": decontaminate.ORACLE,
    "op5_chat_perspectives": chat.ORACLE,
    "op7_url_filter": url_filter.ORACLE,
    "op8_jaccard_join": jaccard.ORACLE,
}
