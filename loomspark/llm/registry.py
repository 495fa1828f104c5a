"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from loomspark.llm import bpe, chat, fingerprints, html_text, jaccard, language, mixing, neighbours, prefix_trie, resampling, sharding, suffixes, topk


def queries() -> dict:
    return {
        "op1_mix_sources": mixing.op1_mix_sources,
        "op3_format_chats": chat.op3_format_chats,
        "op4_shard_documents": sharding.op4_shard_documents,
        "op7_encode_bpe": bpe.op7_encode_bpe,
        "op10_extract_html": html_text.op10_extract_html,
        "op5_fingerprint_documents": fingerprints.op5_fingerprint_documents,
        "op8_jaccard_join": jaccard.op8_jaccard_join,
        "op6_suffix_dedup": suffixes.op6_suffix_dedup,
        "op9_nearest_vectors": neighbours.op9_nearest_vectors,
        "op2_language_id": language.op2_language_id,
        "op11_importance_resample": resampling.op11_importance_resample,
        "op12_prefix_trie": prefix_trie.op12_prefix_trie,
        "op13_exact_topk": topk.op13_exact_topk,
        "pages_language": language.page_languages,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mixing.ORACLE, "op3_format_chats": chat.ORACLE, "op6_suffix_dedup": suffixes.ORACLE, "op8_jaccard_join": jaccard.ORACLE, "op11_importance_resample": resampling.ORACLE, "op12_prefix_trie": prefix_trie.ORACLE, "op13_exact_topk": topk.ORACLE}
