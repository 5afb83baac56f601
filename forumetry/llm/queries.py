"""The queries of the corpus operators, and SQL for those that can be said in it. tests/llm compares the others with brute-force versions."""

from __future__ import annotations

from forumetry.llm import byte_bpe, chat, chunks, decontaminate, gif, periods, prefixes, quality, repair, rules, simhash, toxicity, viterbi

QUERIES = {
    "op1_repair_token_ids": repair.op1_repair_token_ids,
    "op2_repeated_passages": chunks.op2_repeated_passages,
    "op3_byte_bpe": byte_bpe.op3_byte_bpe,
    "op4_gif_media": gif.op4_gif_media,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_chat_format": chat.op6_chat_format,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_viterbi_token_counts": viterbi.op8_viterbi_token_counts,
    "op9_quality_trees": quality.op9_quality_trees,
    "op10_simhash": simhash.op10_simhash,
    "op11_periodic_runs": periods.op11_periodic_runs,
    "op12_prefix_trie": prefixes.op12_prefix_trie,
    "op13_quality_rules": rules.op13_quality_rules,
}
ORACLE_SQL: dict[str, str] = {
    "op5_decontaminate": decontaminate.ORACLE_SQL,
    "op6_chat_format": chat.ORACLE_SQL,
    "op12_prefix_trie": prefixes.ORACLE_SQL,
    "op13_quality_rules": rules.ORACLE_SQL,
}
