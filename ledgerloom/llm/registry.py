"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import alignment, centroids, chat, classifier, jaccard, katz, neighbours, packing, rules, seekable, sentencepieces, sharding, wrappers

QUERIES = {
    "op1_quality_classifier": classifier.op1_quality_classifier,
    "op2_quality_rules": rules.op2_quality_rules,
    "op3_jaccard_join": jaccard.op3_jaccard_join,
    "op4_token_files": seekable.op4_token_files,
    "op5_packing": packing.op5_packing,
    "op6_sharding": sharding.op6_sharding,
    "op7_near_duplicates": neighbours.op7_near_duplicates,
    "op8_main_text": wrappers.op8_main_text,
    "op9_katz": katz.op9_katz,
    "op10_sentencepiece": sentencepieces.op10_sentencepiece,
    "op11_alignment": alignment.op11_alignment,
    "op12_chat_format": chat.op12_chat_format,
    "op13_centroids": centroids.op13_centroids,
}

ORACLES: dict[str, str] = {
    "op2_quality_rules": rules.ORACLE,
    "op6_sharding": sharding.ORACLE,
    "op12_chat_format": chat.ORACLE,
    "op13_centroids": centroids.ORACLE,
}
