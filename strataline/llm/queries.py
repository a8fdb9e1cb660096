"""The registered queries of the operators for training data."""

from __future__ import annotations

from strataline.llm import chat, collocations, decontaminate, embeddings, importance, jaccard, langid, pieces, quality, repeats, tokencounts, toxicity, wrappers

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_token_counts": tokencounts.op2_token_counts,
    "op3_quality": quality.op3_quality,
    "op4_sentencepiece": pieces.op4_sentencepiece,
    "op5_language": langid.op5_language,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_embeddings": embeddings.op7_embeddings,
    "op8_html": wrappers.op8_html,
    "op9_jaccard_join": jaccard.op9_jaccard_join,
    "op10_suffix_array": repeats.op10_suffix_array,
    "op11_collocations": collocations.op11_collocations,
    "op12_chat_format": chat.op12_chat_format,
    "op13_importance_resampling": importance.op13_importance_resampling,
}

ORACLE_SQL = {
    "op1_decontaminate": decontaminate.OP1_SQL,
    "op11_collocations": collocations.OP11_SQL,
    "op12_chat_format": chat.OP12_SQL,
    "op13_importance_resampling": importance.OP13_SQL,
}
