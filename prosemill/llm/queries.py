"""The queries of the operators and their SQL."""

from __future__ import annotations

from . import ann, html_text, language_id, lexical, lm, minhash, mixing, packing, passages, pieces, quality_rules, secrets, trie

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_language_model": lm.op2_language_model,
    "op3_language_id": language_id.op3_language_id,
    "op4_repeated_passages": passages.op4_repeated_passages,
    "op5_mixing": mixing.op5_mixing,
    "op6_ann": ann.op6_ann,
    "op7_near_duplicates": minhash.op7_near_duplicates,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_html_text": html_text.op9_html_text,
    "op10_packing": packing.op10_packing,
    "packed_conversations": packing.packed_conversations,
    "op11_prefix_trie": trie.op11_prefix_trie,
    "op12_lexical_search": lexical.op12_lexical_search,
    "op13_sentencepiece": pieces.op13_sentencepiece,
}

SQL = {"op1_quality_rules": quality_rules.OP1_SQL, "op5_mixing": mixing.OP5_SQL, "op11_prefix_trie": trie.OP11_SQL, "op12_lexical_search": lexical.OP12_SQL}
