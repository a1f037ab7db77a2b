"""The queries of this subpackage, and SQL for those that it can express."""

from docloom.llm import bit_planes, decontaminate, impact_index, langid, language_model, mixing, near_duplicates, prefix_trie, quality_classifier, quality_rules, secrets, url_filters, warc

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_quality_classifier": quality_classifier.op2_quality_classifier,
    "op3_warc": warc.op3_warc,
    "op4_mixing": mixing.op4_mixing,
    "op5_langid": langid.op5_langid,
    "op6_near_duplicates": near_duplicates.op6_near_duplicates,
    "op7_url_filters": url_filters.op7_url_filters,
    "op8_secrets": secrets.op8_secrets,
    "op9_language_model": language_model.op9_language_model,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_impact_search": impact_index.op11_impact_search,
    "op12_bit_planes": bit_planes.op12_bit_planes,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}
SQL = {
    "op1_decontaminate": decontaminate.OP1_SQL,
    "op3_warc": warc.OP3_SQL,
    "op4_mixing": mixing.OP4_SQL,
    "op6_near_duplicates": near_duplicates.OP6_SQL,
    "op8_secrets": secrets.OP8_SQL,
    "op11_impact_search": impact_index.OP11_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}
