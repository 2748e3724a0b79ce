"""The registered queries of this package and their SQL."""

from . import alignment, chat, decontaminate, exactdedup, fingerprints, hardnegatives, jaccard, langid, licenses, mixing, substrings, urlfilter, warc

QUERIES = {
    "op1_source_mixing": mixing.op1_source_mixing,
    "op2_chat_format": chat.op2_chat_format,
    "op3_benchmark_decontamination": decontaminate.op3_benchmark_decontamination,
    "op4_warc_bundles": warc.op4_warc_bundles,
    "op5_url_filter": urlfilter.op5_url_filter,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_substring_dedup": substrings.op7_substring_dedup,
    "op8_language_id": langid.op8_language_id,
    "op9_ngram_jaccard_join": jaccard.op9_ngram_jaccard_join,
    "op10_document_fingerprints": fingerprints.op10_document_fingerprints,
    "op11_exact_dedup": exactdedup.op11_exact_dedup,
    "op12_hard_negatives": hardnegatives.op12_hard_negatives,
    "op13_cross_tokenizer_alignment": alignment.op13_cross_tokenizer_alignment,
}

ORACLE_SQL = {
    "op2_chat_format": chat.OP2_SQL,
    "op3_benchmark_decontamination": decontaminate.OP3_SQL,
    "op4_warc_bundles": warc.OP4_SQL,
    "op7_substring_dedup": substrings.OP7_SQL,
    "op9_ngram_jaccard_join": jaccard.OP9_SQL,
    "op11_exact_dedup": exactdedup.OP11_SQL,
    "op12_hard_negatives": hardnegatives.OP12_SQL,
}
