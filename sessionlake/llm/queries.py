"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from . import alignment, balltree, langid, licenses, linededup, media, mixing, ngramjoin, packing, quotes, spelling, substrings, tokenstore

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_media_columns": media.op2_media_columns,
    "op3_token_store": tokenstore.op3_token_store,
    "op4_source_mix": mixing.op4_source_mix,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_ngram_jaccard": ngramjoin.op6_ngram_jaccard,
    "op7_ball_tree_topk": balltree.op7_ball_tree_topk,
    "op8_quote_threads": quotes.op8_quote_threads,
    "op9_site_lines": linededup.op9_site_lines,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_super_kmers": substrings.op12_super_kmers,
    "op13_token_alignment": alignment.op13_token_alignment,
}
ORACLE = {
    "op6_ngram_jaccard": ngramjoin.ORACLE,
    "op7_ball_tree_topk": balltree.ORACLE,
    "op8_quote_threads": quotes.ORACLE,
    "op9_site_lines": linededup.ORACLE,
    "op11_spelling_variants": spelling.ORACLE,
    "op12_super_kmers": substrings.ORACLE,
}
