"""Queries of the text operators and the SQL they are checked against."""

from __future__ import annotations

from . import hardneg, jaccard, licences, maintext, packing, pieces, rans, repetition, spelling, surrogates, urlrules, vafile, warc

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_warc_normaliser": warc.op2_warc_normaliser,
    "op3_merge_dropout": pieces.op3_merge_dropout,
    "op4_suffix_array_quality": repetition.op4_suffix_array_quality,
    "op5_surrogates": surrogates.op5_surrogates,
    "op6_url_rules": urlrules.op6_url_rules,
    "op7_rans_token_files": rans.op7_rans_token_files,
    "op8_licence_automaton": licences.op8_licence_automaton,
    "op9_ngram_jaccard_join": jaccard.op9_ngram_jaccard_join,
    "op10_va_file_top_k": vafile.op10_va_file_top_k,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_main_text": maintext.op12_main_text,
    "op13_rns_hard_negatives": hardneg.op13_rns_hard_negatives,
}
ORACLE = {
    "op6_url_rules": urlrules.SQL,
    "op10_va_file_top_k": vafile.SQL,
    "op12_main_text": maintext.op12_main_text,
    "op13_rns_hard_negatives": hardneg.SQL,
}
