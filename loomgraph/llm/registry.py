"""Queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from . import ann, bpe, chat, decontaminate, html_crf, langid, shards, simhash, substring_dedup, url_rules


def queries():
    return {
        "op1_crf_blocks": html_crf.op1_crf_blocks,
        "op2_ngram_hits": decontaminate.op2_ngram_hits,
        "op3_hmm_roles": chat.op3_hmm_roles,
        "op4_output_codes": langid.op4_output_codes,
        "op5_dimension_scan": ann.op5_dimension_scan,
        "op6_rabin_karp": substring_dedup.op6_rabin_karp,
        "op7_pigeonring": simhash.op7_pigeonring,
        "op8_virtual_slots": shards.op8_virtual_slots,
        "op9_rarest_token": url_rules.op9_rarest_token,
        "op10_word_table": bpe.op10_word_table,
    }


def oracle_sql():
    return {
        "op2_ngram_hits": decontaminate.OP2_SQL,
        "op6_rabin_karp": substring_dedup.OP6_SQL,
        "op9_rarest_token": url_rules.OP9_SQL,
    }
