"""The registered queries of this subpackage, with their SQL."""

from __future__ import annotations

from . import bpe, chat, codes, collocations, decontaminate, exact_dedup, language, licenses, ngram_join, quality, repeats, toxicity, urls


def queries():
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_quality": quality.op2_quality,
        "op3_ngram_join": ngram_join.op3_ngram_join,
        "op4_licenses": licenses.op4_licenses,
        "op5_bpe": bpe.op5_bpe,
        "op6_repeats": repeats.op6_repeats,
        "op7_chat": chat.op7_chat,
        "op8_urls": urls.op8_urls,
        "op9_exact_dedup": exact_dedup.op9_exact_dedup,
        "op10_language": language.op10_language,
        "op11_collocations": collocations.op11_collocations,
        "op12_toxicity": toxicity.op12_toxicity,
        "op13_codes": codes.op13_codes,
    }


def oracle_sql():
    return {
        "op1_decontaminate": decontaminate.OP1_SQL,
        "op3_ngram_join": ngram_join.OP3_SQL,
        "op4_licenses": licenses.OP4_SQL,
        "op6_repeats": repeats.OP6_SQL,
        "op7_chat": chat.OP7_SQL,
        "op9_exact_dedup": exact_dedup.OP9_SQL,
        "op11_collocations": collocations.OP11_SQL,
        "op13_codes": codes.OP13_SQL,
    }
