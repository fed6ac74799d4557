"""The operators of this subpackage as queries over the synthetic tables, and SQL for those that it can express."""

from __future__ import annotations

from . import chat, collocations, infilling, jaccard, line_dedup, mixing, neighbours, packing, quality, secrets, surrogates, toxicity, url_lists

QUERIES = {
    f.__name__: f
    for f in (
        mixing.op1_mixing_sources,
        surrogates.op2_pii_surrogates,
        quality.op3_quality_rules,
        secrets.op4_secret_scan,
        line_dedup.op5_line_dedup,
        jaccard.op6_ngram_jaccard_join,
        chat.op7_chat_formatting,
        neighbours.op8_nearest_neighbours,
        packing.op9_best_fit_packing,
        url_lists.op10_url_filters,
        infilling.op11_fill_in_middle,
        toxicity.op12_toxicity,
        collocations.op13_collocations,
    )
}

SQL = {
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op7_chat_formatting": chat.OP7_SQL,
    "op10_url_filters": url_lists.OP10_SQL,
    "op11_fill_in_middle": infilling.OP11_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
