"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from valora.llm import (
    bpe_automaton,
    chat_format,
    collocations,
    embedding_join,
    exact_dedup,
    html_extract,
    language_id,
    line_dedup,
    ngram_join,
    packing,
    prefix_trie,
    topk_search,
    warc_revisit,
)


def _exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def queries() -> dict:
    return {
        "op1_chat_format": chat_format.chat_query,
        "op2_exact_dedup": _exact_dedup,
        "op3_language_id": language_id.language_query,
        "op4_html_extract": html_extract.extract_query,
        "op5_bpe_automaton": bpe_automaton.bpe_query,
        "op6_best_fit_pack": packing.packing_query,
        "op7_line_dedup": line_dedup.line_query,
        "op8_ngram_jaccard": ngram_join.ngram_query,
        "op9_warc_revisit": warc_revisit.revisit_query,
        "op10_embedding_neardup": embedding_join.embedding_query,
        "op11_phrase_collocations": collocations.collocation_query,
        "op12_prefix_trie": prefix_trie.trie_query,
        "op13_topk_search": topk_search.topk_query,
    }


def checks() -> dict[str, str]:
    """The others have no SQL form, or one that is too slow; the tests check them by brute
    force, against the tokenizers library, or by accuracy on rows held out."""
    return {
        "op1_chat_format": chat_format.SQL,
        "op2_exact_dedup": exact_dedup.SQL,
        "op7_line_dedup": line_dedup.SQL,
        "op9_warc_revisit": warc_revisit.SQL,
        "op11_phrase_collocations": collocations.SQL,
        "op12_prefix_trie": prefix_trie.SQL,
        "op13_topk_search": topk_search.SQL,
    }
