"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, chunks, langid, linetemplates, mixing, neighbours, pagetext, phraseindex, setjoin, substrings


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": substrings.op1_suffix_dedup,
        "op2_language_id": langid.op2_language_id,
        "op3_source_mix": mixing.op3_source_mix,
        "op4_jaccard_join": setjoin.op4_jaccard_join,
        "op5_cdc_dedup": chunks.op5_cdc_dedup,
        "op6_decontaminate": phraseindex.op6_decontaminate,
        "op7_line_templates": linetemplates.op7_line_templates,
        "op8_html_extract": pagetext.op8_html_extract,
        "op9_chat_format": chat.op9_chat_format,
        "op10_prefix_forest": neighbours.op10_prefix_forest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_source_mix": mixing.op3_sql(),
        "op6_decontaminate": phraseindex.OP6_SQL,
        "op7_line_templates": linetemplates.OP7_SQL,
        "op9_chat_format": chat.OP9_SQL,
    }
