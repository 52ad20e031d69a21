"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from orrery.llm import bpe, chat, language, near_duplicates, neighbours, packing, quality, secrets, token_files, urls


def queries() -> dict[str, Callable]:
    return {
        "op1_packing": packing.op1_packing,
        "op2_neighbours": neighbours.op2_neighbours,
        "op3_chat": chat.op3_chat,
        "op4_simhash": near_duplicates.op4_simhash,
        "op5_secrets": secrets.op5_secrets,
        "op6_bpe": bpe.op6_bpe,
        "op7_quality": quality.op7_quality,
        "op8_urls": urls.op8_urls,
        "op9_token_files": token_files.op9_token_files,
        "op10_language": language.op10_language,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op8_urls": urls.SQL,
    }
