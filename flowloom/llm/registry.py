"""The queries of this subpackage and the SQL that checks them, where SQL can say what they do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, ctw, embeddings, lines, media, merkle, mixing, packing, phrases, quality, sharding, simhash, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_lines": lines.op2_lines,
        "op3_simhash": simhash.op3_simhash,
        "op4_sharding": sharding.op4_sharding,
        "op5_quality": quality.op5_quality,
        "op6_scoring": ctw.op6_scoring,
        "op7_embeddings": embeddings.op7_embeddings,
        "op8_media": media.op8_media,
        "op9_chat": chat.op9_chat,
        "op10_packing": packing.op10_packing,
        "op11_merkle": merkle.op11_merkle,
        "op12_phrases": phrases.op12_phrases,
        "op13_urls": urls.op13_urls,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_merkle": merkle.SQL, "op12_phrases": phrases.SQL, "op13_urls": urls.SQL}
