"""The queries of this subpackage, by name, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, crosstok, decontam, langid, media, minhash, packing, quality, simhash, spelling, suffix, tokens, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": packing.op1_packing,
    "op2_chat_windows": chat.op2_chat_windows,
    "op3_media": media.op3_media,
    "op4_suffix_dedup": suffix.op4_suffix_dedup,
    "op5_quality": quality.op5_quality,
    "op6_token_counts": tokens.op6_token_counts,
    "op7_warc": warc.op7_warc,
    "op8_decontamination": decontam.op8_decontamination,
    "op9_simhash": simhash.op9_simhash,
    "op10_langid": langid.op10_langid,
    "op11_minhash": minhash.op11_minhash,
    "op12_cross_tokenizer": crosstok.op12_cross_tokenizer,
    "op13_spelling": spelling.op13_spelling,
}
ORACLES: dict[str, str] = {
    "op7_warc": warc.ORACLE_SQL,
}
