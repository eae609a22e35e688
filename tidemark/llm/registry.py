"""The queries of the corpus operators and, where SQL can state them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, mixing, passages, pii, quality, sharding, simhash, suffixes, token_files
from .common import read


def _docs(digest) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: digest(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": lambda spark, d: decontaminate.op1_digest(read(spark, d, "documents"), read(spark, d, "benchmark")),
        "op2_mixing": _docs(mixing.op2_digest),
        "op3_sharding": _docs(sharding.op3_digest),
        "op4_passages": _docs(passages.op4_digest),
        "op5_token_files": _docs(token_files.op5_digest),
        "op6_chat": lambda spark, d: chat.op6_digest(read(spark, d, "conversations")),
        "op7_simhash": _docs(simhash.op7_digest),
        "op8_quality": _docs(quality.op8_digest),
        "op9_suffixes": _docs(suffixes.op9_digest),
        "op10_pii": _docs(pii.op10_digest),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": decontaminate.ORACLE, "op2_mixing": mixing.ORACLE, "op6_chat": chat.ORACLE}
