"""The registered queries of this package, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, divergence, extract, katz, lines, mixing, positions, quality, simhash, superkmers, tokenfiles, topk
from .oracles import ORACLES  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": bpe.op1_bpe,
    "op2_mixing": mixing.op2_mixing,
    "op3_simhash": simhash.op3_simhash,
    "op4_html": extract.op4_html,
    "op5_substring_dedup": superkmers.op5_substring_dedup,
    "op6_quality": quality.op6_quality,
    "op7_token_files": tokenfiles.op7_token_files,
    "op9_katz": katz.op9_katz,
    "op10_topk": topk.op10_topk,
    "op8_line_dedup": lines.op8_line_dedup,
    "op11_decontamination": positions.op11_decontamination,
    "op12_source_divergence": divergence.op12_source_divergence,
}
