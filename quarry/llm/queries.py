"""The queries of these operators over the tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, exact_dedup, html_extract, line_dedup, mixing, near_dup, quality, sharding, toxicity
from .common import table


def _over(names: str | tuple[str, ...], operator: Callable[..., DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    names = (names,) if isinstance(names, str) else names
    return lambda spark, sf_dir: operator(*(table(spark, sf_dir, x) for x in names))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": _over("documents", line_dedup.op1_line_dedup),
        "op2_exact_dedup": _over("documents", exact_dedup.op2_exact_dedup),
        "op3_sharding": _over("documents", sharding.op3_sharding),
        "op4_quality": _over(("documents", "labels"), quality.op4_quality),
        "op5_near_dup": _over("documents", near_dup.op5_near_dup),
        "op6_bpe": _over("documents", bpe.op6_bpe),
        "op7_ann": _over("embeddings", ann.op7_ann),
        "op8_mixing": _over("documents", mixing.op8_mixing),
        "op9_toxicity": _over(("documents", "labels"), toxicity.op9_toxicity),
        "op10_html_extract": _over("pages", html_extract.op10_html_extract),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.SQL, "op2_exact_dedup": exact_dedup.SQL}
