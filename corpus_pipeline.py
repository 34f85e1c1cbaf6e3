"""The five corpus stages, as ``loomgrid.llm.pipeline`` defines them; registered as the query ``pipeline``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgrid.llm.pipeline import (  # noqa: F401
    COLUMNS,
    ORACLE_SQL,
    STAGES,
    decontamination_stage,
    mixing_stage,
    near_dedup_stage,
    run,
    token_stage,
    toxicity_stage,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
