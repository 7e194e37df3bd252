"""Stage states, roll-ups of checks and required columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stage_state(has_output: Column, output_ok: Column, has_blocker: Column, blocker_stale: Column, inputs_ready: Column) -> Column:
    """invalid output, complete (a blocker beside it is stale), blocked, stale blocker, ready or waiting."""
    return (
        F.when(has_output & ~output_ok, "INVALID").when(has_output & has_blocker & ~blocker_stale, "CONFLICT").when(has_output, "COMPLETE")
        .when(has_blocker & blocker_stale, "STALE_BLOCKER").when(has_blocker, "BLOCKED").when(inputs_ready, "READY").otherwise("WAITING")
    )


def verdict(checks: DataFrame, group: str, state: str) -> DataFrame:
    """Per group OPERATIONAL only if no check is anything but COMPLETE; NOT_READY if one is invalid or in conflict."""
    bad, all_ok = F.bool_or(F.col(state).isin("INVALID", "CONFLICT")), F.bool_and(F.col(state) == "COMPLETE")
    return checks.groupBy(group).agg(F.when(bad, "NOT_READY").when(all_ok, "OPERATIONAL").otherwise("LIMITED").alias("verdict"), F.count("*").alias("checks"))


def require_columns(df: DataFrame, required: list[str], forbidden: list[str] | None = None) -> DataFrame:
    """df, or an error that names required columns it lacks or forbidden ones it has."""
    missing, extra = sorted(set(required) - set(df.columns)), sorted(set(forbidden or []) & set(df.columns))
    if missing or extra:
        raise ValueError(f"missing columns {missing}, forbidden columns {extra}")
    return df


def unexpected_values(df: DataFrame, column: str, vocabulary: list[str]) -> DataFrame:
    """Values outside the vocabulary, with their counts."""
    return df.where(~F.coalesce(F.col(column).isin(vocabulary), F.lit(False))).groupBy(column).agg(F.count("*").alias("n"))
