"""The findings algebra: first-wins dedupe, floors, overrides, counts, scores, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwarden.functions import severity as S


def first_of(df: DataFrame, keys: list[str], order: list, told: list[str] | None = None) -> DataFrame:
    """The first row of each key by an ascending order, all of it or some columns; combined in each task before rows are dealt, so a hot key is no more than one row of each task."""
    first = F.min_by(F.struct(*(told or df.columns)), F.struct(*order)).alias("_row")
    return df.groupBy(*(F.col(k).alias(f"_key{n}") for n, k in enumerate(keys))).agg(first).select("_row.*")


def above_floor(df: DataFrame, severity: str, confidence: str = "low", ignored: tuple[str, ...] = ()) -> DataFrame:
    """Rows at or above both floors whose rule isn't ignored; a floor that isn't known keeps all."""
    out = df
    if severity in S.SEVERITIES:
        out = out.where(S.rank(F.col("severity")) <= list(S.SEVERITIES).index(severity))
    if confidence in S.CONFIDENCES:
        out = out.where(S.confidence_rank(F.col("confidence")) >= S.CONFIDENCES.index(confidence))
    return out.where(~F.col("rule_id").isin(*ignored)) if ignored else out


def overridden(df: DataFrame, overrides: dict[str, str]) -> DataFrame:
    """Severities by rule; the one before stays in original_severity (null where nothing changed)."""
    new = F.create_map(*(F.lit(x) for pair in overrides.items() for x in pair))[F.col("rule_id")] if overrides else F.lit(None).cast("string")
    return df.withColumns({"original_severity": F.when(new.isNotNull() & (new != F.col("severity")), F.col("severity")), "severity": F.coalesce(new, F.col("severity"))})


def counts_by_severity(df: DataFrame, *keys: str) -> DataFrame:
    """A column for each severity, 0 included."""
    many = [F.count_if(F.col("severity") == s).cast("long").alias(s) for s in S.SEVERITIES]
    return df.groupBy(*keys).agg(*many) if keys else df.agg(*many)


def risk(df: DataFrame, *keys: str) -> DataFrame:
    """risk_score and grade for each key."""
    out = df.groupBy(*keys).agg(F.coalesce(F.sum(S.weight(F.col("severity"))), F.lit(0)).cast("long").alias("risk_score"))
    return out.withColumn("grade", S.grade(F.col("risk_score")))


def canonical_order(*ties: str) -> list[Column]:
    return [S.rank(F.col("severity")).asc(), F.col("file_path").asc(), F.col("line").asc(), *(F.col(t).asc() for t in ties)]
