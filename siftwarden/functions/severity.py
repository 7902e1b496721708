"""Severity and confidence scales, scores and grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Severities from worst to least, with the weight each adds to a risk score.
SEVERITIES = {"critical": 40, "high": 20, "medium": 8, "low": 3, "info": 0}
# Confidences from least to most.
CONFIDENCES = ("low", "medium", "high")
# The grade for a capped score up to each bound.
GRADES = ((0, "A+"), (10, "A"), (25, "B"), (50, "C"), (90, "D"))
WORST_GRADE, SCORE_CAP = "F", 100


def _chain(col: Column, values: dict, default) -> Column:
    out = F
    for key, value in values.items():
        out = out.when(col == key, value)
    return out.otherwise(default)


def rank(severity: Column) -> Column:
    """0 for critical to 4 for info; 5 for a severity that isn't known."""
    return _chain(severity, {s: k for k, s in enumerate(SEVERITIES)}, len(SEVERITIES))


def weight(severity: Column) -> Column:
    return _chain(severity, SEVERITIES, 0)


def confidence_rank(confidence: Column) -> Column:
    return _chain(confidence, {c: k for k, c in enumerate(CONFIDENCES)}, 0)


def grade(score: Column) -> Column:
    """The grade of a risk score: capped, then by bounds."""
    out = F
    for bound, name in GRADES:
        out = out.when(F.least(score, F.lit(SCORE_CAP)) <= bound, name)
    return out.otherwise(WORST_GRADE)


def dimension(spark: SparkSession) -> DataFrame:
    """severity, rank, weight: five rows."""
    return spark.createDataFrame([(s, k, w) for k, (s, w) in enumerate(SEVERITIES.items())], "severity string, rank int, weight int")
