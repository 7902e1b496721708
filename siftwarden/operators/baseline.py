"""Accepted findings: three-way diff, fixed entries, pruning, age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_fingerprint(entries: DataFrame, now: Column, max_age_days: int | None = None) -> DataFrame:
    """fingerprint, active: some entry has no expiry or one after now, and isn't older than the age allowed."""
    live = F.col("expires_at").isNull() | (F.col("expires_at") > now)
    if max_age_days is not None:
        live = live & (F.date_add("created_at", max_age_days) >= now)
    return entries.groupBy("fingerprint").agg(F.bool_or(live).alias("active"))


def diff(findings: DataFrame, entries: DataFrame, now: Column) -> DataFrame:
    """findings with disposition: suppressed, expired (which is new again) or new."""
    known = by_fingerprint(entries, now)
    out = findings.join(known, "fingerprint", "left")
    return out.withColumn("disposition", F.when(F.col("active"), "suppressed").when(F.col("active").isNotNull(), "expired").otherwise("new")).drop("active")


def fixed(findings: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries that no finding has any more."""
    return entries.join(findings.select("fingerprint").distinct(), "fingerprint", "left_anti")


def pruned(findings: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries that some finding still has."""
    return entries.join(findings.select("fingerprint").distinct(), "fingerprint", "left_semi")
