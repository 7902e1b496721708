"""Questions to stored scans and findings: latest, trend, seen, resolved, pages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwarden.functions.severity import SEVERITIES

from . import findings as ops


def scoped(df: DataFrame, org_id: int) -> DataFrame:
    """One tenant's rows; a table without tenants is refused."""
    if "org_id" not in df.columns:
        raise ValueError("the table has no org_id to scope by")
    return df.where(F.col("org_id") == org_id)


def latest(scans: DataFrame, key: str = "project_id", n: int = 1) -> DataFrame:
    """The last n succeeded scans of each project, by id, with recency from 1."""
    w = Window.partitionBy(key).orderBy(F.col("scan_id").desc())
    return scans.where("status = 'succeeded'").withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= n)


def page(df: DataFrame, order: list, limit: int, offset: int = 0, cap: int = 200) -> DataFrame:
    return df.orderBy(*order).offset(max(0, offset)).limit(min(max(1, limit), cap))


def keyset(df: DataFrame, key: str, after, limit: int) -> DataFrame:
    return df.where(F.col(key) > after).orderBy(key).limit(limit)


def seen(findings: DataFrame) -> DataFrame:
    """First and last time of each fingerprint of a project, and in how many scans."""
    return findings.groupBy("project_id", "fingerprint").agg(F.min("created_at").alias("first_seen_at"), F.max("created_at").alias("last_seen_at"), F.count_distinct("scan_id").alias("n_scans"))


def resolved(findings: DataFrame, scans: DataFrame) -> DataFrame:
    """Rows of each project's last scan but one whose fingerprint its last scan doesn't have."""
    two = latest(scans, n=2).select("scan_id", "recency")
    still = F.max(F.col("recency") == 1).over(Window.partitionBy("project_id", "fingerprint"))
    return findings.join(two, "scan_id").withColumn("_still", still).where("recency = 2 and not _still").drop("recency", "_still")


def resolved_open(findings: DataFrame, scans: DataFrame, tasks: int | None = None) -> DataFrame:
    """Open rows of each project's scans before its last one whose fingerprint the last one doesn't have: what that scan resolves.  Made by so many tasks, or by what the session says."""
    last = latest(scans).select(F.col("project_id"), F.col("scan_id").alias("_last"))
    rows = findings.join(last, "project_id").where("scan_id = _last or (scan_id < _last and status = 'open')")
    if tasks:
        rows = rows.repartition(tasks, "project_id", "fingerprint")
    still = F.max(F.col("scan_id") == F.col("_last")).over(Window.partitionBy("project_id", "fingerprint"))
    return rows.withColumn("_still", still).where("scan_id < _last and not _still").drop("_last", "_still")


def unarchived(df: DataFrame, with_archived: bool = False) -> DataFrame:
    """Rows that aren't archived (column archived, null counts as not); all where those are asked for too."""
    return df if with_archived else df.where(~F.coalesce("archived", F.lit(False)))


def between(df: DataFrame, at: str, since: str | None, until: str | None) -> DataFrame:
    """Rows from since to until, both included and either open; times as text, a day or a day and a time.  An inverted range is refused."""
    time = lambda s, end: s if s is None or len(s) > 10 else f"{s} 23:59:59.999999" if end else f"{s} 00:00:00"
    since, until = (datetime.fromisoformat(t) if (t := time(s, k)) else None for k, s in enumerate((since, until)))
    if since and until and since > until:
        raise ValueError(f"{since} is after {until}")
    for bound, holds in ((since, Column.__ge__), (until, Column.__le__)):
        if bound:
            df = df.where(holds(F.col(at), F.lit(bound.isoformat(" ")).cast("timestamp_ntz")))
    return df


def notification(findings: DataFrame, key: str, top: int = 20) -> DataFrame:
    """For each key what a message tells: n of each severity, how many, risk, and the first findings in report order as a JSON list of rule, severity and place; no texts of sources."""
    order = [*ops.canonical_order("rule_id"), "fingerprint"]
    # a task gives out `top` rows of each key at most
    first = findings.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_nth") <= top)
    told = F.struct("rule_id", "severity", F.col("file_path").alias("file"), "line")
    some = first.groupBy(key).agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("_nth", told.alias("told")))), lambda x: x["told"])).alias("top_findings"))
    counts = ops.counts_by_severity(findings, key).withColumn("finding_count", F.expr(" + ".join(SEVERITIES)).cast("long"))
    return counts.join(ops.risk(findings, key), key).join(some, key)
