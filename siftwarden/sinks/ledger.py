"""Tables whose rows change: commits of changed rows on top of each other, read by key at their latest.

A commit is a folder of rows under `data` and a file under `commits` that names it.  The file is put in place only if no
other has its number, so of two writers that saw the same state one is told to look again, and what it had
written is never read.  Readers take the last base and the commits since; `compact` writes these as a new base.
A row with the column `gone` set takes its key out.

Commit files are read by the driver, so compact a table before it has some thousands of them.  On a store whose rename isn't exclusive
(object stores) let one writer commit.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Times that a writer looks again before it gives up.
TRIES = 20


class Taken(RuntimeError):
    """Another writer has committed first, TRIES times."""


class Ledger:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str):
        """keys: what names a row, never null; schema: all columns, the keys included."""
        self.spark, self.path, self.keys, self.schema = spark, path.rstrip("/"), keys, schema
        self.columns = spark.createDataFrame([], schema).columns
        jvm = spark.sparkContext._jvm
        self._path, self._text = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.commons.io.IOUtils
        self._files = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._link = jvm.java.nio.file.Files if self._files.getUri().getScheme() == "file" else None
        self._files.mkdirs(self._path(f"{self.path}/commits"))

    def commits(self) -> list[dict]:
        """What is committed, in order, from the last base on: number, folder, base."""
        names = sorted(f.getPath().getName() for f in self._files.listStatus(self._path(f"{self.path}/commits")) if f.getPath().getName().endswith(".json"))
        out: list[dict] = []
        for name in reversed(names):
            stream = self._files.open(self._path(f"{self.path}/commits/{name}"))
            try:
                out.append(json.loads(self._text.toString(stream, "UTF-8")))
            finally:
                stream.close()
            if out[-1]["base"]:
                break
        return out[::-1]

    def version(self) -> int:
        """The number of the last commit, 0 for none."""
        return max((c["number"] for c in self.commits()), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        """The latest row of each key, `_version` being the commit that it is from; or as of a version not before the last base."""
        held = [c for c in self.commits() if version is None or c["number"] <= version]
        rows = None
        for c in held:
            part = self.spark.read.schema(f"{self.schema}, gone boolean").parquet(f"{self.path}/data/{c['folder']}").withColumn("_version", F.lit(c["number"]))
            rows = part if rows is None else rows.unionByName(part)
        if rows is None:
            return self.spark.createDataFrame([], f"{self.schema}, _version int")
        if len(held) > 1:
            # a combining aggregate, so a key that changes with each commit is a row of each task
            rows = rows.groupBy(*(F.col(k).alias(f"_{k}") for k in self.keys)).agg(F.max_by(F.struct(*rows.columns), "_version").alias("_row")).select("_row.*")
        return rows.where("not gone").select(*self.columns, "_version")

    def commit(self, change: Callable[[DataFrame], DataFrame]) -> tuple[int, DataFrame]:
        """Commits what `change` makes of the table as it is: rows of its columns (and `gone`), a key once at most.

        Where another writer is first, `change` is asked again with what that one left.  The commit's number, and its rows as they were written.
        """
        for _ in range(TRIES):
            version = self.version()
            rows = change(self.read(version))
            folder = self._write(rows)
            if self._put(version + 1, folder, False):
                return version + 1, self.spark.read.schema(f"{self.schema}, gone boolean").parquet(f"{self.path}/data/{folder}").where("not gone").select(*self.columns)
            self._files.delete(self._path(f"{self.path}/data/{folder}"), True)
        raise Taken(f"{self.path}: {TRIES} commits of other writers came first")

    def compact(self) -> bool:
        """A new base of all latest rows; whether it was put in place, which it isn't if another commit came first."""
        version = self.version()
        folder = self._write(self.read(version))
        return self._put(version + 1, folder, True)

    def _write(self, rows: DataFrame) -> str:
        folder = uuid.uuid4().hex
        gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
        rows.select(*self.columns, gone.alias("gone")).write.parquet(f"{self.path}/data/{folder}")
        return folder

    def _put(self, number: int, folder: str, base: bool) -> bool:
        name, whole = f"{number:012}.json", json.dumps({"number": number, "folder": folder, "base": base})
        at, made = self._path(f"{self.path}/commits/{name}"), self._path(f"{self.path}/commits/.{folder}")
        out = self._files.create(made, False)
        try:
            out.write(whole.encode())
        finally:
            out.close()
        try:
            if self._link is None:
                return bool(self._files.rename(made, at))
            file = lambda p: self.spark.sparkContext._jvm.java.io.File(p.toUri().getPath()).toPath()
            try:
                self._link.createLink(file(at), file(made))  # a local rename would write over the other's file
                return True
            except Exception as e:
                if "FileAlreadyExists" not in str(e):
                    raise
                return False
        finally:
            self._files.delete(made, False)


def claim(jobs: Ledger, claimable: Callable[[DataFrame], DataFrame], n: int, worker: str, now) -> DataFrame:
    """The first n jobs that `claimable` gives, by schedule and id, made this worker's own: no two workers are given one job.

    jobs: a ledger of (id, status, scheduled_at, started_at, attempts, worker).
    """

    def take(table: DataFrame) -> DataFrame:
        first = claimable(table).orderBy("scheduled_at", "id").limit(n)
        return first.withColumns({"status": F.lit("running"), "started_at": now, "attempts": F.col("attempts") + 1, "worker": F.lit(worker)})

    return jobs.commit(take)[1]


def scanned(findings: Ledger, scans: DataFrame, found: DataFrame, at) -> int:
    """Writes scans, one of each project at most, to a ledger of (project_id, fingerprint, rule_id, severity, status, first_scan, last_scan, changed_at).

    What a scan found is open, as new, again or still; what was open in its project and isn't found any more is resolved; suppressed rows stay so.
    scans: (project_id, scan_id); found: (project_id, fingerprint, rule_id, severity), each fingerprint of a project once.
    """

    def change(table: DataFrame) -> DataFrame:
        old = table.select("project_id", "fingerprint", *(F.col(c).alias(f"old_{c}") for c in ("rule_id", "severity", "status", "first_scan", "last_scan", "changed_at")))
        # the semi join keeps other projects' rows out of the full one
        old = old.join(scans.select("project_id"), "project_id", "left_semi")
        both = found.withColumn("here", F.lit(True)).join(old, ["project_id", "fingerprint"], "full").join(scans, "project_id")
        here = F.coalesce("here", F.lit(False))
        status = F.when(F.col("old_status") == "suppressed", "suppressed").when(here, "open").otherwise("resolved")
        both = both.where(here | (F.col("old_status") == "open")).withColumn("status", status)
        changed = F.col("old_status").isNull() | (F.col("old_status") != F.col("status"))
        of = lambda c: F.when(here, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c)
        return both.select(
            "project_id", "fingerprint", of("rule_id"), of("severity"), "status", F.coalesce("old_first_scan", "scan_id").alias("first_scan"),
            F.when(here, F.col("scan_id")).otherwise(F.col("old_last_scan")).alias("last_scan"), F.when(changed, at).otherwise(F.col("old_changed_at")).alias("changed_at"),
        )

    return findings.commit(change)[0]


FINDINGS = "project_id long, fingerprint string, rule_id string, severity string, status string, first_scan long, last_scan long, changed_at timestamp_ntz"
