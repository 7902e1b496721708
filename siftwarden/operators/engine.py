"""One run over a table of files: the detectors that are switched on, one schema, floors, overrides, de-duplication.

files: rel_path, language, iac_kind, is_manifest, content (null where a file wasn't read), as `sources.files.read_tree`
gives them.  Detectors that judge lines are arrays of hits over one table of lines, those that judge whole files arrays over one
table of files, so a run reads its files twice, however many are on; manifests, which several detectors join with other tables, are
parsed once before and kept as a work table.  `ENGINES` names the detectors.  One of another make is a function from files and settings to findings without
fingerprints, and may be added.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwarden.functions import severity as S, text as T
from siftwarden.sinks import work
from siftwarden.sources.builtin import RULES

from . import compliance, detect, findings as ops, infra, manifests, pyast

COLUMNS = {
    "engine": "string", "rule_id": "string", "severity": "string", "confidence": "string", "category": "string", "file_path": "string", "line": "long", "end_line": "long", "snippet": "string",
    "package": "string", "ecosystem": "string", "licence": "string",
}
SCHEMA = ", ".join(f"{c} {t}" for c, t in COLUMNS.items())


@dataclass(frozen=True)
class Settings:
    """advisories: ecosystem, package, id, affected, fixed_in, severity; licences: ecosystem, name, licence; either may be none."""

    engines: tuple[str, ...] = ("ast-python", "rule-engine", "secrets", "dependency", "iac", "license-compliance")
    rules: tuple[detect.Rule, ...] = tuple(RULES)
    min_severity: str = "info"
    min_confidence: str = "low"
    ignored: tuple[str, ...] = ()
    overrides: dict[str, str] = field(default_factory=dict)
    entropy_threshold: float = detect.ENTROPY_THRESHOLD
    advisories: DataFrame | None = None
    licences: DataFrame | None = None
    unknown_licence: str = "warn"


def _shaped(df: DataFrame, engine: str) -> DataFrame:
    """The columns of COLUMNS, null where a detector has none."""
    have = set(df.columns)
    names = {"file_path": "rel_path" if "rel_path" in have else "file_path", "end_line": "end_line" if "end_line" in have else "line", "package": "name" if "name" in have else "package"}
    col = lambda c: F.lit(engine) if c == "engine" else F.col(names.get(c, c)) if names.get(c, c) in have else F.lit(None)
    return df.select(*(col(c).cast(t).alias(c) for c, t in COLUMNS.items()))


@dataclass(frozen=True)
class Detector:
    """lines: hits of a line (HIT or null), over rel_path, language, iac_kind, line, line_text, and whether it is `code`, `read` and `random`;
    files: arrays of HIT of a file, over rel_path, language, iac_kind and content; manifests: findings from the table of parsed manifests."""

    lines: Callable[[Settings], list[Column]] | None = None
    files: Callable[[Settings], list[Column]] | None = None
    manifests: Callable[[DataFrame, Settings], DataFrame] | None = None


def _hit(rule: detect.Rule, snippet: Column | None = None) -> Column:
    told = [F.lit(v).alias(n) for n, v in (("rule_id", rule.rule_id), ("severity", rule.severity), ("confidence", rule.confidence), ("category", rule.category))]
    shown = detect.snippet(F.lit(rule.category)) if snippet is None else snippet
    return F.struct(*told, F.col("line"), F.col("line").alias("end_line"), shown.alias("snippet"))


def _rule_lines(s: Settings) -> list[Column]:
    of = lambda r: F.lit(True) if "*" in r.languages else F.col("language").isin(*r.languages)
    return [F.when(F.col("code") & of(r) & detect.matches(r), _hit(r)) for r in s.rules if not r.whole]


def _rule_files(s: Settings) -> list[Column]:
    known = (F.col("language") != "other") | F.col("iac_kind").isNotNull()
    return [detect.whole_hits(list(s.rules), F.when(known, F.col("content")), F.col("language"))] if any(r.whole for r in s.rules) else []


RANDOM = detect.Rule("SECRETS-HIGH-ENTROPY-ASSIGNMENT", "high", "", category="secret")


def _secret_lines(s: Settings) -> list[Column]:
    """Provider tokens and named credentials, and assigned values that look drawn at random; comments count, docstrings don't.  A random value is told as a named
    credential too only where the word is its whole name."""
    name, value = (F.regexp_extract("line_text", detect.ASSIGNMENT, k) for k in (1, 2))
    once = F.when(F.col("random"), F.col("line_text").rlike(detect.BARE_CREDENTIAL)).otherwise(True)
    named = [F.when(F.col("read") & detect.matches(r) & (once if r.rule_id == "SECRETS-HARDCODED-CREDENTIAL" else F.lit(True)), _hit(r)) for r in detect.SECRET_RULES]
    return [*named, F.when(F.col("random"), _hit(RANDOM, F.concat(name, F.lit(" = <redacted:"), F.char_length(value).cast("string"), F.lit(">"))))]


def _infra_lines(s: Settings) -> list[Column]:
    said = ~((F.col("iac_kind") == "docker") & F.startswith(F.ltrim("line_text"), F.lit("#")))
    return [F.when((F.col("iac_kind") == kind) & said & detect.matches(r), _hit(r)) for kind, rules in infra.RULES.items() for r in rules]


def _dependencies(rows: DataFrame, s: Settings) -> DataFrame:
    found = _shaped(compliance.manifest_findings(rows), "dependency")
    if s.advisories is not None:
        found = found.unionByName(_shaped(compliance.advisory_findings(rows.where("kind = 'dependency' and spec is not null"), s.advisories), "dependency"))
    return found


def _licences(rows: DataFrame, s: Settings) -> DataFrame:
    table = s.licences if s.licences is not None else rows.sparkSession.createDataFrame([], "ecosystem string, name string, licence string")
    return _shaped(compliance.licence_findings(rows.where("kind = 'dependency'"), table, unknown=s.unknown_licence), "license-compliance")


ENGINES: dict[str, Detector | Callable[[DataFrame, Settings], DataFrame]] = {
    "ast-python": Detector(files=lambda s: [pyast.hits(F.col("rel_path"), F.when(F.col("language") == "python", F.col("content")))]),
    "rule-engine": Detector(lines=_rule_lines, files=_rule_files),
    "secrets": Detector(lines=_secret_lines),
    "dependency": Detector(manifests=_dependencies),
    "iac": Detector(lines=_infra_lines, files=lambda s: [F.when(F.col("iac_kind") == "docker", infra.lacking(F.col("content")))]),
    "license-compliance": Detector(manifests=_licences),
}


def _told(rows: DataFrame, hits: list[tuple[str, Column]], of_files: bool) -> DataFrame:
    """Findings of rows from hits by engine: one HIT or null for each line, arrays of HIT for each file."""
    kind = f"struct<engine:string,h:{detect.HIT}>"
    if of_files:
        named = lambda e, c: F.transform(F.coalesce(c, F.expr(f"cast(array() as array<{detect.HIT}>)")), lambda h: F.struct(F.lit(e).alias("engine"), h.alias("h")).cast(kind))
        all_ = F.concat(*(named(e, c) for e, c in hits))
    else:
        all_ = F.array_compact(F.array(*(F.when(c.isNotNull(), F.struct(F.lit(e).alias("engine"), c.alias("h"))) for e, c in hits)))
    return rows.select("rel_path", F.explode(all_).alias("x")).select("rel_path", "x.engine", "x.h.*")


def _found(files: DataFrame, s: Settings) -> DataFrame:
    chosen = {name: ENGINES[name] for name in s.engines}
    of = lambda part: [(name, c) for name, d in chosen.items() if isinstance(d, Detector) and getattr(d, part) for c in getattr(d, part)(s)]
    slim = files.select("rel_path", "language", "iac_kind", "content")
    parts = []
    if hits := of("lines"):
        lines = detect.exploded(slim.withColumn("_silent", detect.silent_lines(F.col("content"), F.col("language"))), "content")
        heard = ~F.array_contains("_silent", F.col("line").cast("int"))
        known = (F.col("language") != "other") | F.col("iac_kind").isNotNull()
        lines = lines.withColumn("read", heard & (F.char_length("line_text") <= detect.LONGEST_LINE)).withColumn("code", heard & known & ~detect.is_comment(F.col("line_text"), F.col("language")))
        lines = lines.withColumn("random", F.col("read") & detect.is_random(F.col("line_text"), s.entropy_threshold)).drop("_silent")
        parts.append(_told(lines, hits, False))
    if hits := of("files"):
        parts.append(_told(slim, hits, True))
    out = [p.select(*(F.col(n).cast(t).alias(n) if n in p.columns else F.col("rel_path").alias(n) if n == "file_path" else F.lit(None).cast(t).alias(n) for n, t in COLUMNS.items())) for p in parts]
    if asks := [d for d in chosen.values() if isinstance(d, Detector) and d.manifests]:
        rows = work.kept(manifests.parsed(files.where("is_manifest")), "manifests")
        out += [d.manifests(rows, s) for d in asks]
    out += [d(files, s) for d in chosen.values() if not isinstance(d, Detector)]
    found = files.sparkSession.createDataFrame([], SCHEMA)
    for p in out:
        found = found.unionByName(p)
    return found


def run(files: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Findings of all switched-on detectors, each fingerprint once: the first by file, line and rule."""
    found = _found(files.where("content is not null"), settings)
    found = ops.overridden(ops.above_floor(found, settings.min_severity, settings.min_confidence, settings.ignored), settings.overrides)
    found = found.withColumn("fingerprint", T.fingerprint(F.col("rule_id"), F.col("file_path"), F.col("snippet"), F.col("category")))
    return ops.first_of(found, ["fingerprint"], ["file_path", "line", "rule_id", "engine"])


def stats(files: DataFrame, found: DataFrame) -> DataFrame:
    """One row: files_scanned, files_skipped, lines_scanned, n_findings, n of each severity, risk_score, grade."""
    ended = F.regexp_replace("content", r"\r\n", "\n")
    lines = F.when(ended == "", 0).otherwise(F.char_length(ended) - F.char_length(F.replace(ended, F.lit("\n"), F.lit(""))) + F.when(F.endswith(ended, F.lit("\n")), 0).otherwise(1))
    of_files = files.agg(F.count("content").alias("files_scanned"), F.count_if(F.col("content").isNull()).alias("files_skipped"), F.coalesce(F.sum(lines), F.lit(0)).cast("long").alias("lines_scanned"))
    of_found = ops.counts_by_severity(found).withColumn("n_findings", F.expr(" + ".join(S.SEVERITIES)).cast("long"))
    score = F.expr(" + ".join(f"{w} * {s}" for s, w in S.SEVERITIES.items())).cast("long")
    of_found = of_found.withColumn("risk_score", score)
    # one row either side
    return of_files.withColumn("_k", F.lit(1)).join(of_found.withColumn("_k", F.lit(1)), "_k").drop("_k").withColumn("grade", S.grade(F.col("risk_score")))
