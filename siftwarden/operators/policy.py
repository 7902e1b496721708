"""Policies: gates on counts, score, single findings, licences and packages."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwarden.functions import licences as L, severity as S

from .findings import above_floor, counts_by_severity, overridden, risk

# The choices of a policy document.
FAIL_ON, UNKNOWN_LICENCES = (*S.SEVERITIES, "any", "none"), ("warn", "block", "allow")
ENGINES = ("ast-python", "rule-engine", "secrets", "dependency", "iac", "license-compliance")


@dataclass(frozen=True)
class Policy:
    """fail_on: a severity, "any" (all but info) or "none"; gates: how many of a severity are allowed;
    licences: ids by class, none for the defaults; blocked: (ecosystem or *, name, reason), the last of a name counts."""

    fail_on: str = "high"
    gates: dict[str, int] = field(default_factory=dict)
    max_risk: int | None = None
    ignored: tuple[str, ...] = ()
    overrides: dict[str, str] = field(default_factory=dict)
    min_confidence: str = "low"
    licences: dict[str, tuple[str, ...]] | None = None
    unknown_licence: str = "warn"
    blocked: tuple[tuple[str, str, str], ...] = ()
    engines: tuple[str, ...] | None = None
    exclude: tuple[str, ...] = ()
    entropy_threshold: float | None = None

    def problems(self) -> list[str]:
        """All that is wrong with it, not only the first."""
        whole = lambda n: isinstance(n, int) and not isinstance(n, bool)
        out = [f"fail_on: {self.fail_on}"] if self.fail_on not in FAIL_ON else []
        out += [f"gate: {s}" for s in self.gates if s not in S.SEVERITIES]
        out += [f"gate of {s} is no number: {n}" for s, n in self.gates.items() if not whole(n)]
        out += [f"gate of {s} below 0" for s, n in self.gates.items() if whole(n) and n < 0]
        out += [f"max_risk: {self.max_risk}"] if self.max_risk is not None and (not whole(self.max_risk) or self.max_risk < 0) else []
        out += [f"min_confidence: {self.min_confidence}"] if self.min_confidence not in S.CONFIDENCES else []
        out += [f"licences.unknown: {self.unknown_licence}"] if self.unknown_licence not in UNKNOWN_LICENCES else []
        both = set((self.licences or {}).get("allowed", ())) & set((self.licences or {}).get("blocked", ()))
        out += [f"licences both allowed and blocked: {', '.join(sorted(both))}"] if both else []
        out += [f"engine: {e}" for e in self.engines or () if e not in ENGINES]
        out += [f"blocked package without a name, at {k}" for k, b in enumerate(self.blocked) if not b[1]]
        return out + [f"override of {r}: {s}" for r, s in self.overrides.items() if s not in S.SEVERITIES]


def fails(fail_on: str):
    """The predicate on a finding."""
    if fail_on == "none":
        return F.lit(False)
    if fail_on == "any":
        return F.col("severity") != "info"
    return S.rank(F.col("severity")) <= list(S.SEVERITIES).index(fail_on)


def violations(findings: DataFrame, policy: Policy, key: str) -> DataFrame:
    """key, kind, subject, actual, allowed: for each key, gates and cap exceeded and rules that fail."""
    counts = counts_by_severity(findings, key)
    parts = [counts.where(F.col(s) > n).select(key, F.lit("severity_gate").alias("kind"), F.lit(s).alias("subject"), F.col(s).alias("actual"), F.lit(n).cast("long").alias("allowed")) for s, n in policy.gates.items()]
    if policy.max_risk is not None:
        parts.append(risk(findings, key).where(F.col("risk_score") > policy.max_risk).select(key, F.lit("risk_score").alias("kind"), F.lit("total").alias("subject"), F.col("risk_score").alias("actual"), F.lit(policy.max_risk).cast("long").alias("allowed")))
    bad = findings.where(fails(policy.fail_on)).groupBy(key, "rule_id").agg(F.count(F.lit(1)).alias("actual"))
    parts.append(bad.select(key, F.lit("severity").alias("kind"), F.col("rule_id").alias("subject"), "actual", F.lit(0).cast("long").alias("allowed")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def blocked_packages(components: DataFrame, rules: DataFrame) -> DataFrame:
    """Components that a rule (ecosystem or *, name, reason, no) blocks; the last rule of a name wins, its own ecosystem before *."""
    last = rules.groupBy("ecosystem", "name").agg(F.max_by("reason", "no").alias("reason"))
    own = last.where("ecosystem <> '*'").withColumnRenamed("reason", "own_reason")
    every = last.where("ecosystem = '*'").select("name", F.col("reason").alias("any_reason"))
    out = components.join(own, ["ecosystem", "name"], "left").join(every, "name", "left")
    return out.withColumn("reason", F.coalesce("own_reason", "any_reason")).where("reason is not null").drop("own_reason", "any_reason")


def judged(findings: DataFrame, policy: Policy) -> DataFrame:
    """The findings that a policy looks at, with its severities."""
    return overridden(above_floor(findings, "info", policy.min_confidence, policy.ignored), policy.overrides)


#: What a report sorts violations by.
ORDER = ("kind", "rule_id", "file_path", "line", "message")


def evaluated(findings: DataFrame, policy: Policy) -> DataFrame:
    """kind, rule_id, file_path, line, severity, message: every violation of one scan's findings (as `engine.run` gives them).

    Sort by ORDER for a report; the scan passes if there is none.
    """
    seen = judged(findings, policy)
    none = {"rule_id": F.lit(""), "file_path": F.lit(""), "line": F.lit(0).cast("long"), "severity": F.lit("")}
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    shaped = lambda df, kind, message, **own: df.select(F.lit(kind).alias("kind"), *((own | {}).get(c, F.coalesce(F.col(c), none[c]) if c in df.columns else none[c]).alias(c) for c in none), message.alias("message"))
    counts = counts_by_severity(seen)
    parts = [shaped(counts.where(F.col(s) > n).select(F.lit(s).alias("severity"), F.col(s).alias("n")), "severity_gate", text(F.col("n"), f" {s} finding(s) exceed the allowed maximum of {n}")) for s, n in sorted(policy.gates.items())]
    place = text(F.col("rule_id"), " at ", F.col("file_path"), ":", F.col("line"))
    parts.append(shaped(seen.where(fails(policy.fail_on)), "severity", place))
    if policy.max_risk is not None:
        score = seen.agg(F.coalesce(F.sum(S.weight(F.col("severity"))), F.lit(0)).alias("n")).where(F.col("n") > policy.max_risk)
        parts.append(shaped(score, "risk_score", text("risk score ", F.col("n"), f" exceeds policy maximum {policy.max_risk}")))
    licence = F.coalesce("licence", F.lit("UNKNOWN"))
    told = seen.where("category = 'license-compliance'").withColumn("_class", L.classify(licence, policy.licences, policy.unknown_licence))
    parts.append(shaped(told.where("_class = 'blocked'"), "license_blocked", text("blocked license ", licence, " used by ", F.coalesce("package", F.lit("?")))))
    if policy.unknown_licence == "block":
        parts.append(shaped(told.where("_class = 'unknown'"), "license_unknown", text("unknown license for ", F.coalesce("package", F.lit("?")), " and policy blocks unknown licenses")))
    if policy.blocked:
        # a few rules of a document: the last of an ecosystem and name counts
        rules = findings.sparkSession.createDataFrame([(e, n.lower(), r, k) for k, (e, n, r) in enumerate(policy.blocked)], "ecosystem string, name string, reason string, no int")
        deps = seen.where("category in ('vulnerable-dependency', 'license-compliance') and package is not null").withColumns({"ecosystem": F.lower(F.coalesce("ecosystem", F.lit("*"))), "name": F.lower("package")})
        hit = blocked_packages(deps, rules)
        first = hit.groupBy("ecosystem", "name").agg(F.min(F.struct("rule_id", "file_path", "line", "severity", "reason")).alias("_x")).select("ecosystem", "name", "_x.*")
        parts.append(shaped(first, "blocked_dependency", text("package ", F.col("name"), " (", F.col("ecosystem"), ") is blocked by policy", F.when(F.col("reason") == "", "").otherwise(F.concat(F.lit(": "), "reason")))))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
