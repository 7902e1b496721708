"""Findings and inventories as documents and lines.

Rows become JSON, XML or text pieces in Column expressions; a whole document is then a header, the ordered
pieces and a footer, so that writing one needs no more than a row at a time on the driver.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwarden.functions import licences as L, severity as S, text as T
from siftwarden.operators.findings import canonical_order

# SARIF's level of each severity.
LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}
TOP = 50


def _level(severity: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in LEVELS.items() for x in pair))[severity]


def sarif_results(findings: DataFrame, *more: str) -> DataFrame:
    """A SARIF 2.1.0 result as JSON for each finding (column piece), with what orders it."""
    region = F.struct(F.greatest(F.lit(1), F.col("line")).alias("startLine"))
    place = F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule_id").alias("ruleId"), _level(F.col("severity")).alias("level"), F.struct(F.col("snippet").alias("text")).alias("message"), F.array(place).alias("locations"), F.struct(F.col("fingerprint").alias("primary")).alias("partialFingerprints"))
    return findings.select("severity", "file_path", "line", "rule_id", F.to_json(result).alias("piece"), *more)


def sarif(findings: DataFrame, tool: str) -> Iterator[str]:
    """Rules come in the order in which the results name them first."""
    first = findings.groupBy("rule_id").agg(F.min(F.struct(S.rank(F.col("severity")).alias("rank"), "file_path", "line", "severity")).alias("x")).select("rule_id", "x.*").orderBy("rank", "file_path", "line", "rule_id")
    yield f'{{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":{json.dumps(tool)},"rules":['
    for k, r in enumerate(first.toLocalIterator()):
        yield "," * (k > 0) + json.dumps({"id": r.rule_id, "defaultConfiguration": {"level": LEVELS[r.severity]}})
    yield ']}},"results":['
    yield from _joined(sarif_results(findings).orderBy(*canonical_order("rule_id")).select("piece"))
    yield "]}]}"


def finding_pieces(findings: DataFrame, *more: str) -> DataFrame:
    """A finding as JSON, with what sorts it: severity, file_path, line, rule_id, piece, and the columns that are asked for."""
    place = F.struct("file_path", F.col("line").alias("start_line"), F.coalesce("end_line", "line").alias("end_line") if "end_line" in findings.columns else F.col("line").alias("end_line"), "snippet")
    one = F.struct("rule_id", "severity", "confidence", "category", place.alias("location"), "fingerprint")
    return findings.select("severity", "file_path", "line", "rule_id", F.to_json(one).alias("piece"), *more)


def report(findings: DataFrame, stats: DataFrame, target: str) -> Iterator[str]:
    """The JSON report: sums of a run (one row, as `engine.stats` gives it) and findings in report order."""
    n = stats.first().asDict()
    head = {"target": target, "stats": {k: n[k] for k in ("files_scanned", "files_skipped", "lines_scanned")}, "risk_score": n["risk_score"], "risk_score_capped": min(S.SCORE_CAP, n["risk_score"]), "grade": n["grade"], "severity_counts": {s: n[s] for s in S.SEVERITIES}, "total_findings": n["n_findings"]}
    yield json.dumps(head)[:-1] + ',"findings":['
    for k, r in enumerate(finding_pieces(findings).orderBy(*canonical_order("rule_id")).select("piece").toLocalIterator()):
        yield "," * (k > 0) + r.piece
    yield "]}"


def baseline_entries(findings: DataFrame, now: Column, reason: str = "", days: int | None = None, by: str = "", force: bool = False) -> DataFrame:
    """An entry for each fingerprint, of its first finding by file and rule.

    Critical findings want a reason, unless that is forced: ValueError otherwise.
    """
    if not reason and not force and not findings.where("severity = 'critical'").isEmpty():
        raise ValueError("critical findings are accepted with a reason only")
    first = findings.groupBy("fingerprint").agg(F.min(F.struct(F.col("file_path").alias("file"), "rule_id", "line", "severity")).alias("x")).select("fingerprint", "x.*")
    ends = now + F.make_dt_interval(days=F.lit(days)) if days else F.lit(None).cast("timestamp")
    return first.select("fingerprint", "rule_id", "file", "line", "severity", F.lit(reason).alias("reason"), now.cast("timestamp").alias("created_at"), ends.cast("timestamp").alias("expires_at"), F.lit(by).alias("created_by"))


def baseline(entries: DataFrame) -> Iterator[str]:
    """The newer form of a baseline file, entries by file, rule and fingerprint."""
    yield f'{{"schema_version":2,"count":{entries.count()},"entries":['
    for k, r in enumerate(entries.orderBy("file", "rule_id", "fingerprint").select(F.to_json(F.struct(*entries.columns)).alias("piece")).toLocalIterator()):
        yield "," * (k > 0) + r.piece
    yield "]}"


def junit_cases(findings: DataFrame) -> DataFrame:
    name = F.concat_ws(" ", "rule_id", F.concat_ws(":", "file_path", F.col("line").cast("string")))
    fail = F.concat(F.lit('<failure type="'), F.col("severity"), F.lit('">'), T.xml_safe(F.col("snippet")), F.lit("</failure>"))
    piece = F.concat(F.lit('<testcase name="'), T.xml_safe(name), F.lit('">'), F.when(F.col("severity") != "info", fail).otherwise(""), F.lit("</testcase>"))
    return findings.orderBy(*canonical_order("rule_id")).select(piece.alias("piece"))


def junit(findings: DataFrame, name: str) -> Iterator[str]:
    n = findings.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") != "info").alias("bad")).first()
    yield f'<testsuite name="{escape(name)}" tests="{max(1, n.n)}" failures="{n.bad}">'
    for r in junit_cases(findings).toLocalIterator():
        yield r.piece
    yield "</testsuite>" if n.n else '<testcase name="no findings"/></testsuite>'


def markdown(findings: DataFrame, top: int = TOP) -> Iterator[str]:
    total = findings.count()
    yield "| severity | rule | place | text |"
    yield "|---|---|---|---|"
    cell = lambda c: F.replace(F.replace(F.col(c), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "severity", "rule_id", F.concat_ws(":", cell("file_path"), F.col("line").cast("string")), cell("snippet")), F.lit(" |"))
    for r in findings.orderBy(*canonical_order("rule_id")).limit(top).select(line.alias("piece")).toLocalIterator():
        yield r.piece
    if total > top:
        yield f"\n{total - top} more."


def html(findings: DataFrame, title: str) -> Iterator[str]:
    yield f"<!doctype html><title>{escape(title)}</title><table>"
    cells = F.concat(*(F.concat(F.lit("<td>"), T.xml_safe(F.col(c).cast("string")), F.lit("</td>")) for c in ("severity", "rule_id", "file_path", "line", "snippet")))
    for r in findings.orderBy(*canonical_order("rule_id")).select(F.concat(F.lit("<tr>"), cells, F.lit("</tr>")).alias("piece")).toLocalIterator():
        yield r.piece
    yield "</table>"


# The package URL type of each ecosystem, others are generic; those whose names have a namespace.
PURL_TYPES = {"python": "pypi", "javascript": "npm", "npm": "npm", "go": "golang", "maven": "maven", "java": "maven", "ruby": "gem", "php": "composer", "rust": "cargo", "nuget": "nuget"}
ROOT = "root-component"


def purl(ecosystem: Column, name: Column, version: Column) -> Column:
    """A package URL: slashes of a name part its namespace; what a URL has other uses for is escaped."""
    kind = F.coalesce(F.create_map(*(F.lit(x) for pair in PURL_TYPES.items() for x in pair))[ecosystem], F.lit("generic"))
    for raw, safe in (("%", "%25"), ("#", "%23"), ("?", "%3F"), (" ", "%20"), ("@", "%40")):
        name = F.replace(name, F.lit(raw), F.lit(safe))
    name = F.when(kind == "maven", F.replace(name, F.lit(":"), F.lit("/"))).otherwise(name)
    return F.concat(F.lit("pkg:"), kind, F.lit("/"), name, F.lit("@"), version)


def cyclonedx_components(components: DataFrame, *more: str) -> DataFrame:
    """A CycloneDX component as JSON (column piece) for each component (ecosystem, name, version, purl, licence); in report order, or with what orders it and the columns that are asked for."""
    known = F.col("licence") != "UNKNOWN"
    license_ = lambda x: F.struct(F.struct(x.alias("id")).alias("license"))
    told = F.when(known & L.readable(F.col("licence")) & (F.size(L.ids(F.col("licence"))) > 1) & F.col("licence").rlike(r"(?i)\sor\s|[/,]"), F.transform(L.ids(F.col("licence")), license_)).when(known, F.array(license_(F.col("licence"))))
    one = F.struct(F.lit("library").alias("type"), F.col("purl").alias("bom-ref"), "name", "version", "purl", told.alias("licenses"))
    if more:
        return components.select("ecosystem", "name", "version", F.to_json(one).alias("piece"), *more)
    return components.orderBy("ecosystem", F.lower("name"), "version").select(F.to_json(one).alias("piece"))


def cyclonedx_vulnerabilities(findings: DataFrame, components: DataFrame, target: str | Column, *more: str, by: str | None = None) -> DataFrame:
    """A CycloneDX vulnerability as JSON for each finding; `affects` names its package where the inventory has it (column purl, null for none).

    by: a column of both that names the inventory, where there are several.
    """
    same = ["purl"] + ([by] if by else [])
    held = components.select(*same).distinct().withColumn("_held", F.lit(True))
    target = F.lit(target) if isinstance(target, str) else target
    id_ = F.concat(F.lit("FINDING-"), F.upper(F.substring(F.sha2(F.concat_ws("|", target, "fingerprint"), 256), 1, 12)))
    affects = F.when(F.col("_held"), F.array(F.struct(F.col("purl").alias("ref")))).otherwise(F.expr("cast(array() as array<struct<ref:string>>)"))
    named = lambda k, c: F.struct(F.lit(k).alias("name"), c.cast("string").alias("value"))
    properties = F.array(named("rule-id", F.col("rule_id")), named("category", F.col("category")), named("confidence", F.col("confidence")), named("fingerprint", F.col("fingerprint")), named("file", F.col("file_path")), named("line", F.col("line")))
    one = F.struct(id_.alias("id"), F.array(F.struct("severity", F.lit("other").alias("method"))).alias("ratings"), affects.alias("affects"), properties.alias("properties"))
    return findings.join(held, same, "left").select("severity", "file_path", "line", "rule_id", F.to_json(one).alias("piece"), *more)


def _serial(components: DataFrame, name: str) -> str:
    """A name-based UUID of all package URLs in order, read one at a time."""
    digest = hashlib.sha256(name.encode())
    for r in components.orderBy("ecosystem", F.lower("name"), "version").select("purl").toLocalIterator():
        digest.update(b"|" + r.purl.encode())
    return str(uuid.uuid5(uuid.NAMESPACE_DNS, digest.hexdigest()))


def _joined(pieces: DataFrame) -> Iterator[str]:
    for k, r in enumerate(pieces.toLocalIterator()):
        yield "," * (k > 0) + r.piece


def cyclonedx(components: DataFrame, findings: DataFrame | None = None, name: str = "project", at: str | None = None) -> Iterator[str]:
    """CycloneDX 1.5: components, the root's dependencies, and findings (with purl) as vulnerabilities."""
    meta = {"component": {"type": "application", "bom-ref": ROOT, "name": name}} | ({"timestamp": at} if at else {})
    yield f'{{"bomFormat":"CycloneDX","specVersion":"1.5","serialNumber":"urn:uuid:{_serial(components, name)}","version":1,"metadata":{json.dumps(meta)},"components":['
    yield from _joined(cyclonedx_components(components))
    yield f'],"dependencies":[{{"ref":"{ROOT}","dependsOn":['
    refs = components.orderBy("ecosystem", F.lower("name"), "version")
    yield from _joined(refs.select(F.to_json(F.array("purl")).alias("piece")).select(F.expr("substring(piece, 2, length(piece) - 2)").alias("piece")))
    yield "]}"
    for r in refs.select(F.to_json(F.struct(F.col("purl").alias("ref"), F.expr("cast(array() as array<string>)").alias("dependsOn"))).alias("piece")).toLocalIterator():
        yield "," + r.piece
    yield "]"
    if findings is not None:
        yield ',"vulnerabilities":['
        yield from _joined(cyclonedx_vulnerabilities(findings, components, name).orderBy(*canonical_order("rule_id")).select("piece"))
        yield "]"
    yield "}"


def _spdx_id(purl_: Column) -> Column:
    return F.concat(F.lit("SPDXRef-"), F.substring(F.sha2(purl_, 256), 1, 16))


def spdx_packages(components: DataFrame) -> DataFrame:
    none = lambda c: F.lit("NOASSERTION").alias(c)
    ref = F.array(F.struct(F.lit("PACKAGE-MANAGER").alias("referenceCategory"), F.lit("purl").alias("referenceType"), F.col("purl").alias("referenceLocator")))
    declared = F.when(L.readable(F.col("licence")), F.col("licence")).otherwise("NOASSERTION")
    one = F.struct(_spdx_id(F.col("purl")).alias("SPDXID"), "name", F.col("version").alias("versionInfo"), none("downloadLocation"), F.lit(False).alias("filesAnalyzed"), none("licenseConcluded"), declared.alias("licenseDeclared"), none("copyrightText"), F.lit("LIBRARY").alias("primaryPackagePurpose"), ref.alias("externalRefs"))
    return components.orderBy("ecosystem", F.lower("name"), "version").select(F.to_json(one).alias("piece"))


def spdx_relationships(components: DataFrame, root: str) -> DataFrame:
    one = F.struct(F.lit(root).alias("spdxElementId"), F.lit("DEPENDS_ON").alias("relationshipType"), _spdx_id(F.col("purl")).alias("relatedSpdxElementId"))
    return components.orderBy("ecosystem", F.lower("name"), "version").select(F.to_json(one).alias("piece"))


def spdx(components: DataFrame, name: str, at: str = "1970-01-01T00:00:00Z") -> Iterator[str]:
    """SPDX 2.3: the project, its packages, and what describes and depends on what."""
    root = f"SPDXRef-Root-{hashlib.sha256(name.encode()).hexdigest()[:12]}"
    head = {"spdxVersion": "SPDX-2.3", "dataLicense": "CC0-1.0", "SPDXID": "SPDXRef-DOCUMENT", "name": name, "documentNamespace": f"urn:uuid:{_serial(components, name)}", "creationInfo": {"created": at, "creators": ["Tool: siftwarden"]}, "documentDescribes": [root]}
    top = {"SPDXID": root, "name": name, "downloadLocation": "NOASSERTION", "filesAnalyzed": False, "licenseConcluded": "NOASSERTION", "licenseDeclared": "NOASSERTION", "primaryPackagePurpose": "APPLICATION"}
    yield json.dumps(head)[:-1] + ',"packages":[' + json.dumps(top)
    for r in spdx_packages(components).toLocalIterator():
        yield "," + r.piece
    yield '],"relationships":[' + json.dumps({"spdxElementId": "SPDXRef-DOCUMENT", "relationshipType": "DESCRIBES", "relatedSpdxElementId": root})
    for r in spdx_relationships(components, root).toLocalIterator():
        yield "," + r.piece
    yield "]}"


def inventory_problems(components: DataFrame, edges: DataFrame) -> DataFrame:
    """What is wrong with an inventory: purls that repeat, and edges (purl, needs) whose ends aren't in it."""
    twice = components.groupBy("purl").count().where("count > 1").select(F.lit("duplicate").alias("problem"), "purl")
    ends = edges.select(F.explode(F.array("purl", "needs")).alias("purl")).distinct()
    return twice.unionByName(ends.join(components, "purl", "left_anti").select(F.lit("dangling").alias("problem"), "purl"))


def prometheus_head(name: str, kind: str, help_: str) -> list[str]:
    """The lines before those of a metric; kind: counter, gauge or histogram."""
    return [f"# HELP {name} {help_}".replace("\n", " "), f"# TYPE {name} {kind}"]


def prometheus(df: DataFrame, name: str, labels: list[str], value: str) -> DataFrame:
    """Lines of the text format: name{label="value"} number."""
    told = F.concat_ws(",", *(F.concat(F.lit(f'{c}="'), T.label_value(F.col(c).cast("string")), F.lit('"')) for c in labels))
    return df.select(F.concat(F.lit(f"{name}{{"), told, F.lit("} "), F.col(value).cast("string")).alias("line"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Text cells that look like formulas are guarded."""
    df.select(*(T.csv_safe(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes)).write.csv(path, header=True)


def write_table(df: DataFrame, path: str, by: str = "org_id") -> None:
    """Parquet, appended, by tenant."""
    df.write.mode("append").partitionBy(by).parquet(path)


def save(pieces: Iterator[str], path: str) -> None:
    with open(path, "w") as f:
        f.writelines(p + "\n" for p in pieces)
