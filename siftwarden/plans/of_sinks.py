"""Report pieces as text: what each row of a document is, held against SQL that builds the same JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwarden.operators import policy as P
from siftwarden.sinks import grouped, render
from siftwarden.sources import feeds

from .of_supply import COMPONENT, FEED, _feed, components
from .registry import query
from .standins import COUNTS, FINDING, GRADE, RANK, WEIGHT, findings, read, scans, tasks

def _found(spark: SparkSession, sf_dir: str, by: str | None = None) -> DataFrame:
    return findings(spark, sf_dir, by).withColumn("category", F.lit("code"))


@query(f"""WITH {FINDING} SELECT scan_id, part, supp, line, to_json({{'rule_id': rule_id, 'severity': severity, 'confidence': confidence, 'category': 'code', 'location': {{'file_path': file_path, 'start_line': line, 'end_line': line, 'snippet': snippet}}, 'fingerprint': fingerprint}})::VARCHAR AS piece FROM finding""")
def sink_report_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON report's findings."""
    return render.finding_pieces(_found(spark, sf_dir), "scan_id", "part", "supp").select("scan_id", "part", "supp", "line", "piece")


@query(f"""WITH {FINDING} SELECT fingerprint, arg_min(rule_id, (file_path, rule_id, line, severity)) AS rule_id, min(file_path) AS file, arg_min(line, (file_path, rule_id, line, severity)) AS line, arg_min(severity, (file_path, rule_id, line, severity)) AS severity, 'accepted' AS reason, 'me' AS created_by,
  TIMESTAMP '2024-01-01' AS created_at, TIMESTAMP '2024-01-31' AS expires_at FROM finding GROUP BY fingerprint""")
def sink_baseline_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of a baseline of all findings."""
    out = render.baseline_entries(_found(spark, sf_dir), F.lit("2024-01-01 00:00:00").cast("timestamp"), "accepted", 30, "me")
    return out.withColumns({c: F.to_timestamp_ntz(F.date_format(c, "yyyy-MM-dd HH:mm:ss")) for c in ("created_at", "expires_at")})


_PURL = "'pkg:' || CASE ecosystem WHEN 'python' THEN 'pypi' WHEN 'npm' THEN 'npm' ELSE 'golang' END || '/' || replace(lower(name), '#', '%23') || '@' || version"
INVENTORY = f"{COMPONENT}, inv AS (SELECT ecosystem, lower(name) AS name, version, {_PURL} AS purl, min(CASE WHEN licence = 'Custom' THEN 'UNKNOWN' ELSE licence END) AS licence FROM component GROUP BY 1, 2, 3, 4)"


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.lower("name")
    licence = F.min(F.when(F.col("licence") == "Custom", "UNKNOWN").otherwise(F.col("licence"))).alias("licence")
    return components(spark, sf_dir).groupBy("ecosystem", name.alias("name"), "version").agg(licence).withColumn("purl", render.purl(F.col("ecosystem"), F.col("name"), F.col("version")))


@query(f"""WITH {INVENTORY} SELECT '{{"type":"library","bom-ref":"' || purl || '","name":"' || name || '","version":"' || version || '","purl":"' || purl || '"' || CASE licence WHEN 'UNKNOWN' THEN '' WHEN 'MIT OR GPL-2.0' THEN ',"licenses":[{{"license":{{"id":"MIT"}}}},{{"license":{{"id":"GPL-2.0"}}}}]' ELSE ',"licenses":[{{"license":{{"id":"' || licence || '"}}}}]' END || '}}' AS piece FROM inv""")
def sink_cyclonedx_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.cyclonedx_components(inventory(spark, sf_dir))


@query(f"""WITH {INVENTORY} SELECT '{{"SPDXID":"SPDXRef-' || substr(sha256(purl), 1, 16) || '","name":"' || name || '","versionInfo":"' || version || '","downloadLocation":"NOASSERTION","filesAnalyzed":false,"licenseConcluded":"NOASSERTION","licenseDeclared":"' || CASE licence WHEN 'UNKNOWN' THEN 'NOASSERTION' ELSE licence END ||
  '","copyrightText":"NOASSERTION","primaryPackagePurpose":"LIBRARY","externalRefs":[{{"referenceCategory":"PACKAGE-MANAGER","referenceType":"purl","referenceLocator":"' || purl || '"}}]}}' AS piece FROM inv""")
def sink_spdx_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.spdx_packages(inventory(spark, sf_dir))


@query(f"""WITH {FINDING}, {COMPONENT}, inv AS (SELECT DISTINCT {_PURL} AS purl FROM component WHERE p_partkey % 2 = 0), f AS (SELECT finding.*, {_PURL} AS purl FROM finding JOIN component ON part = p_partkey)
  SELECT scan_id, line, to_json({{'id': 'FINDING-' || upper(substr(sha256('project|' || fingerprint), 1, 12)), 'ratings': [{{'severity': severity, 'method': 'other'}}], 'affects': CASE WHEN inv.purl IS NULL THEN [] ELSE [{{'ref': f.purl}}] END,
    'properties': [{{'name': 'rule-id', 'value': rule_id}}, {{'name': 'category', 'value': 'code'}}, {{'name': 'confidence', 'value': confidence}}, {{'name': 'fingerprint', 'value': fingerprint}}, {{'name': 'file', 'value': file_path}}, {{'name': 'line', 'value': line::VARCHAR}}]}})::VARCHAR AS piece FROM f LEFT JOIN inv USING (purl)""")
def sink_cyclonedx_vulnerabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings, each naming its part's package if the inventory, half the parts, has it."""
    parts = components(spark, sf_dir).withColumn("purl", render.purl(F.col("ecosystem"), F.lower("name"), F.col("version")))
    found = _found(spark, sf_dir).join(parts.select(F.col("p_partkey").alias("part"), "purl"), "part")
    out = render.cyclonedx_vulnerabilities(found, parts.where("p_partkey % 2 = 0"), "project", "scan_id")
    return out.select("scan_id", "line", "piece")


@query(f"WITH {FEED} SELECT ecosystem, CAST(count(DISTINCT package) AS BIGINT) AS packages, CAST(count(*) AS BIGINT) AS advisories, CAST(count(cve) AS BIGINT) AS with_cve, CAST(count(*) FILTER (WHERE source_no = 1) AS BIGINT) AS with_fix FROM feed GROUP BY ecosystem")
def advisory_import_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.import_stats(_feed(spark, sf_dir).withColumn("fixed_in", F.when(F.col("source_no") == 1, "1.0")))


#: A policy over all findings: each branch but unknown licences has something to say.
POLICY = P.Policy(fail_on="critical", gates={"medium": 10}, max_risk=1_000, ignored=("RULE-A1",), min_confidence="medium", overrides={"RULE-N2": "low"}, licences={"blocked": ("GPL-3.0",), "allowed": ("MIT",)}, blocked=(("*", "Brand#11", "old"), ("python", "brand#11", "worse"), ("go", "brand#22", "")))


@query(f"""WITH {FINDING}, {COMPONENT}, f AS (
    SELECT rule_id, CASE rule_id WHEN 'RULE-N2' THEN 'low' ELSE severity END AS severity, file_path, line, 'code' AS category, NULL AS licence, NULL AS package, NULL AS ecosystem FROM finding WHERE confidence <> 'low' AND rule_id <> 'RULE-A1'
    UNION ALL SELECT 'LICENSE', 'low', 'parts.txt', p_partkey, 'license-compliance', licence, name, ecosystem FROM component)
  SELECT 'severity_gate' AS kind, '' AS rule_id, '' AS file_path, CAST(0 AS BIGINT) AS line, 'medium' AS severity, count(*) || ' medium finding(s) exceed the allowed maximum of 10' AS message FROM f WHERE severity = 'medium' HAVING count(*) > 10
  UNION ALL SELECT 'severity', rule_id, file_path, line, severity, rule_id || ' at ' || file_path || ':' || line FROM f WHERE {RANK} <= 0
  UNION ALL SELECT 'risk_score', '', '', 0, '', 'risk score ' || CAST(sum({WEIGHT}) AS BIGINT) || ' exceeds policy maximum 1000' FROM f HAVING sum({WEIGHT}) > 1000
  UNION ALL SELECT 'license_blocked', rule_id, file_path, line, severity, 'blocked license ' || licence || ' used by ' || package FROM f WHERE licence = 'GPL-3.0'
  UNION ALL SELECT 'blocked_dependency', 'LICENSE', 'parts.txt', min(line), 'low', 'package ' || lower(package) || ' (' || ecosystem || ') is blocked by policy' || CASE WHEN ecosystem = 'go' AND lower(package) = 'brand#22' THEN '' WHEN ecosystem = 'python' THEN ': worse' ELSE ': old' END
    FROM f WHERE lower(package) = 'brand#11' OR (lower(package) = 'brand#22' AND ecosystem = 'go') GROUP BY ecosystem, lower(package)""")
def policy_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All branches of a policy over all findings and over all parts as licence findings."""
    found = _found(spark, sf_dir).select("rule_id", "severity", "confidence", "category", "file_path", "line", *(F.lit(None).cast("string").alias(c) for c in ("licence", "package", "ecosystem")))
    parts = components(spark, sf_dir).select(F.lit("LICENSE").alias("rule_id"), F.lit("low").alias("severity"), F.lit("high").alias("confidence"), F.lit("license-compliance").alias("category"), F.lit("parts.txt").alias("file_path"), F.col("p_partkey").cast("long").alias("line"), "licence", F.col("name").alias("package"), "ecosystem")
    return P.evaluated(found.unionByName(parts), POLICY)


_LEVEL = "CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END"
_RESULT = f"""to_json({{'ruleId': rule_id, 'level': {_LEVEL}, 'message': {{'text': snippet}}, 'locations': [{{'physicalLocation': {{'artifactLocation': {{'uri': file_path}}, 'region': {{'startLine': greatest(1, line)}}}}}}], 'partialFingerprints': {{'primary': fingerprint}}}})"""


@query(f"""WITH {FINDING}, f AS (SELECT *, {RANK} AS rank, {_RESULT}::VARCHAR AS piece FROM finding), rule AS (SELECT scan_id, rule_id, min((rank, file_path, line)) AS place, arg_min(severity, (rank, file_path, line)) AS severity FROM f GROUP BY scan_id, rule_id),
  rules AS (SELECT scan_id, string_agg('{{"id":"' || rule_id || '","defaultConfiguration":{{"level":"' || {_LEVEL} || '"}}}}', ',' ORDER BY place, rule_id) AS rules FROM rule GROUP BY scan_id),
  results AS (SELECT scan_id, string_agg(piece, ',' ORDER BY rank, file_path, line, rule_id, piece) AS results FROM f GROUP BY scan_id)
  SELECT scan_id, '{{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"siftwarden","rules":[' || coalesce(rules, '') || ']}}}},"results":[' || coalesce(results, '') || ']}}]}}' AS document
  FROM scan LEFT JOIN rules USING (scan_id) LEFT JOIN results USING (scan_id)""")
def sink_sarif_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A SARIF document for each scan, those that found nothing included."""
    return grouped.documents(grouped.sarif(_found(spark, sf_dir), "scan_id", "siftwarden", scans(spark, sf_dir)), "scan_id", tasks(spark, sf_dir))


@query(f"""WITH {FINDING}, c AS (SELECT project_id, {COUNTS}, count(*) AS n, CAST(sum({WEIGHT}) AS BIGINT) AS risk_score FROM finding GROUP BY project_id),
  f AS (SELECT project_id, string_agg(piece, ',' ORDER BY rank, file_path, line, rule_id, piece) AS found FROM (SELECT project_id, {RANK} AS rank, file_path, line, rule_id,
    to_json({{'rule_id': rule_id, 'severity': severity, 'confidence': confidence, 'category': 'code', 'location': {{'file_path': file_path, 'start_line': line, 'end_line': line, 'snippet': snippet}}, 'fingerprint': fingerprint}})::VARCHAR AS piece FROM finding) GROUP BY project_id)
  SELECT project_id, '{{"risk_score":' || risk_score || ',"grade":"' || {GRADE} || '","severity_counts":{{"critical":' || critical || ',"high":' || high || ',"medium":' || medium || ',"low":' || low || ',"info":' || info || '}},"total_findings":' || n || ',"findings":[' || found || ']}}' AS document FROM c JOIN f USING (project_id)""")
def sink_report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON report for each project."""
    return grouped.report_documents(_found(spark, sf_dir, "project_id"), "project_id")


#: A project's components: the parts that its orders name.
USED = f"""{COMPONENT}, used AS (SELECT DISTINCT o_custkey AS project_id, ecosystem, lower(name) AS name, version, {_PURL} AS purl FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN component ON l_partkey = p_partkey)"""


def _used(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("project_id"))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(orders, "l_orderkey")
    parts = components(spark, sf_dir).select("p_partkey", "ecosystem", F.lower("name").alias("name"), "version")
    used = rows.join(parts, "p_partkey").select("project_id", "ecosystem", "name", "version").distinct()
    return used.withColumn("purl", render.purl(F.col("ecosystem"), F.col("name"), F.col("version")))


@query(f"""WITH {USED}, d AS (SELECT project_id, sha256('project ' || project_id || '|' || string_agg(purl, '|' ORDER BY ecosystem, name, version)) AS digest FROM used GROUP BY project_id),
  h AS (SELECT *, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || digest::BLOB) AS s FROM d)
  SELECT project_id, digest, s[1:8] || '-' || s[9:12] || '-5' || s[14:16] || '-' || substr('89ab', CAST(1 + (strpos('0123456789abcdef', s[17:17]) - 1) % 4 AS INTEGER), 1) || s[18:20] || '-' || s[21:32] AS serial FROM h""")
def sink_serials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest and serial number of every project's inventory at once."""
    return grouped.serials(_used(spark, sf_dir), "project_id", F.concat(F.lit("project "), F.col("project_id").cast("string")))
