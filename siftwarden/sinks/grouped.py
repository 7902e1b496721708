"""One document for each group (a scan, a project), made and written by tasks.

A document is pieces with a place: its part (head, a list, what stands between, another list, foot) and an order within the part.
`documents` puts a group's pieces together in one row, which wants documents that fit one; they are dealt once, by their group.
`write` deals pieces out by ranges of group and place, and its files, one after the other, are the documents, whatever their size: pieces
get their commas by what is first in their part, so any task can write any stretch of a document.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwarden.functions import severity as S, text as T

from .render import LEVELS, ROOT, cyclonedx_components, cyclonedx_vulnerabilities, finding_pieces, sarif_results

HEAD, FIRST, BETWEEN, SECOND, FOOT = range(5)
LISTS = (FIRST, SECOND)
#: What orders pieces of a list before they do so themselves: a rank, texts and a number, as far as there are any.
PLACE = "struct<rank:int,text:string,number:bigint,more:string>"


def _place(rank: Column, text: Column, number: Column, more: Column) -> Column:
    return F.struct(rank.cast("int").alias("rank"), text.alias("text"), number.cast("long").alias("number"), more.alias("more")).alias("place")


def listed(rows: DataFrame, key: str, part: int) -> DataFrame:
    """(key, part, place, piece) of rows (key, place, piece); pieces that are alike stay as many."""
    return rows.select(key, F.lit(part).alias("part"), "place", "piece")


def fixed(keys: DataFrame, key: str, pieces: dict[int, Column]) -> DataFrame:
    """Pieces that each group has once, by their part."""
    each = F.array(*(F.struct(F.lit(part).alias("part"), F.lit(None).cast(PLACE).alias("place"), piece.alias("piece")) for part, piece in pieces.items()))
    return keys.select(key, F.inline(each))


def documents(pieces: DataFrame, key: str, tasks: int | None = None) -> DataFrame:
    """(key, document); made by so many tasks, or by what the session says."""
    if tasks:
        pieces = pieces.repartition(tasks, key)
    whole = F.sort_array(F.collect_list(F.struct("part", "place", "piece")))
    of_part = lambda part: F.array_join(F.transform(F.filter("all", lambda x: x["part"] == part), lambda x: x["piece"]), "," if part in LISTS else "")
    return pieces.groupBy(key).agg(whole.alias("all")).select(key, F.concat(*map(of_part, range(FOOT + 1))).alias("document"))


def _with_commas(pieces: DataFrame, key: str) -> DataFrame:
    """Each piece of a list but its first behind a comma; pieces that are alike become one row."""
    many = pieces.groupBy(key, "part", "place", "piece").agg(F.count(F.lit(1)).alias("n"))
    first = many.where(F.col("part").isin(*LISTS)).groupBy(F.col(key).alias("_key"), F.col("part").alias("_part")).agg(F.min(F.struct("place", "piece")).alias("_first"))
    comma = F.when(F.col("_first").isNull() | (F.struct("place", "piece") == F.col("_first")), "").otherwise(",")
    piece = F.concat(comma, F.array_join(F.array_repeat("piece", F.col("n").cast("int")), ","))
    return many.join(first, F.col(key).eqNullSafe(F.col("_key")) & (F.col("part") == F.col("_part")), "left").select(key, "part", "place", F.col("piece").alias("_tie"), piece.alias("piece"))


def write(pieces: DataFrame, key: str, path: str, files: int) -> None:
    """Text files, each a range of groups and places and a line for each piece; in the order of their names they hold one document after the other."""
    order = [key, "part", "place", "_tie"]
    _with_commas(pieces, key).repartitionByRange(files, *order).sortWithinPartitions(*order).select("piece").write.text(path)


def sarif(findings: DataFrame, key: str, tool: str, keys: DataFrame | None = None) -> DataFrame:
    """Pieces of a SARIF 2.1.0 document for each group, rules in the order in which its results name them first; keys: groups, also those without findings."""
    keys = (findings if keys is None else keys).select(key).distinct()
    level = F.create_map(*(F.lit(x) for pair in LEVELS.items() for x in pair))
    rank = S.rank(F.col("severity"))
    first = findings.groupBy(key, "rule_id").agg(F.min(F.struct(rank.alias("rank"), "file_path", "line", "severity")).alias("x"))
    rule = F.to_json(F.struct(F.col("rule_id").alias("id"), F.struct(level[F.col("x.severity")].alias("level")).alias("defaultConfiguration")))
    rules = first.select(key, _place(F.col("x.rank"), F.col("x.file_path"), F.col("x.line"), F.col("rule_id")), rule.alias("piece"))
    results = sarif_results(findings, key).select(key, _place(rank, F.col("file_path"), F.col("line"), F.col("rule_id")), "piece")
    head = f'{{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":{json.dumps(tool)},"rules":['
    told = fixed(keys, key, {HEAD: F.lit(head), BETWEEN: F.lit(']}},"results":['), FOOT: F.lit("]}]}")})
    return told.unionByName(listed(rules, key, FIRST)).unionByName(listed(results, key, SECOND))


def _sums() -> list[Column]:
    """What a report's head tells of its findings."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in S.SEVERITIES]
    return [F.count(F.lit(1)).alias("total_findings"), F.sum(S.weight(F.col("severity"))).cast("long").alias("risk_score"), *counts]


def _head() -> Column:
    """A report up to its findings, of their sums."""
    told = F.to_json(F.struct("risk_score", S.grade(F.col("risk_score")).alias("grade"), F.struct(*S.SEVERITIES).alias("severity_counts"), "total_findings"))
    return F.concat(F.left(told, F.length(told) - 1), F.lit(',"findings":['))


def _reported(findings: DataFrame, key: str) -> DataFrame:
    """A report's findings in their place, with what its sums want."""
    return finding_pieces(findings, key).select(key, "severity", _place(S.rank(F.col("severity")), F.col("file_path"), F.col("line"), F.col("rule_id")), "piece")


def report(findings: DataFrame, key: str) -> DataFrame:
    """Pieces of a JSON report for each group: counts, risk and findings in report order."""
    sums = findings.groupBy(key).agg(*_sums())
    return fixed(sums, key, {HEAD: _head(), FOOT: F.lit("]}")}).unionByName(listed(_reported(findings, key), key, FIRST))


def report_documents(findings: DataFrame, key: str) -> DataFrame:
    """(key, document), as `documents` makes of `report`'s pieces; findings are read once, since sums are made where a group's findings meet, and findings that are dealt by the key aren't dealt again."""
    whole = F.sort_array(F.collect_list(F.struct("place", "piece")))
    found = F.array_join(F.transform("all", lambda x: x["piece"]), ",")
    return _reported(findings, key).groupBy(key).agg(whole.alias("all"), *_sums()).select(key, F.concat(_head(), found, F.lit("]}")).alias("document"))


def serials(components: DataFrame, key: str, name: Column) -> DataFrame:
    """(key, digest, serial) of each group's components (ecosystem, name, version, purl): SHA-256 of its name and all package URLs in report order, and the UUID made of it.

    A digest is of a whole, so a group's package URLs meet in one row.
    """
    order = F.sort_array(F.collect_list(F.struct("ecosystem", F.lower("name").alias("lower"), "version", "purl")))
    basis = F.concat_ws("|", name, F.array_join(F.transform("all", lambda x: x["purl"]), "|"))
    digest = components.groupBy(key).agg(order.alias("all")).select(key, F.sha2(basis, 256).alias("digest"))
    return digest.withColumn("serial", T.uuid5(str(uuid.NAMESPACE_DNS), F.col("digest")))


def cyclonedx(components: DataFrame, key: str, name: Column, findings: DataFrame | None = None) -> DataFrame:
    """Pieces of a CycloneDX 1.5 document for each group of components; findings (with purl and the key) are its vulnerabilities."""
    keys = serials(components, key, name)
    meta = F.concat(F.lit('{"component":'), F.to_json(F.struct(F.lit("application").alias("type"), F.lit(ROOT).alias("bom-ref"), name.cast("string").alias("name"))), F.lit("}"))
    head = F.concat(F.lit('{"bomFormat":"CycloneDX","specVersion":"1.5","serialNumber":"urn:uuid:'), F.col("serial"), F.lit('","version":1,"metadata":'), meta, F.lit(',"components":['))
    none = F.lit(None)
    rows = cyclonedx_components(components, key).select(key, _place(none, F.concat_ws("\0", "ecosystem", F.lower("name")), none, F.col("version")), "piece")
    if findings is None:
        return fixed(keys, key, {HEAD: head, FOOT: F.lit("]}")}).unionByName(listed(rows, key, FIRST))
    found = cyclonedx_vulnerabilities(findings, components, name, key, by=key)
    found = found.select(key, _place(S.rank(F.col("severity")), F.col("file_path"), F.col("line"), F.col("rule_id")), "piece").join(keys.select(key), key, "left_semi")
    told = fixed(keys, key, {HEAD: head, BETWEEN: F.lit('],"vulnerabilities":['), FOOT: F.lit("]}")})
    return told.unionByName(listed(rows, key, FIRST)).unionByName(listed(found, key, SECOND))
