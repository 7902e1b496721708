"""Infrastructure files: what a line shows, and what a whole Dockerfile lacks."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwarden.functions import text as T

from .detect import Rule, scan

# Rules by kind of file: ids, severities and confidences are fixed values, the patterns our own.
RULES = {
    "docker": [
        Rule("DOCKER-FLOATING-TAG", "low", r"(?i)^\s*FROM\s+\S*:latest|^\s*FROM\s+[^\s:]+(\s|$)", category="supply-chain"),
        Rule("DOCKER-CURL-PIPE-SH", "high", r"(?i)^\s*RUN.*\bcurl\b.*\|\s*(sudo\s+)?(ba)?sh", category="supply-chain"),
        Rule("DOCKER-HARDCODED-SECRET-ENV", "high", r"""(?i)^\s*(ENV|ARG).*(password|secret|api_key|token)\s*=\s*["']?[A-Za-z0-9+/_-]{8}""", category="secrets"),
        Rule("DOCKER-EXPOSE-SSH-PORT", "low", r"(?i)^\s*EXPOSE.*\b22\b", category="misconfiguration"),
    ],
    "terraform": [
        Rule("TF-WORLD-INGRESS", "high", r"""cidr_blocks\s*=\s*\[\s*["']0\.0\.0\.0/0["']""", confidence="high", category="iac-misconfiguration"),
        Rule("TF-PUBLICLY-ACCESSIBLE", "medium", r"(?i)\bpublicly_accessible\s*=\s*true\b", confidence="high", category="iac-misconfiguration"),
        Rule("TF-ENCRYPTION-DISABLED", "high", r"(?i)\bencrypt(ed|ion)\s*=\s*false\b", confidence="high", category="data-protection"),
    ],
    "kubernetes": [
        Rule("K8S-PRIVILEGED", "high", r"(?i)^\s*privileged:\s*true\s*$", confidence="high", category="iac-misconfiguration"),
        Rule("K8S-HOST-NETWORK", "medium", r"(?i)^\s*hostNetwork:\s*true\s*$", confidence="high", category="iac-misconfiguration"),
        Rule("K8S-ROOT-USER", "medium", r"^\s*runAsUser:\s*0\s*$", confidence="high", category="iac-misconfiguration"),
    ],
    "docker-compose": [
        Rule("COMPOSE-PRIVILEGED", "high", r"(?i)^\s*privileged:\s*true\s*$", confidence="high", category="iac-misconfiguration"),
        Rule("COMPOSE-SSH-PUBLISHED", "medium", r"""^\s*-?\s*["']?0\.0\.0\.0:22:""", confidence="high", category="network-exposure"),
    ],
}


def presence(lines: DataFrame) -> DataFrame:
    """Findings of lines (rel_path, iac_kind, line, line_text) in one pass; comment lines of Dockerfiles give none."""
    told = lines.where(~((F.col("iac_kind") == "docker") & F.startswith(F.ltrim("line_text"), F.lit("#"))))
    return scan(told, [replace(r, languages=(kind,)) for kind, rules in RULES.items() for r in rules], "iac_kind")


#: What a Dockerfile may lack: the instruction, and the finding's rule, severity and category.
WANTED = (("USER", "DOCKER-MISSING-USER", "medium", "iac-misconfiguration"), ("HEALTHCHECK", "DOCKER-MISSING-HEALTHCHECK", "info", "reliability"))


def lacking(text: Column) -> Column:
    """An array of HIT: what a Dockerfile lacks, told at its last FROM line (or line 1)."""
    words = F.transform(T.lines(text), lambda x: F.upper(F.regexp_extract(x, r"^\s*(FROM|USER|HEALTHCHECK|(?i:from|user|healthcheck))", 1)))
    last = F.array_max(F.transform(words, lambda w, i: F.when(w == "FROM", i + 1).otherwise(1))).cast("long")
    one = lambda word, rule, severity, category: F.struct(
        F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.lit("medium").alias("confidence"), F.lit(category).alias("category"), F.coalesce(last, F.lit(1)).cast("long").alias("line"), F.coalesce(last, F.lit(1)).cast("long").alias("end_line"), F.lit(f"(no {word} instruction found in file)").alias("snippet")
    )
    return F.array_compact(F.array(*(F.when(~F.array_contains(words, word), one(word, rule, severity, category)) for word, rule, severity, category in WANTED)))


def absence(lines: DataFrame) -> DataFrame:
    """What Dockerfiles lack, from their lines: one pass, grouped by file."""
    word = F.upper(F.regexp_extract("line_text", r"^\s*(FROM|USER|HEALTHCHECK|(?i:from|user|healthcheck))", 1))
    by = lines.where("iac_kind = 'docker'").groupBy("rel_path").agg(F.coalesce(F.max(F.when(word == "FROM", F.col("line"))), F.lit(1)).alias("line"), F.collect_set(word).alias("words"))
    told = [F.when(~F.array_contains("words", w), F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(category).alias("category"), F.lit(f"(no {w} instruction found in file)").alias("snippet"))) for w, rule, severity, category in WANTED]
    return by.select("rel_path", F.col("line").cast("long").alias("line"), F.inline(F.array_compact(F.array(*told))))
