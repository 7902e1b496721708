"""Rules on text: rows of text to findings, one pass for all line rules and one for those on whole files."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwarden.functions import text as T


@dataclass(frozen=True)
class Rule:
    """One rule.  `languages` may hold "*"; `exclude` silences a line that also matches it; every match
    holds one of `needs`, plain texts that are looked for first, since that is far cheaper than the pattern.
    `whole`: the pattern is matched on the whole file, not line by line."""

    rule_id: str
    severity: str
    pattern: str
    languages: tuple[str, ...] = ("*",)
    exclude: str | None = None
    confidence: str = "medium"
    category: str = "code"
    needs: tuple[str, ...] = ()
    whole: bool = False


# What starts a comment line, by language.
COMMENT = {
    "python": "#", "ruby": "#", "shell": "#", "yaml": "#", "terraform": "#", "dotenv": "#", "sql": "--",
    "javascript": "//", "typescript": "//", "java": "//", "go": "//", "c": "//", "cpp": "//", "csharp": "//", "php": "//",
}
# Keys of a rule pack whose values are patterns and prose, not code.
DEFINITIONS = frozenset("pattern exclude_if_matches message remediation title description id".split())
_KEY = re.compile(r"\s*([A-Za-z_]\w*)\s*:(?:\s|$)", re.A)


def exploded(files: DataFrame, text: str = "text") -> DataFrame:
    """A row for each line, numbered from 1."""
    out = files.withColumn("_lines", T.lines(F.col(text))).drop(text)
    return out.select("*", F.posexplode("_lines").alias("_pos", "line_text")).withColumn("line", (F.col("_pos") + 1).cast("long")).drop("_lines", "_pos")


def is_comment(line: Column, language: Column) -> Column:
    """Whether a line is nothing but a comment."""
    marker = F.create_map(*(F.lit(x) for pair in COMMENT.items() for x in pair))[language]
    return F.coalesce(F.startswith(F.ltrim(line, F.lit(" \t")), marker), F.lit(False))


def docstring_lines(lines: list[str]) -> set[int]:
    """Numbers, from 1, of the lines of Python texts that open at the start of a line: documentation, not code."""
    out, quote = set(), ""
    for n, line in enumerate(lines, 1):
        text = line.strip()
        if quote:
            out.add(n)
            quote = "" if quote in line else quote
        elif text[:3] in ('"""', "'''"):
            out.add(n)
            quote = "" if len(text) >= 6 and text.endswith(text[:3]) else text[:3]
    return out


def definition_lines(lines: list[str]) -> set[int]:
    """Numbers of the lines of a rule pack (a YAML list `rules` whose entries have a `pattern`) that define rules."""
    if not any(re.match(r"rules\s*:\s*$", x) for x in lines) or not any(re.match(r"\s+(-\s+)?pattern\s*:", x) for x in lines):
        return set()
    out, inside = set(), False
    for n, line in enumerate(lines, 1):
        if m := _KEY.match(line):
            inside = m[1] in DEFINITIONS
        elif line.strip() and not inside:
            continue
        if inside and line.strip():
            out.add(n)
    return out


def silent_lines(text: Column, language: Column) -> Column:
    """Numbers of the lines that no line rule looks at: docstrings of Python files, definitions of rule packs."""

    @F.arrow_udf("array<int>")
    def told(texts: pa.Array, languages: pa.Array) -> pa.Array:
        look = {"python": docstring_lines, "yaml": definition_lines}
        return pa.array([sorted(look[k](re.split(_LINE_END, t))) if k in look and t else [] for t, k in zip(texts.to_pylist(), languages.to_pylist())], pa.list_(pa.int32()))

    return F.when(language.isin("python", "yaml"), told(text, language)).otherwise(F.expr("cast(array() as array<int>)"))


_LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def code_lines(files: DataFrame, text: str = "text") -> DataFrame:
    """The lines of files (language, text, ...) that line rules look at."""
    lines = exploded(files.withColumn("_silent", silent_lines(F.col(text), F.col("language"))), text)
    return lines.where(~F.array_contains("_silent", F.col("line").cast("int")) & ~is_comment(F.col("line_text"), F.col("language"))).drop("_silent")


HIT = "struct<rule_id:string,severity:string,confidence:string,category:string,line:bigint,end_line:bigint,snippet:string>"
HITS = pa.list_(pa.struct([(n, pa.int64() if "line" in n else pa.string()) for n in ("rule_id", "severity", "confidence", "category", "line", "end_line", "snippet")]))


def whole_hits(rules: list[Rule], text: Column, language: Column) -> Column:
    """An array of HIT: the matches of whole-file rules in a text."""
    kept = [(r, re.compile(r.pattern), re.compile(r.exclude) if r.exclude else None) for r in rules if r.whole]

    @F.arrow_udf(f"array<{HIT}>")
    def told(texts: pa.Array, languages: pa.Array) -> pa.Array:
        out = []
        for t, kind in zip(texts.to_pylist(), languages.to_pylist()):
            some = [x for x in kept if t and ("*" in x[0].languages or kind in x[0].languages) and (not x[0].needs or any(n in t for n in x[0].needs))]
            lines = t.split("\n") if some else []
            silent = definition_lines(lines) if some and kind == "yaml" else ()
            rows = []
            for r, pattern, exclude in some:
                for m in pattern.finditer(t):
                    first, last = t.count("\n", 0, m.start()) + 1, t.count("\n", 0, m.end()) + 1
                    if first not in silent and not (exclude and exclude.search(m[0])):
                        rows.append({"rule_id": r.rule_id, "severity": r.severity, "confidence": r.confidence, "category": r.category, "line": first, "end_line": last, "snippet": "\n".join(lines[first - 1 : last])[: T.SNIPPET]})
            out.append(rows)
        return pa.array(out, HITS)

    return told(text, language)


def scan_whole(files: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """files, but for their text, with a row for each match of a whole-file rule: rule_id, ..., line, end_line and snippet."""
    hits = files.withColumn("_hits", whole_hits(rules, F.col(text), F.col("language")))
    return hits.drop(text).select("*", F.explode("_hits").alias("_hit")).select("*", "_hit.*").drop("_hits", "_hit")


def matches(rule: Rule) -> Column:
    """Whether `line_text` is a match of a line rule."""
    found = F.col("line_text").rlike(rule.pattern)
    if rule.needs:
        some = F.contains("line_text", F.lit(rule.needs[0]))
        for x in rule.needs[1:]:
            some = some | F.contains("line_text", F.lit(x))
        found = some & found
    return found & ~F.col("line_text").rlike(rule.exclude) if rule.exclude else found


def snippet(category: Column) -> Column:
    """What a finding shows of `line_text`: of a secret nothing but how long its line is."""
    return F.when(category == "secret", T.redacted(F.col("line_text"))).otherwise(F.substring(F.trim("line_text"), 1, T.SNIPPET))


def scan(lines: DataFrame, rules: list[Rule], language: str | None = None) -> DataFrame:
    """lines with a row for each line rule that matches: rule_id, severity, confidence, category, snippet.

    Each rule is a literal pattern in one array expression, so a line is read once for all rules and no
    join is made; patterns are compiled once.
    """
    hits = []
    for k, r in enumerate(r for r in rules if not r.whole):
        found = matches(r)
        if "*" not in r.languages and language:
            found = found & F.col(language).isin(*r.languages)
        told = F.struct(F.lit(k).alias("rule_no"), *(F.lit(v).alias(n) for n, v in (("rule_id", r.rule_id), ("severity", r.severity), ("confidence", r.confidence), ("category", r.category))))
        hits.append(F.when(found, told))
    out = lines.select("*", F.explode(F.array_compact(F.array(*hits))).alias("_hit")).select("*", "_hit.*").drop("_hit")
    return out.withColumn("snippet", snippet(F.col("category")))


# Rules on prose and configuration lines, of our own making.
TEXT_RULES = [
    # the credential word is a name's only segment or one of two; constants such as lexer tokens have more, those of rights dotted words as values
    Rule("SECRETS-HARDCODED-CREDENTIAL", "high", r"""(?i)\b(([a-z0-9]+[_-])?(api_?key|token|secret|password|passwd)|(api_?key|token|secret|password|passwd)[_-][a-z0-9]+)["']?\s*[:=]\s*["'][^"'\s]{8,}["']""", exclude=r"""(?i)[:=]\s*["'](your|changeme|example|https?:|[a-z_]+(\.[a-z_]+)+["'])""", confidence="high", category="secret", needs=('"', "'")),
    Rule("SECRET-AWS-ACCESS-KEY-ID", "critical", r"\bAKIA[0-9A-Z]{16}\b", confidence="high", category="secret", needs=("AKIA",)),
    Rule("SECRET-GITHUB-TOKEN", "critical", r"\bgh[opsur]_[A-Za-z0-9]{36}|\bgithub_pat_[A-Za-z0-9_]{22}", confidence="high", category="secret", needs=("gh", "github_pat_")),
    Rule("SECRET-STRIPE-KEY", "critical", r"\b[rs]k_(live|test)_[A-Za-z0-9]{16}", confidence="high", category="secret", needs=("k_live_", "k_test_")),
    Rule("SECRET-SLACK-TOKEN", "critical", r"\bxox[abeoprs]-[A-Za-z0-9-]{10}", confidence="high", category="secret", needs=("xox",)),
    Rule("SECRET-GOOGLE-API-KEY", "high", r"\bAIza[A-Za-z0-9_-]{35}", confidence="high", category="secret", needs=("AIza",)),
    Rule("SECRET-DATABASE-URI", "critical", r"\b(postgres(ql)?|mysql|mariadb|mongodb(\+srv)?|redis|amqp)://[^\s:/@]*:[^\s/@]{3,}@", confidence="high", category="secret", needs=("://",)),
    Rule("SECRET-PRIVATE-KEY-BLOCK", "critical", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", confidence="high", category="secret", needs=("-----BEGIN",)),
    Rule("PII-EMAIL-ADDRESS", "low", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z.]{2,}", category="privacy", needs=("@",)),
    Rule("PII-IPV4-ADDRESS", "info", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", confidence="low", category="privacy"),
    Rule("LICENSE-SENTENCE", "info", r"(?i)\b(licensed|released) under (the )?[A-Z]", category="license"),
]
#: A credential whose name is the word alone.
BARE_CREDENTIAL = r"""(?i)\b(api_key|token|secret|password|passwd)\s*[:=]"""
SECRET_RULES = [r for r in TEXT_RULES if r.category == "secret"]
# The assignment whose value the entropy detector weighs.
ASSIGNMENT = r"""\b([A-Za-z_][A-Za-z0-9_]*)\s*[:=]\s*["']([A-Za-z0-9+/=_-]{20,})["']"""
# Hexadecimal values have 4 bits a character at most, so none of them is above the default.
ENTROPY_THRESHOLD, LONGEST_LINE = 4.3, 2_000


def is_random(line: Column, threshold: float = ENTROPY_THRESHOLD) -> Column:
    """Whether a line assigns a value that looks drawn at random."""
    return F.when(line.rlike(ASSIGNMENT), T.entropy(F.regexp_extract(line, ASSIGNMENT, 2)) >= threshold).otherwise(False)


def entropy_assignments(lines: DataFrame, threshold: float = ENTROPY_THRESHOLD) -> DataFrame:
    """lines, but for their text, with the name, value_length and entropy of an assigned value that looks drawn at random."""
    some = lines.where((F.char_length("line_text") <= LONGEST_LINE) & F.col("line_text").rlike(ASSIGNMENT))
    value = F.regexp_extract("line_text", ASSIGNMENT, 2)
    out = some.withColumns({"name": F.regexp_extract("line_text", ASSIGNMENT, 1), "value_length": F.char_length(value).cast("long"), "entropy": T.entropy(value)})
    return out.where(F.col("entropy") >= threshold).drop("line_text")
