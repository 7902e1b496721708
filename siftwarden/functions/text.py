"""Line splitting, fingerprints, entropy, redaction and escaping as Column expressions."""

from __future__ import annotations

from hashlib import sha256
from uuid import UUID

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All line ends of Unicode text.  A text's last line end starts no further line.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
BLANK = r"(?U)[\s\x1C-\x1F]+"
SNIPPET, FINGERPRINT = 500, 16


def lines(text: Column) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def fingerprint(rule_id: Column, path: Column, snippet: Column, category: Column) -> Column:
    """What names a finding across scans: line numbers and white space don't count."""
    parts = [rule_id, path, F.substring(F.regexp_replace(snippet, BLANK, ""), 1, 400), category]
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts)), 256), 1, FINGERPRINT)


def entropy(value: Column) -> Column:
    """Shannon entropy in bits for each character; 0 for an empty text."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    parts = F.transform(F.array_distinct(chars), lambda d: F.size(F.filter(chars, lambda c: c == d)) / n)
    return -F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + p * F.log2(p))


def redacted(value: Column) -> Column:
    """A secret's length and nothing else of it."""
    return F.concat(F.lit("<redacted:"), F.char_length(value).cast("string"), F.lit(">"))


def csv_safe(value: Column) -> Column:
    """No spreadsheet takes the cell for a formula."""
    return F.when(value.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)


def xml_safe(value: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(raw), F.lit(safe))
    return value


def label_value(value: Column) -> Column:
    """For a metrics label: backslash, quote and line end escaped."""
    for raw, safe in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        value = F.replace(value, F.lit(raw), F.lit(safe))
    return value


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based UUID (version 5) of a text in a namespace, itself a UUID."""
    digest = F.sha1(F.concat(F.lit(UUID(namespace).bytes), F.encode(name, "UTF-8")))
    part = lambda a, n: F.substring(digest, a, n)
    variant = F.lower(F.hex(F.conv(part(17, 1), 16, 10).cast("long").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """The keyed hash of a text, lower-case hexadecimal; the key stands in the plan, so keep plans as safe as it."""
    block = (sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.unhex(F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in block)), F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in block)), inner), 256)
