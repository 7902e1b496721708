"""Versions and ranges as Column expressions: parse, compare, normalise, test.

A range is alternatives joined by `||`, each of comparators joined by `,`; an empty range holds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_VERSION = r"^v?\d+(\.\d+)*"


def key(version: Column) -> Column:
    """Sorts as versions do: four numbers, then a release above its pre-releases, then the pre-release.

    Without a dash, digits of a suffix count as a further number (1.0.0rc1 is 1.0.0.1).
    """
    head = F.substring_index(version, "-", 1)
    digits = F.transform(F.regexp_extract_all(head, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))
    numbers = F.slice(F.concat(digits, F.array_repeat(F.lit(0), 4)), 1, 4)
    pre = F.when(F.contains(version, F.lit("-")), F.substring(version, F.instr(version, "-") + 1, F.lit(1_000)))
    return F.struct(numbers.alias("numbers"), pre.isNull().alias("release"), F.coalesce(pre, F.lit("")).alias("pre"))


def code(version_key: Column) -> Column:
    """62 bits that never fall while keys rise: the four numbers, each as far as its bits go; what they leave out is for the key to tell."""
    n = lambda k, most: F.least(F.get(version_key["numbers"], F.lit(k)), F.lit(most)).cast("long")
    return F.shiftleft(n(0, 32767), 47) + F.shiftleft(n(1, 65535), 31) + F.shiftleft(n(2, 65535), 15) + n(3, 32767)


_OP = r"^\s*(>=|<=|!=|={1,3}|>|<|)"


def bounds(spec: Column) -> Column:
    """A range's alternatives, each a list of (op, key): what is worked out once for each range."""
    parts = lambda text, by: F.filter(F.split(text, by), lambda x: F.trim(x) != "")
    one = lambda c: F.struct(F.regexp_extract(c, _OP, 1).alias("op"), key(F.trim(F.regexp_replace(c, _OP, ""))).alias("key"))
    return F.transform(parts(F.coalesce(spec, F.lit("")), r"\|\|"), lambda alt: F.transform(parts(alt, ","), one))


def within(version_key: Column, alternatives: Column) -> Column:
    """Whether the key of a version lies in a range's bounds."""

    def holds(c: Column) -> Column:
        op, b = c["op"], c["key"]
        return F.when(op == ">=", version_key >= b).when(op == "<=", version_key <= b).when(op == ">", version_key > b).when(op == "<", version_key < b).when(op == "!=", version_key != b).otherwise(version_key == b)

    return F.exists(alternatives, lambda alt: F.forall(alt, holds))


def in_range(version: Column, spec: Column) -> Column:
    return within(key(version), bounds(spec))


def candidate(spec: Column) -> Column:
    """The first version that a requirement names: the lowest that it may mean; null where it names none."""
    return F.nullif(F.regexp_extract(spec, r"\d+(\.\d+){0,3}", 0), F.lit(""))


def pinned(spec: Column) -> Column:
    """Exactly one version: bare, or after = or ==."""
    exact = F.trim(spec).rlike(r"^={0,3}\s*v?\d+(\.\d+)*([-+.]?[A-Za-z0-9]+)*$") & ~F.trim(spec).rlike(r"\.[xX]$")
    return F.coalesce(exact, F.lit(False))


def normalized(spec: Column) -> Column:
    """Caret, tilde, pessimistic and wildcard forms as comparators; null where there is no such form."""
    s = F.trim(spec)
    part = lambda k: F.regexp_extract(s, r"(\d+)(?:\.(\d+))?(?:\.(\d+))?", k)
    major, minor, patch = (F.coalesce(F.try_to_number(F.nullif(part(k), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0)) for k in (1, 2, 3))
    has_minor, has_patch = part(2) != "", part(3) != ""
    text = lambda *n: F.concat_ws(".", *(x.cast("string") for x in n))
    span = lambda low, high: F.concat(F.lit(">="), low, F.lit(",<"), high)
    full = text(major, minor, patch)
    zero = F.lit(0)
    caret = F.when(major > 0, span(full, text(major + 1, zero, zero))).when(minor > 0, span(full, text(zero, minor + 1, zero))).otherwise(span(full, text(zero, zero, patch + 1)))
    tilde = F.when(has_minor, span(full, text(major, minor + 1, zero))).otherwise(span(full, text(major + 1, zero, zero)))
    pessimistic = F.when(has_patch, span(full, text(major, minor + 1, zero))).otherwise(span(full, text(major + 1, zero, zero)))
    wildcard = F.when(has_minor, span(text(major, minor, zero), text(major, minor + 1, zero))).otherwise(span(text(major, zero, zero), text(major + 1, zero, zero)))
    return (
        F.when(s.rlike(r"^\^\s*v?\d"), caret)
        .when(s.rlike(r"^~>\s*v?\d") | s.rlike(r"^~=\s*v?\d"), pessimistic)
        .when(s.rlike(r"^~\s*v?\d"), tilde)
        .when(s.rlike(r"^v?\d+(\.\d+)?\.[xX*]$"), wildcard)
        .when(s.rlike(r"^\s*(>=|<=|!=|==|=|>|<)?\s*v?\d[\w.+-]*(\s*(,|\|\|)\s*(>=|<=|!=|==|=|>|<)?\s*v?\d[\w.+-]*)*$"), F.regexp_replace(s, r"\s+", ""))
    )


def permits(spec: Column, version: Column) -> Column:
    """Whether a requirement allows a version: true, false, or null where that can't be told."""
    return F.when(version.rlike(_VERSION), F.when(normalized(spec).isNotNull(), in_range(version, normalized(spec))))


def package_name(ecosystem: Column, name: Column) -> Column:
    lower = F.lower(name)
    return F.when(ecosystem == "python", F.regexp_replace(lower, r"[-_.]+", "-")).otherwise(lower)
