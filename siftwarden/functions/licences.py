"""SPDX expressions: tokens, validity and class as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The licences of each class; others are unknown.
ALLOWED = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "Unlicense", "CC0-1.0", "0BSD", "Python-2.0", "PSF-2.0", "BlueOak-1.0.0")
WARNING = ("LGPL-2.0", "MPL-1.1", "MPL-2.0", "EPL-1.0", "EPL-2.0", "CDDL-1.0", "CDDL-1.1", "CPL-1.0", "Artistic-2.0")
BLOCKED = ("GPL-2.0", "GPL-3.0", "AGPL-1.0", "AGPL-3.0", "SSPL-1.0", "OSL-3.0", "EUPL-1.2", "LGPL-2.1", "LGPL-3.0")
# From best to worst.
CLASSES = ("allowed", "warning", "unknown", "blocked")
# What stands for no licence, and the class of an expression that can't be read, by what a policy does then.
NOTHING = ("", "UNKNOWN", "NONE", "NOASSERTION", "NULL", "-")
UNREAD = {"warn": "unknown", "block": "blocked", "allow": "allowed"}


def one_class(licence: Column, sets: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The class of one licence id, which must be spelled as it is listed; a worse class wins where sets overlap."""
    sets = sets or {"blocked": BLOCKED, "warning": WARNING, "allowed": ALLOWED}
    out = F.when(licence.isin(*sets.get("blocked", ())), "blocked").when(licence.isin(*sets.get("warning", ())), "warning")
    return out.when(licence.isin(*sets.get("allowed", ())), "allowed").otherwise("unknown")


def _words(expression: Column) -> Column:
    """Ids and operators in order, without brackets; slash and comma are read as OR."""
    clean = F.regexp_replace(F.coalesce(expression, F.lit("")), r"[/,]", " OR ")
    return F.regexp_extract_all(clean, F.lit(r"[A-Za-z0-9.+-]+"), F.lit(0))


def _is(word: Column, *operators: str) -> Column:
    return F.coalesce(F.upper(word).isin(*operators), F.lit(False))


def ids(expression: Column) -> Column:
    """The licence ids of an expression; what follows WITH is an exception and no id."""
    words = _words(expression)
    return F.filter(words, lambda w, i: ~_is(w, "AND", "OR", "WITH") & ~_is(F.get(words, i - 1), "WITH"))


def readable(expression: Column) -> Column:
    """Whether an expression names licences: not empty, no operator after WITH, not AND and OR at once."""
    words = _words(expression)
    odd = F.exists(F.transform(words, lambda w, i: _is(w, "WITH") & _is(F.get(words, i + 1), "AND", "OR", "WITH")), lambda x: x)
    mixed = F.exists(words, lambda w: _is(w, "AND")) & F.exists(words, lambda w: _is(w, "OR"))
    none = F.upper(F.trim(F.coalesce(expression, F.lit("")))).isin(*NOTHING)
    return ~none & ~odd & ~mixed & (F.size(ids(expression)) > 0)


def classify(expression: Column, sets: dict[str, tuple[str, ...]] | None = None, unknown: str = "warn") -> Column:
    """OR: the best class of its ids; AND or one: the worst; an expression that can't be read: what `unknown` says."""
    ranks = F.transform(ids(expression), lambda x: F.array_position(F.array(*map(F.lit, CLASSES)), one_class(x, sets)))
    chosen = F.when(F.exists(_words(expression), lambda w: _is(w, "OR")), F.array_min(ranks)).otherwise(F.array_max(ranks))
    known = F.get(F.array(*map(F.lit, CLASSES)), (chosen - 1).cast("int"))
    return F.when(readable(expression), known).otherwise(UNREAD.get(unknown, "unknown"))
