"""Dependency manifests: whole files to dependency rows and error rows.

Each file goes to one small parser by its name, inside mapInPandas, since formats need a reader for whole files; a
parser that fails gives an error row and never a failed task.  Nothing in a file is run.
"""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

SCHEMA = "rel_path string, kind string, ecosystem string, name string, spec string, line int, direct boolean, error string"
Row = tuple[str, str, str | None, int, bool]  # ecosystem, name, spec, line, direct


#: In place of an ecosystem: the name tells what is wrong with a line, and the rest of the file counts.
WRONG = "!"


class Problem(Exception):
    """A file that can't be taken as its name promises; the text names the integrity rule."""


def _numbered(text: str) -> Iterator[tuple[int, str]]:
    return enumerate(text.splitlines(), 1)


def _at(text: str, what: str) -> int:
    """The first line that has `what`; 1 if none has."""
    return next((n for n, line in _numbered(text) if what in line), 1)


def requirements(text: str) -> Iterator[Row]:
    for n, line in _numbered(text):
        line = line.split(" #")[0].strip()
        if not line or line[0] in "#-":
            continue
        m = re.match(r"([A-Za-z0-9][\w.-]*)(?:\[[^\]]*\])?\s*([^;]*)", line)
        if m:
            yield "python", m[1], m[2].strip() or None, n, True
        else:
            yield WRONG, "UNPARSEABLE-LINE", None, n, True


def _toml(text: str) -> dict:
    try:
        return tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise Problem(f"MALFORMED: {e}") from e


def _json(text: str) -> dict:
    try:
        out = json.loads(text)
    except ValueError as e:
        raise Problem(f"MALFORMED: {e}") from e
    if not isinstance(out, dict):
        raise Problem("MALFORMED: not an object")
    return out


def _version(value) -> str | None:
    value = value.get("version") if isinstance(value, dict) else value
    return value if isinstance(value, str) and value != "*" and "://" not in value else None


def _section(text: str, eco: str, section: dict | None, direct: bool = True) -> Iterator[Row]:
    for name, value in (section or {}).items():
        yield eco, name, _version(value), _at(text, name), direct


def pyproject(text: str) -> Iterator[Row]:
    doc = _toml(text)
    for need in doc.get("project", {}).get("dependencies", []):
        m = re.match(r"[A-Za-z0-9][\w.-]*", need)
        if m:
            yield "python", m[0], need[m.end() :].strip() or None, _at(text, need), True
    poetry = doc.get("tool", {}).get("poetry", {})
    yield from (r for r in _section(text, "python", poetry.get("dependencies")) if r[1] != "python")


def pipfile(text: str) -> Iterator[Row]:
    doc = _toml(text)
    for part in ("packages", "dev-packages"):
        yield from _section(text, "python", doc.get(part))


def pipfile_lock(text: str) -> Iterator[Row]:
    doc = _json(text)
    for part in ("default", "develop"):
        yield from _section(text, "python", doc.get(part))


def toml_lock(eco: str) -> Callable[[str], Iterator[Row]]:
    def parse(text: str) -> Iterator[Row]:
        for p in _toml(text).get("package", []):
            yield eco, p["name"], p.get("version"), _at(text, f'"{p["name"]}"'), False

    return parse


def setup_py(text: str) -> Iterator[Row]:
    m = re.search(r"install_requires\s*=\s*\[([^\]]*)\]", text)
    if not m:
        raise Problem("UNPARSED: no literal list of requirements")
    for need in re.findall(r"""["']([^"']+)["']""", m[1]):
        name = re.match(r"[A-Za-z0-9][\w.-]*", need)
        if name:
            yield "python", name[0], need[name.end() :].strip() or None, _at(text, need), True


def package_json(text: str) -> Iterator[Row]:
    doc = _json(text)
    for part in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies"):
        yield from _section(text, "npm", doc.get(part))


def package_lock(text: str) -> Iterator[Row]:
    doc = _json(text)
    if "packages" in doc:
        for path, p in doc["packages"].items():
            if "node_modules/" in path:
                yield "npm", path.rpartition("node_modules/")[2], p.get("version"), _at(text, f'"{path}"'), path.count("node_modules/") == 1
    else:
        yield from _section(text, "npm", doc.get("dependencies"), False)


def yarn_lock(text: str) -> Iterator[Row]:
    name, at = None, 1
    for n, line in _numbered(text):
        if m := re.match(r'"?(@?[^@\s"]+)@.*:$', line):
            name, at = m[1], n
        elif name and (m := re.match(r'\s+version:?\s+"?([^"\s]+)', line)):
            yield "npm", name, m[1], at, False
            name = None


def pnpm_lock(text: str) -> Iterator[Row]:
    for n, line in _numbered(text):
        if m := re.match(r"""\s+['"]?/?(@?[^@\s'"]+)@(\d[^('":\s]*)[^:]*:\s*$""", line):
            yield "npm", m[1], m[2], n, False


def go_mod(text: str) -> Iterator[Row]:
    block = False
    for n, line in _numbered(text):
        if line.startswith("require ("):
            block = True
        elif block and line.strip() == ")":
            block = False
        elif (block or line.startswith("require ")) and (m := re.match(r"(?:require\s+)?\s*(\S+)\s+(v\S+)", line)):
            yield "go", m[1], m[2], n, "// indirect" not in line


def go_sum(text: str) -> Iterator[Row]:
    seen = set()
    for n, line in _numbered(text):
        m = re.match(r"(\S+)\s+(v[^\s/]+)(?:/go\.mod)?\s", line)
        if m and m.groups() not in seen:
            seen.add(m.groups())
            yield "go", m[1], m[2], n, False


def cargo_toml(text: str) -> Iterator[Row]:
    doc = _toml(text)
    for part in ("dependencies", "dev-dependencies", "build-dependencies"):
        for eco, name, spec, line, direct in _section(text, "rust", doc.get(part)):
            yield eco, name, f"^{spec}" if spec and spec[0].isdigit() else spec, line, direct


def pom_xml(text: str) -> Iterator[Row]:
    for m in re.finditer(r"<dependency>(.*?)</dependency>", text, re.S):
        get = lambda tag, body=m[1]: (re.search(rf"<{tag}>\s*([^<]+?)\s*</{tag}>", body) or [None, None])[1]
        if get("groupId") and get("artifactId"):
            version, line = get("version"), text.count("\n", 0, m.start()) + 1
            unknown = version is not None and "${" in version
            yield "maven", f"{get('groupId')}:{get('artifactId')}", None if unknown else version, line, True
            if unknown:
                yield WRONG, f"UNRESOLVED-VERSION: {version}", None, line, True


def pattern(eco: str, regex: str, direct: bool = True) -> Callable[[str], Iterator[Row]]:
    """A parser for formats of one dependency a line."""

    def parse(text: str) -> Iterator[Row]:
        for n, line in _numbered(text):
            for m in re.finditer(regex, line):
                yield eco, m["name"], m["spec"] or None, n, direct

    return parse


def elements(eco: str, tag: str, name: str, spec: str) -> Callable[[str], Iterator[Row]]:
    """A parser for XML where each element of a tag names a dependency, its version in an attribute or a child of that name."""

    def parse(text: str) -> Iterator[Row]:
        if "<!DOCTYPE" in text or "<!ENTITY" in text:
            raise Problem("MALFORMED: declares entities")
        try:
            top = ElementTree.fromstring(text)
        except ElementTree.ParseError as e:
            raise Problem(f"MALFORMED: {e}") from e
        bare = lambda x: x.tag.rpartition("}")[2]
        lines: dict[str, list[int]] = {}
        for n, line in _numbered(text):
            for word in re.findall(r"[\w.-]+", line):
                lines.setdefault(word, []).append(n)
        for x in top.iter():
            if bare(x) == tag and x.get(name):
                inner = next((c.text for c in x if bare(c) == spec and c.text), None)
                at = lines.get(x.get(name), [1])
                yield eco, x.get(name), (x.get(spec) or inner or "").strip() or None, at.pop(0) if len(at) > 1 else at[0], True

    return parse


# What a build script calls the ways to depend on something.
_GRADLE = frozenset("implementation api compile compileOnly runtimeOnly testImplementation testRuntimeOnly annotationProcessor kapt classpath".split())


def gradle(text: str) -> Iterator[Row]:
    """Lines that begin with a way to depend and hold quoted coordinates, group, name and version."""
    for n, line in _numbered(text):
        if (re.match(r"\s*\w*", line)[0].strip()) in _GRADLE:
            for quoted in re.findall(r"""["']([^"']+)["']""", line):
                parts = quoted.split(":")
                if len(parts) >= 3:
                    version = parts[2].partition("@")[0]
                    yield "maven", ":".join(parts[:2]), None if "$" in version else version, n, True


def composer(locked: bool) -> Callable[[str], Iterator[Row]]:
    def parse(text: str) -> Iterator[Row]:
        doc = _json(text)
        if locked:
            for p in doc.get("packages", []) + doc.get("packages-dev", []):
                yield "php", p["name"], str(p.get("version", "")).lstrip("v") or None, _at(text, f'"{p["name"]}"'), False
        else:
            for part in ("require", "require-dev"):
                yield from (r for r in _section(text, "php", doc.get(part)) if r[1] != "php" and not r[1].startswith("ext-"))

    return parse


PARSERS: dict[str, Callable[[str], Iterator[Row]]] = {
    "constraints.txt": requirements, "Pipfile": pipfile, "Pipfile.lock": pipfile_lock, "poetry.lock": toml_lock("python"), "pyproject.toml": pyproject, "setup.py": setup_py,
    "package.json": package_json, "package-lock.json": package_lock, "yarn.lock": yarn_lock, "pnpm-lock.yaml": pnpm_lock, "go.mod": go_mod, "go.sum": go_sum,
    "Cargo.toml": cargo_toml, "Cargo.lock": toml_lock("rust"), "pom.xml": pom_xml, "composer.json": composer(False), "composer.lock": composer(True),
    "build.gradle": gradle, "build.gradle.kts": gradle, "packages.config": elements("nuget", "package", "id", "version"),
    "Gemfile": pattern("ruby", r"""^\s*gem\s+["'](?P<name>[^"']+)["'](?:\s*,\s*["'](?P<spec>[^"']+)["'])?"""),
    "Gemfile.lock": pattern("ruby", r"^ {4}(?P<name>\S+) \((?P<spec>[^)]+)\)", False),
}
_CSPROJ = elements("nuget", "PackageReference", "Include", "Version")


def parser_of(path: str) -> Callable[[str], Iterator[Row]] | None:
    name = path.rpartition("/")[2]
    if name.endswith(".csproj"):
        return _CSPROJ
    if name.endswith(".txt") and (name.startswith("requirements") or re.search(r"(^|/)requirements[^/]*/", path)):
        return requirements
    return PARSERS.get(name)


def rows_of(path: str, text: str) -> list[tuple]:
    parse, out = parser_of(path), []
    if parse is None:
        return [(path, "error", None, None, None, 1, None, "UNRECOGNIZED")]
    if not text.strip():
        return [(path, "error", None, None, None, 1, None, "EMPTY")]
    try:
        for eco, name, spec, line, direct in parse(text):
            out.append((path, "error", None, None, None, line, None, name) if eco == WRONG else (path, "dependency", eco, name, spec, line, direct, None))
    except Problem as e:
        out.append((path, "error", None, None, None, 1, None, str(e)))
    except Exception as e:  # noqa: BLE001  any file may hold anything
        out.append((path, "error", None, None, None, 1, None, f"PARSER-CRASH: {type(e).__name__}"))
    return out or [(path, "error", None, None, None, 1, None, "NO-DEPENDENCIES")]


def parsed(files: DataFrame) -> DataFrame:
    """Rows of SCHEMA from files (rel_path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            yield pd.DataFrame([r for path, text in zip(batch.rel_path, batch.content) for r in rows_of(path, text or "")], columns=names)

    return files.select("rel_path", "content").mapInPandas(run, SCHEMA)


class ManifestRows:
    """For SQL: `FROM files, LATERAL manifest_rows(rel_path, content)` gives the rows of SCHEMA but for the path."""

    def eval(self, path: str, text: str) -> Iterator[tuple]:
        for row in rows_of(path or "", text or ""):
            yield row[1:]


def register(spark: SparkSession, name: str = "manifest_rows") -> None:
    """Makes the parsers a table function of SQL."""
    spark.udtf.register(name, udtf(ManifestRows, returnType=SCHEMA.partition(", ")[2]))
