"""Source trees as tables: discovery, classification, decoding.

files(rel_path, size_bytes, language, iac_kind, is_manifest, skip_reason, content) — rejected files stay as rows
with a skip_reason, so that counting them needs no second walk; their content is never decoded.
"""

from __future__ import annotations

import fnmatch
import os.path
import zlib
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, LessThanOrEqual

# Language by extension.
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go", "rb": "ruby", "php": "php", "cs": "csharp", "sh": "shell",
    "bash": "shell", "sql": "sql", "tf": "terraform", "yml": "yaml", "yaml": "yaml", "json": "json", "xml": "xml", "html": "html", "env": "dotenv", "toml": "toml", "rs": "rust", "kt": "kotlin",
}
# Manifests by name, and by form.
MANIFESTS = (
    "Pipfile", "Pipfile.lock", "poetry.lock", "pyproject.toml", "setup.py", "constraints.txt", "package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "go.mod", "go.sum",
    "Cargo.toml", "Cargo.lock", "pom.xml", "build.gradle", "build.gradle.kts", "composer.json", "composer.lock", "Gemfile", "Gemfile.lock", "packages.config",
)
MANIFEST_FORM = r"(^|/)(requirements[^/]*\.txt|[^/]+\.csproj|requirements[^/]*/[^/]+\.txt)$"
EXCLUDED_DIRS = ("node_modules", "venv", ".venv", "__pycache__", "dist", "build", "vendor", "target")
EXCLUDED_NAMES = ("*.min.js", "*.map", "*.lock", "*.png", "*.jpg", "*.gif", "*.pdf", "*.zip")
MAX_BYTES = 2048 * 1024


def glob(col: Column, patterns: tuple[str, ...]) -> Column:
    """Whether any shell pattern matches all of a text; * crosses slashes."""
    out = F.lit(False)
    for p in patterns:
        out = out | col.rlike(fnmatch.translate(p).replace(r"\Z", r"\z"))
    return out


def inside(root: str, path: str) -> bool:
    """Whether a path, links followed, lies in root."""
    real, top = os.path.realpath(path), os.path.realpath(root)
    return real == top or real.startswith(top + os.sep)


def classified(df: DataFrame) -> DataFrame:
    """language, iac_kind and is_manifest from rel_path."""
    path = F.col("rel_path")
    name = F.substring_index(path, "/", -1)
    ext = F.lower(F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1)).otherwise(""))
    known = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))[ext]
    iac = (
        F.when(name.rlike(r"^Dockerfile(\..+)?$"), "docker")
        .when(name.rlike(r"^(docker-)?compose\.ya?ml$"), "docker-compose")
        .when(ext == "tf", "terraform")
        .when(ext.isin("yml", "yaml") & (F.lower(path).rlike("k8s|kubernetes") | name.rlike(r"^deployment\.ya?ml$")), "kubernetes")
    )
    manifest = name.isin(*MANIFESTS) | path.rlike(MANIFEST_FORM)
    return df.withColumns({"iac_kind": iac, "is_manifest": manifest, "language": F.coalesce(F.when(iac == "docker", "dockerfile"), known, F.lit("other"))})


def skipped(path: Column, size: Column, is_manifest: Column, ignore: tuple[str, ...] = (), include: tuple[str, ...] = ()) -> Column:
    """Why a file isn't read, or null; manifests' names win over excluded names."""
    name = F.substring_index(path, "/", -1)
    dirs = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    out = F.when(F.exists(dirs, lambda d: d.isin(*EXCLUDED_DIRS) | d.startswith(".git")), "excluded-directory")
    out = out.when(size > MAX_BYTES, "too-large").when(~is_manifest & glob(name, EXCLUDED_NAMES), "excluded-name")
    if ignore:
        out = out.when(glob(path, ignore), "ignored")
    return out.when(~glob(path, include), "not-included") if include else out


class Folders(InputPartition):
    """A folder's own files, or with `deep` all below it, of which a task takes those that fall to its turn."""

    def __init__(self, top: str, deep: bool, turn: int = 0, turns: int = 1):
        self.top, self.deep, self.turn, self.turns = top, deep, turn, turns


class TreeReader(DataSourceReader):
    """Each task walks folders of its own; the driver looks at the root's entries and no further."""

    def __init__(self, options: dict[str, str]):
        self.root = os.path.realpath(options["path"])
        self.most = int(options.get("maxbytes", MAX_BYTES))
        self.turns = int(options.get("turns", TURNS))
        self.largest: int | None = None

    def pushFilters(self, filters):
        """A bound on `length` is kept while files are looked up, before any is opened; all else is left to Spark."""
        for f in filters:
            if isinstance(f, LessThanOrEqual) and f.attribute == ("length",):
                self.largest = f.value if self.largest is None else min(self.largest, f.value)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        with os.scandir(self.root) as entries:
            folders = sorted(e.path for e in entries if e.is_dir(follow_symlinks=False) and _entered(e.name))
        return [Folders(self.root, False), *(Folders(f, True, k, self.turns) for f in folders for k in range(self.turns))]

    def _files(self, part: Folders) -> Iterator[tuple[str, int]]:
        for top, dirs, names in os.walk(part.top):
            dirs[:] = sorted(d for d in dirs if _entered(d)) if part.deep else []
            for name in sorted(names):
                path = os.path.join(top, name)
                if zlib.crc32(os.path.relpath(path, self.root).encode("utf-8", "surrogateescape")) % part.turns == part.turn and os.path.isfile(path) and (not os.path.islink(path) or inside(self.root, path)):
                    size = os.path.getsize(path)
                    if self.largest is None or size <= self.largest:
                        yield os.path.relpath(path, self.root), size

    def read(self, partition: Folders) -> Iterator[tuple]:
        for name, size in self._files(partition):
            try:
                content = (Path(self.root) / name).read_bytes() if size <= self.most and not _left_out(name) else None
            except OSError:  # one that goes, or may not be read, is listed without content
                content = None
            yield name.encode("utf-8", "replace").decode(), size, content


#: Tasks that share the files of one of the root's folders.
TURNS = 4


def _entered(name: str) -> bool:
    """Whether a folder's files are listed; those of excluded folders are, and stay unread."""
    return not (name.startswith(".git") or name[0] == "." and name in EXCLUDED_DIRS)


def _left_out(path: str) -> bool:
    return any(x in EXCLUDED_DIRS for x in path.split(os.sep)[:-1])


class Tree(DataSource):
    """Files of a folder that all machines mount: rel_path, length, and content unless it has more than `maxBytes`; hidden ones too, and each read once.

    Files of excluded folders are listed without content, version control's aren't; links that lead out of the folder aren't followed.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "rel_path string, length long, content binary"

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def read_tree(spark: SparkSession, root: str, ignore: tuple[str, ...] = (), include: tuple[str, ...] = ()) -> DataFrame:
    """Files of a tree; those too large are listed and not read.  A folder is walked by tasks, each file read once; on another store Spark's reader lists it."""
    if "://" not in root:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # else Spark refuses readers that can take filters
        spark.dataSource.register(Tree)
        df = spark.read.format("source_tree").load(root)
    else:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        raw = found.where(F.col("length") <= MAX_BYTES).select("path", "length", "content").unionByName(found.where(F.col("length") > MAX_BYTES).select("path", "length", F.lit(None).cast("binary").alias("content")))
        df = raw.withColumn("rel_path", F.substring("path", len(root.rstrip("/")) + 2, 100_000))
    df = classified(df.select("rel_path", F.col("length").alias("size_bytes"), "content"))
    df = df.withColumn("skip_reason", skipped(F.col("rel_path"), F.col("size_bytes"), F.col("is_manifest"), ignore, include))
    # bytes that aren't UTF-8 give no character
    text = F.when(F.col("skip_reason").isNull(), F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit("")))
    return df.withColumn("content", text)
