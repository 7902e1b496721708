"""Queries on files: one is made for each part, of a few kinds, for what only a whole-file reader can find."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwarden.operators import detect, infra, manifests, pyast
from siftwarden.sinks import work
from siftwarden.sources import files as tree

from .registry import query
from .standins import made_files, made_sql, read

# Small Python files of our own, and what reports say of each: rule, severity, line; fixed values.
PYTHON = {
    "app/run.py": ("import os, hashlib\ndef go(payload, cmd):\n    os.system(payload)\n    os.system(cmd)\n    return hashlib.md5(cmd.encode())\n", [("PY-AST-CMD-INJECTION", "critical", 3), ("PY-AST-SHELL-TRUE", "medium", 4), ("PY-AST-WEAK-HASH", "medium", 5)]),
    "app/sub.py": ("import subprocess as sp\nsp.run(cmd, shell=True)\nsp.run(['ls'])\nsp.call(input(), shell=True)\n", [("PY-AST-SHELL-TRUE", "medium", 2), ("PY-AST-CMD-INJECTION", "critical", 4)]),
    "app/db.py": ("def find(cur, name):\n    cur.execute('select * from t where n = ' + name)\n    cur.execute('select 1')\n    cur.execute(f'select {request.args}')\n", [("PY-AST-SQL-INJECTION", "high", 2), ("PY-AST-SQL-INJECTION", "critical", 4)]),
    "app/safe.py": ("import shlex, os\ndef go(payload):\n    os.system(shlex.quote(payload))\n", [("PY-AST-SHELL-TRUE", "medium", 3)]),
    "app/broken.py": ("def (", []),
    "app/misc.py": ("import yaml, requests\nDEBUG = True\ndef load(f, seen=[]):\n    try:\n        return yaml.load(f)\n    except Exception:\n        pass\nrequests.get('https://x', verify=False)\nyaml.unsafe_load(f)\nyaml.load(f, Loader=yaml.SafeLoader)\n",
        [("PY-AST-DEBUG-ENABLED", "high", 2), ("PY-AST-MUTABLE-DEFAULT-ARG", "low", 3), ("PY-AST-INSECURE-DESERIALIZATION", "critical", 5), ("PY-AST-SILENT-EXCEPTION-SWALLOW", "low", 6), ("PY-AST-TLS-VERIFY-DISABLED", "high", 8), ("PY-AST-UNSAFE-YAML-LOADER", "critical", 9)]),
    "app/eval.py": ("eval(x)\nexec(input())\ncompile(s, 'f', 'exec')\n", [("PY-AST-EVAL-USE", "high", 1), ("PY-AST-EXEC-USE", "critical", 2), ("PY-AST-COMPILE-USE", "high", 3)]),
    "app/load.py": ("import pickle, marshal, shelve, tempfile, os\npickle.loads(b)\nmarshal.load(f)\nshelve.open('x')\ntempfile.mktemp()\nos.chmod('f', 0o777)\nos.chmod('f', 0o640)\nos.chmod('f', 0o600)\n",
        [("PY-AST-INSECURE-DESERIALIZATION", "critical", 2), ("PY-AST-INSECURE-DESERIALIZATION", "critical", 3), ("PY-AST-INSECURE-DESERIALIZATION", "critical", 4), ("PY-AST-INSECURE-TEMPFILE", "medium", 5), ("PY-AST-WORLD-WRITABLE-CHMOD", "medium", 6)]),
    "app/auth.py": ("assert user.is_admin\nassert authority\nhost = '0.0.0.0'\nport = '0.0.0.0'\n", [("PY-AST-ASSERT-SECURITY-CHECK", "high", 1), ("PY-AST-BIND-ALL-INTERFACES", "medium", 3)]),
    "tests/test_auth.py": ("assert user.is_admin\n", []),
    "app/tls.py": ("import ssl, random\nctx = ssl.SSLContext(ssl.PROTOCOL_TLSv1)\nctx.verify_mode = ssl.CERT_NONE\ntoken = random.randint(0, 9)\nsize = random.randint(0, 9)\n", [("PY-AST-WEAK-TLS-PROTOCOL", "high", 2), ("PY-AST-SSL-VERIFY-DISABLED", "high", 3), ("PY-AST-INSECURE-RANDOM", "high", 4)]),
    "app/flow.py": ("import requests\nfrom xml.dom import minidom\ndef view(user_path, user_url):\n    open(user_path)\n    open(secure_filename(user_path))\n    requests.get(user_url)\n    redirect(request.args['next'])\n    Markup(request.form['a'])\n    Template(user_path)\n    minidom.parseString(x)\n",
        [("PY-AST-PATH-TRAVERSAL", "high", 4), ("PY-AST-SSRF", "high", 6), ("PY-AST-OPEN-REDIRECT", "medium", 7), ("PY-AST-XSS", "high", 8), ("PY-AST-TEMPLATE-INJECTION", "critical", 9), ("PY-AST-UNSAFE-XML-PARSER", "high", 10)]),
}
MANIFESTS = [
    ("requirements.txt", "flask==2.0.@N@\n# note\nrequests[socks]>=2.0 ; python_version > '3'\nbare\n"), ("package.json", '{"dependencies": {"left-pad@N@": "^1.3.0"}, "devDependencies": {"jest": "29.0.0"}}'),
    ("go.mod", "module x\nrequire (\n\tgithub.com/a/b@N@ v1.2.3\n\tgithub.com/c/d v0.1.0 // indirect\n)\n"), ("Cargo.toml", '[dependencies]\nserde = "1.@N@"\n'), ("pom.xml", "<dependency><groupId>g</groupId><artifactId>a</artifactId><version>${v}</version></dependency>"),
    ("Gemfile.lock", "GEM\n  specs:\n    rails (7.0.@N@)\n      rack (>= 2)\n"), ("web/app.csproj", '<PackageReference Include="N" Version="1.0" />'), ("composer.json", '{"require": {"php": ">=8", "a/b": "^1"}}'), ("broken/package.json", "{"), ("pyproject.toml", "[project]\n"),
]
DOCKERFILES = [("a/Dockerfile", "FROM python:latest\n# FROM other:latest\nRUN curl https://x | sh\nENV API_TOKEN=abc12345\nEXPOSE 22\nFROM python AS build\n"), ("b/Dockerfile", "FROM python:3.12@sha256:0\nFROM scratch\nUSER app\n"), ("c/Dockerfile", "# empty\nUSER app\nHEALTHCHECK NONE\n"), ("k8s/pod.yaml", "spec:\n  hostNetwork: true\n  privileged: true\n  runAsUser: 0\n"), ("docker-compose.yml", "services:\n  a:\n    privileged: true\n    ports:\n      - \"0.0.0.0:22:22\"\n      - 8080:80\n"), ("main.tf", 'cidr_blocks = ["0.0.0.0/0"]\nencrypted = false\npublicly_accessible = TRUE\n')]


@query("WITH " + made_sql(list(PYTHON), [(p, *r) for p, (_, rows) in PYTHON.items() for r in rows], "rule_id, severity, line") + " SELECT rel_path, rule_id, severity, CAST(line + shift AS INTEGER) AS line FROM made")
def python_ast_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pyast.scan(made_files(spark, sf_dir, [(p, text + "# of part @N@\n" * (p != "app/broken.py")) for p, (text, _) in PYTHON.items()], shift=True)).select("rel_path", "rule_id", "severity", "line")


# What the manifests above hold: ecosystem, name, requirement, line, whether it is direct, and what is wrong; fixed values.
DEPENDENCIES = [
    ("requirements.txt", "python", "flask", "==2.0.@N@", 1, True, None), ("requirements.txt", "python", "requests", ">=2.0", 3, True, None), ("requirements.txt", "python", "bare", None, 4, True, None), ("package.json", "npm", "left-pad@N@", "^1.3.0", 1, True, None),
    ("package.json", "npm", "jest", "29.0.0", 1, True, None), ("go.mod", "go", "github.com/a/b@N@", "v1.2.3", 3, True, None), ("go.mod", "go", "github.com/c/d", "v0.1.0", 4, False, None), ("Cargo.toml", "rust", "serde", "^1.@N@", 2, True, None), ("pom.xml", "maven", "g:a", None, 1, True, None),
    ("pom.xml", None, None, None, 1, None, "UNRESOLVED-VERSION"), ("Gemfile.lock", "ruby", "rails", "7.0.@N@", 3, False, None), ("web/app.csproj", "nuget", "N", "1.0", 1, True, None), ("composer.json", "php", "a/b", "^1", 1, True, None),
    ("broken/package.json", None, None, None, 1, None, "MALFORMED"), ("pyproject.toml", None, None, None, 1, None, "NO-DEPENDENCIES"),
]


@query("WITH " + made_sql([p for p, _ in MANIFESTS], DEPENDENCIES, "ecosystem, name, spec, line, direct, error") + " SELECT rel_path, ecosystem, replace(name, '@N@', p_partkey::VARCHAR) AS name, replace(spec, '@N@', p_partkey::VARCHAR) AS spec, CAST(line AS INTEGER) AS line, direct, error FROM made")
def manifest_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifests.parsed(made_files(spark, sf_dir, MANIFESTS))
    return rows.select("rel_path", "ecosystem", "name", "spec", "line", "direct", F.regexp_extract("error", r"^[A-Z-]+", 0).alias("error"))


@query("WITH " + made_sql([p for p, _ in MANIFESTS], [d for d in DEPENDENCIES if d[1]], "ecosystem, name, spec, line, direct, error") + " SELECT ecosystem, CAST(count(*) AS BIGINT) AS n, CAST(count(spec) AS BIGINT) AS with_spec, CAST(count(DISTINCT replace(name, '@N@', p_partkey::VARCHAR)) AS BIGINT) AS names FROM made GROUP BY ecosystem")
def manifest_parse_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files by a table function in SQL: dependencies of each ecosystem."""
    manifests.register(spark)
    made_files(spark, sf_dir, MANIFESTS).createOrReplaceTempView("made_manifests")
    return spark.sql("SELECT m.ecosystem, count(*) AS n, count(m.spec) AS with_spec, count(DISTINCT m.name) AS names FROM made_manifests f, LATERAL manifest_rows(f.rel_path, f.content) m WHERE m.kind = 'dependency' GROUP BY m.ecosystem")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.exploded(tree.classified(made_files(spark, sf_dir, DOCKERFILES, shift=True)), "content")


# What the files above hold, by the ids, severities and places that reports use: fixed values.
ABSENT = [("a/Dockerfile", 6, "DOCKER-MISSING-USER", "medium"), ("a/Dockerfile", 6, "DOCKER-MISSING-HEALTHCHECK", "info"), ("b/Dockerfile", 2, "DOCKER-MISSING-HEALTHCHECK", "info")]
PRESENT = [
    ("a/Dockerfile", 1, "DOCKER-FLOATING-TAG", "low"), ("a/Dockerfile", 3, "DOCKER-CURL-PIPE-SH", "high"), ("a/Dockerfile", 4, "DOCKER-HARDCODED-SECRET-ENV", "high"), ("a/Dockerfile", 5, "DOCKER-EXPOSE-SSH-PORT", "low"), ("a/Dockerfile", 6, "DOCKER-FLOATING-TAG", "low"),
    ("b/Dockerfile", 2, "DOCKER-FLOATING-TAG", "low"), ("k8s/pod.yaml", 2, "K8S-HOST-NETWORK", "medium"), ("k8s/pod.yaml", 3, "K8S-PRIVILEGED", "high"), ("k8s/pod.yaml", 4, "K8S-ROOT-USER", "medium"),
    ("docker-compose.yml", 3, "COMPOSE-PRIVILEGED", "high"), ("docker-compose.yml", 5, "COMPOSE-SSH-PUBLISHED", "medium"),
    ("main.tf", 1, "TF-WORLD-INGRESS", "high"), ("main.tf", 2, "TF-ENCRYPTION-DISABLED", "high"), ("main.tf", 3, "TF-PUBLICLY-ACCESSIBLE", "medium"),
]


def _found(rows: list[tuple]) -> str:
    return "WITH " + made_sql([p for p, _ in DOCKERFILES], rows, "line, rule_id, severity") + " SELECT rel_path, CAST(line + shift AS BIGINT) AS line, rule_id, severity FROM made"


@query(_found(ABSENT))
def dockerfile_absence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infra.absence(_lines(spark, sf_dir)).select("rel_path", "line", "rule_id", "severity")


@query(_found(PRESENT))
def iac_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infra.presence(_lines(spark, sf_dir)).select("rel_path", "line", "rule_id", "severity")


@query("SELECT page_id, lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) AS ext, CAST(length(html) - length(replace(html, chr(10), '')) + 1 AS BIGINT) AS n_lines FROM pages")
def page_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.char_length("html") - F.char_length(F.replace("html", F.lit("\n"), F.lit(""))) + 1
    return read(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", r"\.([A-Za-z0-9]+)$", 1)).alias("ext"), n.cast("long").alias("n_lines"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def streaming_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly counts by a stream that takes all there is and ends; complete mode, so no row is late.

    What the last batch counted is written out by tasks; nothing goes through the driver.
    """
    from siftwarden.streaming import live

    batch = read(spark, sf_dir, "events")
    place = work.place(spark, "streaming_event_counts")
    stream = live.hourly(spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))
    # with no event at all there is no batch, and an empty table stands
    stream_schema = stream.schema
    spark.createDataFrame([], stream_schema).write.parquet(f"{place}/out")
    run = stream.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{place}/out")).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream_schema).parquet(f"{place}/out").select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "n")
