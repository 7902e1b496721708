"""One line that each rule must find; the rest of the lines it must not."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siftwarden.operators import detect
from siftwarden.sources.builtin import RULES

FIRES = {
    "GO-SQL-CONCATENATION": 'db.Query("select " + id)', "GO-UNESCAPED-TEMPLATE": "template.HTML(x)", "GO-WEAK-RANDOM-SECURITY": "token := rand.Int()", "GO-UNSAFE-POINTER": "p := unsafe.Pointer(&x)", "GO-IGNORING-TLS-ERROR": "_ = conn.Handshake()",
    "GO-INSECURE-SKIP-VERIFY": "InsecureSkipVerify: true", "GO-COMMAND-INJECTION": 'exec.Command("sh", "-c", x)', "JAVA-SQL-CONCATENATION": 's.executeQuery("select " + x)', "JAVA-OBJECT-DESERIALIZATION": "new ObjectInputStream(in)",
    "JAVA-XXE-DOCUMENT-BUILDER": "DocumentBuilderFactory.newInstance()", "JAVA-WEAK-RANDOM-SECURITY": "new Random()", "JAVA-MESSAGE-DIGEST-MD5": 'MessageDigest.getInstance("MD5")', "JAVA-RUNTIME-EXEC-CONCAT": 'Runtime.getRuntime().exec("a" + b)',
    "JAVA-WEAK-CIPHER-ECB": 'Cipher.getInstance("AES/ECB/X")', "JAVA-TRUST-ALL-CERTS": "public void checkServerTrusted(X[] c, String a) {}", "JS-EVAL-USE": "eval(x)", "JS-INNERHTML-XSS": "e.innerHTML = x", "JS-DOCUMENT-WRITE": "document.write(x)",
    "JS-HARDCODED-SECRET-ASSIGN": "const api_key = 'abcdefgh1'", "JS-JWT-NONE-ALG": "algorithms: ['none']", "JS-INSECURE-RANDOM-SECURITY": "token = Math.random()", "JS-DISABLE-TLS-REJECT-UNAUTHORIZED": "rejectUnauthorized: false",
    "JS-CHILD-PROCESS-EXEC": "exec('ls ' + x)", "JS-REGEX-DOS": "new RegExp(user)", "RUBY-MASS-ASSIGNMENT": "User.new(params[:user])", "RUBY-YAML-LOAD": "YAML.load(x)", "RUBY-SYSTEM-INTERPOLATION": 'system("ls #{x}")', "RUBY-SQL-INTERPOLATION": 'User.where("id = #{x}")',
    "RUBY-EVAL-USE": "eval(x)", "RUBY-SEND-FROM-PARAMS": "o.send(params[:m])", "PHP-EVAL-USE": "eval($x);", "PHP-SQL-CONCAT": 'mysql_query("a" . $x);', "PHP-UNSERIALIZE-USE": "unserialize($x)", "PHP-SUPERGLOBAL-IN-SQL": '"select * from t where a=" . $_GET["a"]',
    "PHP-ECHO-SUPERGLOBAL": "echo $_GET['a'];", "PHP-DYNAMIC-INCLUDE": "include($_GET['p']);", "PHP-COMMAND-SUPERGLOBAL": "system($_POST['c']);", "PHP-WEAK-PASSWORD-HASH": "md5($password)", "CSHARP-XML-EXTERNAL-ENTITY": "DtdProcessing.Parse",
    "TERRAFORM-HARDCODED-SECRET": 'password = "hunter22"', "JWT-ALGORITHM-NONE": '"alg": "none"', "PY-DJANGO-DEBUG-TRUE": "DEBUG = True", "PY-DJANGO-SECRET-HARDCODED": "SECRET_KEY = 'abcdefghij'", "PY-ALLOWED-HOSTS-WILDCARD": "ALLOWED_HOSTS = ['*']",
    "PY-PICKLE-REQUEST-DATA": "pickle.loads(request.data)", "SHELL-CURL-PIPE-SH": "curl https://x | sh", "SHELL-WGET-PIPE-SH": "wget -O- x | bash", "SHELL-CHMOD-777": "chmod -R 777 /x", "SHELL-UNQUOTED-VARIABLE": "rm -rf $DIR",
    "DOCKERFILE-ADD-REMOTE-URL": "ADD https://x /y", "YAML-K8S-PRIVILEGED-CONTAINER": "  privileged: true", "YAML-K8S-HOST-NETWORK": "hostNetwork: true", "YAML-K8S-RUN-AS-ROOT": "runAsUser: 0", "SQL-GRANT-ALL-PRIVILEGES": "GRANT ALL ON x TO y",
    "DOTENV-COMMITTED-SECRET": "DB_PASSWORD=hunter22",
}
QUIET = [("php", "echo htmlspecialchars($_GET['a']);"), ("ruby", "YAML.safe_load(x)"), ("dotenv", "API_KEY=changeme"), ("python", "SECRET_KEY = os.environ['K1234567']"), ("javascript", "const token = process.env.TOKEN"), ("java", "new SecureRandom()")]


def test_all_rules(spark):
    assert len(RULES) == 55 == len({r.rule_id for r in RULES}) and set(FIRES) == {r.rule_id for r in RULES}
    rows = [(r.rule_id, r.languages[0], FIRES[r.rule_id]) for r in RULES] + [(None, lang, line) for lang, line in QUIET]
    lines = spark.createDataFrame(rows, "want string, language string, line_text string")
    whole = detect.scan_whole(lines.withColumnRenamed("line_text", "text"), RULES).select("want", "rule_id")
    got = detect.scan(lines, RULES, "language").select("want", "rule_id").unionByName(whole).collect()
    assert {r.rule_id for r in RULES} == {r.want for r in got if r.want == r.rule_id}
    assert [r for r in got if r.want is None] == []


@pytest.mark.parametrize("language,line,comment", [("python", "  # x", True), ("go", "// x", True), ("go", "x // y", False), ("other", "# x", False)])
def test_comments(spark, language, line, comment):
    df = spark.createDataFrame([(language, line)], "language string, line string")
    assert df.select(detect.is_comment(F.col("line"), F.col("language"))).first()[0] is comment


PYTHON = '''"""Doc.

DEBUG = True
"""
DEBUG = True
# DEBUG = True
def f():
    """One line: DEBUG"""
    x = """
DEBUG = True
"""
'''
PACK = "rules:\n  - id: A\n    pattern: privileged: true\n    message: >\n      privileged:true\n    languages: [yaml]\nprivileged: true\n"


def test_masks(spark):
    assert detect.docstring_lines(PYTHON.splitlines()) == {1, 2, 3, 4, 8, 11}  # the last quote opens at the start of a line
    assert detect.definition_lines(PACK.splitlines()) == {3, 4, 5}
    assert detect.definition_lines("rules:\n  - x\nprivileged: true".splitlines()) == set()
    files = spark.createDataFrame([("a.py", "python", PYTHON), ("p.yml", "yaml", PACK), ("k.yml", "yaml", "privileged: true\n# privileged: true"), ("a.js", "javascript", "// eval(x)\n/* eval(x) */"), ("n.py", "python", None)], "rel_path string, language string, text string")
    got = {(r.rel_path, r.line) for r in detect.scan(detect.code_lines(files), RULES, "language").collect()}
    assert got == {("a.py", 5), ("a.py", 10), ("p.yml", 7), ("k.yml", 1), ("a.js", 2)}


def test_whole_file_rules(spark):
    java = "class T {\n  public void checkServerTrusted(X[] c,\n      String a)\n  {\n  }\n}\n"
    files = spark.createDataFrame([("T.java", "java", java), ("T.go", "go", java), ("N.java", "java", None)], "rel_path string, language string, text string")
    r = detect.scan_whole(files, RULES).collect()
    assert [(x.rel_path, x.rule_id, x.line, x.end_line) for x in r] == [("T.java", "JAVA-TRUST-ALL-CERTS", 2, 5)]
    assert r[0].snippet == "\n".join(java.split("\n")[1:5])
