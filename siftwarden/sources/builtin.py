"""The packaged rules: ids, languages, severities and confidences are fixed values; the patterns are our own.

Patterns hold for Java's regular expressions, RE2 and Python alike; rules marked `whole` are matched by Python on whole files.
"""

from __future__ import annotations

from siftwarden.operators.detect import Rule

_JS = ("javascript", "typescript")


def _rule(rule_id: str, languages: tuple[str, ...] | str, severity: str, confidence: str, pattern: str, exclude: str | None = None, needs: tuple[str, ...] = (), whole: bool = False) -> Rule:
    return Rule(rule_id, severity, pattern, (languages,) if isinstance(languages, str) else languages, exclude, confidence, "code", needs, whole)


RULES = [
    _rule("GO-SQL-CONCATENATION", "go", "critical", "high", r'\.(Query|QueryRow|Exec)(Context)?\([^)]*("\s*\+|fmt\.Sprintf\()'),
    _rule("GO-UNESCAPED-TEMPLATE", "go", "high", "medium", r"template\.(HTML|JS|URL)\(", needs=("template.",)),
    _rule("GO-WEAK-RANDOM-SECURITY", "go", "high", "medium", r'(?i)(token|secret|password|nonce|session)\w*\s*:?=.*\brand\.(Int|Read|Uint)', needs=("rand.",)),
    _rule("GO-UNSAFE-POINTER", "go", "medium", "medium", r"\bunsafe\.Pointer\(", needs=("unsafe.Pointer",)),
    _rule("GO-IGNORING-TLS-ERROR", "go", "medium", "medium", r"_\s*=\s*\w*[cC]onn\w*\.(Handshake|VerifyHostname)\("),
    _rule("GO-INSECURE-SKIP-VERIFY", "go", "critical", "high", r"InsecureSkipVerify\s*:\s*true", needs=("InsecureSkipVerify",)),
    _rule("GO-COMMAND-INJECTION", "go", "high", "low", r'exec\.Command(Context)?\(.*("(ba)?sh"\s*,\s*"-c"|\+)', needs=("exec.Command",)),
    _rule("JAVA-SQL-CONCATENATION", "java", "critical", "high", r'\.(executeQuery|executeUpdate|execute|prepareStatement)\(\s*"[^"]*"\s*\+', r"^\s*(//|\*)"),
    _rule("JAVA-OBJECT-DESERIALIZATION", "java", "critical", "high", r"new\s+ObjectInputStream\(|\.readObject\(\)"),
    _rule("JAVA-XXE-DOCUMENT-BUILDER", "java", "high", "medium", r"DocumentBuilderFactory\.newInstance\(\)", needs=("DocumentBuilderFactory",)),
    _rule("JAVA-WEAK-RANDOM-SECURITY", "java", "high", "medium", r"new\s+(java\.util\.)?Random\(|Math\.random\(\)", r"SecureRandom"),
    _rule("JAVA-MESSAGE-DIGEST-MD5", "java", "medium", "high", r'MessageDigest\.getInstance\(\s*"(MD5|SHA-?1)"', needs=("MessageDigest",)),
    _rule("JAVA-RUNTIME-EXEC-CONCAT", "java", "critical", "high", r"getRuntime\(\)\.exec\([^)]*\+", needs=("getRuntime",)),
    _rule("JAVA-WEAK-CIPHER-ECB", "java", "high", "high", r'Cipher\.getInstance\(\s*"(DES|RC4|[A-Za-z]+/ECB)', needs=("Cipher.",)),
    _rule("JAVA-TRUST-ALL-CERTS", "java", "critical", "high", r"void\s+checkServerTrusted\([^)]*\)[^{]*\{\s*\}", needs=("checkServerTrusted",), whole=True),
    _rule("JS-EVAL-USE", _JS, "high", "medium", r"\beval\(|new\s+Function\("),
    _rule("JS-INNERHTML-XSS", _JS, "medium", "low", r"\.(innerHTML|outerHTML)\s*\+?=", needs=("HTML",)),
    _rule("JS-DOCUMENT-WRITE", _JS, "low", "low", r"document\.write(ln)?\(", needs=("document.write",)),
    _rule("JS-HARDCODED-SECRET-ASSIGN", _JS, "high", "medium", r"""(?i)\b(const|let|var)\s+\w*(secret|password|api_?key|token)\w*\s*=\s*["'][^"']{8,}["']""", r"(?i)process\.env|example|changeme"),
    _rule("JS-JWT-NONE-ALG", _JS, "critical", "high", r"""algorithms?\s*:\s*\[?\s*["']none["']"""),
    _rule("JS-INSECURE-RANDOM-SECURITY", _JS, "medium", "medium", r"(?i)(token|secret|password|nonce|session)\w*\s*[:=].*math\.random\(\)"),
    _rule("JS-DISABLE-TLS-REJECT-UNAUTHORIZED", _JS, "critical", "high", r"rejectUnauthorized\s*:\s*false|NODE_TLS_REJECT_UNAUTHORIZED\W+0"),
    _rule("JS-CHILD-PROCESS-EXEC", _JS, "high", "medium", r"\bexec(Sync)?\(\s*(`[^`]*\$\{|[^)]*\+)"),
    _rule("JS-REGEX-DOS", _JS, "low", "low", r"new\s+RegExp\(\s*[A-Za-z_]"),
    _rule("RUBY-MASS-ASSIGNMENT", "ruby", "medium", "low", r"\.(new|create|update)\(\s*params(\[:\w+\])?\s*\)|permit!"),
    _rule("RUBY-YAML-LOAD", "ruby", "high", "medium", r"YAML\.load\(", r"safe_load|permitted_classes"),
    _rule("RUBY-SYSTEM-INTERPOLATION", "ruby", "critical", "high", r'\b(system|exec)\(?\s*"[^"]*#\{|`[^`]*#\{'),
    _rule("RUBY-SQL-INTERPOLATION", "ruby", "critical", "high", r'\.(where|find_by_sql|execute|order)\(\s*"[^"]*#\{'),
    _rule("RUBY-EVAL-USE", "ruby", "high", "medium", r"\b(eval|instance_eval|class_eval)[\s(]+\w"),
    _rule("RUBY-SEND-FROM-PARAMS", "ruby", "high", "high", r"\.(send|public_send)\(\s*params\[", needs=("params",)),
    _rule("PHP-EVAL-USE", "php", "critical", "medium", r"\beval\s*\("),
    _rule("PHP-SQL-CONCAT", "php", "high", "medium", r"""(?i)(mysqli?_query|->query|->exec)\s*\([^;]*["']\s*\.\s*\$"""),
    _rule("PHP-UNSERIALIZE-USE", "php", "high", "high", r"\bunserialize\s*\(\s*\$", needs=("unserialize",)),
    _rule("PHP-SUPERGLOBAL-IN-SQL", "php", "critical", "high", r"(?i)(select|insert|update|delete)\s.*\$_(GET|POST|REQUEST|COOKIE)", needs=("$_",)),
    _rule("PHP-ECHO-SUPERGLOBAL", "php", "high", "high", r"\b(echo|print)\b.*\$_(GET|POST|REQUEST|COOKIE)", r"htmlspecialchars|htmlentities", needs=("$_",)),
    _rule("PHP-DYNAMIC-INCLUDE", "php", "critical", "high", r"\b(include|require)(_once)?\b\s*\(?\s*\$_(GET|POST|REQUEST|COOKIE)", needs=("$_",)),
    _rule("PHP-COMMAND-SUPERGLOBAL", "php", "critical", "high", r"\b(exec|system|shell_exec|passthru|popen)\s*\(.*\$_(GET|POST|REQUEST|COOKIE)", needs=("$_",)),
    _rule("PHP-WEAK-PASSWORD-HASH", "php", "high", "high", r"(?i)\b(md5|sha1)\s*\(\s*\$\w*pass"),
    _rule("CSHARP-XML-EXTERNAL-ENTITY", "csharp", "high", "low", r"DtdProcessing\.Parse|new\s+XmlTextReader\(|XmlResolver\s*=\s*new\s", whole=True),
    _rule("TERRAFORM-HARDCODED-SECRET", "terraform", "high", "medium", r'(?i)\b(password|secret|token|api_key)\w*\s*=\s*"[^"$]{6,}"', r"(?i)var\.|data\.|example"),
    _rule("JWT-ALGORITHM-NONE", ("python", "javascript", "typescript", "go", "ruby", "php"), "critical", "high", r"""(?i)\balg(orithms?)?["']?\s*(:|=|=>)\s*\[?\s*["']none["']"""),
    _rule("PY-DJANGO-DEBUG-TRUE", "python", "high", "high", r"^DEBUG\s*=\s*True\b", needs=("DEBUG",)),
    _rule("PY-DJANGO-SECRET-HARDCODED", "python", "critical", "high", r"""^SECRET_KEY\s*=\s*["'][^"']{8,}["']""", r"(?i)environ|getenv|config\(", needs=("SECRET_KEY",)),
    _rule("PY-ALLOWED-HOSTS-WILDCARD", "python", "medium", "medium", r"""^ALLOWED_HOSTS\s*=\s*\[[^\]]*["']\*["']""", needs=("ALLOWED_HOSTS",)),
    _rule("PY-PICKLE-REQUEST-DATA", "python", "critical", "high", r"pickle\.loads?\(.*\brequest\.", needs=("pickle.",)),
    _rule("SHELL-CURL-PIPE-SH", "shell", "high", "high", r"\bcurl\b[^|]*\|\s*(sudo\s+)?(ba|z|da)?sh\b", needs=("curl",)),
    _rule("SHELL-WGET-PIPE-SH", "shell", "high", "high", r"\bwget\b[^|]*\|\s*(sudo\s+)?(ba|z|da)?sh\b", needs=("wget",)),
    _rule("SHELL-CHMOD-777", "shell", "medium", "high", r"\bchmod\s+(-R\s+)?0?777\b", needs=("chmod",)),
    _rule("SHELL-UNQUOTED-VARIABLE", "shell", "low", "medium", r"\brm\s+(-\w+\s+)*\$\w+", needs=("rm",)),
    _rule("DOCKERFILE-ADD-REMOTE-URL", ("other", "dockerfile"), "medium", "medium", r"^\s*ADD\s+https?://", needs=("ADD",)),
    _rule("YAML-K8S-PRIVILEGED-CONTAINER", "yaml", "critical", "high", r"^\s*privileged:\s*true\b", needs=("privileged",)),
    _rule("YAML-K8S-HOST-NETWORK", "yaml", "high", "high", r"^\s*hostNetwork:\s*true\b", needs=("hostNetwork",)),
    _rule("YAML-K8S-RUN-AS-ROOT", "yaml", "medium", "high", r"^\s*runAsUser:\s*0\b", needs=("runAsUser",)),
    _rule("SQL-GRANT-ALL-PRIVILEGES", "sql", "medium", "high", r"(?i)\bgrant\s+all(\s+privileges)?\s+on\b"),
    _rule("DOTENV-COMMITTED-SECRET", "dotenv", "high", "medium", r"^\s*\w*(SECRET|PASSWORD|TOKEN|API_KEY)\w*\s*=\s*\S{6,}", r"(?i)changeme|example|your|<|\$\{"),
]
