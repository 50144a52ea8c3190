"""Rule catalogues: code rules, configuration rules, taint patterns, symbol patterns. Plain data.

A rule's ``guards`` are literal strings of which a line must hold one before the pattern is tried (compared in lower
case); they make the scan cheap and never change what a pattern finds. ``mode`` is ``line``, ``file`` (the pattern may
span lines; reported at line 1) or ``absent`` (reported when the pattern is nowhere in the file).
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    rule_id: str
    severity: str
    cwe_id: str
    languages: tuple[str, ...]
    pattern: str
    guards: tuple[str, ...]
    fix: str
    mode: str = "line"
    files: tuple[str, ...] = ()


PY, JS, JAVA, C = ("python",), ("javascript", "typescript"), ("java",), ("c", "cpp")
SERVER = ("rust", "python", "javascript", "typescript", "go", "java")
ANY = ()

CODE_RULES = [
    Rule("sql-injection-string-concat", "high", "CWE-89", SERVER, r"(?i)[\"'](?:select|insert|update|delete)\b[^\"']*[\"']\s*(?:\+|%|\.format|\|\|)", ("select", "insert", "update", "delete"), "Use bound parameters."),
    Rule("sql-injection-fstring", "high", "CWE-89", PY, r"(?i)\bf[\"'](?:select|insert|update|delete)\b[^\"']*\{", ("select", "insert", "update", "delete"), "Use bound parameters."),
    Rule("command-injection", "critical", "CWE-78", SERVER, r"(?i)\b(?:os\.system|os\.popen|subprocess\.\w+|child_process\.exec|exec\.Command|Runtime\.getRuntime\(\)\.exec|Command::new)\s*\(.*(?:\+|\bf[\"']|format|shell\s*=\s*True|\$\{)", ("os.", "subprocess", "exec", "command"), "Pass a fixed program and a list of arguments."),
    Rule("hardcoded-api-key", "high", "CWE-798", ANY, r"(?i)\bapi[_-]?key\b[\"']?\s*[:=]\s*[\"'][A-Za-z0-9_-]{16,}[\"']", ("api",), "Read the key from a secret store."),
    Rule("aws-access-key", "critical", "CWE-798", ANY, r"\bA(?:KIA|SIA)[0-9A-Z]{16}\b", ("akia", "asia"), "Revoke the key and read it from a secret store."),
    Rule("private-key", "critical", "CWE-321", ANY, r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", ("private key",), "Remove the key from the source and replace it."),
    Rule("path-traversal", "high", "CWE-22", ANY, r"(?i)\b(?:open|readfile|readfilesync|sendfile|fs::read\w*)\s*\([^)]*\b(?:req|request|params|query|input)\b", ("open", "readfile", "sendfile", "fs::read"), "Resolve the path and check that it stays below a fixed folder."),
    Rule("xss-innerhtml", "medium", "CWE-79", JS, r"\.(?:innerHTML|outerHTML)\s*\+?=(?!=)", ("innerhtml", "outerhtml"), "Set text content, or sanitise the markup."),
    Rule("xss-dangerously-set", "medium", "CWE-79", JS, r"dangerouslySetInnerHTML", ("dangerouslysetinnerhtml",), "Render text, or sanitise the markup."),
    Rule("unsafe-deserialization-python", "high", "CWE-502", PY, r"\b(?:pickle|cPickle|marshal|shelve)\.loads?\s*\(|\byaml\.load\s*\((?!.*SafeLoader)", ("pickle", "marshal", "shelve", "yaml"), "Use a data-only format or a safe loader."),
    Rule("unsafe-deserialization-java", "high", "CWE-502", JAVA, r"\bnew\s+ObjectInputStream\s*\(|\.readObject\s*\(", ("objectinputstream", "readobject"), "Use a data-only format, or filter the classes."),
    Rule("weak-hash-md5", "medium", "CWE-328", ANY, r"(?i)\bmd5\s*(?:\(|::|\.|[\"'])", ("md5",), "Use SHA-256 or a password hash."),
    Rule("weak-hash-sha1", "low", "CWE-328", ANY, r"(?i)\bsha-?1\s*(?:\(|::|\.|[\"'])", ("sha1", "sha-1"), "Use SHA-256."),
    Rule("missing-csrf-check", "medium", "CWE-352", PY, r"@csrf_exempt\b|(?i)csrf[_a-z]*\s*=\s*False", ("csrf",), "Keep the framework's request-forgery check."),
    Rule("open-redirect", "medium", "CWE-601", ANY, r"(?i)\bredirect\s*\([^)]*\b(?:req|request|params|query|next|url)\b", ("redirect",), "Allow only known targets."),
    Rule("ldap-injection", "high", "CWE-90", (*PY, *JS, *JAVA), r"\(\s*(?:uid|cn|mail|sAMAccountName)=[\"']?\s*(?:\+|%|\{|\$\{)", ("uid=", "cn=", "mail=", "samaccountname="), "Escape filter values."),
    Rule("xxe-xml-parsing", "high", "CWE-611", (*PY, *JAVA, *JS), r"\b(?:DocumentBuilderFactory|SAXParserFactory|XMLInputFactory)\.newInstance|\betree\.(?:parse|fromstring)\s*\(|\bnoent\s*:\s*true", ("factory", "etree", "noent"), "Turn external entities off."),
    Rule("xpath-injection", "high", "CWE-643", ANY, r"(?i)\bxpath\s*\(\s*(?:f?[\"'][^\"']*[\"']\s*[+%]|f[\"'][^\"']*\{)", ("xpath",), "Use variables in the expression."),
    Rule("ssti-template-injection", "critical", "CWE-1336", (*PY, *JS), r"\brender_template_string\s*\(\s*[^\"')]|\bTemplate\s*\(\s*(?:req|request)\b", ("render_template_string", "template"), "Render fixed templates with values as context."),
    Rule("nosql-injection", "high", "CWE-943", (*JS, *PY), r"\$where\b|\.(?:find|findOne|update|remove)\s*\(\s*(?:req|request)\.", ("$where", ".find", ".update", ".remove"), "Build the query from checked values."),
    Rule("header-injection-crlf", "medium", "CWE-113", ANY, r"(?i)\b(?:set_?header|add_?header|writehead)\s*\([^)]*\b(?:req|request|params|input)\b", ("header", "writehead"), "Strip line breaks from header values."),
    Rule("log-injection", "low", "CWE-117", ANY, r"(?i)\b(?:log|logger|logging|console)\.\w+\s*\([^)]*\b(?:req|request)\.(?:body|query|params|args|form)", ("log", "console"), "Strip line breaks before logging."),
    Rule("hardcoded-jwt-secret", "critical", "CWE-798", ANY, r"(?i)\bjwt\.(?:sign|encode|verify|decode)\s*\([^)]*,\s*[\"'][^\"']{4,}[\"']", ("jwt",), "Read the signing key from a secret store."),
    Rule("permissive-cors", "medium", "CWE-942", ANY, r"(?i)access-control-allow-origin[\"']?\s*[,:=]\s*[\"']\*|\borigin\s*:\s*[\"']\*[\"']|allow_origins\s*=\s*\[[\"']\*", ("origin",), "List the allowed origins."),
    Rule("insecure-cookie", "medium", "CWE-614", ANY, r"(?i)\b(?:secure|httponly|http_only)\s*[:=]\s*false", ("secure", "httponly", "http_only"), "Set secure and http-only."),
    Rule("session-fixation", "high", "CWE-384", (*PY, *JS), r"(?i)\bsession(?:\.sid|\.id|_id|\[[\"']id[\"']\])\s*=\s*(?:req|request)\b", ("session",), "Make a new session at login."),
    Rule("missing-auth-decorator", "low", "CWE-862", PY, r"(?m)^@\w+\.route\([^)]*\)\s*\ndef ", (".route",), "Require a login for the route.", "file"),
    Rule("weak-random", "medium", "CWE-338", ANY, r"\bMath\.random\s*\(|\brandom\.(?:random|randint|choice)\s*\(|\brand\s*\(\s*\)", ("random", "rand"), "Use a cryptographic generator."),
    Rule("ecb-mode", "high", "CWE-327", ANY, r"\bMODE_ECB\b|(?i)aes/ecb|[\"']aes-\d+-ecb[\"']", ("ecb",), "Use an authenticated mode."),
    Rule("hardcoded-iv-nonce", "medium", "CWE-329", ANY, r"(?i)\b(?:iv|nonce)\b\s*[:=]\s*b?[\"'][^\"']{8,}[\"']", ("iv", "nonce"), "Draw a new value for each message."),
    Rule("stack-trace-exposure", "medium", "CWE-209", ANY, r"\bprintStackTrace\s*\(|\btraceback\.(?:print_exc|format_exc)\s*\(|\.stack\s*\)", ("stack", "traceback"), "Log the trace and answer without it."),
    Rule("debug-mode-production", "medium", "CWE-489", ANY, r"(?i)\bdebug\s*=\s*true\b", ("debug",), "Turn debugging off."),
    Rule("verbose-error-response", "medium", "CWE-209", (*JS, *JAVA), r"\b(?:send|json|write|body)\s*\([^)]*\b(?:err|error|ex|e)\.(?:message|stack|getMessage)", ("err", ".message", ".stack", "getmessage"), "Answer with a general message."),
    Rule("todo-with-secret", "low", "CWE-615", ANY, r"(?i)(?:#|//|/\*)\s*(?:todo|fixme|hack)\b.*\b(?:password|secret|token|key)\b", ("todo", "fixme", "hack"), "Remove the remark."),
    Rule("buffer-overflow-c", "critical", "CWE-120", C, r"\b(?:gets|strcpy|strcat|sprintf|vsprintf)\s*\(", ("gets", "strcpy", "strcat", "sprintf"), "Use the bounded form."),
    Rule("use-after-free", "critical", "CWE-416", C, r"\bfree\s*\(\s*(\w+)\s*\)\s*;.*\b\1\b\s*(?:->|\[)", ("free",), "Set the pointer to null after it is freed."),
    Rule("integer-overflow", "medium", "CWE-190", ("rust", *JAVA, *C), r"\b(?:malloc|alloca|new\s+\w+\s*\[)\s*\(?[^;)]*\*[^;)]*|\bas\s+(?:u8|i8|u16|i16)\b", ("malloc", "alloca", "new ", " as "), "Check the range before computing."),
    Rule("regex-dos", "medium", "CWE-1333", ANY, r"\([^()]*[+*]\)[+*]", (")+", ")*"), "Rewrite without nested repeats."),
    Rule("ssrf", "high", "CWE-918", ANY, r"(?i)\b(?:requests\.\w+|fetch|axios(?:\.\w+)?|urlopen|http\.get|reqwest::get)\s*\([^)]*\b(?:req|request|params|query|input)\b", ("requests", "fetch", "axios", "urlopen", "http.get", "reqwest"), "Allow only known hosts."),
    Rule("toctou-race", "medium", "CWE-367", (*PY, *JAVA, *C), r"(?s)\b(?:os\.path\.exists|access|exists)\s*\([^)]*\)[^\n]*\n[^\n]*\b(?:open|fopen|remove|unlink)\s*\(", ("exists", "access"), "Open the file and handle the error.", "file"),
    Rule("prototype-pollution", "high", "CWE-1321", JS, r"__proto__|\bconstructor\s*\[\s*[\"']prototype|\bObject\.assign\s*\(\s*\{\}\s*,\s*(?:req|request)\b", ("__proto__", "prototype", "object.assign"), "Reject such keys."),
    Rule("github-token", "critical", "CWE-798", ANY, r"\bgh[pousr]_[A-Za-z0-9]{36}\b", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "Revoke the token."),
    Rule("slack-token", "critical", "CWE-798", ANY, r"\bxox[abprs]-[A-Za-z0-9-]{10,}", ("xox",), "Revoke the token."),
    Rule("google-api-key", "high", "CWE-798", ANY, r"\bAIza[0-9A-Za-z_-]{35}", ("aiza",), "Restrict or revoke the key."),
    Rule("connection-string-password", "high", "CWE-798", ANY, r"(?i)\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp)://[^:/\s]+:[^@/\s]+@", ("://",), "Read the password from a secret store."),
]

DOCKER, K8S, TF, CI, ENV = ("Dockerfile", "*.dockerfile"), ("*.yml", "*.yaml"), ("*.tf",), (".github/workflows/",), (".env", "*.env")
CONF = (".env", "*.env", "*.conf", "*.cfg", "*.ini")
HELM = ("*/templates/*.yml", "*/templates/*.yaml")


def _config(rule_id: str, severity: str, cwe: str, files: tuple[str, ...], pattern: str, fix: str, mode: str = "line") -> Rule:
    return Rule(rule_id, severity, cwe, ANY, pattern, (), fix, mode, files)


CONFIG_RULES = [
    _config("docker-run-as-root", "medium", "CWE-250", DOCKER, r"(?m)^USER\s+(?!root\b)", "Add a USER line.", "absent"),
    _config("docker-latest-tag", "low", "CWE-1104", DOCKER, r"(?i)^FROM\s+\S+:latest\b", "Pin the image."),
    _config("docker-copy-all", "medium", "CWE-200", DOCKER, r"(?i)^COPY\s+\.\s", "Copy named files."),
    _config("docker-add-remote", "medium", "CWE-829", DOCKER, r"(?i)^ADD\s+https?://", "Fetch with a checksum."),
    _config("docker-secret-in-env", "high", "CWE-798", DOCKER, r"(?i)^(?:ENV|ARG)\s+\w*(?:PASSWORD|SECRET|TOKEN|KEY)\w*[= ]\S", "Pass secrets at run time."),
    _config("docker-no-healthcheck", "low", "CWE-693", DOCKER, r"(?m)^HEALTHCHECK\b", "Add a HEALTHCHECK line.", "absent"),
    _config("docker-expose-sensitive-port", "medium", "CWE-284", DOCKER, r"(?i)^EXPOSE\s+.*\b(?:22|2375|3306|5432|6379|27017)\b", "Keep the port inside."),
    _config("docker-apt-no-recommends", "low", "CWE-1104", DOCKER, r"apt-get install(?!.*--no-install-recommends)", "Add --no-install-recommends."),
    _config("k8s-privileged-container", "critical", "CWE-250", K8S, r"^\s*-?\s*privileged:\s*true\b", "Drop the privilege."),
    _config("k8s-host-network", "high", "CWE-284", K8S, r"^\s*hostNetwork:\s*true\b", "Use the pod network."),
    _config("k8s-host-pid", "high", "CWE-284", K8S, r"^\s*hostPID:\s*true\b", "Use the pod's processes."),
    _config("k8s-run-as-root", "high", "CWE-250", K8S, r"^\s*(?:runAsUser:\s*0|runAsNonRoot:\s*false)\b", "Run as a user of its own."),
    _config("k8s-latest-image", "low", "CWE-1104", K8S, r"^\s*-?\s*image:\s*\S+:latest\b", "Pin the image."),
    _config("k8s-plaintext-secret", "high", "CWE-798", K8S, r"(?i)^\s*(?:password|secret|token|api_?key):\s*[\"']?[A-Za-z0-9+/=_-]{8,}", "Use a secret reference."),
    _config("k8s-capabilities-all", "critical", "CWE-250", K8S, r"(?m)capabilities:\s*\n\s*add:\s*(?:\n\s*-|\[)\s*[\"']?ALL\b", "Add only what is needed.", "file"),
    _config("k8s-no-resource-limits", "medium", "CWE-770", K8S, r"^\s*resources:\s*\{\s*\}", "Set limits."),
    _config("tf-s3-no-encryption", "high", "CWE-311", TF, r"(?i)\bencrypt(?:ion|ed)?\w*\s*=\s*false", "Encrypt the bucket."),
    _config("tf-security-group-wide-open", "high", "CWE-284", TF, r"cidr_blocks\s*=\s*\[\s*\"0\.0\.0\.0/0\"", "Name the networks."),
    _config("tf-rds-no-encryption", "high", "CWE-311", TF, r"storage_encrypted\s*=\s*false", "Encrypt the storage."),
    _config("tf-hardcoded-credentials", "critical", "CWE-798", (*TF, "*.tfvars"), r"(?i)\b(?:access_key|secret_key|password|token)\s*=\s*\"[^\"$]{8,}\"", "Use variables from a secret store."),
    _config("tf-public-subnet-db", "medium", "CWE-284", TF, r"publicly_accessible\s*=\s*true", "Keep the database inside."),
    _config("tf-no-logging", "medium", "CWE-778", TF, r"(?i)\b(?:enable_logging|logging_enabled)\s*=\s*false", "Turn logging on."),
    _config("ci-plaintext-secret", "critical", "CWE-798", (*CI, ".gitlab-ci.yml", "Jenkinsfile", ".circleci/"), r"(?i)\b\w*(?:password|secret|token|api_key)\w*\s*[:=]\s*[\"']?(?!\$)[A-Za-z0-9+/_-]{12,}", "Use the secret store of the service."),
    _config("ci-pull-request-target", "high", "CWE-284", CI, r"\bpull_request_target\b", "Use pull_request."),
    _config("ci-unpinned-action", "medium", "CWE-829", CI, r"\buses:\s*[\w./-]+@(?:main|master|v\d+)\s*$", "Pin the action to a commit."),
    _config("ci-self-hosted-runner", "medium", "CWE-284", CI, r"\bruns-on:.*self-hosted", "Use isolated runners."),
    _config("ci-permissions-write-all", "high", "CWE-250", CI, r"\bpermissions:\s*write-all", "Name the permissions."),
    _config("ci-npm-install", "low", "CWE-829", (*CI, ".gitlab-ci.yml", "Jenkinsfile"), r"\bnpm (?:install|i)\b", "Use npm ci."),
    _config("env-debug-enabled", "medium", "CWE-489", (*ENV, ".env.production"), r"(?i)^\s*\w*DEBUG\w*\s*=\s*(?:1|true|on)\b", "Turn debugging off."),
    _config("env-database-password", "high", "CWE-798", (*CONF, ".env.production"), r"(?i)^\s*\w*(?:DB|DATABASE|PG|MYSQL)\w*PASS\w*\s*=\s*\S", "Use a secret store."),
    _config("env-default-credentials", "high", "CWE-798", (*CONF, "*.yml", "*.yaml", "*.properties"), r"(?i)\b\w*pass(?:word)?\w*\s*[:=]\s*[\"']?(?:admin|password|changeme|root|123456)\b", "Set a strong password."),
    _config("env-cors-wildcard", "medium", "CWE-942", (*ENV, "*.conf", "*.cfg"), r"(?i)\bCORS\w*\s*=\s*[\"']?\*", "List the origins."),
    _config("env-no-tls", "high", "CWE-295", (*ENV, "*.conf", "*.cfg", "*.yml", "*.yaml"), r"(?i)\b(?:ssl|tls)[_-]?(?:verify|enabled|mode)\w*\s*[:=]\s*[\"']?(?:false|0|off|disable)", "Turn TLS checks on."),
    _config("env-secret-in-config", "high", "CWE-798", (*CONF, "*.properties", "config.yml", "config.yaml", "settings.yml"), r"(?i)\b\w*(?:secret|api_?key|private_?key|token)\w*\s*[:=]\s*[\"']?[A-Za-z0-9+/=_-]{16,}", "Use a secret store."),
    _config("helm-default-secret", "medium", "CWE-798", ("values.yml", "values.yaml", *HELM), r"(?i)^\s*\w*(?:password|secret)\w*:\s*[\"']?\w+", "Leave the default empty."),
    _config("helm-privileged", "high", "CWE-250", HELM, r"^\s*privileged:\s*true\b", "Drop the privilege."),
    _config("nginx-autoindex", "medium", "CWE-548", ("nginx.conf", "*.nginx", "*.conf"), r"^\s*autoindex\s+on\b", "Turn the listing off."),
    _config("nginx-server-tokens", "low", "CWE-200", ("nginx.conf", "*.nginx", "*.conf"), r"^\s*server_tokens\s+on\b", "Turn the version off."),
]

#: Where tainted values come from, by language: (pattern, category).
SOURCES = {
    "python": [*((p, "input") for p in ("request.args", "request.form", "request.json", "request.data", "request.get_json", "input(", "sys.argv")), ("os.environ", "environment")],
    "javascript": [*((p, "input") for p in ("req.body", "req.params", "req.query", "req.headers", "location.search", "document.cookie")), ("process.env", "environment")],
    "go": [(p, "input") for p in ("r.URL.Query", "r.FormValue", "r.Body")],
    "java": [(p, "input") for p in ("getParameter(", "getHeader(", "getInputStream(", "getQueryString(")],
    "rust": [(p, "input") for p in ("std::env::args", "Query<", "Json<")],
}
SOURCES["typescript"] = SOURCES["javascript"]
#: Where they do harm, by language: (pattern, category).
SINKS = {
    "python": [
        *((p, "sql") for p in ("execute(", "cursor.execute", "f\"SELECT", "f\"INSERT", "f\"UPDATE", "f\"DELETE")), *((p, "command") for p in ("os.system", "os.popen", "subprocess.", "eval(", "exec(")),
        ("render_template_string", "xss"), *((p, "deserialization") for p in ("pickle.loads", "yaml.load(", "marshal.loads")),
    ],
    "javascript": [*((p, "sql") for p in ("execute(", "db.query", ".raw(", "sequelize.query")), *((p, "command") for p in ("child_process", "exec(", "eval(")), ("innerHTML", "xss"), ("document.write", "xss"), ("unserialize(", "deserialization")],
    "typescript": [*((p, "sql") for p in ("db.query", ".raw(", "sequelize.query")), *((p, "command") for p in ("child_process", "exec(", "eval(")), ("innerHTML", "xss"), ("document.write", "xss"), ("unserialize(", "deserialization")],
    "java": [*((p, "sql") for p in ("execute(", "executeQuery(", "createQuery(")), ("Runtime.getRuntime", "command"), ("ProcessBuilder", "command")],
}
#: CWE and severity of a sink's category.
SINK_CWE = {"sql": "CWE-89", "command": "CWE-78", "xss": "CWE-79", "deserialization": "CWE-502", "file": "CWE-22"}
SINK_SEVERITY = {"sql": "critical", "command": "critical", "xss": "high", "deserialization": "high", "file": "medium"}
#: Words that make a called function risky.
RISKY = (
    "exec", "query", "raw_sql", "eval", "spawn", "command", "deserialize", "from_str", "from_bytes", "unmarshal", "decode", "open", "read_file", "write_file", "remove", "unlink", "rename",
    "encrypt", "decrypt", "hash", "sign", "verify", "send", "request", "fetch", "get", "post", "redirect", "set_cookie", "create_token", "upload", "download", "serialize",
)

#: (kind, pattern with the name as group 1) of declarations, by language.
SYMBOLS = {
    "rust": [("function", r"^(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+(\w+)"), ("method", r"^\s+(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)"), ("struct", r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)"), ("enum", r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)"), ("trait", r"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+(\w+)")],
    "python": [("function", r"^(?:async\s+)?def\s+(\w+)"), ("method", r"^\s+(?:async\s+)?def\s+(\w+)"), ("class", r"^\s*class\s+(\w+)")],
    "javascript": [("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s+(\w+)"), ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>"), ("class", r"^\s*(?:export\s+)?(?:default\s+)?class\s+(\w+)")],
    "go": [("function", r"^func\s+(\w+)"), ("method", r"^func\s+\([^)]*\)\s+(\w+)"), ("type", r"^type\s+(\w+)")],
    "java": [("class", r"^\s*(?:public\s+|private\s+|protected\s+)?(?:abstract\s+|final\s+|static\s+)*class\s+(\w+)"), ("interface", r"^\s*(?:public\s+)?interface\s+(\w+)"), ("method", r"^\s+(?:public|private|protected)\s+(?:static\s+|final\s+|synchronized\s+)*[\w<>\[\], ]+\s(\w+)\s*\(")],
    "ruby": [("method", r"^\s*def\s+(?:self\.)?(\w+[?!]?)"), ("class", r"^\s*class\s+(\w+)"), ("module", r"^\s*module\s+(\w+)")],
    "php": [("function", r"^\s*(?:(?:public|private|protected|static|abstract|final)\s+)*function\s+(\w+)"), ("class", r"^\s*(?:abstract\s+|final\s+)?class\s+(\w+)")],
    "c": [("function", r"^(?!(?:if|for|while|switch|return|else)\b)[A-Za-z_][\w\s*]*?\b(?!(?:if|for|while|switch|return|else)\b)(\w+)\s*\([^;]*\)\s*\{?\s*$"), ("struct", r"^\s*(?:typedef\s+)?struct\s+(\w+)"), ("macro", r"^#define\s+(\w+)")],
    "cpp": [("class", r"^\s*(?:class|struct)\s+(\w+)"), ("namespace", r"^\s*namespace\s+(\w+)"), ("method", r"^\s*[\w:<>*&\s]+\s+\w+::(\w+)\s*\(")],
    "csharp": [("class", r"^\s*(?:(?:public|private|internal|protected|abstract|sealed|static|partial)\s+)*(?:class|interface|struct|enum|record)\s+(\w+)"), ("method", r"^\s*(?:(?:public|private|internal|protected|static|async|override|virtual)\s+)+[\w<>\[\],?]+\s+(\w+)\s*\(")],
    "swift": [("function", r"^\s*(?:(?:public|private|internal|open|static|override)\s+)*func\s+(\w+)"), ("class", r"^\s*(?:(?:public|private|open|final)\s+)*(?:class|struct|enum|protocol|actor)\s+(\w+)")],
    "kotlin": [("function", r"^\s*(?:(?:public|private|internal|override|suspend|inline)\s+)*fun\s+(?:<[^>]*>\s*)?(\w+)"), ("class", r"^\s*(?:(?:public|private|internal|data|sealed|abstract|open)\s+)*(?:class|interface|object)\s+(\w+)")],
    "scala": [("function", r"^\s*(?:(?:private|protected|override|final|implicit)\s+)*def\s+(\w+)"), ("class", r"^\s*(?:(?:private|case|abstract|sealed|final)\s+)*(?:class|trait|object)\s+(\w+)")],
    "shell": [("function", r"^\s*(?:function\s+)?(\w+)\s*\(\)\s*\{?"), ("variable", r"^\s*export\s+(\w+)="), ("alias", r"^\s*alias\s+(\w+)=")],
}
SYMBOLS["typescript"] = [*SYMBOLS["javascript"], ("interface", r"^\s*(?:export\s+)?(?:interface|type|enum)\s+(\w+)")]
#: Names that look like calls but are keywords or built in.
BUILTINS = {
    "python": ("if", "for", "while", "return", "print", "len", "range", "str", "int", "float", "list", "dict", "set", "tuple", "super", "isinstance", "type", "and", "or", "not", "in", "def", "class", "elif", "with", "except"),
    "javascript": ("if", "for", "while", "switch", "catch", "return", "function", "require", "typeof", "parseInt", "parseFloat", "String", "Number", "Boolean", "Array", "Object"),
    "go": ("if", "for", "switch", "return", "func", "make", "len", "cap", "append", "panic", "recover", "new", "copy", "delete"),
    "java": ("if", "for", "while", "switch", "catch", "return", "new", "super", "this", "synchronized"),
    "rust": ("if", "for", "while", "match", "return", "fn", "Some", "None", "Ok", "Err", "Box", "Vec", "String"),
}
BUILTINS["typescript"] = BUILTINS["javascript"]

#: Advice by what a configuration rule's name holds; the first that fits counts, and a rule's own text where none does.
CONFIG_FIXES = (
    (("secret", "credentials"), "Move the secret out of configuration, rotate it, and load it from a secret store."),
    (("latest", "unpinned"), "Pin the mutable dependency reference to a specific version or immutable digest."),
    (("root", "privileged"), "Drop privileges and run the workload with the minimum permissions it actually needs."),
    (("wildcard", "wide-open", "permissions-write-all", "host-network", "host-pid"), "Tighten the exposed security boundary to the minimum allow-list required."),
    (("debug",), "Disable debug / development behavior in production configuration."),
    (("no-tls",), "Re-enable TLS verification and trust only expected certificates."),
    (("healthcheck",), "Add a health check so orchestration can detect unhealthy instances."),
    (("resource-limits",), "Define CPU and memory requests/limits for the workload."),
)
