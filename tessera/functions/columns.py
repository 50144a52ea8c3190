"""Column functions: paths, languages, ranks, fingerprints, texts. All are JVM expressions; no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language of a file extension.
LANGUAGES = {
    "rs": "rust", "py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript",
    "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "typescript", "go": "go", "java": "java",
    "rb": "ruby", "php": "php", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "cs": "csharp",
    "swift": "swift", "kt": "kotlin", "kts": "kotlin", "scala": "scala", "sol": "solidity", "sh": "shell", "bash": "shell",
    "sql": "sql", "yaml": "yaml", "yml": "yaml", "toml": "toml", "json": "json", "xml": "xml", "html": "html", "htm": "html",
    "css": "css", "scss": "scss", "sass": "scss", "md": "markdown", "markdown": "markdown", "dockerfile": "dockerfile",
}
#: Severities and statuses in order of rank.
SEVERITIES = ("critical", "high", "medium", "low")
CONFIDENCES = ("high", "medium", "low")
STATUSES = ("open", "confirmed", "fixed", "dismissed", "false_positive")
#: Parts of paths of tests and generated files.
TEST_DIRS = ("test", "tests", "__tests__", "spec", "specs", "fixtures", "testdata", "test_data", "mock", "mocks")
TEST_ENDS = ("_test.rs", "_test.go", "_test.py", ".test.js", ".test.ts", ".test.tsx", ".spec.js", ".spec.ts", ".spec.tsx")
LOCK_ENDS = (".lock", "-lock.json")
#: CWE numbers of each OWASP Top 10 (2021) category, from the public cross-reference, and 190 and 489 by kinship.
OWASP = {
    "A01": (22, 23, 35, 59, 200, 201, 219, 264, 275, 276, 284, 285, 352, 359, 377, 402, 425, 441, 497, 538, 540, 548, 552, 566, 601, 639, 651, 668, 706, 862, 863, 913, 922, 1275),
    "A02": (261, 296, 310, 319, 321, 322, 323, 324, 325, 326, 327, 328, 329, 330, 331, 335, 336, 337, 338, 340, 347, 523, 720, 757, 759, 760, 780, 818, 916),
    "A03": (20, 74, 75, 77, 78, 79, 80, 83, 87, 88, 89, 90, 91, 93, 94, 95, 96, 97, 98, 99, 100, 113, 116, 138, 184, 470, 471, 564, 610, 643, 644, 652, 917, 1321),
    "A04": (73, 183, 190, 209, 213, 235, 256, 257, 266, 269, 280, 311, 312, 313, 316, 419, 430, 434, 444, 451, 472, 501, 522, 525, 539, 579, 598, 602, 642, 646, 650, 653, 656, 657, 799, 807, 840, 841, 927, 1021, 1173),
    "A05": (2, 11, 13, 15, 16, 260, 315, 489, 520, 526, 537, 541, 547, 611, 614, 756, 776, 942, 1004, 1032, 1174),
    "A06": (937, 1035, 1104),
    "A07": (255, 259, 287, 288, 290, 294, 295, 297, 300, 302, 303, 304, 306, 307, 346, 384, 521, 549, 555, 593, 613, 620, 640, 798, 940, 1216),
    "A08": (345, 353, 426, 494, 502, 565, 784, 829, 830, 915, 1357),
    "A09": (117, 223, 532, 778),
    "A10": (918,),
}


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def language_of(path: Column) -> Column:
    """Language from the extension (case matters); null without or with an unknown one."""
    return F.try_element_at(_map(LANGUAGES), F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def is_test_path(path: Column) -> Column:
    """Whether a path is of a test, fixture or lock file; directories count only after a slash."""
    low = F.lower(path)
    name = F.element_at(F.split(low, "/"), -1)
    found = name.startswith("test_")
    for e in TEST_ENDS:
        found = found | name.endswith(e)
    for e in LOCK_ENDS:
        found = found | low.endswith(e)
    for d in TEST_DIRS:
        found = found | low.contains(f"/{d}/")
    return found


def file_matches(path: Column, patterns: list[str]) -> Column:
    """``*.x`` is a suffix, a pattern with ``*`` elsewhere a glob, one with a slash a part of the path, any other the exact file name."""
    name = F.element_at(F.split(path, "/"), -1)
    found = F.lit(False)
    for p in patterns:
        if p.startswith("*.") and "*" not in p[1:]:
            found = found | path.endswith(p[1:])
        elif "*" in p:
            found = found | glob_matches(path, p)
        elif "/" in p:
            found = found | path.contains(p)
        else:
            found = found | (name == p)
    return found


def glob_regex(glob: str) -> str:
    """A regular expression for ``*`` (also across slashes), ``?`` and classes."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += ".*"
            while glob[i + 1 : i + 2] == "*":
                i += 1
        elif c == "?":
            out += "."
        elif c == "[" and "]" in glob[i + 2 :]:
            j = glob.index("]", i + 2)
            inner = glob[i + 1 : j].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]"
            i = j
        else:
            out += "\\" + c if not c.isalnum() and c not in "_/ " else c
        i += 1
    return f"(?s)^{out}$"


def glob_matches(path: Column, glob: str) -> Column:
    return path.rlike(glob_regex(glob))


def _rank(c: Column, order: tuple[str, ...]) -> Column:
    return F.coalesce(F.try_element_at(_map({x: len(order) - k for k, x in enumerate(order)}), F.lower(F.trim(c))), F.lit(0))


def severity_rank(c: Column) -> Column:
    """critical 4 ... low 1, anything else 0."""
    return _rank(c, SEVERITIES)


def confidence_rank(c: Column) -> Column:
    """high 3 ... low 1, anything else 0."""
    return _rank(c, CONFIDENCES)


def status_rank(c: Column) -> Column:
    """Triage place: open 0 ... false_positive 4, anything else 5."""
    return F.coalesce(F.try_element_at(_map({x: k for k, x in enumerate(STATUSES)}), c), F.lit(len(STATUSES)))


def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "error").when(severity == "medium", "warning").otherwise("note")


def security_severity(severity: Column) -> Column:
    return F.coalesce(F.try_element_at(_map({"critical": "9.5", "high": "8.0", "medium": "5.0", "low": "2.0"}), severity), F.lit("5.0"))


def confidence_percent(confidence: Column) -> Column:
    return F.coalesce(F.try_element_at(_map({"high": 95, "medium": 75, "low": 55}), F.lower(confidence)), F.lit(75))


def severity_label(severity: Column) -> Column:
    return F.initcap(severity)


def fingerprint(*parts: Column | str) -> Column:
    """SHA-256 of the parts joined by colons."""
    return F.sha2(F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts]), 256)


def group_fingerprint(kind: str, title: Column) -> Column:
    return F.concat(F.lit("group:"), F.sha2(F.concat(F.lit(f"{kind}-group:"), title), 256))


def clean_title(title: Column) -> Column:
    """A title without a leading ``[CWE-n] ``."""
    return F.regexp_replace(title, r"^\[CWE-[0-9]+\]\s*", "")


def cwe_of(cwe: Column, title: Column) -> Column:
    """The CWE, or else the one that begins the title."""
    return F.coalesce(cwe, F.nullif(F.regexp_extract(title, r"^\[(CWE-[0-9]+)\]", 1), F.lit("")))


def owasp_code(cwe: Column) -> Column:
    """OWASP Top 10 category of ``CWE-89`` or ``89`` in any case; null outside."""
    n = F.regexp_extract(F.upper(F.trim(cwe)), r"^(?:CWE-)?([0-9]+)$", 1).try_cast("int")
    found = F.lit(None).cast("string")
    for code, numbers in OWASP.items():
        found = F.when(n.isin(*numbers), code).otherwise(found)
    return found


def normalize_remote_url(url: Column) -> Column:
    """Trimmed, lower-case, without scheme, user and ``.git``."""
    u = F.regexp_replace(F.lower(F.trim(url)), r"^[a-z+]+://", "")
    u = F.regexp_replace(u, r"^[^@/]+@", "")
    return F.regexp_replace(F.rtrim(u), r"\.git/?$|/$", "")


def remote_host(url: Column) -> Column:
    return F.regexp_extract(normalize_remote_url(url), r"^([^/:]+)", 1)


def humanize_slug(c: Column) -> Column:
    return F.initcap(F.translate(c, "_-", "  "))


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def looks_like_prose(c: Column) -> Column:
    """A patch that is a list of instructions: its first non-blank line begins a list and nothing looks like code."""
    return c.rlike(r"^\s*(?:1[.)]|- |\* )") & ~c.contains("{") & ~c.contains(";") & ~c.contains("=>")


def shannon_entropy(c: Column) -> Column:
    """Bits a character."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    n = F.size(chars).cast("double")
    return F.aggregate(
        F.array_distinct(chars), F.lit(0.0), lambda s, x: s - F.size(F.filter(chars, lambda y: y == x)) / n * F.log2(F.size(F.filter(chars, lambda y: y == x)) / n)
    )


def looks_secret(c: Column, entropy: Column | None = None) -> Column:
    """Whether a quoted literal may be a secret: long, not a path or UUID, of mixed characters (or long hex), and of high entropy."""
    path_like = c.rlike(r"^/|^\./|^\.\./|://|[?&\\ \t]|/.*/")
    uuid = c.rlike(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")
    classes = sum((c.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]", r"[+/=_-]")), F.lit(0))
    hexes = c.rlike("^[0-9a-fA-F]+$") & (F.octet_length(c) >= 32)
    return (F.octet_length(c) >= 24) & ~path_like & ~uuid & ((classes >= 3) | hexes) & ((shannon_entropy(c) if entropy is None else entropy) >= 3.5)


def assigned_variable(line: Column) -> Column:
    """The name that a line assigns to, else null: no comparison, no call or index on the left; of ``a b: T = x`` it is ``b``."""
    s = F.regexp_replace(F.trim(line), r"^(?:let|const|var) ", "")
    at = F.instr(s, "=")
    before = F.trim(F.substr(s, F.lit(1), at - 1))
    name = F.trim(F.element_at(F.split(F.trim(F.regexp_replace(before, r":+$", "")), ":"), 1))
    name = F.element_at(F.split(name, r"\s+"), -1)
    bad = (at <= 1) | F.substr(s, at, F.lit(2)).eqNullSafe("==") | before.rlike("[!<>]$") | (name == "") | name.rlike(r"[()\[]")
    return F.when(~bad, name)


def classify_cvss(severity: Column) -> Column:
    """Severity from an array of ``(type, score)``: of ``CVSS_V3`` the number after the last slash; high without one."""
    v3 = F.try_element_at(F.filter(severity, lambda s: s["type"] == "CVSS_V3"), F.lit(1))
    n = F.element_at(F.split(v3["score"], "/"), -1).try_cast("double")
    return F.when(n >= 9, "critical").when(n >= 7, "high").when(n >= 4, "medium").when(n.isNotNull(), "low").otherwise("high")


def upgrade_target(declared: Column, fixed: Column) -> Column:
    """The fixed version in the style of the declared one (``^1.2`` gives ``^1.3``)."""
    return F.concat(F.regexp_extract(declared, r"^[^0-9]*", 0), fixed)


#: The texts about a package's upgrade.
NO_FIX = "No fixed version was published for `%s` `%s` in the OSV response. Review the advisory and consider removing, replacing, or isolating the package until a fix ships."
ONE_FIX = "Upgrade `%s` from `%s` to `%s`."
MORE_FIXES = "Upgrade `%s` from `%s` to a fixed release. Suggested target: `%s`. Other known fixed versions: %s."
GUIDANCE = "// Upgrade `%s` in `%s`.\n// Current declaration:\n%s\n\n// Replace with:\n%s"
NO_GUIDANCE = (
    "// `%s` `%s` is vulnerable in `%s`.\n// No fixed version was published in the OSV response.\n// Next steps:\n// 1. Review the advisory and linked references.\n"
    "// 2. Remove or replace the dependency if possible.\n// 3. Constrain exposure until an upstream fixed version is released."
)


def upgrade_summary(package: Column, version: Column, fixed: Column) -> Column:
    """What to do, by the fixed versions (an array, the first of which is the target)."""
    target = F.get(fixed, F.lit(0))
    return (
        F.when(F.coalesce(F.size(fixed), F.lit(0)) < 1, F.format_string(NO_FIX, package, version))
        .when(F.size(fixed) == 1, F.format_string(ONE_FIX, package, version, target))
        .otherwise(F.format_string(MORE_FIXES, package, version, target, F.array_join(fixed, ", ")))
    )


def upgraded_snippet(package: Column, declared: Column, snippet: Column, target: Column) -> Column:
    """The manifest entry with the declared version replaced, once, by the target in its style."""
    spec = upgrade_target(F.coalesce(declared, F.lit("")), target)
    at = F.instr(snippet, declared)
    swapped = F.when(at > 0, F.concat(F.substr(snippet, F.lit(1), at - 1), spec, F.substr(snippet, at + F.length(declared), F.lit(1 << 30)))).otherwise(snippet)
    return F.when(F.coalesce(declared, F.lit("")) == "", F.format_string("Set `%s` to `%s` in the manifest entry.", package, spec)).otherwise(swapped)


def upgrade_guidance(package: Column, version: Column, path: Column, declared: Column, snippet: Column, fixed: Column) -> Column:
    """A note for the code: the manifest entry as it is and as it should be, or next steps where no version is fixed."""
    target = F.get(fixed, F.lit(0))
    return F.when(target.isNull(), F.format_string(NO_GUIDANCE, package, version, path)).otherwise(F.format_string(GUIDANCE, package, path, snippet, upgraded_snippet(package, declared, snippet, target)))
