"""Queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import registry_more  # noqa: F401  (registers its queries)
from tessera.book import LINES, QUERIES, SECRET_SQL, SQL, Query, query
from tessera.functions import columns as C
from tessera.operators import detect, findings, graph, packages
from tessera.operators import text as T
from tessera.operators.catalogue import CODE_RULES, Rule
from tessera.plans.fixtures import fx
from tessera.plans.scratch import materialize
from tessera.sources import corpus
from tessera.streaming import streams


def flagship(spark: SparkSession, root: str) -> DataFrame:
    """Secrets of all files, rolled up and scored for every repository (also those without any)."""
    files = fx(spark, root, "files")
    found = detect.scan_secrets(files).withColumns({"scan_id": F.col("repo_id"), "status": F.lit("open"), "poc_validated": F.lit(False)})
    repos = files.select(F.col("repo_id").alias("scan_id")).distinct()
    rolled = findings.scan_rollup(found, repos)
    return rolled.join(findings.security_score(found).select("scan_id", "score"), "scan_id", "left").na.fill(100, ["score"])


#: Rules over the words of the driver's documents, in a pattern language that Java and RE2 share.
PROSE_RULES = [
    Rule("prose-token", "high", "CWE-798", (), r"(?i)\btoken\s*=", ("token",), "Remove it."),
    Rule("prose-license", "low", "CWE-1104", ("python", "go"), r"Licensed under", ("licensed",), "Check it."),
    Rule("prose-shout", "medium", "CWE-200", (), r"[A-Z]{4,}!!", ("!!",), "Lower it."),
    Rule("prose-table", "low", "CWE-20", ("javascript", "java"), r"\w+ \| \w+ \|", (" | ",), "Reformat it."),
]
PROSE_ABSENT = [Rule("no-license", "low", "CWE-1104", (), r"(?m)Licensed under", (), "Add one.", "absent", ("*.py", "*.go"))]
TEST_PATH = "(file_path LIKE '%/tests/%')"


@query("file_stats", "files", f"WITH {LINES} SELECT file_path, language, sha256(content) AS content_hash, CAST(len(x) AS INT) AS line_count, CAST(strlen(content) AS INT) AS byte_size FROM arr")
def file_stats(spark, root):
    return T.with_file_stats(T.with_language(fx(spark, root, "files"))).select("file_path", "language", "content_hash", "line_count", "byte_size")


@query("lines_per_language", "files", f"WITH {LINES} SELECT language, count(DISTINCT file_path) AS n_files, count(*) AS n_lines FROM lines GROUP BY language")
def lines_per_language(spark, root):
    return T.to_lines(fx(spark, root, "files")).groupBy("language").agg(F.countDistinct("file_path").alias("n_files"), F.count("*").alias("n_lines"))


@query(
    "path_facts", "files",
    """SELECT file_path, file_path LIKE '%/tests/%' AS is_test, file_path LIKE '%.py' OR file_path LIKE '%/f1%' AS matches, regexp_matches(file_path, '^src/.*[1-3]\\.rs$') AS globbed,
       sha256('r:' || file_path || ':1') AS fingerprint, 'group:' || sha256('rule-group:' || file_path) AS group_fingerprint, trim(regexp_replace(file_path, '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM fx_files""",
)
def path_facts(spark, root):
    p = F.col("file_path")
    return fx(spark, root, "files").select(
        p, C.is_test_path(p).alias("is_test"), C.file_matches(p, ["*.py", "/f1"]).alias("matches"), C.glob_matches(p, "src/*[1-3].rs").alias("globbed"),
        C.fingerprint("r", p, "1").alias("fingerprint"), C.group_fingerprint("rule", p).alias("group_fingerprint"), C.slugify(p).alias("slug"),
    )


@query("secrets", "files", SECRET_SQL)
def secrets(spark, root):
    return detect.scan_secrets(fx(spark, root, "files")).select("file_path", "line_start", "literal", F.round("entropy", 4).alias("entropy"), "fingerprint")


def _rule_sql(rules: list[Rule]) -> str:
    parts = []
    for r in rules:
        spoken = f"language IN ({', '.join(repr(x) for x in r.languages)})" if r.languages else "TRUE"
        parts.append(f"SELECT '{r.rule_id}' AS rule_id, '{r.severity}' AS severity, '{r.cwe_id}' AS cwe_id, file_path, line_no FROM lines WHERE {spoken} AND NOT {TEST_PATH} AND regexp_matches(line, '{r.pattern}')")
    return f"""WITH {LINES}, hits AS ({' UNION ALL '.join(parts)})
SELECT h.rule_id, h.severity, h.cwe_id, h.file_path, CAST(h.line_no AS INT) AS line_start,
  array_to_string(list_transform(list_slice(a.x, greatest(1, h.line_no - 2), h.line_no + 2), lambda v: regexp_replace(v, '\\r$', '')), chr(10)) AS snippet
FROM hits h JOIN arr a ON a.file_path = h.file_path"""


@query("code_rules", "files", _rule_sql(PROSE_RULES))
def code_rules(spark, root):
    return detect.scan_code_rules(fx(spark, root, "files"), PROSE_RULES).select("rule_id", "severity", "cwe_id", "file_path", "line_start", "snippet")


@query("absent_rules", "files", "SELECT 'no-license' AS rule_id, file_path FROM fx_files WHERE (file_path LIKE '%.py' OR file_path LIKE '%.go') AND content NOT LIKE '%Licensed under%'")
def absent_rules(spark, root):
    return detect.scan_absent(fx(spark, root, "files"), PROSE_ABSENT).select("rule_id", "file_path")


#: Rules that lines of the view ``code`` meet, and in the files of which remainders.
CODE_LINES = {"unsafe-deserialization-python": "doc_id % 6 = 0", "xss-innerhtml": "doc_id % 6 = 1", "integer-overflow": "doc_id % 6 = 4", "aws-access-key": "doc_id % 6 IN (2, 3, 5)"}
CATALOGUE_SQL = " UNION ALL ".join(f"SELECT '{r.rule_id}' AS rule_id, '{r.severity}' AS severity, 'static' AS source, count(*) AS n FROM fx_code WHERE {CODE_LINES[r.rule_id]} AND NOT {TEST_PATH} HAVING count(*) > 0" for r in CODE_RULES if r.rule_id in CODE_LINES)


@query("full_catalogue", "code", CATALOGUE_SQL)
def full_catalogue(spark, root):
    """All code and configuration rules over all files, each of which has lines of code after its text."""
    files = fx(spark, root, "code")
    both = detect.scan_code_rules(files).unionByName(detect.scan_config_rules(files))
    return both.groupBy("rule_id", "severity", "source").agg(F.count("*").alias("n"))


@query("code_taint", "code", f"""WITH a AS (SELECT *, len(string_split(content, chr(10))) AS n FROM fx_code WHERE doc_id % 6 = 0)
SELECT file_path, 'sql' AS category, p AS sink_pattern, 'name' AS origin, CAST(n - 3 AS INT) AS source_line, CAST(n AS INT) AS sink_line FROM a, (SELECT unnest(['execute(', 'cursor.execute']) AS p)""")
def code_taint(spark, root):
    """A value that goes from a request through a second name into a statement, in every Python file."""
    flows = detect.taint_flows(fx(spark, root, "code")).filter("variable = 'other'")
    return flows.select("file_path", "category", "sink_pattern", F.lit("name").alias("origin"), "source_line", "sink_line")


@query(
    "grep_context", "files",
    f"""WITH {LINES} SELECT file_path, CAST(l.line_no AS INT) AS line_no, l.line,
  array_to_string(list_slice(a.x, greatest(1, l.line_no - 2), l.line_no - 1), chr(10)) AS before, array_to_string(list_slice(a.x, l.line_no + 1, l.line_no + 2), chr(10)) AS after
FROM lines l JOIN arr a USING (file_path) WHERE regexp_matches(l.line, 'Licensed|[Tt]oken')""",
)
def grep_context(spark, root):
    rows = graph.search(fx(spark, root, "files"), "Licensed|[Tt]oken")
    return rows.select("file_path", "line_no", "line", F.array_join("before", "\n").alias("before"), F.array_join("after", "\n").alias("after"))


KEYWORDS = ["license", "token", "password", "the"]


@query(
    "keyword_top3", "files",
    f"""WITH {LINES}, hits AS (SELECT file_path, line_no, unnest(list_filter({KEYWORDS!r}, lambda k: contains(lower(line), k))) AS keyword FROM lines)
SELECT file_path, keyword, CAST(line_no AS INT) AS line_no, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY file_path, keyword ORDER BY line_no) AS r FROM hits) WHERE r <= 3""",
)
def keyword_top3(spark, root):
    return detect.keyword_hits(T.to_lines(fx(spark, root, "files")), KEYWORDS, 3, None).select("file_path", "keyword", "line_no", "rank")


@query(
    "tech_stack", "files",
    """WITH l AS (SELECT repo_id, language AS label, count(*) AS n FROM fx_files WHERE language IS NOT NULL GROUP BY 1, 2),
t AS (SELECT repo_id, label, n FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, label) AS k FROM l) WHERE k <= 5),
m AS ("""
    + " UNION ALL ".join(f"SELECT repo_id, '{x}' AS label FROM fx_files WHERE contains({c}, '{p.replace(chr(39), chr(39) * 2)}')" for c, marks in (("file_path", detect.PATH_MARKS), ("content", detect.CONTENT_MARKS)) for x, p in marks)
    + ") SELECT * FROM t UNION ALL SELECT repo_id, label, count(*) AS n FROM m GROUP BY 1, 2",
)
def tech_stack(spark, root):
    return detect.tech_stack(fx(spark, root, "files"))


@query(
    "call_names", "files",
    """WITH c AS (SELECT repo_id, file_path, language, unnest(list_distinct(regexp_extract_all(content, '([0-9A-Za-z_]+)\\s*\\(', 1))) AS name FROM fx_files WHERE language IS NOT NULL)
SELECT repo_id, file_path, name FROM c WHERE NOT ("""
    + " OR ".join(f"(language = '{k}' AND name IN ({', '.join(repr(x) for x in v)}))" for k, v in sorted(graph.BUILTINS.items()))
    + ")",
)
def call_names(spark, root):
    return graph.call_names(fx(spark, root, "files"))


@query(
    "imports", "files",
    """WITH i AS (SELECT repo_id, file_path, unnest(list_distinct(regexp_extract_all(content, '"([^"]+)"', 1))) AS target FROM fx_files WHERE language = 'go'
  UNION ALL SELECT repo_id, file_path, unnest(list_distinct(list_concat(regexp_extract_all(content, '(?m)^from\\s+([A-Za-z0-9_.]+)\\s+import\\b', 1), regexp_extract_all(content, '(?m)^import\\s+([A-Za-z0-9_.]+)', 1)))) FROM fx_files WHERE language = 'python'
  UNION ALL SELECT repo_id, file_path, unnest(list_distinct(regexp_extract_all(content, '(?m)^use\\s+([A-Za-z0-9_:]+)', 1))) FROM fx_files WHERE language = 'rust')
SELECT repo_id, target, count(*) AS n_files FROM i GROUP BY 1, 2""",
)
def imports(spark, root):
    return graph.import_summary(graph.imports(fx(spark, root, "files")))


TAINT_SOURCES = {k: [("the ", "input")] for k in ("python", "javascript")}
TAINT_SINKS = {k: [("token", "sql"), ("licensed", "xss")] for k in ("python", "javascript")}


@query("taint")
def taint(spark, root):
    """Flows between words of the documents; tests compare the operator with plain Python."""
    return detect.taint_findings(detect.taint_flows(fx(spark, root, "files"), sources=TAINT_SOURCES, sinks=TAINT_SINKS)).select("file_path", "rule_id", "severity", "cwe_id", "line_start", "fingerprint")


RANK = "CASE status WHEN 'open' THEN 0 WHEN 'confirmed' THEN 1 WHEN 'fixed' THEN 2 WHEN 'dismissed' THEN 3 WHEN 'false_positive' THEN 4 ELSE 5 END"
SEV = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
TRIAGE = f"{RANK}, {SEV} DESC, created_at DESC, finding_id"
COUNTS = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in C.SEVERITIES)


@query("triage_page", "findings", f"SELECT CAST(row_number() OVER (ORDER BY {TRIAGE}) AS INT) AS position, finding_id, status, severity, (SELECT count(*) FROM fx_findings) AS total, CAST(ceil((SELECT count(*) FROM fx_findings) / 25.0) AS BIGINT) AS total_pages FROM fx_findings QUALIFY position BETWEEN 26 AND 50")
def triage_page(spark, root):
    page = findings.paginate(fx(spark, root, "findings"), findings.triage_columns(), page=2)
    return page.select("position", "finding_id", "status", "severity", "total", "total_pages")


@query("count_findings", "findings", "SELECT count(*) AS n FROM fx_findings WHERE severity = 'critical' AND status = 'open'")
def count_findings(spark, root):
    return findings.count_findings(fx(spark, root, "findings"), "critical", "open")


@query("scan_rollup", "scans findings", f"WITH f AS (SELECT scan_id, count(*) AS total, {COUNTS} FROM fx_findings GROUP BY 1) SELECT s.scan_id, coalesce(total, 0) AS total, " + ", ".join(f"coalesce({s}, 0) AS {s}" for s in C.SEVERITIES) + " FROM fx_scans s LEFT JOIN f ON f.scan_id = s.scan_id")
def scan_rollup(spark, root):
    return findings.scan_rollup(fx(spark, root, "findings"), fx(spark, root, "scans"))


@query("owner_counts", "repos findings", "SELECT r.user_id, count(f.finding_id) AS open_findings, count(f.finding_id) FILTER (f.severity = 'critical') AS open_critical FROM fx_repos r LEFT JOIN fx_findings f ON f.repo_id = r.repo_id AND f.status = 'open' WHERE NOT r.deleted GROUP BY 1")
def owner_counts(spark, root):
    return findings.owner_counts(fx(spark, root, "findings"), fx(spark, root, "repos"))


@query("visible_findings", "repos findings", "SELECT finding_id, repo_id FROM fx_findings WHERE repo_id IN (SELECT repo_id FROM fx_repos WHERE user_id = 3 AND NOT deleted)")
def visible_findings(spark, root):
    return findings.visible_to(fx(spark, root, "findings"), fx(spark, root, "repos"), 3).select("finding_id", "repo_id")


@query("recent_scans", "scans repos", "SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, scan_id DESC) AS INT) AS position, scan_id, status FROM fx_scans JOIN fx_repos USING (repo_id) WHERE NOT deleted QUALIFY position <= 6")
def recent_scans(spark, root):
    return findings.recent_scans(fx(spark, root, "scans"), fx(spark, root, "repos")).select("user_id", "position", "scan_id", "status")


@query("repo_cards", "scans repos", "WITH s AS (SELECT repo_id, scan_id, status, count(*) OVER (PARTITION BY repo_id) AS n, row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, scan_id DESC) AS k FROM fx_scans) SELECT r.repo_id, r.name, coalesce(s.n, 0) AS scan_count, s.scan_id AS last_scan_id, s.status AS last_status FROM fx_repos r LEFT JOIN s ON s.repo_id = r.repo_id AND s.k = 1 WHERE NOT deleted")
def repo_cards(spark, root):
    return findings.repo_cards(fx(spark, root, "repos"), fx(spark, root, "scans")).select("repo_id", "name", "scan_count", "last_scan_id", "last_status")


_w = "CASE confidence WHEN 'high' THEN 1.0::DOUBLE WHEN 'medium' THEN 0.7::DOUBLE WHEN 'low' THEN 0.4::DOUBLE ELSE 0.7::DOUBLE END * CASE WHEN poc_validated THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END"
SCORE_SQL = (
    "WITH w AS (SELECT scan_id, " + ", ".join(f"coalesce(sum({_w}) FILTER (severity = '{s}' AND status NOT IN ('dismissed', 'false_positive', 'fixed')), 0) AS {s}" for s in findings.LOSS) + " FROM fx_findings GROUP BY 1), "
    + "l AS (SELECT scan_id, " + ", ".join(f"{m} * {s} / ({s} + {h}) AS {s}_loss" for s, (m, h) in findings.LOSS.items()) + " FROM w) SELECT scan_id, "
    + ", ".join(f"round({s}_loss, 4) AS {s}_loss" for s in findings.LOSS) + ", CAST(greatest(0, least(100, round(100 - (" + " + ".join(f"{s}_loss" for s in findings.LOSS) + ")))) AS INT) AS score FROM l"
)


@query("security_score", "findings", SCORE_SQL)
def security_score(spark, root):
    return findings.security_score(fx(spark, root, "findings")).select("scan_id", *[F.round(f"{s}_loss", 4).alias(f"{s}_loss") for s in findings.LOSS], "score")


@query("severity_summary", "findings", f"SELECT scan_id, count(*) AS total, {COUNTS}, " + ", ".join(f"round(100.0::DOUBLE * count(*) FILTER (severity = '{s}') / count(*), 4) AS {s}_percent" for s in C.SEVERITIES) + " FROM fx_findings GROUP BY 1")
def severity_summary(spark, root):
    out = findings.severity_summary(fx(spark, root, "findings"))
    return out.withColumns({f"{s}_percent": F.round(f"{s}_percent", 4) for s in C.SEVERITIES})


@query("report_index", "findings", f"SELECT scan_id, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY {SEV} DESC, {TRIAGE}) AS INT) AS display_index, severity, finding_id FROM fx_findings WHERE status NOT IN ('dismissed', 'false_positive')")
def report_index(spark, root):
    return findings.report_index(fx(spark, root, "findings"))


@query("owasp", "findings", "SELECT CASE cwe_id WHEN 'CWE-89' THEN 'A03' WHEN 'CWE-78' THEN 'A03' WHEN 'CWE-79' THEN 'A03' WHEN 'CWE-798' THEN 'A07' WHEN 'CWE-502' THEN 'A08' WHEN 'CWE-22' THEN 'A01' END AS owasp_code, count(*) AS n FROM fx_findings GROUP BY 1")
def owasp(spark, root):
    return findings.with_owasp(fx(spark, root, "findings")).groupBy("owasp_code").agg(F.count("*").alias("n"))


_active = "status NOT IN ('dismissed', 'false_positive', 'fixed')"
_level = "CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END"


@query("sarif_rules", "findings", f"SELECT scan_id, cwe_id AS rule_id, title AS name, {_level} AS level, CASE severity WHEN 'critical' THEN '9.5' WHEN 'high' THEN '8.0' WHEN 'medium' THEN '5.0' ELSE '2.0' END AS security_severity FROM fx_findings WHERE {_active} QUALIFY row_number() OVER (PARTITION BY scan_id, cwe_id ORDER BY {TRIAGE}) = 1")
def sarif_rules(spark, root):
    return findings.sarif_rules(fx(spark, root, "findings"))


@query("sarif_results", "findings", f"SELECT scan_id, finding_id, cwe_id AS rule_id, {_level} AS level, file_path, greatest(1, line_start) AS start_line, greatest(1, line_start) AS end_line FROM fx_findings WHERE {_active}")
def sarif_results(spark, root):
    return findings.sarif_results(fx(spark, root, "findings"))


@query("sarif_documents")
def sarif_documents(spark, root):
    return corpus.to_sarif(fx(spark, root, "findings"))


@query("scan_reports")
def scan_reports(spark, root):
    f = fx(spark, root, "findings")
    return corpus.scan_report(findings.severity_summary(f), findings.report_buckets(f), findings.security_score(f))


@query("group_by_rule", "findings", f"WITH g AS (SELECT scan_id, title, count(*) AS n, max({SEV}) AS r FROM fx_findings GROUP BY 1, 2), s AS (SELECT *, CASE r WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS max_severity FROM g) SELECT scan_id, title, n, max_severity, '[' || upper(max_severity) || '] ' || title || ' (' || n || ' location' || CASE WHEN n = 1 THEN '' ELSE 's' END || ')' AS group_title, 'group:' || sha256('rule-group:' || title) AS group_fingerprint FROM s")
def group_by_rule(spark, root):
    return findings.group_by_rule(fx(spark, root, "findings"))


_cand = f"SELECT f.* FROM fx_findings f JOIN fx_repos r USING (repo_id) WHERE {SEV.replace('severity', 'f.severity')} >= {SEV.replace('severity', 'r.min_severity')} AND (f.poc_validated OR f.confidence = 'high')"


@query("issue_plan", "repos findings", f"WITH c AS ({_cand}), i AS (SELECT DISTINCT repo_id, title FROM fx_findings WHERE status = 'fixed') SELECT c.repo_id, c.finding_id, CASE WHEN i.title IS NULL THEN 'create' ELSE 'link' END AS action FROM c LEFT JOIN i ON i.repo_id = c.repo_id AND i.title = c.title")
def issue_plan(spark, root):
    f = fx(spark, root, "findings")
    rows = findings.issue_candidates(f, fx(spark, root, "repos"))
    return findings.plan_issues(rows, f.filter("status = 'fixed'"), ("repo_id", "title")).select("repo_id", "finding_id", "action")


ISSUE_SQL = "CASE WHEN line_start % 20 = 0 THEN 'code of ' || title || chr(10) || 'second' END"


@query("issue_texts", "findings", f"""WITH f AS (SELECT *, {ISSUE_SQL} AS s, row_number() OVER (PARTITION BY scan_id, title ORDER BY {TRIAGE}) AS k FROM fx_findings)
SELECT scan_id, title, '## Grouped Finding' || chr(10) || chr(10) || '- Rule: **' || title || '**' || chr(10) || '- Severity: `' || ['low', 'medium', 'high', 'critical'][max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END)] || '`' || chr(10)
  || '- Locations: **' || count(*) || '**' || chr(10) || '- CWE: `' || arg_min(cwe_id, k) || '`' || chr(10) || chr(10) || '### Affected Locations' || chr(10) || chr(10) || '| File | Line | Confidence |' || chr(10) || '|------|------|------------|' || chr(10)
  || string_agg('| `' || file_path || '` | ' || line_start || ' | ' || confidence || ' |', chr(10) ORDER BY k)
  || coalesce(chr(10) || chr(10) || '### Example Evidence' || chr(10) || chr(10) || '```text' || chr(10) || max(s) || chr(10) || '```', '') AS body FROM f GROUP BY 1, 2""")
def issue_texts(spark, root):
    f = fx(spark, root, "findings")
    return findings.issue_texts(f.withColumn("code_snippet", F.when(F.col("line_start") % 20 == 0, F.concat(F.lit(" code of "), "title", F.lit("\nsecond\n")))))


@query("issue_bodies", "findings", f"""SELECT finding_id, '[' || upper(severity) || '] ' || title AS issue_title, '## Finding' || chr(10) || chr(10) || '- Severity: `' || severity || '`' || chr(10) || '- Confidence: `' || confidence || '`' || chr(10) || '- Fingerprint: `' || finding_id || '`' || chr(10)
  || '- Location: `' || file_path || '`:' || line_start || '-' || (line_start + 2) || chr(10) || '- CWE: `' || cwe_id || '`' || coalesce(chr(10) || chr(10) || '### Evidence' || chr(10) || chr(10) || '```text' || chr(10) || {ISSUE_SQL} || chr(10) || '```', '')
  || CASE WHEN line_start % 30 = 0 THEN chr(10) || chr(10) || '### References' || chr(10) || chr(10) || '- https://a' || chr(10) || '- https://b' ELSE '' END AS issue_body FROM fx_findings""")
def issue_bodies(spark, root):
    f = fx(spark, root, "findings").withColumns({"line_end": F.col("line_start") + 2, "fingerprint": F.col("finding_id")})
    f = f.withColumn("code_snippet", F.when(F.col("line_start") % 20 == 0, F.concat(F.lit(" code of "), "title", F.lit("\nsecond\n"))))
    urls = F.when(F.col("line_start") % 30 == 0, F.array(F.lit("https://a"), F.lit("https://b")))
    return findings.issue_bodies(f.withColumn("reference_urls", urls)).select("finding_id", "issue_title", "issue_body")


@query("upsert", "findings", "WITH b AS (SELECT scan_id, title, created_at, finding_id, line_start % 20 = 0 AS new FROM fx_findings) SELECT scan_id, title, created_at, finding_id FROM b QUALIFY row_number() OVER (PARTITION BY scan_id, title ORDER BY new DESC, created_at DESC, finding_id DESC) = 1")
def upsert(spark, root):
    f = fx(spark, root, "findings").select("scan_id", "title", "created_at", "finding_id", "line_start")
    old, new = f.filter("line_start % 20 <> 0").drop("line_start"), f.filter("line_start % 20 = 0").drop("line_start")
    return findings.upsert(old, new, ["scan_id", "title"], "created_at")


@query("latest_stage", "events", "SELECT scan_id, stage, status FROM fx_events QUALIFY row_number() OVER (PARTITION BY scan_id, stage ORDER BY created_at DESC, event_id DESC) = 1")
def latest_stage(spark, root):
    return streams.latest_stage(fx(spark, root, "events")).select("scan_id", "stage", "status")


@query("event_tail", "events", "SELECT scan_id, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY created_at DESC, event_id DESC) AS INT) AS position, event_id FROM fx_events QUALIFY position <= 5")
def event_tail(spark, root):
    return findings.tail(fx(spark, root, "events"), 5).select("scan_id", "position", "event_id")


@query("stage_snapshot", "events", "WITH s AS (SELECT DISTINCT scan_id FROM fx_events), t AS (SELECT unnest(" + repr(list(findings.STAGES)) + ") AS stage, unnest(range(1, 10)) AS place), l AS (SELECT scan_id, stage, status FROM fx_events QUALIFY row_number() OVER (PARTITION BY scan_id, stage ORDER BY created_at DESC, event_id DESC) = 1) SELECT s.scan_id, t.stage, CAST(t.place AS INT) AS place, coalesce(l.status, 'pending') AS status FROM s CROSS JOIN t LEFT JOIN l ON l.scan_id = s.scan_id AND l.stage = t.stage")
def stage_snapshot(spark, root):
    e = fx(spark, root, "events")
    return findings.stage_snapshot(e.select("scan_id").distinct(), e).select("scan_id", "stage", "place", "status")


@query("current_task", "events", "SELECT scan_id, stage, status FROM fx_events QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY status = 'running' DESC, created_at DESC, event_id DESC) = 1")
def current_task(spark, root):
    return findings.current_task(fx(spark, root, "events"))


JOBS_SQL = """SELECT s.scan_id AS job_id, r.user_id, s.created_at, CASE s.scan_id % 10 WHEN 0 THEN 'claimed' WHEN 1 THEN 'running' ELSE 'pending' END AS status, CAST(s.scan_id % 3 AS INT) AS priority,
  CAST(s.scan_id % 4 AS INT) AS attempts, 3 AS max_attempts, s.created_at AS run_at, s.created_at AS claimed_at, r.user_id % 5 = 0 AS few FROM {scans} s JOIN {repos} r ON s.repo_id = r.repo_id WHERE NOT (r.user_id % 5 = 0 AND s.scan_id % 10 < 2)"""


def _jobs(spark, root):
    jobs = spark.sql(JOBS_SQL, scans=fx(spark, root, "scans"), repos=fx(spark, root, "repos"))
    return jobs.withColumns({c: F.col(c).cast("timestamp") for c in ("created_at", "run_at", "claimed_at")})


_jobs_cte = "WITH j AS (" + JOBS_SQL.format(scans="fx_scans", repos="fx_repos") + ")"


@query("eligible_jobs", "scans repos", _jobs_cte + ", b AS (SELECT user_id, count(*) AS n FROM j WHERE status IN ('claimed', 'running') GROUP BY 1) SELECT j.job_id, j.user_id, j.priority, CAST(row_number() OVER (PARTITION BY j.user_id ORDER BY priority DESC, created_at, job_id) AS INT) AS user_rank FROM j LEFT JOIN b ON b.user_id = j.user_id WHERE status = 'pending' AND run_at <= DATE '1997-01-01' AND attempts < max_attempts AND coalesce(b.n, 0) < 2")
def eligible_jobs(spark, root):
    return findings.eligible_jobs(_jobs(spark, root), F.lit("1997-01-01").cast("timestamp")).select("job_id", "user_id", "priority", "user_rank")


@query("stale_jobs", "scans repos", _jobs_cte + " SELECT job_id, CASE WHEN attempts >= max_attempts THEN 'dead' ELSE 'pending' END AS new_status FROM j WHERE status IN ('claimed', 'running') AND claimed_at < TIMESTAMP '1997-01-01' - INTERVAL 30 MINUTE")
def stale_jobs(spark, root):
    return findings.stale_jobs(_jobs(spark, root), F.lit("1997-01-01").cast("timestamp"), 30).select("job_id", "new_status")


@query("call_degree", "edges", "SELECT repo_id, name, sum(i) AS callers, sum(o) AS callees FROM (SELECT repo_id, caller AS name, 0 AS i, 1 AS o FROM fx_edges UNION ALL SELECT repo_id, callee, 1, 0 FROM fx_edges) GROUP BY 1, 2")
def call_degree(spark, root):
    return graph.call_degree(fx(spark, root, "edges"))


@query("callers_summary", "edges", "SELECT repo_id, callee, string_agg(DISTINCT caller, ', ' ORDER BY caller) AS callers FROM fx_edges GROUP BY 1, 2")
def callers_summary(spark, root):
    return graph.callers_summary(fx(spark, root, "edges"))


@query(
    "risk_chains", "edges",
    """WITH RECURSIVE b AS (SELECT DISTINCT repo_id, caller AS entry, caller AS node, 0 AS d FROM fx_edges e WHERE NOT EXISTS (SELECT 1 FROM fx_edges x WHERE x.repo_id = e.repo_id AND x.callee = e.caller)
  UNION SELECT b.repo_id, b.entry, e.callee, b.d + 1 FROM b JOIN fx_edges e ON e.repo_id = b.repo_id AND e.caller = b.node WHERE b.d < 4)
SELECT repo_id, entry, node AS target, min(d) AS depth FROM b GROUP BY 1, 2, 3 HAVING min(d) > 0 AND node LIKE '%7'""",
)
def risk_chains(spark, root):
    """From every function that no other one of its repository calls."""
    e = materialize(fx(spark, root, "edges"), "edges")
    called = e.select("repo_id", F.col("callee").alias("name"))
    entries = e.select("repo_id", F.col("caller").alias("name")).distinct().join(called, ["repo_id", "name"], "left_anti")
    return graph.risk_chains(entries, e, cap=None, risky=F.col("callee").endswith("7")).select("repo_id", "entry", "target", "depth")


@query(
    "trace_callers", "edges",
    """WITH RECURSIVE e AS (SELECT repo_id, caller, callee FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, callee ORDER BY caller) AS k FROM fx_edges) WHERE k <= 20),
b AS (SELECT DISTINCT repo_id, callee AS node, 0 AS d FROM fx_edges x WHERE NOT EXISTS (SELECT 1 FROM fx_edges y WHERE y.repo_id = x.repo_id AND y.caller = x.callee)
  UNION SELECT b.repo_id, e.caller, b.d + 1 FROM b JOIN e ON e.repo_id = b.repo_id AND e.callee = b.node WHERE b.d < 2), m AS (SELECT repo_id, node, min(d) AS d FROM b GROUP BY 1, 2)
SELECT m.repo_id, CAST(m.d + 1 AS INT) AS depth, e.caller, e.callee FROM m JOIN e ON e.repo_id = m.repo_id AND e.callee = m.node WHERE m.d < 2""",
)
def trace_callers(spark, root):
    """To every function that calls no other one."""
    e = materialize(fx(spark, root, "edges"), "edges")
    calling = e.select("repo_id", F.col("caller").alias("name"))
    starts = e.select("repo_id", F.col("callee").alias("name")).distinct().join(calling, ["repo_id", "name"], "left_anti")
    return graph.trace_callers(starts, e, cap=None)


_key = "list_transform(string_split({v}, '.'), lambda x: CAST(x AS INT))"


@query("audit", "packages advisories", f"SELECT p.occurrence_id, a.advisory_id, p.version, a.fixed FROM fx_packages p JOIN fx_advisories a ON p.name = a.name AND p.ecosystem = a.ecosystem WHERE {_key.format(v='p.version')} < {_key.format(v='a.fixed')}")
def audit(spark, root):
    return packages.audit_packages(fx(spark, root, "packages"), fx(spark, root, "advisories")).select("occurrence_id", "advisory_id", "version", "fixed")


LOCK_SQL = "SELECT occurrence_id, 'r' || (occurrence_id % 7) AS repo_id, name, ecosystem, 'd' || (occurrence_id % 40) || '/' || CASE occurrence_id % 5 WHEN 0 THEN 'package-lock.json' WHEN 1 THEN 'package.json' WHEN 2 THEN 'requirements.txt' WHEN 3 THEN 'go.sum' ELSE 'Cargo.toml' END AS manifest_path FROM {packages}"


@query("lock_select", "packages", "WITH p AS (" + LOCK_SQL.format(packages="fx_packages") + "), l AS (SELECT DISTINCT repo_id, replace(manifest_path, 'package-lock.json', 'package.json') AS m FROM p WHERE manifest_path LIKE '%package-lock.json') SELECT p.occurrence_id, p.manifest_path FROM p LEFT JOIN l ON l.repo_id = p.repo_id AND l.m = p.manifest_path WHERE l.m IS NULL AND p.manifest_path NOT LIKE '%go.sum'")
def lock_select(spark, root):
    return packages.select_occurrences(spark.sql(LOCK_SQL, packages=fx(spark, root, "packages"))).select("occurrence_id", "manifest_path")


def _two_snapshots(spark, root):
    files = T.with_file_stats(fx(spark, root, "files"))
    new = files.filter("doc_id % 10 <> 3").withColumn("content_hash", F.when(F.col("doc_id") % 10 == 4, F.lit("changed")).otherwise(F.col("content_hash")))
    return files, new.unionByName(files.filter("doc_id % 10 = 5").withColumn("file_path", F.concat("file_path", F.lit(".new"))))


@query("snapshot_diff", "files", "SELECT file_path, CASE doc_id % 10 WHEN 3 THEN 'deleted' WHEN 4 THEN 'modified' ELSE 'unchanged' END AS change FROM fx_files UNION ALL SELECT file_path || '.new', 'added' FROM fx_files WHERE doc_id % 10 = 5")
def snapshot_diff(spark, root):
    return findings.snapshot_diff(*_two_snapshots(spark, root)).select("file_path", "change")


@query("carry_forward", "files", "SELECT sha256(file_path) AS fingerprint, doc_id % 10 <> 4 AS carried, CASE WHEN doc_id % 2 = 0 THEN 'fixed' ELSE 'open' END AS status FROM fx_files WHERE doc_id % 10 <> 3 UNION ALL SELECT sha256(file_path || '.new'), FALSE, 'open' FROM fx_files WHERE doc_id % 10 = 5")
def carry_forward(spark, root):
    old, new = _two_snapshots(spark, root)
    shape = lambda df, status: df.select("repo_id", "file_path", F.sha2("file_path", 256).alias("fingerprint"), status.alias("status"))
    before, after = shape(old, F.when(F.col("doc_id") % 2 == 0, "fixed").otherwise("open")), shape(new, F.lit("open"))
    return findings.carry_forward(before, after, findings.snapshot_diff(old, new)).select("fingerprint", "carried", "status")


@query("tool_usage", "tool_calls", "SELECT scan_id, stage, count(*) AS calls, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS tokens FROM fx_tool_calls GROUP BY 1, 2")
def tool_usage(spark, root):
    return findings.tool_usage(fx(spark, root, "tool_calls"))


@query("on_change", "events", "SELECT scan_id, event_id FROM (SELECT *, lag(stage) OVER w AS a, lag(status) OVER w AS b, row_number() OVER w AS k FROM fx_events WINDOW w AS (PARTITION BY scan_id ORDER BY created_at, event_id)) WHERE k = 1 OR a IS DISTINCT FROM stage OR b IS DISTINCT FROM status")
def on_change(spark, root):
    return streams.on_change(fx(spark, root, "events"), "scan_id", ["stage", "status"], ["created_at", "event_id"]).select("scan_id", "event_id")


@query("event_rates", "events", "SELECT CAST(date_trunc('hour', created_at) AS VARCHAR) AS window_start, stage, count(*) AS n FROM fx_events GROUP BY 1, 2")
def event_rates(spark, root):
    return streams.event_rates(fx(spark, root, "events")).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("live_counts", "findings", f"SELECT scan_id, count(*) AS total, {COUNTS} FROM fx_findings GROUP BY 1")
def live_counts(spark, root):
    return streams.live_counts(fx(spark, root, "findings"))


@query("cascade_delete", "repos findings", "SELECT finding_id FROM fx_findings WHERE repo_id NOT IN (SELECT repo_id FROM fx_repos WHERE deleted)")
def cascade_delete(spark, root):
    return findings.cascade_delete(fx(spark, root, "repos").filter("deleted"), fx(spark, root, "findings"), "repo_id").select("finding_id")


@query("list_repos", "repos scans", "SELECT r.repo_id, r.name, count(s.scan_id) AS scan_count FROM fx_repos r LEFT JOIN fx_scans s USING (repo_id) WHERE NOT deleted GROUP BY 1, 2")
def list_repos(spark, root):
    return findings.list_repos(fx(spark, root, "repos"), fx(spark, root, "scans")).select("repo_id", "name", "scan_count")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
