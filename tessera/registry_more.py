"""More queries over the driver's tables: recon, packages, findings state, model text, and streams run over all that is there."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.book import LINES, SECRET_SQL, query
from tessera.functions import columns as C
from tessera.operators import detect, findings, graph, modeltext, packages
from tessera.operators import text as T
from tessera.plans.fixtures import dealt, fx
from tessera.plans.scratch import new_dir
from tessera.sources import corpus, folder
from tessera.sources.tables import table
from tessera.streaming import streams


@query("leading_excerpt", "files", f"WITH {LINES} SELECT file_path, array_to_string(list_slice(x, 1, 12), chr(10)) AS excerpt, CASE WHEN len(x) > 0 THEN CAST(least(len(x), 12) AS INT) END AS excerpt_end FROM arr")
def leading_excerpt(spark, root):
    return T.leading_excerpt(fx(spark, root, "files")).select("file_path", "excerpt", "excerpt_end")


def _marked_lines(spark, root):
    rows = fx(spark, root, "files").select("file_path", T.lines_of(F.col("content")).alias("lines"))
    return rows.select("file_path", "lines", F.posexplode("lines").alias("k", "line")).filter(F.col("line").contains("Licensed")).select("file_path", "lines", (F.col("k") + 1).alias("line_no"))


@query(
    "numbered_excerpt", "files",
    f"""WITH {LINES} SELECT l.file_path, CAST(l.line_no AS INT) AS line_no, array_to_string(list_transform(range(greatest(1, l.line_no - 8), least(len(a.x), l.line_no + 12) + 1), lambda i: format('{{:5d}} | {{}}', i, a.x[i])), chr(10)) AS excerpt
FROM lines l JOIN arr a USING (file_path) WHERE contains(l.line, 'Licensed')""",
)
def numbered_excerpt(spark, root):
    return T.numbered_excerpt(_marked_lines(spark, root), "patch").select("file_path", "line_no", "excerpt")


@query(
    "window_snippet", "files",
    f"""WITH {LINES} SELECT l.file_path, CAST(l.line_no AS INT) AS line_no, greatest(1, l.line_no - 12) AS first, CAST(least(len(a.x), l.line_no + 18) - greatest(1, l.line_no - 12) + 1 AS INT) AS n,
  len(list_filter(list_slice(a.x, greatest(1, l.line_no - 12), l.line_no + 18), lambda v: strlen(v) > 240)) AS cut, l.line_no - 12 > 1 OR l.line_no + 18 < len(a.x) AS truncated, CAST(len(a.x) AS INT) AS original_line_count
FROM lines l JOIN arr a USING (file_path) WHERE contains(l.line, 'Licensed')""",
)
def window_snippet(spark, root):
    w = T.window_snippet(_marked_lines(spark, root))
    return w.select("file_path", "line_no", F.col("window")[0]["number"].cast("long").alias("first"), F.size("window").alias("n"), F.size(F.filter("window", lambda x: x["line_truncated"])).cast("long").alias("cut"), "truncated", "original_line_count")


@query("list_files", "files", f"WITH {LINES} SELECT repo_id, file_path, CAST(len(x) AS INT) AS line_count FROM arr WHERE file_path LIKE 'src/tests/%.py'")
def list_files(spark, root):
    return graph.list_files(fx(spark, root, "files"), "src/tests/", ".py")


@query("file_tree", "files", "SELECT DISTINCT repo_id, file_path FROM fx_files")
def file_tree(spark, root):
    return graph.file_tree(fx(spark, root, "files"))


@query("read_file", "files", "SELECT repo_id, file_path, CASE WHEN strlen(content) > 15000 THEN NULL ELSE content END AS content FROM fx_files WHERE file_path = 'src/f7.js'")
def read_file(spark, root):
    return graph.read_file(fx(spark, root, "files"), "src/f7.js")


@query("search_page", "files", f"WITH {LINES}, h AS (SELECT repo_id, file_path, line_no FROM lines WHERE contains(line, 'the ')) SELECT repo_id, file_path, CAST(line_no AS INT) AS line_no, (SELECT greatest(0, count(*) - 30) FROM h) AS more FROM h ORDER BY repo_id, file_path, line_no LIMIT 30")
def search_page(spark, root):
    return graph.search_page(graph.search(fx(spark, root, "files"), "the ", regex=False)).select("repo_id", "file_path", "line_no", "more")


#: Documents as lines of ``x``, after which lines of code are planted; ``n`` is the number of lines before these.
PLANTED_SQL = "m AS (SELECT *, CAST(1 + length(coalesce(content, '')) - length(replace(coalesce(content, ''), chr(10), '')) AS INT) AS n FROM fx_files)"


def _planted(spark, root, *lines: str) -> DataFrame:
    """Files in which every line of a document is blanked, with one of ``lines`` (which may be several) after it, by ``doc_id``."""
    after = F.get(F.array(*[F.lit(x) for x in lines]), (F.col("doc_id") % len(lines)).cast("int"))
    blank = F.array_join(F.transform(F.split(F.coalesce("content", F.lit("")), "\n"), lambda x: F.repeat(F.lit("x"), F.length(x))), "\n")  # by line: a pattern would run for every character
    return fx(spark, root, "files").withColumn("content", F.concat(blank, F.lit("\n"), after))


@query("find_routes", "files", f"WITH {PLANTED_SQL} SELECT repo_id, file_path, n + 1 AS line_no FROM m WHERE doc_id % 3 < 2 QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY file_path, line_no) <= 100")
def find_routes(spark, root):
    return detect.find_routes(T.to_lines(_planted(spark, root, '@app.route("/a")', "router.get('/b', f)", "get('/c')"))).select("repo_id", "file_path", "line_no")


@query("config_hits", "files", f"WITH {PLANTED_SQL} SELECT repo_id, file_path, n + 1 AS line_no, CASE doc_id % 3 WHEN 0 THEN 'os.getenv' ELSE 'process.env' END AS pattern FROM m WHERE doc_id % 3 < 2 QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY file_path, line_no) <= 30")
def config_hits(spark, root):
    return detect.config_hits(T.to_lines(_planted(spark, root, 'os.getenv("A")', "process.env.B", "c"))).select("repo_id", "file_path", "line_no", "pattern")


@query("db_hits", "files", f"WITH {PLANTED_SQL} SELECT repo_id, file_path, n + k AS line_no, 'psycopg' AS pattern FROM m CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) WHERE doc_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY file_path, line_no) <= 30")
def db_hits(spark, root):
    """Files with four lines of one library, of which three count, and of another one that comes later in the list."""
    return detect.db_hits(T.to_lines(_planted(spark, root, "psycopg\npsycopg 2\nuse psycopg, redis\npsycopg", "none"))).select("repo_id", "file_path", "line_no", "pattern")


CONFIG_SQL = """SELECT *, CASE doc_id % 3 WHEN 0 THEN 'd' || doc_id || '/Dockerfile' WHEN 1 THEN 'k/x' || doc_id || '.yml' ELSE 'i' || doc_id || '.tf' END AS path FROM m"""


@query(
    "config_rules", "files",
    f"""WITH {PLANTED_SQL}, c AS ({CONFIG_SQL}) SELECT path AS file_path, 'docker-latest-tag' AS rule_id, n + 1 AS line_start, 'low' AS severity, 'Pin the mutable dependency reference to a specific version or immutable digest.' AS fix FROM c WHERE doc_id % 3 = 0
UNION ALL SELECT path, 'docker-no-healthcheck', 1, 'low', 'Add a health check so orchestration can detect unhealthy instances.' FROM c WHERE doc_id % 3 = 0
UNION ALL SELECT path, 'k8s-privileged-container', n + 1, 'critical', 'Drop privileges and run the workload with the minimum permissions it actually needs.' FROM c WHERE doc_id % 3 = 1
UNION ALL SELECT path, 'k8s-host-pid', n + 2, 'high', 'Tighten the exposed security boundary to the minimum allow-list required.' FROM c WHERE doc_id % 3 = 1
UNION ALL SELECT path, 'tf-public-subnet-db', n + 1, 'medium', 'Keep the database inside.' FROM c WHERE doc_id % 3 = 2""",
)
def config_rules(spark, root):
    """All configuration rules over files of three kinds: rules by line, and rules of what is absent."""
    doc = F.col("doc_id").cast("string")
    path = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("d"), doc, F.lit("/Dockerfile"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("k/x"), doc, F.lit(".yml"))).otherwise(F.concat(F.lit("i"), doc, F.lit(".tf")))
    files = _planted(spark, root, "FROM a:latest\nUSER app", "  privileged: true\n  hostPID: true", " publicly_accessible = true").withColumn("file_path", path)
    return detect.scan_config_rules(files).select("file_path", "rule_id", "line_start", "severity", "fix")


@query("trace_flows", "files", """WITH s AS (SELECT doc_id AS d FROM fx_files WHERE content LIKE '%Licensed%'), o AS (SELECT d + 1 AS d FROM s WHERE d + 1 IN (SELECT doc_id FROM fx_files)),
r AS (SELECT 1 AS depth, 'f' || d AS caller, 'f' || (d - 1) AS callee FROM o UNION ALL SELECT 2, 'f' || (d + 1), 'f' || d FROM o WHERE d NOT IN (SELECT d FROM s) AND d + 1 IN (SELECT doc_id FROM fx_files)) SELECT * FROM r ORDER BY depth, callee, caller LIMIT 200""")
def trace_flows(spark, root):
    """Each file has one function, which that of the next file calls; from those in files with a match, two calls up."""
    files = fx(spark, root, "files").withColumn("repo_id", F.lit("all"))
    name = F.concat(F.lit("f"), "doc_id")
    symbols = files.select("repo_id", "file_path", name.alias("name"), F.lit("function").alias("kind"), F.lit(1).alias("line_no"))
    edges = files.select("repo_id", name.alias("caller"), F.concat(F.lit("f"), F.col("doc_id") - 1).alias("callee"))
    return graph.trace_flows(files, symbols, edges, "Licensed").select("depth", "caller", "callee")


BUDGETS, ALL_BUDGETS = {"critical": 60, "high": 40, "low": 30}, 110


@query(
    "pack_context", "findings",
    f"""WITH i AS (SELECT repo_id, severity AS section, finding_id AS pos, title AS text, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 2 END AS place, CASE severity WHEN 'critical' THEN 60 WHEN 'high' THEN 40 ELSE 30 END AS budget FROM fx_findings WHERE severity <> 'medium'),
r AS (SELECT *, sum(length(text)) OVER (PARTITION BY repo_id, section ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM i),
s AS (SELECT repo_id, section, place, coalesce(string_agg(text, chr(10) ORDER BY pos) FILTER (run <= budget), '') AS text, count(*) FILTER (run > budget) AS omitted, coalesce(sum(length(text)) FILTER (run <= budget), 0) AS used FROM r GROUP BY 1, 2, 3),
k AS (SELECT *, sum(used) OVER (PARTITION BY repo_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS every FROM s QUALIFY every <= {ALL_BUDGETS})
SELECT repo_id, string_agg('## ' || section || chr(10) || text || CASE WHEN omitted > 0 THEN chr(10) || '(' || omitted || ' omitted)' ELSE '' END, chr(10) || chr(10) ORDER BY place) AS context FROM k GROUP BY 1""",
)
def pack_context(spark, root):
    items = fx(spark, root, "findings").select("repo_id", F.col("severity").alias("section"), F.col("finding_id").alias("pos"), F.col("title").alias("text"))
    return detect.pack_context(items, BUDGETS, ALL_BUDGETS)


WORDS = ("token", "license", "the")


@query(
    "first_pattern", "files",
    f"""WITH {LINES}, h AS (SELECT repo_id, file_path, line_no, CASE WHEN contains(line, 'token') THEN [0] ELSE [] END || CASE WHEN contains(line, 'license') THEN [1] ELSE [] END || CASE WHEN contains(line, 'the') THEN [2] ELSE [] END AS ks FROM lines),
e AS (SELECT repo_id, file_path, line_no, unnest(ks) AS k FROM h), m AS (SELECT *, min(k) OVER (PARTITION BY repo_id, file_path) AS least FROM e),
r AS (SELECT * FROM m WHERE k = least QUALIFY row_number() OVER (PARTITION BY repo_id, file_path ORDER BY line_no) <= 3)
SELECT repo_id, file_path, CAST(line_no AS INT) AS line_no, ['token', 'license', 'the'][k + 1] AS pattern FROM r QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY file_path, line_no) <= 30""",
)
def first_pattern(spark, root):
    return detect.first_pattern_hits(T.to_lines(fx(spark, root, "files")), WORDS, 3, 30).select("repo_id", "file_path", "line_no", "pattern")


@query("manifest_excerpts", "files", "SELECT repo_id, file_path, left(content, 2000) AS excerpt FROM fx_files WHERE file_path LIKE '%.txt'")
def manifest_excerpts(spark, root):
    return detect.manifest_excerpts(fx(spark, root, "files"), ["*.txt"])


@query(
    "entry_list", "edges",
    """WITH s AS (SELECT DISTINCT repo_id, 'src/' || caller || '.go' AS file_path, caller AS name FROM fx_edges), f AS (SELECT repo_id, file_path, name FROM s WHERE name LIKE '%1'),
o AS (SELECT repo_id, file_path, name FROM s WHERE name NOT LIKE '%1' AND name NOT LIKE '%2' QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY file_path, name) <= 30), e AS (SELECT *, 0 AS o FROM f UNION ALL SELECT *, 1 FROM o)
SELECT repo_id, file_path, name FROM e QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY o, file_path, name) <= 50""",
)
def entry_list(spark, root):
    return graph.entry_list(_symbols(spark, root)).select("repo_id", "file_path", "name")


def _symbols(spark, root) -> DataFrame:
    """A symbol for each caller of the graph; those ending in 1 are entry points, all but those ending in 2 public."""
    name = F.col("caller")
    return fx(spark, root, "edges").select(
        "repo_id", F.concat(F.lit("src/"), name, F.lit(".go")).alias("file_path"), F.lit("go").alias("language"), name.alias("name"), F.lit("function").alias("kind"), F.lit(1).alias("line_no"),
        (~name.endswith("2")).alias("is_public"), name.endswith("1").alias("is_entry_point"),
    ).distinct()


SYMBOL_SQL = "s AS (SELECT DISTINCT repo_id, 'src/' || caller || '.go' AS file_path, caller AS name FROM fx_edges)"


@query(
    "api_surface", "edges",
    f"""WITH {SYMBOL_SQL}, p AS (SELECT *, 1 AS exports, row_number() OVER (PARTITION BY repo_id ORDER BY file_path) AS place FROM s WHERE name NOT LIKE '%2' QUALIFY place <= 30),
i AS (SELECT repo_id, callee AS name, count(*) AS callers FROM fx_edges GROUP BY 1, 2), o AS (SELECT repo_id, caller AS name, count(*) AS callees FROM fx_edges GROUP BY 1, 2)
SELECT p.repo_id, p.file_path, CAST(p.place AS INT) AS place, p.name, coalesce(i.callers, 0) AS callers, coalesce(o.callees, 0) AS callees FROM p LEFT JOIN i USING (repo_id, name) LEFT JOIN o USING (repo_id, name)""",
)
def api_surface(spark, root):
    return graph.api_surface(_symbols(spark, root), fx(spark, root, "edges")).select("repo_id", "file_path", "place", "name", "callers", "callees")


@query("find_symbol", "edges", f"WITH {SYMBOL_SQL} SELECT repo_id, file_path, name FROM s WHERE name = 'f7'")
def find_symbol(spark, root):
    return graph.find_symbol(_symbols(spark, root), "f7").select("repo_id", "file_path", "name")


BREAKS = "length(t) - length(replace(t, chr(10), ''))"


@query("declaration_ends", "files", f"""WITH d AS (SELECT file_path, replace(replace(replace(coalesce(content, ''), '"', ' '), chr(92), ' '), '*/', '  ') AS t FROM fx_files WHERE language IS NOT NULL)
SELECT file_path, 'shown' AS name, 1 AS line_no, CAST(4 + {BREAKS} AS INT) AS end_line, '' AS parent FROM d UNION ALL SELECT file_path, 'Last', CAST(5 + {BREAKS} AS INT), CAST(6 + {BREAKS} AS INT), '' FROM d""")
def declaration_ends(spark, root):
    """Each file is a function around the document's text as a comment or string, in which a declaration is hidden, and a type."""
    t = F.replace(F.replace(F.replace(F.coalesce("content", F.lit("")), F.lit('"'), F.lit(" ")), F.lit("\\"), F.lit(" ")), F.lit("*/"), F.lit("  "))
    head = {"python": "def shown():", "javascript": "function shown() {", "go": "func shown() {", "java": "  public void shown() {", "rust": "fn shown() {"}
    hidden = {"python": "def no(): pass", "javascript": "function no() {", "go": "func no() {", "java": "  public void no() {", "rust": "fn no() {"}
    last = {"python": "class Last:\n  x = 1", "javascript": "class Last {\n}", "go": "type Last struct {\n}", "java": "class Last {\n}", "rust": "struct Last {\n}"}
    of = lambda m: F.try_element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), F.col("language"))
    python = F.col("language") == "python"
    body = F.concat(of(head), F.lit("\n"), F.when(python, '  """').otherwise("/* "), t, F.lit("\n"), of(hidden), F.when(python, '"""\n  return 1\n').otherwise(" */\n}\n"), of(last))
    found = graph.extract_symbols(fx(spark, root, "files").filter("language IS NOT NULL").withColumn("content", body))
    return found.select("file_path", "name", "line_no", "end_line", F.coalesce("parent", F.lit("")).alias("parent"))


@query("dependents", "files", "SELECT DISTINCT repo_id, file_path FROM fx_files WHERE language = 'go' AND doc_id % 4 = 0")
def dependents(spark, root):
    files = fx(spark, root, "files")
    return graph.dependents(graph.imports(files.withColumn("content", F.concat(F.when(F.col("doc_id") % 4 == 0, 'import "lib/token"\n').otherwise('import "lib"\n'), F.regexp_replace("content", '"', "'")))), "lib/token")


PATCH_SQL = "SELECT finding_id, concat('p', finding_id) AS patch_id, created_at, concat('+ fix ', title) AS patch FROM {findings}"


@query("scan_patches", "findings", f"WITH p AS ({PATCH_SQL.format(findings='fx_findings')}) SELECT p.patch_id, f.scan_id, f.file_path FROM p JOIN fx_findings f USING (finding_id)")
def scan_patches(spark, root):
    f = fx(spark, root, "findings")
    return findings.scan_patches(spark.sql(PATCH_SQL, findings=f), f).select("patch_id", "scan_id", "file_path")


@query("render_findings", "findings", f"WITH p AS ({PATCH_SQL.format(findings='fx_findings')}) SELECT f.finding_id, f.title AS clean_title, f.cwe_id AS cwe, CASE cwe_id WHEN 'CWE-89' THEN 'A03' WHEN 'CWE-78' THEN 'A03' WHEN 'CWE-79' THEN 'A03' WHEN 'CWE-798' THEN 'A07' WHEN 'CWE-502' THEN 'A08' WHEN 'CWE-22' THEN 'A01' END AS owasp_code, p.patch FROM fx_findings f LEFT JOIN p USING (finding_id)")
def render_findings(spark, root):
    f = fx(spark, root, "findings")
    return findings.render_findings(f, spark.sql(PATCH_SQL, findings=f)).select("finding_id", "clean_title", "cwe", "owasp_code", "patch")


@query(
    "executive_summary", "findings",
    """WITH c AS (SELECT scan_id, count(*) AS n, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'high') AS h, count(*) FILTER (severity = 'medium') AS m, count(*) FILTER (severity = 'low') AS l FROM fx_findings GROUP BY 1)
SELECT scan_id, n || ' finding' || CASE WHEN n = 1 THEN '' ELSE 's' END || ': ' || c || ' critical, ' || h || ' high, ' || m || ' medium, ' || l || ' low.' || CASE WHEN c + h > 0 THEN ' ' || (c + h) || ' need' || CASE WHEN c + h = 1 THEN 's' ELSE '' END || ' attention first.' ELSE '' END AS text FROM c""",
)
def executive_summary(spark, root):
    return findings.executive_summary(findings.severity_summary(fx(spark, root, "findings"))).select("scan_id", "text")


ACTION_SQL = "SELECT finding_id, created_at, line_start AS action_id, CASE line_start % 40 WHEN 10 THEN 'fixed' WHEN 20 THEN 'odd' END AS status, CASE line_start % 30 WHEN 0 THEN 'critical' END AS severity FROM {findings}"


@query("triage_apply", "findings", f"WITH a AS ({ACTION_SQL.format(findings='fx_findings')}) SELECT f.finding_id, CASE WHEN a.status = 'fixed' THEN 'fixed' ELSE f.status END AS status, coalesce(a.severity, f.severity) AS severity FROM fx_findings f JOIN a USING (finding_id)")
def triage_apply(spark, root):
    f = fx(spark, root, "findings")
    return findings.apply_triage(f, spark.sql(ACTION_SQL, findings=f))[0].select("finding_id", "status", "severity")


@query("triage_audit", "findings", f"WITH a AS ({ACTION_SQL.format(findings='fx_findings')}), n AS (SELECT f.finding_id, f.status AS old_status, CASE WHEN a.status = 'fixed' THEN 'fixed' ELSE f.status END AS new_status, f.severity AS old_severity, coalesce(a.severity, f.severity) AS new_severity FROM fx_findings f JOIN a USING (finding_id)) SELECT * FROM n WHERE old_status <> new_status OR old_severity <> new_severity")
def triage_audit(spark, root):
    f = fx(spark, root, "findings")
    return findings.apply_triage(f, spark.sql(ACTION_SQL, findings=f))[1]


def _verdicts(f: DataFrame) -> DataFrame:
    kind = F.col("line_start") % 50
    sure = F.lit('```json\n{"verdict": "confirmed", "severity": "critical", "reasoning": "seen"}\n```')
    wrong = F.lit('I think: {"verdict": "FALSE_POSITIVE", "reasoning": ""} so')
    return f.select("finding_id", F.when(kind == 10, sure).when(kind == 20, wrong).when(kind == 30, '{"verdict": "plausible"}').otherwise("no verdict").alias("verdict"))


@query("verdicts_apply", "findings", """SELECT finding_id, CASE line_start % 50 WHEN 10 THEN 'critical' ELSE severity END AS severity, CASE line_start % 50 WHEN 10 THEN 'high' WHEN 20 THEN 'low' ELSE confidence END AS confidence,
  CASE line_start % 50 WHEN 20 THEN 'false_positive' ELSE status END AS status, CASE line_start % 50 WHEN 10 THEN 'confirmed' WHEN 20 THEN 'false_positive' WHEN 30 THEN 'plausible' ELSE 'unchanged' END AS outcome,
  CASE line_start % 50 WHEN 10 THEN title || chr(10) || chr(10) || '---' || chr(10) || 'seen' ELSE title END AS description FROM fx_findings""")
def verdicts_apply(spark, root):
    f = fx(spark, root, "findings").withColumn("description", F.col("title"))
    return findings.apply_verdicts(f, _verdicts(f)).select("finding_id", "severity", "confidence", "status", "outcome", "description")


@query("validation_apply", "findings", """SELECT finding_id, CASE WHEN line_start % 20 = 0 THEN line_start % 40 = 0 ELSE poc_validated END AS poc_validated, CASE WHEN line_start % 20 = 0 THEN '{"verdict":"' || CASE WHEN line_start % 40 = 0 THEN 'confirmed' ELSE 'failed' END || '","exit_code":' || line_start || ',"output":"' || title || '"}' WHEN line_start % 30 = 0 THEN '{"stored":' || line_start || '}' END AS poc_result FROM fx_findings""")
def validation_apply(spark, root):
    """Some findings have a stored result; two in three of the results are older ones of the same findings."""
    f = fx(spark, root, "findings").withColumn("poc_result", F.when(F.col("line_start") % 10 == 0, F.when(F.col("line_start") % 30 == 0, F.concat(F.lit('{"stored":'), "line_start", F.lit("}")))))
    verdict = F.when((F.col("line_start") % 40 == 0) == (F.col("k") == 0), "confirmed").otherwise("failed")
    got = f.filter("line_start % 20 = 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    got = got.select("finding_id", verdict.alias("verdict"), F.col("line_start").alias("exit_code"), F.col("title").alias("output"), F.date_sub("created_at", F.col("k")).alias("created_at"))
    return findings.apply_validation(f, got).select("finding_id", "poc_validated", "poc_result")


@query("merge_new", "findings", "WITH f AS (SELECT finding_id, title || ':' || file_path AS fingerprint, line_start, file_path FROM fx_findings) SELECT finding_id, fingerprint FROM f WHERE line_start % 20 = 0 AND fingerprint NOT IN (SELECT fingerprint FROM f WHERE line_start % 20 <> 0) QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY finding_id, file_path, line_start) = 1")
def merge_new(spark, root):
    f = fx(spark, root, "findings").select("finding_id", F.concat_ws(":", "title", "file_path").alias("fingerprint"), "file_path", "line_start")
    return findings.merge_new(f.filter("line_start % 20 <> 0"), f.filter("line_start % 20 = 0")).select("finding_id", "fingerprint")


@query("detector_summary", "findings", "SELECT scan_id, cwe_id AS source, count(*) AS n FROM fx_findings GROUP BY 1, 2")
def detector_summary(spark, root):
    return findings.detector_summary(fx(spark, root, "findings").withColumn("source", F.col("cwe_id")))


KINDS = ("status_change", "ai_explanation", "ai_verification", "issue_linked", "remediation_pr_opened", "comment", "remediation_failed")
EVENT_SQL = f"""SELECT event_id, user_id AS finding_id, ts AS created_at, CASE event_id % {len(KINDS)} {' '.join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(KINDS))} END AS event_type,
  CASE event_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'in_review' END AS old_value, CASE event_id % 4 WHEN 0 THEN 'fixed' WHEN 1 THEN 'false_positive' WHEN 2 THEN 'noted' END AS new_value, CASE WHEN event_id % 2 = 0 THEN 'said' END AS comment,
  CASE event_id % 5 WHEN 0 THEN concat('{{{{"summary":"s', CAST(event_id AS STRING), '","verdict":"confirmed","provider":"gitlab","external_issue_number":"', CAST(event_id AS STRING), '","created":true,"pr_url":"u"}}}}') WHEN 1 THEN 'broken' END AS metadata FROM {{events}}"""


@query("latest_event", "", f"WITH e AS ({EVENT_SQL.format(events='events')}) SELECT finding_id, event_id, new_value FROM e WHERE event_type = 'comment' QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY created_at DESC, event_id DESC) = 1")
def latest_event(spark, root):
    return findings.latest_event(spark.sql(EVENT_SQL, events=table(spark, root, "events")), "comment").select("finding_id", "event_id", "new_value")


@query(
    "activity_feed", "",
    f"""WITH e AS ({EVENT_SQL.format(events='events')}),
v AS (SELECT *, CASE new_value WHEN 'fixed' THEN 'Fixed' WHEN 'false_positive' THEN 'False Positive' WHEN 'noted' THEN 'Noted' END AS n, CASE old_value WHEN 'open' THEN 'Open' WHEN 'in_review' THEN 'In Review' END AS o, event_id % 5 = 0 AS m FROM e)
SELECT event_id, CASE event_type WHEN 'status_change' THEN 'Status updated' WHEN 'ai_explanation' THEN 'AI explanation generated' WHEN 'ai_verification' THEN 'AI verification: ' || CASE WHEN m THEN 'Confirmed' ELSE 'Needs Review' END
    WHEN 'issue_linked' THEN 'Repository issue linked' WHEN 'remediation_pr_opened' THEN 'Fix PR opened' WHEN 'remediation_failed' THEN 'Fix PR agent failed' ELSE 'Comment' END AS feed_title,
  CASE event_type WHEN 'status_change' THEN coalesce('Triage moved from ' || o || ' to ' || n || '.', 'Triage moved to ' || n || '.', comment, 'The finding status was updated.')
    WHEN 'ai_explanation' THEN CASE WHEN m THEN 's' || event_id ELSE coalesce(comment, 'Plain-language clarification is now available for this alert.') END
    WHEN 'ai_verification' THEN coalesce(comment, 'A second-pass verification review was recorded.')
    WHEN 'issue_linked' THEN CASE WHEN m THEN 'GITLAB issue #' || event_id || ' was created for this finding.' ELSE coalesce(comment, 'Repository issue linkage changed.') END
    WHEN 'remediation_pr_opened' THEN CASE WHEN m THEN 'Draft pull request opened: u' ELSE coalesce(comment, 'A draft pull request was opened for this finding.') END
    WHEN 'remediation_failed' THEN coalesce(comment, 'Fix PR generation failed before a pull request was opened.') ELSE coalesce(comment, new_value, old_value, 'Review activity was recorded.') END AS detail,
  CASE event_type WHEN 'status_change' THEN CASE new_value WHEN 'fixed' THEN 'success' WHEN 'false_positive' THEN 'warning' ELSE 'active' END WHEN 'ai_explanation' THEN 'active' WHEN 'ai_verification' THEN CASE WHEN m THEN 'success' ELSE 'active' END
    WHEN 'issue_linked' THEN 'success' WHEN 'remediation_pr_opened' THEN 'success' WHEN 'remediation_failed' THEN 'warning' ELSE 'neutral' END AS tone FROM v""",
)
def activity_feed(spark, root):
    return findings.activity_feed(spark.sql(EVENT_SQL, events=table(spark, root, "events"))).select("event_id", "feed_title", "detail", "tone")


@query("list_scans", "scans findings", "WITH n AS (SELECT scan_id, count(*) AS n FROM fx_findings GROUP BY 1) SELECT s.repo_id, s.scan_id, coalesce(n.n, 0) AS finding_count, CAST(row_number() OVER (PARTITION BY s.repo_id ORDER BY s.created_at DESC, s.scan_id DESC) AS INT) AS position FROM fx_scans s LEFT JOIN n USING (scan_id)")
def list_scans(spark, root):
    return findings.list_scans(fx(spark, root, "scans"), fx(spark, root, "findings")).select("repo_id", "scan_id", "finding_count", "position")


@query("search_repos", "repos", "SELECT repo_id FROM fx_repos WHERE contains(lower(name), '00001')")
def search_repos(spark, root):
    return findings.search_repos(fx(spark, root, "repos"), "00001", ("name",)).select("repo_id")


URL_SQL = "SELECT repo_id, concat(CASE repo_id % 3 WHEN 0 THEN 'https://Host.com/' WHEN 1 THEN 'git@host.com/' ELSE 'http://host.com/' END, 'Team/', name, CASE repo_id % 2 WHEN 0 THEN '.git' ELSE '' END) AS remote_url FROM {repos}"


@query("match_push", "repos", "SELECT 'e' || repo_id AS event_id, repo_id FROM fx_repos")
def match_push(spark, root):
    repos = spark.sql(URL_SQL, repos=fx(spark, root, "repos"))
    pushed = repos.select(F.concat(F.lit("e"), "repo_id").alias("event_id"), F.upper("remote_url").alias("remote_url"))
    pushed = pushed.select("event_id", F.concat(F.lit("https://host.com/"), F.regexp_replace(F.regexp_replace("remote_url", r"^(HTTPS://HOST\.COM/|GIT@HOST\.COM/|HTTP://HOST\.COM/)", ""), r"\.GIT$", "")).alias("clone_url"))
    return findings.match_push(pushed, repos).select("event_id", "repo_id")


@query("mark_connected", "repos", "SELECT repo_id, repo_id % 4 = 0 AS connected FROM fx_repos")
def mark_connected(spark, root):
    repos = spark.sql(URL_SQL, repos=fx(spark, root, "repos"))
    return findings.mark_connected(repos.withColumnRenamed("remote_url", "clone_url"), repos.filter("repo_id % 4 = 0")).select("repo_id", "connected")


@query(
    "transitions", "events",
    """SELECT scan_id, arg_max(status, created_at) AS status, min(created_at) FILTER (status = 'running') AS started_at, max(created_at) FILTER (status IN ('completed', 'failed')) AS finished_at FROM fx_events GROUP BY 1""",
)
def transitions(spark, root):
    e = fx(spark, root, "events").select("scan_id", "status", F.col("created_at").cast("timestamp").alias("at"))
    rows = e.select("scan_id", F.lit("pending").alias("status"), F.lit(None).cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at")).distinct()
    return findings.apply_transitions(rows, e, ["scan_id"])


@query("fixed_versions", "advisories", "SELECT advisory_id, fixed AS recommended FROM fx_advisories")
def fixed_versions(spark, root):
    """The ranges of the advisories, as the nested documents that scanners publish, and the version that ends each."""
    a = fx(spark, root, "advisories")
    spans = F.array(F.struct(F.lit("SEMVER").alias("type"), F.array(F.struct("introduced", F.lit(None).cast("string").alias("fixed"), F.lit(None).cast("string").alias("last_affected")), F.struct(F.lit(None).cast("string").alias("introduced"), "fixed", F.lit(None).cast("string").alias("last_affected"))).alias("events")))
    docs = a.select(F.col("advisory_id").alias("id"), F.array(F.struct(F.struct("name", "ecosystem").alias("package"), spans.alias("ranges"))).alias("affected"), "name")
    return packages.fixed_versions(docs).select(F.col("id").alias("advisory_id"), "recommended")


@query("advisory_ranges", "advisories", "SELECT advisory_id, ecosystem, name, introduced, fixed FROM fx_advisories")
def advisory_ranges(spark, root):
    """The advisories as JSON lines in the shared folder, read back by their reader."""
    a = fx(spark, root, "advisories")
    spans = F.array(F.struct(F.lit("SEMVER").alias("type"), F.array(F.struct("introduced", F.lit(None).cast("string").alias("fixed")), F.struct(F.lit(None).cast("string").alias("introduced"), "fixed")).alias("events")))
    path = new_dir(spark, "advisories")
    a.select(F.col("advisory_id").alias("id"), F.array(F.struct(F.struct("name", "ecosystem").alias("package"), spans.alias("ranges"))).alias("affected")).write.json(path)
    return corpus.advisory_ranges(corpus.read_advisories(spark, path)).select("advisory_id", "ecosystem", "name", "introduced", "fixed")


@query("scanner_findings", "findings", "SELECT title AS rule_id, file_path, line_start, CASE severity WHEN 'critical' THEN 'high' WHEN 'high' THEN 'medium' WHEN 'medium' THEN 'medium' ELSE 'low' END AS severity, confidence, cwe_id, sha256('semgrep:' || title || ':' || file_path || ':' || line_start) AS fingerprint FROM fx_findings")
def scanner_findings(spark, root):
    """The findings as an external scanner's JSON in the shared folder, read back by its reader."""
    f = fx(spark, root, "findings")
    sev = F.when(F.col("severity") == "critical", "ERROR").when(F.col("severity") == "low", "INFO").otherwise("WARNING")
    meta = F.struct(F.upper("confidence").alias("confidence"), F.array(F.concat("cwe_id", F.lit(": x"))).alias("cwe"))
    one = F.struct(F.col("title").alias("check_id"), F.concat(F.lit("/work/"), "file_path").alias("path"), F.struct(F.col("line_start").alias("line")).alias("start"), F.struct(F.lit("m").alias("message"), sev.alias("severity"), meta.alias("metadata")).alias("extra"))
    path = new_dir(spark, "scanner")
    f.select(F.array(one).alias("results")).write.json(path)
    return corpus.read_scanner_json(spark, path, "/work", multi_line=False).select("rule_id", "file_path", "line_start", "severity", "confidence", "cwe_id", "fingerprint")


@query("model_json", "", "SELECT conv_id, turn, coalesce(text, '') AS said FROM conversations")
def model_json(spark, root):
    """Texts wrapped as a model does: plain JSON, in a fence, or inside prose."""
    rows = table(spark, root, "conversations").select("conv_id", "turn", F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("said"))).alias("j"))
    fence = F.concat(F.lit("```json\n"), "j", F.lit("\n```"))
    said = F.when(F.col("conv_id") % 3 == 0, F.col("j")).when(F.col("conv_id") % 3 == 1, fence).otherwise(F.concat(F.lit("So: "), "j", F.lit(" and {more}")))
    return rows.select("conv_id", "turn", F.from_json(modeltext.extract_json(said), "said string")["said"].alias("said"))


@query("patch_grounding", "files", f"WITH {LINES} SELECT doc_id, len(x) > 0 AND doc_id % 3 = 0 AS grounded FROM arr")
def patch_grounding(spark, root):
    """A patch for the first line of every file: a true one, one of a line that isn't there, one of another file."""
    files = fx(spark, root, "files")
    line = F.coalesce(F.get(T.lines_of(F.col("content")), F.lit(0)), F.lit(""))
    f = files.select(F.col("doc_id").alias("finding_id"), "repo_id", "file_path", F.lit(1).alias("line_start"))
    path = F.when(F.col("doc_id") % 3 == 2, F.lit("else.py")).otherwise(F.col("file_path"))
    old = F.when(F.col("doc_id") % 3 == 1, F.lit("never written §")).otherwise(line)
    patch = F.concat(F.lit("--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n@@ -1,1 +1,1 @@\n-"), old, F.lit("\n+new\n"))
    p = files.select(F.col("doc_id").alias("finding_id"), patch.alias("patch"))
    return modeltext.validate_patches(p, f, files).select(F.col("finding_id").alias("doc_id"), "grounded")


def _spread(spark, root) -> DataFrame:
    """The findings of which models are made, over all cores: small tables are one file split each, and models are costly to build and to parse. Large ones are dealt out already."""
    f = fx(spark, root, "findings").select("finding_id", "repo_id", "file_path", "line_start", "title", "severity", "cwe_id")
    cores = spark.sparkContext.defaultParallelism
    return f if dealt(spark, root, "findings") >= cores else f.repartition(cores, "finding_id")


def _models(spark, root) -> DataFrame:
    f = _spread(spark, root)
    quote, o, c = F.lit('"'), F.lit("{"), F.lit("}")
    part = F.when(F.col("line_start") % 20 == 0, "risks").otherwise("threats")
    decision = F.when(F.col("line_start") % 30 == 0, "Accepted").otherwise("x")
    place = F.concat(F.lit("./"), "file_path", F.when(F.col("line_start") % 20 == 0, "").otherwise(".no"))
    threat = F.to_json(F.struct(F.col("title"), F.concat(F.lit("very "), "severity").alias("severity"), F.array(F.lit("s"), F.lit("Denial"), F.lit("spoof")).alias("stride"), decision.alias("decision")))
    surface = F.to_json(F.struct(F.lit("c").alias("concern"), place.alias("location")))
    model = F.concat(o, quote, part, quote, F.lit(": ["), threat, F.lit(', "'), "cwe_id", F.lit('"], "attack_surfaces": ['), surface, F.lit("]"), c)
    return f.select(F.col("finding_id").alias("model_id"), "repo_id", "file_path", model.alias("model"))


@query(
    "threat_items", "findings",
    """SELECT finding_id AS model_id, 1 AS position, title AS name, CASE WHEN severity = 'medium' THEN 'medium' ELSE severity END AS risk_level, CASE line_start % 30 WHEN 0 THEN 'accept' ELSE 'mitigate' END AS risk_treatment, 'spoofing,denial_of_service' AS stride FROM fx_findings
UNION ALL SELECT finding_id, 2, cwe_id, 'medium', 'mitigate', '' FROM fx_findings""",
)
def threat_items(spark, root):
    got = modeltext.model_items(_models(spark, root), "threats")
    return got.select("model_id", "position", "name", "risk_level", "risk_treatment", F.array_join("stride", ",").alias("stride"))


def _plans(spark, root) -> DataFrame:
    """A model for each finding: a head, an assumption, two mitigations, a check and a claim, under keys that vary with its line."""
    f = _spread(spark, root)
    odd = F.col("line_start") % 2 == 1
    state = F.when(F.col("line_start") % 3 == 0, "Implemented").when(F.col("line_start") % 3 == 1, "needs-validation").otherwise("odd")
    one = lambda **kv: F.struct(*[v.alias(k) for k, v in kv.items()])
    rest = F.to_json(one(
        overview=F.col("title"), scope=one(repo=F.col("repo_id"), included=F.array("file_path", F.lit("all"))), model_assumptions=F.array(one(title=F.col("title"), risk=F.col("severity"))),
        validation=F.array(one(threat=F.col("title"), tool=F.lit("ci"), state=state)), assurance=F.array(one(statement=F.col("cwe_id"), level=F.col("severity"), gaps=F.array("file_path"))),
    ))
    acts = F.to_json(F.array(one(risk=F.col("title"), recommendation=F.concat(F.lit("fix "), "file_path"), decision=F.lit("Watch"), status=state)))
    key = F.when(odd, "countermeasures").otherwise("actions")
    model = F.concat(F.lit('{"'), key, F.lit('": ["review", '), F.expr("substr(acts, 2)"), F.lit(", "), F.expr("substr(rest, 2)"))
    return f.select("*", rest.alias("rest"), acts.alias("acts")).select(F.col("finding_id").alias("model_id"), model.alias("model"))


STATE_SQL = "CASE line_start % 3 WHEN 0 THEN 'existing' WHEN 1 THEN 'needs_validation' ELSE 'proposed' END"


@query("model_heads", "findings", "SELECT finding_id AS model_id, title AS summary, CAST(repo_id AS VARCHAR) AS subject, 'unknown' AS system_type, file_path || ',all' AS in_scope, 0 AS others FROM fx_findings")
def model_heads(spark, root):
    got = modeltext.model_heads(_plans(spark, root))
    return got.select("model_id", "summary", "subject", "system_type", F.array_join("in_scope", ",").alias("in_scope"), (F.size("out_of_scope") + F.size("assets") + F.size("entry_points")).alias("others"))


@query(
    "model_mitigations", "findings",
    f"""SELECT finding_id AS model_id, 1 AS position, 'Unspecified threat' AS threat, 'review' AS action, 'mitigate' AS risk_treatment, 'proposed' AS status FROM fx_findings
UNION ALL SELECT finding_id, 2, title, 'fix ' || file_path, 'monitor', {STATE_SQL} FROM fx_findings""",
)
def model_mitigations(spark, root):
    return modeltext.model_items(_plans(spark, root), "mitigations").select("model_id", "position", "threat", "action", "risk_treatment", "status")


@query(
    "model_checks", "findings",
    f"""SELECT finding_id AS model_id, title AS statement, severity AS why_it_matters, title AS target, 'Manual security review' AS method, {STATE_SQL} AS status, cwe_id AS claim,
  CASE WHEN severity IN ('high', 'low') THEN severity ELSE 'medium' END AS confidence, file_path AS gaps FROM fx_findings""",
)
def model_checks(spark, root):
    """Each part is read from the row of the part before, so models are parsed once and not joined with themselves."""
    rows = modeltext.model_items(_plans(spark, root), "assumptions", keep_model=True).select("model_id", "m", "statement", "why_it_matters")
    rows = modeltext.model_items(rows, "validation_plan", keep=("statement", "why_it_matters"), keep_model=True).select("model_id", "m", "statement", "why_it_matters", "target", "method", "status")
    rows = modeltext.model_items(rows, "assurance_claims", keep=("statement", "why_it_matters", "target", "method", "status"))
    return rows.select("model_id", "statement", "why_it_matters", "target", "method", "status", "claim", "confidence", F.array_join("gaps", ",").alias("gaps"))


@query("ground_surfaces", "findings", "SELECT finding_id AS model_id, file_path AS file FROM fx_findings WHERE line_start % 20 = 0")
def ground_surfaces(spark, root):
    surfaces = modeltext.model_items(_models(spark, root), "surfaces", keep=("repo_id",))
    return modeltext.ground_surfaces(surfaces, fx(spark, root, "findings").select("repo_id", "file_path")).select("model_id", F.expr("substr(file, 3)").alias("file"))


@query("ground_flows", "findings", "SELECT finding_id FROM fx_findings WHERE line_start % 20 = 0 OR line_start % 30 = 0")
def ground_flows(spark, root):
    """Flows of which some name a file of their repository, some something generic, some neither."""
    f = fx(spark, root, "findings")
    source = F.when(F.col("line_start") % 20 == 0, F.concat(F.lit("See "), F.element_at(F.split("file_path", "/"), -1))).otherwise("zzz")
    flows = f.select("finding_id", "repo_id", source.alias("source"), F.when(F.col("line_start") % 30 == 0, "The Database").otherwise("yyy").alias("sink"))
    return modeltext.ground_flows(flows, f.select("repo_id", "file_path")).select("finding_id")


def _drain(spark: SparkSession, landed: str, schema, build: Callable[[DataFrame], DataFrame], mode: str, files: int):
    """The files of ``landed`` through ``build`` as a stream until all are read: the finished query and the sink's rows from the shared folder.

    Each batch of the sink has a folder of its own. In complete mode the last batch counts, in append mode all.
    """
    out, checkpoint = (new_dir(spark, x) for x in ("sink", "stream-checkpoint"))
    result = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(landed))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = result.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    found = spark.read.parquet(out)
    if mode == "complete":
        found = found.filter(F.col("batch") == found.agg(F.max("batch")).first()[0])
    return q, found.drop("batch")


def streamed(spark: SparkSession, rows: DataFrame, build: Callable[[DataFrame], DataFrame], mode: str, parts: int = 4) -> DataFrame:
    """``rows``, landed as files, run through ``build`` as a stream in two batches.

    Each task lands a file of its own rows, so files grow in number with the input and not in size; fewer than ``parts`` are dealt again.
    """
    landed = new_dir(spark, "landing")
    rows.write.parquet(landed)
    files = len(spark.read.schema(rows.schema).parquet(landed).inputFiles())
    if files < parts:
        few, landed, files = spark.read.schema(rows.schema).parquet(landed), new_dir(spark, "landing"), parts
        few.repartition(parts).write.parquet(landed)
    return _drain(spark, landed, rows.schema, build, mode, -(-files // 2))[1]


def streamed_in_order(spark: SparkSession, rows: DataFrame, build: Callable[[DataFrame, str], DataFrame], parts: int = 8, late: bool = False):
    """``rows``, landed in order of time but for up to a sixteenth of their time span, run through ``build(stream, delay)``; query and rows.

    Then come, with ``late``, the rows of the first quarter again, and a row far ahead, with which the watermark passes all others.
    """
    landed, at = new_dir(spark, "landing"), F.unix_seconds("created_at")
    low, high = rows.agg(F.min(at), F.max(at)).first()
    span = high - low + 16
    moved = at + F.pmod(F.xxhash64("event_id"), F.lit(span // 16))
    part = F.least(F.lit(parts - 1), F.floor((moved - low) * parts / (span + span // 16)))
    for k in range(parts):
        rows.filter(part == k).repartition(2).write.mode("append").parquet(landed)
    if late:
        rows.filter(at < low + span // 4).repartition(2).write.mode("append").parquet(landed)
    ahead = F.expr("timestamp'2100-01-01'")
    end = spark.range(1).select(*[(ahead if c == "created_at" else F.lit(-1) if c in ("scan_id", "event_id") else F.lit(None)).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
    end.write.mode("append").parquet(landed)
    return _drain(spark, landed, rows.schema, lambda s: build(s, f"{span // 4} seconds"), "append", 2)


COUNTS = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in C.SEVERITIES)


@query("stream_live_counts", "findings", f"SELECT scan_id, count(*) AS total, {COUNTS} FROM fx_findings GROUP BY 1")
def stream_live_counts(spark, root):
    return streamed(spark, fx(spark, root, "findings").select("scan_id", "severity"), streams.live_counts, "complete")


def _events(spark, root) -> DataFrame:
    return fx(spark, root, "events").withColumn("created_at", F.col("created_at").cast("timestamp"))


@query("stream_stage_state", "events", "SELECT scan_id, stage, status FROM fx_events QUALIFY row_number() OVER (PARTITION BY scan_id, stage ORDER BY created_at DESC, event_id DESC) = 1")
def stream_stage_state(spark, root):
    return streamed(spark, _events(spark, root), streams.stage_state, "complete").select("scan_id", "stage", "status")


@query("stream_event_rates", "events", "SELECT CAST(date_trunc('hour', created_at) AS VARCHAR) AS window_start, stage, count(*) AS n FROM fx_events GROUP BY 1, 2")
def stream_event_rates(spark, root):
    rates = streamed(spark, _events(spark, root), lambda s: streams.event_rates(s, watermark=None), "complete")
    return rates.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("stream_session_rates", "events", """WITH m AS (SELECT *, CASE WHEN created_at - lag(created_at) OVER (PARTITION BY scan_id ORDER BY created_at, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM fx_events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY scan_id ORDER BY created_at, event_id) AS k FROM m) SELECT scan_id, CAST(date_trunc('second', min(created_at)) AS VARCHAR) AS session_start, count(*) AS n FROM s GROUP BY scan_id, k""")
def stream_session_rates(spark, root):
    found = streamed(spark, _events(spark, root), lambda s: streams.session_rates(s, watermark=None), "complete")
    return found.select("scan_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")


CHANGES = "scan_id", ["stage", "status"], ["created_at", "event_id"]


@query("stream_on_change", "events", "SELECT scan_id, event_id FROM (SELECT *, lag(stage) OVER w AS a, lag(status) OVER w AS b, row_number() OVER w AS k FROM fx_events WINDOW w AS (PARTITION BY scan_id ORDER BY created_at, event_id)) WHERE k = 1 OR a IS DISTINCT FROM stage OR b IS DISTINCT FROM status")
def stream_on_change(spark, root):
    return streamed_in_order(spark, _events(spark, root), lambda s, delay: streams.on_change(s, *CHANGES, delay=delay))[1].select("scan_id", "event_id")


@query("stream_until_terminal", "events", "WITH t AS (SELECT *, CASE WHEN status = 'failed' THEN 1 ELSE 0 END AS ends FROM fx_events) SELECT scan_id, event_id FROM t QUALIFY coalesce(sum(ends) OVER (PARTITION BY scan_id ORDER BY created_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0")
def stream_until_terminal(spark, root):
    rows = _events(spark, root).select("scan_id", "event_id", F.when(F.col("status") == "failed", "error").otherwise("progress").alias("event_type"), "created_at")
    return streamed_in_order(spark, rows, lambda s, delay: streams.until_terminal(s, delay, keep=None))[1].select("scan_id", "event_id")


@query("stream_late_rows", "events", """WITH m AS (SELECT CAST(epoch(date_trunc('second', created_at)) AS BIGINT) AS t FROM fx_events), s AS (SELECT t, min(t) OVER () AS low, max(t) OVER () AS high FROM m) SELECT count(*) AS dropped FROM s WHERE t < low + (high - low + 16) // 4""")
def stream_late_rows(spark, root):
    """The rows of the first quarter, in whole seconds, come again after all others: all of them are dropped behind the watermark, and no others."""
    q, _ = streamed_in_order(spark, _events(spark, root), lambda s, delay: streams.on_change(s, *CHANGES, delay=delay), late=True)
    return spark.range(1).select(F.lit(streams.late_rows(q)).cast("long").alias("dropped"))


@query("stream_rates_late", "events", "SELECT CAST(date_trunc('hour', created_at) AS VARCHAR) AS window_start, stage, count(*) AS n FROM fx_events GROUP BY 1, 2")
def stream_rates_late(spark, root):
    """Windows close at the watermark; rows that come later, here all of the first quarter again, are left out."""
    _, found = streamed_in_order(spark, _events(spark, root), lambda s, delay: streams.event_rates(s, watermark=delay), late=True)
    return found.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("stream_sliding_rates", "events", """SELECT CAST(date_trunc('hour', created_at) - to_hours(CAST(k AS INTEGER)) AS VARCHAR) AS window_start, stage, count(*) AS n
  FROM fx_events CROSS JOIN (SELECT unnest(range(0, 6)) AS k) GROUP BY 1, 2""")
def stream_sliding_rates(spark, root):
    """Windows of six hours that begin every hour, closed at the watermark, with late rows."""
    _, found = streamed_in_order(spark, _events(spark, root), lambda s, delay: streams.event_rates(s, "6 hours", "1 hour", delay), late=True)
    return found.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("stream_parsed_events", "events", "SELECT scan_id, event_id, status FROM fx_events WHERE event_id % 4 <> 0")
def stream_parsed_events(spark, root):
    kind = F.when(F.col("event_id") % 4 == 0, "odd").otherwise("progress")
    lines = _events(spark, root).select(F.to_json(F.struct("scan_id", "event_id", kind.alias("event_type"), F.col("created_at").alias("timestamp"), F.struct("stage", "status").alias("data"))).alias("value"))
    return streamed(spark, lines, streams.parse_scan_events, "append").select("scan_id", "event_id", F.col("data.status").alias("status"))


@query("stream_secrets", "files", SECRET_SQL.replace(" round(e, 4) AS entropy,", ""))
def stream_secrets(spark, root):
    """Secrets of landing files: those of the batch query ``secrets``."""
    return streamed(spark, fx(spark, root, "files").select("repo_id", "file_path", "language", "content"), streams.scan_stream, "append").select("file_path", "line_start", "literal", "fingerprint")


@query("stream_snapshot_tail", "events", "SELECT scan_id, event_id FROM fx_events")
def stream_snapshot_tail(spark, root):
    """A third of the events is the snapshot; the stream brings all of them, and runs twice."""
    rows = _events(spark, root).select("scan_id", "event_id", "created_at")
    landed, out, checkpoint = (new_dir(spark, x) for x in ("landing", "sink", "stream-checkpoint"))
    rows.write.parquet(landed)
    stream = spark.readStream.schema(rows.schema).parquet(landed)
    for _ in range(2):
        streams.snapshot_then_tail(rows.filter("event_id % 3 = 0"), stream, out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select("scan_id", "event_id")


@query("stream_scan_requests", "repos", "SELECT repo_id, 'c' || repo_id AS commit FROM fx_repos")
def stream_scan_requests(spark, root):
    repos = spark.sql(URL_SQL, repos=fx(spark, root, "repos"))
    body = F.to_json(F.struct(F.lit("refs/heads/main").alias("ref"), F.concat(F.lit("c"), "repo_id").alias("after"), F.struct(F.col("remote_url").alias("clone_url")).alias("repository")))
    pushed = repos.select(F.lit("push").alias("event_type"), body.alias("body"))
    return streamed(spark, pushed, lambda s: streams.scan_requests(s, repos), "append").select("repo_id", "commit")


ODD_EVENTS = "CASE event_id % 13 WHEN 0 THEN 'provider_fallback' WHEN 1 THEN 'scan_failed' ELSE 'progress' END"


@query(
    "scan_snapshot", "events findings",
    f"""WITH e AS (SELECT *, {ODD_EVENTS} AS event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE status END AS s FROM fx_events),
t AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY created_at DESC, event_id DESC) AS k, CASE WHEN s = 'completed' THEN 'success' WHEN s = 'failed' THEN 'error' WHEN s = 'running' THEN 'active' WHEN event_type = 'scan_failed' THEN 'error' ELSE 'neutral' END AS tone FROM e QUALIFY k <= 80),
a AS (SELECT scan_id, string_agg(event_id || ':' || tone, ',' ORDER BY k) AS activity, coalesce(arg_min(stage, k) FILTER (s = 'running'), arg_min(stage, k)) AS task FROM t GROUP BY 1),
l AS (SELECT scan_id, stage, s FROM e QUALIFY row_number() OVER (PARTITION BY scan_id, stage ORDER BY created_at DESC, event_id DESC) = 1),
g AS (SELECT unnest({list(findings.STAGES)!r}) AS stage, unnest(range(1, 10)) AS place),
p AS (SELECT x.scan_id, string_agg(coalesce(l.s, 'pending'), ',' ORDER BY place) AS stages FROM (SELECT DISTINCT scan_id FROM e) x CROSS JOIN g LEFT JOIN l ON l.scan_id = x.scan_id AND l.stage = g.stage GROUP BY 1),
b AS (SELECT scan_id, arg_max(event_id, (created_at, event_id)) AS fallback FROM e WHERE event_type = 'provider_fallback' GROUP BY 1),
n AS (SELECT scan_id, count(*) AS total, count(*) FILTER (severity = 'high') AS high FROM fx_findings GROUP BY 1)
SELECT a.scan_id, activity, task, stages, fallback, coalesce(total, 0) AS total, coalesce(high, 0) AS high FROM a JOIN p USING (scan_id) LEFT JOIN b USING (scan_id) LEFT JOIN n USING (scan_id)""",
)
def scan_snapshot(spark, root):
    e = _events(spark, root).withColumn("event_type", F.expr(ODD_EVENTS)).withColumn("status", F.when(F.col("event_id") % 7 != 0, F.col("status")))
    found = findings.scan_snapshot(e.select("scan_id").distinct().withColumn("status", F.lit("hunting")), fx(spark, root, "findings"), e)
    return found.select(
        "scan_id", F.array_join(F.transform("activity", lambda x: F.concat_ws(":", x["event_id"], x["tone"])), ",").alias("activity"), F.col("current_task.stage").alias("task"),
        F.array_join(F.transform("stages", lambda x: x["status"]), ",").alias("stages"), F.col("fallback.event_id").alias("fallback"), "counts.total", "counts.high",
    )


def _parts(v: str) -> str:
    return f"list_transform(string_split({v}, '.'), lambda x: CAST(x AS INT))"


ROW_RANGE = "CAST(s_nationkey % 3 AS VARCHAR) || '.5.0' AS introduced, CAST(2 + s_nationkey % 3 AS VARCHAR) || '.3.9' AS last_affected"


@query("audit_ranges", "packages", f"""WITH a AS (SELECT s_suppkey AS advisory, 'pkg' || (s_suppkey % 50) AS name, CASE s_suppkey % 3 WHEN 0 THEN 'npm' WHEN 1 THEN 'PyPI' ELSE 'crates.io' END AS ecosystem, {ROW_RANGE} FROM supplier)
SELECT p.occurrence_id, a.advisory FROM fx_packages p JOIN a ON p.name = a.name AND p.ecosystem = a.ecosystem WHERE {_parts('p.version')} >= {_parts('a.introduced')} AND {_parts('p.version')} <= {_parts('a.last_affected')}""")
def audit_ranges(spark, root):
    """Ranges that begin within a version line and end with a last affected one, by the rules of three ecosystems."""
    a = fx(spark, root, "advisories").join(table(spark, root, "supplier"), F.expr("advisory_id = concat('ADV-', s_suppkey)"))
    line = F.col("s_nationkey") % 3
    a = a.select(F.col("s_suppkey").alias("advisory"), "name", "ecosystem", F.concat(line, F.lit(".5.0")).alias("introduced"), F.lit(None).cast("string").alias("fixed"), F.concat(line + 2, F.lit(".3.9")).alias("last_affected"))
    return packages.audit_packages(fx(spark, root, "packages"), a).select("occurrence_id", "advisory")


def _written_folder(spark, root) -> str:
    """A folder in the shared one with a file for each document, written in tasks."""
    base = new_dir(spark, "folder").removeprefix("file:")

    def write(batches):
        for pdf in batches:
            for path, text in zip(pdf["file_path"], pdf["content"], strict=True):
                fs, where = pafs.FileSystem.from_uri(f"{base}/{path}")
                fs.create_dir(where.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(where) as f:
                    f.write((text or "").encode())
            yield pdf[["file_path"]]

    fx(spark, root, "files").select("file_path", "content").mapInPandas(write, "file_path string").write.format("noop").mode("overwrite").save()
    return base


@query("folder_source", "files", "SELECT file_path, CAST(strlen(coalesce(content, '')) AS BIGINT) AS byte_size, sha256(coalesce(content, '')) AS content_hash, language FROM fx_files WHERE file_path LIKE '%.py'")
def folder_source(spark, root):
    """Documents written as files and read back by the data source, which opens files of one kind only."""
    files = folder.read_folder(spark, _written_folder(spark, root)).filter(F.col("file_path").endswith(".py"))
    return files.select("file_path", "byte_size", F.sha2("content", 256).alias("content_hash"), "language")
