import datetime
import json
import os
import pathlib

from pyspark.sql import functions as F

from tessera import registry, registry_more
from tessera.operators import findings, graph
from tessera.operators.text import lines_of
from tessera.plans import fixtures, scratch
from tessera.sources import corpus
from tessera.streaming import streams


def at(minute):
    return datetime.datetime(2024, 1, 1, 0, minute)


FINDING = "finding_id string, status string, severity string, confidence string, description string"


def test_validation_keeps_stored_results_and_takes_the_newest(spark):
    f = spark.createDataFrame([("1", False, '{"old":1}'), ("2", True, '{"old":2}'), ("3", None, None)], "finding_id string, poc_validated boolean, poc_result string")
    results = spark.createDataFrame([("1", "failed", 1, "x", at(1)), ("1", "confirmed", 0, "y", at(2)), ("1", "failed", 2, "z", at(0)), ("9", "confirmed", 0, "", at(0))], "finding_id string, verdict string, exit_code int, output string, created_at timestamp")
    want = [("1", True, '{"verdict":"confirmed","exit_code":0,"output":"y"}'), ("2", True, '{"old":2}'), ("3", None, None)]
    assert sorted(tuple(r) for r in findings.apply_validation(f, results).select("finding_id", "poc_validated", "poc_result").collect()) == want
    tied = findings.apply_validation(f.drop("poc_result"), results.drop("created_at")).orderBy("finding_id").collect()
    assert [r["poc_validated"] for r in tied] == [False, True, None] and "z" in tied[0]["poc_result"]


def test_the_newest_verdict_counts_however_rows_are_dealt(spark):
    f = spark.createDataFrame([("1", "open", "low", "medium", "d")], FINDING)
    rows = [("1", json.dumps({"verdict": v}), at(m)) for v, m in (("confirmed", 1), ("false_positive", 3), ("plausible", 2))]
    verdicts = spark.createDataFrame(rows, "finding_id string, verdict string, created_at timestamp")
    for parts in (1, 3):
        assert [r["outcome"] for r in findings.apply_verdicts(f, verdicts.repartition(parts)).collect()] == ["false_positive"]
        assert [r["outcome"] for r in findings.apply_verdicts(f, verdicts.drop("created_at").repartition(parts)).collect()] == ["plausible"]


def test_findings_without_fingerprint_are_all_new(spark):
    schema = "finding_id string, fingerprint string, file_path string, line_start int"
    old = spark.createDataFrame([("0", "a", "f", 1), ("00", None, "f", 1)], schema)
    new = spark.createDataFrame([("1", "a", "f", 1), ("2", None, "f", 1), ("3", None, "f", 1), ("4", "b", "g", 2), ("5", "b", "f", 3)], schema)
    assert sorted(r["finding_id"] for r in findings.merge_new(old, new).collect()) == ["2", "3", "4"]


def test_feed_of_every_event_type(spark):
    meta = json.dumps
    rows = [
        ("status_change", "open", "false_positive", None, None, "Status updated", "Triage moved from Open to False Positive.", "warning"),
        ("status_change", None, "fixed", None, None, "Status updated", "Triage moved to Fixed.", "success"),
        ("status_change", "open", None, "why", None, "Status updated", "why", "active"),
        ("status_change", None, None, None, "no json", "Status updated", "The finding status was updated.", "active"),
        ("status_change", None, "dismissed", None, None, "Status updated", "Triage moved to Dismissed.", "neutral"),
        ("ai_explanation", None, None, "c", meta({"summary": "s"}), "AI explanation generated", "s", "active"),
        ("ai_explanation", None, None, "c", meta({"summary": 5}), "AI explanation generated", "c", "active"),
        ("ai_verification", None, None, None, meta({"verdict": "false_positive_likely", "rationale": "r"}), "AI verification: False Positive Likely", "r", "warning"),
        ("ai_verification", None, None, None, None, "AI verification: Needs Review", "A second-pass verification review was recorded.", "active"),
        ("ai_verification", None, None, None, meta({"verdict": "confirmed"}), "AI verification: Confirmed", "A second-pass verification review was recorded.", "success"),
        ("issue_linked", None, None, None, meta({"provider": "github", "external_issue_number": "7", "created": True}), "Repository issue linked", "GITHUB issue #7 was created for this finding.", "success"),
        ("issue_linked", None, None, None, meta({"provider": "github", "external_issue_number": "7", "created": "true"}), "Repository issue linked", "Linked to existing GITHUB issue #7 for this finding.", "success"),
        ("issue_linked", None, None, None, meta({"provider": "github", "external_issue_number": 7}), "Repository issue linked", "Repository issue linkage changed.", "success"),
        ("remediation_started", None, None, None, meta({"branch": "b", "model": "m"}), "Fix PR agent started", "Generating a fix branch `b` with `m`.", "active"),
        ("remediation_started", None, None, "c", meta({"branch": "b"}), "Fix PR agent started", "c", "active"),
        ("remediation_pr_opened", None, None, "c", meta({"pr_url": "u"}), "Fix PR opened", "Draft pull request opened: u", "success"),
        ("remediation_failed", None, None, None, meta({"error": "e"}), "Fix PR agent failed", "e", "warning"),
        ("remediation_failed", None, None, None, "[1]", "Fix PR agent failed", "Fix PR generation failed before a pull request was opened.", "warning"),
        ("some_odd__type", "o", "n", None, None, "Some Odd Type", "n", "neutral"),
        ("x", None, None, None, None, "X", "Review activity was recorded.", "neutral"),
    ]
    df = spark.createDataFrame([(k, *r[:5]) for k, r in enumerate(rows)], "k int, event_type string, old_value string, new_value string, comment string, metadata string")
    got = findings.activity_feed(df).orderBy("k").select("feed_title", "detail", "tone").collect()
    assert [tuple(r) for r in got] == [r[5:] for r in rows]
    bare = findings.activity_feed(df.select("event_type").filter("event_type = 'x'")).first()
    assert bare["detail"] == "Review activity was recorded."


def test_lines_end_at_breaks_only(spark):
    texts = {"x\r": ["x\r"], "a\r\nb\r\n": ["a", "b"], "a\r\r\nb\r": ["a\r", "b\r"], "\n": [""], "\r\n\r\n": ["", ""], "": [], "a\n\n": ["a", ""]}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["x"] for r in df.select("t", lines_of(F.col("t")).alias("x")).collect()} == texts


def test_links_are_not_followed(spark, tmp_path):
    (tmp_path / "outside.py").write_text("secret = 1")
    root = tmp_path / "root"
    (root / "a").mkdir(parents=True)
    (root / "a" / "x.py").write_text("x = 1")
    os.symlink(tmp_path / "outside.py", root / "ln.py")
    os.symlink(root, root / "a" / "loop")
    os.symlink(root / "gone", root / "broken.py")
    assert [r["file_path"] for r in corpus.read_corpus(spark, str(root), "r").collect()] == ["a/x.py"]


def test_edges_of_files_without_a_repository(spark):
    symbols = spark.createDataFrame([(r, p, n, "function", k) for r, p in ((None, "a"), (None, None), ("r", "a")) for k, n in enumerate("fg")], "repo_id string, file_path string, name string, kind string, line_no int")
    calls = spark.createDataFrame([(None, "a", "g"), (None, None, "f"), ("r", "b", "g")], "repo_id string, file_path string, name string")
    assert {tuple(r)[:4] for r in graph.call_edges(symbols, calls).collect()} == {(None, "a", "f", "g"), (None, None, "g", "f")}


def test_snapshot_of_scans_without_and_with_many_events(spark):
    scans = spark.createDataFrame([(1, "hunting", at(50)), (2, "completed", at(51)), (3, None, None)], "scan_id long, status string, updated_at timestamp")
    none = spark.createDataFrame([], "scan_id long, severity string")
    rows = [(1, k, "hunt", "running" if k == 5 else "completed", at(k % 60), "progress", f"t{k}", None, k) for k in range(200)] + [(2, 1, "vidarr", None, at(1), "scan_failed", "x", "d", None)]
    events = spark.createDataFrame(rows, "scan_id long, event_id long, stage string, status string, created_at timestamp, event_type string, title string, detail string, progress_pct int")
    df = findings.scan_snapshot(scans, none, events)
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()
    one, two, three = df.orderBy("scan_id").collect()
    assert [e["event_id"] for e in one["activity"]] == sorted(range(200), key=lambda k: (k % 60, k), reverse=True)[:80] and one["is_live"] and one["counts"]["total"] == 0
    assert one["current_task"]["title"] == f"t{one['activity'][0]['event_id']}"  # the running one is older than the newest eighty
    assert (two["activity"][0]["tone"], two["is_live"], two["status_label"]) == ("error", False, "Completed")
    assert [s["label"] for s in two["stages"]][6] == "Víðarr" and [s["status"] for s in two["stages"]] == ["pending"] * 9
    assert (three["current_task"]["title"], three["activity"], three["is_live"]) == ("Waiting for activity", None, True)


def test_rendered_findings_have_window_and_references(spark):
    lines = "\n".join(f"line {k}" for k in range(1, 60)) + "\n" + "x" * 300
    rows = [("1", "[CWE-89] bad", None, "high", "high", 30, lines, '["https://a", 5, {"b": 1}, null]'), ("2", "t", "CWE-79", "low", "?", 5, "", "{}"), ("3", "t", None, "low", "low", None, None, "no json"), ("4", "t", None, "low", "medium", 99, "only", None)]
    f = spark.createDataFrame(rows, "finding_id string, title string, cwe_id string, severity string, confidence string, line_start int, code_snippet string, references_json string")
    none = spark.createDataFrame([], "finding_id string, patch_id string, created_at timestamp, patch string")
    one, two, three, four = findings.render_findings(f, none).orderBy("finding_id").collect()
    assert (one["clean_title"], one["cwe"], one["confidence_pct"], one["reference_urls"][0]) == ("bad", "CWE-89", 95, "https://a")
    w = one["snippet_window"]
    assert [x["number"] for x in w["lines"]] == list(range(18, 49)) and w["truncated"] and w["original_line_count"] == 60
    assert two["snippet_window"] is None and two["reference_urls"] == [] and two["confidence_pct"] == 75
    assert three["snippet_window"] is None and three["reference_urls"] == [] and four["snippet_window"]["lines"][0]["text"] == "only"


def test_issue_bodies_say_what_there_is(spark):
    rows = [("1", "s", "t", "high", "medium", "a.py", 3, 4, "CWE-1", "CVE-2", " why \n", "é" * 700, "+x", ["u"], "fp"), ("2", "s", "t", "low", "low", "b.py", 9, None, None, None, None, None, None, None, None)]
    schema = "finding_id string, scan_id string, title string, severity string, confidence string, file_path string, line_start int, line_end int, cwe_id string, cve_id string, description string, code_snippet string, suggested_patch string, reference_urls array<string>, fingerprint string"
    f = spark.createDataFrame(rows, schema).withColumns({"status": F.lit("open"), "created_at": F.lit(at(0))})
    one, two = findings.issue_bodies(f).orderBy("finding_id").collect()
    assert one["issue_title"] == "[HIGH] t" and two["issue_body"] == "## Finding\n\n- Severity: `low`\n- Confidence: `low`\n- Location: `b.py`:9"
    want = "## Finding\n\n- Severity: `high`\n- Confidence: `medium`\n- Fingerprint: `fp`\n- Location: `a.py`:3-4\n- CWE: `CWE-1`\n- CVE: `CVE-2`\n\n### Summary\n\nwhy\n\n### Evidence\n\n```text\n"
    assert one["issue_body"] == want + "é" * 600 + "...\n```\n\n### Suggested Patch\n\n```diff\n+x\n```\n\n### References\n\n- u"
    body = findings.issue_texts(f).first()["body"]
    assert body.startswith("## Grouped Finding\n\n- Rule: **t**\n- Severity: `high`\n- Locations: **2**\n- CWE: `CWE-1`\n\n### Summary\n\nwhy\n\n### Affected Locations\n")
    assert "| `a.py` | 3-4 | medium |\n| `b.py` | 9 | low |\n\n### Example Evidence" in body and body.endswith("### References\n\n- u")


def test_joined_tables_are_dealt_by_their_size(spark, monkeypatch):
    """Of large tables a task's share stays the same: partitions of the join, and of groups by its key, grow with the files."""
    root = "/root/testdata/sf0.01"
    want = {tuple(r) for r in registry.queries()["group_by_rule"](spark, root).collect()}
    monkeypatch.setattr(fixtures, "PART_BYTES", 1 << 17)
    got = registry.queries()["group_by_rule"](spark, root)
    assert got.rdd.getNumPartitions() == -(-os.path.getsize(f"{root}/lineitem.parquet") // (1 << 17)) > 4
    assert {tuple(r) for r in got.collect()} == want


def test_landed_files_grow_in_number_with_the_input(spark):
    rows = spark.range(0, 900, 1, 9).toDF("scan_id").selectExpr("scan_id", "'high' AS severity")
    assert registry_more.streamed(spark, rows, streams.live_counts, "complete").count() == 900
    landed = max((p for p in pathlib.Path(scratch.shared_dir(spark).removeprefix("file:")).rglob("landing-*")), key=lambda p: p.stat().st_mtime)
    assert len(list(landed.glob("*.parquet"))) == 9
