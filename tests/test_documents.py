import json

from tessera import registry
from tessera.operators import detect, findings, graph
from tessera.operators import text as T
from tessera.plans.fixtures import fx
from tessera.sources import corpus

SF = "/root/testdata/sf0.001"


def test_sarif_documents_hold_the_active_findings_of_each_scan(spark):
    rows = [r.asDict() for r in fx(spark, SF, "findings").collect()]
    got = {r["scan_id"]: json.loads(r["sarif"]) for r in registry.queries()["sarif_documents"](spark, SF).collect()}
    live = [r for r in rows if r["status"] not in ("dismissed", "false_positive", "fixed")]
    assert set(got) == {r["scan_id"] for r in live}
    level = {"critical": "error", "high": "error", "medium": "warning", "low": "note"}
    for scan, doc in got.items():
        run = doc["runs"][0]
        mine = sorted((r["finding_id"], r["cwe_id"], level[r["severity"]], r["file_path"], r["line_start"]) for r in live if r["scan_id"] == scan)
        said = sorted((x["finding_id"], x["ruleId"], x["level"], *(p := x["locations"][0]["physicalLocation"])["artifactLocation"].values(), p["region"]["startLine"]) for x in run["results"])
        assert said == mine and doc["version"] == "2.1.0"
        assert {x["id"] for x in run["tool"]["driver"]["rules"]} == {r[1] for r in mine}


def test_scan_reports_hold_counts_buckets_and_score(spark):
    f = fx(spark, SF, "findings")
    score = {r["scan_id"]: r["score"] for r in findings.security_score(f).collect()}
    rows = [r.asDict() for r in f.collect()]
    for r in registry.queries()["scan_reports"](spark, SF).collect():
        doc = json.loads(r["report"])
        mine = [x for x in rows if x["scan_id"] == r["scan_id"]]
        assert doc["total"] == len(mine) and doc["score"] == score[r["scan_id"]]
        for s in ("critical", "high", "medium", "low"):
            assert doc[s] == sum(x["severity"] == s for x in mine)
        shown = sorted(i for b in doc.get("buckets") or [] for i in b["finding_ids"])
        assert shown == sorted(x["finding_id"] for x in mine if x["status"] not in ("dismissed", "false_positive"))


def test_taint_findings_have_the_severity_of_their_sink(spark):
    flows = detect.taint_flows(spark.createDataFrame([("r", "a.py", "python", "a = input()\nos.system(a)\ncursor.execute(a)")], "repo_id string, file_path string, language string, content string"))
    got = {(r["rule_id"], r["line_start"], r["severity"], r["cwe_id"]) for r in detect.taint_findings(flows).collect()}
    assert {(a, b) for a, b, *_ in got} == {("taint-command", 2), ("taint-sql", 3)} and all(s in ("critical", "high") and c.startswith("CWE-") for *_, s, c in got)


def test_stream_of_secrets_equals_the_batch(spark):
    batch = registry.queries()["secrets"](spark, "/root/testdata/sf0.01")
    names = [c for c in ("file_path", "line_start", "fingerprint") if c in batch.columns]
    got = registry.queries()["stream_secrets"](spark, "/root/testdata/sf0.01").select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch.select(*names).collect())) and got


def test_snapshots_and_findings_are_written_and_read(spark, tmp_path):
    files = spark.createDataFrame([("r", 1, "a.py", "x\ny\n"), ("r", 2, "a.py", "z"), ("q", 1, "a.py", None)], "repo_id string, scan_id int, file_path string, content string")
    for part in (1, 2):
        corpus.write_snapshots(files.filter(f"scan_id = {part}"), str(tmp_path / "s"))
    kept = spark.read.parquet(str(tmp_path / "s"))
    got = corpus.snapshot_at(kept.filter("repo_id = 'r'"), 1, "a.py").collect()
    assert [(r["line_count"], r["byte_size"], r["content"]) for r in got] == [(2, 4, "x\ny\n")]
    assert corpus.snapshot_at(kept, 3, "a.py").count() == 0 and kept.count() == 3
    f = spark.createDataFrame([("1", ["u"]), ("2", []), ("3", None)], "finding_id string, references array<string>")
    corpus.append_findings(f.filter("finding_id < '2'"), str(tmp_path / "f"))
    corpus.append_findings(f.filter("finding_id >= '2'"), str(tmp_path / "f"))
    assert sorted((r["finding_id"], r["references"]) for r in spark.read.parquet(str(tmp_path / "f")).collect()) == [("1", ["u"]), ("2", None), ("3", None)]


def test_small_readers(spark):
    symbols = spark.createDataFrame([("r", "a", "f", 2), ("r", "a", "e", 1), ("r", "b", "g", 1), ("q", "a", "h", 1)], "repo_id string, file_path string, name string, line_no int")
    assert [r["name"] for r in graph.symbols_in_file(symbols.filter("repo_id = 'r'"), "a").collect()] == ["e", "f"]
    assert {r["repo_id"]: r["n"] for r in graph.symbol_count(symbols).collect()} == {"r": 3, "q": 1}
    edges = spark.createDataFrame([("r", "a", "x"), ("r", "a", "y"), ("r", "b", "x")], "repo_id string, file_path string, target string")
    assert {r["target"] for r in graph.dependencies(edges, "a").collect()} == {"x", "y"}
    e = spark.createDataFrame([("2", 1, 5), ("1", 2, 4), ("1", 1, 6)], "finding_id string, created_at int, event_id int")
    assert [r["event_id"] for r in findings.timeline(e).collect()] == [6, 4, 5]
    body = spark.createDataFrame([("r", "f.txt", "é" * 8000), ("r", "g.txt", "short")], "repo_id string, file_path string, content string")
    cut = graph.read_file(body, "f.txt").first()["content"]
    assert cut == "é" * 7500 + "\n... (cut)" and graph.read_file(body, "g.txt").first()["content"] == "short"
    assert T.with_language(body).select("language").distinct().collect()[0][0] is None
