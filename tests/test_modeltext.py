import pytest
from pyspark.sql import functions as F

from tessera import registry_more
from tessera.operators import findings
from tessera.operators import modeltext as M
from tessera.plans import fixtures

FENCE = "```"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"a": 1}', '{"a": 1}'), (f'{FENCE}json\n{{"a": 1}}\n{FENCE}', '{"a": 1}'), (f'{FENCE}\n[1, 2]\n{FENCE}', "[1, 2]"), ('Sure: {"a": {"b": "}"}} and {"c": 2}', '{"a": {"b": "}"}}'),
        ('} {"q": "a \\" { b"} tail', '{"q": "a \\" { b"}'), ("no object", None), ("{broken", None), (None, None), ("", None), ("x {not: json", None),
    ],
)
def test_json_in_text(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(M.extract_json(F.col("t")).alias("j")).first()["j"] == want


def diff(path, start, old, new):
    return "\n".join([f"--- a/{path}", f"+++ b/{path}", f"@@ -{start},{len(old)} +{start},{len(new)} @@", *(f"-{x}" for x in old), *(f"+{x}" for x in new), ""])


def test_patches_are_held_against_their_file(spark):
    body = "let port = 1;\r\nlet host = 2;\nsave(host);\nload(port);\n"
    files = spark.createDataFrame([("r", "web/app.js", body), ("r", "web/app.js", body), (None, "n.js", "x")], "repo_id string, file_path string, content string")
    f = spark.createDataFrame([("near", "r", "web/app.js", 1, 2), ("far", "r", "web/app.js", 4, 4), ("gone", "r", "lost.js", 1, 1), ("late", "r", "web/app.js", 40, 41)], "finding_id string, repo_id string, file_path string, line_start int, line_end int")
    good = diff("web/app.js", 1, ["let port = 1;", "let host = 2;"], ["let port = env.PORT;"])
    cases = [
        ("near", good, True), ("far", good, False), ("late", good, False), ("gone", good, False), ("none", good, False), ("near", None, False), ("near", "", False), ("near", "fix the port", False),
        ("near", diff("web/app.js", 1, ["let secret = 9;"], ["x"]), False), ("near", diff("other.js", 1, ["let port = 1;"], ["x"]), False), ("near", diff("web/app.js", 9, ["let port = 1;"], ["x"]), False),
        ("near", good + "@@ -3,1 +3,1 @@\n-never();\n+x\n", False), ("near", good + "@@ -3 +3 @@\n save(host);\n", True), ("near", good.replace("@@ -1,2", "@@ oops"), False),
    ]
    got = M.validate_patches(spark.createDataFrame([(i, k, p) for i, (k, p, _) in enumerate(cases)], "n int, finding_id string, patch string"), f, files).orderBy("n").collect()
    assert [r["grounded"] for r in got] == [w for *_, w in cases]


def test_threat_models_get_one_shape(spark):
    text = """Here it is: {"risks": ["stolen keys", {"title": "forged id", "detail": "d", "severity": "Very High", "probability": "LOW", "damage": "?", "stride": ["S", "info disclosure", "spoofing", "odd", "Privilege escalation"], "decision": "Avoid"},
      {"categories": "dos", "scenario": "flood", "surface": 7}], "threats": "later", "attack_surfaces": [{"concern": "login", "location": "./src/login.py", "line_number": "12", "risk": "critical!"}, "bare"],
      "dataflows": [{"from": "Parser", "to": "Sink", "kind": "keys"}, {}], "trust_boundaries": [{"origin": "web", "trust_to": "core"}]}"""
    models = spark.createDataFrame([(1, text), (2, "none"), (3, None), (4, "[1]")], "model_id int, model string")
    got = M.model_items(models, "threats").orderBy("position").collect()
    assert [(r["name"], r["description"], r["risk_level"], r["likelihood"], r["impact"], r["risk_treatment"], r["related_surface"]) for r in got] == [
        ("stolen keys", "stolen keys", "medium", "medium", "medium", "mitigate", None), ("forged id", "d", "high", "low", "medium", "eliminate", None), ("flood", "flood", "medium", "medium", "medium", "mitigate", "7"),
    ]
    assert [r["stride"] for r in got] == [[], ["spoofing", "information_disclosure", "elevation_of_privilege"], ["denial_of_service"]]
    assert [(r["name"], r["file"], r["line"], r["risk_level"]) for r in M.model_items(models, "surfaces").orderBy("position").collect()] == [("login", "./src/login.py", 12, "critical"), ("bare", None, None, "medium")]
    assert [(r["name"], r["description"]) for r in M.model_items(models, "data_flows").orderBy("position").collect()] == [("keys", "Parser -> Sink"), ("unknown -> unknown", "unknown -> unknown")]
    assert [(r["name"], r["from_zone"]) for r in M.model_items(models, "boundaries").collect()] == [("web -> core", "web")]


def test_other_parts_of_threat_models(spark):
    text = """{"overview": ["pays", 2, {"no": 1}, " "], "system_scope": {"application": "shop", "included": ["web", null, " api "], "excluded": "mail", "assets": null, "inputs": {"a": 1}},
      "assumptions": [" tls ", {"title": ["a", "b"], "impact": "", "risk": "leak", "files": ["x.py", 3]}], "countermeasures": ["rotate", {"risk": "theft", "recommendation": "mask", "treatment": "Watch", "state": "Implemented", "team": "core"}],
      "verification": [{"threat": "theft", "test": "fuzz", "tool": "ci", "status": "needs-validation"}, "scan"], "security_claims": [{"statement": "sealed", "level": "LOW", "supporting_evidence": "audit", "open_questions": []}, {}],
      "threats": [{"title": "t", "references": "a.py", "mitre": [{"phase": "access", "id": "T1", "confidence": "High"}, "impact"]}, {"title": "u", "attck": "[odd", "mitre": null}, {"title": "v", "attack": {"name": "n"}}]}"""
    models = spark.createDataFrame([(1, text), (2, '{"scope": " all "}'), (3, '{"scope": null}'), (4, "none"), (5, None)], "model_id int, model string")
    heads = [tuple(r) for r in M.model_heads(models).orderBy("model_id").collect()]
    assert heads == [(1, "pays, 2", "shop", "unknown", ["web", "api"], ["mail"], [], []), (2, M.NO_SUMMARY, "all", "unknown", [], [], [], []), (3, M.NO_SUMMARY, None, None, [], [], [], [])]
    items = lambda part: [r.asDict(recursive=True) for r in M.model_items(models, part).orderBy("position").collect()]
    first, second = items("assumptions")
    assert (first["statement"], first["why_it_matters"], first["evidence"]) == ("tls", M.DEFAULTS["assumptions"]["why_it_matters"], [])
    assert (second["statement"], second["why_it_matters"], second["evidence"]) == ("a, b", "leak", ["x.py", "3"])
    assert [(r["threat"], r["action"], r["risk_treatment"], r["status"], r["owner"]) for r in items("mitigations")] == [("Unspecified threat", "rotate", "mitigate", "proposed", None), ("theft", "mask", "monitor", "existing", "core")]
    assert [(r["target"], r["method"], r["automation"], r["status"]) for r in items("validation_plan")] == [("theft", "fuzz", "ci", "needs_validation"), ("scan", "scan", "manual", "proposed")]
    assert [(r["claim"], r["confidence"], r["evidence"], r["gaps"]) for r in items("assurance_claims")] == [("sealed", "low", ["audit"], []), ("Unspecified assurance claim", "medium", [], [])]
    t, u, v = items("threats")
    assert t["evidence"] == ["a.py"] and [(a["tactic"], a["technique_id"], a["confidence"]) for a in t["mitre_attack"]] == [("access", "T1", "high"), ("impact", None, "low")]
    assert u["mitre_attack"] == [] and [(a["tactic"], a["technique"], a["confidence"]) for a in v["mitre_attack"]] == [("unknown", "n", "medium")]


def test_threat_models_are_grounded(spark):
    files = spark.createDataFrame([("r", "src/auth/login.py"), ("r", "run"), ("q", "src/pay.py")], "repo_id string, file_path string")
    names = ["src/auth/login.py", "./login.py", "/src/auth/login.py", "ogin.py", "n", "pay.py", "src/login.py", None, ""]
    s = spark.createDataFrame([("r", n, i) for i, n in enumerate(names)], "repo_id string, file string, k int")
    assert sorted(r["k"] for r in M.ground_surfaces(s, files).collect()) == [0, 1, 2, 3, 4, 7, 8]
    ends = [("Web User", "x"), ("x", "login.py here"), ("pay.py", "y"), ("zed", "odd"), ("to run it", "q"), ("zed", "odd")]
    flows = spark.createDataFrame([("r", a, b, i) for i, (a, b) in enumerate(ends)], "repo_id string, source string, sink string, k int")
    assert sorted(r["k"] for r in M.ground_flows(flows, files).collect()) == [0, 1, 4]


def test_fenced_verdicts_are_read(spark):
    f = spark.createDataFrame([("1", "open", "high", "low", "d")], "finding_id string, status string, severity string, confidence string, description string")
    v = spark.createDataFrame([("1", f'{FENCE}json\n{{"verdict": "confirmed", "severity": "critical", "reasoning": "r"}}\n{FENCE}')], "finding_id string, verdict string")
    r = findings.apply_verdicts(f, v).first()
    assert (r["severity"], r["confidence"], r["outcome"]) == ("critical", "high", "confirmed")


def test_pieces_of_flows_are_shuffled_only_where_a_name_begins_so(spark):
    files = spark.createDataFrame([("r", "a/zq"), ("r", "a/main.py"), ("s", "b/Ünï.py"), (None, "n.js")], "repo_id string, file_path string")
    flows = [(0, "r", "See main.py" + " x" * 500, "y"), (1, "r", "yzq", "y"), (2, "r", "b/Ünï.py", "y"), (3, "s", "b/ünï.py Ü", "y"), (4, None, "y", "in n.js"), (5, "r", None, "zq"), (6, "r", "y", "a database"), (7, "r", "See main.py" + " x" * 500, "y")]
    got = M.ground_flows(spark.createDataFrame(flows, "k int, repo_id string, source string, sink string"), files)
    assert sorted(r["k"] for r in got.collect()) == [0, 1, 4, 6, 7]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "slot" in plan and "array_distinct" not in plan


def test_several_parts_are_read_from_one_parse_without_a_join(spark):
    text = 'So: {"assumptions": ["a", "b"], "validation": [{"threat": "t"}], "threats": [{"title": "x"}]}'
    models = spark.createDataFrame([(1, text), (2, '{"assumptions": ["c"]}'), (3, "null"), (4, "nothing"), (5, "﻿{}"), (6, "tried"), (7, '{"assumptions": ["d"], "assumptions": ["e"]}')], "model_id int, model string")
    rows = M.model_items(models, "assumptions", keep_model=True)
    assert sorted((r["model_id"], r["position"], r["statement"]) for r in rows.collect()) == [(1, 1, "a"), (1, 2, "b"), (2, 1, "c")]
    both = M.model_items(rows.select("model_id", "m", "statement"), "validation_plan", keep=("statement",))
    assert sorted((r["model_id"], r["statement"], r["target"]) for r in both.collect()) == [(1, "a", "t"), (1, "b", "t")]
    assert "Join" not in both._jdf.queryExecution().optimizedPlan().toString()


def test_prose_is_not_parsed_as_json(spark):
    texts = ["no verdict", "I think {\"a\": 1} so", "NaN", "Infinity", "true", " null ", "-1.5", '"s"', "trueish", "-x", "[1", "﻿1"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").withColumn("plain", F.when(F.try_parse_json(F.btrim("t", F.lit(M.BLANKS))).isNotNull(), F.btrim("t", F.lit(M.BLANKS))))
    rows = M.with_json(df, "t", "j").withColumn("same", F.col("j").eqNullSafe(M.extract_json(F.col("t")))).collect()
    assert all(r["same"] for r in rows)
    assert [r["j"] for r in sorted(rows, key=lambda r: r["k"])] == [r["plain"] if r["plain"] is not None or "{" not in r["t"] else '{"a": 1}' for r in sorted(rows, key=lambda r: r["k"])]


def test_paths_meet_surfaces_under_ends_of_lengths_that_occur_only(spark):
    files = spark.createDataFrame([("r", "src/auth/login.py"), ("r", "src/auth/login.py"), ("r", "run"), (None, "a/Üb.py")], "repo_id string, file_path string")
    long = [("r", "auth/login.py"), ("r", "./login.py"), ("r", "x/login.py"), ("q", "login.py"), (None, "//./login.py"), ("r", None), ("r", "/")]
    short = [("r", "n"), ("r", "./run"), ("r", "un.py"), (None, "b.py"), (None, "Üb.py"), ("r", "brun"), (None, "n")]
    named = lambda rows: spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], "repo_id string, file string, k int")
    got = M.ground_surfaces(named(long), files)
    assert got.columns == ["repo_id", "file", "k"] and sorted(r["k"] for r in got.collect()) == [0, 1, 5, 6]
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["k"] for r in M.ground_surfaces(named(long + short), files).collect()) == [0, 1, 5, 6, 7, 8, 10, 11]
    assert sorted(r["k"] for r in M.ground_surfaces(named(long).filter("file IS NULL"), files).collect()) == [5]
    assert M.ground_surfaces(named(long).limit(0), files).count() == 0


def test_findings_that_are_dealt_by_key_are_not_shuffled_again_for_models(spark, sf, monkeypatch):
    plan = lambda: registry_more._spread(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan().count("RepartitionByExpression") == 1
    rows = registry_more._spread(spark, sf).count()
    monkeypatch.setattr(fixtures, "PART_BYTES", 10_000)
    assert plan().count("RepartitionByExpression") == 2 and "RepartitionByExpression [finding_id" not in plan()
    assert registry_more._spread(spark, sf).count() == rows
