"""Work on the findings table: filters, order, pages, roll-ups, scores, groups, and changes of state.

Every function takes and returns DataFrames. Ties are broken by the finding's id, so results do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.columns import (
    SEVERITIES, clean_title, confidence_percent, confidence_rank, cwe_of, group_fingerprint, looks_like_prose, normalize_remote_url, owasp_code, sarif_level, security_severity, severity_label, severity_rank, slugify, status_rank,
)
from tessera.operators.modeltext import with_json
from tessera.operators.text import lines_of, window_snippet

#: Greatest loss and half-way weight of each severity, weight of each confidence, factor of a validated finding.
LOSS = {"critical": (35.0, 2.0), "high": (30.0, 5.0), "medium": (18.0, 8.0), "low": (8.0, 20.0)}
WEIGHT = {"high": 1.0, "medium": 0.7, "low": 0.4}
OTHER_WEIGHT, VALIDATED = 0.7, 1.3
#: Statuses that are left out, by use.
INACTIVE = {"score": ("dismissed", "false_positive", "fixed"), "sarif": ("dismissed", "false_positive", "fixed"), "report": ("dismissed", "false_positive")}


def filter_findings(df: DataFrame, severity: str | None = None, status: str | None = None) -> DataFrame:
    if severity is not None:
        df = df.filter(F.col("severity") == severity)
    return df if status is None else df.filter(F.col("status") == status)


def visible_to(df: DataFrame, repos: DataFrame, user_id) -> DataFrame:
    """Rows of repositories that the user owns and that aren't deleted."""
    return df.join(repos.filter((F.col("user_id") == user_id) & ~F.col("deleted")).select("repo_id"), "repo_id", "left_semi")


def active(df: DataFrame, mode: str) -> DataFrame:
    return df.filter(~F.coalesce(F.col("status"), F.lit("")).isin(*INACTIVE[mode]))


def issue_candidates(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """Findings at the repository's least severity or above that are validated or of high confidence."""
    limits = repos.select("repo_id", F.col("min_severity"))
    found = findings.join(limits, "repo_id").filter(severity_rank(F.col("severity")) >= severity_rank(F.col("min_severity")))
    return found.filter(F.coalesce("poc_validated", F.lit(False)) | (F.col("confidence") == "high")).drop("min_severity")


def search_repos(repos: DataFrame, query: str, columns: tuple[str, ...] = ("full_name", "description", "language")) -> DataFrame:
    q = query.lower()
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.lower(c).contains(q), F.lit(False))
    return repos.filter(found)


def triage_columns() -> list[Column]:
    return [status_rank(F.col("status")), severity_rank(F.col("severity")).desc(), F.col("created_at").desc(), F.col("finding_id")]


def paginate(df: DataFrame, order: list[Column], page: int = 1, per_page: int = 25, most: int = 100) -> DataFrame:
    """One page with ``position``, ``total`` and ``total_pages`` (1 when empty). The rows up to the page's end are all that is sorted."""
    page, per_page = max(1, page), min(most, max(1, per_page))
    first = (page - 1) * per_page
    total = df.agg(F.count("*").alias("total")).withColumn("total_pages", F.greatest(F.lit(1), F.ceil(F.col("total") / per_page)).cast("long"))
    rows = df.orderBy(*order).limit(first + per_page).offset(first)
    rows = rows.withColumn("position", F.row_number().over(Window.orderBy(*order)) + first)  # one page
    return rows.crossJoin(F.broadcast(total))  # one row of totals


def count_findings(df: DataFrame, severity: str | None = None, status: str | None = None) -> DataFrame:
    return filter_findings(df, severity, status).agg(F.count("*").alias("n"))


def scan_rollup(findings: DataFrame, scans: DataFrame) -> DataFrame:
    """Total and count of each severity of every scan; zeros for a scan without findings."""
    sums = findings.groupBy("scan_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    return scans.select("scan_id").join(sums, "scan_id", "left").na.fill(0, ["total", *SEVERITIES])


def owner_counts(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """Open and open critical findings of each user over repositories that aren't deleted; zeros for users without any."""
    is_open = findings.filter("status = 'open'").groupBy("repo_id").agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "critical").alias("c"))
    found = repos.filter("NOT deleted").join(is_open, "repo_id", "left")
    return found.groupBy("user_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("open_findings"), F.coalesce(F.sum("c"), F.lit(0)).alias("open_critical"))


def recent_scans(scans: DataFrame, repos: DataFrame, n: int = 6) -> DataFrame:
    """The newest ``n`` scans of each user: ``user_id, position, scan_id, status, created_at``."""
    w = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), F.col("scan_id").desc())
    found = scans.join(repos.filter("NOT deleted").select("repo_id", "user_id"), "repo_id")
    found = found.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)
    return found.select("user_id", "position", "scan_id", "status", "created_at")


def repo_cards(repos: DataFrame, scans: DataFrame) -> DataFrame:
    """Each repository with its number of scans and its newest one."""
    last = scans.groupBy("repo_id").agg(
        F.count("*").alias("scan_count"), F.max(F.struct("created_at", "scan_id", "status")).alias("last")
    )
    return repos.filter("NOT deleted").join(last, "repo_id", "left").select(
        "repo_id", "user_id", "name", F.coalesce("scan_count", F.lit(0)).alias("scan_count"), F.col("last.scan_id").alias("last_scan_id"),
        F.col("last.status").alias("last_status"), F.col("last.created_at").alias("last_scan_at"),
    )


def security_score(findings: DataFrame, by: tuple[str, ...] = ("scan_id",)) -> DataFrame:
    """Score from 0 to 100 and the loss by severity. The loss of a severity is its greatest one times ``w / (w + half)`` of its weight ``w``."""
    weight = F.lit(OTHER_WEIGHT)
    for c, w in WEIGHT.items():
        weight = F.when(F.lower("confidence") == c, w).otherwise(weight)
    weight = weight * F.when(F.col("poc_validated"), VALIDATED).otherwise(1.0)
    alive = ~F.coalesce(F.col("status"), F.lit("")).isin(*INACTIVE["score"])
    sums = findings.groupBy(*by).agg(*[F.sum(F.when(alive & (F.col("severity") == s), weight).otherwise(0.0)).alias(f"{s}_weight") for s in LOSS])
    out = sums.withColumns({f"{s}_loss": most * F.col(f"{s}_weight") / (F.col(f"{s}_weight") + half) for s, (most, half) in LOSS.items()})
    total = sum((F.col(f"{s}_loss") for s in LOSS), F.lit(0.0))
    return out.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), F.round(100 - total))).cast("int"))


def severity_summary(findings: DataFrame) -> DataFrame:
    """Counts and percentages of each severity by scan, over all findings."""
    sums = findings.groupBy("scan_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    return sums.withColumns({f"{s}_percent": F.when(F.col("total") == 0, 0.0).otherwise(F.col(s) * 100.0 / F.col("total")) for s in SEVERITIES})


def report_index(findings: DataFrame) -> DataFrame:
    """``scan_id, display_index, severity, finding_id``: a running number over the severity buckets of a report."""
    w = Window.partitionBy("scan_id").orderBy(severity_rank(F.col("severity")).desc(), *triage_columns())
    return active(findings, "report").withColumn("display_index", F.row_number().over(w)).select("scan_id", "display_index", "severity", "finding_id")


def report_buckets(findings: DataFrame) -> DataFrame:
    """One row for each scan and severity: label, count, first number and the findings in order."""
    return (
        report_index(findings)
        .groupBy("scan_id", "severity")
        .agg(F.count("*").alias("n"), F.min("display_index").alias("first_index"), F.sort_array(F.collect_list(F.struct("display_index", "finding_id"))).alias("f"))
        .select("scan_id", "severity", severity_label(F.col("severity")).alias("label"), "n", "first_index", F.transform("f", lambda x: x["finding_id"]).alias("finding_ids"))
    )


def _with(df: DataFrame, **kinds: str) -> DataFrame:
    """``df`` with those of the named columns that it lacks, as nulls."""
    return df.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in df.columns})


def render_findings(findings: DataFrame, patches: DataFrame) -> DataFrame:
    """Findings as a report shows them.

    Adds ``clean_title, cwe, owasp_code, label, confidence_pct``, ``snippet_window`` (the lines of ``code_snippet`` around ``line_start``, whether they are cut, and how many there are; null
    without a snippet), ``reference_urls`` (the strings of the JSON array ``references_json``; empty where it is none), and the first ``patch`` with whether it is prose.
    """
    first = patches.groupBy("finding_id").agg(F.min_by("patch", F.struct("created_at", "patch_id")).alias("patch"))
    rows = _with(findings, code_snippet="string", references_json="string")
    cwe = cwe_of(F.col("cwe_id"), F.col("title"))
    rows = window_snippet(rows.withColumn("__lines", lines_of(F.nullif("code_snippet", F.lit("")))), "__lines", "line_start")
    window = F.struct(F.col("window").alias("lines"), "truncated", "original_line_count")
    listed = F.from_json("references_json", "array<string>")
    urls = F.when(F.try_parse_json("references_json").isNotNull() & F.trim("references_json").startswith("["), F.filter(listed, lambda u: u.isNotNull() & ~u.rlike(r"^[\[{]")))
    return rows.join(first, "finding_id", "left").withColumns(
        {
            "clean_title": clean_title(F.col("title")), "cwe": cwe, "owasp_code": owasp_code(cwe), "label": severity_label(F.col("severity")), "confidence_pct": confidence_percent(F.col("confidence")),
            "snippet_window": F.when(F.size("__lines") > 0, window), "reference_urls": F.coalesce(urls, F.array().cast("array<string>")), "patch_is_prose": F.coalesce(looks_like_prose(F.col("patch")), F.lit(False)),
        }
    ).drop("__lines", "window", "truncated", "original_line_count")


def executive_summary(summary: DataFrame) -> DataFrame:
    """Adds ``text`` to the rows of ``severity_summary``."""
    some = F.col("critical") + F.col("high")
    text = F.when(F.col("total") == 0, "No findings.").otherwise(
        F.concat(
            F.format_string("%d finding%s", "total", F.when(F.col("total") == 1, "").otherwise("s")),
            F.format_string(": %d critical, %d high, %d medium, %d low.", "critical", "high", "medium", "low"),
            F.when(some > 0, F.format_string(" %d need%s attention first.", some, F.when(some == 1, "s").otherwise(""))).otherwise(""),
        )
    )
    return summary.withColumn("text", text)


def _rule_id() -> Column:
    tag = F.substring(F.coalesce("fingerprint", "finding_id"), 1, 12)
    return F.coalesce(F.nullif("cwe_id", F.lit("")), F.nullif("cve_id", F.lit("")), F.concat(F.lit("tessera."), slugify(F.col("source")), F.lit("."), tag))


def _sarif_rows(findings: DataFrame) -> DataFrame:
    for c in ("cve_id", "source", "fingerprint"):
        if c not in findings.columns:
            findings = findings.withColumn(c, F.lit(None).cast("string"))
    return active(findings, "sarif").withColumn("rule_id", _rule_id())


def sarif_rules(findings: DataFrame) -> DataFrame:
    """One row for each scan and rule, defined by its first finding in triage order."""
    w = Window.partitionBy("scan_id", "rule_id").orderBy(*triage_columns())
    first = _sarif_rows(findings).withColumn("k", F.row_number().over(w)).filter("k = 1")
    return first.select("scan_id", "rule_id", clean_title(F.col("title")).alias("name"), sarif_level(F.col("severity")).alias("level"), security_severity(F.col("severity")).alias("security_severity"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """One row for each active finding, with lines of at least 1 that don't run backwards."""
    rows = _sarif_rows(findings)
    start = F.greatest(F.lit(1), F.coalesce("line_start", F.lit(1)))
    end = F.greatest(start, F.coalesce(F.col("line_end") if "line_end" in rows.columns else F.lit(None).cast("int"), start))
    return rows.select("scan_id", "finding_id", "rule_id", sarif_level(F.col("severity")).alias("level"), "file_path", start.alias("start_line"), end.alias("end_line"))


def with_owasp(df: DataFrame) -> DataFrame:
    return df.withColumn("owasp_code", owasp_code(F.col("cwe_id")))


def group_by_rule(findings: DataFrame) -> DataFrame:
    """Findings of one title in a scan: ``n``, the greatest severity, a title for the group and its fingerprint."""
    found = findings.groupBy("scan_id", "title").agg(F.count("*").alias("n"), F.max(severity_rank(F.col("severity"))).alias("rank"))
    top = F.coalesce(F.get(F.array(*[F.lit(s) for s in reversed(SEVERITIES)]), F.col("rank") - 1), F.lit("low"))
    title = F.format_string("[%s] %s (%d location%s)", F.upper("max_severity"), "title", "n", F.when(F.col("n") == 1, "").otherwise("s"))
    return found.withColumn("max_severity", top).withColumns({"group_title": title, "group_fingerprint": group_fingerprint("rule", F.col("title"))}).drop("rank")


def plan_issues(candidates: DataFrame, issues: DataFrame, keys: tuple[str, ...] = ("repo_id", "fingerprint")) -> DataFrame:
    """Adds ``action``: ``link`` where an issue of the key is there, else ``create``."""
    known = issues.select(*keys, F.lit(True).alias("__known")).dropDuplicates(list(keys))
    return candidates.join(known, list(keys), "left").withColumn("action", F.when(F.col("__known"), "link").otherwise("create")).drop("__known")


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of both; of rows with one key an update wins, of updates the one that is greatest by ``order``."""
    both = target.withColumn("__new", F.lit(0)).unionByName(updates.withColumn("__new", F.lit(1)))
    rest = [c for c in target.columns if c not in (*keys, order)]
    w = Window.partitionBy(*keys).orderBy(F.col("__new").desc(), F.col(order).desc(), *[F.col(c).desc() for c in rest])
    return both.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k", "__new")


def latest_by(df: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """The row of each key that is newest, by ``ts`` and then ``tie``; pre-aggregated, so a hot key is no hot task."""
    rest = [c for c in df.columns if c not in (*keys, ts, tie)]
    return df.groupBy(*keys).agg(F.max(F.struct(ts, tie, *rest)).alias("r")).select(*keys, "r.*").select(*df.columns)


def tail(df: DataFrame, n: int, key: str = "scan_id", ts: str = "created_at", tie: str = "event_id") -> DataFrame:
    """The newest ``n`` rows of each key, with ``position``."""
    w = Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col(tie).desc())
    return df.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)


def apply_triage(findings: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings with the newest allowed status and severity of each, and the audit rows (old and new values).

    ``actions`` has ``finding_id, created_at, action_id, status, severity``; a value that is null or not allowed changes nothing.
    """
    ok = actions.withColumn("status", F.when(status_rank(F.col("status")) < 5, F.col("status"))).withColumn(
        "severity", F.when(severity_rank(F.col("severity")) > 0, F.col("severity"))
    )
    order = F.struct("created_at", "action_id")
    last = ok.groupBy("finding_id").agg(
        F.max_by("status", F.when(F.col("status").isNotNull(), order)).alias("new_status"), F.max_by("severity", F.when(F.col("severity").isNotNull(), order)).alias("new_severity")
    )
    both = findings.join(last, "finding_id", "left").withColumns({"new_status": F.coalesce("new_status", "status"), "new_severity": F.coalesce("new_severity", "severity")})
    audit = both.filter("NOT (new_status <=> status) OR NOT (new_severity <=> severity)").select(
        "finding_id", F.col("status").alias("old_status"), "new_status", F.col("severity").alias("old_severity"), "new_severity"
    )
    changed = both.withColumns({"status": F.col("new_status"), "severity": F.col("new_severity")}).drop("new_status", "new_severity")
    return changed, audit


def timeline(events: DataFrame) -> DataFrame:
    return events.orderBy("finding_id", "created_at", "event_id")


def latest_event(events: DataFrame, event_type: str) -> DataFrame:
    return latest_by(events.filter(F.col("event_type") == event_type), ["finding_id"], "created_at", "event_id")


def scan_patches(patches: DataFrame, findings: DataFrame) -> DataFrame:
    """Patches with the scan and file of their finding."""
    return patches.join(findings.select("finding_id", "scan_id", "file_path"), "finding_id")


def _newest(rows: DataFrame, value: Column, tie: Column) -> DataFrame:
    """``finding_id, __v``: the ``value`` of each finding's newest row by ``created_at`` (if the column is there), then by ``tie``."""
    time = [F.col("created_at")] if "created_at" in rows.columns else []
    return rows.groupBy("finding_id").agg(F.max_by(value, F.struct(*time, tie)).alias("__v"))


def apply_verdicts(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Findings after reviewer verdicts (``finding_id, verdict``: a model's text that holds JSON with verdict, severity, reasoning).

    confirmed: confidence high, and the severity if it is a known one; false_positive: that status and low confidence;
    anything else, also unreadable JSON, changes nothing but for the reasoning that is appended to the description. Adds ``outcome``. Of several
    verdicts of a finding the newest by ``created_at`` counts, of equal ones (or without that column) the last in order of text.
    """
    newest = with_json(_newest(verdicts, F.col("verdict"), F.col("verdict")), "__v", "__json")
    v = F.from_json("__json", "verdict string, severity string, reasoning string")
    got = newest.select("finding_id", F.explode(F.array(v)).alias("v")).select(
        "finding_id", F.lower("v.verdict").alias("__verdict"), F.lower("v.severity").alias("__severity"), F.col("v.reasoning").alias("__why")
    )
    both = findings.join(got, "finding_id", "left")
    sure, wrong = F.col("__verdict").eqNullSafe("confirmed"), F.col("__verdict").eqNullSafe("false_positive")
    return both.withColumns(
        {
            "severity": F.when(sure & (severity_rank(F.col("__severity")) > 0), F.col("__severity")).otherwise(F.col("severity")),
            "confidence": F.when(sure, "high").when(wrong, "low").otherwise(F.col("confidence")),
            "status": F.when(wrong, "false_positive").otherwise(F.col("status")),
            "description": F.concat_ws("\n\n---\n", "description", F.nullif("__why", F.lit(""))),
            "outcome": F.when(sure, "confirmed").when(wrong, "false_positive").when(F.col("__verdict") == "plausible", "plausible").otherwise("unchanged"),
        }
    ).drop("__verdict", "__severity", "__why")


def apply_validation(findings: DataFrame, results: DataFrame) -> DataFrame:
    """Sets ``poc_validated`` and ``poc_result`` (JSON) from ``results (finding_id, verdict, exit_code, output)``; a finding without a result keeps what it has.

    Of several results of a finding the newest by ``created_at`` counts, of equal ones (or without that column) the last in order of verdict, exit code and output.
    """
    result = F.struct("verdict", "exit_code", "output")
    got = _newest(results, result, result).select("finding_id", (F.col("__v.verdict") == "confirmed").alias("__ok"), F.to_json("__v").alias("__json"))
    if "poc_result" not in findings.columns:
        findings = findings.withColumn("poc_result", F.lit(None).cast("string"))
    both = findings.join(got, "finding_id", "left")
    return both.withColumns({"poc_validated": F.coalesce("__ok", "poc_validated"), "poc_result": F.coalesce("__json", "poc_result")}).drop("__ok", "__json")


def eligible_jobs(jobs: DataFrame, now: Column, max_active: int = 2) -> DataFrame:
    """Pending jobs that are due and have attempts left, of users with fewer than ``max_active`` active jobs, with ``rank`` by priority, then age."""
    busy = jobs.filter(F.col("status").isin("claimed", "running")).groupBy("user_id").agg(F.count("*").alias("active"))
    due = jobs.filter((F.col("status") == "pending") & (F.col("run_at") <= now) & (F.col("attempts") < F.col("max_attempts")))
    free = due.join(busy, "user_id", "left").filter(F.coalesce("active", F.lit(0)) < max_active).drop("active")
    w = Window.partitionBy("user_id").orderBy(F.col("priority").desc(), "created_at", "job_id")
    return free.withColumn("user_rank", F.row_number().over(w))


def stale_jobs(jobs: DataFrame, now: Column, minutes: int) -> DataFrame:
    """Jobs claimed longer ago than ``minutes``, with ``new_status``: dead without attempts left, else pending."""
    old = jobs.filter(F.col("status").isin("claimed", "running") & (F.col("claimed_at") < now - F.make_dt_interval(mins=F.lit(minutes))))
    return old.withColumn("new_status", F.when(F.col("attempts") >= F.col("max_attempts"), "dead").otherwise("pending"))


#: Stages of a scan in order.
STAGES = ("ingest", "tyr", "static_analysis", "taint_analysis", "config_scan", "hunt", "vidarr", "garmr", "report")


def stage_snapshot(scans: DataFrame, events: DataFrame) -> DataFrame:
    """Every stage of every scan in order with its newest status, ``pending`` without an event."""
    spark = scans.sparkSession
    stages = spark.createDataFrame(list(enumerate(STAGES, 1)), "place int, stage string")
    last = latest_by(events.select("scan_id", "stage", "created_at", "event_id", "status"), ["scan_id", "stage"], "created_at", "event_id")
    every = scans.select("scan_id").crossJoin(F.broadcast(stages))  # nine rows a scan
    return every.join(last.select("scan_id", "stage", "status", "created_at"), ["scan_id", "stage"], "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def current_task(events: DataFrame) -> DataFrame:
    """The newest running event of a scan, else its newest."""
    order = F.struct((F.col("status") == "running").alias("r"), "created_at", "event_id")
    return events.groupBy("scan_id").agg(F.max(F.struct(order.alias("o"), "stage", "status")).alias("m")).select("scan_id", "m.stage", "m.status")


#: Names of stages that differ from their slug, tones of events, statuses in which a scan is over, and what is said of a scan without events.
STAGE_LABEL = {"vidarr": "Víðarr"}
EVENT_TONE = {"completed": "success", "failed": "error", "running": "active", "warning": "warning"}
TYPE_TONE = {"issue_automation": "active", "scan_failed": "error"}
OVER = ("completed", "failed", "cancelled")
WAITING = ("Waiting for activity", "No execution activity has been recorded yet.")


def _label(slug: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in STAGE_LABEL.items() for x in kv]), slug), humanized(slug))


def scan_snapshot(scans: DataFrame, findings: DataFrame, events: DataFrame, newest: int = 80) -> DataFrame:
    """One row for each of ``scans (scan_id, status, updated_at)``: ``scan_id, status, status_label, is_live, counts, current_task, fallback, stages, activity``.

    ``activity`` holds the ``newest`` events by ``created_at``, then ``event_id``, newest first, with their tone; the current task is the newest of them that runs, else the
    newest, else a notice. ``stages`` are all nine in order with their newest status (``pending`` without an event); ``fallback`` is the newest event of type ``provider_fallback``.
    ``events`` has ``scan_id, event_id, stage, status, created_at``, and perhaps ``event_type, title, detail, progress_pct``. The newest events are found by a bounded rank, which Spark
    already cuts before the shuffle (null for a scan without events), and all else by partial sums, so a scan with very many events is no task of its own.
    """
    for c, kind in (("event_type", "string"), ("title", "string"), ("detail", "string"), ("progress_pct", "int")):
        if c not in events.columns:
            events = events.withColumn(c, F.lit(None).cast(kind))
    order = F.struct("created_at", "event_id", "status")
    latest = [F.max(F.when(F.col("stage") == s, order)).alias(f"s{k}") for k, s in enumerate(STAGES)]
    back = F.max(F.when(F.col("event_type") == "provider_fallback", F.struct("created_at", "event_id", "detail"))).alias("fallback")
    by_stage = events.groupBy("scan_id").agg(*latest, back)
    count = findings.groupBy("scan_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])

    w = Window.partitionBy("scan_id").orderBy(F.col("created_at").desc(), F.col("event_id").desc())
    tone = F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for kv in EVENT_TONE.items() for x in kv]), F.col("status")),
        F.try_element_at(F.create_map(*[F.lit(x) for kv in TYPE_TONE.items() for x in kv]), F.col("event_type")), F.lit("neutral"),
    )
    shown = F.struct(F.col("k").alias("place"), "event_id", "event_type", tone.alias("tone"), "status", "stage", "title", "detail", "progress_pct", "created_at")
    top = events.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= newest).groupBy("scan_id").agg(F.sort_array(F.collect_list(shown)).alias("activity"))

    rows = scans.select("scan_id", "status", F.col("updated_at") if "updated_at" in scans.columns else F.lit(None).cast("timestamp").alias("updated_at"))
    rows = rows.join(count, "scan_id", "left").join(by_stage, "scan_id", "left").join(top, "scan_id", "left")
    task = lambda e: F.struct(e["stage"].alias("stage"), e["title"].alias("title"), e["detail"].alias("detail"), e["progress_pct"].alias("progress_pct"), e["created_at"].cast("timestamp").alias("created_at"))
    running = F.try_element_at(F.filter("activity", lambda e: e["status"] == "running"), F.lit(1))
    first = F.try_element_at(F.col("activity"), F.lit(1))
    idle = F.struct(F.lit(None).cast("string").alias("stage"), F.lit(WAITING[0]).alias("title"), F.lit(WAITING[1]).alias("detail"), F.lit(None).cast("int").alias("progress_pct"), F.col("updated_at").cast("timestamp").alias("created_at"))
    stages = F.array(*[F.struct(F.lit(s).alias("stage"), _label(F.lit(s)).alias("label"), F.coalesce(F.col(f"s{k}.status"), F.lit("pending")).alias("status"), F.col(f"s{k}.created_at").alias("created_at")) for k, s in enumerate(STAGES)])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return rows.select(
        "scan_id", "status", _label(F.col("status")).alias("status_label"), (~F.coalesce(F.col("status").isin(*OVER), F.lit(False))).alias("is_live"),
        F.struct(zero("total"), *[zero(s) for s in SEVERITIES]).alias("counts"),
        F.when(running.isNotNull(), task(running)).when(first.isNotNull(), task(first)).otherwise(idle).alias("current_task"),
        "fallback", stages.alias("stages"), "activity",
    )


def snapshot_diff(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("repo_id", "file_path"), mark: str = "content_hash") -> DataFrame:
    """``change`` of each file: added, deleted, modified or unchanged."""
    a = old.select(*keys, F.col(mark).alias("__a"), F.lit(True).alias("__ina"))
    b = new.select(*keys, F.col(mark).alias("__b"), F.lit(True).alias("__inb"))
    change = (
        F.when(F.col("__ina").isNull(), "added").when(F.col("__inb").isNull(), "deleted").when(F.col("__a").eqNullSafe(F.col("__b")), "unchanged").otherwise("modified")
    )
    return a.join(b, list(keys), "full").select(*keys, change.alias("change"))


def carry_forward(old_findings: DataFrame, new_findings: DataFrame, diff: DataFrame, keys: tuple[str, ...] = ("repo_id", "file_path")) -> DataFrame:
    """Findings of the next scan with ``carried``: those of unchanged files come from the old scan; a new one with a known fingerprint keeps the old state."""
    same = diff.filter("change = 'unchanged'").select(*keys)
    kept = old_findings.join(same, list(keys), "left_semi").withColumn("carried", F.lit(True))
    state = old_findings.groupBy("fingerprint").agg(F.max("status").alias("__status"))
    fresh = new_findings.join(same, list(keys), "left_anti").join(state, "fingerprint", "left").withColumn("status", F.coalesce("__status", "status")).drop("__status")
    return kept.unionByName(fresh.select(*old_findings.columns).withColumn("carried", F.lit(False)))


def tool_usage(calls: DataFrame, rollup: bool = False) -> DataFrame:
    """Calls and tokens of each scan and stage; with ``rollup`` also of each scan and of all."""
    grouped = calls.rollup("scan_id", "stage") if rollup else calls.groupBy("scan_id", "stage")
    return grouped.agg(F.count("*").alias("calls"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"))


def list_scans(scans: DataFrame, findings: DataFrame, repo_id=None) -> DataFrame:
    """Scans, perhaps of one repository, newest first by ``position`` within each, with their number of findings."""
    rows = scans if repo_id is None else scans.filter(F.col("repo_id") == repo_id)
    n = findings.groupBy("scan_id").agg(F.count("*").alias("finding_count"))
    w = Window.partitionBy("repo_id").orderBy(F.col("created_at").desc(), F.col("scan_id").desc())
    return rows.join(n, "scan_id", "left").na.fill(0, ["finding_count"]).withColumn("position", F.row_number().over(w))


def list_repos(repos: DataFrame, scans: DataFrame) -> DataFrame:
    """Repositories that aren't deleted with their number of scans and newest scan time."""
    n = scans.groupBy("repo_id").agg(F.count("*").alias("scan_count"), F.max("created_at").alias("last_scan_at"))
    return repos.filter("NOT deleted").join(n, "repo_id", "left").na.fill(0, ["scan_count"])


def apply_transitions(rows: DataFrame, events: DataFrame, keys: list[str], once: str | None = None) -> DataFrame:
    """Rows after the newest event of each key: new status, timestamps kept where they are set.

    ``events`` has the keys, ``status, at``; ``started_at`` and ``finished_at`` are filled by running and completed or failed events.
    once: a boolean column that is set by an event of status ``applied`` and never again by later ones.
    """
    e = events.groupBy(*keys).agg(
        F.max_by("status", "at").alias("__status"), F.min(F.when(F.col("status") == "running", F.col("at"))).alias("__start"),
        F.max(F.when(F.col("status").isin("completed", "failed"), F.col("at"))).alias("__end"), F.max(F.col("status") == "applied").alias("__applied"),
    )
    both = rows.join(e, keys, "left")
    new = {"status": F.coalesce("__status", "status"), "started_at": F.coalesce("started_at", "__start"), "finished_at": F.coalesce("finished_at", "__end")}
    if once:
        new[once] = F.coalesce(F.col(once), F.lit(False)) | F.coalesce("__applied", F.lit(False))
    return both.withColumns(new).drop("__status", "__start", "__end", "__applied")


def cascade_delete(deleted: DataFrame, children: DataFrame, key: str, set_null: bool = False) -> DataFrame:
    """Children after their parents ``deleted (key)`` went: removed too, or with their key set to null."""
    gone = deleted.select(key).distinct()
    if not set_null:
        return children.join(gone, key, "left_anti")
    marked = children.join(gone.withColumn("__gone", F.lit(True)), key, "left")
    return marked.withColumn(key, F.when(F.col("__gone").isNull(), F.col(key))).select(*children.columns)


def humanized(slug: Column) -> Column:
    """Words of a slug with capital first letters: ``in_review`` is ``In Review``. Other letters stay."""
    words = F.filter(F.split(slug, "_"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")


#: Titles and tones of events, and what is said where an event has no text of its own.
FEED = {
    "status_change": ("Status updated", None, "The finding status was updated."),
    "ai_explanation": ("AI explanation generated", "active", "Plain-language clarification is now available for this alert."),
    "ai_verification": (None, None, "A second-pass verification review was recorded."),
    "issue_linked": ("Repository issue linked", "success", "Repository issue linkage changed."),
    "remediation_started": ("Fix PR agent started", "active", "Fix PR generation started."),
    "remediation_pr_opened": ("Fix PR opened", "success", "A draft pull request was opened for this finding."),
    "remediation_failed": ("Fix PR agent failed", "warning", "Fix PR generation failed before a pull request was opened."),
}
STATUS_TONE = {"confirmed": "success", "fixed": "success", "false_positive": "warning", "dismissed": "neutral"}
VERDICT_TONE = {"confirmed": "success", "false_positive_likely": "warning"}


def _lookup(table: dict[str, str], key: Column, other: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(other))


def activity_feed(events: DataFrame) -> DataFrame:
    """Adds ``feed_title, detail, tone`` of finding events by ``event_type, old_value, new_value, comment, metadata`` (JSON; missing columns count as null).

    Texts of the metadata count only if they are strings, as does ``created`` only as a boolean; malformed metadata counts as none.
    """
    for c in ("old_value", "new_value", "comment", "metadata"):
        if c not in events.columns:
            events = events.withColumn(c, F.lit(None).cast("string"))
    kind, old, new, comment = (F.col(c) for c in ("event_type", "old_value", "new_value", "comment"))
    data = F.expr("try_parse_json(metadata)")

    def text(field: str) -> Column:
        is_text = F.schema_of_variant(F.try_variant_get(data, f"$.{field}", "variant")) == "STRING"
        return F.when(is_text, F.try_variant_get(data, f"$.{field}", "string"))

    made = F.schema_of_variant(F.try_variant_get(data, "$.created", "variant")) == "BOOLEAN"
    made = F.coalesce(F.when(made, F.try_variant_get(data, "$.created", "boolean")), F.lit(False))
    said = lambda k: F.coalesce(comment, F.lit(FEED[k][2]))
    linked = F.when(made, F.concat(F.upper(text("provider")), F.lit(" issue #"), text("external_issue_number"), F.lit(" was created for this finding."))).otherwise(
        F.concat(F.lit("Linked to existing "), F.upper(text("provider")), F.lit(" issue #"), text("external_issue_number"), F.lit(" for this finding."))
    )
    moved = F.when(old.isNotNull(), F.concat(F.lit("Triage moved from "), humanized(old), F.lit(" to "), humanized(new), F.lit("."))).otherwise(F.concat(F.lit("Triage moved to "), humanized(new), F.lit(".")))
    started = F.concat(F.lit("Generating a fix branch `"), text("branch"), F.lit("` with `"), text("model"), F.lit("`."))
    verdict = text("verdict")
    detail = (
        F.when(kind == "status_change", F.coalesce(moved, said("status_change")))
        .when(kind == "ai_explanation", F.coalesce(text("summary"), said("ai_explanation")))
        .when(kind == "ai_verification", F.coalesce(text("rationale"), said("ai_verification")))
        .when(kind == "issue_linked", F.coalesce(linked, said("issue_linked")))
        .when(kind == "remediation_started", F.coalesce(started, said("remediation_started")))
        .when(kind == "remediation_pr_opened", F.coalesce(F.concat(F.lit("Draft pull request opened: "), text("pr_url")), said("remediation_pr_opened")))
        .when(kind == "remediation_failed", F.coalesce(text("error"), said("remediation_failed")))
        .otherwise(F.coalesce(comment, new, old, F.lit("Review activity was recorded.")))
    )
    title = F.when(kind == "ai_verification", F.concat(F.lit("AI verification: "), F.coalesce(humanized(verdict), F.lit("Needs Review"))))
    tone = F.when(kind == "status_change", _lookup(STATUS_TONE, new, "active")).when(kind == "ai_verification", _lookup(VERDICT_TONE, verdict, "active"))
    for k, (name, mood, _) in FEED.items():
        title = title.when(kind == k, name) if name else title
        tone = tone.when(kind == k, mood) if mood else tone
    return events.withColumns({"feed_title": title.otherwise(humanized(kind)), "detail": detail, "tone": tone.otherwise("neutral")})


#: Most bytes of a snippet and of a patch in an issue.
MOST_SNIPPET, MOST_PATCH = 1200, 1600


def _cut(text: Column, most: int) -> Column:
    """At most ``most`` bytes of a text, whole characters, with dots where it goes on; blanks around it go."""
    head = F.regexp_replace(F.decode(F.substring(F.encode(text, "utf-8"), 1, most), "utf-8"), "\ufffd+$", "")
    return _trimmed(F.when(F.octet_length(text) > most, F.concat(head, F.lit("..."))).otherwise(text))


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def _section(title: str, text: Column, fence: str | None = None) -> Column:
    """A part of an issue's body; nothing for a null text."""
    before, after = (f"### {title}\n\n", "\n\n") if fence is None else (f"### {title}\n\n```{fence}\n", "\n```\n\n")
    return F.coalesce(F.concat(F.lit(before), text, F.lit(after)), F.lit(""))


def _bullet(label: str, text: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"- {label}: `"), text, F.lit("`\n")), F.lit(""))


def _references(urls: Column) -> Column:
    return F.when(F.size(urls) > 0, F.concat(F.lit("### References\n\n"), F.array_join(F.transform(urls, lambda u: F.concat(F.lit("- "), u)), "\n"), F.lit("\n"))).otherwise("")


ISSUE = {"line_end": "int", "cve_id": "string", "description": "string", "code_snippet": "string", "suggested_patch": "string", "fingerprint": "string", "reference_urls": "array<string>"}


def _lines_at() -> Column:
    return F.concat_ws("-", F.col("line_start").cast("string"), F.col("line_end").cast("string"))


def issue_bodies(findings: DataFrame) -> DataFrame:
    """Adds ``issue_title`` and ``issue_body`` for an issue of each finding: a list of facts, then summary, evidence, patch and references as far as there are any."""
    c = F.col
    body = F.concat(
        F.lit("## Finding\n\n"), _bullet("Severity", c("severity")), _bullet("Confidence", c("confidence")), _bullet("Fingerprint", c("fingerprint")),
        F.lit("- Location: `"), F.coalesce("file_path", F.lit("")), F.lit("`:"), _lines_at(), F.lit("\n"), _bullet("CWE", c("cwe_id")), _bullet("CVE", c("cve_id")), F.lit("\n"),
        _section("Summary", _trimmed(c("description"))), _section("Evidence", _cut(c("code_snippet"), MOST_SNIPPET), "text"), _section("Suggested Patch", _cut(c("suggested_patch"), MOST_PATCH), "diff"),
        _references(F.coalesce("reference_urls", F.array().cast("array<string>"))),
    )
    rows = _with(findings, **ISSUE)
    return rows.withColumns({"issue_title": F.format_string("[%s] %s", F.upper("severity"), "title"), "issue_body": _trimmed(body)}).select(*findings.columns, "issue_title", "issue_body")


def issue_texts(findings: DataFrame) -> DataFrame:
    """``scan_id, title, body``: one text for each scan and title: the facts of the group, a table of its places in triage order, and the first summary, evidence and patch that some of them has, and all references."""
    rows = _with(findings, **ISSUE)
    w = Window.partitionBy("scan_id", "title").orderBy(*triage_columns())
    place = F.concat(F.lit("| `"), F.coalesce("file_path", F.lit("")), F.lit("` | "), _lines_at(), F.lit(" | "), F.coalesce("confidence", F.lit("")), F.lit(" |"))
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("k"))).alias(c)
    grouped = rows.withColumn("k", F.row_number().over(w)).withColumn("place", place).groupBy("scan_id", "title").agg(
        F.max(severity_rank(F.col("severity"))).alias("rank"), F.sort_array(F.collect_list(F.struct("k", "place"))).alias("p"), first("cwe_id"), first("description"), first("code_snippet"), first("suggested_patch"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("reference_urls", F.array().cast("array<string>")))))).alias("urls"),
    )
    severity = F.coalesce(F.get(F.array(*[F.lit(s) for s in reversed(SEVERITIES)]), F.col("rank") - 1), F.lit("low"))
    table = F.concat(F.lit("### Affected Locations\n\n| File | Line | Confidence |\n|------|------|------------|\n"), F.array_join(F.transform("p", lambda x: x["place"]), "\n"), F.lit("\n\n"))
    body = F.concat(
        F.lit("## Grouped Finding\n\n- Rule: **"), "title", F.lit("**\n"), _bullet("Severity", severity), F.lit("- Locations: **"), F.size("p").cast("string"), F.lit("**\n"), _bullet("CWE", F.col("cwe_id")), F.lit("\n"),
        _section("Summary", _trimmed(F.col("description"))), table, _section("Example Evidence", _cut(F.col("code_snippet"), MOST_SNIPPET), "text"), _section("Suggested Patch", _cut(F.col("suggested_patch"), MOST_PATCH), "diff"), _references(F.col("urls")),
    )
    return grouped.select("scan_id", "title", _trimmed(body).alias("body"))


def match_push(events: DataFrame, repos: DataFrame) -> DataFrame:
    """Push events with the first repository (by id) whose remote URL is theirs in normal form."""
    known = repos.select("repo_id", normalize_remote_url(F.col("remote_url")).alias("__url")).groupBy("__url").agg(F.min("repo_id").alias("repo_id"))
    return events.withColumn("__url", normalize_remote_url(F.col("clone_url"))).join(known, "__url").drop("__url")


def mark_connected(remote: DataFrame, repos: DataFrame) -> DataFrame:
    """Adds ``connected``: whether a repository has the remote's URL in normal form."""
    known = repos.select(normalize_remote_url(F.col("remote_url")).alias("__url"), F.lit(True).alias("__in")).distinct()
    return remote.withColumn("__url", normalize_remote_url(F.col("clone_url"))).join(known, "__url", "left").withColumn("connected", F.coalesce("__in", F.lit(False))).drop("__url", "__in")


def merge_new(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming findings whose fingerprint is not there yet, one for each fingerprint. Findings without a fingerprint can't be told apart, so all of them are new."""
    fresh = incoming.filter("fingerprint IS NOT NULL").join(existing.select("fingerprint"), "fingerprint", "left_anti")
    w = Window.partitionBy("fingerprint").orderBy(*[F.col(c) for c in incoming.columns if c in ("file_path", "line_start", "finding_id")])
    fresh = fresh.withColumn("__k", F.row_number().over(w)).filter("__k = 1").select(*incoming.columns)
    return fresh.unionByName(incoming.filter("fingerprint IS NULL"))


def detector_summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("scan_id", "source").agg(F.count("*").alias("n"))
