"""Sources and sinks: code corpora, archives, scanner and advisory files, push events, findings."""

from __future__ import annotations

import io
import os
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import sarif_level, security_severity
from tessera.operators.findings import sarif_results, sarif_rules
from tessera.operators.text import with_file_stats, with_language
from tessera.plans.scratch import materialize

#: Directories that are not read, and the largest file in bytes.
SKIPPED_DIRS = (".git", "node_modules", "target", "dist", "build", "vendor", ".venv", "venv", "__pycache__", ".tox", ".next", ".idea", ".vscode", "coverage", "out")
MOST_BYTES = 1_048_576


def _skipped(path: Column) -> Column:
    """Files in skipped directories, and hidden ones."""
    skipped = "|".join(d.replace(".", r"\.") for d in SKIPPED_DIRS)
    return path.rlike(rf"(?:^|/)(?:{skipped})/") | path.rlike(r"(?:^|/)\.[^/]*$")


def is_link(fs: pafs.FileSystem, path: str) -> bool:
    """Whether a path is a link; only local file systems have any."""
    return isinstance(fs, pafs.LocalFileSystem) and os.path.islink(path)


def read_corpus(spark: SparkSession, root: str, repo_id: str) -> DataFrame:
    """Text files below a folder: ``repo_id, file_path, content, byte_size, language``.

    Skipped directories (which aren't opened), hidden files, links (to files or folders), files over ``MOST_BYTES`` and files that aren't UTF-8 are left out;
    names that begin with an underscore, which Spark's own listing drops, are read. ``root`` is an absolute path or a URI
    that pyarrow opens. Directories are listed level by level, and files read, in tasks.
    """
    skipped = set(SKIPPED_DIRS)

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(root)
        base = base.rstrip("/")
        for pdf in batches:
            for folder in pdf["file_path"]:
                found = fs.get_file_info(pafs.FileSelector(f"{base}/{folder}" if folder else base))
                found = [e for e in found if not is_link(fs, e.path)]
                rows = [(e.path[len(base) :].lstrip("/"), e.base_name, e.type == pafs.FileType.Directory, e.size or 0) for e in found]
                rows = [(p, d, n) for p, name, d, n in rows if not (name in skipped if d else name.startswith(".") or n > MOST_BYTES)]
                yield pd.DataFrame(rows, columns=["file_path", "is_dir", "byte_size"])

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(root)
        for pdf in batches:
            for path, size in zip(pdf["file_path"], pdf["byte_size"], strict=True):
                with fs.open_input_stream(f"{base.rstrip('/')}/{path}") as f:
                    data = f.read()
                try:
                    yield pd.DataFrame({"file_path": [path], "content": [data.decode()], "byte_size": [size]})
                except UnicodeDecodeError:
                    continue

    schema = "file_path string, is_dir boolean, byte_size int"
    folders, files = spark.createDataFrame([("",)], "file_path string"), None
    while True:
        level = materialize(folders.mapInPandas(listed, schema), "corpus-listing")
        files = level.filter("NOT is_dir") if files is None else files.unionByName(level.filter("NOT is_dir"))
        folders = level.filter("is_dir").select("file_path")
        if folders.isEmpty():
            break
        folders = folders.repartition("file_path")
    read = files.select("file_path", "byte_size").repartition("file_path").mapInPandas(opened, "file_path string, content string, byte_size int")
    return with_language(read.select(F.lit(repo_id).alias("repo_id"), "file_path", "content", "byte_size"))


def read_zip_corpus(spark: SparkSession, glob: str) -> DataFrame:
    """Text files of zip archives: ``archive, file_path, content``.

    Directories, skipped and hidden ones, and entries whose name leaves the archive are left out; a single top folder is cut off. An archive
    that can't be read is one row with neither path nor content; an entry that can't is left out.
    """

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        for e in z.infolist():
                            if e.is_dir() or e.filename.startswith("/") or ".." in e.filename.split("/") or "\\" in e.filename or e.file_size > MOST_BYTES:
                                continue
                            try:
                                rows.append((path, e.filename, z.read(e).decode()))
                            except (UnicodeDecodeError, zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError):
                                continue
                except zipfile.BadZipFile:
                    yield pd.DataFrame([(path, None, None)], columns=["archive", "file_path", "content"])
                    continue
                tops = {r[1].split("/")[0] for r in rows}
                if len(tops) == 1 and all("/" in r[1] for r in rows):
                    rows = [(a, n.split("/", 1)[1], c) for a, n, c in rows]
                yield pd.DataFrame(rows, columns=["archive", "file_path", "content"])

    found = spark.read.format("binaryFile").load(glob).select("path", "content").mapInPandas(unpack, "archive string, file_path string, content string")
    return found.filter(~F.coalesce(_skipped(F.col("file_path")), F.lit(False)))


def write_snapshots(files: DataFrame, path: str) -> None:
    """Files with hash, size and line count, by repository."""
    with_file_stats(files).write.partitionBy("repo_id").mode("append").parquet(path)


def snapshot_at(snapshots: DataFrame, scan_id, file_path: str) -> DataFrame:
    return snapshots.filter((F.col("scan_id") == scan_id) & (F.col("file_path") == file_path)).orderBy("content_hash").limit(1)


def append_findings(findings: DataFrame, path: str) -> None:
    """Append findings; an empty list of references is stored as null."""
    if "references" in findings.columns:
        findings = findings.withColumn("references", F.when(F.size("references") > 0, F.col("references")))
    findings.write.mode("append").parquet(path)


SCANNER = (
    "results array<struct<check_id:string,path:string,start:struct<line:int>,end:struct<line:int>,extra:struct<message:string,severity:string,lines:string,fix:string,"
    "fix_regex:struct<regex:string,replacement:string>,metadata:struct<confidence:string,cwe:array<string>,references:array<string>>>>>"
)


def read_scanner_json(spark: SparkSession, path: str, root: str = "", multi_line: bool = True) -> DataFrame:
    """Findings of an external scanner's JSON, a document a file (or, with ``multi_line`` off, a line): severities ERROR, WARNING, INFO are high, medium, low (else medium)."""
    r = spark.read.schema(SCANNER).option("multiLine", multi_line).json(path).select(F.explode("results").alias("r")).select("r.*")
    sev = F.when(F.col("extra.severity") == "ERROR", "high").when(F.col("extra.severity") == "INFO", "low").otherwise("medium")
    conf = F.when(F.upper("extra.metadata.confidence").isin("HIGH", "LOW"), F.lower("extra.metadata.confidence")).otherwise("medium")
    file_path = F.when(F.col("path").startswith(root), F.regexp_replace(F.substr("path", F.lit(len(root) + 1)), "^/+", "")).otherwise(F.col("path"))
    fix = F.coalesce("extra.fix", F.concat(F.lit("replace "), "extra.fix_regex.regex", F.lit(" by "), "extra.fix_regex.replacement"), "extra.message")
    return r.select(
        F.col("check_id").alias("rule_id"), file_path.alias("file_path"), F.col("start.line").alias("line_start"), F.col("end.line").alias("line_end"), sev.alias("severity"), conf.alias("confidence"),
        F.nullif(F.regexp_extract(F.try_element_at("extra.metadata.cwe", F.lit(1)), r"(CWE-[0-9]+)", 1), F.lit("")).alias("cwe_id"),
        F.concat(F.lit("[semgrep:"), "check_id", F.lit("] "), F.substring("extra.message", 1, 200)).alias("title"), F.lit("semgrep").alias("source"), fix.alias("fix"),
        F.col("extra.lines").alias("snippet"), F.sha2(F.concat_ws(":", F.lit("semgrep"), "check_id", file_path, F.col("start.line").cast("string")), 256).alias("fingerprint"),
    )


ADVISORY = (
    "id string, summary string, aliases array<string>, severity array<struct<type:string,score:string>>, affected array<struct<package:struct<name:string,ecosystem:string>,"
    "ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>>>, references array<struct<type:string,url:string>>"
)


def read_advisories(spark: SparkSession, path: str) -> DataFrame:
    """Advisories (one JSON document a line or file) with their nested ranges."""
    return spark.read.schema(ADVISORY).json(path)


def advisory_ranges(advisories: DataFrame) -> DataFrame:
    """One row for each range: ``advisory_id, ecosystem, name, introduced, fixed, last_affected``."""
    rows = advisories.select(F.col("id").alias("advisory_id"), F.explode("affected").alias("a")).select("advisory_id", "a.package.*", F.explode("a.ranges").alias("r"))
    pick = lambda k: F.try_element_at(F.filter(F.transform("r.events", lambda e: e[k]), lambda v: v.isNotNull()), F.lit(1))
    return rows.select("advisory_id", "ecosystem", "name", F.coalesce(pick("introduced"), F.lit("0")).alias("introduced"), pick("fixed").alias("fixed"), pick("last_affected").alias("last_affected"))


PUSH = (
    "ref string, after string, checkout_sha string, object_kind string, repository struct<clone_url:string,git_http_url:string>, project struct<git_http_url:string>"
)


def read_push_events(events: DataFrame, body_col: str = "body", type_col: str = "event_type") -> DataFrame:
    """``clone_url, ref, commit`` of push events of both hosts' shapes (batch or stream); other events are left out."""
    b = F.from_json(body_col, PUSH)
    rows = events.withColumn("__b", b).filter((F.col(type_col) == "push") | (F.col("__b.object_kind") == "push"))
    url = F.coalesce("__b.repository.clone_url", "__b.project.git_http_url", "__b.repository.git_http_url")
    return rows.withColumns({"clone_url": url, "ref": F.col("__b.ref"), "commit": F.coalesce("__b.after", "__b.checkout_sha")}).drop("__b")


def to_sarif(findings: DataFrame, tool: str = "tessera") -> DataFrame:
    """``scan_id, sarif``: a SARIF 2.1.0 document for each scan, with its rules and active findings in order."""
    rule = F.struct(F.col("rule_id").alias("id"), F.col("name"), F.struct(F.col("level")).alias("defaultConfiguration"), F.struct(F.col("security_severity").alias("security-severity")).alias("properties"))
    rules = sarif_rules(findings).groupBy("scan_id").agg(F.sort_array(F.collect_list(rule)).alias("rules"))
    place = F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), F.struct(F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("finding_id"), F.col("rule_id").alias("ruleId"), F.col("level"), F.array(place).alias("locations"))
    results = sarif_results(findings).groupBy("scan_id").agg(F.sort_array(F.collect_list(result)).alias("results"))
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name"), F.col("rules")).alias("driver")).alias("tool"), F.col("results"))
    doc = F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))
    return rules.join(results, "scan_id").select("scan_id", F.to_json(doc).alias("sarif"))


def scan_report(summary: DataFrame, buckets: DataFrame, scores: DataFrame) -> DataFrame:
    """``scan_id, report``: one nested JSON document for each scan from the summary, the buckets and the score."""
    b = buckets.groupBy("scan_id").agg(F.sort_array(F.collect_list(F.struct("first_index", "label", "n", "finding_ids"))).alias("buckets"))
    rows = summary.join(b, "scan_id", "left").join(scores.select("scan_id", "score"), "scan_id", "left")
    return rows.select("scan_id", F.to_json(F.struct("scan_id", "total", "critical", "high", "medium", "low", "score", "buckets")).alias("report"))


def level_maps(severity: Column) -> list[Column]:
    return [sarif_level(severity).alias("level"), security_severity(severity).alias("security_severity")]
