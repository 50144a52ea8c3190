"""Package manifests to occurrences, and occurrences to advisories."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.columns import upgrade_guidance, upgrade_summary
from tessera.functions.versions import version_bin, version_key
from tessera.operators.text import to_lines
from tessera.plans.scratch import materialize

#: Ecosystem of a manifest's file name.
MANIFESTS = {
    "Cargo.toml": "crates.io", "Cargo.lock": "crates.io", "package.json": "npm", "package-lock.json": "npm", "requirements.txt": "PyPI", "Pipfile": "PyPI", "pyproject.toml": "PyPI",
    "go.mod": "Go", "go.sum": "Go", "pom.xml": "Maven", "build.gradle": "Maven", "Gemfile": "RubyGems", "Gemfile.lock": "RubyGems", "composer.json": "Packagist", "composer.lock": "Packagist",
}
#: Lock files, and the manifest beside those whose entries are looked up.
LOCKS = ("Cargo.lock", "package-lock.json", "Gemfile.lock", "composer.lock", "go.sum")
COMPANIONS = {"Cargo.lock": "Cargo.toml", "package-lock.json": "package.json"}
SCHEMA = "repo_id string, manifest_path string, ecosystem string, name string, version string, declared_version string, line_start int"


def _map(pairs: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def find_manifests(files: DataFrame) -> DataFrame:
    """Manifest files with their ecosystem."""
    return files.withColumn("ecosystem", _map(MANIFESTS, file_name(F.col("file_path")))).filter("ecosystem IS NOT NULL")


def _plain(df: DataFrame, name: Column, version: Column, declared: Column, line: Column) -> DataFrame:
    return df.select(
        F.col("repo_id").cast("string").alias("repo_id"), F.col("file_path").alias("manifest_path"), "ecosystem", name.alias("name"), version.alias("version"), declared.alias("declared_version"), line.cast("int").alias("line_start")
    ).filter("name IS NOT NULL AND name <> ''")


def _sections(lines: DataFrame) -> DataFrame:
    """Adds ``section``: the last ``[header]`` at or above a line of its file."""
    w = Window.partitionBy("repo_id", "file_path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    header = F.nullif(F.regexp_extract("line", r"^\s*\[+([^\]]+)\]+\s*$", 1), F.lit(""))
    return lines.withColumns({"header": header}).withColumn("section", F.last("header", ignorenulls=True).over(w))


def _tree(files: DataFrame) -> DataFrame:
    """Nested ``dependencies`` of package-lock version 1, of any depth: the one format that needs a loop."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for repo, path, eco, text in zip(pdf["repo_id"], pdf["file_path"], pdf["ecosystem"], pdf["content"], strict=True):
                try:
                    root = json.loads(text)
                except (ValueError, TypeError):
                    continue
                todo = [root.get("dependencies")] if isinstance(root, dict) and not root.get("packages") else []
                while todo:
                    level = todo.pop()
                    for name, entry in level.items() if isinstance(level, dict) else ():
                        if isinstance(entry, dict):
                            v = str(entry.get("version", ""))
                            out.append((repo, path, eco, name, v, v, 1))
                            todo.append(entry.get("dependencies"))
            yield pd.DataFrame(out, columns=["repo_id", "manifest_path", "ecosystem", "name", "version", "declared_version", "line_start"])

    return files.select(F.col("repo_id").cast("string").alias("repo_id"), "file_path", "ecosystem", "content").mapInPandas(walk, SCHEMA)


def parse_manifests(files: DataFrame) -> DataFrame:
    """Package occurrences of all manifests: ``repo_id, manifest_path, ecosystem, name, version, declared_version, line_start``.

    ``files`` has ``repo_id, file_path, content``. Unreadable JSON gives no rows.
    """
    found = find_manifests(files.select("repo_id", "file_path", "content")).withColumn("name_", file_name(F.col("file_path")))

    def only(*names: str) -> DataFrame:
        return found.filter(F.col("name_").isin(*names))

    strip = lambda v: F.regexp_replace(v, r"^[^0-9]*", "")
    line, at = F.col("line"), F.col("line_no")
    toml = _sections(to_lines(only("Cargo.toml"))).filter(F.col("section").isin("dependencies", "dev-dependencies", "build-dependencies") & F.col("header").isNull())
    declared = F.coalesce(F.nullif(F.regexp_extract("line", r"^\s*[\w-]+\s*=\s*\"([^\"]*)\"", 1), F.lit("")), F.nullif(F.regexp_extract("line", r"\bversion\s*=\s*\"([^\"]*)\"", 1), F.lit("")), F.lit(""))
    cargo = _plain(toml, F.regexp_extract(line, r"^\s*([\w-]+)\s*=", 1), strip(declared), declared, at)

    lock = to_lines(only("Cargo.lock"))
    w = Window.partitionBy("repo_id", "file_path").orderBy("line_no")
    lock = lock.withColumn("block", F.sum((F.trim("line") == "[[package]]").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("block > 0")
    value = lambda k: F.max(F.nullif(F.regexp_extract("line", rf'^{k}\s*=\s*"([^"]*)"', 1), F.lit("")))
    lock = lock.groupBy("repo_id", "file_path", "ecosystem", "block").agg(value("name").alias("n"), value("version").alias("v"), F.min("line_no").alias("line_no"))
    cargo_lock = _plain(lock, F.col("n"), F.coalesce("v", F.lit("")), F.coalesce("v", F.lit("")), F.col("line_no"))

    sections = F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>")
    npm = only("package.json").select("repo_id", "file_path", "ecosystem", sections.alias("j"))
    both = F.map_entries(F.coalesce(F.col("j.dependencies"), F.create_map().cast("map<string,string>")))
    dev = F.map_entries(F.coalesce(F.col("j.devDependencies"), F.create_map().cast("map<string,string>")))
    npm = npm.select("repo_id", "file_path", "ecosystem", F.explode(F.concat(both, dev)).alias("e"))
    package = _plain(npm, F.col("e.key"), strip(F.col("e.value")), F.col("e.value"), F.lit(1))

    locked = only("package-lock.json")
    v2 = locked.select("repo_id", "file_path", "ecosystem", F.from_json("content", "packages map<string,struct<version:string>>").alias("j"))
    v2 = v2.select("repo_id", "file_path", "ecosystem", F.explode("j.packages").alias("k", "e")).filter("k <> ''")
    package_lock = _plain(v2, F.element_at(F.split("k", "node_modules/"), -1), F.coalesce("e.version", F.lit("")), F.coalesce("e.version", F.lit("")), F.lit(1))

    req = to_lines(only("requirements.txt")).withColumn("line", F.trim(F.regexp_replace("line", r"(^|\s)#.*$", ""))).filter(~F.col("line").rlike(r"^(?:-|$)"))
    spec = r"^([A-Za-z0-9._-]+)(?:\[[^\]]*\])?\s*(?:(===|==|>=|<=|~=|!=|>|<)\s*([^,;\s]+))?"
    pip = _plain(req, F.regexp_extract(line, spec, 1), F.regexp_extract(line, spec, 3), F.concat(F.regexp_extract(line, spec, 2), F.regexp_extract(line, spec, 3)), at)

    go = to_lines(only("go.mod")).withColumn("m", F.regexp_extract("line", r"^\s*(?:require\s+)?([\w./~-]+\.[\w./~-]+)\s+v[0-9]", 1)).filter("m <> '' AND NOT line RLIKE '^\\\\s*(?:replace|exclude|retract|module)\\\\b'")
    ver = F.regexp_extract("line", r"\sv([0-9][^\s]*)", 1)
    go_mod = _plain(go, F.col("m"), ver, F.concat(F.lit("v"), ver), at)

    pom = only("pom.xml").select("repo_id", "file_path", "ecosystem", F.explode(F.regexp_extract_all("content", F.lit(r"(?s)<dependency>(.*?)</dependency>"), F.lit(1))).alias("d"))
    tag = lambda t: F.trim(F.regexp_extract("d", rf"(?s)<{t}>\s*([^<]*)</{t}>", 1))
    pom = pom.filter(~tag("version").contains("${") & (tag("artifactId") != ""))
    maven = _plain(pom, F.concat(tag("groupId"), F.lit(":"), tag("artifactId")), tag("version"), tag("version"), F.lit(1))
    out = cargo
    for part in (cargo_lock, package, package_lock, pip, go_mod, maven, _tree(locked)):
        out = out.unionByName(part)
    return out


def select_occurrences(packages: DataFrame) -> DataFrame:
    """Occurrences to look up: of supported lock files, and of manifests without such a lock file beside them."""
    name = file_name(F.col("manifest_path"))
    folder = F.regexp_replace("manifest_path", r"[^/]*$", "")
    locked = packages.filter(name.isin(*COMPANIONS)).select("repo_id", F.concat(folder, _map(COMPANIONS, name)).alias("manifest_path")).distinct()
    open_ = packages.filter(name.isin(*COMPANIONS) | ~name.isin(*LOCKS))
    return open_.join(locked, ["repo_id", "manifest_path"], "left_anti")


def report_location(occurrences: DataFrame, packages: DataFrame) -> DataFrame:
    """Adds ``report_path, report_line``: of a lock file's entry the companion manifest's entry of that name, if any, else its own."""
    name = file_name(F.col("manifest_path"))
    folder = F.regexp_replace("manifest_path", r"[^/]*$", "")
    rows = occurrences.withColumn("__path", F.when(name.isin(*COMPANIONS), F.concat(folder, _map(COMPANIONS, name))))
    there = packages.groupBy("repo_id", F.col("manifest_path").alias("__path"), "name", "ecosystem").agg(F.min("line_start").alias("__line"))
    out = rows.join(there, ["repo_id", "__path", "name", "ecosystem"], "left")
    found = F.col("__line").isNotNull()
    return out.withColumns({"report_path": F.when(found, F.col("__path")).otherwise(F.col("manifest_path")), "report_line": F.coalesce("__line", "line_start")}).drop("__path", "__line")


def audit_packages(packages: DataFrame, advisories: DataFrame, most: int = 1 << 20) -> DataFrame:
    """Occurrences that an advisory range covers. ``advisories`` has ``advisory_id, ecosystem, name, introduced`` and ``fixed`` or ``last_affected``.

    ``introduced`` of ``0`` means from the start. Versions compare by the rules of their ecosystem. Ranges meet the distinct versions of a package, not its occurrences, and
    only in the bins of first numbers that they reach, so a package with many versions and ranges has no join of all with all. A version whose occurrences
    and ranges make more than ``most`` rows is cut into slices of its occurrences, and tasks are as many as rows and slices ask for: a task's
    work does not grow with the result, which may be quadratic in the tables.
    """
    if "last_affected" not in advisories.columns:
        advisories = advisories.withColumn("last_affected", F.lit(None).cast("string"))
    key = lambda c: version_key(F.col(c), F.col("ecosystem"))
    start = F.when(F.col("introduced") == "0", "").otherwise(F.coalesce(key("introduced"), F.lit("")))
    a = advisories.withColumns({"__lo": start, "__hi": key("fixed"), "__last": key("last_affected")})
    v = packages.filter("version <> ''").groupBy("ecosystem", "name", "version").agg(F.count("*").alias("__n")).withColumn("__v", key("version")).withColumn("__bin", version_bin(F.col("__v")))
    bins = v.groupBy("ecosystem", "name").agg(F.collect_set("__bin").alias("__bins"))
    upper = version_bin(F.coalesce("__hi", "__last", F.lit("~")))
    a = a.join(bins, ["ecosystem", "name"]).withColumn("__bin", F.explode(F.filter("__bins", lambda b: (b >= version_bin(F.col("__lo"))) & (b <= upper)))).drop("__bins")
    below = F.coalesce(F.col("__v") < F.col("__hi"), F.col("__v") <= F.col("__last"), F.lit(True))
    hit = v.join(a, ["ecosystem", "name", "__bin"]).filter((F.col("__lo") <= F.col("__v")) & below)
    hit = materialize(hit.drop("__v", "__lo", "__hi", "__last", "__bin"), "audit")
    same = ["ecosystem", "name", "version"]
    pairs = F.first("__n") * F.count("*")
    sizes = materialize(hit.groupBy(*same).agg(pairs.alias("__pairs"), F.ceil(pairs / most).cast("int").alias("__slices")), "audit-sizes")
    tasks = max(1, -(-(sizes.agg(F.sum("__pairs")).first()[0] or 0) // most))
    spread = F.pmod(F.xxhash64(*packages.columns), F.col("__slices")).cast("int")
    rows = packages.join(sizes.drop("__pairs"), same).withColumn("__slice", spread).drop("__slices").repartition(tasks, *same, "__slice")
    hit = hit.drop("__n").join(sizes.drop("__pairs"), same).withColumn("__slice", F.explode(F.sequence(F.lit(0), F.col("__slices") - 1))).drop("__slices").repartition(tasks, *same, "__slice")
    return rows.join(hit, [*same, "__slice"]).drop("__slice")


def with_upgrade(found: DataFrame) -> DataFrame:
    """Adds ``fix_summary`` and ``fix_guidance`` to audited occurrences (``name, version, manifest_path, declared, snippet, fixed_versions``)."""
    c = F.col
    return found.withColumns(
        {
            "fix_summary": upgrade_summary(c("name"), c("version"), c("fixed_versions")),
            "fix_guidance": upgrade_guidance(c("name"), c("version"), c("manifest_path"), c("declared"), c("snippet"), c("fixed_versions")),
        }
    )


def fixed_versions(advisories: DataFrame) -> DataFrame:
    """Adds ``fixed_versions`` (in order, distinct) and ``recommended`` to OSV rows for ``name``: of affected entries of that package or none."""
    mine = F.filter("affected", lambda a: a["package"]["name"].isNull() | (a["package"]["name"] == F.col("name")))
    events = F.flatten(F.transform(mine, lambda a: F.flatten(F.transform(F.coalesce(a["ranges"], F.array()), lambda r: r["events"]))))
    fixed = F.array_distinct(F.filter(F.transform(events, lambda e: e["fixed"]), lambda v: v.isNotNull()))
    return advisories.withColumn("fixed_versions", fixed).withColumn("recommended", F.try_element_at("fixed_versions", F.lit(1)))


def advisory_urls(advisories: DataFrame) -> DataFrame:
    """Adds ``urls``: the advisory's own and those that its id and GHSA and CVE aliases stand for, without repeats."""
    own = F.transform(F.coalesce("references", F.expr("slice(references, 1, 0)")), lambda r: r["url"])
    ids = F.concat(F.array("id"), F.coalesce("aliases", F.array().cast("array<string>")))
    ghsa = F.transform(F.filter(ids, lambda x: x.startswith("GHSA-")), lambda x: F.concat(F.lit("https://github.com/advisories/"), x))
    cve = F.transform(F.filter(ids, lambda x: x.startswith("CVE-")), lambda x: F.concat(F.lit("https://nvd.nist.gov/vuln/detail/"), x))
    return advisories.withColumn("urls", F.array_union(F.array_union(F.coalesce(own, F.array().cast("array<string>")), ghsa), cve))
