"""Detection jobs: rule scans, secrets, taint flows and reconnaissance, each one pass over files or lines."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.columns import assigned_variable, file_matches, fingerprint, is_test_path, looks_secret, shannon_entropy
from tessera.operators import catalogue
from tessera.operators.catalogue import Rule
from tessera.operators.text import around, in_test_code, lines_of, to_lines

KEYS = ["repo_id", "file_path"]


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _matching(rules: list[Rule], text: Column, extra) -> Column:
    """Ids of the rules whose guards and pattern are met: one expression of literal patterns, so each is compiled once."""
    low = F.lower(text)
    tests = []
    for r in rules:
        guard = _any([low.contains(g) for g in r.guards]) if r.guards else F.lit(True)
        tests.append(F.when(extra(r) & guard & text.rlike(r.pattern), F.lit(r.rule_id)))
    return F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")


def _rule_columns(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``severity, cwe_id, fix`` of ``rule_id`` from a broadcast table of the rules."""
    rows = [(r.rule_id, r.severity, r.cwe_id, r.fix) for r in rules]
    dim = df.sparkSession.createDataFrame(rows, "rule_id string, severity string, cwe_id string, fix string")
    return df.join(F.broadcast(dim), "rule_id")


def _findings(hits: DataFrame, rules: list[Rule], source: str) -> DataFrame:
    found = _rule_columns(hits, rules)
    return found.select(
        *KEYS, "rule_id", "severity", F.lit("high").alias("confidence"), "cwe_id", F.concat(F.lit("["), "cwe_id", F.lit("] "), F.translate("rule_id", "-", " ")).alias("title"),
        F.lit(source).alias("source"), F.col("line_no").alias("line_start"), "snippet", "fix", fingerprint(F.col("rule_id"), F.col("file_path"), F.col("line_no").cast("string")).alias("fingerprint"),
    )


MARKS = "array<struct<line_no:int,rules:array<int>>>"


def _guarded_lines(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """Files ``(repo_id, file_path, language, content)`` that hold a guard of some rule, with ``marks``: the lines with one and the rules that these guards are for.

    One automaton of all guards walks over a content once, so the time doesn't grow with the number of rules; the patterns are tested later, where a guard was found.
    """
    of: dict[str, list[int]] = {}
    for k, r in enumerate(rules):
        for g in r.guards:
            of.setdefault(g, []).append(k)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = ahocorasick.Automaton()
        for g, ks in of.items():
            words.add_word(g, ks)
        words.make_automaton()
        kind = pa.list_(pa.struct([("line_no", pa.int32()), ("rules", pa.list_(pa.int32()))]))
        for batch in batches:
            keep, marks = [], []
            for i, text in enumerate(batch.column("content")):
                low = (text.as_py() or "").lower()
                hits = [(end, ks) for end, ks in words.iter(low)] if low else []
                if not hits:
                    continue
                lines: dict[int, set[int]] = {}
                breaks = np.flatnonzero(np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32) == 10)
                for line, (_, ks) in zip((np.searchsorted(breaks, [end for end, _ in hits]) + 1).tolist(), hits, strict=True):
                    lines.setdefault(line, set()).update(ks)
                keep.append(i)
                marks.append([{"line_no": n, "rules": sorted(ks)} for n, ks in sorted(lines.items())])
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(marks, kind)], [*kept.schema.names, "marks"])

    shape = files.select(*KEYS, "language", "content")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in shape.schema)
    return shape.mapInArrow(run, f"{fields}, marks {MARKS}")


def scan_code_rules(files: DataFrame, rules: list[Rule] | None = None, skip_tests: bool = True) -> DataFrame:
    """Findings of code rules in ``files (repo_id, file_path, language, content)``.

    A rule without languages is for every file, also of unknown language. Test files, and lines inside test code, are left out.
    Each row is a file of its own, also where paths repeat or are null. Lines, marks of test code and snippets are found inside
    the row, so nothing is shuffled; only lines that hold some guard go on, with the rules of their guards.
    """
    rules = catalogue.CODE_RULES if rules is None else rules
    if skip_tests:
        files = files.filter(~F.coalesce(is_test_path(F.col("file_path")), F.lit(False)))
    guarded, by_file = [r for r in rules if r.mode == "line" and r.guards], [r for r in rules if r.mode == "file"]
    unguarded = [r for r in rules if r.mode == "line" and not r.guards]

    def spoken(r: Rule) -> Column:
        return F.coalesce(F.col("language").isin(*r.languages), F.lit(False)) if r.languages else F.lit(True)

    def in_lines(base: DataFrame) -> DataFrame:
        """Adds the lines, and whether each is inside test code."""
        tests = F.when(F.lit(skip_tests) & (F.col("language") == "rust") & F.col("content").contains("#["), in_test_code(F.col("lines")))
        return base.withColumn("lines", lines_of(F.col("content"))).withColumn("tests", tests).drop("content")

    snippet = F.array_join(around(F.col("lines"), F.col("line_no"), 2, 2), "\n").alias("snippet")
    outside = ~F.coalesce(F.get("tests", F.col("line_no") - 1), F.lit(False))
    found = []
    if guarded:
        rows = in_lines(_guarded_lines(files, guarded)).select(*KEYS, "language", "lines", "tests", F.explode("marks").alias("m"))
        rows = rows.select(*KEYS, "language", "lines", "tests", F.col("m.line_no").alias("line_no"), F.get("lines", F.col("m.line_no") - 1).alias("line"), F.explode("m.rules").alias("r"))
        met = F.when(F.lit(False), False)
        for k, r in enumerate(guarded):
            met = met.when(F.col("r") == k, spoken(r) & F.col("line").rlike(r.pattern))
        name = F.get(F.array(*[F.lit(r.rule_id) for r in guarded]), F.col("r"))
        found.append(rows.filter(met & outside).select(*KEYS, "line_no", name.alias("rule_id"), snippet))
    if unguarded:
        rows = in_lines(files.select(*KEYS, "language", "content")).select(*KEYS, "language", "lines", "tests", F.posexplode("lines").alias("k", "line")).withColumn("line_no", F.col("k") + 1)
        found.append(rows.filter(outside).select(*KEYS, "line_no", F.explode(_matching(unguarded, F.col("line"), spoken)).alias("rule_id"), snippet))
    if by_file:
        base = files.select(*KEYS, "language", "content", lines_of(F.col("content")).alias("lines"))
        found.append(base.select(*KEYS, F.lit(1).alias("line_no"), F.explode(_matching(by_file, F.col("content"), spoken)).alias("rule_id"), F.array_join(F.slice(F.col("lines"), 1, 3), "\n").alias("snippet")))
    return _findings(reduce(DataFrame.unionByName, found), rules, "static")


def scan_config_rules(files: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Findings of configuration rules: by line in matching files, by whole file, and rules whose pattern is absent (at line 1).

    One pass: a path is held against the file patterns once, and lines are tested inside the file's row, so neither the content nor the rules
    are laid out again for every line, and no generated method holds all patterns (the JVM compiles none of more than 8,000 bytes).
    """
    rules = catalogue.CONFIG_RULES if rules is None else rules
    kinds = sorted({r.files for r in rules})
    named = F.array(*[file_matches(F.col("file_path"), list(k)) for k in kinds]).cast("array<boolean>")
    here = lambda r: F.get("named", F.lit(kinds.index(r.files)))
    base = files.filter(file_matches(F.col("file_path"), sorted({f for k in kinds for f in k})))
    # what is generated is computed once, however often later columns name it
    base = base.select(*KEYS, "content", F.explode(F.array(named)).alias("named")).withColumn("lines", lines_of(F.col("content")))
    by_line = [r for r in rules if r.mode == "line"]
    hit = lambda line_no, rule, whole: F.struct(line_no.alias("line_no"), rule.alias("rule_id"), F.lit(whole).alias("whole"))
    marks = F.flatten(F.transform("lines", lambda line, k: F.transform(_matching(by_line, line, here), lambda r: hit(k + 1, r, False))))
    whole = [F.when(here(r) & (F.col("content").rlike(r.pattern) == F.lit(r.mode == "file")), F.lit(r.rule_id)) for r in rules if r.mode != "line"]
    if whole:
        marks = F.concat(marks, F.transform(F.array_compact(F.array(*whole)), lambda r: hit(F.lit(1), r, True)))
    hits = base.select(*KEYS, "lines", F.explode(marks).alias("m")).select(*KEYS, "lines", "m.*")
    shown = F.when(F.col("whole"), F.slice("lines", 1, 12)).otherwise(around(F.col("lines"), F.col("line_no"), 2, 2))
    hits = hits.select(*KEYS, "line_no", "rule_id", F.array_join(shown, "\n").alias("snippet"))
    return _findings(hits, rules, "config").withColumn("fix", config_fix(F.col("rule_id"), F.col("fix")))


def config_fix(rule_id: Column, own: Column) -> Column:
    """Advice by the class of a configuration rule; of a rule in no class its own text."""
    out = F.when(F.lit(False), own)
    for parts, text in catalogue.CONFIG_FIXES:
        out = out.when(_any([rule_id.contains(p) for p in parts]), text)
    return out.otherwise(own)


def scan_absent(files: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Files in which the pattern of an ``absent`` rule is nowhere: ``repo_id, file_path, rule_id``."""
    rules = [r for r in (catalogue.CONFIG_RULES if rules is None else rules) if r.mode == "absent"]
    tests = [F.when(file_matches(F.col("file_path"), list(r.files)) & ~F.col("content").rlike(r.pattern), F.lit(r.rule_id)) for r in rules]
    return files.select(*KEYS, F.explode(F.array_compact(F.array(*tests))).alias("rule_id"))


#: Assignment to a name that suggests a secret.
SECRET_NAME = (
    r"(?i)(?:api[_-]?key|secret(?:[_-]?key)?|(?:access|refresh)?[_-]?token|password|passwd|(?:private|access)[_-]?key|client[_-]?secret|encryption[_-]?(?:key|iv)|credential|bearer|session[_-]?secret)\s*[:=]"
)
QUOTED = r"[\"']([^\"'\\\n]{20,})[\"']"


def scan_secrets(files: DataFrame, mask: bool = True) -> DataFrame:
    """Findings of secrets in files with a language: the first quoted literal that looks like one, on lines that assign to such a name.

    The literal is masked but for four characters, unless ``mask`` is off.
    """
    lines = to_lines(files.filter("language IS NOT NULL").select(*KEYS, "content")).filter(F.col("line").rlike(SECRET_NAME))
    measured = F.transform(F.regexp_extract_all("line", F.lit(QUOTED), F.lit(1)), lambda x: F.struct(x.alias("literal"), shannon_entropy(x).alias("entropy")))
    found = F.try_element_at(F.filter(measured, lambda m: looks_secret(m["literal"], m["entropy"])), F.lit(1))
    hits = lines.withColumn("m", found).filter("m IS NOT NULL").select("*", "m.*")
    shown = F.concat(F.substring("literal", 1, 4), F.repeat(F.lit("*"), F.length("literal") - 4)) if mask else F.col("literal")
    return hits.select(
        *KEYS, F.col("line_no").alias("line_start"), F.lit("high").alias("severity"), F.lit("medium").alias("confidence"), F.lit("CWE-798").alias("cwe_id"), F.lit("static").alias("source"),
        F.lit("hardcoded-secret").alias("rule_id"), shown.alias("literal"), F.round("entropy", 6).alias("entropy"),
        fingerprint("hardcoded-secret", F.col("file_path"), F.col("line_no").cast("string")).alias("fingerprint"),
    )


def _patterns(table: dict[str, list[tuple[str, str]]], line: Column) -> Column:
    """``(pattern, category)`` of a line's matches in its language."""
    out = F.array().cast("array<struct<pattern:string,category:string>>")
    for language, entries in sorted(table.items()):
        tests = F.array_compact(F.array(*[F.when(line.contains(p), F.struct(F.lit(p).alias("pattern"), F.lit(c).alias("category"))) for p, c in entries]))
        out = F.when(F.col("language") == language, tests).otherwise(out)
    return out


TAINTED = "array<struct<variable:string,source_line:int>>"


def _first_of_each(sorted_rows: Column) -> Column:
    """Of rows in order of ``variable`` the first of each."""
    return F.aggregate(sorted_rows, F.array().cast(TAINTED), lambda acc, r: F.when(F.try_element_at(acc, F.lit(-1))["variable"].eqNullSafe(r["variable"]), acc).otherwise(F.concat(acc, F.array(r))))


def _spread(seeds: Column, assigned: Column, rounds: int) -> Column:
    """``(variable, source_line)`` of all names that ``seeds`` taint through ``assigned (line, variable)``: a fixed point inside the row.

    Each round only looks for names that the round before has added; a name keeps what it was first tainted by.
    """

    def step(s: Column, _: Column) -> Column:
        reaching = lambda a: F.filter(s["fresh"], lambda f: F.contains(a["line"], f["variable"]) & (a["variable"] != f["variable"]))
        reached = F.flatten(F.transform(assigned, lambda a: F.transform(reaching(a), lambda f: F.struct(a["variable"].alias("variable"), f["source_line"].alias("source_line")))))
        new = F.filter(reached, lambda r: ~F.exists(s["known"], lambda t: t["variable"] == r["variable"]) & ~F.exists(s["fresh"], lambda t: t["variable"] == r["variable"]))
        return F.struct(F.concat(s["known"], s["fresh"]).alias("known"), _first_of_each(F.array_sort(new)).alias("fresh"))

    start = F.struct(F.array().cast(TAINTED).alias("known"), seeds.alias("fresh"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda s: F.concat(s["known"], s["fresh"]))


def taint_flows(files: DataFrame, rounds: int = 10, sources: dict | None = None, sinks: dict | None = None) -> DataFrame:
    """Flows inside files: ``repo_id, file_path, language, source_line, sink_line, sink_pattern, category, variable``.

    A line with a source taints the variable it assigns (a variable seeded more than once keeps the last such line). A line that assigns and holds a tainted name taints its variable too,
    for up to ``rounds`` rounds. A sink line that holds a tainted name is one flow for each sink pattern, from the tainted name with the least source line, then name. The order of lines is not looked at.
    Each row is a file of its own, also where repository or path are null or repeat: all of it is found inside the row, and nothing is shuffled.
    """
    sources, sinks = sources or catalogue.SOURCES, sinks or catalogue.SINKS
    rows = files.filter(F.col("language").isin(*{*sources, *sinks})).select(*KEYS, "language", lines_of(F.col("content")).alias("x"))
    seen = F.transform("x", lambda v, i: F.struct((i + 1).alias("line_no"), v.alias("line"), (F.size(_patterns(sources, v)) > 0).alias("from"), _patterns(sinks, v).alias("to"), assigned_variable(v).alias("variable")))
    rows = rows.select(*KEYS, "language", F.filter(seen, lambda m: m["from"] | (F.size(m["to"]) > 0) | m["variable"].isNotNull()).alias("m"))
    seeds = F.transform(F.filter("m", lambda m: m["from"] & m["variable"].isNotNull()), lambda m: F.struct(m["variable"].alias("variable"), (-m["line_no"]).alias("source_line")))
    rows = rows.withColumn("seeds", F.transform(_first_of_each(F.array_sort(seeds)), lambda s: F.struct(s["variable"].alias("variable"), (-s["source_line"]).alias("source_line"))))
    rows = rows.filter("size(seeds) > 0").withColumn("assigned", F.filter("m", lambda m: m["variable"].isNotNull())).withColumn("ends", F.filter("m", lambda m: F.size(m["to"]) > 0)).filter("size(ends) > 0")
    rows = rows.select(*KEYS, "language", "ends", _spread(F.col("seeds"), F.col("assigned"), rounds).alias("tainted"))
    rows = rows.select(*KEYS, "language", "tainted", F.explode("ends").alias("e"))
    held = F.filter("tainted", lambda t: F.contains(F.col("e.line"), t["variable"]))
    least = F.array_min(F.transform(held, lambda t: F.struct(t["source_line"].alias("source_line"), t["variable"].alias("variable"))))
    rows = rows.select(*KEYS, "language", F.col("e.line_no").alias("sink_line"), least.alias("t"), F.explode("e.to").alias("s")).filter("t IS NOT NULL")
    return rows.select(*KEYS, "language", "t.source_line", "sink_line", F.col("s.pattern").alias("sink_pattern"), F.col("s.category").alias("category"), "t.variable")


def taint_findings(flows: DataFrame) -> DataFrame:
    """Flows as findings, with severity and CWE by the sink's category."""
    pick = lambda m: F.try_element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), F.col("category"))
    return flows.select(
        *KEYS, F.concat(F.lit("taint-"), "category").alias("rule_id"), pick(catalogue.SINK_SEVERITY).alias("severity"), F.lit("medium").alias("confidence"), pick(catalogue.SINK_CWE).alias("cwe_id"),
        F.format_string("Value of %s from line %d reaches %s", "variable", "source_line", "sink_pattern").alias("title"), F.lit("taint").alias("source"), F.col("sink_line").alias("line_start"),
        fingerprint("taint", F.col("file_path"), F.col("source_line").cast("string"), F.col("sink_line").cast("string"), F.col("sink_pattern")).alias("fingerprint"),
    )


def keyword_hits(lines: DataFrame, keywords: list[str], n: int = 3, cap: int | None = 80) -> DataFrame:
    """The first ``n`` lines of each file that hold a keyword (any case), with ``rank``; at most ``cap`` for a repository."""
    low = F.lower("line")
    found = F.array_compact(F.array(*[F.when(low.contains(k.lower()), F.lit(k)) for k in keywords]))
    hits = lines.select(*KEYS, "line_no", "line", F.explode(found).alias("keyword"))
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy(*KEYS, "keyword").orderBy("line_no"))).filter(F.col("rank") <= n)
    return hits if cap is None else _capped(hits, cap, "file_path", "keyword", "line_no")


def _capped(df: DataFrame, cap: int, *order: str) -> DataFrame:
    w = Window.partitionBy("repo_id").orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= cap).drop("__k")


#: Literals that tell a route declaration.
ROUTES = (
    "@app.route", "@app.get", "@app.post", "@router.", "@blueprint.", "app.get(", "app.post(", "app.put(", "app.delete(", "router.get(", "router.post(", "router.put(", "router.delete(", ".route(",
    "@GetMapping", "@PostMapping", "@PutMapping", "@DeleteMapping", "@RequestMapping", "http.HandleFunc", "mux.HandleFunc", "Route::get", "Route::post", "#[get(", "#[post(", "HandleFunc(", "path(",
)
#: Patterns of environment access, and of database libraries, in order of preference.
ENV_USE = ("os.environ", "os.getenv", "process.env", "std::env::var", "env::var", "os.Getenv", "System.getenv", "ENV[")
DATABASES = ("sqlalchemy", "psycopg", "sqlx", "diesel", "mongoose", "mongodb", "sequelize", "prisma", "typeorm", "knex", "gorm", "database/sql", "hibernate", "jdbc", "redis", "sqlite", "django.db")


def find_routes(lines: DataFrame, cap: int = 100) -> DataFrame:
    return _capped(lines.filter(_any([F.col("line").contains(r) for r in ROUTES])), cap, "file_path", "line_no")


def first_pattern_hits(lines: DataFrame, patterns: tuple[str, ...], each: int, cap: int) -> DataFrame:
    """For each file, the first pattern of the list that it holds, and up to ``each`` lines with it."""
    tests = F.array_compact(F.array(*[F.when(F.col("line").contains(p), F.lit(k)) for k, p in enumerate(patterns)]))
    hits = lines.select(*KEYS, "line_no", "line", F.explode(tests).alias("k"))
    hits = hits.withColumn("least", F.min("k").over(Window.partitionBy(*KEYS))).filter("k = least")
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy(*KEYS).orderBy("line_no"))).filter(F.col("rank") <= each)
    return _capped(hits.withColumn("pattern", F.get(F.array(*[F.lit(p) for p in patterns]), F.col("k"))).drop("least", "k"), cap, "file_path", "line_no")


#: Endings and parts of names of configuration files.
CONFIG_NAMES = (".env", ".ini", ".cfg", ".conf", ".toml", ".properties", "config", "settings")


def config_hits(lines: DataFrame) -> DataFrame:
    """Lines that read the environment, and the first line of files with a configuration-like name."""
    named = lines.filter((F.col("line_no") == 1) & _any([F.lower("file_path").contains(n) for n in CONFIG_NAMES]))
    named = named.select(*KEYS, "line_no", "line", F.lit(1).alias("rank"), F.lit("config file").alias("pattern"))
    used = first_pattern_hits(lines, ENV_USE, 5, 30)
    return _capped(used.unionByName(named.join(used.select(*KEYS).distinct(), KEYS, "left_anti")), 30, "file_path", "line_no")


def db_hits(lines: DataFrame) -> DataFrame:
    return first_pattern_hits(lines, DATABASES, 3, 30)


#: Marks of a technology: (label, part of a path) and (label, part of a content).
PATH_MARKS = (("docker", "Dockerfile"), ("compose", "docker-compose"), ("terraform", ".tf"), ("github-actions", ".github/workflows"), ("gitlab-ci", ".gitlab-ci"), ("npm", "package.json"), ("cargo", "Cargo.toml"), ("go-modules", "go.mod"), ("maven", "pom.xml"), ("gradle", "build.gradle"), ("pip", "requirements.txt"), ("poetry", "pyproject.toml"))
CONTENT_MARKS = (("flask", "from flask"), ("django", "django"), ("fastapi", "fastapi"), ("express", "express("), ("react", "from 'react'"), ("spring", "springframework"), ("gin", "gin-gonic"), ("axum", "axum::"), ("actix", "actix_web"), ("graphql", "graphql"), ("grpc", "grpc"), ("jwt", "jwt"))


def tech_stack(files: DataFrame, top: int = 5) -> DataFrame:
    """``repo_id, label, n``: the ``top`` languages by files, and every mark that some file has."""
    w = Window.partitionBy("repo_id").orderBy(F.col("n").desc(), "label")
    langs = files.filter("language IS NOT NULL").groupBy("repo_id", F.col("language").alias("label")).agg(F.count("*").alias("n"))
    langs = langs.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= top).drop("k")
    marks = [F.when(F.col("file_path").contains(p), F.lit(x)) for x, p in PATH_MARKS] + [F.when(F.col("content").contains(p), F.lit(x)) for x, p in CONTENT_MARKS]
    found = files.select("repo_id", F.explode(F.array_distinct(F.array_compact(F.array(*marks)))).alias("label"))
    return langs.unionByName(found.groupBy("repo_id", "label").agg(F.count("*").alias("n")))


def manifest_excerpts(files: DataFrame, names: list[str], n: int = 2000) -> DataFrame:
    return files.filter(file_matches(F.col("file_path"), names)).select(*KEYS, F.substring("content", 1, n).alias("excerpt"))


def pack_context(items: DataFrame, budgets: dict[str, int], total: int) -> DataFrame:
    """One row for each repository: the sections' items in order, as long as budgets last, and how many were left out.

    ``items`` has ``repo_id, section, pos, text``. A section keeps its items up to the first that exceeds its budget of
    characters; sections go in the order of ``budgets`` until the ``total`` is exceeded.
    """
    place = F.try_element_at(F.create_map(*[F.lit(x) for k, s in enumerate(budgets) for x in (s, k)]), F.col("section"))
    budget = F.try_element_at(F.create_map(*[F.lit(x) for kv in budgets.items() for x in kv]), F.col("section"))
    w = Window.partitionBy("repo_id", "section").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = items.withColumns({"place": place, "budget": budget}).filter("place IS NOT NULL").withColumn("run", F.sum(F.length("text")).over(w))
    sections = rows.groupBy("repo_id", "section", "place").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("run") <= F.col("budget"), F.struct("pos", "text")))), lambda x: x["text"]), "\n").alias("text"),
        F.count_if(F.col("run") > F.col("budget")).alias("omitted"), F.coalesce(F.sum(F.when(F.col("run") <= F.col("budget"), F.length("text"))), F.lit(0)).alias("used"),
    )
    v = Window.partitionBy("repo_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    body = F.concat(F.lit("## "), "section", F.lit("\n"), "text", F.when(F.col("omitted") > 0, F.format_string("\n(%d omitted)", "omitted")).otherwise(""))
    kept = sections.withColumn("all", F.sum("used").over(v)).filter(F.col("all") <= total)
    return kept.groupBy("repo_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", body.alias("b")))), lambda x: x["b"]), "\n\n").alias("context"))
