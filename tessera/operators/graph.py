"""Code search, symbols, imports and call edges, and walks over the call graph."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.columns import glob_matches
from tessera.operators.catalogue import BUILTINS, RISKY
from tessera.operators.scopes import declarations
from tessera.operators.text import lines_of
from tessera.plans.scratch import materialize

KEYS = ["repo_id", "file_path"]


def _compiles(query: str) -> bool:
    """Whether Java, which runs it, takes ``query`` as a regular expression."""
    from pyspark import SparkContext
    from pyspark.errors import IllegalArgumentException

    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(query)
    except IllegalArgumentException:
        return False
    return True


def search(files: DataFrame, query: str, glob: str | None = None, context: int = 2, regex: bool = True) -> DataFrame:
    """Lines that match: ``repo_id, file_path, line_no, line, before, after`` (arrays of up to ``context`` lines). With ``regex`` off, or where the query is no valid expression, it is plain text."""
    regex = regex and _compiles(query)
    if glob:
        files = files.filter(glob_matches(F.col("file_path"), glob))
    hit = (lambda c: c.rlike(query)) if regex else (lambda c: c.contains(query))
    rows = files.filter(F.col("content").rlike(query) if regex and "^" not in query and "$" not in query else F.lit(True)) if regex else files.filter(F.col("content").contains(query))
    rows = rows.select(*KEYS, lines_of(F.col("content")).alias("x"))
    places = F.filter(F.transform("x", lambda v, i: F.when(hit(v), i + 1)), lambda i: i.isNotNull())
    rows = rows.select(*KEYS, "x", F.explode(places).alias("line_no"))
    first = F.greatest(F.lit(1), F.col("line_no") - context)
    return rows.select(*KEYS, "line_no", F.get("x", F.col("line_no") - 1).alias("line"), F.slice("x", first, F.col("line_no") - first).alias("before"), F.slice("x", F.col("line_no") + 1, context).alias("after"))


def search_page(hits: DataFrame, n: int = 30) -> DataFrame:
    """The first ``n`` hits by file and line, with ``more``: how many follow."""
    total = hits.agg(F.count("*").alias("__n"))
    return hits.orderBy(*KEYS, "line_no").limit(n).crossJoin(F.broadcast(total)).withColumn("more", F.greatest(F.lit(0), F.col("__n") - n)).drop("__n")  # one row of totals


def read_file(files: DataFrame, path: str, most: int = 15_000) -> DataFrame:
    """A file's content, cut after ``most`` bytes (and any character that they end in) with a notice."""
    head = F.regexp_replace(F.decode(F.substring(F.encode("content", "utf-8"), 1, most), "utf-8"), "\ufffd+$", "")
    cut = F.when(F.octet_length("content") > most, F.concat(head, F.lit("\n... (cut)"))).otherwise(F.col("content"))
    return files.filter(F.col("file_path") == path).select(*KEYS, cut.alias("content"))


def list_files(files: DataFrame, directory: str = "", extension: str = "") -> DataFrame:
    found = files.filter(F.col("file_path").startswith(directory) & F.col("file_path").endswith(extension))
    return found.select(*KEYS, F.size(lines_of(F.col("content"))).alias("line_count")).orderBy(*KEYS)


def file_tree(files: DataFrame) -> DataFrame:
    return files.select(*KEYS).distinct().orderBy(*KEYS)


def _is_public(name: Column) -> Column:
    python, go = ~name.startswith("_"), name.rlike("^[A-Z]")
    marked = F.col("line").rlike(r"\b(?:pub|public|export)\b")
    lang = F.col("language")
    return F.when(lang == "python", python).when(lang == "go", go).when(lang.isin("rust", "java", "csharp", "javascript", "typescript", "php", "swift"), marked).otherwise(True)


def extract_symbols(files: DataFrame, symbols: dict[str, list[tuple[str, str]]] | None = None) -> DataFrame:
    """Declarations: ``repo_id, file_path, language, name, kind, line_no, end_line, parent, is_public, is_entry_point``.

    By line patterns of each language, of which the first that matches decides, on files whose comments and strings are blank; blocks give the last line
    and the declaration around it. A Python function is a method where a class is next around it. Entry points are functions named ``main`` (any case) or
    public functions of files whose path speaks of routes, handlers, an API or controllers.
    """
    rows = declarations(files, symbols)
    python = (F.col("language") == "python") & F.col("kind").isin("function", "method")
    rows = rows.withColumn("kind", F.when(python, F.when(F.col("parent_kind") == "class", "method").otherwise("function")).otherwise(F.col("kind")))
    public = _is_public(F.col("name"))
    callable_ = F.col("kind").isin("function", "method")
    entry = callable_ & ((F.lower("name") == "main") | (public & F.col("file_path").rlike("routes|handler|api|Controller")))
    return rows.select(*KEYS, "language", "name", "kind", "line_no", "end_line", "parent", public.alias("is_public"), entry.alias("is_entry_point"))


def structural_search(files: DataFrame, kind: str, name_regex: str = ".*") -> DataFrame:
    """Python syntax nodes of a kind (``FunctionDef``, ``Call``, ...) whose name matches: ``start_line, end_line, name, snippet``. Files that don't parse give none."""
    import re

    wanted = re.compile(name_regex)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for repo, path, text in zip(pdf["repo_id"], pdf["file_path"], pdf["content"], strict=True):
                try:
                    nodes = ast.walk(ast.parse(text or ""))
                except (SyntaxError, ValueError, RecursionError):
                    continue
                for node in nodes:
                    if type(node).__name__ == kind:
                        name = getattr(node, "name", None) or getattr(node, "id", None) or getattr(getattr(node, "func", None), "attr", None) or getattr(getattr(node, "func", None), "id", "")
                        if wanted.search(name):
                            out.append((repo, path, node.lineno, node.end_lineno, name, ast.get_source_segment(text, node)))
            yield pd.DataFrame(out, columns=["repo_id", "file_path", "start_line", "end_line", "name", "snippet"])

    rows = files.filter("language = 'python'").select(F.col("repo_id").cast("string").alias("repo_id"), "file_path", "content")
    return rows.mapInPandas(run, "repo_id string, file_path string, start_line int, end_line int, name string, snippet string")


def find_symbol(symbols: DataFrame, name: str, file_path: str | None = None) -> DataFrame:
    found = symbols.filter(F.col("name") == name)
    return found if file_path is None else found.filter(F.col("file_path") == file_path)


def symbols_in_file(symbols: DataFrame, file_path: str) -> DataFrame:
    return symbols.filter(F.col("file_path") == file_path).orderBy("line_no")


def entry_points(symbols: DataFrame) -> DataFrame:
    return symbols.filter("is_entry_point")


def exports(symbols: DataFrame) -> DataFrame:
    return symbols.filter("is_public")


def symbol_count(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("repo_id").agg(F.count("*").alias("n"))


def call_names(files: DataFrame) -> DataFrame:
    """Distinct names that look like calls in each file, without built-in ones of its language."""
    names = F.array_distinct(F.regexp_extract_all("content", F.lit(r"(\w+)\s*\("), F.lit(1)))
    rows = files.filter("language IS NOT NULL").select(*KEYS, "language", F.explode(names).alias("name"))
    known = files.sparkSession.createDataFrame([(k, x) for k, v in BUILTINS.items() for x in v], "language string, name string")
    return rows.join(F.broadcast(known), ["language", "name"], "left_anti").select(*KEYS, "name")


def call_edges(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """Edges ``repo_id, file_path, caller, callee, line_no``: every function of a file to every function of it that is called somewhere in the file. Null is a repository like any other."""
    file = F.struct(*KEYS).alias("file")  # a struct's null fields are equal
    functions = symbols.filter(F.col("kind").isin("function", "method")).select(file, "name", "line_no").distinct()
    callees = calls.select(file, "name").join(functions.select("file", "name").distinct(), ["file", "name"], "left_semi").withColumnRenamed("name", "callee")
    found = functions.withColumnRenamed("name", "caller").join(callees, "file").filter("caller <> callee")
    return found.select("file.*", "caller", "callee", "line_no")


def callers(edges: DataFrame, name: str) -> DataFrame:
    return edges.filter(F.col("callee") == name)


def callees(edges: DataFrame, name: str) -> DataFrame:
    return edges.filter(F.col("caller") == name)


def _repo(df: DataFrame) -> DataFrame:
    """Rows of a graph without repositories belong to one, null."""
    return df if "repo_id" in df.columns else df.withColumn("repo_id", F.lit(None).cast("string"))


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def call_degree(edges: DataFrame) -> DataFrame:
    """``repo_id, name, callers, callees`` of every name of each repository's graph."""
    e = _repo(edges)
    both = e.select("repo_id", F.col("caller").alias("name"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(e.select("repo_id", F.col("callee").alias("name"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return both.groupBy("repo_id", "name").agg(F.sum("i").alias("callers"), F.sum("o").alias("callees"))


def callers_summary(edges: DataFrame) -> DataFrame:
    """A line of sorted callers for each callee of a repository."""
    return _repo(edges).groupBy("repo_id", "callee").agg(F.array_join(F.sort_array(F.collect_set("caller")), ", ").alias("callers"))


#: Import patterns of each language; the first group that is set is the target.
IMPORTS = {
    "rust": (r"(?m)^use\s+([A-Za-z0-9_:]+)", r"(?m)^mod\s+([A-Za-z0-9_]+)"),
    "python": (r"(?m)^from\s+([A-Za-z0-9_.]+)\s+import\b", r"(?m)^import\s+([A-Za-z0-9_.]+)"),
    "javascript": (r"(?:import|require)\s*\(?['\"]([^'\"]+)['\"]", r"(?m)^import\s[^'\"\n]*\sfrom\s+['\"]([^'\"]+)['\"]"),
    "go": (r"\"([^\"]+)\"",),
    "java": (r"(?m)^import\s+(?:static\s+)?([A-Za-z0-9_.]+);",),
}
IMPORTS |= {"typescript": IMPORTS["javascript"], "kotlin": (r"(?m)^import\s+([A-Za-z0-9_.]+)",)}


def imports(files: DataFrame) -> DataFrame:
    """Distinct ``repo_id, file_path, target``."""
    found = F.array().cast("array<string>")
    for language, patterns in sorted(IMPORTS.items()):
        every = F.concat(*[F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in patterns])
        found = F.when(F.col("language") == language, every).otherwise(found)
    return files.filter(F.col("language").isin(*IMPORTS)).select(*KEYS, F.explode(F.array_distinct(found)).alias("target"))


def dependencies(edges: DataFrame, file_path: str) -> DataFrame:
    return edges.filter(F.col("file_path") == file_path).select("target").distinct()


def dependents(edges: DataFrame, target: str) -> DataFrame:
    return edges.filter(F.col("target") == target).select(*KEYS).distinct()


def import_summary(edges: DataFrame) -> DataFrame:
    """Files that import each target in a repository."""
    return edges.groupBy("repo_id", "target").agg(F.count("*").alias("n_files"))


def is_risky(name: Column) -> Column:
    out = F.lit(False)
    for w in RISKY:
        out = out | F.lower(name).contains(w)
    return out


def _distance_to(edges: DataFrame, risky: Column, depth: int) -> DataFrame:
    """``f_repo, f_node, far``: how many calls every node is from a risky name, up to ``depth``; ``edges`` has ``e_repo, caller, callee``."""
    front = edges.filter(risky).select(F.col("e_repo").alias("f_repo"), F.col("caller").alias("f_node")).distinct().withColumn("far", F.lit(1))
    known = front = materialize(front, "chain-far")
    for d in range(2, depth + 1):
        more = edges.join(front, _same("callee", "f_node") & _same("e_repo", "f_repo"), "left_semi").select(F.col("e_repo").alias("r"), F.col("caller").alias("n")).distinct()
        more = more.join(known, _same("r", "f_repo") & _same("n", "f_node"), "left_anti").select(F.col("r").alias("f_repo"), F.col("n").alias("f_node"), F.lit(d).alias("far"))
        front = materialize(more, "chain-far")
        if front.isEmpty():
            break
        known = known.unionByName(front)
    return known


def risk_chains(entries: DataFrame, edges: DataFrame, depth: int = 4, cap: int | None = 80, risky: Column | None = None) -> DataFrame:
    """Shortest call paths from ``entries (repo_id, name)`` to risky names of the same repository: ``repo_id, entry, target, depth, path``, breadth first.

    Of paths of one length to a node the one first in order of names is kept, so the frontier holds a node once for each entry. A walk back from the risky names, whose
    rows are nodes, says how far each node is from one; only nodes that can still get there are walked on.
    """
    risky = is_risky(F.col("callee")) if risky is None else risky
    e = _repo(edges).select(F.col("repo_id").alias("e_repo"), "caller", "callee").distinct()
    front = _repo(entries).select("repo_id", F.col("name").alias("entry"), F.col("name").alias("node"), F.array("name").alias("path")).distinct()
    e = materialize(e, "chain-edges")
    far = _distance_to(e, risky, depth)
    front = materialize(front.join(far, _same("node", "f_node") & _same("repo_id", "f_repo"), "left_semi"), "chain-start")
    seen, found = front.select("repo_id", "entry", "node"), None
    for d in range(1, depth + 1):
        step = front.join(e, _same("node", "caller") & _same("repo_id", "e_repo")).select("repo_id", "entry", "callee", F.concat("path", F.array("callee")).alias("path"))
        step = step.groupBy("repo_id", "entry", "callee").agg(F.min("path").alias("path"))
        past = seen.select(F.col("repo_id").alias("s_repo"), F.col("entry").alias("s_entry"), F.col("node").alias("s_node"))
        new = step.join(past, _same("repo_id", "s_repo") & _same("entry", "s_entry") & _same("callee", "s_node"), "left_anti")
        if d < depth:
            here = far.filter(F.col("far") <= depth - d)
            new = new.join(here, _same("callee", "f_node") & _same("repo_id", "f_repo"), "left").withColumn("on", F.col("far").isNotNull())
            new = materialize(new.filter(risky | F.col("on")).select("repo_id", "entry", "callee", "path", "on"), "chain")
        hits = new.filter(risky).select("repo_id", "entry", F.col("callee").alias("target"), F.lit(d).alias("depth"), F.array_join("path", " > ").alias("path"))
        found = hits if found is None else found.unionByName(hits)
        if d < depth:
            seen = seen.unionByName(new.select("repo_id", "entry", F.col("callee").alias("node")))
            front = new.filter("on").select("repo_id", "entry", F.col("callee").alias("node"), "path")
            if front.isEmpty():
                break
    return found if cap is None else found.orderBy("depth", "repo_id", "entry", "target").limit(cap)


def api_surface(symbols: DataFrame, edges: DataFrame, files: int = 30, each: int = 10) -> DataFrame:
    """The ``files`` files of a repository with most exports, and ``each`` exports of them with caller and callee counts and how many more there are."""
    n_in = edges.groupBy("repo_id", F.col("callee").alias("name")).agg(F.count("*").alias("callers"))
    n_out = edges.groupBy("repo_id", F.col("caller").alias("name")).agg(F.count("*").alias("callees"))
    public = exports(symbols)
    count = public.groupBy(*KEYS).agg(F.count("*").alias("exports"))
    count = count.withColumn("place", F.row_number().over(Window.partitionBy("repo_id").orderBy(F.col("exports").desc(), "file_path"))).filter(F.col("place") <= files)
    rows = public.join(count, KEYS).withColumn("k", F.row_number().over(Window.partitionBy(*KEYS).orderBy("line_no", "name"))).filter(F.col("k") <= each)
    rows = rows.join(n_in, ["repo_id", "name"], "left").join(n_out, ["repo_id", "name"], "left").na.fill(0, ["callers", "callees"])
    return rows.select(*KEYS, "place", "exports", "name", "kind", "callers", "callees", F.greatest(F.lit(0), F.col("exports") - each).alias("more"))


def entry_list(symbols: DataFrame, extra: int = 30, cap: int = 50) -> DataFrame:
    """Entry points, then up to ``extra`` other exports, at most ``cap`` a repository."""
    first = entry_points(symbols).select("repo_id", "file_path", "name", F.lit(0).alias("o")).distinct()
    other = exports(symbols).select("repo_id", "file_path", "name", F.lit(1).alias("o")).join(first.select("repo_id", "name"), ["repo_id", "name"], "left_anti").distinct()
    other = other.withColumn("k", F.row_number().over(Window.partitionBy("repo_id").orderBy("file_path", "name"))).filter(F.col("k") <= extra).drop("k")
    every = first.unionByName(other.select(*first.columns))
    return every.withColumn("k", F.row_number().over(Window.partitionBy("repo_id").orderBy("o", "file_path", "name"))).filter(F.col("k") <= cap).drop("k", "o")


def trace_callers(starts: DataFrame, edges: DataFrame, depth: int = 2, each: int = 20, cap: int | None = 200) -> DataFrame:
    """Callers of ``starts (repo_id, name)`` in their repository, level by level: ``repo_id, depth, caller, callee``. Of a function ``each`` callers at most, in order of name; each function once."""
    e = _repo(edges).select(F.col("repo_id").alias("e_repo"), "caller", "callee").distinct()
    # what more than one level reads is written once
    e = materialize(e.withColumn("k", F.row_number().over(Window.partitionBy("e_repo", "callee").orderBy("caller"))).filter(F.col("k") <= each).drop("k"), "trace-edges")
    front, found = materialize(_repo(starts).select("repo_id", F.col("name").alias("node")).distinct(), "trace"), None
    seen = front
    for d in range(1, depth + 1):
        step = front.join(e, _same("node", "callee") & _same("repo_id", "e_repo")).select("repo_id", F.lit(d).alias("depth"), "caller", "callee")
        step = materialize(step, "trace-step") if d < depth else step
        found = step if found is None else found.unionByName(step)
        past = seen.select(F.col("repo_id").alias("s_repo"), F.col("node").alias("s_node"))
        front = step.select("repo_id", F.col("caller").alias("node")).distinct().join(past, _same("repo_id", "s_repo") & _same("node", "s_node"), "left_anti")
        if d < depth:
            front = materialize(front, "trace")
            seen = seen.unionByName(front)
            if front.isEmpty():
                break
    return found if cap is None else found.orderBy("depth", "repo_id", "callee", "caller").limit(cap)


def trace_flows(files: DataFrame, symbols: DataFrame, edges: DataFrame, pattern: str, depth: int = 2) -> DataFrame:
    """``trace_callers`` from the functions of matching files that begin at or above a matching line."""
    hits = search(files, pattern, context=0).groupBy(*KEYS).agg(F.max("line_no").alias("last"))  # a function above some match is above the last
    above = symbols.filter(F.col("kind").isin("function", "method")).join(hits, KEYS).filter("line_no <= last")
    return trace_callers(above.select("repo_id", "name"), edges, depth)


def finding_callers(findings: DataFrame, symbols: DataFrame, edges: DataFrame, around: int = 5, each: int = 5) -> DataFrame:
    """Symbols within ``around`` lines of a finding and up to ``each`` callers: a range join inside one file."""
    near = findings.select("finding_id", *KEYS, "line_start").join(symbols.select(*KEYS, "name", "line_no"), KEYS)
    near = near.filter(F.col("line_no").between(F.col("line_start") - around, F.col("line_start") + around)).select("finding_id", "repo_id", "name").distinct()
    got = near.join(edges.select("repo_id", F.col("callee").alias("name"), "caller").distinct(), ["repo_id", "name"], "left")
    w = Window.partitionBy("finding_id", "name").orderBy("caller")
    return got.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= each).select("finding_id", "name", "caller")
