"""Lexical scopes of source files: comments and strings are blanked, and braces or indentation give a tree of nested line intervals.

One walk over a file's tokens by a small scanner, in tasks, without a shuffle; declarations, end lines and enclosing scopes are then found with
column functions on the row.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.catalogue import SYMBOLS
from tessera.operators.text import lines_of

KEYS = ["repo_id", "file_path"]
DOUBLE, SINGLE = r'"(?:[^"\\\n]|\\.)*"?', r"'(?:[^'\\\n]|\\.)*'?"
SLASHES = (r"//[^\n]*", r"/\*.*?(?:\*/|\Z)")
CHAR = r"'(?:\\[^\n']+|[^'\\\n])'"
#: Comments and strings of each language, tried in order; an open string ends with its line, unless its kind runs on.
BLANKED = {
    "python": (r"#[^\n]*", r'"""(?:[^\\]|\\.)*?(?:"""|\Z)', r"'''(?:[^\\]|\\.)*?(?:'''|\Z)", DOUBLE, SINGLE),
    "rust": (*SLASHES, r'r(#*)".*?(?:"\1|\Z)', r'"(?:[^"\\]|\\.)*(?:"|\Z)', CHAR),
    "go": (*SLASHES, r"`[^`]*(?:`|\Z)", DOUBLE, CHAR),
    "java": (*SLASHES, r'"""(?:[^\\]|\\.)*?(?:"""|\Z)', DOUBLE, CHAR),
    "javascript": (*SLASHES, r"`(?:[^`\\]|\\.)*(?:`|\Z)", DOUBLE, SINGLE),
    "ruby": (r"#[^\n]*", DOUBLE, SINGLE),
    "shell": (r"(?<![\w$])#[^\n]*", r'"(?:[^"\\]|\\.)*(?:"|\Z)', r"'[^']*(?:'|\Z)"),
    "php": (r"#(?!\[)[^\n]*", *SLASHES, r'"(?:[^"\\]|\\.)*(?:"|\Z)', r"'(?:[^'\\]|\\.)*(?:'|\Z)"),
    "c": (*SLASHES, DOUBLE, CHAR),
}
BLANKED |= {"typescript": BLANKED["javascript"], "kotlin": BLANKED["java"], "scala": BLANKED["java"], "swift": BLANKED["java"], "csharp": BLANKED["c"], "cpp": BLANKED["c"]}
#: Languages whose blocks are not in braces.
INDENTED, UNSCOPED = ("python",), ("ruby", "shell")
MARKS = re.compile(r"[{}();\n]|[^\s{}();]+")
HEADER = re.compile(r"(?:async\s+)?(?:def|class)\b")
SCOPE = "array<struct<head_line:int,start_line:int,end_line:int,depth:int>>"


@cache
def _blanked(language: str) -> re.Pattern:
    return re.compile("|".join(f"(?:{p})" for p in BLANKED[language]), re.S)


def blank(text: str, language: str) -> str:
    """``text`` with comments and strings as blanks; line breaks stay."""
    return _blanked(language).sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def braced(masked: str) -> list[tuple[int, int, int, int]]:
    """``(head, start, end, depth)`` of each brace pair: where its statement begins, where it opens and closes. One that stays open ends with the file."""
    out, stack, line, head, parens = [], [], 1, None, 0
    for m in MARKS.finditer(masked):
        t = m[0]
        if t == "\n":
            line += 1
        elif t == "{":
            stack.append((head or line, line, parens))
            head, parens = None, 0
        elif t == "}":
            head = None
            if stack:
                first, start, parens = stack.pop()
                out.append((first, start, line, len(stack)))
        elif t == ";":
            head = head if parens else None
        else:
            head = head or line
            parens = max(0, parens + (t == "(") - (t == ")"))
    out += [(first, start, line, k) for k, (first, start, _) in enumerate(stack)]
    return sorted(out)


def indented(masked: str) -> list[tuple[int, int, int, int]]:
    """The same for blocks by indentation: a logical line that ends with a colon, or declares, and the deeper lines below it."""
    out, stack, last, depth, start = [], [], 0, 0, None
    for k, line in enumerate(masked.split("\n"), 1):
        code = line.strip()
        if not code:
            continue
        if start is None:
            start, indent, first = k, len(line.expandtabs()) - len(line.expandtabs().lstrip()), code
        depth = max(0, depth + sum(map(code.count, "([{")) - sum(map(code.count, ")]}")))
        if depth == 0 and not code.endswith("\\"):
            while stack and stack[-1][0] >= indent:
                out.append((stack[-1][1], stack.pop()[2], last, len(stack)))
            if code.endswith(":") or HEADER.match(first):
                stack.append((indent, start, k))
            start = None
        last = k
    while stack:
        out.append((stack[-1][1], stack.pop()[2], last, len(stack)))
    return sorted(out)


def with_scopes(files: DataFrame) -> DataFrame:
    """Adds ``masked``, the content with comments and strings as blanks, and ``scopes``, its blocks as ``(head_line, start_line, end_line, depth)``.

    Other columns stay. Files of other languages keep their content and have no scopes; a null content stays null.
    """
    names = files.columns
    if {"masked", "scopes"} & set(names):
        files = files.drop("masked", "scopes")
        names = files.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masked, scopes = [], []
            for text, language in zip(batch.column("content").to_pylist(), batch.column("language").to_pylist(), strict=True):
                if text is not None and language in BLANKED:
                    text = blank(text, language)
                    found = [] if language in UNSCOPED else indented(text) if language in INDENTED else braced(text)
                else:
                    found = []
                masked.append(text)
                scopes.append([dict(zip(("head_line", "start_line", "end_line", "depth"), s, strict=True)) for s in found])
            shape = pa.list_(pa.struct([(c, pa.int32()) for c in ("head_line", "start_line", "end_line", "depth")]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(masked, pa.string()), pa.array(scopes, shape)], [*names, "masked", "scopes"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(run, f"{fields}, masked string, scopes {SCOPE}")


def _declared(line: Column, symbols: dict[str, list[tuple[str, str]]]) -> Column:
    """``(kind, name)`` by the first pattern of the row's language that matches."""
    found = F.lit(None).cast("struct<kind:string,name:string>")
    for language, patterns in sorted(symbols.items()):
        tests = [F.when(line.rlike(p), F.struct(F.lit(k).alias("kind"), F.regexp_extract(line, p, 1).alias("name"))) for k, p in patterns]
        found = F.when(F.col("language") == language, F.coalesce(*tests)).otherwise(found)
    return found


def _found_in(files: DataFrame, symbols: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """``repo_id, file_path, language, content, x, found`` of each file: its masked lines, and its declarations in order of lines."""
    rows = with_scopes(files.filter(F.col("language").isin(*symbols)).select(*KEYS, "language", "content"))
    rows = rows.withColumn("x", lines_of(F.col("masked")))
    found = F.transform("x", lambda v, i: F.struct((i + 1).alias("line_no"), v.alias("line"), _declared(v, symbols).alias("s")))
    rows = rows.withColumn("found", F.filter(found, lambda d: d["s"].isNotNull() & (d["s"]["name"] != "")))

    def end_of(d: Column, i: Column) -> Column:
        after = F.coalesce(F.get("found", i + 1)["line_no"], F.lit(1 << 30))
        mine = F.filter("scopes", lambda s: (s["head_line"] <= d["line_no"]) & (s["start_line"] >= d["line_no"]) & (s["start_line"] < after))
        return F.coalesce(F.get(mine, F.lit(0))["end_line"], d["line_no"])

    ends = F.transform("found", lambda d, i: F.struct(d["line_no"].alias("line_no"), d["line"].alias("line"), d["s"]["kind"].alias("kind"), d["s"]["name"].alias("name"), end_of(d, i).alias("end_line")))
    return rows.withColumn("found", ends).select(*KEYS, "language", "content", "x", "found")


def _innermost(first: Column, last: Column, strictly: bool) -> Column:
    """The last declaration of the row whose lines hold ``first`` to ``last``; null outside of all."""
    return F.try_element_at(F.filter("found", lambda o: ((o["line_no"] < first) if strictly else (o["line_no"] <= first)) & (o["end_line"] >= last)), F.lit(-1))


def _text(first: Column, last: Column) -> Column:
    return F.array_join(F.slice(lines_of(F.col("content")), first, last - first + 1), "\n")


def declarations(files: DataFrame, symbols: dict[str, list[tuple[str, str]]] | None = None, snippet: bool = False) -> DataFrame:
    """Declarations with their extent: ``repo_id, file_path, language, name, kind, line_no, line, end_line, parent, parent_kind``, and the ``snippet`` if asked for.

    A declaration owns the first block that opens at or below it before the next declaration, and ends with it; without a block it ends on its line.
    ``parent`` is the innermost declaration around it. What stands in comments or strings declares nothing. Each row is a file of its own.
    """
    rows = _found_in(files, symbols or SYMBOLS).select(*KEYS, "language", "content", "found", F.explode("found").alias("d"))
    first, last = F.col("d.line_no"), F.col("d.end_line")
    around = _innermost(first, last, True)
    more = [_text(first, last).alias("snippet")] if snippet else []
    return rows.select(
        *KEYS, "language", "d.name", "d.kind", "d.line_no", "d.line", "d.end_line", around["name"].alias("parent"), around["kind"].alias("parent_kind"), *more
    )


def scope_search(files: DataFrame, kind: str, name_regex: str = ".*") -> DataFrame:
    """Declarations of a ``kind``, or calls (``kind`` is ``call``), whose name matches, in all languages: ``repo_id, file_path, kind, name, start_line, end_line, inside, snippet``.

    ``inside`` is the innermost declaration around it. A call is a name before a parenthesis in code, unless its line declares that name; its snippet is the line. All of
    it is found inside the row of a file.
    """
    if kind != "call":
        hits = declarations(files, snippet=True).filter((F.col("kind") == kind) & F.col("name").rlike(name_regex))
        return hits.select(*KEYS, "kind", "name", F.col("line_no").alias("start_line"), "end_line", F.col("parent").alias("inside"), "snippet")
    rows = _found_in(files, SYMBOLS).select(*KEYS, "content", "found", F.posexplode("x").alias("k", "code")).filter(F.col("code").contains("("))
    calls = rows.select(*KEYS, "content", "found", (F.col("k") + 1).alias("start_line"), F.explode(F.regexp_extract_all("code", F.lit(r"(\w+)\s*\("), F.lit(1))).alias("name"))
    here = F.col("start_line")
    calls = calls.filter(F.col("name").rlike(name_regex) & ~F.exists("found", lambda d: (d["line_no"] == here) & (d["name"] == F.col("name"))))
    return calls.select(*KEYS, F.lit("call").alias("kind"), "name", "start_line", here.alias("end_line"), _innermost(here, here, False)["name"].alias("inside"), _text(here, here).alias("snippet"))
