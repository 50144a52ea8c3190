"""Files to lines, and excerpts around a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import language_of


def lines_of(content: Column) -> Column:
    """Array of lines: one trailing line break makes no line, and a carriage return before a break is dropped (one at the end of a last line without a break is not)."""
    return F.when(F.coalesce(content, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.split(F.regexp_replace(F.replace(content, F.lit("\r\n"), F.lit("\n")), r"\n\z", ""), "\n")
    )


def with_language(files: DataFrame, path_col: str = "file_path") -> DataFrame:
    return files.withColumn("language", language_of(F.col(path_col)))


def with_file_stats(files: DataFrame, content_col: str = "content") -> DataFrame:
    """Adds ``content_hash, line_count, byte_size``."""
    c = F.coalesce(F.col(content_col), F.lit(""))
    return files.withColumns(
        {"content_hash": F.sha2(c, 256), "line_count": F.size(lines_of(c)), "byte_size": F.octet_length(c)}
    )


def to_lines(files: DataFrame, content_col: str = "content") -> DataFrame:
    """One row a line, ``line_no`` from 1 and ``line``, without the content."""
    keep = [c for c in files.columns if c not in (content_col, "line_no", "line")]
    return files.select(*keep, F.posexplode(lines_of(F.col(content_col))).alias("k", "line")).select(*keep, (F.col("k") + 1).alias("line_no"), "line")


def around(lines: Column, line_no: Column, before: int, after: int) -> Column:
    """The lines from ``before`` above to ``after`` below."""
    start = F.greatest(F.lit(1), line_no - before)
    return F.slice(lines, start, line_no + after - start + 1)


def with_snippet(hits: DataFrame, lines_col: str = "lines", line_col: str = "line_no", n: int = 2) -> DataFrame:
    """Adds ``snippet``: ``n`` lines to either side of the hit, joined by line breaks."""
    return hits.withColumn("snippet", F.array_join(around(F.col(lines_col), F.col(line_col), n, n), "\n"))


def leading_excerpt(files: DataFrame, n: int = 12, content_col: str = "content") -> DataFrame:
    """Adds ``excerpt`` of the first ``n`` lines and ``excerpt_end``, its last line (null for an empty file)."""
    x = lines_of(F.col(content_col))
    k = F.least(F.size(x), F.lit(n))
    return files.withColumns({"excerpt": F.array_join(F.slice(x, 1, n), "\n"), "excerpt_end": F.when(k > 0, k)})


#: Lines before and after, for each use of a numbered excerpt.
EXCERPTS = {"patch": (8, 12), "review": (5, 5), "verdict": (15, 16), "symbol": (0, 59)}


def numbered_excerpt(hits: DataFrame, use: str, lines_col: str = "lines", line_col: str = "line_no") -> DataFrame:
    """Adds ``excerpt``, whose lines carry their numbers."""
    before, after = EXCERPTS[use]
    part = around(F.col(lines_col), F.col(line_col), before, after)
    first = F.greatest(F.lit(1), F.col(line_col) - before)
    return hits.withColumn("excerpt", F.array_join(F.transform(part, lambda x, i: F.format_string("%5d | %s", first + i, x)), "\n"))


def window_snippet(hits: DataFrame, lines_col: str = "lines", line_col: str = "line_no", before: int = 12, after: int = 18, most: int = 240) -> DataFrame:
    """Adds ``window`` of ``(number, text, line_truncated)``, ``truncated`` and ``original_line_count``.

    A line of more than ``most`` bytes is cut at a character and ends with `` …``. A focus beyond the end counts as the last line.
    """
    x = F.col(lines_col)
    focus = F.greatest(F.lit(1), F.least(F.col(line_col), F.size(x)))
    first = F.greatest(F.lit(1), focus - before)
    part = F.slice(x, first, focus + after - first + 1)

    def clip(line: Column) -> Column:
        sizes = F.transform(F.sequence(F.lit(0), F.least(F.length(line), F.lit(most))), lambda k: F.struct(k.alias("k"), F.octet_length(F.substr(line, F.lit(1), k)).alias("n")))
        fits = F.array_max(F.transform(F.filter(sizes, lambda s: s["n"] <= most), lambda s: s["k"]))
        return F.when(F.octet_length(line) <= most, line).otherwise(F.concat(F.substr(line, F.lit(1), fits), F.lit(" …")))

    window = F.transform(part, lambda v, i: F.struct((first + i).alias("number"), clip(v).alias("text"), (F.octet_length(v) > most).alias("line_truncated")))
    return hits.withColumns({"window": window, "truncated": F.size(part) < F.size(x), "original_line_count": F.size(x)})


def in_test_code(lines: Column) -> Column:
    """For each of an array of lines, whether it is test code: braces opened since the last ``#[cfg(test)]`` within 30 lines are not all closed, or one of the 5 lines before is ``#[test]``.

    One walk over the array; nothing leaves the row.
    """
    net = lambda x: F.length(F.regexp_replace(x, "[^{]", "")) - F.length(F.regexp_replace(x, "[^}]", ""))
    start = F.struct(F.lit(0).alias("k"), F.lit(-1000).alias("mark"), F.lit(0).alias("open"), F.lit(-1000).alias("test"), F.array().cast("array<boolean>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        here = x.contains("#[cfg(test)]")
        mark = F.when(here, s["k"]).otherwise(s["mark"])
        opened = F.when(here, net(x)).otherwise(s["open"] + net(x))
        inside = ((s["k"] - mark <= 30) & (opened > 0)) | (s["k"] - s["test"] <= 5)
        test = F.when(F.trim(x).startswith("#[test]"), s["k"]).otherwise(s["test"])
        return F.struct((s["k"] + 1).alias("k"), mark.alias("mark"), opened.alias("open"), test.alias("test"), F.concat(s["out"], F.array(inside)).alias("out"))

    return F.aggregate(lines, start, step, lambda s: s["out"])
