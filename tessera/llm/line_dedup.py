"""Boilerplate lines by their frequency within a site.

Lines are counted once a page and host; a line that stands on too large a share of its host's pages is
dropped from all of them. Counts are pre-aggregated before the shuffle, and the lines meet the list of
dropped ones in ``salts`` parts of each key, so that neither a large host nor a line that stands on all
of its pages fills one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.scratch import materialize

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)"


def host_of(url: Column) -> Column:
    """The lower-case host of an absolute URL, else null."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def html_lines(html: Column) -> Column:
    """Visible lines of a page: block elements break lines, other tags vanish; trimmed, none empty."""
    s = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", "")
    s = F.regexp_replace(s, r"(?i)</?(?:p|div|li|ul|ol|h[1-6]|br|tr|td|table|article|nav|footer|header|section|title|head|body|html)(?:[ /][^>]*)?>", "\n")
    return text_lines(F.regexp_replace(s, r"<[^>]*>", ""))


def text_lines(text: Column) -> Column:
    """Lines of a text, trimmed of blanks; none empty."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[\r\n]+"), lambda x: F.trim(x)), lambda x: x != "")


def boilerplate(lines: DataFrame, pages: DataFrame, max_ratio: float, min_pages: int, salts: int) -> DataFrame:
    """Lines to drop, ``host, h1, h2, pages, host_pages``, from ``lines (host, h1, h2)``, each once a page, and ``pages (host)``.

    The lines of a host meet its total in ``salts`` parts.
    """
    totals = pages.groupBy("host").agg(F.count("*").alias("host_pages")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    often = lines.groupBy("host", "h1", "h2").agg(F.count("*").alias("pages")).filter(F.col("pages") >= min_pages)
    often = often.withColumn("part", F.pmod("h1", F.lit(salts)).cast("int"))
    return often.join(totals, ["host", "part"]).drop("part").filter(F.col("pages") > max_ratio * F.col("host_pages"))


def line_dedup(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    lines: Column | None = None,
    max_ratio: float = 0.3,
    min_pages: int = 3,
    salts: int = 32,
) -> DataFrame:
    """One row for each row of ``pages``: ``page_id, host, n_lines, n_kept, text`` (kept lines, joined by line breaks).

    lines: array of a page's lines, by default the visible lines of column ``html``. A line goes when it
    stands on at least ``min_pages`` pages of a host and on more than ``max_ratio`` of them; both bounds are
    on pages, however often a page repeats it. Pages without a host (null or relative url) keep all lines. A null page has no lines and
    an empty text. Each row is a page, also where ids or whole rows repeat. Other columns are ignored; an
    empty table gives no rows.
    """
    lines = html_lines(F.col("html")) if lines is None else lines
    base = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), lines.alias("lines"))
    # rows that agree in all of these have one result; written once, as the lines are dear to find
    base = base.withColumn("key", F.xxhash64("page_id", "host", "lines")).withColumn("key2", F.xxhash64(F.lit(1), "page_id", "host", "lines"))
    base = materialize(base, "page-lines")
    sited = base.filter("host IS NOT NULL")
    # two 64-bit hashes stand for a line, so that its text is not shuffled
    both = [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")]
    counted = sited.select("host", F.explode(F.array_distinct("lines")).alias("line")).select("host", *both)
    drop = boilerplate(counted, sited, max_ratio, min_pages, salts).select("host", "h1", "h2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    placed = sited.select("key", "key2", "host", F.posexplode("lines").alias("pos", "line")).select(
        "key", "key2", "host", "pos", *both, F.pmod("key", F.lit(salts)).cast("int").alias("salt")
    )
    gone = placed.join(drop, ["host", "h1", "h2", "salt"], "left_semi").groupBy("key", "key2").agg(F.collect_set("pos").alias("gone"))
    left = F.array_except(F.expr("sequence(0, size(lines) - 1)"), F.col("gone"))
    out = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(left, lambda i: F.get("lines", i)))
    return (
        base.join(gone, ["key", "key2"], "left")
        .withColumn("out", out)
        .select(
            "page_id",
            "host",
            F.size("lines").cast("long").alias("n_lines"),
            F.size("out").cast("long").alias("n_kept"),
            F.array_join("out", "\n").alias("text"),
        )
    )
