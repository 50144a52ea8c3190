"""The queries that are registered, and the SQL that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import detect
from tessera.plans.fixtures import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, views: str = "", sql: str = "") -> Callable[[Query], Query]:
    """Register a query and, where there is one, its SQL over the fixture views ``fx_<view>``."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = with_views(views, sql)
        return f

    return add


#: Lines of all files, of whose content a last line break is no line.
LINES = r"""
raw0 AS (SELECT *, replace(content, chr(13) || chr(10), chr(10)) AS c0 FROM fx_files),
raw AS (SELECT doc_id, repo_id, file_path, language, CASE WHEN c0 LIKE '%' || chr(10) THEN left(c0, length(c0) - 1) ELSE c0 END AS c, coalesce(content, '') AS content FROM raw0),
arr AS (SELECT *, CASE WHEN content = '' THEN [] ELSE string_split(c, chr(10)) END AS x FROM raw),
lines AS (SELECT repo_id, file_path, language, unnest(range(1, len(x) + 1)) AS line_no, unnest(x) AS line FROM arr)
"""
SECRET_SQL = rf"""WITH {LINES},
cand AS (SELECT repo_id, file_path, line_no, regexp_extract_all(line, '["'']([^"''\\\n]{{20,}})["'']', 1) AS lits FROM lines
  WHERE language IS NOT NULL AND regexp_matches(line, '{detect.SECRET_NAME}')),
lit AS (SELECT repo_id, file_path, line_no, unnest(lits) AS l, generate_subscripts(lits, 1) AS k FROM cand),
ent AS (SELECT repo_id, file_path, line_no, k, l, -sum(n / length(l) * log2(n / length(l))) AS e
  FROM (SELECT repo_id, file_path, line_no, k, l, ch, CAST(count(*) AS DOUBLE) AS n FROM (SELECT *, unnest(string_split(l, '')) AS ch FROM lit) GROUP BY ALL) GROUP BY ALL),
ok AS (SELECT *, row_number() OVER (PARTITION BY file_path, line_no ORDER BY k) AS r FROM ent
  WHERE strlen(l) >= 24 AND NOT regexp_matches(l, '^/|^\./|^\.\./|://|[?&\\ \t]|/.*/') AND e >= 3.5
    AND NOT regexp_matches(l, '(?i)^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[1-5][0-9a-f]{{3}}-[89ab][0-9a-f]{{3}}-[0-9a-f]{{12}}$')
    AND (CAST(regexp_matches(l, '[a-z]') AS INT) + CAST(regexp_matches(l, '[A-Z]') AS INT) + CAST(regexp_matches(l, '[0-9]') AS INT) + CAST(regexp_matches(l, '[+/=_-]') AS INT) >= 3
      OR (regexp_matches(l, '^[0-9a-fA-F]+$') AND strlen(l) >= 32)))
SELECT file_path, CAST(line_no AS INT) AS line_start, left(l, 4) || repeat('*', length(l) - 4) AS literal, round(e, 4) AS entropy, sha256('hardcoded-secret:' || file_path || ':' || line_no) AS fingerprint FROM ok WHERE r = 1"""
