"""Compare queries with their SQL in DuckDB, as rows with columns in order of name."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return round(v, 5)
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat() if hasattr(v, "hour") else v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return float(v) if v.__class__.__name__ == "Decimal" else v


def rows_of(records, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in records), key=str), sorted(names)


def compare(spark, root, query, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    want = rows_of(found.fetchall(), names)
    df = query(spark, root)
    got = rows_of([tuple(r) for r in df.collect()], df.columns)
    assert got[1] == want[1], (got[1], want[1])
    assert len(got[0]) == len(want[0]), (len(got[0]), len(want[0]))
    differ = [(g, w) for g, w in zip(got[0], want[0], strict=True) if g != w]
    assert not differ, differ[:3]
    return len(got[0])
