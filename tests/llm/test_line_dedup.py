from collections import Counter

from pyspark.sql import functions as F

from tessera.llm.line_dedup import html_lines, line_dedup, text_lines


def test_matches_brute_force(spark):
    rows = []
    for i in range(90):
        host = None if i % 11 == 0 else f"http://u@H{i % 3 if i % 2 else 0}.example:80/p?{i}"
        rows.append((i, host, f"Menu\n  body {i} \nMenu\nfooter {i % 3}\nrare {i % 20}\n\n"))
    rows += [rows[5], (200, "http://solo.example", "Menu\nx"), (201, "nohost", "Menu"), (202, "http://h0.example", None), (None, None, "")]
    df = spark.createDataFrame(rows, "page_id long, url string, text string").withColumn("host", F.lit("x")).withColumn("key", F.lit(1))
    got = line_dedup(df, lines=text_lines(F.col("text")), salts=3).collect()
    host = lambda u: u.split("//")[1].split("/")[0].split("@")[-1].split(":")[0].lower() if u and "//" in u else None
    lines = lambda t: [x.strip() for x in (t or "").split("\n") if x.strip()]
    total, seen = Counter(host(u) for _, u, _ in rows), Counter((host(u), x) for _, u, t in rows for x in set(lines(t)))
    want = []
    for i, u, t in rows:
        keep = [x for x in lines(t) if host(u) is None or not (seen[host(u), x] >= 3 and seen[host(u), x] > 0.3 * total[host(u)])]
        want.append((i, host(u), len(lines(t)), len(keep), "\n".join(keep)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert any(w[2] != w[3] for w in want)
    assert line_dedup(df.limit(0), lines=text_lines(F.col("text"))).count() == 0


def test_html_lines(spark):
    html = '<html><head><title>T x</title><style>p{a}</style><script>var t="</p>";</script></head><body><!-- c --><p>a <b>b</b><br>c</p><ul><li>d</li></ul></body></html>'
    df = spark.createDataFrame([(html,), (None,), ("",)], "html string").select(html_lines(F.col("html")).alias("x"))
    assert [r["x"] for r in df.collect()] == [["T x", "a b", "c", "d"], [], []]
