import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.columns import upgraded_snippet
from tessera.functions.versions import version_bin, version_key
from tessera.operators.packages import audit_packages, with_upgrade

ORDER = {
    "npm": ["0.0.1-alpha", "0.0.1", "0.9.9", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.2.0", "1.10.0", "2.0.0-0", "2.0.0-1.x", "2.0.0", "10.0.0"],
    "crates.io": ["0.1.0-pre.9", "0.1.0-pre.10", "0.1.0", "0.1.1+build.5", "0.2.0"],
    "Go": ["v0.0.0-20190101000000-abcdefabcdef", "v0.0.0-20200101000000-abcdefabcdef", "v0.0.1", "v1.2.3-rc1", "v1.2.3", "v2.0.0+incompatible", "v20190101.0.0"],
    "PyPI": ["1.0.dev456", "1.0a1.dev1", "1.0a1", "1.0a2.dev456", "1.0a12.dev456", "1.0a12", "1.0b1.dev456", "1.0b2", "1.0b2.post345.dev456", "1.0b2.post345", "1.0rc1.dev456", "1.0rc1", "1.0", "1.0+abc.5", "1.0.post456.dev34", "1.0.post456", "1.0.15", "1.1.dev1", "1.10", "2013.10", "1!0.5", "1!1.0"],
    "Maven": ["1.0-alpha-1", "1.0-alpha-2", "1.0-beta-1", "1.0-milestone-1", "1.0-rc1", "1.0-snapshot", "1.0", "1.0-sp", "1.0-jre", "1.0.1-rc1", "1.0.1", "1.1", "1.10", "2.0-alpha", "2"],
    "RubyGems": ["1.0.a", "1.0.b1", "1.0.rc1", "1.0.rc2", "1.0", "1.0.1.pre", "1.0.1", "1.1", "1.10.0", "2"],
}
SAME = {"npm": [("v1.2.3", "1.2.3"), ("1.2", "1.2.0"), ("1.0.0+a", "1.0.0")], "PyPI": [("1.0", "1.0.0"), ("1.0alpha1", "1.0.a1"), ("1.0-1", "1.0.post1"), ("v1.0RC1", "1.0c1"), ("1.0-rev2", "1.0.r2")], "Maven": [("1", "1.0.0"), ("1.0.GA", "1"), ("1.0-Final", "1.0"), ("1.0-alpha1", "1.0-ALPHA-1"), ("1-cr1", "1-rc-1")], "RubyGems": [("1", "1.0.0"), ("1.a", "1.0.a")]}


@pytest.mark.parametrize("ecosystem", sorted(ORDER))
def test_keys_sort_like_versions(spark, ecosystem):
    def keys(versions):
        df = spark.createDataFrame([(k, v, ecosystem) for k, v in enumerate(versions)], "k int, v string, e string")
        return [(r["x"], r["b"]) for r in df.select("k", version_key(F.col("v"), F.col("e")).alias("x")).withColumn("b", version_bin(F.col("x"))).orderBy("k").collect()]

    got = keys(ORDER[ecosystem])
    wrong = [(a, b) for (a, x), (b, y) in zip(zip(ORDER[ecosystem], got, strict=True), list(zip(ORDER[ecosystem], got, strict=True))[1:], strict=False) if not x[0] < y[0] or x[1] > y[1]]
    assert not wrong, wrong
    for a, b in SAME.get(ecosystem, []):
        x, y = keys([a, b])
        assert x == y, (a, b, x, y)


def test_ranges_against_all_pairs(spark):
    rng = random.Random(3)
    version = lambda: f"{rng.randint(0, 3)}.{rng.randint(0, 12)}.{rng.randint(0, 3)}"
    pkgs = [(k, "npm", rng.choice("ab"), version() if k % 9 else "") for k in range(300)] + [(900, "PyPI", "a", "1.0rc1"), (901, "npm", "c", None)]
    advs = [(f"A{k}", "npm", rng.choice("abz"), rng.choice(["0", version()]), *rng.choice([(version(), None), (None, version()), (None, None)])) for k in range(120)] + [("P", "PyPI", "a", "1.0b1", "1.0", None)]
    packages = spark.createDataFrame(pkgs, "occurrence_id int, ecosystem string, name string, version string")
    advisories = spark.createDataFrame(advs, "advisory_id string, ecosystem string, name string, introduced string, fixed string, last_affected string")
    num = lambda v: tuple(map(int, v.split(".")))
    want = {(900, "P")}
    for i, e, n, v in pkgs[:300]:
        for a, ae, an, lo, hi, last in advs[:120]:
            if v and (e, n) == (ae, an) and (lo == "0" or num(lo) <= num(v)) and (num(v) < num(hi) if hi else num(v) <= num(last) if last else True):
                want.add((i, a))
    got = [(r["occurrence_id"], r["advisory_id"]) for r in audit_packages(packages, advisories).collect()]
    assert sorted(got) == sorted(want) and len(got) == len(set(got))
    assert audit_packages(packages, advisories.drop("last_affected").limit(0)).count() == 0


def test_a_package_with_thousands_of_versions_and_ranges_joins_by_bins(spark):
    n = 3000
    packages = spark.range(n).select(F.lit("npm").alias("ecosystem"), F.lit("hot").alias("name"), F.concat("id", F.lit(".0.0")).alias("version"))
    advisories = spark.range(n).select(F.col("id").cast("string").alias("advisory_id"), F.lit("npm").alias("ecosystem"), F.lit("hot").alias("name"), F.concat("id", F.lit(".0.0")).alias("introduced"), F.concat(F.col("id") + 1, F.lit(".0.0")).alias("fixed"))
    assert audit_packages(packages, advisories).count() == n


def test_a_version_with_many_occurrences_and_ranges_is_cut_into_slices(spark):
    packages = spark.range(40).select("id", F.lit("npm").alias("ecosystem"), F.lit("hot").alias("name"), F.when(F.col("id") < 30, "1.0.0").otherwise("9.0.0").alias("version"))
    advisories = spark.range(20).select(F.col("id").cast("string").alias("advisory_id"), F.lit("npm").alias("ecosystem"), F.lit("hot").alias("name"), F.lit("0").alias("introduced"), F.lit("2.0.0").alias("fixed"))
    found = audit_packages(packages, advisories, most=50)
    assert sorted((r["id"], int(r["advisory_id"])) for r in found.collect()) == [(i, a) for i in range(30) for a in range(20)]
    assert len([n for n in found.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]) > 3


def test_upgrade_texts(spark):
    rows = [("a", "1.2", "p.json", "^1.2", '"a": "^1.2", "b": "^1.2"', ["1.3"]), ("b", "1.0", "r.txt", "", "b", ["2.0", "3.0"]), ("c", "1", "r.txt", "==1", "c==1", []), ("d", "1", "r.txt", None, "d", None)]
    got = with_upgrade(spark.createDataFrame(rows, "name string, version string, manifest_path string, declared string, snippet string, fixed_versions array<string>")).orderBy("name").collect()
    assert [r["fix_summary"].split(".")[0] + "." for r in got[2:]] == ["No fixed version was published for `c` `1` in the OSV response.", "No fixed version was published for `d` `1` in the OSV response."]
    assert got[0]["fix_summary"] == "Upgrade `a` from `1.2` to `1.3`."
    assert got[1]["fix_summary"] == "Upgrade `b` from `1.0` to a fixed release. Suggested target: `2.0`. Other known fixed versions: 2.0, 3.0."
    assert got[0]["fix_guidance"].endswith('// Replace with:\n"a": "^1.3", "b": "^1.2"') and got[1]["fix_guidance"].endswith("Set `b` to `2.0` in the manifest entry.")
    assert got[2]["fix_guidance"].startswith("// `c` `1` is vulnerable in `r.txt`.")
    one = spark.createDataFrame([("x", "(1.0", "x (1.0) $", "2")], "p string, d string, s string, t string")
    assert one.select(upgraded_snippet(*map(F.col, "pdst"))).first()[0] == "x (2) $"
