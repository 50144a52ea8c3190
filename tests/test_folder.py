import os

from pyspark.sql.datasource import EqualTo, IsNotNull, LessThan, StringEndsWith

from tessera.operators.detect import scan_secrets
from tessera.sources.folder import FolderReader, FolderStream, read_folder, stream_folder


def make(root, files):
    for name, data in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)


def test_only_files_that_meet_the_conditions_are_planned(tmp_path):
    make(tmp_path, {f"d{k % 3}/f{k}.{'py' if k % 2 else 'go'}": b"x" * k for k in range(20)})
    reader = FolderReader({"path": str(tmp_path), "partitionBytes": str(3 << 16)})
    rest = list(reader.pushFilters([StringEndsWith(("file_path",), ".py"), IsNotNull(("content",)), LessThan(("byte_size",), 10), EqualTo(("content",), "a")]))
    assert [type(f) for f in rest] == [IsNotNull, EqualTo]
    parts = reader.partitions()
    assert sorted(f.path for p in parts for f in p.files) == sorted(f"d{k % 3}/f{k}.py" for k in (1, 3, 5, 7, 9))
    assert [len(p.files) for p in parts] == [2, 2, 1]


def test_reads_what_the_corpus_reader_reads(spark, tmp_path):
    make(tmp_path, {"a/x.py": b"print(1)\n", "a/__init__.py": b"", "build/z.py": b"1", "a/b/c.go": b"package c", ".env": b"K=1", "b.bin": b"\xff\xfe", "big.txt": b"x" * ((1 << 20) + 1), "n.txt": "é".encode()})
    os.symlink(tmp_path / "a" / "x.py", tmp_path / "ln.py")
    os.symlink(tmp_path, tmp_path / "a" / "loop")
    got = read_folder(spark, str(tmp_path)).collect()
    assert sorted((r["file_path"], r["byte_size"], r["content"], r["language"]) for r in got) == [("a/__init__.py", 0, "", "python"), ("a/b/c.go", 9, "package c", "go"), ("a/x.py", 9, "print(1)\n", "python"), ("n.txt", 2, "é", None)]
    some = read_folder(spark, str(tmp_path)).filter("file_path LIKE 'a/%' AND byte_size > 0 AND content LIKE 'print%'")
    assert [r["file_path"] for r in some.collect()] == ["a/x.py"]
    (tmp_path / "empty").mkdir()
    assert read_folder(spark, str(tmp_path / "empty")).count() == 0


def test_a_stream_reads_each_landing_file_once(spark, tmp_path):
    root, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    make(root, {"a.py": b'token = "abcdefGHIJKLmnopqrstuvwxyz0123"\n', "b.py": b"x = 1\n"})
    for more in ({}, {"c.py": b'secret = "ABCDEFghijklMNOPQRSTUVWXYZ0123"\n'}):
        make(root, more)
        rows = stream_folder(spark, str(root)).selectExpr("'r' AS repo_id", "file_path", "language", "content")
        q = scan_secrets(rows).select("file_path", "line_start").writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(once=True).start()
        q.awaitTermination()
    assert sorted((r["file_path"], r["line_start"]) for r in spark.read.parquet(out).collect()) == [("a.py", 1), ("c.py", 1)]
    stream = FolderStream({"path": str(root)})
    assert stream.partitions(stream.latestOffset(), stream.latestOffset()) == [] and sum(len(p.files) for p in stream.partitions(stream.initialOffset(), stream.latestOffset())) == 3
