import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.registry import op3_token_table, tokenizer_path
from tessera.llm.token_table import Coder, ShardReader, ShardWriter, id_of, key_of, lookup, read_token_table, write_token_table

PLAIN = Tokenizer.from_file(tokenizer_path())
CODER = Coder(tokenizer_path(), most=2000)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", " \n", "a", "The", "don't", "'s", "é", "ñ.", "12", "!!", "\xa0", "​", "\x1c", "　", "<|endoftext|>", "😀", "x-y"]), max_size=20).map("".join))
def test_pieces_give_the_ids_of_whole_texts(text):
    assert np.frombuffer(CODER.encode([text])[0], CODER.kind).tolist() == PLAIN.encode(text, add_special_tokens=False).ids


def test_frequent_words_stay_in_a_bounded_memory():
    rng, coder, merged = random.Random(3), Coder(tokenizer_path(), most=200), []
    merge = coder.merge
    coder.merge = lambda shown: merged.append(shown) or merge(shown)
    for _ in range(60):
        text = "First often, häufig. " + " ".join("".join(rng.choices("abcdefé", k=9)) for _ in range(20)) + "\nnext line"
        assert np.frombuffer(coder.encode([text])[0], coder.kind).tolist() == PLAIN.encode(text, add_special_tokens=False).ids
    assert merged.count("Ġoften") == merged.count("First") == 1
    assert all(len(m.newer) + len(m.older) <= 200 for m in (coder.pieces, coder.letters)) and len(coder.words) <= 40


ODD = [" ", "  ", "\n", "\n\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u202f", "\u205f", "\u3000", "\u200b", ".", ",", "'s", "'", "—", "’", "word", "Wort", "é", "ß", "ñ", "漢", "ก่", "a\u0301", "7", "²", "😀", "<|endoftext|>", "<|endof"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(ODD), max_size=12).map("".join)), max_size=6), st.integers(0, 2))
def test_arrow_slices_give_the_ids_of_whole_texts(texts, skipped):
    got = CODER.encode(pa.array(texts, pa.string()).slice(skipped))
    assert [np.frombuffer(x, CODER.kind).tolist() for x in got] == [PLAIN.encode(t or "", add_special_tokens=False).ids for t in texts[skipped:]]


def test_memory_holds_words_once_and_nothing_long():
    coder, texts = Coder(tokenizer_path()), ["often often, often.\noften", "x" * 5000 + "=" + "y" * 5000, "often"]
    for x, t in zip(coder.encode(texts), texts, strict=True):
        assert np.frombuffer(x, coder.kind).tolist() == PLAIN.encode(t, add_special_tokens=False).ids
    assert set(coder.letters.newer) == {"often", " often"}
    assert not any(len(k) > 100 for m in (coder.letters, coder.pieces) for k in (*m.newer, *m.older)) and not any(len(k) > 100 for k in coder.words)


def test_shard_round_trip_and_lookup(tmp_path):
    rng = random.Random(1)
    keys = sorted([key_of(i) for i in rng.sample(range(-5000, 5000), 1500)] + [key_of(7)] * 40 + [b""])
    rows = [(k, rng.randbytes(2 * rng.randint(0, 300))) for k in keys]

    class File(io.BytesIO):
        def close(self):
            (tmp_path / "x.sst").write_bytes(self.getvalue())

    w = ShardWriter(File(), 2, block_bytes=2000)
    for k, v in rows:
        w.add(k, v)
    w.close()
    r = ShardReader(pafs.LocalFileSystem(), str(tmp_path / "x.sst"))
    assert list(r.scan()) == rows and r.entries == len(rows) and r.ids == sum(len(v) // 2 for _, v in rows)
    for k in {*keys, key_of(99999), key_of(-99999)}:
        assert r.get(k) == [v for x, v in rows if x == k]
    assert [id_of(k) for k in keys[:3]] == sorted((id_of(k) for k in keys[:3]), key=lambda x: (x is not None, x or 0))


def brute(rows):
    start, out = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*PLAIN.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("shard_bytes", [1 << 28, 400])
def test_table_round_trip(spark, shard_bytes):
    rng = random.Random(2)
    rows = [(i * 3 - 50, rng.choice(["", None, "one two", "x  y\n z", "long " * 5000, "é", "a<|endoftext|> b", "<|endoftext|>"])) for i in range(80)] + [(None, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("x")).withColumn("tie", F.lit(1)).repartition(5)
    manifest = write_token_table(docs, tokenizer_path(), shard_bytes=shard_bytes)
    out = read_token_table(manifest)
    got = sorted((tuple(r)[:4] for r in out.collect()), key=lambda r: r[1])
    assert got == brute(rows)
    found = {r["doc_id"]: r["ids"] for r in lookup(manifest, spark.createDataFrame([(-50,), (-47,), (1000,), (None,)], "doc_id long")).collect()}
    assert set(found) == {-50, -47, None} and found[None] == [*PLAIN.encode("none").ids, 2]
    empty = write_token_table(docs.limit(0), tokenizer_path())
    assert read_token_table(empty).count() == 0


def test_repeated_rows_are_all_written(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c")], "doc_id long, text string")
    out = read_token_table(write_token_table(docs, tokenizer_path()), with_ids=False).orderBy("start").collect()
    assert [r["doc_id"] for r in out] == [1, 1, 1, 2] and [r["start"] for r in out] == [0, 2, 4, 6]


def test_query_matches_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in op3_token_table(spark, sf).collect()), key=lambda r: r[1]) == brute(rows)
