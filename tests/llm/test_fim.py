import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import fim
from tests.llm.test_simhash import sort


def brute(doc_id, text, rate=100, spm_rate=50, seed=7):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    sha = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(sha[k : k + 8], 16) for k in range(0, 32, 8))
    n = len(lines)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    spm = h4 % 100 < spm_rate
    return doc_id, n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


TEXTS = [
    None, "", "\n", "\n\n\n", "a", "a\n", "a\nb", "one\r\ntwo\x0bthree four\n", "x<P>y\nz", "x<P", "P>\n<S", "<", "<S\n>\n<\nM>", "é\nüß\n漢字\n😀", " \n \n", "<M>",
    "line\n" * 50_000, "no line break " * 20_000, "漢字😀\n" * 20_000, "a" * 300_000, ("x" * 8191 + "<S>") * 3, "\n".join(str(k * k) for k in range(30_000)),
]


def test_rows_and_restored_texts(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "a\nb\nc"), (None, None), (1, "a\nb"), (1, "a\nb")]
    docs = spark.createDataFrame([(i, t, 1, "q") for i, t in rows], "doc_id long, text string, n int, output string")
    for kw in ({}, {"rate": 50, "spm_rate": 0, "seed": 1}, {"spm_rate": 100, "cache_bytes": 0}):
        found = fim.fill_in_middle(docs, **kw)
        want = sort(brute(i, t, **{k: v for k, v in kw.items() if k != "cache_bytes"}) for i, t in rows)
        assert sort(found.collect()) == want
        back = found.select("doc_id", fim.restored(F.col("output"), F.col("form")))
        assert sort(back.collect()) == sort((i, t or "") for i, t in rows)
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1, 100, 1 << 20])
def test_chunks_are_defined_by_content(monkeypatch, block):
    rnd = random.Random(3)
    shared = bytes(rnd.choice(b"abcdefghij \n") for _ in range(60_000))
    texts = [bytes(rnd.choice(b"klmnopq \n") for _ in range(n)) + shared for n in (0, 17, 5_003)]
    whole = [fim.boundaries(t) for t in texts]
    monkeypatch.setattr(fim, "BLOCK", block)
    if block > 1 or len(texts[0]) < 1000:
        assert [fim.boundaries(t) for t in texts] == whole
    else:
        assert fim.boundaries(texts[1][:3000]) == [e for e in whole[1] if e < 3000][: len(fim.boundaries(texts[1][:3000])) - 1] + [3000]
    for t, ends in zip(texts, whole, strict=True):
        sizes = np.diff([0, *ends])
        assert ends[-1] == len(t) and sizes.max() <= 8192 and sizes[:-1].min() >= 256
    parts = [{t[a:b] for a, b in zip([0, *e], e, strict=False)} for t, e in zip(texts, whole, strict=True)]
    assert len(parts[0] & parts[2]) > 0.8 * len(parts[0])  # the passage falls into the same chunks, wherever it begins
    assert fim.boundaries(b"") == [] and max(np.diff(fim.boundaries(b"a" * 50_000))) <= 8192


def test_gear_sees_the_last_32_bytes():
    data = np.frombuffer(np.random.default_rng(1).bytes(500), np.uint8)
    want, h = [], 0
    for b in data.tolist():
        h = (h << 1) + int(fim.GEAR[b]) & 0xFFFFFFFF
        want.append(h)
    assert fim.gear(data).tolist() == want


def test_cache_answers_by_content_and_stays_bounded():
    chunks = fim.Chunks(10_000)
    a = b"x\n" * 500
    assert chunks.summary(a)[1] == 1000 and chunks.hits == 0
    assert chunks.summary(b"x\n" * 500)[0].tolist() == list(range(1, 1000, 2)) and chunks.hits == 1
    for k in range(100):
        chunks.summary(b"%d" % k * 400)
    assert chunks.size <= 10_000 and a not in chunks.known


def test_every_cut_of_a_text():
    text = ("é\n" + "y" * 700 + "\n\nz").encode() * 40
    laid = fim.Layout(text, fim.Chunks(1 << 20))
    lines = re.findall(r"[^\n]*\n|[^\n]+", text.decode())
    assert laid.n == len(lines)
    for k in range(len(lines) + 1):
        head = "".join(lines[:k])
        assert laid.cut(k) == (len(head.encode()), len(head))
