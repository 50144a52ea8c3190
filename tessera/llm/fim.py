"""Fill-in-middle: whole texts are cut at line ends into prefix, middle and suffix, and put into another order.

1. A gear hash rolls over the bytes of a text; where its upper bits are zero, a chunk ends. So chunk ends depend on the
   bytes before them only, and passages that texts share fall into the same chunks.
2. A chunk is looked up in a cache by its hash and compared with the cached bytes. Its summary says where its line breaks
   are, how many characters it holds, and whether a mark lies in it; marks that cross a boundary show in the bytes around it.
3. Sums of the chunks' line breaks say in which chunk a cut lies, the chunk's summary says where.

One pass without a shuffle; a task holds one text, a batch of outputs and a cache of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
WINDOW = 32
GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([k])).digest()[:4], "big") for k in range(256)], np.uint32)
#: Bytes of a text that are hashed at once.
BLOCK = 1 << 20
#: Bytes of output that make a batch.
BATCH = 1 << 25


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte, the sum of the table's entries for the last 32 bytes, each shifted by its distance."""
    h = GEAR[data]
    step = 1
    while step < WINDOW:  # windows of twice the length from two of them
        more = h.copy()
        more[step:] += h[:-step] << np.uint32(step)
        h, step = more, step * 2
    return h


def boundaries(text: bytes, bits: int = 10, least: int = 256, most: int = 8192) -> list[int]:
    """Ends of the chunks of ``text``: about ``2**bits`` bytes apart, at least ``least`` and at most ``most``."""
    ends, last = [], 0
    for at in range(0, len(text), BLOCK):
        before = min(at, WINDOW - 1)
        h = gear(np.frombuffer(text, np.uint8, min(BLOCK, len(text) - at) + before, at - before))[before:]
        for end in (np.flatnonzero(h >> np.uint32(32 - bits) == 0) + (at + 1)).tolist():
            while end - last > most:
                last += most
                ends.append(last)
            if end - last >= least:
                last = end
                ends.append(end)
    while len(text) - last > most:
        last += most
        ends.append(last)
    if last < len(text):
        ends.append(len(text))
    return ends


def _chars(data: bytes) -> int:
    return len(data) - int(np.count_nonzero(np.frombuffer(data, np.uint8) & 0xC0 == 0x80))


class Chunks:
    """Summaries of chunks by content, the least recently used ones leave beyond ``most`` bytes."""

    def __init__(self, most: int) -> None:
        self.most, self.size, self.known, self.hits = most, 0, {}, 0

    def summary(self, chunk: bytes) -> tuple[np.ndarray, int, bool]:
        """Places of the line breaks, number of characters, and whether a mark is inside."""
        found = self.known.pop(chunk, None)  # equal hash and equal bytes
        if found is None:
            breaks = np.flatnonzero(np.frombuffer(chunk, np.uint8) == 10).astype(np.int32)
            found = breaks, _chars(chunk), any(m in chunk for m in MARKS)
            self.size += len(chunk) + breaks.nbytes
        else:
            self.hits += 1
        self.known[chunk] = found
        while self.size > self.most and len(self.known) > 1:
            old = next(iter(self.known))
            self.size -= len(old) + self.known.pop(old)[0].nbytes
        return found


class Layout:
    """A text as chunks: number of lines, marks, and the place of any line end."""

    def __init__(self, text: bytes, chunks: Chunks) -> None:
        self.text, self.ends = text, boundaries(text)
        self.begin = [0, *self.ends[:-1]] if self.ends else []
        parts = [chunks.summary(text[a:b]) for a, b in zip(self.begin, self.ends, strict=True)]
        self.breaks = [p[0] for p in parts]
        self.lines = np.cumsum([0, *(len(p[0]) for p in parts)])
        self.chars = np.cumsum([0, *(p[1] for p in parts)])
        self.n = int(self.lines[-1]) + (bool(text) and not text.endswith(b"\n"))
        across = (text[max(0, e - 2) : e + 2] for e in self.ends[:-1])
        self.marked = any(p[2] for p in parts) or any(m in x for x in across for m in MARKS)

    def cut(self, lines: int) -> tuple[int, int]:
        """Bytes and characters of the first ``lines`` lines."""
        if lines == 0:
            return 0, 0
        if lines > self.lines[-1]:  # the last one has no line break
            return len(self.text), int(self.chars[-1])
        k = int(np.searchsorted(self.lines, lines)) - 1
        end = self.begin[k] + int(self.breaks[k][lines - int(self.lines[k]) - 1]) + 1
        return end, int(self.chars[k]) + _chars(self.text[self.begin[k] : end])


def draws(id_col: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the hash of ``seed`` and id; a null id counts as no digits."""
    sha = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(sha, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = 100, spm_rate: int = 50, seed: int = 7, cache_bytes: int = 1 << 25
) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n, form, prefix_chars, middle_chars, output``.

    ``n`` is the number of lines (runs up to a line break, which belongs to its line, and what follows the last one). The prefix ends after the
    lesser of two drawn numbers of lines, the middle after the greater. ``rate`` of a hundred texts are reordered, ``spm_rate`` of a hundred of them as
    ``<S>suffix<P>prefix<M>middle`` (``spm``), the others as ``<P>prefix<S>suffix<M>middle`` (``psm``). Texts that are empty or null, hold a
    mark, or aren't drawn stay as they are (``plain``; ``prefix_chars`` and ``middle_chars`` are null). All draws are a function of ``seed`` and id:
    rows of one id are drawn alike, a null id counts as no digits. Other columns are ignored; an empty table gives no rows.

    cache_bytes: size of a task's cache of chunk summaries.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks(cache_bytes)
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            cols[-1] = cols[-1].cast(pa.string())
            return pa.RecordBatch.from_arrays(cols, names)

        for batch in batches:
            rows, size = [], 0
            ids, texts, (h1, h2, h3, h4) = batch.column("doc_id").to_pylist(), batch.column("text"), (batch.column(f"h{k}").to_pylist() for k in (1, 2, 3, 4))
            for i, doc_id in enumerate(ids):
                text = (texts[i].as_py() or "").encode()
                laid = Layout(text, chunks)
                if not text or laid.marked or h3[i] % 100 >= rate:
                    rows.append((doc_id, laid.n, "plain", None, None, text))
                else:
                    low, high = sorted((h1[i] % (laid.n + 1), h2[i] % (laid.n + 1)))
                    (a, a_chars), (b, b_chars) = laid.cut(low), laid.cut(high)
                    prefix, middle, suffix = text[:a], text[a:b], text[b:]
                    spm = h4[i] % 100 < spm_rate
                    parts = (MARKS[1], suffix, MARKS[0], prefix) if spm else (MARKS[0], prefix, MARKS[1], suffix)
                    rows.append((doc_id, laid.n, "spm" if spm else "psm", a_chars, b_chars - a_chars, b"".join((*parts, MARKS[2], middle))))
                size += len(rows[-1][-1])
                if size > BATCH:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)

    hs = draws(F.col(id_col), seed)
    asked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[h.alias(f"h{k}") for k, h in enumerate(hs, 1)])
    return asked.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` made ``output`` of. No mark arises where two parts meet, so the marks are those that were put in."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    in_order = F.when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(F.concat(parts[1], parts[3], parts[2]))
    return F.when(form == "plain", output).otherwise(in_order)
