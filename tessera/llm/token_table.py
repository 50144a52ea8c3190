"""Token ids of documents in sorted-string-table shards.

A shard holds documents in ascending order of their id. Its parts, one after the other:

* data blocks: entries of prefix-compressed key and ids; every ``RESTART``-th entry of a block has its whole key;
  a block is compressed as a whole;
* block index: the last key, offset and size of each block (sparse: one entry a block);
* Bloom filter over the keys;
* footer of ``FOOTER.size`` bytes: offsets of index and filter, counts, bytes an id, magic number.

Documents are dealt to tasks by range of id, so the shards in order of task are in order of id. A task
writes its shards under names of their own and only what it returns enters the manifest: shards of lost
or repeated tasks are never read.
"""

from __future__ import annotations

import array
import bisect
import os
import struct
import sys
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.plans.batches import small_batches
from tessera.plans.scratch import materialize, new_dir

MAGIC = b"tesssst1"
FOOTER = struct.Struct("<QQQQQBB6x8s")  # index offset, filter offset, entries, ids, blocks, bytes an id, probes, magic
RESTART = 16
MANIFEST = "part int, seq int, path string, first_id long, last_id long, n_docs long, n_tokens long"


def key_of(doc_id: int | None) -> bytes:
    """Bytes that sort like the ids; a null id sorts first."""
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, probes: int, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + k * b + k * k) % bits for k in range(probes)]


class ShardWriter:
    """Writes entries, in ascending order of key, to an open binary file."""

    def __init__(self, out, id_bytes: int, block_bytes: int = 1 << 16, probes: int = 7, bits_a_key: int = 10):
        self.out, self.id_bytes, self.block_bytes, self.probes, self.bits_a_key = out, id_bytes, block_bytes, probes, bits_a_key
        self.offset = self.entries = self.ids = self.in_block = 0
        self.index: list[bytes] = []
        self.keys: list[bytes] = []
        self.block, self.last = bytearray(), b""
        self.zip = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: bytes) -> None:
        shared = 0
        if self.in_block % RESTART:
            shared = len(os.path.commonprefix([key, self.last]))
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(ids)) + key[shared:] + ids
        self.last, self.in_block, self.entries = key, self.in_block + 1, self.entries + 1
        self.ids += len(ids) // self.id_bytes
        self.keys.append(key)
        if len(self.block) >= self.block_bytes:
            self._end_block()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.offset += len(data)

    def _end_block(self) -> None:
        if self.in_block:
            data = self.zip.compress(bytes(self.block))
            self.index.append(_varint(len(self.last)) + self.last + struct.pack("<QI", self.offset, len(data)))
            self._write(data)
            self.block, self.in_block = bytearray(), 0

    def close(self) -> None:
        self._end_block()
        index_at = self.offset
        self._write(b"".join(self.index))
        bloom_at, bits = self.offset, max(64, -(-self.bits_a_key * len(self.keys) // 8) * 8)
        bloom = bytearray(bits // 8)
        for key in self.keys:
            for p in _probes(key, self.probes, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        self._write(bytes(bloom))
        self._write(FOOTER.pack(index_at, bloom_at, self.entries, self.ids, len(self.index), self.id_bytes, self.probes, MAGIC))
        self.out.close()


class ShardReader:
    """Reads a shard: its footer, block index and filter at once, its blocks on demand."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        self.index_at, self.bloom_at, self.entries, self.ids, blocks, self.id_bytes, self.probes, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a shard")
        tail = self.file.read_at(size - FOOTER.size - self.index_at, self.index_at)
        index, self.bloom = tail[: self.bloom_at - self.index_at], tail[self.bloom_at - self.index_at :]
        self.last_keys, self.places, at = [], [], 0
        for _ in range(blocks):
            n, at = _read_varint(index, at)
            self.last_keys.append(index[at : at + n])
            self.places.append(struct.unpack_from("<QI", index, at + n))
            at += n + 12
        self.zip = zstandard.ZstdDecompressor()

    def block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        offset, size = self.places[k]
        data = self.zip.decompress(self.file.read_at(size, offset))
        at, last = 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            own, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            last = last[:shared] + data[at : at + own]
            yield last, data[at + own : at + own + n]
            at += own + n

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.places)):
            yield from self.block(k)

    def get(self, key: bytes) -> list[bytes]:
        """The ids of all entries of ``key``: filter, binary search of the block index, then the block."""
        bits = len(self.bloom) * 8
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.probes, bits)):
            return []
        out, k = [], bisect.bisect_left(self.last_keys, key)
        while k < len(self.places):
            found = [v for x, v in self.block(k) if x == key]
            out += found
            if self.last_keys[k] != key:
                break
            k += 1
        return out


def _visible() -> dict[int, str]:
    """Byte-level vocabularies spell printable Latin-1 bytes as themselves and the others by the characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(256 + k) for k, b in enumerate(hidden)}


VISIBLE = _visible()
SPELLED = [VISIBLE.get(b, chr(b)) for b in range(256)]
BLANK, MARKS = VISIBLE[32], ".,;:!?"


def _table(of: Iterable[int]) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(of)] = True
    return table


#: Bytes that are white space, or that some rules take for it.
WHITE = _table([*range(9, 14), *range(28, 33)])
IS_MARK = _table(MARKS.encode())
ASCII_LETTER = _table([*range(65, 91), *range(97, 123)])
_longer = [c.encode() for c in map(chr, range(128, sys.maxunicode + 1)) if c.isspace()]
#: Bytes with which white space of more than one byte begins, and its last bytes but one.
WHITE_LEAD, LAST_BUT_ONE = _table(c[0] for c in _longer), _table(c[-2] for c in _longer)
#: Pieces and words of more characters are not remembered.
LONGEST = 64
#: Bytes of the texts that are encoded at once.
SLICE = 1 << 23
_coders: dict[str, Coder] = {}


class Memory:
    """Ids by key, in two halves of ``most / 2`` keys, or of those that are asked for at once if these are more.

    When the newer half is full it becomes the older one. Keys of the older one that are asked for go into the newer one again and the others are
    forgotten at the next turn, so frequent keys stay.
    """

    def __init__(self, most: int):
        self.half = most // 2
        self.newer: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def make_room(self, keys: int) -> bool:
        """Whether the newer half began anew, as ``keys`` more would not have gone into it."""
        if not self.newer or len(self.newer) + keys <= self.half:
            return False
        self.newer, self.older = {}, self.newer
        return True


class Coder:
    """A byte-level tokenizer with a bounded memory of words.

    A byte-level tokenizer starts a new word where white space or a mark follows a letter, so a text is encoded piece by piece
    (see ``_cut``). Each piece of a slice of texts is encoded once. It is cut into words by the
    tokenizer's own rule, and only words that are new go through its merges. A text that holds one of the tokenizer's
    added tokens is encoded by the tokenizer as a whole, since these are cut out by rules of their own.
    """

    def __init__(self, path: str, most: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals out the work
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        rule = tokenizer.pre_tokenizer
        if tokenizer.normalizer is not None or type(rule).__name__ != "ByteLevel" or rule.add_prefix_space:
            raise ValueError("only byte-level tokenizers without normalizer and prefix blank are cut at blanks")
        self.whole = tokenizer
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.words_of, self.merge = rule.pre_tokenize_str, tokenizer.model.tokenize
        self.kind = np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.letters = Memory(most)  # letters with or without a blank before them
        self.pieces = Memory(most // 5)  # pieces of other kinds
        self.words: dict[str, bytes] = {}  # other words, by the vocabulary's spelling
        self.most_words = most // 5

    def _bytes(self, found: list[int]) -> bytes:
        ids = array.array(self.code, found)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _merged(self, shown: str) -> bytes:
        """The ids of a word as the vocabulary spells it, with a visible character for each byte."""
        return self._bytes([t.id for t in self.merge(shown)])

    def _word(self, shown: str) -> bytes:
        found = self.words.get(shown)
        if found is None:
            if len(self.words) >= self.most_words:
                self.words.clear()
            found = self._merged(shown)
            if len(shown) <= LONGEST:
                self.words[shown] = found
        return found

    def _letters(self, core: str) -> bytes:
        if core.isascii():
            return self._merged(BLANK + core[1:] if core[0] == " " else core)
        return self._merged("".join([SPELLED[b] for b in core.encode()]))

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of each of ``pieces``, which differ."""
        self.letters.make_room(len(pieces))
        self.pieces.make_room(len(pieces))
        letters, letters_before, known, before = self.letters.newer, self.letters.older, self.pieces.newer, self.pieces.older
        out = list(map(letters.get, pieces))
        for k, found in enumerate(out):
            if found is not None:
                continue
            piece = pieces[k]
            if piece.isalpha() or piece[0] == " " and piece[1:].isalpha():  # letters are one word
                memory, found = letters, letters_before.get(piece) or self._letters(piece)
            else:
                memory, found = known, known.get(piece) or before.get(piece) or b"".join([self._word(shown) for shown, _ in self.words_of(piece)])
            if len(piece) <= LONGEST:
                memory[piece] = found
            out[k] = found
        return out

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """The ids of each text, little-endian, in ``kind``."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string())
        if texts.null_count:
            texts = texts.fill_null("")
        whole: dict[int, bytes] = {}
        for added in self.added:
            for k in np.flatnonzero(pc.match_substring(texts, added).to_numpy(zero_copy_only=False)).tolist():
                if k not in whole:
                    whole[k] = self._bytes(self.whole.encode(texts[k].as_py(), add_special_tokens=False).ids)
        if whole:
            texts = pc.if_else(pa.array([k in whole for k in range(len(texts))]), "", texts)
        pieces, first = _cut(texts)
        found = pieces.dictionary_encode()
        ids = pa.array(self._pieces(found.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.binary()).take(found.indices)
        _, offsets, data = ids.buffers()
        ends = np.frombuffer(offsets, np.int32)[first].tolist() if len(pieces) else [0] * len(first)
        data = memoryview(data or b"")
        return [whole[k] if k in whole else bytes(data[a:b]) for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True))]


def _cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts, one after the other, and the place of the first piece of each text, with that of the end.

    A piece begins with its text, at a blank or line break right after a visible character, at a mark right after an ASCII letter, and
    after a line break that stands alone. What may be white space of more than one byte
    is taken for it: then the piece is longer, and its ids are the same.
    """
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    raw = pa.py_buffer(data or b"").slice(int(ends[0]), int(ends[-1] - ends[0]))
    buf = np.frombuffer(raw, np.uint8)
    ends = ends - ends[0]
    begins = np.zeros(len(buf) + 1, bool)
    begins[1:-1] = IS_MARK[buf[1:]] & ASCII_LETTER[buf[:-1]]
    at = np.flatnonzero((buf == 32) | (buf == 10))
    at = at[at > 0]
    last = buf[at - 1]
    at = at[~(WHITE[last] | ((last >= 128) & LAST_BUT_ONE[buf[at - 2]]))]
    begins[at] = True
    lines = at[(buf[at] == 10) & (at + 1 < len(buf))]
    following = buf[lines + 1]
    begins[lines[~(WHITE[following] | WHITE_LEAD[following])] + 1] = True
    begins[ends] = True
    places = np.flatnonzero(begins)
    pieces = pa.StringArray.from_buffers(len(places) - 1, pa.py_buffer(places.astype(np.int32)), raw)
    return pieces, np.searchsorted(places, ends)


def coder(path: str) -> Coder:
    """One coder for each worker process."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def _slices(texts: pa.Array, size: int = SLICE) -> Iterator[pa.Array]:
    """Texts of ``size`` bytes at most together, or one that is longer."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, side="right")))
        yield texts.slice(a, b - a)
        a = b


def write_token_table(
    docs: DataFrame,
    tokenizer: str,
    path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 2,
    shard_bytes: int = 1 << 28,
) -> DataFrame:
    """Encode every text, append ``end_id`` and write shards; returns the manifest (``MANIFEST`` and ``start``).

    ``path`` (default: a new one in the shared folder) is a URI that pyarrow can write. ``start`` counts the
    ids of all shards before. Null and empty texts have the end id only. A null document id sorts before all others; rows
    that share an id are all written, in order of a hash of their text. An empty table gives an empty manifest.
    A shard ends with its task or after ``shard_bytes``. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = path or new_dir(spark, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(tokenizer)
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        end = np.array([end_id], code.kind).tobytes()
        part, seq, out, name, first, last = TaskContext.get().partitionId(), 0, None, "", None, None

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pylist(
                [{"part": part, "seq": seq, "path": name, "first_id": first, "last_id": last, "n_docs": out.entries, "n_tokens": out.ids}], schema=schema
            )

        schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
        for batch in batches:
            ids = iter(batch.column("doc_id").to_pylist())
            for texts in _slices(batch.column("text")):
                for found in code.encode(texts):
                    doc_id = next(ids)
                    if out is None:
                        name = f"{path}/{part:06d}-{seq:04d}-{uuid.uuid4().hex}.sst"
                        out = ShardWriter(fs.open_output_stream(f"{root}/{name.rsplit('/', 1)[1]}"), code.kind.itemsize)
                        first = doc_id
                    out.add(key_of(doc_id), found + end)
                    last = doc_id
                    if out.offset >= shard_bytes:
                        yield done()
                        out, seq = None, seq + 1
        if out is not None:
            yield done()

    manifest = materialize(dealt.mapInArrow(write, MANIFEST), "token-manifest")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def read_token_table(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Read all shards: ``doc_id, start, n_tokens, ids_crc32`` and, on demand, ``ids`` (array)."""
    fields = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    shards = max(1, manifest.count())

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = pafs.FileSystem.from_uri(row["path"])
                shard, start, out = ShardReader(fs, path), row["start"], []
                kind = np.dtype(f"<u{shard.id_bytes}")
                for key, data in shard.scan():
                    ids = np.frombuffer(data, kind).astype("<u4")
                    out.append((id_of(key), start, len(ids), zlib.crc32(ids.tobytes()), *([ids.astype(np.int32)] * with_ids)))
                    start += len(ids)
                    if len(out) == 1000:
                        yield batch_of(out)
                        out = []
                if out:
                    yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=False)], names[: 4 + with_ids])

    return manifest.repartition(min(shards, 10_000)).mapInArrow(read, fields)


def lookup(manifest: DataFrame, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, ids`` for every id of ``keys`` that is in the table (once for each entry).

    The manifest has one row a shard and goes to all tasks; a key is found by binary search over shards,
    filter, block index and block.
    """
    shards = sorted(
        ((key_of(r["first_id"]), key_of(r["last_id"]), r["path"]) for r in manifest.select("first_id", "last_id", "path").collect()),
    )
    firsts = [s[0] for s in shards]

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, ShardReader] = {}
        for batch in batches:
            got, ids = [], []
            for doc_id in batch.column("doc_id").to_pylist():
                key = key_of(doc_id)
                k = bisect.bisect_right(firsts, key) - 1
                while k >= 0 and shards[k][1] >= key:
                    path = shards[k][2]
                    if path not in opened:
                        opened[path] = ShardReader(*pafs.FileSystem.from_uri(path))
                    for data in opened[path].get(key):
                        got.append(doc_id)
                        ids.append(np.frombuffer(data, f"<u{opened[path].id_bytes}").astype(np.int32))
                    k -= 1
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return keys.select(F.col(id_col).cast("long").alias("doc_id")).mapInArrow(find, "doc_id long, ids array<int>")
