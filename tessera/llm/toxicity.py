"""Toxicity of texts after noisy-channel deobfuscation.

A word may be disguised by look-alike signs (``1d10t``), separators of any kind and number between letters (``i d i o t``, ``i/d/i/o/t``),
signs that can't be seen, or repeated letters (``idiooot``, ``iidioot``). A span that shows any of these is a lattice: each sign may be read as a letter that
looks like it, a run of one letter as the whole run or as a shorter one, and separators as nothing or as the end of a word. Viterbi decoding takes the
path that is best under a character trigram model of all texts' words and the costs of the channel. The restored text is then
scored by logistic regression on the words, and word beginnings, that tell labelled texts apart.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.linear import fit_ordinal, sigmoid
from tessera.llm.sampling import labelled_texts
from tessera.llm.textnum import LETTER, chunks, mix, spans, word_hashes
from tessera.plans.scratch import materialize

#: Letters that a sign may stand for.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c", "¡": "i",
}
SIGNS = "".join(LOOKS_LIKE)
#: Signs that can't be seen: soft hyphen, joiners, marks of direction. They are left out of all words.
UNSEEN = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
#: A look-alike sign, a letter three times in a row, or two doubled letters in a word: its token is a lattice.
TRIGGER = re.compile(rf"[{re.escape(SIGNS)}]|([^\W\d_])\1(?:\1|[^\W\d_]*?([^\W\d_])\2)")
#: Three or more single letters or digits with any separators between them, however many: a lattice too, blanks and line breaks included.
SPACED = re.compile(r"(?<![^\W_])[^\W_](?:[\W_]+[^\W_]){2,}(?![^\W_])")
#: A run of separators; a sign that looks like a letter may separate too, but stands by itself.
PLACE = re.compile(rf"(?:(?![{re.escape(SIGNS)}])[\W_])+|(.)\1*", re.S)
DOUBLED = re.compile(r"([^\W\d_])\1")
EDGE = re.compile(r"^([^\w@$]*)(.*?)([.,;:?\"')\]}]*!*)$", re.S)
#: A path that costs more than this for each character is no word: the span stays as it is.
WORST = 3.9
#: Letters of the character model; all others count as one.
ALPHABET = frozenset("abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xDF, 0x100))))
OTHER = "\ufffd"


class CharModel:
    """Character trigrams of words with interpolated smoothing; a word is padded with blanks."""

    def __init__(self, trigrams: dict[str, float]):
        self.tri = trigrams
        self.bi: dict[str, float] = {}
        self.uni: dict[str, float] = {}
        self.pairs: dict[str, float] = {}
        self.ones: dict[str, float] = {}
        for part, n in trigrams.items():
            for table, key in ((self.bi, part[1:]), (self.uni, part[2]), (self.pairs, part[:2]), (self.ones, part[1])):
                table[key] = table.get(key, 0) + n
        self.total = sum(self.uni.values())
        self.memo: dict[str, float] = {}

    def cost(self, history: str, c: str) -> float:
        """-log P(c | the two characters before it)."""
        key = history + c
        found = self.memo.get(key)
        if found is None:
            if len(self.memo) > 1_000_000:
                self.memo.clear()
            a, b, x = (OTHER if y.isalpha() and y not in ALPHABET else y for y in key)
            p = (self.uni.get(x, 0) + 0.1) / (self.total + 30.0)
            p = (self.bi.get(b + x, 0) + 4 * p) / (self.ones.get(b, 0) + 4)
            p = (self.tri.get(a + b + x, 0) + 4 * p) / (self.pairs.get(a + b, 0) + 4)
            found = self.memo[key] = -math.log(p)
        return found


def trigrams(word: str) -> list[str]:
    padded = f"  {''.join(c if c in ALPHABET else OTHER for c in word)} "
    return [padded[k - 2 : k + 1] for k in range(2, len(padded))]


def char_model(docs: DataFrame, text_col: str) -> CharModel:
    """The trigrams of all words of all texts; a word weighs the logarithm of its count. The alphabet bounds the table."""
    words = docs.select(F.explode(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}]+")).alias("w")).filter("w <> ''")
    known = "".join(sorted(ALPHABET))
    padded = F.concat(F.lit("  "), F.regexp_replace("w", f"[^{known}]", OTHER), F.lit(" "))
    counted = words.groupBy("w").agg(F.log2(F.count("*") + 1.0).alias("n")).select("n", padded.alias("w"))
    parts = counted.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 2), lambda k: F.substr("w", k, F.lit(3)))).alias("tri"))
    return CharModel({r["tri"]: r["n"] for r in parts.groupBy("tri").agg(F.sum("n").alias("n")).collect()})


def lattice(token: str, spaced: bool = False) -> list[list[tuple[str, float]]]:
    """Readings ``(letters, channel cost)`` of each run of one character, or of separators, of a lower-case span. In a ``spaced`` one look-alike signs may separate as well."""
    places, doubled = [], len(DOUBLED.findall(token)) > 1
    for m in PLACE.finditer(token):
        c, n = m[1], len(m[0])
        if c is None:
            places.append([("", 0.25 + 0.25 * min(n, 4)), (" ", 0.5)])
            continue
        letters = [(c, 0.0)] if c.isalpha() else []
        letters += [(x, 0.7) for x in LOOKS_LIKE.get(c, "")]
        if not letters:
            places.append([(m[0], 0.0)])
            continue
        readings = {}
        for x, cost in letters:
            for length in {n, 1, min(n, 2)}:
                extra = 0.0 if length == n else 0.5
                if n >= 3 and length == n:
                    extra = 1.0 * (n - 2)  # three in a row are rarely meant
                if n == 2 and length == 1:
                    extra = 4.0 if doubled else 6.0
                readings[x * length] = min(readings.get(x * length, 1e9), cost * (1 if x == c else n) + extra)
        if spaced and not c.isalnum():
            readings |= {"": 0.25 + 0.25 * min(n, 4), " ": 0.5}
        places.append(sorted(readings.items()))
    return places


def decode(token: str, model: CharModel, spaced: bool = False) -> tuple[str, float]:
    """The best path through the lattice of ``token``, and its cost. Time and memory follow the length."""
    best: dict[str, tuple[float, tuple | None]] = {"  ": (0.0, None)}
    for readings in lattice(token, spaced):
        nxt: dict[str, tuple[float, tuple | None]] = {}
        for history, (cost, said) in best.items():
            for letters, channel in readings:
                c, h = cost + channel, history
                for x in letters:
                    if x == " " and h == "  ":
                        continue  # a word that is over can't end again
                    c += model.cost(h, x)
                    h = "  " if x == " " else h[1] + x
                if h not in nxt or c < nxt[h][0]:
                    nxt[h] = (c, (said, letters))
        best = nxt
    cost, said = min(((cost + (0.0 if h == "  " else model.cost(h, " ")), h, said) for h, (cost, said) in best.items()), key=lambda x: x[:2])[::2]
    parts = []
    while said is not None:
        said, letters = said
        parts.append(letters)
    return "".join(reversed(parts)), cost


def _spans(text: str) -> list[tuple[int, int]]:
    """Begin and end of the spans of ``text`` that are read as lattices, in order and apart."""
    found, end = [], 0
    for m in TRIGGER.finditer(text):
        if m.start() >= end:
            a, end = m.start(), m.end()
            while a and not text[a - 1].isspace():
                a -= 1
            while end < len(text) and not text[end].isspace():
                end += 1
            if not text[a:end].isdecimal():
                found.append((a, end))
    spaced = [m.span() for m in SPACED.finditer(text)]
    if not spaced:
        return found
    out: list[tuple[int, int]] = []
    for a, b in sorted(found + spaced):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _restored(span: str, model: CharModel) -> str:
    """``span`` with its core decoded, unless no path through it looks like words."""
    head, core, tail = EDGE.match(span).groups()
    if not core:
        return span
    said, cost = decode(core, model, SPACED.search(core) is not None)
    return f"{head}{said}{tail}" if any(c.isalpha() for c in said) and cost <= WORST * (len(said) + 1) else span


def restore(text: str, model: CharModel, memo: dict[str, str]) -> str:
    """``text``, lower-cased, with disguised spans of any length decoded. Numbers, and spans no reading of which looks like words, stay."""
    text = UNSEEN.sub("", text.lower())
    out, at = [], 0
    for a, b in _spans(text):
        span = text[a:b]
        said = memo.get(span)
        if said is None:
            said = _restored(span, model)
            if len(span) <= 64:
                if len(memo) > 200_000:
                    memo.clear()
                memo[span] = said
        out += [text[at:a], said]
        at = b
    return "".join(out) + text[at:]


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(text, feature)`` of every word of lower-case texts: the hash of a word, and its first 4, 5 and 6 bytes if it is longer."""
    at, found = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    with np.errstate(over="ignore"):
        for first, _, raw, starts in chunks(texts):
            begin, end = spans(LETTER[raw])
            if not len(begin):
                continue
            owner = first + np.searchsorted(starts, begin, side="right") - 1
            at.append(owner)
            found.append(word_hashes(raw, begin, end))
            padded = np.concatenate([raw, np.zeros(8, np.uint8)])
            head = np.zeros(len(begin), np.uint64)
            for k in range(6):
                head |= padded[begin + k].astype(np.uint64) << np.uint64(8 * k)
                n = k + 1
                if n >= 4:
                    long = end - begin > n
                    at.append(owner[long])
                    found.append(mix(head[long] * np.uint64(2 * n + 1) + np.uint64(n)))
    return np.concatenate(at), np.concatenate(found)


def learn(labelled: DataFrame, chars: CharModel, max_features: int = 4096, min_texts: int = 5, min_chi2: float = 12.0, min_strong: int = 20) -> dict:
    """Chosen features, weights and bias from ``labelled (text, label)``, the bounded sample.

    Equal texts count once. To the driver come ``max_features`` features (the size of the model), and
    for each text the list of those of its features that were chosen.
    """
    shared = labelled.sparkSession.sparkContext.broadcast(chars)  # trigrams of a bounded alphabet

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, str] = {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([restore(t, shared.value, memo) for t in batch.column("text").to_pylist()], pa.string()), batch.column("label")], ["text", "label"])

    rows = labelled.groupBy(F.lower("text").alias("text")).agg(F.max((F.col("label") > 0).cast("int")).alias("label"))
    rows = materialize(rows.mapInArrow(restored, "text string, label int"), "toxic-sample")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    model = {"chars": chars, "features": np.empty(0, np.uint64), "strong": np.empty(0, bool), "weights": np.empty(0), "bias": math.log((n1 + 0.5) / (n0 + 0.5))}
    if not n1 or not n0:
        return model

    def texts_of(batch: pa.RecordBatch) -> list[bytes]:
        return [t.encode() for t in batch.column("text").to_pylist()]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, f = features(texts_of(batch))
            if len(f):
                pairs = np.unique(np.rec.fromarrays([f, at]))  # once a text
                label = batch.column("label").to_numpy(zero_copy_only=False)[pairs.f1]
                found, inverse = np.unique(pairs.f0, return_inverse=True)
                ones = np.bincount(inverse, label, minlength=len(found)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"f": found.view(np.int64), "a": ones, "n": np.bincount(inverse, minlength=len(found))})

    total = n0 + n1
    a, n = F.col("a").cast("double"), F.col("n").cast("double")
    chi2 = total * F.pow(a * total - n * n1, 2) / (n * (total - n) * float(n1) * n0)
    chosen = (
        rows.mapInArrow(count, "f long, a long, n long")
        .groupBy("f")
        .agg(F.sum("a").alias("a"), F.sum("n").alias("n"))
        .filter((F.col("n") >= min_texts) & (F.col("n") < total))
        .withColumn("chi2", chi2)
        .filter(F.col("chi2") >= min_chi2)
        .orderBy(F.desc("chi2"), "f")
        .limit(max_features)
        .select("f", "a", "n")
        .toPandas()
    )
    if not len(chosen):
        return model
    order = np.argsort(chosen["f"].to_numpy().view(np.uint64))
    chosen = chosen.iloc[order]
    # features that occur in labelled texts only, and often; to hold any of them is a feature of its own
    model |= {"features": chosen["f"].to_numpy().view(np.uint64), "strong": ((chosen["a"] == chosen["n"]) & (chosen["n"] >= min_strong)).to_numpy()}

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists: list[list[int]] = [[] for _ in range(batch.num_rows)]
            at, f = present(texts_of(batch), model["features"])
            for k, x in zip(at.tolist(), f.tolist(), strict=True):
                lists[k].append(x)
            for k in set(at[model["strong"][f]].tolist()):
                lists[k].append(len(model["features"]))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(lists, pa.list_(pa.int32()))], ["label", "f"])

    sample = rows.mapInArrow(match, "label int, f array<int>").toPandas()
    sizes = sample["f"].map(len).to_numpy()
    indptr = np.concatenate([[0], np.cumsum(sizes)])
    indices = np.concatenate([np.asarray(x, np.int64) for x in sample["f"]] + [np.empty(0, np.int64)])
    w, t = fit_ordinal(indptr, indices, np.ones(len(indices)), sample["label"].to_numpy(), len(model["features"]) + 1, 2, l2=1e-5, steps=400)
    return model | {"weights": w, "bias": -float(t[0])}


def logits(texts: list[bytes], model: dict) -> np.ndarray:
    """The score of each restored text before the logistic function."""
    out = np.full(len(texts), float(model["bias"]))
    if len(model["features"]):
        at, f = present(texts, model["features"])
        out += np.bincount(at, model["weights"][f], minlength=len(texts))
        out[np.unique(at[model["strong"][f]])] += model["weights"][-1]
    return out


def present(texts: list[bytes], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(text, index of chosen feature)``, each once a text."""
    at, f = features(texts)
    sieve = np.zeros(1 << 16, bool)
    sieve[(chosen >> np.uint64(48)).astype(np.int64)] = True
    maybe = sieve[(f >> np.uint64(48)).astype(np.int64)]
    at, f = at[maybe], f[maybe]
    if not len(f):
        return at, at
    k = np.minimum(np.searchsorted(chosen, f), len(chosen) - 1)
    hit = chosen[k] == f
    pairs = np.unique(at[hit] * len(chosen) + k[hit])
    return pairs // len(chosen), pairs % len(chosen)


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    fit_rows: int = 20_000,
    seed: int = 5,
    restored: bool = False,
    **options,
) -> DataFrame:
    """The columns of ``docs`` and ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on); ``restored`` text on demand.

    ``labels`` (id, label) name the rows of ``docs`` to learn from, of which about ``fit_rows`` are used; the character model
    counts the words of all rows. A null text
    counts as empty and has the score of the bias, as has a text without any chosen feature. With labels of
    one class, or none, all scores are the smoothed share of the label. Repeated rows and ids change
    nothing; columns of ``docs`` called like the new ones are replaced; an empty table gives no rows.
    """
    sample = labelled_texts(docs, labels, id_col, text_col, label_col, fit_rows, seed)
    shared = docs.sparkSession.sparkContext.broadcast(learn(sample, char_model(docs, text_col), **options))

    @F.pandas_udf("struct<score:double,predicted:int,restored:string>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model, memo = shared.value, {}
        for texts in batches:
            plain = [restore(t, model["chars"], memo) for t in texts]
            p = sigmoid(logits([t.encode() for t in plain], model))
            yield pd.DataFrame({"score": p, "predicted": (p >= 0.5).astype(np.int32), "restored": plain if restored else [None] * len(plain)})

    found = docs.withColumn("__said", predict(F.coalesce(F.col(text_col), F.lit(""))))
    new = {c: F.col(f"__said.{c}") for c in ("score", "predicted", *(["restored"] * restored))}
    return found.withColumns(new).drop("__said")
