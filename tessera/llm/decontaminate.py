"""Benchmark decontamination by spaced-seed hashing.

A fixed mask such as ``110110111`` picks some of the words of a window and ignores the others, so two
windows that differ only in ignored places have one hash. The seeds of the benchmark are joined with
those of every document position; the join, the hashing and the test around each hit run in one
pass over the documents, without a shuffle of their text. A benchmark too large for that meets the documents in a
shuffle of seeds, of which a bitmap of all its seeds lets few through. Around a hit the benchmark item is laid along
the document, and some window of ``window`` words must agree in ``similarity`` of its words. The masks are
completed for each window size until every allowed choice of differing words leaves some mask intact, and all
windows around a hit are tested, so nothing is missed.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Six words each; together they bridge single and double substitutions at varied distances.
MASKS = ("111111", "1111011", "11011011", "111000111")
#: With more choices of differing words than this, masks are not searched: a plain run is long enough by pigeonhole.
MOST_CHOICES = 500
#: Words of a text that are searched at once.
PIECE = 128


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _hits(mask: str, size: int, changed: tuple[int, ...]) -> bool:
    """Whether ``mask`` fits somewhere into ``size`` words so that it ignores all changed ones."""
    return any(all(c == "0" or at + i not in changed for i, c in enumerate(mask)) for at in range(size - len(mask) + 1))


def _lighter(size: int, weight: int) -> list[str]:
    """All masks of ``weight`` words within ``size``, short ones first."""
    if weight == 1:
        return ["1"]
    inner = [(span, c) for span in range(weight, size + 1) for c in itertools.combinations(range(1, span - 1), weight - 2)]
    return ["".join("1" if i in (0, span - 1, *c) else "0" for i in range(span)) for span, c in inner]


def masks_for(size: int, similarity: float, masks: tuple[str, ...], known: tuple[str, ...] = ()) -> tuple[str, ...]:
    """Masks that find every window of ``size`` words of which ``similarity`` agree: those of ``masks`` that fit, and
    as few more as a greedy search needs, heavy ones and those of ``known`` first."""
    changes = max(d for d in range(size) if d == 0 or (size - d) / size >= similarity)
    found = [m for m in masks if len(m) <= size]
    if math.comb(size, changes) > MOST_CHOICES:
        return (*found, "1" * math.ceil((size - changes) / (changes + 1)))
    left = [c for c in itertools.combinations(range(size), changes) if not any(_hits(m, size, c) for m in found)]
    weight = min(max((m.count("1") for m in masks), default=size), size - changes)
    while left:
        pools = [[m for m in known if m.count("1") == weight and len(m) <= size], _lighter(size, weight)]
        best = next((m for n, m in (max(((sum(_hits(m, size, c) for c in left), m) for m in pool), default=(0, "")) for pool in pools) if n), None)
        if best is None:
            weight -= 1
            continue
        found.append(best)
        left = [c for c in left if not _hits(best, size, c)]
    return tuple(found)


def _seeds(masks: dict[str, list[int]], array: str, at: str, size: str, span: str | None = None) -> Column:
    """The hashes of all masks that fit at word ``at``, and with ``span`` only of those that windows of this size use; else null."""
    out = []
    for k, (mask, spans) in enumerate(masks.items()):
        picked = ", ".join(f"get({array}, {at} + {i})" for i, c in enumerate(mask) if c == "1")
        used = f" AND {span} IN ({', '.join(map(str, spans))})" if span else ""
        out.append(f"CASE WHEN {at} + {len(mask)} <= {size}{used} THEN xxhash64({k}, {picked}) END")
    return F.expr(f"array({', '.join(out)})")


def _text_key(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key")


def _blocks(items: DataFrame, most_words: int) -> int:
    """In how many blocks the benchmark is broadcast, each of about ``most_words`` words."""
    total = items.select(F.sum(F.size("item_words"))).first()[0] or 0
    return max(1, math.ceil(total / most_words))


def _hashes(array: str) -> Column:
    """The hash of each word, from which those of all masks are made."""
    return F.transform(array, lambda w: F.xxhash64(w))


def _pieces(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """``doc_id, text_key, piece, lead, doc_words, hashes``: runs of ``PIECE`` words of each text, with the ``window - 1`` words around them, of which ``lead`` stand before.

    What is found in a piece is held in memory until its end, so a text is never the unit of that.
    """
    low, high = f"greatest(0, k * {PIECE} - {window} + 1)", f"least((k + 1) * {PIECE} + {window} - 1, size(doc_words))"
    part = lambda c: f"'{c}', slice({c}, {low} + 1, {high} - {low})"
    cut = f"transform(sequence(0, CAST((size(doc_words) - 1) DIV {PIECE} AS INT)), k -> named_struct('piece', k, 'lead', k * {PIECE} - {low}, {part('doc_words')}, {part('hashes')}))"
    rows = docs.select(F.col(id_col).alias("doc_id"), _text_key(text_col), words(F.col(text_col)).alias("doc_words")).withColumn("hashes", _hashes("doc_words"))
    return rows.select("doc_id", "text_key", F.explode(F.expr(cut)).alias("p")).select("doc_id", "text_key", "p.*").filter(F.size("doc_words") > 0)


def _around(window: int) -> list[Column]:
    """``item_words, item_at, item_size`` of a hit, as far as windows around it reach."""
    low = f"greatest(0, item_at - {window} + 1)"
    high = f"least(item_size, item_at + {window})"
    return [F.expr(f"slice(item_words, {low} + 1, {high} - {low})").alias("item_words"), F.expr(f"item_at - {low}").alias("item_at"), F.expr(f"{high} - {low}").alias("item_size")]


def _items(benchmark: DataFrame, item_col: str, item_text_col: str, min_words: int) -> DataFrame:
    """``item_id, item_key, item_words`` of the items that can match, each once; ``item_key`` is the hash of the words."""
    rows = benchmark.select(F.col(item_col).alias("item_id"), words(F.col(item_text_col)).alias("item_words")).filter(F.size("item_words") >= min_words)
    return rows.distinct().withColumn("item_key", F.xxhash64("item_words"))


def _overlaps(
    docs: DataFrame,
    known: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 13,
    similarity: float = 0.8,
    masks: tuple[str, ...] = MASKS,
    block_words: int = 200_000,
    most_blocks: int = 4,
    sieve_bits: int = 30,
    salts: int = 8,
) -> DataFrame:
    """``doc_id, text_key, item_key, matched`` of each document and each different text of ``known (item_id, item_key, item_words)`` that overlap, once."""
    items = known.select("item_key", "item_words").distinct().withColumn("item_size", F.size("item_words"))
    spans = [r[0] for r in items.select(F.least(F.lit(window), "item_size")).distinct().collect()]  # `window` sizes at most
    used: dict[str, list[int]] = {}
    for span in sorted({*spans, window}, reverse=True):
        for mask in masks_for(span, similarity, masks, tuple(used)):
            used.setdefault(mask, []).append(span)
    blocks = _blocks(items, block_words)
    items = items.withColumn("block", F.pmod("item_key", F.lit(blocks)))
    seeds = (
        items.withColumn("hashes", _hashes("item_words"))
        .select("block", "item_key", "hashes", "item_size", F.posexplode("hashes").alias("item_at", "w"))
        .select("block", "item_key", "item_at", F.explode(_seeds(used, "hashes", "item_at", "item_size", f"least({window}, item_size)")).alias("seed"))
        .filter("seed IS NOT NULL")
    )
    pieces = _pieces(docs, id_col, text_col, window)
    starts = F.expr(f"sequence(lead, least(lead + {PIECE}, size(doc_words)) - 1)")
    keyed = pieces.select("doc_id", "text_key", "piece", "doc_words", "hashes", F.size("hashes").alias("doc_size"), F.explode(starts).alias("at"))
    keyed = keyed.select("doc_id", "text_key", "piece", "doc_words", "at", F.explode(_seeds(used, "hashes", "at", "doc_size")).alias("seed")).filter("seed IS NOT NULL")
    first = f"greatest(0, at - {window} + 1)"
    near = [F.expr(f"slice(doc_words, {first} + 1, {2 * window - 1})").alias("doc_words"), F.expr(f"at - {first}").alias("at")]
    if blocks > most_blocks:
        hits = _shuffled(pieces, keyed, items.drop("block"), seeds.drop("block"), near, window, sieve_bits, salts)
        found = hits.select("doc_id", "text_key", "item_key", _matched(window).alias("matched")).filter(F.col("matched") >= similarity)
        return found.groupBy("doc_id", "text_key", "item_key").agg(F.max("matched").alias("matched"))
    out = None
    for b in range(blocks):
        small = [F.broadcast(x.filter(F.col("block") == b).drop("block")) for x in (seeds, items)]
        hits = keyed.join(small[0], "seed").select("doc_id", "text_key", "item_key", "item_at", *near)
        hits = hits.join(small[1], "item_key").select("doc_id", "text_key", "item_key", "at", "doc_words", *_around(window))
        found = hits.select("doc_id", "text_key", "item_key", _matched(window).alias("matched")).filter(F.col("matched") >= similarity)
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "text_key", "item_key").agg(F.max("matched").alias("matched"))


def find_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_words: int = 5,
    **options,
) -> DataFrame:
    """One row for each document and benchmark item that overlap: ``doc_id, text_key, item_id, matched`` (best share of a window).

    ``text_key`` is the hash of the document's text, so that rows which share an id, or have none, are judged by their own text.

    Items shorter than ``window`` words are compared as a whole; items of fewer than ``min_words`` words
    match nothing, and so do null and empty texts. Repeated rows and repeated items change nothing; items with the same words are looked for once.
    A benchmark of up to ``most_blocks`` blocks of about ``block_words`` words is broadcast block by block, each of which is laid
    against all documents in a pass of its own. A larger one is shuffled: see ``_shuffled``. Both ways find the same. Options: see ``_overlaps``.
    """
    known = _items(benchmark, item_col, item_text_col, min_words)
    found = _overlaps(docs, known, id_col=id_col, text_col=text_col, **options).join(known.select("item_key", "item_id"), "item_key")
    return found.groupBy("doc_id", "text_key", "item_id").agg(F.max("matched").alias("matched"))


def _shuffled(pieces: DataFrame, keyed: DataFrame, items: DataFrame, seeds: DataFrame, near: list[Column], window: int, sieve_bits: int, salts: int) -> DataFrame:
    """The hits of a benchmark of any size, in two passes over the documents and one shuffle of their words.

    A bitmap of at most ``2**sieve_bits`` bits, which is all that is broadcast, holds the seeds of the benchmark; only document seeds whose bit is set
    are shuffled, dealt to ``salts`` tasks for each seed, so one that is in very many documents is no task of its own. Seeds meet without words; those
    of the document come from the piece in which a hit lies, those of the item, as far as windows around it reach, from the item.
    """
    sieve_bits = min(sieve_bits, max(16, math.ceil(math.log2(max(1, seeds.count()))) + 6))  # 64 bits a seed
    place = F.pmod("seed", F.lit(1 << sieve_bits))
    bits = seeds.select(place.alias("p")).groupBy(F.shiftright("p", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("p") % 32768).alias("bitmap"))
    bits = bits.select("part", F.expr("transform(sequence(0, 511), k -> CAST(conv(hex(substring(bitmap, 8 * k + 1, 8)), 16, -10) AS BIGINT))").alias("longs"))  # eight bytes each, the first on top
    at, long = (F.col("p") % 32768).cast("int"), F.expr("get(longs, CAST((p % 32768) DIV 64 AS INT))")
    bit = (7 - F.shiftright(at, 3) % 8) * 8 + at % 8
    sieved = keyed.select("doc_id", "text_key", "piece", "at", "seed", place.alias("p")).withColumn("part", F.shiftright("p", 15))
    sieved = sieved.join(F.broadcast(bits), "part").filter(F.getbit(long, bit) == 1)
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    dealt = sieved.select("doc_id", "text_key", "piece", "at", "seed", F.pmod(F.xxhash64("text_key", "doc_id", "piece", "at"), F.lit(salts)).cast("int").alias("salt"))
    hits = dealt.join(seeds.select("*", salt), ["seed", "salt"]).select("doc_id", "text_key", "piece", "at", "salt", "item_key", "item_at").distinct()
    said = pieces.select(F.col("doc_id").alias("t_id"), F.col("text_key").alias("t_key"), F.col("piece").alias("t_piece"), F.array_join("doc_words", " ").alias("said"))  # words hold no blank
    met = hits.join(said, F.expr("doc_id <=> t_id AND text_key = t_key AND piece = t_piece")).withColumn("doc_words", F.split("said", " "))
    met = met.select("doc_id", "text_key", "salt", "item_key", "item_at", *near)
    return met.join(items.select("*", salt), ["item_key", "salt"]).select("doc_id", "text_key", "item_key", "at", "doc_words", *_around(window))


def _matched(window: int) -> Column:
    """The best share of agreeing words in all windows of the item that hold the first word of the hit."""
    span = f"least({window}, item_size)"
    low, high = f"greatest(0, item_at - {span} + 1)", f"least(item_size, item_at + {span}) - 1"
    agree = "CASE WHEN at - item_at + {j} >= 0 AND get(doc_words, at - item_at + {j}) = get(item_words, {j}) THEN 1 ELSE 0 END"
    # x.n agreeing words in the window that ends at j; x.best of the whole windows so far
    new = f"x.n + {agree.format(j='j')} - CASE WHEN j - {span} >= {low} THEN {agree.format(j=f'(j - {span})')} ELSE 0 END"
    # windows that are not whole yet are part of the first whole one, so they never hold more
    step = f"named_struct('n', {new}, 'best', greatest(x.best, {new}))"
    return F.expr(f"aggregate(sequence({low}, {high}), named_struct('n', 0, 'best', 0), (x, j) -> {step}, x -> x.best) / {span}")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_words: int = 5, **options
) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, contaminated, n_items, item_ids, matched``.

    ``item_ids`` lists the overlapping benchmark items in ascending order and is empty for clean
    documents; ``matched`` is 0 there. Every row is judged by its own text, also where ids repeat or are null. Other
    columns are ignored, whatever their names. Options: see ``find_overlaps``.
    """
    known = _items(benchmark, item_col, item_text_col, min_words)
    found = (
        _overlaps(docs, known, id_col=id_col, text_col=text_col, **options)
        .join(known.groupBy("item_key").agg(F.collect_set("item_id").alias("ids")), "item_key")
        .groupBy(F.col("doc_id").alias("found_id"), F.col("text_key").alias("found_key"))
        .agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("item_ids"), F.max("matched").alias("matched"))
    )
    return (
        docs.select(F.col(id_col).alias("doc_id"), _text_key(text_col))
        .join(found, F.expr("doc_id <=> found_id AND text_key = found_key"), "left")
        .select(
            "doc_id",
            F.col("matched").isNotNull().alias("contaminated"),
            F.when(F.col("matched").isNull(), 0).otherwise(F.size("item_ids")).cast("long").alias("n_items"),
            F.coalesce("item_ids", F.array()).alias("item_ids"),
            F.round(F.coalesce("matched", F.lit(0.0)), 6).alias("matched"),
        )
    )


def clean_only(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_words: int = 5, **options
) -> DataFrame:
    """The rows of ``docs`` whose text overlaps no benchmark item, with all their columns."""
    leaks = _overlaps(docs, _items(benchmark, item_col, item_text_col, min_words), id_col=id_col, text_col=text_col, **options)
    leaks = leaks.select(F.col("doc_id").alias("__leak_id"), F.col("text_key").alias("__leak_key")).distinct()
    met = docs[id_col].eqNullSafe(leaks["__leak_id"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == leaks["__leak_key"])
    return docs.join(leaks, met, "left_anti")
