"""Mixing towards target weights with soft domain membership.

A labelled table gives each hashed word its log-likelihood in every domain; the sum over a document's
words gives the document's domain posteriors. A nonnegative rate for each document is then fitted by
projected gradient on the least squares ``|A r - T|^2``, where ``A`` holds the expected tokens of each
document in each domain and ``T`` the wanted totals. A step needs ``A r`` only, which is one number a
domain; the rates themselves never leave the executors. A fit that misses a target raises an error.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.scratch import materialize

#: Steps without a thousandth of progress after which targets count as out of reach; tries with a larger total.
STALLED = 50
GROWTHS = 12


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def domain_table(labelled: DataFrame, text_col: str, label_col: str, buckets: int, max_domains: int) -> tuple[list, DataFrame, list[float]]:
    """Domains, the table ``(bucket, l0, l1, ...)`` of log-likelihoods with add-one smoothing, and log-priors.

    The table has ``buckets`` rows at most and a column for each domain; more than ``max_domains`` raise an error.
    """
    rows = labelled.filter(F.col(label_col).isNotNull()).select(F.col(label_col).alias("label"), F.col(text_col).alias("text"))
    found = rows.groupBy("label").count().orderBy("label").limit(max_domains + 1).collect()
    if len(found) > max_domains:
        raise ValueError(f"more than {max_domains} domains")
    domains = [r["label"] for r in found]
    total = sum(r["count"] for r in found)
    priors = [math.log(r["count"] / total) for r in found]
    if not domains:
        return [], rows, []
    counts = (
        rows.select("label", F.explode(words(F.col("text"))).alias("w"))
        .groupBy(F.pmod(F.xxhash64("w"), F.lit(buckets)).alias("bucket"))
        .agg(*[F.count_if(F.col("label") == d).alias(f"n{k}") for k, d in enumerate(domains)])
    )
    counts = materialize(counts, "mix-counts")
    sums = counts.agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(len(domains))]).first()
    likely = [F.log((F.col(f"n{k}") + 1.0) / ((sums[k] or 0) + buckets)).alias(f"l{k}") for k in range(len(domains))]
    return domains, counts.select("bucket", *likely), priors


def posteriors(docs: DataFrame, model: tuple[list, DataFrame, list[float]], text_col: str, id_col: str, buckets: int, flat: float) -> DataFrame:
    """``doc_id, tokens, p0, p1, ...`` for each id. ``flat`` scales the log-likelihood of a word, since neighbours aren't independent."""
    domains, likely, priors = model
    ids = range(len(domains))
    hits = docs.select(F.col(id_col).alias("s_id"), F.explode(words(F.col(text_col))).alias("w"))
    scored = (
        hits.withColumn("bucket", F.pmod(F.xxhash64("w"), F.lit(buckets)))
        .join(F.broadcast(likely), "bucket", "left")  # at most `buckets` rows
        .groupBy("s_id")
        .agg(F.count("*").alias("n"), *[F.sum(f"l{k}").alias(f"l{k}") for k in ids])
    )
    rows = docs.select(F.col(id_col).alias("doc_id")).distinct().join(scored, F.expr("doc_id <=> s_id"), "left")
    rows = rows.withColumn("tokens", F.coalesce("n", F.lit(0)).cast("long"))
    logit = [F.coalesce(F.col(f"l{k}"), F.lit(0.0)) * flat + priors[k] for k in ids]
    rows = rows.select("doc_id", "tokens", *[x.alias(f"x{k}") for k, x in enumerate(logit)])
    top = F.greatest(*[F.col(f"x{k}") for k in ids]) if len(domains) > 1 else F.col("x0")
    rows = rows.select("doc_id", "tokens", *[F.exp(F.col(f"x{k}") - top).alias(f"e{k}") for k in ids])
    total = sum((F.col(f"e{k}") for k in ids), F.lit(0.0))
    return rows.select("doc_id", "tokens", *[(F.col(f"e{k}") / total).alias(f"p{k}") for k in ids])


def _gram(soft: DataFrame, domains: int) -> np.ndarray:
    """``A D^-1 A^T``: how the totals of the domains move together when documents move by tokens and posteriors."""
    ids = range(domains)
    sums = soft.agg(*[F.sum(F.col("tokens") * F.col(f"p{a}") * F.col(f"p{b}")).alias(f"g{a}_{b}") for a in ids for b in ids if a <= b]).first()
    return np.array([[sums[f"g{min(a, b)}_{max(a, b)}"] or 0.0 for b in ids] for a in ids])


def _inverse(gram: np.ndarray) -> np.ndarray:
    """The pseudo-inverse, scaled first so that a rare domain counts like a common one."""
    d = np.sqrt(np.diag(gram))
    d = np.where(d > 0, d, 1.0)
    return np.linalg.pinv(gram / np.outer(d, d), rcond=1e-12, hermitian=True) / np.outer(d, d)


def fit_rates(soft: DataFrame, shares: list[float], total_tokens: float, tolerance: float, max_steps: int, steps_per_table: int, low: float = 0.0, strict: bool = True) -> DataFrame:
    """Add ``rate``, at least ``low``, to ``soft (doc_id, tokens, p0, ...)`` so that expected tokens of domain k come to ``shares[k] * total_tokens``.

    Each total is met within ``tolerance`` of itself (of all tokens where a share is 0); a ``ValueError`` says which
    are not, or, unless ``strict``, the fit stands that is the nearest when it stops to improve. The step is taken in the metric that weighs a document by its tokens, and the misfit is scaled by
    the inverse of the domains' Gram matrix: no eigenvalue is above 1, rare domains move as fast as common
    ones, and without an active bound the first step is exact. Nesterov's momentum carries the previous
    rates along and starts again when the misfit grows.
    """
    ids = range(len(shares))
    scale = max(1.0, total_tokens)
    gram = _gram(soft, len(shares)) / scale
    inverse = _inverse(gram)
    mean = gram.sum()
    now = soft.withColumn("rate", F.lit(float(max(low, 1.0 / mean if mean else 0.0)))).withColumn("ahead", F.col("rate"))
    now = materialize(now, "mix-rates")
    want = np.array(shares)
    t, last, best, since = 1.0, math.inf, math.inf, 0
    for done in range(max_steps + 1):
        got = now.agg(
            *[F.sum(F.col("tokens") * F.col(f"p{k}") * F.col("ahead")).alias(f"a{k}") for k in ids],
            *[F.sum(F.col("tokens") * F.col(f"p{k}") * F.col("rate")).alias(f"r{k}") for k in ids],
        ).first()
        off = np.array([got[f"r{k}"] or 0.0 for k in ids]) / scale - want
        miss = np.abs(off) / np.where(want > 0, want, 1.0)
        if miss.max() <= tolerance:
            return now.drop("ahead")
        value = float(off @ inverse @ off)
        since = 0 if value < 0.999 * best else since + 1
        best = min(best, value)
        if done == max_steps or since >= STALLED:
            break
        t = 1.0 if value > last else t
        last = value
        push_by = inverse @ (np.array([got[f"a{k}"] or 0.0 for k in ids]) / scale - want)
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        push = (t - 1) / after
        t = after
        slope = sum((F.col(f"p{k}") * float(push_by[k]) for k in ids), F.lit(0.0))
        now = now.withColumn("next", F.greatest(F.lit(float(low)), F.col("ahead") - slope))
        now = now.withColumn("ahead", F.col("next") + push * (F.col("next") - F.col("rate"))).withColumn("rate", F.col("next")).drop("next")
        if (done + 1) % steps_per_table == 0:
            now = materialize(now, "mix-rates")
    if not strict:
        return materialize(now.drop("ahead"), "mix-rates")
    raise ValueError(f"after {done} steps domains miss their targets by a part of {[float(f'{x:.3g}') for x in miss]} (shares {shares}); allowed is {tolerance}")


def reachable(soft: DataFrame, shares: list[float]) -> list[float]:
    """``shares`` themselves, or, where the posteriors of the domains move together, the nearest ones that some rates of documents can give."""
    gram = _gram(soft, len(shares))
    d = np.sqrt(np.diag(gram))
    d = np.where(d > 0, d, 1.0)
    value, vector = np.linalg.eigh(gram / np.outer(d, d))
    vector = vector[:, value > 1e-9 * max(value.max(), 1e-300)]
    if vector.shape[1] == len(shares):
        return shares
    near = np.maximum(d * (vector @ (vector.T @ (np.array(shares) / d))), 0.0)
    return (near / near.sum()).tolist() if near.sum() > 0 else shares


def fit_with_least(
    soft: DataFrame, shares: list[float], total: float, tolerance: float, max_steps: int, steps_per_table: int, low: float, strict: bool = True
) -> DataFrame:
    """``fit_rates`` with rates of at least ``low`` and the total scaled up until the shares can be met under it.

    The unbounded fit is ``p . mu`` for one ``mu``; where it is positive, the total is scaled so that the smallest
    of these rates is ``low``. Else the total grows from the least that any fit needs.
    """
    if not low:
        return fit_rates(soft, shares, total, tolerance, max_steps, steps_per_table, strict=strict)
    ids = range(len(shares))
    mu = _inverse(_gram(soft, len(shares))) @ (np.array(shares) * total)
    rate = sum((F.col(f"p{k}") * float(mu[k]) for k in ids), F.lit(0.0))
    sums = soft.filter("tokens > 0").agg(F.min(rate).alias("least"), *[F.sum(F.col("tokens") * F.col(f"p{k}")).alias(f"s{k}") for k in ids]).first()
    if sums["least"] > 0:
        return fit_rates(soft, shares, total * max(1.0, low / sums["least"]), tolerance, max_steps, steps_per_table, low, strict)
    times = max(1.0, *(low * sums[f"s{k}"] / (shares[k] * total) for k in ids if shares[k] > 0))
    for grown in range(GROWTHS):
        try:
            return fit_rates(soft, shares, total * times * 1.5**grown, tolerance, max_steps, steps_per_table, low)
        except ValueError as missed:
            reason = missed
    if not strict:
        return fit_rates(soft, shares, total * times, tolerance, max_steps, steps_per_table, low, strict)
    raise ValueError(f"no total meets the targets with rates of {low} at least") from reason


def mix(
    docs: DataFrame,
    targets: dict[str, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "lang",
    labelled: DataFrame | None = None,
    temperature: float = 0.7,
    fit_rows: int = 20_000,
    buckets: int = 1 << 12,
    max_domains: int = 64,
    flat: float = 0.5,
    tolerance: float = 1e-4,
    max_steps: int = 1000,
    steps_per_table: int = 4,
    min_copies: int = 0,
    seed: int = 7,
) -> DataFrame:
    """One row for each id of ``docs``: ``doc_id, tokens, domain, posterior, rate, copies, target_miss``.

    targets: the wanted share of tokens of each domain (scaled to sum 1; domains left out get 0); by
    default the expected shares raised to ``temperature``. Each target that is asked for is met within ``tolerance`` of itself, or a
    ``ValueError`` is raised. Default targets give way where the texts don't tell the domains apart: they are the nearest ones that posteriors can
    reach, and if the fit still misses them it stands; ``target_miss``, alike in all rows, is the largest miss as a part of its target. The total stays that of ``docs``; with ``min_copies`` no rate is below it, and the
    total grows until the shares are met all the same. The table of
    likelihoods is learned from ``labelled`` (by default ``docs``), of whose rows with a label about
    ``fit_rows`` are used, chosen by hash: the bound of the classifier's sample. Posteriors, token totals and rates cover
    all rows. ``copies`` is the rate rounded up or down at random by a hash of the id.

    Rows that share an id (or have none) count as one document whose texts are joined. Null and empty texts
    have no tokens, the prior as posteriors and the rate that follows. Without any label there are no domains:
    ``domain`` is null and every rate 1. Of equal posteriors the first domain in order of name is reported.
    An empty table gives no rows; other columns are ignored.
    """
    source = docs if labelled is None else labelled
    known = source.filter(F.col(label_col).isNotNull())
    n = known.count()
    marks = [c for c in (id_col, text_col, label_col) if c in known.columns]
    taken = F.pmod(F.xxhash64(*marks, F.lit(seed)), F.lit(1 << 30)) < math.floor(min(1.0, fit_rows / max(1, n)) * (1 << 30))
    chosen = known.filter(taken).select(F.col(label_col).alias("label"), F.col(text_col).alias("text"))
    model = domain_table(chosen, "text", "label", buckets, max_domains)
    domains = model[0]
    if not domains:
        plain = docs.select(F.col(id_col).alias("doc_id"), F.size(words(F.col(text_col))).alias("n"))
        return plain.groupBy("doc_id").agg(F.sum("n").cast("long").alias("tokens")).select(
            "doc_id", "tokens", F.lit(None).cast("string").alias("domain"), F.lit(None).cast("double").alias("posterior"), F.lit(1.0).alias("rate"), F.lit(max(1, min_copies)).cast("long").alias("copies"), F.lit(0.0).alias("target_miss")
        )
    soft = materialize(posteriors(docs, model, text_col, id_col, buckets, flat), "mix-soft")
    ids = range(len(domains))
    sums = soft.agg(*[F.sum(F.col("tokens") * F.col(f"p{k}")).alias(f"s{k}") for k in ids]).first()
    total = sum(x or 0.0 for x in sums)
    raw = [(x or 0.0) / total if total else 0.0 for x in sums]
    wanted = [targets.get(d, 0.0) for d in domains] if targets else [x**temperature if x > 0 else 0.0 for x in raw]
    whole = sum(wanted)
    shares = [x / whole for x in wanted] if whole else raw
    if not targets and total:
        shares = reachable(soft, shares)
    rated = fit_with_least(soft, shares, total, tolerance, max_steps, steps_per_table, float(min_copies), bool(targets)) if total else soft.withColumn("rate", F.lit(1.0))
    got = rated.agg(*[F.sum(F.col("tokens") * F.col(f"p{k}") * F.col("rate")).alias(f"g{k}") for k in ids]).first()
    given = sum(x or 0.0 for x in got)
    miss = max((abs((got[k] or 0.0) / given - x) / (x if x > 0 else 1.0) for k, x in enumerate(shares)), default=0.0) if given else 0.0
    top = F.greatest(*[F.col(f"p{k}") for k in ids]) if len(domains) > 1 else F.col("p0")
    name = F.coalesce(*[F.when(F.col(f"p{k}") == top, d) for k, d in enumerate(domains)])
    chance = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 24)) / float(1 << 24)
    copies = F.floor(F.col("rate")) + (chance < F.col("rate") - F.floor("rate")).cast("long")
    return rated.select(
        "doc_id", "tokens", name.cast("string").alias("domain"), top.alias("posterior"), "rate", F.greatest(copies, F.lit(min_copies).cast("long")).alias("copies"), F.lit(float(miss)).alias("target_miss")
    )


def apply_mix(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, each as often as ``mixed`` says, with the columns of ``docs``."""
    plan = mixed.select(F.col("doc_id").alias("__mix_id"), F.col("copies").alias("__copies"))
    joined = docs.join(plan, docs[id_col].eqNullSafe(plan["__mix_id"])).filter("__copies > 0")
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*[joined[c] for c in docs.columns])
