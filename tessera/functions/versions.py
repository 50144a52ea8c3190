"""Order-preserving keys of package versions: strings that sort like the versions of an ecosystem."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters before which a key's bin ends: an epoch and the first number. Bins sort like the versions.
BIN = 28
DIGITS = 20
#: Version rules by ecosystem; all others go by semantic versions.
STYLE = {"PyPI": "pep440", "Maven": "maven", "RubyGems": "gems"}
#: What PEP 440 takes as one kind of pre-release.
PRE = {"a": "0", "alpha": "0", "b": "1", "beta": "1", "c": "2", "rc": "2", "pre": "2", "preview": "2"}
#: Qualifiers of Maven in order; a release stands between snapshot and sp.
QUALIFIER = {"alpha": "1", "a": "1", "beta": "2", "b": "2", "milestone": "3", "m": "3", "rc": "4", "cr": "4", "snapshot": "5", "ga": "6", "final": "6", "release": "6", "sp": "70"}
PEP440 = (
    r"^\s*v?(?:([0-9]+)!)?([0-9]+(?:\.[0-9]+)*)(?:[._-]?(alpha|beta|preview|pre|rc|a|b|c)[._-]?([0-9]*))?"
    r"(?:-([0-9]+)|[._-]?(post|rev|r)[._-]?([0-9]*))?(?:[._-]?(dev)[._-]?([0-9]*))?(?:\+([a-z0-9._-]+))?\s*$"
)


def _number(digits: Column) -> Column:
    """Digits of any count up to twenty, as text that sorts like the number; none counts as 0."""
    return F.lpad(F.regexp_replace(digits, "^0+", ""), DIGITS, "0")


def _numbers(dotted: Column, parts: int) -> Column:
    every = F.concat(F.split(dotted, r"\."), F.array_repeat(F.lit("0"), parts))
    return F.array_join(F.transform(F.slice(every, 1, parts), _number), ".")


def _pick(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def _semantic(v: Column) -> Column:
    """Numbers, then pre-releases before the release; build metadata doesn't count."""
    numbers = F.regexp_extract(v, r"^[^0-9]*([0-9]+(?:\.[0-9]+)*)", 1)
    pre = F.regexp_extract(v, r"^[^0-9]*[0-9]+(?:\.[0-9]+)*[.-]?([A-Za-z-][0-9A-Za-z.-]*|(?<=-)[0-9A-Za-z.-]+)", 1)
    ids = F.transform(F.split(F.regexp_replace(pre, "^-", ""), r"\."), lambda x: F.when(x.rlike("^[0-9]+$"), F.concat(F.lit("0"), _number(x))).otherwise(F.concat(F.lit("1"), x)))
    return F.concat(F.lit("000000."), _numbers(numbers, 6), F.when(pre == "", "~").otherwise(F.concat(F.lit("-"), F.array_join(ids, "\u0001"))))


def _pep440(v: Column) -> Column:
    """Epoch, release, then development, pre-, plain and post-releases; a local version follows its public one."""
    low = F.lower(v)
    g = lambda k: F.regexp_extract(low, PEP440, k)
    pre, post, dev = g(3) != "", (g(5) != "") | (g(6) != ""), g(8) != ""
    phase = F.when(pre, F.concat(F.lit("b"), _pick(PRE, g(3)), _number(g(4)))).when(~post & dev, "a").otherwise("c")
    after = F.when(post, F.concat(F.lit("1"), _number(F.concat(g(5), g(7))))).otherwise("0")
    under = F.when(dev, F.concat(F.lit("0"), _number(g(9)))).otherwise("1")
    key = F.concat(F.lpad(F.regexp_replace(g(1), "^0+", ""), 6, "0"), F.lit("."), _numbers(g(2), 6), F.lit("."), phase, F.lit("."), after, F.lit("."), under, F.when(g(10) != "", F.concat(F.lit("+"), g(10))).otherwise(""))
    return F.when(low.rlike(PEP440), key).otherwise(_semantic(v))


def _tokens(v: Column, word: Column | None, ending: str) -> Column:
    """Numbers after words; the end stands between words and numbers, where an empty part would."""
    parts = F.regexp_extract_all(v, F.lit("[0-9]+|[a-z]+"), F.lit(0))
    first, rest = F.try_element_at(parts, F.lit(1)), F.slice(parts, 2, 1 << 20)
    named = lambda t: F.concat(F.lit("5"), t, F.lit("\u0001")) if word is None else F.coalesce(_pick(QUALIFIER, t), F.concat(F.lit("71"), t, F.lit("\u0001")))
    one = lambda t: F.when(t.rlike("^[0-9]"), F.concat(F.lit("8"), _number(t))).otherwise(named(t))
    lead = F.when(F.coalesce(first, F.lit("")).rlike("^[0-9]"), _number(first)).otherwise(F.concat(F.lit("0" * DIGITS), F.coalesce(one(first), F.lit(""))))
    return F.concat(F.lit("000000."), lead, F.array_join(F.transform(rest, one), ""), F.lit(ending))


def _maven(v: Column) -> Column:
    """Qualifiers in their order, unknown ones after the release; zeros and words for a release count for nothing at the end of a part."""
    return _tokens(F.regexp_replace(F.lower(v), r"(?:[.-](?:0+|ga|final|release))+(?=$|-[a-z]|[.-]?(?:alpha|beta|milestone|rc|cr|snapshot|sp)\b)", ""), F.lit(""), "6")


def _gems(v: Column) -> Column:
    """A part with letters is a pre-release."""
    return _tokens(F.regexp_replace(F.lower(v), r"(?:\.0+)+(?=$|[.-]?[a-z])", ""), None, "6")


def version_key(v: Column, ecosystem: Column | None = None) -> Column:
    """A text that sorts like ``v`` among the versions of its ``ecosystem``: PyPI, Maven and RubyGems by their own rules, all others by semantic versions.

    A leading ``v`` (or anything before the first digit) doesn't count. Numbers may have twenty digits. Null gives null.
    """
    if ecosystem is None:
        return _semantic(v)
    out = _semantic(v)
    for name, style in STYLE.items():
        out = F.when(ecosystem == name, {"pep440": _pep440, "maven": _maven, "gems": _gems}[style](v)).otherwise(out)
    return out


def version_bin(key: Column) -> Column:
    """The part of a key up to the first number: keys of one order have bins of the same order."""
    return F.substring(key, 1, BIN)
