"""Text that a language model wrote: JSON inside it, patches held against files, and threat models brought to one shape."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.plans.scratch import materialize

BLANKS = " \t\n\r\f\v"
QUOTED_OR_BRACE = re.compile(r'"(?:[^"\\]|\\.)*"?|[{}]', re.S)


def first_object(text: str | None) -> str | None:
    """The first balanced ``{...}`` of a text; braces inside quotes don't count."""
    depth, start = 0, 0
    for m in QUOTED_OR_BRACE.finditer(text or ""):
        if m[0] == "{":
            start = start if depth else m.start()
            depth += 1
        elif m[0] == "}" and depth:
            depth -= 1
            if not depth:
                return text[start : m.end()]
    return None


@F.pandas_udf(StringType())
def _balanced(texts: pd.Series) -> pd.Series:
    return texts.map(first_object)


#: How JSON begins. Prose is told by it without a parse, which costs most where it fails.
BEGINS = r'\A(?:[{\["\-0-9\x{FEFF}]|true|false|null)'


def _valid(c: Column) -> Column:
    return F.when(c.rlike(BEGINS), F.when(F.try_parse_json(c).isNotNull(), c))


def _trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def _direct(whole: Column) -> Column:
    """A trimmed text that is JSON, or what its fence holds if that is."""
    fenced = F.when(whole.startswith("```"), _trimmed(F.regexp_replace(whole, r"\A```(?:json|JSON)?|```\z", "")))
    return F.coalesce(_valid(whole), _valid(fenced))


def extract_json(text: Column) -> Column:
    """The JSON in a model's text: the whole text, else what a fence holds, else the first balanced object; null if none of these parses."""
    whole = _trimmed(text)
    direct = _direct(whole)
    return F.coalesce(direct, _valid(_balanced(F.when(direct.isNull(), whole))))


def with_json(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """``df`` with ``out``, the JSON in ``text_col`` as ``extract_json`` finds it. What is generated is computed once, however often later columns name it."""
    rows = df.withColumn("__whole", _trimmed(F.col(text_col)))
    rows = rows.select("*", F.explode(F.array(_direct(F.col("__whole")))).alias("__direct"))
    found = F.coalesce("__direct", _valid(_balanced(F.when(F.col("__direct").isNull(), F.col("__whole")))))
    return rows.select(*df.columns, F.explode(F.array(found)).alias(out))


def _parsed(models: DataFrame, id_col: str, json_col: str, keep: tuple[str, ...]) -> DataFrame:
    rows = with_json(models.select(id_col, *keep, F.col(json_col).alias("__text")), "__text", "__json")
    return rows.select(id_col, *keep, F.explode(F.array(F.from_json("__json", "map<string,string>"))).alias("m")).filter("m IS NOT NULL")


def parse_models(models: DataFrame, id_col: str = "model_id", json_col: str = "model", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col, keep..., m``: the maps of raw JSON of all models that are JSON objects, found as by ``extract_json`` and written once, so that any number of parts is read from one parse."""
    return materialize(_parsed(models, id_col, json_col, keep), "models")


HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+\d+(?:,\d+)? @@")


def patch_fits(patch: str, path: str, start: int, end: int, content: str) -> bool:
    """Whether a unified diff is for ``path``, all its hunks' old lines stand in ``content`` side by side, and one hunk covers some of lines ``start`` to ``end`` and holds one of them."""
    bare = lambda p: re.sub(r"^(?:a/)*(?:b/)*", "", p.strip())
    lines = (patch or "").strip().splitlines()
    old = [x[4:] for x in lines if x.startswith("--- ")]
    new = [x[4:] for x in lines if x.startswith("+++ ")]
    if not any(bare(x[-1]) == bare(path) for x in (old, new) if x):
        return False
    hunks: list[tuple[int, int, list[str]]] = []
    now = None
    for x in lines:
        if x.startswith("@@"):
            m = HUNK.match(x)
            now = (int(m[1]), int(m[2] or 1), []) if m else None
            if now:
                hunks.append(now)
        elif now and x[:1] in (" ", "-"):
            now[2].append(x[1:])
    hunks = [h for h in hunks if h[2]]
    text = (content or "").replace("\r\n", "\n")
    body = text.removesuffix("\n").split("\n") if text else []
    whole = "\n" + "\n".join(body) + "\n"
    if not hunks or any("\n" + "\n".join(h[2]) + "\n" not in whole for h in hunks):
        return False
    first, last = max(1, start), max(start, end)
    if first > len(body):
        return False
    wanted = set(body[first - 1 : last])
    return any(a <= last and a + max(0, n - 1) >= first and wanted & set(old) for a, n, old in hunks)


def validate_patches(patches: DataFrame, findings: DataFrame, files: DataFrame) -> DataFrame:
    """``patches`` with ``grounded``: whether each fits its finding's file and lines. Without the finding, or its file, it does not.

    ``findings`` has ``finding_id, repo_id, file_path, line_start`` and perhaps ``line_end``. Every row is judged by itself.
    """

    @F.pandas_udf("boolean")
    def fits(patch: pd.Series, path: pd.Series, start: pd.Series, end: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series([patch_fits(*x) for x in zip(patch, path, start, end, content, strict=True)])

    end = F.col("line_end") if "line_end" in findings.columns else F.col("line_start")
    places = findings.select("finding_id", "repo_id", F.col("file_path").alias("__path"), F.coalesce("line_start", F.lit(1)).alias("__start"), F.coalesce(end, "line_start", F.lit(1)).alias("__end"))
    file = lambda p: F.struct("repo_id", F.col(p).alias("path")).alias("__file")  # noqa: E731  a struct's null fields are equal
    places = places.select("finding_id", "__path", "__start", "__end", file("__path"))
    asked_for = places.join(patches.select("finding_id"), "finding_id", "left_semi").select("__file").distinct()
    # only contents of files with a patch are shuffled on; where there are few, Spark broadcasts their names and shuffles no others
    body = files.select(file("file_path"), F.col("content").alias("__content")).join(asked_for, "__file", "left_semi").groupBy("__file").agg(F.max("__content").alias("__content"))
    both = patches.join(places, "finding_id", "left").join(body, "__file", "left")
    asked = F.coalesce(F.col("patch"), F.lit("")), F.coalesce(F.col("__path"), F.lit("")), F.coalesce("__start", F.lit(1)), F.coalesce("__end", F.lit(1)), F.coalesce("__content", F.lit(""))
    return both.withColumn("grounded", F.col("__path").isNotNull() & F.col("__content").isNotNull() & fits(*asked)).select(*patches.columns, "grounded")


#: Keys under which a part of a threat model may stand, in order of preference.
PARTS = {
    "threats": ("threats", "risks", "potential_threats"),
    "surfaces": ("surfaces", "attack_surfaces", "security_concerns"),
    "data_flows": ("data_flows", "dataflows", "sensitive_data_flows"),
    "boundaries": ("boundaries", "trust_boundaries"),
    "assumptions": ("assumptions", "model_assumptions"),
    "mitigations": ("mitigations", "countermeasures", "actions", "remediations"),
    "validation_plan": ("validation_plan", "validation", "verification"),
    "assurance_claims": ("assurance_claims", "assurance", "security_claims"),
}
#: Keys of each field of an item.
FIELDS = {
    "threats": {
        "description": ("description", "detail", "scenario", "what_can_go_wrong"), "name": ("name", "title", "threat", "risk"), "related_surface": ("related_surface", "surface", "attack_surface"),
        "likelihood": ("likelihood", "probability", "exploitability"), "impact": ("impact", "damage"), "risk_level": ("risk_level", "severity", "risk"), "risk_treatment": ("risk_treatment", "treatment", "decision"),
    },
    "surfaces": {
        "description": ("description", "detail", "recommendation", "notes"), "name": ("name", "concern", "title", "issue"), "endpoint": ("endpoint", "path", "route", "url"),
        "file": ("file", "location", "source_file"), "line": ("line", "line_number"), "risk_level": ("risk_level", "severity", "risk"),
    },
    "data_flows": {"source": ("source", "from", "origin"), "sink": ("sink", "to", "target"), "sensitive_data": ("sensitive_data", "data", "data_type", "kind"), "description": ("description", "detail"), "name": ("name", "title")},
    "boundaries": {"from_zone": ("from_zone", "source", "from", "origin", "trust_from"), "to_zone": ("to_zone", "sink", "to", "target", "trust_to"), "description": ("description", "detail"), "name": ("name", "title", "boundary")},
    "assumptions": {
        "statement": ("statement", "assumption", "name", "title"), "why_it_matters": ("why_it_matters", "impact", "risk"),
        "how_to_validate": ("how_to_validate", "validation", "verification"), "stale_if": ("stale_if", "review_when", "trigger"),
    },
    "mitigations": {
        "threat": ("threat", "threat_name", "risk"), "action": ("action", "mitigation", "countermeasure", "recommendation"), "risk_treatment": ("risk_treatment", "treatment", "decision"),
        "status": ("status", "state"), "validation": ("validation", "how_to_validate", "verification"), "owner": ("owner", "team", "component"),
    },
    "validation_plan": {
        "target": ("target", "threat", "mitigation", "assumption"), "method": ("method", "test", "check", "validation"), "expected_evidence": ("expected_evidence", "evidence", "proof"),
        "automation": ("automation", "automated_by", "tool"), "status": ("status", "state"),
    },
    "assurance_claims": {"claim": ("claim", "statement", "title"), "confidence": ("confidence", "level")},
}
#: Keys of fields that are lists of strings.
LISTS = {
    "threats": {"evidence": ("evidence", "references", "files")},
    "assumptions": {"evidence": ("evidence", "references", "files")},
    "assurance_claims": {"evidence": ("evidence", "supporting_evidence"), "gaps": ("gaps", "missing_evidence", "open_questions")},
    "scope": {
        "in_scope": ("in_scope", "included", "components"), "out_of_scope": ("out_of_scope", "excluded", "limits"),
        "assets": ("assets", "protected_assets", "sensitive_assets"), "entry_points": ("entry_points", "entrypoints", "inputs"),
    },
}
#: Fields that an item which is a bare string fills, where these are not its name and description.
SAID = {"assumptions": ("statement",), "mitigations": ("action",), "validation_plan": ("target", "method"), "assurance_claims": ("claim",)}
#: What a field says where the model says nothing.
DEFAULTS = {
    "assumptions": {
        "statement": "Unspecified assumption", "why_it_matters": "Assumption affects the threat model's accuracy.",
        "how_to_validate": "Review implementation and runtime configuration.", "stale_if": "Architecture, infrastructure, or authentication behavior changes.",
    },
    "mitigations": {"threat": "Unspecified threat", "action": "Define a concrete mitigation.", "validation": "Verify the mitigation through code review or security testing."},
    "validation_plan": {
        "target": "Unspecified validation target", "method": "Manual security review", "expected_evidence": "Evidence that the target was checked successfully.", "automation": "manual",
    },
    "assurance_claims": {"claim": "Unspecified assurance claim"},
}
#: Keys and defaults of a model's head.
HEAD = {
    "summary": ("summary", "overview", "description", "analysis_summary"), "scope": ("scope", "subject", "system_scope"),
    "subject": ("subject", "name", "application", "repo"), "system_type": ("system_type", "type", "architecture"),
}
#: Texts where a model says nothing of a threat, a surface, or an attack technique (bare, or without a reason).
FILLERS = {"threats": "Threat identified by provider output.", "surfaces": "Threat surface identified by provider output."}
RATIONALES = ("Mapping provided without structured detail.", "Mapping was present in provider output.")
NO_SUMMARY, NO_SUBJECT = "Threat model synthesized from non-standard provider output.", "Modeled system"
#: Keys of a threat's mappings to attack techniques, and of a mapping's fields.
ATTACK_KEYS = ("mitre_attack", "mitre", "attack_mappings", "attck", "attack")
ATTACK = {
    "tactic": ("tactic", "attack_tactic", "phase"), "technique_id": ("technique_id", "id", "attack_id", "mitre_id"), "technique": ("technique", "name", "attack_technique"),
    "confidence": ("confidence", "mapping_confidence"), "rationale": ("rationale", "reason", "evidence"),
}
#: Names of an item's status; others are proposed.
STATUSES = {"existing": ("existing", "implemented", "present"), "missing": ("missing", "absent"), "needs_validation": ("needs_validation", "needs validation", "unverified")}
STRIDE_KEYS = ("stride", "stride_categories", "categories")
#: Category, its letter and other names, and parts of words that tell it.
STRIDE = (
    ("spoofing", ("s",), ("spoof",)), ("tampering", ("t",), ("tamper",)), ("repudiation", ("r",), ("repudiat",)), ("information_disclosure", ("i",), ("disclosure",)),
    ("denial_of_service", ("d", "dos"), ("denial", "service")), ("elevation_of_privilege", ("e", "privilege_escalation"), ("privilege",)),
)
TREATMENTS = {"accept": ("accept", "accepted"), "transfer": ("transfer", "transferred"), "eliminate": ("eliminate", "avoid", "remove"), "monitor": ("monitor", "watch")}
#: Terms that a data flow may always end in.
GENERIC = ("user", "browser", "client", "database", "db", "api", "server", "external", "network", "cache", "queue", "storage", "memory", "file", "config", "env", "session")


def risk_level(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.contains("critical"), "critical").when(low.contains("high"), "high").when(low == "medium", "medium").when(low.contains("low"), "low").otherwise("medium")


def _lookup(words: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in words.items() for x in pair])


def _named(c: Column, names: dict[str, tuple[str, ...]], other: str) -> Column:
    known = _lookup({w: name for name, words in names.items() for w in words})
    return F.coalesce(F.try_element_at(known, F.replace(F.lower(F.trim(c)), F.lit("-"), F.lit("_"))), F.lit(other))


def treatment(c: Column) -> Column:
    return _named(c, TREATMENTS, "mitigate")


def item_status(c: Column) -> Column:
    return _named(c, STATUSES, "proposed")


def confidence_level(c: Column) -> Column:
    """``high`` and ``low`` as they are; all else is ``medium``."""
    return _named(c, {"high": ("high",), "low": ("low",)}, "medium")


def stride(values: Column) -> Column:
    """STRIDE categories of an array of names, letters or phrases, each once, in order; others are left out."""

    known = _lookup({w: name for name, others, _ in STRIDE for w in (name, *others)})

    def plain(v: Column) -> Column:
        return F.replace(F.replace(F.lower(F.trim(v)), F.lit(" "), F.lit("_")), F.lit("-"), F.lit("_"))

    def one(low: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, _, parts in reversed(STRIDE):
            for p in parts:
                out = F.when(low.contains(p), name).otherwise(out)
        return F.coalesce(F.try_element_at(known, low), out)

    return F.array_distinct(F.array_compact(F.transform(F.transform(values, plain), one)))  # each is made plain once


def _holds(c: Column, *brackets: str) -> Column:
    """Whether trimmed raw JSON is an object or a list, by its opening brackets."""
    opens = F.lit(False)
    for b in brackets:
        opens = opens | c.startswith(b)
    return opens & F.try_parse_json(c).isNotNull()


def _strings(c: Column) -> Column:
    """The strings in a value: those of a list, or the value itself; no objects, nulls and blanks."""
    listed = F.transform(F.when(_holds(c, "["), F.from_json(c, "array<string>")).otherwise(F.array(c)), lambda v: F.trim(v))
    return F.filter(listed, lambda v: v.isNotNull() & (v != "") & ~_holds(v, "[", "{"))


def _said(table: Column) -> Column:
    """A map of raw JSON with what each key says: a scalar, or the scalars of a list with commas between them; null for all else."""

    def one(_: Column, raw: Column) -> Column:
        plain = ~(raw.startswith("[") | raw.startswith("{"))
        return F.nullif(F.when(plain, raw).otherwise(F.array_join(_strings(raw), ", ")), F.lit(""))

    return F.transform_values(F.transform_values(table, lambda _, v: F.trim(v)), one)


def _first(said: Column, keys: tuple[str, ...]) -> Column:
    """The first of ``keys`` that says something in a map of ``_said``, which is made once for all fields."""
    return F.coalesce(*[said[k] for k in keys])


def _list(table: Column, keys: tuple[str, ...]) -> Column:
    """The strings under the first of ``keys`` that is there at all; an empty list without one."""
    found = F.coalesce(*[F.when(F.map_contains_key(table, F.lit(k)), _strings(table[k])) for k in keys])
    return F.coalesce(found, F.array().cast("array<string>"))


def _attack(table: Column) -> Column:
    """Mappings to attack techniques: a list, or one; a bare string is a tactic."""
    raw = lambda c: F.when(_holds(c, "["), F.from_json(c, "array<string>")).when(c.isNull(), F.array().cast("array<string>")).otherwise(F.array(c))
    found = F.coalesce(*[F.when(F.map_contains_key(table, F.lit(k)), raw(table[k])) for k in ATTACK_KEYS], F.array().cast("array<string>"))

    def parts(item: Column) -> Column:
        is_object = _holds(item, "{")
        return F.struct(F.when(~is_object, F.trim(item)).alias("said"), _said(F.when(is_object, F.from_json(item, "map<string,string>"))).alias("s"))

    def one(part: Column) -> Column:
        said = part["said"]
        got = {f: _first(part["s"], keys) for f, keys in ATTACK.items()}
        got["tactic"] = F.coalesce(said, got["tactic"], F.lit("unknown"))
        got["confidence"] = F.when(said.isNotNull(), "low").otherwise(confidence_level(got["confidence"]))
        got["rationale"] = F.when(said.isNotNull(), RATIONALES[0]).otherwise(F.coalesce(got["rationale"], F.lit(RATIONALES[1])))
        return F.struct(*[c.alias(f) for f, c in got.items()])

    return F.transform(F.transform(F.array_compact(found), parts), one)  # each is parsed once for all fields


def model_heads(models: DataFrame, id_col: str = "model_id", json_col: str = "model") -> DataFrame:
    """One row for each threat model that is a JSON object: the id, ``summary``, and its scope: ``subject``, ``system_type`` and lists of strings.

    A scope that is a string is its subject. Without a scope, subject and type are null and the lists are empty. ``models`` may be parsed already (``parse_models``).
    """
    rows = models if "m" in models.columns else _parsed(models, id_col, json_col, ())
    rows = rows.withColumn("raw", F.coalesce(*[F.col("m")[k] for k in HEAD["scope"]]))
    rows = rows.withColumn("o", F.when(_holds(F.col("raw"), "{"), F.from_json("raw", "map<string,string>")))
    rows = rows.withColumn("s", _said(F.col("o"))).withColumn("top", F.map_filter("m", lambda k, _: k.isin(*HEAD["summary"])))
    o, s, said = F.col("o"), F.col("s"), F.when(F.col("o").isNull(), F.trim("raw"))
    there = F.col("raw").isNotNull()
    return rows.select(
        id_col, F.coalesce(_first(_said(F.col("top")), HEAD["summary"]), F.lit(NO_SUMMARY)).alias("summary"),
        F.when(there, F.coalesce(said, _first(s, HEAD["subject"]), F.lit(NO_SUBJECT))).alias("subject"), F.when(there, F.coalesce(_first(s, HEAD["system_type"]), F.lit("unknown"))).alias("system_type"),
        *[_list(o, keys).alias(f) for f, keys in LISTS["scope"].items()],
    )


def model_items(models: DataFrame, part: str, id_col: str = "model_id", json_col: str = "model", keep: tuple[str, ...] = (), keep_model: bool = False) -> DataFrame:
    """One row for each item of a ``part`` of threat models: the id, columns to ``keep``, ``position`` from 1, and the part's fields (of threats also ``stride`` and ``mitre_attack``).

    The first key of ``PARTS`` that holds an array counts. An item that is a string is its own name and description. Missing fields get
    the defaults; levels, treatments and categories are brought to known values. Text that is no JSON object gives no rows. ``models`` may be parsed
    already (``parse_models``), which reads several parts from one parse. With ``keep_model`` rows also have the parsed model ``m``, from which another
    part can be read; a model without an item has no row.
    """
    models = models if "m" in models.columns else _parsed(models, id_col, json_col, keep)
    keep = (*keep, "m") if keep_model else keep
    raw = F.coalesce(*[F.when(F.col("m")[k].startswith("["), F.col("m")[k]) for k in PARTS[part]])
    rows = models.select(id_col, *keep, F.posexplode(F.from_json(raw, "array<string>")).alias("k", "item"))
    is_object = F.col("item").startswith("{")
    tables = F.transform(F.array(F.when(is_object, F.from_json("item", "map<string,string>"))), lambda o: F.struct(o.alias("o"), _said(o).alias("s")))
    rows = rows.filter("item IS NOT NULL").select(id_col, *keep, (F.col("k") + 1).alias("position"), F.when(~is_object, F.trim("item")).alias("said"), F.explode(tables).alias("f"))
    rows = rows.select(id_col, *keep, "position", "said", "f.o", "f.s")  # parsed once for all fields
    got = {f: _first(F.col("s"), keys) for f, keys in FIELDS[part].items()}
    said = F.col("said")
    if part in SAID:
        for f in SAID[part]:
            got[f] = F.coalesce(said, got[f])
        got |= {f: F.coalesce(got[f], F.lit(text)) for f, text in DEFAULTS[part].items()}
    elif part in ("data_flows", "boundaries"):
        ends = ("source", "sink") if part == "data_flows" else ("from_zone", "to_zone")
        for e in ends:
            got[e] = F.coalesce(got[e], F.lit("unknown"))
        got["description"] = F.coalesce(said, got["description"], F.concat(got[ends[0]], F.lit(" -> "), got[ends[1]]))
    else:
        filler = FILLERS[part]
        got["description"] = F.coalesce(said, got["description"], F.lit(filler))
    if part == "data_flows":
        got["sensitive_data"] = F.coalesce(got["sensitive_data"], F.lit("unknown"))
        got["name"] = F.coalesce(said, got["name"], F.when(got["sensitive_data"] != "unknown", got["sensitive_data"]), got["description"])
    elif "name" in got:
        got["name"] = F.coalesce(said, got["name"], got["description"])
    for f in ("likelihood", "impact", "risk_level"):
        if f in got:
            got[f] = risk_level(got[f])
    if "line" in got:
        got["line"] = got["line"].try_cast("int")
    for f, known in (("risk_treatment", treatment), ("status", item_status), ("confidence", confidence_level)):
        if f in got:
            got[f] = known(got[f])
    got |= {f: _list(F.col("o"), keys) for f, keys in LISTS.get(part, {}).items()}
    if part == "threats":
        got["stride"] = stride(_list(F.col("o"), STRIDE_KEYS))
        got["mitre_attack"] = _attack(F.col("o"))
    return rows.select(id_col, *keep, "position", *[c.alias(f) for f, c in got.items()])


def ground_surfaces(surfaces: DataFrame, files: DataFrame, longest: int = 8) -> DataFrame:
    """Surfaces ``(repo_id, file, ...)`` without a file, or whose file is a path of the repository or the end of one.

    Both sides meet on the last ``longest`` characters, or all of a shorter name, so no surface is held against all files. Surfaces are
    written once, as they may come from a parse; then a path meets them under ends of only those lengths that some name has.
    """
    clean = F.regexp_replace(F.regexp_replace("file", "^/+", ""), r"^(?:\./)+", "")
    rows, tail = materialize(surfaces, "surfaces"), F.right(clean, F.lit(longest))
    named = rows.filter(clean != "")
    sizes = sorted(r[0] for r in named.select(F.length(tail)).distinct().collect())  # 1 to ``longest``
    paths = files.select(F.col("repo_id").alias("f_repo"), "file_path").distinct()
    # clean names and ends are made again on both sides of the shuffle, so they are not shuffled with the rows
    if len(sizes) > 1:
        paths = paths.withColumn("__size", F.explode(F.array(*[F.lit(n) for n in sizes]))).filter(F.col("__size") <= F.length("file_path"))
    end = F.expr(f"right(file_path, {'__size' if len(sizes) > 1 else (sizes or [longest])[0]})")
    known = named.join(paths, F.expr("repo_id <=> f_repo") & (tail == end) & F.endswith("file_path", clean), "left_semi")
    return known.unionByName(rows.filter(clean.isNull() | (clean == "")))


#: Slots of the beginnings of names; those in use are broadcast.
SLOTS = 1 << 18


def ground_flows(flows: DataFrame, files: DataFrame, gram: int = 3) -> DataFrame:
    """Flows ``(repo_id, source, sink, ...)`` of which an end names something generic or holds the name of a file of the repository.

    Names and ends meet on the first ``gram`` characters of the name, so no flow is held against all files. Of the pieces of an end only those are
    shuffled in whose slot, by hash, some name begins; at most ``SLOTS`` slots are broadcast, and they only decide how much is compared.
    """
    rows = flows.withColumn("__ends", F.concat(F.lower("source"), F.lit("\n"), F.lower("sink"))).withColumn("__row", F.xxhash64("repo_id", "__ends"))
    generic = F.lit(False)
    for t in GENERIC:
        generic = generic | F.col("__ends").contains(t)
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS)).alias("slot")
    names = files.select(F.col("repo_id").alias("f_repo"), F.element_at(F.split("file_path", "/"), -1).alias("base")).filter("base <> ''").distinct()
    names = materialize(names.withColumn("g", F.left("base", F.lit(gram))), "flow-names")
    sizes = sorted(r[0] for r in names.select(F.length("g")).distinct().collect())  # 1 to ``gram``
    parts = F.array(*[F.substr("__ends", "k", F.lit(n)) for n in sizes]).cast("array<string>")
    places = rows.filter(~generic).select("repo_id", "__ends", "__row", F.explode(F.sequence(F.lit(1), F.length("__ends"))).alias("k"))
    grams = places.select("repo_id", "__ends", "__row", F.explode(parts).alias("gram")).withColumn("slot", slot("gram"))
    grams = grams.join(F.broadcast(names.select(slot("g")).distinct()), "slot", "left_semi")
    named = grams.join(names, F.expr("repo_id <=> f_repo AND gram = g AND contains(__ends, base)"), "left_semi").select("__row", F.lit(True).alias("__named")).distinct()
    return rows.join(named, "__row", "left").filter(generic | F.col("__named")).select(*flows.columns)
