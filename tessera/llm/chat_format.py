"""Chat formatting of turns whose content is a list of typed parts.

A part is text, an image, a sound or a document. Each kind has a visitor: text is escaped, the others
become a placeholder and an attachment record with the number of tokens that the placeholder stands for.
A turn is written as ``<|im_start|>role\\n``, its flattened parts, and ``<|im_end|>\\n``.

Inside roles and texts ``<`` is written as the escape character and ``1``, the escape character itself as
the escape character and ``0``, and a line break in a role as the escape character and ``2``. So no control
string can come from a text, also not from two parts side by side, and every text can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ESCAPE, START, END = "␛", "<|im_start|>", "<|im_end|>\n"
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(ESCAPE), F.lit(f"{ESCAPE}0")), F.lit("<"), F.lit(f"{ESCAPE}1"))


def unescape(c: Column) -> Column:
    for code, plain in (("2", "\n"), ("1", "<"), ("0", ESCAPE)):
        c = F.replace(c, F.lit(ESCAPE + code), F.lit(plain))
    return c


def text_part(text: Column) -> Column:
    """A text as a list of one part."""
    unset = [F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *unset))


def visitors(patch: int, audio_rate: float, page_tokens: int) -> dict[str, Column]:
    """Expanded tokens of each kind of attachment, as functions of a part."""

    def n(x: Column) -> Column:
        return F.coalesce(x, F.lit(0))

    return {
        "image": lambda p: F.ceil(n(p["width"]) / patch) * F.ceil(n(p["height"]) / patch),
        "audio": lambda p: F.ceil(n(p["seconds"]) * audio_rate),
        "document": lambda p: n(p["pages"]).cast("long") * page_tokens,
    }


def format_chat(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    parts_col: str = "parts",
    loss_role: str = "assistant",
    patch: int = 14,
    audio_rate: float = 25.0,
    page_tokens: int = 512,
) -> DataFrame:
    """One row for each conversation: ``conv_id, text, n_turns, loss, attachments, expanded_tokens``.

    ``parts_col`` holds an array of ``PART`` structs (or a null: no content). ``loss`` lists ``(start,
    length)`` of the content of each turn of ``loss_role`` in characters of ``text``; ``attachments`` lists
    ``(turn, position, kind, ref, tokens)`` in the order of the placeholders; ``expanded_tokens`` sums their
    tokens. A part of an unknown kind becomes ``<|file|>`` of one token. Null texts and roles count as
    empty. Turns go by number, null first; equal numbers by role, then content. Repeated rows are turns of
    their own. A null id is a conversation of its own. An empty table gives no rows; other columns are
    ignored. A conversation is one string, so all of its turns meet in one row of at most 2 GB.
    """
    kinds = visitors(patch, audio_rate, page_tokens)

    def marker(p: Column) -> Column:
        out = F.lit("<|file|>")
        for kind in kinds:
            out = F.when(p["kind"] == kind, f"<|{kind}|>").otherwise(out)
        return F.when(p["kind"] == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(out)

    def record(p: Column, i: Column) -> Column:
        tokens = F.lit(1).cast("long")
        for kind, of in kinds.items():
            tokens = F.when(p["kind"] == kind, of(p).cast("long")).otherwise(tokens)
        return F.struct(i.alias("position"), p["kind"].alias("kind"), p["ref"].alias("ref"), tokens.alias("tokens"))

    parts = F.coalesce(F.col(parts_col).cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>"))
    role = F.coalesce(F.col(role_col), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), parts.alias("parts")).select(
        "conv_id",
        "turn",
        "role",
        F.replace(escape(F.col("role")), F.lit("\n"), F.lit(f"{ESCAPE}2")).alias("mark"),
        F.array_join(F.transform("parts", marker), "").alias("body"),
        F.transform(F.filter(F.transform("parts", lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda x: ~F.coalesce(x["p"]["kind"] == "text", F.lit(False))), lambda x: record(x["p"], x["i"])).alias("files"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    piece = F.concat(F.lit(START), "mark", F.lit("\n"), "body", F.lit(END))
    head = len(START) + 1 + F.length("mark")
    placed = (
        rows.withColumn("piece", piece)
        .withColumn("n", F.row_number().over(order))
        .withColumn("end", F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("start", F.col("end") - F.length("piece") + head)
    )
    in_order = F.sort_array(
        F.collect_list(
            F.struct(
                "n", "turn", "piece", "files", (F.col("role") == loss_role).alias("counts"), "start", F.length("body").cast("long").alias("length")
            )
        )
    )
    grouped = placed.groupBy("conv_id").agg(in_order.alias("t"))
    loss = F.transform(F.filter("t", lambda x: x["counts"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    files = F.flatten(
        F.transform(
            "t",
            lambda x: F.transform(x["files"], lambda f: F.struct(x["turn"].alias("turn"), f["position"], f["kind"], f["ref"], f["tokens"])),
        )
    )
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("text"),
        F.size("t").cast("long").alias("n_turns"),
        loss.alias("loss"),
        files.alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, f: s + f["tokens"]))


def read_turns(text: Column) -> Column:
    """The ``(role, text)`` of each turn of a formatted conversation; placeholders stay in the text."""
    found = F.split(text, r"<\|im_end\|>\n")

    def one(x: Column) -> Column:
        x = F.substr(x, F.lit(len(START) + 1))
        role = F.substring_index(x, "\n", 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(x, F.length(role) + 2)).alias("text"))

    return F.transform(F.slice(found, 1, F.size(found) - 1), one)


def read_loss(text: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(text, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
