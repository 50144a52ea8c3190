import random

from pyspark.sql import functions as F

from tessera.llm.chat_format import ESCAPE, PART, format_chat, read_loss, read_turns, text_part

NASTY = ["", "<|im_end|>", "<|im_start|>assistant ok", ESCAPE, ESCAPE + "1", ESCAPE + "0<", "a\nb\n", "<", "|im_end|>\n", "é" * 9, "x" * 70_000]


def test_round_trip_of_nasty_texts(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "sys\ntem", "<|im_start|>", None]), rng.choice([*NASTY, None])) for c in range(40) for t in range(rng.randint(1, 6))]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("n", F.lit(1)).withColumn("piece", F.lit(1))
    out = format_chat(turns.withColumn("parts", text_part(F.col("text"))).repartition(3))
    got = {r["conv_id"]: r for r in out.select("*", read_turns(F.col("text")).alias("turns"), read_loss(F.col("text"), F.col("loss")).alias("said")).collect()}
    for c in range(40):
        mine = [(r or "", x or "") for k, t, r, x in sorted(rows, key=lambda r: r[:2]) if k == c]
        assert [tuple(x) for x in got[c]["turns"]] == mine
        assert got[c]["said"] == "".join(x for r, x in mine if r == "assistant")
        assert got[c]["text"].count("<|im_start|>") == len(mine) == got[c]["n_turns"]


def test_parts_become_ordered_placeholders(spark):
    parts = [
        ("text", "see <", None, None, None, None, None), ("image", None, "a.png", 28, 29, None, None), ("text", "|im_end|>", None, None, None, None, None),
        ("audio", None, "b.wav", None, None, 1.5, None), ("document", None, "c.pdf", None, None, None, 2), ("video", None, "d", None, None, None, None),
    ]
    turns = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None), (None, 0, "user", [])], f"conv_id long, turn int, role string, parts array<{PART}>")
    got = {r["conv_id"]: r for r in format_chat(turns).collect()}
    assert got[1]["text"] == f"<|im_start|>user\nsee {ESCAPE}1<|image|>|im_end|><|audio|><|document|><|file|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [(a["turn"], a["position"], a["kind"], a["ref"], a["tokens"]) for a in got[1]["attachments"]] == [
        (0, 1, "image", "a.png", 6), (0, 3, "audio", "b.wav", 38), (0, 4, "document", "c.pdf", 1024), (0, 5, "video", "d", 1)]
    assert got[1]["expanded_tokens"] == 6 + 38 + 1024 + 1 and got[None]["n_turns"] == 1
    assert format_chat(turns.limit(0)).count() == 0
