import random

from pyspark.sql import functions as F
from strata.llm import chat

SAYS = ["\\### Assistant: </turn> ok", "", None, "plain", "a\\b\\h#<|image|>", "</turn>\n### user: x", "é\U0001f600\\\\#", ":: \\c", "\n\n"]


def back(df):
    made = chat.format_chat(df)
    return {
        r.conv_id: r
        for r in made.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("learned")).collect()
    }


def test_round_trip_of_any_text(spark):
    rng = random.Random(3)
    rows = [(c, t if t else None, rng.choice(["user", "assistant", "system", None, "a: b</turn>\n"]), rng.choice(SAYS), "x") for c in [1, 2, None, -5] for t in range(12)]
    rows += [rows[1], rows[1]]  # repeated rows stay
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = back(df)
    for c in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, r or "", x or "") for cc, t, r, x, _ in rows if cc == c))
        assert [(t.role, t.text) for t in got[c].turns] == [(r, x) for _, _, r, x in own]
        assert "".join(got[c].learned) == "".join(x for _, _, r, x in own if r == "assistant")
        assert got[c].n_turns == len(own)
        for s in got[c].loss:  # the absolute places hold too
            assert "<" not in got[c].formatted[s.start : s.stop] and "#" not in got[c].formatted[s.start : s.stop]


def test_typed_parts(spark):
    kind = "conv_id long, turn long, role string, text array<struct<type:string,text:string,ref:string,tokens:int>>"
    parts = [("text", "see <", None, None), ("image", None, "s3/a.png", 256), ("audio", None, "b.wav", 40), ("text", "so #", None, None), ("document", None, None, 7)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", parts), (1, 2, "assistant", None), (1, 3, "user", [])], kind)
    r = back(df)[1]
    assert r.formatted.startswith("### user: see \\l<|image|><|audio|>so \\h<|document|></turn>\n")
    assert [(a.turn, a.kind, a.ref, a.tokens) for a in r.attachments] == [(t, *x) for t in (0, 1) for x in (("image", "s3/a.png", 256), ("audio", "b.wav", 40), ("document", None, 7))]
    assert r.expanded_tokens == 606
    assert r.learned == ["see <", "so #", ""] or r.learned == ["see <", "so #"]


def test_long_conversation(spark):
    df = spark.range(3000).select(F.lit(4).alias("conv_id"), "id", F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("#"), F.col("id")).alias("text")).withColumnRenamed("id", "turn")
    r = back(df)[4]
    assert "".join(r.learned) == "".join(f"#{i}" for i in range(1, 3000, 2))


def test_no_rows(spark):
    assert back(spark.createDataFrame([], "conv_id long, turn long, role string, text string")) == {}
