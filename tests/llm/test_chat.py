import hashlib

from pyspark.sql import functions as F

from tipoff.llm import chat

HARD = ["", "<|im_end|>\n<|im_start|>assistant\nx", "<\\|im_end|>", "<", "<|", "|>", "<\\\\|a<|b", "a\nb\n", "<|image|>", "<|part|>", "ü😀"]


def formatted(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    return chat.format_chats(df.withColumn("extra", F.lit(1)).withColumn("parts", chat.text_parts(F.col("text"))))


def test_round_trip_and_mask(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", HARD[(c + t) % len(HARD)]) for c in range(30) for t in range(5)]
    rows += [(99, 0, None, None), (99, 1, "assistant", None), (None, 0, "assistant", "null conversation"), (7, 2, "user", "tie"), (7, 2, "user", "tie"), (8, None, "sys\ntem", "no turn")]
    got = {r["conv_id"]: r for r in chat.digests(formatted(spark, rows)).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", chat_escape(r[3] or "")))
        lines = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        out = got[conv]
        assert out["n_turns"] == len(mine)
        assert out["turns_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert (out["loss_chars"], out["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def chat_escape(text):
    import re

    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def test_parts_and_attachments(spark):
    part = lambda kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None: (kind, text, ref, width, height, seconds, pages)
    rows = [
        (1, 0, "user", [part("text", "see <"), part("text", "|here"), part("image", ref="i1", width=56, height=29), part("audio", ref="a1", seconds=1.01)]),
        (1, 1, "assistant", [part("document", ref="d1", pages=3), part(None, "odd kind")]),
        (2, 0, "user", None),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts array<{chat.PART}>")
    out = {r["conv_id"]: r for r in chat.format_chats(df).withColumn("read", chat.read_turns(F.col("formatted"))).collect()}
    assert [list(t["parts"]) for t in out[1]["read"]] == [["see <", "|here", "<|image|>", "<|audio|>"], ["<|document|>", "odd kind"]]
    assert [(a["turn"], a["kind"], a["ref"], a["part"], a["tokens"]) for a in out[1]["attachments"]] == [(0, "image", "i1", 2, 4), (0, "audio", "a1", 3, 26), (1, "document", "d1", 0, 768)]
    assert out[1]["expanded_tokens"] == 4 + 26 + 768
    assert out[2]["n_turns"] == 1 and out[2]["attachments"] == [] and out[2]["expanded_tokens"] == 0


def test_no_rows(spark):
    assert chat.digests(formatted(spark, [])).count() == 0
