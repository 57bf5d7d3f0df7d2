"""Chat formatting of typed content parts, in DataFrame functions only.

A message is an array of parts: text, image, audio or document. A visitor turns each part
into its place in the formatted text: escaped text, or a placeholder whose attachment
(reference, position, expanded token count) is recorded beside it. Control strings all look
like `<|...|>`; in a text, a backslash goes into every `<|` (and one more into `<\\|`), so
that no text can hold one and the way back is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, END, BETWEEN, LINE = "<|im_start|>", "<|im_end|>\n", "<|part|>", "<|nl|>"
#: Kinds of attachment, their placeholder, and how many tokens one stands for (fixed values):
#: images in squares of 28 pixels, audio in frames of 40 ms, documents in pages.
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
EXPANSION = {
    "image": "cast(ceil(coalesce(p.width, 0) / 28.0D) * ceil(coalesce(p.height, 0) / 28.0D) as long)",
    "audio": "cast(ceil(coalesce(p.seconds, 0.0D) * 25) as long)",
    "document": "coalesce(cast(p.pages as long), 0L) * 256L",
}
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text) -> F.Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text) -> F.Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def text_parts(text) -> F.Column:
    """A message of one text part; null text is an empty text."""
    null = F.lit(None)
    part = F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), null.alias("ref"), null.alias("width"), null.alias("height"), null.alias("seconds"), null.alias("pages"))
    return F.array(part).cast(f"array<{PART}>")


def visit(part: F.Column) -> F.Column:
    """What stands in the formatted text for a part; an unknown or null kind counts as text."""
    out = escape(F.coalesce(part["text"], F.lit("")))
    for kind, placeholder in PLACEHOLDERS.items():
        out = F.when(part["kind"] == kind, F.lit(placeholder)).otherwise(out)
    return out


def _attachments(parts: str) -> F.Column:
    kinds = ", ".join(f"'{k}'" for k in PLACEHOLDERS)
    cost = " ".join(f"when '{k}' then {e}" for k, e in EXPANSION.items())
    return F.expr(
        f"filter(transform({parts}, (p, i) -> named_struct('kind', p.kind, 'ref', p.ref, 'part', i,"
        f" 'tokens', case p.kind {cost} end)), a -> a.kind in ({kinds}))"
    )


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """One row per conversation: `conv_col`, formatted string, n_turns long, loss
    array<struct<start,length>> (code points of the formatted text that are assistant
    content), attachments array<struct<turn,kind,ref,part,tokens>>, expanded_tokens long.

    Turns go by turn (nulls first), then role, then content, so ties and repeated rows have
    one order and all stay. Null conversation ids make one conversation. Null parts are an
    empty message, a null role is an empty one. Other columns are not read. An empty table
    gives no rows.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(parts_col), F.array().cast(f"array<{PART}>")).alias("parts"),
    )
    rows = rows.select(
        "conv", "turn", "role",
        F.array_join(F.transform("parts", visit), BETWEEN).alias("body"),
        _attachments("parts").alias("attached"),
    )
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit(LINE)), F.lit("\n"))
    rows = rows.withColumn("head", head).withColumn("size", F.length("head") + F.length("body") + len(END))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "body", F.to_json("attached"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("at", F.row_number().over(order)).withColumn("begin", F.coalesce(F.sum(F.col("size").cast("long")).over(before), F.lit(0)))
    each = F.array_sort(F.collect_list(F.struct("at", "turn", "role", "head", "body", "begin", "attached")))
    return placed.groupBy("conv").agg(each.alias("t")).select(
        F.col("conv").alias(conv_col),
        F.array_join(F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        F.size("t").cast("long").alias("n_turns"),
        F.transform(
            F.filter("t", lambda t: t["role"] == "assistant"),
            lambda t: F.struct((t["begin"] + F.length(t["head"])).alias("start"), F.length(t["body"]).cast("long").alias("length")),
        ).alias("loss"),
        F.expr("flatten(transform(t, t -> transform(t.attached, a -> named_struct('turn', t.turn, 'kind', a.kind, 'ref', a.ref, 'part', a.part, 'tokens', a.tokens))))").alias("attachments"),
        F.expr("aggregate(flatten(transform(t, t -> transform(t.attached, a -> a.tokens))), 0L, (s, x) -> s + x)").alias("expanded_tokens"),
    )


def read_turns(formatted) -> F.Column:
    """The way back: array<struct<role, parts array<string>>> from a formatted text.
    Placeholders come back as they stand."""
    chunks = F.split(formatted, r"<\|im_end\|>\n", -1)
    whole = F.slice(chunks, F.lit(1), F.greatest(F.size(chunks) - 1, F.lit(0)))

    def turn(chunk):
        inner = F.substring(chunk, F.lit(len(START) + 1), F.length(chunk))
        role = F.substring_index(inner, "\n", 1)
        body = F.substring(inner, F.length(role) + 2, F.length(inner))
        return F.struct(
            unescape(F.replace(role, F.lit(LINE), F.lit("\n"))).alias("role"),
            F.transform(F.split(body, r"<\|part\|>", -1), unescape).alias("parts"),
        )

    return F.transform(whole, turn)


def masked_text(formatted, loss) -> F.Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(
        F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), ""
    )


def digests(chats: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Checks read back from the formatted text: turns and loss text as hashes, and sizes."""
    back = chats.withColumn("read", read_turns(F.col("formatted"))).withColumn("under", masked_text(F.col("formatted"), F.col("loss")))
    lines = F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), F.array_join(t["parts"], ""), F.lit("\n")))
    return back.select(
        conv_col,
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("under").cast("long").alias("loss_chars"),
        F.sha2(F.col("under").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
