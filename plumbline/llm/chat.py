"""Chat formatting with typed content parts; built-in functions only.

A message is a list of parts (type, text, ref, and width, height, seconds or pages).  A
visitor turns each part into text in order: an image, audio or document
becomes a placeholder, is listed with its reference and its place among the parts, and counts as so many tokens as it expands
to.  Placeholders have names of their own (``<|media:image|>``), which no control string has.
Texts that follow each other are joined before they are escaped, so no control string
can be put together from parts.  Control strings of this and of other common templates inside a text get a backslash after their first
character, and one more if there are some already, so the reader can undo it.

The template is <|turn|>role<|text|>content<|end|> for each turn.  The loss mask
covers the texts of assistant turns, and no placeholder: one span per turn without attachments,
else one per text that is not empty.  Defined results: a null role or
text is empty; parts that are null are none; an unknown type is a placeholder without
tokens; turns of one number follow role and content; a null turn comes first; a null
conv_id is a conversation of its own.  Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: What may not stand in a text as it is: the first character, and what follows it.
CONTROL = r"([<\[])(\\*)(\||/?s>|</?SYS>>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(\||/?s>|</?SYS>>|/?INST\])"

PART = "struct<type:string,text:string,ref:string,width:long,height:long,seconds:double,pages:long>"


@dataclass(frozen=True)
class Expansion:
    """Tokens that attachments expand to."""

    image_patch: int = 14
    image_merge: int = 2
    audio_per_second: float = 25.0
    document_per_page: int = 1024


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def text_part(text: Column) -> Column:
    """The parts of a message that is one text."""
    none = lambda kind: F.lit(None).cast(kind)
    return F.array(
        F.struct(
            F.lit("text").alias("type"),
            text.alias("text"),
            none("string").alias("ref"),
            none("long").alias("width"),
            none("long").alias("height"),
            none("double").alias("seconds"),
            none("long").alias("pages"),
        )
    )


def visit(part: Column, how: Expansion) -> Column:
    """(text, holder, kind, ref, tokens) of one part; kind is null for text."""
    side = how.image_patch * how.image_merge
    patches = lambda n: F.ceil(F.coalesce(n, F.lit(0)) / side)
    kind = F.coalesce(part["type"], F.lit("text"))
    is_text = kind == "text"
    tokens = (
        F.when(kind == "image", patches(part["width"]) * patches(part["height"]))
        .when(kind == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * how.audio_per_second))
        .when(kind == "document", F.coalesce(part["pages"], F.lit(0)) * how.document_per_page)
        .otherwise(0)
    )
    holder = F.concat(F.lit("<|media:"), F.regexp_replace(kind, "[^A-Za-z0-9_]", "_"), F.lit("|>"))
    return F.struct(
        F.when(is_text, F.coalesce(part["text"], F.lit(""))).otherwise("").alias("text"),
        F.when(is_text, "").otherwise(holder).alias("holder"),
        F.when(~is_text, kind).alias("kind"),
        part["ref"].alias("ref"),
        tokens.cast("long").alias("tokens"),
    )


def runs_of(seen: Column, attached: Column) -> Column:
    """array<struct<text, holder>>: the escaped text before each attachment and its placeholder, then the text after the last."""

    def run(k: Column) -> Column:
        before = F.coalesce(F.get(attached["place"], k - 1), F.lit(-1))
        after = F.coalesce(F.get(attached["place"], k), F.size(seen))
        joined = F.array_join(F.slice(seen["text"], before + 2, after - before - 1), "")
        return F.struct(escape(joined).alias("text"), F.coalesce(F.get(attached["holder"], k), F.lit("")).alias("holder"))

    return F.transform(F.sequence(F.lit(0), F.size(attached)), run)


def text_spans(runs: Column) -> Column:
    """array<struct<offset, n>>: the texts in a content of ``runs``; one span if there is one run, else none that is empty."""
    n, m = lambda r: F.char_length(r["text"]), lambda r: F.char_length(r["holder"])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<offset:int,n:int>>").alias("spans"))
    step = lambda s, r: F.struct(
        (s["at"] + n(r) + m(r)).alias("at"),
        F.when((F.size(runs) > 1) & (n(r) == 0), s["spans"]).otherwise(F.array_append(s["spans"], F.struct(s["at"].alias("offset"), n(r).alias("n")))).alias("spans"),
    )
    return F.aggregate(runs, start, step, lambda s: s["spans"])


def format_conversations(messages: DataFrame, how: Expansion = Expansion(), learned: str = "assistant") -> DataFrame:
    """One row per conversation of (conv_id, turn, role, parts): its text, loss mask, attachments and tokens.

    ``loss_mask``: array<struct<start, length>> in code points of ``formatted``, start from 0;
    ``attachments``: array<struct<turn, place, kind, ref, tokens>> in order, places from 0;
    ``attachment_tokens``: what all placeholders expand to.
    """
    visited = messages.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.transform(
            F.coalesce("parts", F.array().cast(f"array<{PART}>")), lambda p, i: F.struct(i.alias("place"), visit(p, how).alias("part"))
        ).alias("placed"),
    )
    visited = visited.select(
        "conv_id",
        "turn",
        "role",
        F.transform("placed", lambda p: p["part"]).alias("seen"),
        F.transform(
            F.filter("placed", lambda p: p["part"]["kind"].isNotNull()),
            lambda p: F.struct(p["place"].alias("place"), *(p["part"][c].alias(c) for c in ("holder", "kind", "ref", "tokens"))),
        ).alias("attached"),
    )
    cut = visited.select("conv_id", "turn", "role", "attached", runs_of(F.col("seen"), F.col("attached")).alias("runs"))
    content = F.array_join(F.transform("runs", lambda r: F.concat(r["text"], r["holder"])), "")
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    pieces = cut.select(
        "conv_id",
        "turn",
        "role",
        F.concat(head, content, F.lit(END)).alias("piece"),
        F.char_length(head).alias("lead"),
        text_spans(F.col("runs")).alias("spans"),
        "attached",
    )
    so_far = Window.partitionBy("conv_id").orderBy("turn", "role", "piece").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("start", F.coalesce(F.sum(F.char_length("piece")).over(so_far), F.lit(0)) + F.col("lead"))
    turns = placed.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("start", "turn", "role", "piece", "spans", "attached"))).alias("turns")
    )
    listed = F.flatten(
        F.transform(
            "turns",
            lambda t: F.transform(t["attached"], lambda a: F.struct(t["turn"].alias("turn"), *(a[c].alias(c) for c in ("place", "kind", "ref", "tokens")))),
        )
    )
    mask = F.flatten(
        F.transform(
            F.filter("turns", lambda t: t["role"] == learned),
            lambda t: F.transform(t["spans"], lambda s: F.struct((t["start"] + s["offset"]).alias("start"), s["n"].alias("length"))),
        )
    )
    out = turns.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        mask.alias("loss_mask"),
        listed.alias("attachments"),
    )
    return out.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation; placeholders stay in the text."""
    pieces = F.split(formatted, r"<\|turn\|>", -1)
    turns = F.filter(pieces, lambda t, i: i > 0)
    return F.transform(
        turns,
        lambda t: F.struct(
            unescape(F.substring_index(t, TEXT, 1)).alias("role"),
            unescape(F.substring_index(F.substring(t, F.instr(t, TEXT) + len(TEXT), F.char_length(t)), END, 1)).alias("text"),
        ),
    )


def masked(formatted: Column, mask: Column) -> Column:
    """The unescaped text under each span of the loss mask."""
    return F.transform(mask, lambda m: unescape(F.substring(formatted, (m["start"] + 1).cast("int"), m["length"].cast("int"))))
