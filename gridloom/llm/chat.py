"""Chat formatting of typed content parts, in DataFrame functions only.

A turn holds an array of parts: ``text``, ``image``, ``audio`` or ``document``.  A visitor (one method per type)
turns each part into a piece of the formatted text: texts are escaped, every other part becomes a placeholder
``<|image:3|>`` numbered in order over the conversation, with its reference, its place and the number of tokens it
expands to in ``attachments``.  The template is::

    <|im_start|>role<|im_sep|>pieces<|im_end|>

Texts cannot forge it: ``\\`` becomes ``\\\\``, ``<|`` becomes ``<\\|``, and a ``|`` that begins a text ``\\|`` (so that
no two neighbouring texts join to ``<|``); dropping the backslash in front of every escaped character gives the text
back.  The loss mask is one span per turn (start 0-based, in code points of the formatted text; length 0 where no loss is taken).

One shuffle by conversation: a window numbers the turns and placeholders and sums the lengths, and the same
partitioning serves the aggregate that joins the pieces.  A conversation is one row of the result by definition, so
its own text is the only thing that meets in one task.

Defined cases: rows come by turn, those of one turn by role, parts; a null turn comes first; a null role is
empty; a null or empty list of parts, a null part and a null text say nothing; a part of any other type becomes an
``other`` placeholder of no tokens; unknown sizes count 0; rows of a null ``conv_id`` form one conversation; repeated rows are
turns of their own; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Pieces of a text that count as a token each.
TOKEN = r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\s]"


def escape(text: Column) -> Column:
    """The text without any control string; see :func:`unescape`."""
    safe = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.when(F.startswith(safe, F.lit("|")), F.concat(F.lit("\\"), safe)).otherwise(safe)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """A text as a part of its own."""
    empty = [F.lit(None).cast(kind).alias(name) for name, kind in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.struct(F.lit("text").alias("type"), text.cast("string").alias("text"), *empty).cast(PART)


@dataclass(frozen=True)
class Flattener:
    """Visits the parts of a turn; each method gives the tokens that a part of its type expands to.

    An image counts a token per square of ``patch`` pixels and two marks, audio ``rate`` tokens a second, a
    document ``page`` tokens a page, a text its words and punctuation marks.
    """

    patch: int = 28
    rate: float = 25.0
    page: int = 512

    def text(self, part: Column) -> Column:
        return F.regexp_count(F.coalesce(part["text"], F.lit("")), F.lit(TOKEN)).cast("long")

    def image(self, part: Column) -> Column:
        side = lambda x: F.ceil(F.coalesce(x, F.lit(0)) / self.patch)
        return side(part["width"]) * side(part["height"]) + 2

    def audio(self, part: Column) -> Column:
        return F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * self.rate).cast("long")

    def document(self, part: Column) -> Column:
        return F.coalesce(part["pages"], F.lit(0)).cast("long") * self.page

    def other(self, part: Column) -> Column:
        return F.lit(0).cast("long")

    def visit(self, part: Column, place: Column) -> Column:
        """``struct(kind, body, ref, tokens, place)``; ``body`` is the escaped text, null for a placeholder."""
        kind = F.when(part["type"].isin("text", "image", "audio", "document"), part["type"]).otherwise(F.lit("other"))
        tokens = F.lit(None).cast("long")
        for name in ("other", "document", "audio", "image", "text"):
            tokens = F.when(kind == name, getattr(self, name)(part)).otherwise(tokens)
        body = F.when(kind == "text", escape(F.coalesce(part["text"], F.lit(""))))
        return F.struct(kind.alias("kind"), body.alias("body"), part["ref"].alias("ref"), tokens.alias("tokens"), place.alias("place"))

    def flatten(self, parts: Column) -> Column:
        held = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
        return F.transform(held, self.visit)


def format_conversations(rows: DataFrame, parts: str = "parts", conv_id: str = "conv_id", turn: str = "turn", role: str = "role", loss_roles: tuple[str, ...] = ("assistant",), visitor: Flattener | None = None) -> DataFrame:
    """``(conv_id, formatted, mask, attachments, n_turns, tokens)`` per conversation, from rows with an array of parts.

    ``mask`` holds per turn ``(start, loss_start, loss_length)``; ``attachments`` per placeholder ``(number, turn_no,
    place, kind, ref, tokens)``, in order; ``tokens`` counts what all parts expand to.
    """
    visitor = visitor or Flattener()
    named = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.col(parts).cast(f"array<{PART}>").alias("parts"))
    seen = named.withColumn("seen", visitor.flatten(F.col("parts")))
    hung = F.filter("seen", lambda p: p["body"].isNull())
    seen = seen.withColumn("hung", F.transform(hung, lambda p: p["place"]))
    # The numbers of placeholders go on from turn to turn, so the sums run over the window.
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "parts")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    seen = seen.withColumns({"no": F.row_number().over(order), "first": F.coalesce(F.sum(F.size("hung")).over(upto), F.lit(0))})
    number = lambda p: F.col("first") + F.array_position("hung", p["place"])
    piece = lambda p: F.coalesce(p["body"], F.concat(F.lit("<|"), p["kind"], F.lit(":"), number(p).cast("string"), F.lit("|>")))
    notes = F.transform(F.filter("seen", lambda p: p["body"].isNull()), lambda p: F.struct(number(p).alias("number"), F.col("no").alias("turn_no"), p["place"].alias("place"), p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens")))
    heads = F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP))
    said = seen.select(
        "conv_id", "no", heads.alias("head"), F.array_join(F.transform("seen", piece), "").alias("body"), F.col("role").isin(*loss_roles).alias("learnt"), notes.alias("notes"),
        F.aggregate("seen", F.lit(0).cast("long"), lambda s, p: s + p["tokens"]).alias("tokens"),
    )
    by_no = Window.partitionBy("conv_id").orderBy("no")
    size = F.length("head") + F.length("body") + len(END)
    placed = said.withColumn("start", F.coalesce(F.sum(size.cast("long")).over(by_no.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    mask = F.struct("start", (F.col("start") + F.length("head")).alias("loss_start"), F.when(F.col("learnt"), F.length("body")).otherwise(0).cast("long").alias("loss_length"))
    one = F.struct("no", F.concat("head", "body", F.lit(END)).alias("piece"), mask.alias("mask"), "notes", "tokens")
    all_ = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    pick = lambda name: F.transform("turns", lambda t: t[name])
    total = F.aggregate(pick("tokens"), F.lit(0).cast("long"), lambda s, x: s + x)
    return all_.select("conv_id", F.array_join(pick("piece"), "").alias("formatted"), pick("mask").alias("mask"), F.flatten(pick("notes")).alias("attachments"), F.size("turns").cast("long").alias("n_turns"), total.alias("tokens"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``(conv_id, turns, loss_text)`` from ``formatted`` and ``mask``: roles and texts unescaped, placeholders as they stand.

    Text under the mask is cut out of the turn that the span lies in, so a long conversation is read once.
    """
    segments = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, F.greatest(F.size("mask"), F.lit(1)))
    bare = lambda s: F.regexp_replace(s, r"(?s)<\|im_end\|>\z", "")
    turn = lambda s: F.struct(unescape(F.regexp_replace(s, r"(?s)<\|im_sep\|>.*\z", "")).alias("role"), unescape(F.regexp_replace(bare(s), r"(?s)\A.*?<\|im_sep\|>", "")).alias("text"))
    # The segments follow the start mark, so positions count from behind it.
    under = lambda m, i: F.substring(F.element_at("segments", i + 1), (m["loss_start"] - m["start"] - len(START) + 1).cast("int"), m["loss_length"].cast("int"))
    rows = formatted.withColumn("segments", segments)
    return rows.select("conv_id", F.transform("segments", turn).alias("turns"), F.array_join(F.transform("mask", lambda m, i: unescape(under(m, i))), "").alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def turn_digest(turns: Column) -> Column:
    """SHA-256 of role, line feed, text, line feed of every turn, in order."""
    return F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256)
