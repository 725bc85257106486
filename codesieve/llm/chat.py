"""Chat formatting: typed content parts to one text per conversation, with its loss mask. Columns only.

Template, for each turn::

    <|turn|>ROLE\\nBODY<|end|>\\n

Inside roles and texts ``\\`` becomes ``\\s``, ``<`` becomes ``\\l`` and, in roles, a newline becomes ``\\n``: no ``<`` of a
text is left, so no text can hold or complete a control string, and undoing the three codes gives the text back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>\n"
PART_TYPE = "struct<kind: string, text: string, ref: string, units: bigint>"
#: Tokens that one unit expands to: an image tile, a second of audio, a page.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 700}


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def text_part(text: Column) -> Column:
    """A part that holds a plain text."""
    null = F.lit(None)
    return F.struct(F.lit("text").alias("kind"), text.alias("text"), null.cast("string").alias("ref"),
                    null.cast("bigint").alias("units"))


class PartVisitor:
    """How each kind of part is written. A subclass may add kinds or change their form."""

    def __init__(self, tokens_per_unit: dict[str, int] = TOKENS_PER_UNIT):
        self.tokens_per_unit = tokens_per_unit
        self.kinds: dict[str, Callable[[Column, Column], Column]] = {k: self.attachment(k) for k in tokens_per_unit}

    def attachment(self, kind: str) -> Callable[[Column, Column], Column]:
        return lambda part, number: F.concat(F.lit(f"<|{kind}:"), number.cast("string"), F.lit("|>"))

    def is_attachment(self, part: Column) -> Column:
        return F.coalesce(part["kind"].isin(*self.kinds), F.lit(False)) if self.kinds else F.lit(False)

    def visit(self, part: Column, number: Column) -> Column:
        """The part's form in the text; ``number`` counts attachments from 1 through the conversation."""
        out = escape(part["text"])
        for kind, form in self.kinds.items():
            out = F.when(part["kind"] == kind, form(part, number)).otherwise(out)
        return out

    def expanded(self, part: Column) -> Column:
        """Tokens that the part's placeholder stands for; no units count as one, negative ones as none."""
        units = F.greatest(F.coalesce(part["units"], F.lit(1)), F.lit(0))
        out = F.lit(0).cast("bigint")
        for kind, each in self.tokens_per_unit.items():
            out = F.when(part["kind"] == kind, units * each).otherwise(out)
        return out


def format_conversations(turns: DataFrame, visitor: PartVisitor | None = None, trained: str = "assistant") -> DataFrame:
    """One row per conversation of ``turns(conv_id, turn, role, parts)``, ``parts`` an array of PART_TYPE.

    Returns conv_id, n_turns, ``formatted``, ``loss_spans`` (start and length in bytes of the UTF-8 text, in order: the text
    parts of ``trained`` turns), ``attachments`` (number, kind, ref, tokens: in order of their placeholders) and
    ``expanded_tokens``. Other columns of ``turns`` are ignored.

    Defined cases: turns come in order of (turn, role, parts), nulls first, so that ties and repeated rows always come out
    alike, and each repeated row is a turn of its own. A null role is the empty role, a null conv_id a conversation of its
    own. A turn with null or no parts has an empty body; null texts are empty; parts of an unknown or null kind are written
    as their text. No rows give no conversations. Texts of any length are kept whole.

    One shuffle, by conversation. A conversation becomes one value, so it has to fit into a task; nothing else has to.
    """
    visitor = visitor or PartVisitor()
    whole = Window.partitionBy("conv_id").orderBy("turn", "role", "parts")
    numbered = turns.select("conv_id", "turn", "role", "parts").withColumn("turn_no", F.row_number().over(whole))
    parts = numbered.select("conv_id", "turn_no", "role", F.size("parts").alias("n"), F.posexplode_outer("parts").alias("part_no", "part"))
    before = Window.partitionBy("conv_id").orderBy("turn_no", "part_no").rowsBetween(Window.unboundedPreceding, -1)
    upto = before.rowsBetween(Window.unboundedPreceding, 0)
    part = F.col("part")
    attached = visitor.is_attachment(part)
    first = F.coalesce(F.col("part_no"), F.lit(0)) == 0
    last = F.col("part_no").isNull() | (F.col("part_no") == F.col("n") - 1)
    written = (
        parts.withColumn("number", F.sum(attached.cast("long")).over(upto))
        .withColumn("head", F.when(first, F.concat(F.lit(TURN), escape_role(F.col("role")), F.lit("\n"))).otherwise(""))
        .withColumn("body", visitor.visit(part, F.col("number")))
        .withColumn("piece", F.concat("head", "body", F.when(last, F.lit(END)).otherwise("")))
        .withColumn("at", F.coalesce(F.sum(F.octet_length("piece")).over(before), F.lit(0)) + F.octet_length("head"))
    )
    in_order = F.struct("turn_no", "part_no", "piece")
    span = F.struct(F.col("at").cast("int").alias("start"), F.octet_length("body").alias("length"))
    under_loss = (F.col("role") == trained) & ~attached & (F.octet_length("body") > 0)
    reference = F.struct(F.col("number"), part["kind"].alias("kind"), part["ref"].alias("ref"), visitor.expanded(part).alias("tokens"))
    return written.groupBy("conv_id").agg(
        F.max("turn_no").cast("long").alias("n_turns"),
        F.array_join(F.transform(F.array_sort(F.collect_list(in_order)), lambda x: x["piece"]), "").alias("formatted"),
        F.array_sort(F.collect_list(F.when(under_loss, span))).alias("loss_spans"),
        F.array_sort(F.collect_list(F.when(attached, reference))).alias("attachments"),
        F.coalesce(F.sum(visitor.expanded(part)), F.lit(0)).alias("expanded_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """``formatted`` back to an array of (role, text as written, unescaped)."""
    pieces = F.split(formatted, r"<\|end\|>\n", -1)
    turns = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.substring(p, len(TURN) + 1, 1 << 30))
    return F.transform(turns, lambda t: F.struct(
        unescape_role(F.substring_index(t, "\n", 1)).alias("role"),
        unescape(F.substr(t, F.instr(t, "\n") + 1)).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask. Bytes are cut, not characters: each cut costs its own length only."""
    raw = formatted.cast("binary")
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(raw, s["start"] + 1, s["length"]).cast("string"))), "")
