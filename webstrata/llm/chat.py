"""Chat formatting with a grammar that can be read back.

    conversation := turn*
    turn         := "[INST]" role "[/INST]" ["[ESC]"] text "</s>"

A text is first written as it is and the turn parsed again; if the parser doesn't return the same role and text, the text
is escaped, marked with [ESC] and parsed again. Escaping doubles the backslash and puts one behind the first
character of each control string, so no control string is left inside a text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import let

OPEN, BODY, ESCAPED, CLOSE = "[INST]", "[/INST]", "[ESC]", "</s>"
CONTROL = r"\[/?INST\]|\[ESC\]|</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), rf"([\[<])(?=/?INST\]|ESC\]|/s>)", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(BODY), text, F.lit(CLOSE))


def parse_turns(formatted: Column) -> Column:
    """array<struct<role, text, raw, escaped>> read back from a rendered conversation; null if it breaks the grammar."""
    pieces = F.split(formatted, CLOSE)  # a rendered text ends with CLOSE, so the last piece is empty
    turns = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, BODY, 1)
        raw = F.substring(piece, F.length(head) + len(BODY) + 1, F.length(piece))
        marked = raw.startswith(ESCAPED)
        inner = F.when(marked, F.substring(raw, len(ESCAPED) + 1, F.length(raw))).otherwise(raw)
        role = unescape(F.substring(head, len(OPEN) + 1, F.length(head)))
        return F.struct(role.alias("role"), F.when(marked, unescape(inner)).otherwise(inner).alias("text"), inner.alias("raw"), marked.alias("escaped"))

    def valid(piece: Column) -> Column:
        return piece.rlike(r"(?s)^\[INST\](?:(?!" + CONTROL + r").)*+\[/INST\](?:\[ESC\])?(?:(?!" + CONTROL + r").)*+$")

    return F.when(F.element_at(pieces, -1) == "", F.when(F.forall(turns, valid), F.transform(turns, turn)))


def _body(role: Column, text: Column) -> Column:
    """The first form of the text that the parser returns unchanged: as it is, else escaped."""
    back = F.element_at(parse_turns(_render(escape(role), text)), 1)
    plain = ~text.rlike(CONTROL) | F.coalesce((back["text"] == text) & (back["role"] == role) & ~back["escaped"], F.lit(False))
    return F.when(plain, text).otherwise(F.concat(F.lit(ESCAPED), escape(text)))


def format_conversations(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", train_on: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans, recovered, round_trip.

    Rows are ordered by turn (null first), then role and text; repeated rows are turns of their own. Null roles and texts are
    empty, null conversation ids form one conversation. loss_spans: [start, end) in code points of ``formatted`` around each
    text with role ``train_on``, still escaped. recovered: role and text of each turn as parsed from ``formatted``;
    round_trip: they equal the source. Other columns aren't read. A conversation is one string, so its turns meet in one task.
    """
    turns = df.select(df[conv_id].alias("conv_id"), df[turn].alias("turn"), F.coalesce(df[role], F.lit("")).alias("role"), F.coalesce(df[text], F.lit("")).alias("text"))
    turns = turns.withColumn("body", _body(F.col("role"), F.col("text")))
    turns = turns.withColumn("rendered", _render(escape(F.col("role")), F.col("body"))).withColumn("size", F.length("rendered").cast("long"))
    so_far = W.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, W.currentRow)
    turns = turns.withColumn("stop", F.sum("size").over(so_far))
    marked = F.col("body").startswith(ESCAPED) & (F.col("body") != F.col("text"))
    stop = F.col("stop") - len(CLOSE)
    start = stop - F.length("body") + F.when(marked, len(ESCAPED)).otherwise(0)
    rows = F.sort_array(F.collect_list(F.struct("stop", "rendered", "role", "text", start.alias("from"), stop.alias("to"))))
    grouped = turns.groupBy("conv_id").agg(rows.alias("turns"))
    out = grouped.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.col("turns.rendered"), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["role"] == train_on), lambda t: F.struct(t["from"].alias("start"), t["to"].alias("end"))).alias("loss_spans"),
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"),
    )
    back = F.transform(parse_turns(F.col("formatted")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return out.withColumn("recovered", back).withColumn("round_trip", F.col("recovered").eqNullSafe(F.col("source"))).drop("source")


CHUNK = 1024


def loss_text(formatted: str = "formatted", loss_spans: str = "loss_spans") -> Column:
    """All text under the loss mask, read from the formatted string and unescaped.

    The string is cut into parts of CHUNK characters once, and a span is read from the parts it lies in, so many spans don't walk from the start each.
    """

    def piece(chunks: Column) -> Callable[[Column], Column]:
        def read(span: Column) -> Column:
            begin = span["start"] - len(ESCAPED)  # a turn's head is longer than that
            first = F.floor(begin / CHUNK).cast("int")
            last = F.floor((span["end"] - 1) / CHUNK).cast("int")
            near = F.array_join(F.slice(chunks, first + 1, last - first + 1), "")
            window = F.substring(near, (begin - first * CHUNK + 1).cast("int"), (span["end"] - begin).cast("int"))
            return let(window, lambda w: F.when(w.startswith(ESCAPED), unescape(F.substring(w, len(ESCAPED) + 1, F.length(w)))).otherwise(F.substring(w, len(ESCAPED) + 1, F.length(w))))

        return read

    parts = F.regexp_extract_all(F.col(formatted), F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return let(parts, lambda chunks: F.array_join(F.transform(F.col(loss_spans), piece(chunks)), ""))
