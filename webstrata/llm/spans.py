"""Spans of regular expressions in whole texts, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let

SPAN = "array<struct<kind:string,start:long,end:long,match:string>>"


PART = 256


def find_spans(text: Column, kind: str, pattern: str, needs: Column, keep) -> Column:
    """Leftmost non-overlapping matches as structs (kind, start, end, match); code points, end exclusive.

    ``needs`` says cheaply whether a text can match at all. The matches and the parts between them follow
    each other, so a running sum of their lengths gives the places. ``keep``: filter on a match. Sums run over parts of ``PART``
    matches and then over the parts, so a text with very many matches takes time in proportion.
    """

    def pieces(matches: Column) -> Column:
        between = F.split(text, pattern, -1)
        return F.zip_with(F.slice(between, 1, F.size(matches)), matches, lambda gap, match: F.struct(F.length(gap).alias("gap"), match.alias("match")))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        end = begin + F.length(x["match"])
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), x["match"].alias("match"))
        return F.struct(end.alias("at"), F.when(keep(x["match"]), F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    def within(part: Column, at: Column) -> Column:
        return F.aggregate(part, F.struct(at.alias("at"), F.array().cast(SPAN).alias("spans")), step, lambda state: state["spans"])

    def over(parts: Column) -> Column:
        long = lambda x: F.lit(x).cast("long")
        widths = F.transform(parts, lambda p: F.aggregate(p, long(0), lambda n, x: n + x["gap"] + F.length(x["match"])))
        starts = F.aggregate(widths, F.array(long(0)), lambda sums, w: F.concat(sums, F.array(F.element_at(sums, -1) + w)))
        return F.flatten(F.zip_with(parts, F.slice(starts, 1, F.size(parts)), within))

    def found(both: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(both) - 1) / PART).cast("int")), lambda i: F.slice(both, i * PART + 1, F.lit(PART)))
        return F.when(F.size(both) > PART, let(cut, over)).when(F.size(both) > 0, within(both, F.lit(0).cast("long"))).otherwise(F.array().cast(SPAN))

    return F.when(needs, let(let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), pieces), found)).otherwise(F.array().cast(SPAN))


def spans_string(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end by start, then by kind as listed, comma-joined."""
    rank = F.array(*[F.lit(k) for k in kinds])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(rank, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
