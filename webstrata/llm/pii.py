"""Personal data: base expressions, and identifiers found by bootstrapped contextual extraction.

Base spans are seeds. The words around them, around runs of tokens with a digit and around tokens with an @ form lexical patterns; a graph
joins patterns and the values seen in them. Scores go from instances to patterns and back for some rounds: what a pattern finds counts
as an instance of the patterns around it in the next round, so patterns without any seed come in. Patterns of high
confidence give their kind to runs and tokens that no base expression matches. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, whole_text
from .spans import SPAN, count_kind, find_spans, spans_string

KINDS = ["email", "ip", "card", "phone"]
LOCAL = "A-Za-z0-9._%+-"
# fixed expressions. \G and the lookbehind only skip starts inside a run whose earlier start has failed already; possessive groups match in a loop and
# not by recursion, however long the text is
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# a token with an @ is by itself; others with a digit join over spaces
_DIGIT_TOKEN = r"[^ \n@0-9]*+[0-9][^ \n@]*+(?![^ \n])"
RUN = rf"(?<![^ \n])(?:[^ \n@]*+@[^ \n]*+|{_DIGIT_TOKEN}(?:\x20++{_DIGIT_TOKEN})*+)"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    """The check sum of card numbers, from the right."""
    digits = F.reverse(_digits(match))

    def value(i: Column) -> Column:
        d = F.substring(digits, i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))

    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), value), F.lit(0), lambda a, b: a + b)
    return F.length(digits).between(12, 19) & (total % 10 == 0)


#: (kind, expression, cheap test of a text, filter of a match)
BASE = [
    ("email", EMAIL, lambda t: t.contains("@"), lambda m: F.lit(True)),
    ("ip", IP, lambda t: t.rlike(r"[0-9]\.[0-9]"), lambda m: F.forall(F.split(m, r"\."), lambda p: p.cast("double") <= 255)),
    ("card", CARD, lambda t: t.rlike(r"(?:[0-9][\x20-]?){12}"), lambda m: F.when(F.length(m) < 38, _luhn(m)).otherwise(False)),
    ("phone", PHONE, lambda t: t.contains("+"), lambda m: F.length(_digits(m)).between(9, 15)),
]


def base_spans(text: Column) -> Column:
    """All base spans of a text as array<struct<kind, start, end, match>>."""
    return F.concat(*[find_spans(text, kind, pattern, needs(text), keep) for kind, pattern, needs, keep in BASE])


def _masked(text: Column) -> Column:
    """The text with an @ for each character of a base span, so that no run goes over one."""

    def without(pattern: str, keep, t: Column) -> Column:
        matches = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        hidden = F.concat(F.transform(matches, lambda m: F.when(keep(m), F.repeat(F.lit("@"), F.length(m))).otherwise(m)), F.array(F.lit("")))
        return F.array_join(F.flatten(F.zip_with(F.split(t, pattern, -1), hidden, lambda gap, m: F.array(gap, m))), "")

    def step(pattern: str, needs, keep):
        return lambda t: F.when(needs(t), without(pattern, keep, t)).otherwise(t)

    for _, pattern, needs, keep in BASE:
        text = let(text, step(pattern, needs, keep))
    return text


def _runs(text: Column) -> Column:
    """Maximal runs of tokens that hold a digit, and tokens that hold an @."""
    return find_spans(text, "run", RUN, text.rlike("[0-9@]"), lambda m: F.lit(True))


CHUNK, NEAR, FAR = 1024, 60, 1000


def _context(chunks: Column, length: Column, span: Column) -> Column:
    """start, end, kind, value, left, left2, right of a span; these are its last word, its last two and its next word, within FAR characters. Signs that touch the span aren't words.

    ``chunks``: the text in parts of CHUNK characters, so that a context is found without walking from the start of a long text.
    """
    signs = r"[^ \n\p{L}\p{N}]++"

    def part(start: Column, end: Column) -> Column:
        start, end = F.greatest(start, F.lit(0)), F.least(end, length)
        first = F.floor(start / CHUNK).cast("int")
        near = F.array_join(F.slice(chunks, first + 1, F.lit(2)), "")
        return F.when(end > start, F.substring(near, (start - first * CHUNK + 1).cast("int"), (end - start).cast("int"))).otherwise("")

    def words(side: str, x: Column) -> Column:
        if side == "left":
            bare = F.regexp_replace(x, rf"(?<![^ \n]){signs}$", "")
            return F.struct(F.regexp_extract(bare, r"(?<![^ \n])([^ \n]++)[ \n]*+$", 1).alias("one"), F.regexp_extract(bare, r"(?<![^ \n])([^ \n]++[ \n]++[^ \n]++)[ \n]*+$", 1).alias("two"))
        return F.regexp_extract(F.regexp_replace(x, rf"^{signs}(?![^ \n])", ""), r"^[ \n]*+([^ \n]++)", 1)

    start, end = span["start"], span["end"]
    # the near text is enough if blanks bound the words in it
    left = let(part(start - NEAR, start), lambda x: F.when((start > NEAR) & ~x.rlike(r"[ \n][^ \n]++[ \n]++[^ \n]++[ \n]++[^ \n\p{L}\p{N}]*+$|[ \n][^ \n]++[ \n]++[^ \n]*[\p{L}\p{N}][^ \n]*$"), words("left", part(start - FAR, start))).otherwise(words("left", x)))
    right = let(part(end, end + NEAR), lambda x: F.when((length > end + NEAR) & ~x.rlike(r"^[^ \n\p{L}\p{N}]*+[ \n]++[^ \n]++[ \n]|^[^ \n]*[\p{L}\p{N}][^ \n]*[ \n]"), words("right", part(end, end + FAR))).otherwise(words("right", x)))
    value = F.regexp_replace(span["match"], r"^[^A-Za-z0-9+]+|[^A-Za-z0-9]+$", "")
    made = lambda w: F.struct(start.alias("start"), end.alias("end"), span["kind"].alias("kind"), value.alias("value"), F.lower(w["one"]).alias("left"), F.lower(w["two"]).alias("left2"), F.lower(right).alias("right"))
    return let(left, made)


def _patterns() -> Column:
    """The lexical patterns of an instance: its last word, its last two, its next word, and the words on both sides."""
    found = [("L:", "left"), ("LL:", "left2"), ("R:", "right")]
    both = F.when((F.length("left") > 0) & (F.length("right") > 0), F.concat(F.lit("B:"), "left", F.lit(" "), "right"))
    return F.array_compact(F.array(*[F.when(F.length(c) > 0, F.concat(F.lit(k), c)) for k, c in found], both))


def personal_data(df: DataFrame, rounds: int = 4, min_support: int = 5, min_confidence: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, base (base spans), found (spans of discovered identifiers).

    Null texts are empty. Rows may repeat and ids be null: each row is searched by itself. ``min_support``: different instances with a score of at least ``min_confidence`` a pattern
    needs, seeds or found in the round before; a pattern's confidence is the sum of its instances' scores by their number. What is found is a run of tokens with a digit or a token with an @, of at least six characters, and overlaps no base span.
    """
    body = whole_text(df[text])
    docs = df.select(F.monotonically_increasing_id().alias("row"), df[doc_id].alias("doc_id"), body.alias("text"))
    docs = docs.select("row", "doc_id", "text", base_spans(F.col("text")).alias("base"))
    runs = F.filter(_runs(F.when(F.size("base") > 0, _masked(F.col("text"))).otherwise(F.col("text"))), lambda t: ~t["match"].contains("@@@@@@") & (F.length(t["match"]) >= 6))
    docs = docs.select("row", "doc_id", "text", "base", F.transform(runs, lambda t: t.withField("kind", F.lit(None).cast("string"))).alias("runs"))
    chunks = F.when(F.size("base") + F.size("runs") > 0, F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0)))
    docs = docs.select("row", "doc_id", "base", "runs", chunks.alias("chunks"), F.length("text").cast("long").alias("length"))
    docs = docs.select("row", "doc_id", "base", *[F.transform(spans, lambda s: _context(F.col("chunks"), F.col("length"), s)).alias(name) for spans, name in (("base", "seeds"), ("runs", "tokens"))])
    docs = materialize(docs.withColumn("tokens", F.filter("tokens", lambda t: F.length(t["value"]) >= 6)))

    # the graph: patterns and instances (values); only here do values meet across documents
    seen = docs.select(F.explode(F.concat("seeds", "tokens")).alias("t")).select("t.*")
    edges = seen.select("value", "kind", F.explode(_patterns()).alias("pattern"))
    edges = materialize(edges.groupBy("pattern", "value").agg(F.max("kind").alias("seed")))
    sizes = materialize(edges.groupBy("pattern").agg(F.count("*").alias("instances")).filter(F.col("instances") >= min_support))
    seeds = edges.filter("seed is not null").select("value", F.col("seed").alias("kind")).distinct().withColumn("score", F.lit(1.0))
    # sides of these joins grow with the input: they are merged, and what is shared by very many rows is split
    known, patterns = materialize(seeds), None
    for _ in range(rounds):
        votes = edges.join(known.hint("merge"), "value").groupBy("pattern", "kind").agg(F.sum("score").alias("votes"), F.count_if(F.col("score") >= min_confidence).alias("support")).filter(F.col("support") >= min_support)
        patterns = materialize(votes.join(sizes.hint("merge"), "pattern").select("pattern", "kind", F.least(F.col("votes") / F.col("instances"), F.lit(1.0)).alias("confidence")))
        found = edges.filter("seed is null").join(patterns.hint("merge"), "pattern").groupBy("value", "kind").agg(F.max("confidence").alias("score"))
        known = materialize(seeds.unionByName(found.join(seeds.select("value").distinct().hint("merge"), "value", "left_anti")))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    surest = lambda *more: F.max_by(F.struct("kind", *more), F.struct("confidence", F.negative(rank)))
    best = materialize(patterns.filter(F.col("confidence") >= min_confidence).groupBy("pattern").agg(surest("confidence").alias("b")).select("pattern", "b.*"))
    if best.limit(1).count() == 0:
        return docs.select("doc_id", "base", F.array().cast(SPAN).alias("found"))

    asked = docs.select("row", F.explode("tokens").alias("t")).select("row", "t.start", "t.end", "t.value", "t.left", "t.left2", "t.right")
    asked = asked.select("row", "start", "end", "value", F.explode(_patterns()).alias("pattern"))
    hits = asked.join(best.hint("merge"), "pattern").groupBy("row", "start", "end", "value").agg(surest().alias("k"))
    hits = hits.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("k.kind", "start", "end", F.col("value").alias("match")))).alias("found"))
    free = F.filter("found", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (b["end"] > t["start"])))
    return docs.join(hits, "row", "left").select("doc_id", "base", F.coalesce(free, F.array().cast(SPAN)).alias("found"))


def personal_data_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans from the output of ``personal_data``."""
    base = F.col("base")
    return found.select("doc_id", *[count_kind(base, k).alias(f"n_{k}") for k in KINDS], F.sha2(spans_string(base, KINDS), 256).alias("base_sha256"), spans_string(F.concat("base", "found"), KINDS).alias("spans"))
