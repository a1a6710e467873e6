"""Secret scans through a trigram inverted index.

The index has the postings of all trigrams of all texts, whatever the rules are; rules added later need no new scan. Each rule's expression gives a
Boolean query over trigrams that any match must hold. Their postings are intersected, and only candidates are verified by the expression. A rule without
mandatory trigrams scans every text. Built-in functions only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from re import _constants as rc
from re import _parser as rp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import marked, materialize, shared_dir, whole_text
from .spans import count_kind, find_spans, spans_string


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    keep: Callable[[Column], Column]
    needs: str = ""  # a cheap expression for rules that scan fully


ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = [
    Rule("assign", ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8),
    Rule("access", "AKIA[A-Z0-9]+", lambda m: F.length(m) >= 16),
    Rule("hex", "[0-9a-f]+", lambda m: F.length(m) >= 32, "[0-9a-f]{32}"),
]
# public formats of keys that the base expressions don't name
ADDED = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", lambda m: F.lit(True), "gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", lambda m: F.lit(True)),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", lambda m: F.lit(True)),
]
GAP = "\0"


def _strings(parsed, limit: int = 64) -> list[str]:
    """Alternatives of what a parsed expression matches, in lower case; a gap stands for anything."""
    out = [""]
    for op, arg in parsed:
        if op is rc.LITERAL:
            part = [chr(arg).lower()]
        elif op is rc.SUBPATTERN:
            part = _strings(arg[3], limit)
        elif op is rc.BRANCH:
            part = [s for branch in arg[1] for s in _strings(branch, limit)]
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT, rc.POSSESSIVE_REPEAT):
            least, most, inner = arg
            once = _strings(inner, limit)
            part = ["", *once] if (least, most) == (0, 1) else [GAP] if least == 0 else once if most == 1 else [s + GAP + s for s in once]
        elif op in (rc.AT, rc.ASSERT, rc.ASSERT_NOT):
            part = [""]
        else:
            part = [GAP]
        out = list(dict.fromkeys(a + b for a in out for b in part))
        if len(out) > limit:
            out = [GAP]
    return out


def trigram_query(pattern: str) -> list[list[str]] | None:
    """OR of ANDs of lower-case trigrams that every match holds; None if some match may hold none."""
    query = []
    for s in _strings(rp.parse(pattern)):
        grams = {part[i : i + 3] for part in s.split(GAP) for i in range(len(part) - 2)}
        if not grams:
            return None
        query.append(sorted(grams))
    return [list(q) for q in dict.fromkeys(tuple(q) for q in query)]


PIECE = 4096
#: rows of a page of postings; trigrams that one scan asks for: beyond ten values Parquet's filters know only the smallest and the largest
PAGE_ROWS, AT_ONCE = 256, 10


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Postings (trigram, doc_id) of all trigrams of whole lower-cased texts, written to ``path``; rows with a null id have none.

    A task writes the segment of its own documents, sorted by trigram and in small pages, so nothing is shuffled and a reader that asks for a trigram by equality skips the
    pages of others. Long texts are cut into pieces that overlap by two characters.
    """
    low = docs.select(docs[doc_id].alias("doc_id"), F.lower(whole_text(docs[text])).alias("low")).filter("doc_id is not null")
    piece = F.regexp_extract_all("low", F.lit(rf"(?s)(?=(.{{3,{PIECE + 2}}})).{{1,{PIECE}}}"), F.lit(1))
    grams = low.select("doc_id", F.explode(piece).alias("piece")).select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("piece", F.lit("(?s)(?=(...))"), F.lit(1)))).alias("trigram"))
    path = path or shared_dir(docs.sparkSession)
    made = grams.select("trigram", "doc_id").sortWithinPartitions("trigram", "doc_id")
    made.write.option("parquet.page.row.count.limit", PAGE_ROWS).parquet(path)
    return docs.sparkSession.read.schema(made.schema).parquet(path)


def postings(index: DataFrame, trigrams: list[str]) -> DataFrame:
    """The postings of some trigrams, in as many scans as let each trigram be an equality that the file format filters by."""
    parts = [index.filter(F.col("trigram").isin(trigrams[i : i + AT_ONCE])) for i in range(0, len(trigrams), AT_ONCE)]
    return reduce(DataFrame.unionByName, parts)


def candidates(index: DataFrame, queries: dict[str, list[list[str]]]) -> DataFrame:
    """(doc_id, rules): documents in the intersection of the postings of one of a rule's ANDs.

    A trigram is one bit of each AND that names it; the lists of an AND are intersected by joining the bits of a document, in part before the shuffle.
    """
    ands = [(kind, sorted(set(grams))[:63]) for kind, q in queries.items() for grams in q]  # as many as a long has bits; what is left out only widens
    rows = postings(index, sorted({g for _, grams in ands for g in grams}))
    bits = [F.bit_or(F.create_map(*[F.lit(x) for i, g in enumerate(grams) for x in (g, 1 << i)])[F.col("trigram")].cast("long")).alias(f"and{k}") for k, (_, grams) in enumerate(ands)]
    held = rows.groupBy("doc_id").agg(*bits)
    whole = [F.when(F.col(f"and{k}") == (1 << len(grams)) - 1, F.lit(kind)) for k, (kind, grams) in enumerate(ands)]
    return held.select("doc_id", F.array_distinct(F.array_compact(F.array(*whole))).alias("rules")).filter(F.size("rules") > 0)


def find_secrets(df: DataFrame, rules: list[Rule] | None = None, doc_id: str = "doc_id", text: str = "text", index: DataFrame | None = None) -> DataFrame:
    """One row per row of ``df``: doc_id, spans (array<struct<kind, start, end, match>>).

    Null texts are empty; rows with a null id aren't indexed and are scanned by all rules; rows may repeat. ``index``: of ``build_index`` over the
    same documents, built here if there is none. A bitmap of the candidates' ids tells which texts may be
    candidates; only those are shuffled to meet the rules they are candidates for.
    """
    rules = [*BASE, *ADDED] if rules is None else rules
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    docs = df.select(df[doc_id].alias("doc_id"), whole_text(df[text]).alias("text"))

    def spans(needed: Callable[[Rule], Column]) -> Column:
        return F.concat(*[find_spans(F.col("text"), r.kind, r.pattern, needed(r) if r.kind in queries else F.col("text").rlike(r.needs or r.pattern), r.keep) for r in rules]).alias("spans")

    if not queries:
        return docs.select("doc_id", spans(lambda r: F.lit(True)))
    hits = materialize(candidates(build_index(df, doc_id, text) if index is None else index, queries).withColumnRenamed("doc_id", "_hit"))
    docs = marked(docs, "doc_id", hits, "_hit")
    rest = docs.filter(~F.col("_maybe")).select("doc_id", spans(lambda r: F.col("doc_id").isNull()))
    asked = docs.filter("_maybe").select("doc_id", "text").join(hits, F.col("doc_id") == F.col("_hit"), "left")
    return rest.unionByName(asked.select("doc_id", spans(lambda r: F.coalesce(F.array_contains("rules", r.kind), F.lit(False)))))


def secrets_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans from the output of ``find_secrets``."""
    kinds = [r.kind for r in BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return found.select("doc_id", *[count_kind(F.col("spans"), k).alias(f"n_{k}") for k in kinds], F.sha2(spans_string(base, kinds), 256).alias("base_sha256"), spans_string(F.col("spans"), [*kinds, *[r.kind for r in ADDED]]).alias("spans"))
