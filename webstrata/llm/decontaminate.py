"""Benchmark decontamination by template canonicalisation.

Words become typed templates: numbers, names (capitalised words inside a sentence) and units are replaced by placeholders whose
values are kept as slots. Windows of a fixed number of template words of the benchmark and the documents meet in a hash join; a document and an item
with enough consistent windows in common are reported. A name of the item may stand for itself and one other name; equal numbers
or units of an item may be different quantities, so each occurrence has a value of its own. A question asked again with
other numbers or names is so caught with its new values. Items of fewer words than a window are one window of all their words,
without placeholders.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize, only_cache, whole_text

TOKEN = re.compile(r"[^\W_]+(?:[.,][0-9]+)*|[%$€£°]|[.!?:\n\"]")
NUMBER, NAME, UNIT = "<num>", "<name>", "<unit>"
# fixed values: units of measure and currencies
UNITS = frozenset("mm cm m km in ft yd mi mg g kg t lb oz ml l s sec ms min h hr day days week weeks year years hour hours minute minutes second seconds meter meters metre metres mile miles kilometer kilometers gram grams kilogram kilograms liter liters litre litres pound pounds ounce ounces inch inches foot feet yard yards dollar dollars euro euros cent cents percent % $ € £ °".split())


PLAIN, DIGITS, CAPITAL, MEASURE, ENDING = range(5)


def _kind(token: str) -> int:
    if token[0].isdigit():
        return DIGITS
    if token in '.!?:\n"':
        return ENDING
    if token.lower() in UNITS:
        return MEASURE
    return CAPITAL if token[0].isupper() and not token.isupper() else PLAIN


class Templates:
    """Template words of texts as 64-bit hashes. The hash of each token is kept, with its kind in the lowest three bits."""

    def __init__(self, keep: int = 300_000):
        self.known, self.keep = {}, keep

    @staticmethod
    def _hash(word: str) -> int:
        import xxhash

        return xxhash.xxh64_intdigest(word) & ~7

    def of(self, text: str) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """(hashes of template words, their words, slots: 0 for none, 1 for numbers and units, 2 for names, hashes of the words themselves). A unit counts only behind a number, a name only inside a sentence."""
        tokens, known = TOKEN.findall(text), self.known
        only_cache(known)
        if len(known) > self.keep:
            known.clear()
        found = list(map(known.get, tokens))
        if None in found:
            for t in {t for t, h in zip(tokens, found, strict=True) if h is None}:
                known[t] = self._hash(t.lower()) | _kind(t)
            found = map(known.__getitem__, tokens)
        hashes = np.fromiter(found, np.uint64, len(tokens))
        kind = (hashes & np.uint64(7)).astype(np.int8)
        before = np.concatenate([[ENDING], kind[:-1]]) if len(kind) else kind
        word = kind != ENDING
        number, unit, name = kind == DIGITS, (kind == MEASURE) & (before == DIGITS), (kind == CAPITAL) & (before != ENDING)
        hashes = hashes & np.uint64(~7 & (2**64 - 1))
        plain = hashes[word]
        for which, placeholder in ((number, NUMBER), (unit, UNIT), (name, NAME)):
            if which.any():
                hashes[which] = self._hash(placeholder)
        slot = (number | unit) + 2 * name.astype(np.int8)
        return hashes[word], [t for t, k in zip(tokens, word.tolist(), strict=True) if k], slot[word], plain


def _slot(word: str, kind: int) -> str | None:
    """The value of a slot, for a name behind an @; null for other words."""
    return (("@" if kind == 2 else "") + word.lower()) if kind else None


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; of fewer words, none."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


BLOOM_BITS = 1 << 23
_TEMPLATES = Templates()
SCHEMA = "key long, pos int, size int, n_windows int, hash long, slots array<string>"


def _windows(size: int, bloom=None, short: Iterable[int] = ()):
    """mapInArrow function: all windows of each (key, text), or those in a bitmap of fixed size. n_windows: different ones of the text, without a bitmap.

    Without a bitmap, a text of fewer words is one window of its words without slots; with one, the first and last of such
    windows of the sizes ``short`` are found in a text.
    """
    schema = pa.schema([("key", pa.int64()), ("pos", pa.int32()), ("size", pa.int32()), ("n_windows", pa.int32()), ("hash", pa.int64()), ("slots", pa.list_(pa.string()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bloom is None else np.frombuffer(bloom.value, np.uint8)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashed, words, slot, plain = _TEMPLATES.of(text)
                hashes = window_hashes(hashed, size)
                if len(hashes):
                    # a window of slots alone says nothing by its template and would be one key for all tables of numbers: its own words are hashed
                    bare = np.convolve(slot > 0, np.ones(size, int), "valid") == size
                    hashes = np.where(bare, window_hashes(plain, size), hashes)
                at, n = np.arange(len(hashes)), 0 if bits is not None else len(np.unique(hashes))
                if bits is not None:
                    at = at[_in(bits, hashes)]
                signed = hashes.view(np.int64)
                for i in at.tolist():
                    rows.append((key, i, size, n, int(signed[i]), [_slot(words[k], slot[k]) for k in range(i, i + size)]))
                for k in short if bits is not None else [len(words)] if 0 < len(words) < size else ():
                    whole = window_hashes(plain, k)
                    of = {}
                    for i in np.flatnonzero(_in(bits, whole)).tolist() if bits is not None else [0]:
                        h = int(whole.view(np.int64)[i])
                        of[h] = (of.get(h, (i,))[0], i)
                    rows += [(key, i, k, 1, h, []) for h, ends in of.items() for i in sorted(set(ends))]
                if len(rows) > 20_000:
                    yield _batch(rows, schema)
                    rows = []
            if rows:
                yield _batch(rows, schema)

    return run


def _in(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = (hashes % np.uint64(BLOOM_BITS)).astype(np.int64)
    return (bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def bitmap(windows: DataFrame) -> bytes:
    """One bit for each window hash modulo BLOOM_BITS: 1 MB however large the benchmark is."""
    slot = F.pmod(F.col("hash") % F.lit(BLOOM_BITS) + F.when(F.col("hash") < 0, F.lit((1 << 64) % BLOOM_BITS)).otherwise(0), F.lit(BLOOM_BITS))
    out = np.zeros(BLOOM_BITS >> 3, np.uint8)
    for at, value in windows.select(slot.alias("slot")).groupBy(F.expr("slot div 8").alias("byte")).agg(F.expr("bit_or(shiftleft(1, cast(slot % 8 as int)))").alias("bits")).collect():
        out[at] = value
    return out.tobytes()


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, window: int = 8, min_share: float = 0.5, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", max_broadcast: int = 100_000) -> DataFrame:
    """doc_id, item_id, n_windows, share, first_word, last_word, reparameterised for each document that holds a benchmark item.

    n_windows, share: the item's different windows, and their part, found with consistent slots, at least ``min_share``. Items of fewer words than a window are found where all
    their words follow each other with their own values. first_word, last_word: where in the document,
    in template words. reparameterised: some slot has another value. ``max_broadcast``: so many windows of the benchmark go to all tasks. Null texts and ids give no rows; rows that repeat an id
    count as one document.
    """
    spark = docs.sparkSession
    items = benchmark.select(benchmark[item_id].cast("long").alias("key"), whole_text(benchmark[item_text]).alias("text")).filter("key is not null")
    # equal windows with other slots stay, so that a verbatim copy of each is seen
    item_windows = items.mapInArrow(_windows(window), SCHEMA).groupBy(F.col("key").alias("item_id"), "hash", "size", F.col("slots").alias("item_slots")).agg(F.min("pos").alias("item_pos"), F.max("n_windows").alias("item_windows"))
    item_windows = materialize(item_windows)
    short = sorted(r["size"] for r in item_windows.filter(F.col("size") < window).select("size").distinct().collect())  # fewer than a window has words
    bloom = spark.sparkContext.broadcast(bitmap(item_windows))
    texts = docs.select(docs[doc_id].cast("long").alias("key"), whole_text(docs[text]).alias("text")).filter("key is not null and text <> ''")
    found = texts.mapInArrow(_windows(window, bloom, short), SCHEMA).select(F.col("key").alias("doc_id"), "pos", "size", "hash", "slots")
    if item_windows.count() <= max_broadcast:  # beyond that, the windows meet in a shuffled hash join
        item_windows = F.broadcast(item_windows)
    joined = found.join(item_windows, ["hash", "size"])
    pairs = F.filter(F.arrays_zip("item_slots", "slots"), lambda s: s["item_slots"].isNotNull())
    other = F.filter(pairs, lambda s: s["item_slots"] != s["slots"])
    names = F.transform(F.filter(other, lambda s: s["item_slots"].startswith("@")), lambda s: F.struct(s["item_slots"].alias("name"), s["slots"].alias("value")))
    each = joined.select("doc_id", "item_id", "hash", "item_pos", "item_windows", "pos", (F.col("pos") + F.col("size") - 1).alias("end"), (F.size(other) > 0).alias("changed"), names.alias("names"), F.forall("item_slots", lambda s: s.isNotNull()).alias("bare"))
    # windows of slots alone count if they are verbatim
    each = each.filter(~(F.col("bare") & F.col("changed"))).withColumn("shift", F.col("pos") - F.col("item_pos"))
    windows = F.collect_set(F.struct("hash", "pos", "end", "changed", "names"))
    runs = each.groupBy("doc_id", "item_id", "shift").agg(windows.alias("windows"), F.max("item_windows").alias("item_windows"))
    # windows with a name that stands for several other names don't count; verbatim ones always do
    values = F.array_distinct(F.flatten(F.col("windows.names")))
    runs = runs.withColumn("values", F.transform(values, lambda v: v["name"]))
    runs = runs.withColumn("several", F.array_distinct(F.filter("values", lambda n: F.size(F.filter("values", lambda m: m == n)) > 1)))
    good = F.filter("windows", lambda w: ~F.arrays_overlap(F.transform(w["names"], lambda n: n["name"]), F.col("several")))
    counted = runs.select("doc_id", "item_id", "item_windows", F.explode(good).alias("w")).select("doc_id", "item_id", "item_windows", "w.*")
    out = counted.groupBy("doc_id", "item_id").agg(
        F.count_distinct("hash").alias("n_windows"), F.max("item_windows").alias("item_windows"), F.min("pos").alias("first_word"), F.max("end").alias("last_word"), F.max("changed").alias("reparameterised"),
    )
    return out.withColumn("share", F.least(F.col("n_windows") / F.col("item_windows"), F.lit(1.0))).filter(F.col("share") >= min_share).drop("item_windows")


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, contaminated, item_ids (ascending)."""
    pairs = contaminated_pairs(docs, benchmark, doc_id=doc_id, **options)
    hits = pairs.groupBy(F.col("doc_id").alias("_hit")).agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    out = docs.select(docs[doc_id].alias("doc_id")).join(hits, F.col("doc_id") == F.col("_hit"), "left")
    return out.select("doc_id", F.col("_hit").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their columns; rows with a null id stay."""
    hit = free_name(docs, "hit")
    hits = contaminated_pairs(docs, benchmark, doc_id=doc_id, **options).select(F.col("doc_id").alias(hit)).distinct()
    return docs.join(hits, docs[doc_id] == hits[hit], "left_anti")
