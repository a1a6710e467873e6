import hashlib
import io
import random
import re
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webstrata.llm import chat, decontaminate, exact_dedup, near_dedup, packing, pii, quality, secrets, sharding, token_files
from webstrata.llm.fast_tokens import FastTokens
from webstrata.llm.queries import vocabulary

WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Ids, nulls, empty and long texts, copies, repeated rows; clashing extra columns."""
    rng = random.Random(3)
    base = [prose(rng, n) for n in (3, 40, 40, 200, 3000, 1)]
    near = base[3].split(" ")
    near[50] = "changed"
    out = [(i, t) for i, t in enumerate(base)] + [(10, base[1]), (11, base[1]), (12, None), (13, ""), (14, "\n \t"), (15, " ".join(near)), (16, base[4]), (None, base[2]), (None, None), (17, "Émile ñandú 日本語"), (18, "x" * 5000), (20, " a\tb"), (21, "a  b\x1fc"), (11, base[1]), (19, base[4] + " tail")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "row", 7, 0.5) for i, t in rows], "doc_id long, text string, hit string, dropped int, kept_rows double")


@pytest.fixture
def none(docs):
    return docs.filter("false")


# chat


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "[INST]", ""]), st.text(st.sampled_from(list("[]/<>s\\ INSTEC\na")), max_size=12)), min_size=1, max_size=4))
def test_chat_escape_is_reversible_in_python(turns):
    esc = lambda t: re.sub(r"([\[<])(?=/?INST\]|ESC\]|/s>)", r"\1\\", t.replace("\\", "\\\\"))
    for _, t in turns:
        assert re.sub(r"(?s)\\(.)", r"\1", esc(t)) == t
        assert not re.search(r"\[/?INST\]|\[ESC\]|</s>", esc(t))


def test_chat_round_trip(spark):
    rng = random.Random(5)
    parts = ["[INST]", "[/INST]", "</s>", "[ESC]", "\\", "\\\\", "[", "<", "/s>", "hi", "\n", "é", "INST]"]
    data = [(c, t, rng.choice(["user", "assistant", None]), None if rng.random() < 0.1 else "".join(rng.choice(parts) for _ in range(rng.randrange(8)))) for c in (1, 2, 3, None) for t in range(12)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("stop", F.lit(1))
    out = chat.format_conversations(df).withColumn("loss", chat.loss_text()).collect()
    assert len(out) == 4 and all(r.round_trip for r in out)
    for r in out:
        mine = [(t[2] or "", t[3] or "") for t in data if t[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.recovered] == mine
        assert r.loss == "".join(t for role, t in mine if role == "assistant")
        assert all(r.formatted[s.start : s.end].count("</s>") == 0 for s in r.loss_spans)
    assert chat.format_conversations(df.filter("false")).count() == 0


def test_chat_of_very_long_and_repeated_turns(spark):
    """Many turns take time in proportion; repeated rows are turns of their own; a very long text comes back."""
    long = "a [INST] b \\\\ </s> é 𝒳 " * 20_000
    data = [(1, t, "assistant" if t % 2 else "user", f"</s> turn {t} 𝒳" if t % 3 else "same") for t in range(20_000)]
    data += [(2, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", long), (2, 1, "assistant", long), (3, 0, "assistant", None), (3, 0, "assistant", "")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.format_conversations(df).withColumn("loss", chat.loss_text()).select("conv_id", "n_turns", "round_trip", "loss").collect()}
    assert all(r.round_trip for r in out.values()) and {k: r.n_turns for k, r in out.items()} == {1: 20_000, 2: 4, 3: 2}
    assert out[1].loss == "".join(t for c, _, role, t in data if c == 1 and role == "assistant")
    assert out[2].loss == long + long and out[3].loss == ""


# sharding


def test_sharding(docs, none):
    out = sharding.shard_documents(docs, sharding.uniform_tree(24), sharding.uniform_tree(25)).collect()
    assert len(out) == docs.count()
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 24)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert next(r.size for r in out if r.doc_id == 12) == 8 and next(r.text_crc32 for r in out if r.doc_id == 17) == zlib.crc32("Émile ñandú 日本語".encode())
    assert sharding.shard_documents(none, sharding.uniform_tree(2)).count() == 0


def test_one_more_shard_takes_rows_only_into_itself(spark):
    ids = spark.range(1500).select(F.col("id").cast("string").alias("id"))
    placed = ids.select(*[sharding.place(F.col("id"), sharding.uniform_tree(n)).alias(f"n{n}") for n in range(24, 32)]).collect()
    for r in placed:
        assert all(r[f"n{n + 1}"] in (r[f"n{n}"], n) for n in range(24, 31))
    assert all(any(r[f"n{n + 1}"] == n for r in placed) for n in range(24, 31))


def test_weights_move_only_what_they_must(spark):
    ids = spark.range(4000).select(F.col("id").cast("string").alias("id"))
    tree = sharding.uniform_tree(24)
    heavier = [sharding.Shard(s.region, s.rack, s.shard, 3.0 if s.shard == 5 else 1.0) for s in tree]
    moved = ids.select(sharding.place(F.col("id"), tree).alias("a"), sharding.place(F.col("id"), heavier).alias("b")).filter("a <> b").collect()
    assert moved and all(m.b == 5 for m in moved)
    counts = ids.groupBy(sharding.place(F.col("id"), tree).alias("s")).count().collect()
    assert len(counts) == 24 and max(c["count"] for c in counts) < 3 * min(c["count"] for c in counts)
    with pytest.raises(ValueError):
        sharding.place(F.lit("x"), [])


# tokens


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_fast_tokens_equal_the_library(name, rows):
    k = FastTokens(vocabulary(name), keep=50)
    texts = [t or "" for _, t in rows] + ["a  b\n\nc", "  x", "\n", "a \nb", " ", "<|endoftext|> x", "don't I'LL", "Don't. stop, now.", "1,234. 56.7, x", "a\tb", "á ́b", "''s 's", "ÀÉ ß. İx µ", "x . , y"]
    want = [e.ids for e in k.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in k.encode_all(texts)] == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_fast_tokens_equal_an_untouched_library(name):
    from tokenizers import Tokenizer

    rng = random.Random(7)
    texts = ["x\ty\tz\n\n\nw", "x\u00a0y  z", "a\x1fb c", "a <|endoftext|> b", "a<|endoftext|>b", "A <|ENDOFTEXT|> b", "c <|EndOfText|>. d", "\ta b\n"]
    texts += ["".join(rng.choice(["a", "Bc", "1", ".", "'s", " ", " ", "\n", "\n\n", "\t", "\u00a0", "\r\n", "\u3000", "é"]) for _ in range(rng.randrange(1, 12))) for _ in range(2000)]
    want = [e.ids for e in Tokenizer.from_file(vocabulary(name)).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in FastTokens(vocabulary(name), keep=50).encode_all(texts)] == want


def library(path):
    """Ids of a whole text by an untouched tokenizer."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda text: np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


PARTS = st.sampled_from([*"abIiİıßÀéñ.,;'-12 \n", "\u0307", "\u0301", "\u0327", "ﬁ", "日本", "ŉ", "ǰ", "ẞ", "İ.", "İ,", "é.", "DENİZLİ", "x.", "Å,"])


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.lists(PARTS, max_size=14).map("".join), min_size=1, max_size=40))
def test_signs_behind_any_letter_are_encoded_as_by_the_library(name, texts):
    from webstrata.llm.fast_tokens import tokens_of

    k = tokens_of(vocabulary(name))
    k.clear()
    want = [e.ids for e in k.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in k.encode_all(texts)] == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_signs_behind_every_latin_letter_stand_alone(name):
    """What stems rest on, for all letters they are taken at: alone, in words of several kinds, with and without a blank before."""
    k = FastTokens(vocabulary(name))
    ids = lambda t: k.tokenizer.encode(t, add_special_tokens=False).ids
    letters = [chr(c) for c in range(256) if chr(c).isalpha() or "0" <= chr(c) <= "9"]
    for c in letters:
        for before in ("", " ", "a", " word", "é", "1", "'", "-", "X\u0307", "日"):
            for sign in ".,":
                assert ids(before + c + sign) == ids(before + c) + ids(sign), (before, c, sign)


class Counted:
    """A tokenizer that counts the characters it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.chars = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.chars += sum(map(len, texts))
        return self.tokenizer.encode_batch_fast(texts, **options)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_are_given_to_the_library_once_whatever_signs_follow(name):
    whole, k = library(vocabulary(name)), FastTokens(vocabulary(name))
    k.tokenizer = Counted(k.tokenizer)
    words = [f"{a}{b}word{c}" for a in "abcdefghij" for b in "klmnopqrst" for c in ("", "é", "1")]
    texts = [" ".join(w + sign for w in words) for sign in ("", ".", "***", "$$$", "?!", ";", ")", "_", ".,.", '"')]
    assert list(k.encode_all(texts)) == [whole(t) for t in texts]
    assert k.tokenizer.chars < 1.5 * len(texts[0])  # beside the blanks, and marks between parts


def test_white_space_that_makes_cuts_uncertain_is_that_of_python():
    import sys

    import pyarrow as pa
    import pyarrow.compute as pc

    from webstrata.llm.fast_tokens import UNCERTAIN

    chars = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    found = pc.match_substring_regex(pa.array([f"a{c}b" for c in chars]), UNCERTAIN).to_pylist()
    assert [c for c, f in zip(chars, found, strict=True) if f] == [c for c in chars if c.isspace() and c not in " \n"]
    texts = {"": True, " ": True, "a": False, " a": True, "a ": True, "a\n": True, "\na": True, "a b\nc": False, "a  b": True, "a \nb": True, "a\n\nb": True}
    assert pc.match_substring_regex(pa.array(list(texts)), UNCERTAIN).to_pylist() == list(texts.values())


SIGNED = st.sampled_from([*"aZé÷×ªµÿß1_'\"`^~|<=>;:!?()[]{}@#$%&*+/\\.,- \n", "\u0301", "\u0338", "\u0307", "İ", "日", "Ġ", "Ċ", "\u00a0", "'s", "'ll", "x's", "word***", "</w>", "<|endoftext|>", "<|"])


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.lists(SIGNED, max_size=16).map("".join), max_size=40))
def test_texts_of_signs_are_encoded_as_by_the_library(name, texts):
    from webstrata.llm.fast_tokens import tokens_of

    k = tokens_of(vocabulary(name))
    k.clear()
    want = [np.array(e.ids, "<u4").tobytes() for e in k.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert list(k.encode_all(texts)) == want
    assert list(k.encode_all(texts, chars=9)) == want  # all parts are known now


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_parts_begin_only_where_the_library_begins_one(name):
    """All pairs of a character of two bytes or less and an ASCII one, in words of several kinds: parts by themselves give the ids of the whole."""
    from webstrata.llm.fast_tokens import cuts

    k = FastTokens(vocabulary(name))
    chars, n = [chr(c) for c in range(0x21, 0x180) if not chr(c).isspace()], 0
    for before, after in (("", ""), ("w", "x"), ("-", "\u0338")):
        words = [f" {before}{a}{b}{after}" for a in chars for b in map(chr, range(0x21, 0x7F))]
        split = []
        for w in words:
            data = np.frombuffer(w.encode(), np.uint8)
            at = [*cuts(data).tolist(), len(data)]
            split.append([data[i:j].tobytes().decode() for i, j in zip(at, at[1:], strict=False)])
        some = [(w, p) for w, p in zip(words, split, strict=True) if len(p) > 1]
        parts = dict.fromkeys(x for _, p in some for x in p)
        ids = dict(zip(parts, k._library(list(parts)), strict=True))
        assert k._library([w for w, _ in some]) == [b"".join(ids[x] for x in p) for _, p in some]
        n += len(some)
    assert n > 10_000


def test_pack_of_composed_letters_equals_the_library(spark):
    from tokenizers import Tokenizer

    library, texts = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), ["DENİZLİ.", "bir DENİZLİ, iki", "İ.İ, é. a.", "x" * 30_000 + "İ."]
    out = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), vocabulary("word_bpe_49k.json")).collect()
    for i, t in enumerate(texts):
        pieces = sorted((r.start, bytes(r.ids)) for r in out if r.doc_id == i)
        assert np.frombuffer(b"".join(p for _, p in pieces), "<u4").tolist() == [*library.encode(t, add_special_tokens=False).ids, 1]


def test_token_files(spark, docs, none, tmp_path, rows):
    path = vocabulary("byte_bpe_50k.json")
    files = token_files.write_token_files(docs, path, f"file://{tmp_path}/t", frame_bytes=2000)
    back = token_files.read_token_files(spark, files).collect()
    assert len(back) == len(rows)
    ids = library(path)
    want = sorted((hashlib.md5(ids(t) + struct.pack("<I", 0)).hexdigest(), i if i is not None else -1) for i, t in rows)
    assert sorted((hashlib.md5(bytes(r.ids)).hexdigest(), r.doc_id if r.doc_id is not None else -1) for r in back) == want
    at = 0
    for r in sorted(back, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(back, key=lambda r: r.start) if r.doc_id is not None]
    assert ids == sorted(ids)
    assert [r.doc_id for r in token_files.read_token_files(spark, files, [3]).collect()] == [3]
    assert token_files.read_token_files(spark, token_files.write_token_files(none, path, f"file://{tmp_path}/n")).count() == 0


def test_token_file_reads_frames_apart_and_finds_damage():
    out = io.BytesIO()
    f = token_files.TokenFile(out, 40)
    for i in range(6):
        f.add(i, struct.pack("<5I", i, 1, 2, 3, 0))
    assert len(out.getvalue()) > 0  # closed frames don't wait for the end
    f.finish()
    data = bytearray(out.getvalue())
    assert len(f.frames) == 3
    assert [(d, s, a.tolist()) for d, s, a in token_files.read_token_file(io.BytesIO(bytes(data)), {4})] == [(4, 20, [4, 1, 2, 3, 0])]
    data[f.frames[0][0] - 3] ^= 0xFF
    assert [d for d, _, _ in token_files.read_token_file(io.BytesIO(bytes(data)), {5})] == [5]
    with pytest.raises(Exception):
        list(token_files.read_token_file(io.BytesIO(bytes(data)), {0}))


# packing


def test_first_fit_decreasing_is_first_fit():
    rng = random.Random(1)
    sizes = [rng.randrange(1, 100) for _ in range(300)]
    free, want = [], {}
    for i in sorted(range(300), key=lambda i: -sizes[i]):
        b = next((b for b, f in enumerate(free) if f >= sizes[i]), len(free))
        free += [100] * (b == len(free))
        want[i] = (b, 100 - free[b])
        free[b] -= sizes[i]
    assert packing.first_fit_decreasing(sizes, 100) == [want[i] for i in range(300)]


def test_pack(docs, none, rows):
    out = packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), capacity=256, group_bytes=20_000).collect()
    ids = library(vocabulary("word_bpe_49k.json"))
    want = sorted(ids(t) + struct.pack("<I", 1) for _, t in rows)
    by_place, at = {}, {}
    for r in out:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in at.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 256
    for r in (r for r in out if r.doc_id not in (None, 11)):
        by_place.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    single = sorted(ids(t) + struct.pack("<I", 1) for i, t in rows if i not in (None, 11))
    assert sorted(b"".join(x for _, x in sorted(p)) for p in by_place.values()) == single
    assert sum(r.length for r in out) * 4 == sum(map(len, want))
    assert packing.pack_documents(none, vocabulary("word_bpe_49k.json")).count() == 0
    assert packing.padded_length(64, 256) == 64 and packing.padded_length(65, 256) == 256


# decontamination


def test_decontamination(spark):
    rng = random.Random(2)
    item = "When Anna rides 12 km in 3 hours and then rests how far does Anna get before the sun goes down at last"
    other = "When Peter rides 45 km in 9 hours and then rests how far does Peter get before the sun goes down at last"
    mixed = "When Peter rides 45 km in 9 hours and then rests how far does Maria get before the sun goes down at last"
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (None, item)], "item_id long, text string")
    data = [(1, prose(rng, 50) + ". " + item + ". " + prose(rng, 50)), (2, prose(rng, 30) + ". " + other), (3, prose(rng, 200)), (4, None), (5, ""), (6, item.lower().replace("anna", "Anna")), (None, item), (7, item[:40])]
    df = spark.createDataFrame([(*r, "x") for r in data], "doc_id long, text string, hit string")
    pairs = {r.doc_id: r for r in decontaminate.contaminated_pairs(df, bench).collect()}
    assert sorted(pairs) == [1, 2, 6] and not pairs[1].reparameterised and pairs[2].reparameterised
    assert [r.contaminated for r in decontaminate.contamination(df, bench).filter("doc_id is not null").orderBy("doc_id").collect()] == [True, True, False, False, False, True, False]
    assert sorted(r.doc_id or -1 for r in decontaminate.drop_contaminated(df, bench).collect()) == [-1, 3, 4, 5, 7]
    mix = spark.createDataFrame([(1, mixed)], "doc_id long, text string")
    assert decontaminate.contaminated_pairs(mix, bench).count() == 0 and decontaminate.contaminated_pairs(df, bench.filter("false")).count() == 0
    assert decontaminate.contaminated_pairs(df.filter("false"), bench).count() == 0


def test_decontamination_repeated_values(spark):
    item = "A farmer sells 12 boxes of pears in the morning and then 12 boxes of plums at noon before Anna sees Anna leave"
    texts = [item, item.replace("12", "15", 1).replace("12", "7"), item.replace("12", "13", 1), item.replace("Anna", "Maria", 1), item.replace("Anna", "Maria", 1).replace("Anna", "Ruth")]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(i, "w1 w2. " + t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.n_windows, r.share, r.reparameterised) for r in decontaminate.contaminated_pairs(docs, bench, min_share=0.1).collect()}
    # of 16 windows, 4 hold one of the two different names or both
    assert got == {0: (16, 1.0, False), 1: (16, 1.0, True), 2: (16, 1.0, True), 3: (16, 1.0, True), 4: (12, 12 / 16, False)}


def test_decontamination_counts_different_windows(spark):
    item = "the quick brown fox jumps over a lazy dog while all other animals sleep under the old tree"
    line = item.split(" ")[:9]
    table = "Sum up 1 2 3 4 5 6 7 8 9 10"
    twice = "so every one of them counts 3 pears today and every one of them counts 4 pears today and every one of them"
    bench = spark.createDataFrame([(1, item), (2, table), (3, twice)], "item_id long, text string")
    texts = [" ".join(line) + ".\n", " ".join(str(i * 7) for i in range(60)), twice]
    docs = spark.createDataFrame([(0, texts[0] * 6), (1, texts[1]), (2, twice), (3, item)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_windows, r.share) for r in decontaminate.contaminated_pairs(docs, bench, min_share=0.1).collect()}
    assert got == {(0, 1): (2, 2 / 11), (2, 3): (10, 1.0), (3, 1): (11, 1.0)}
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()) == [0, 1]


def test_decontamination_short_items(spark):
    bench = spark.createDataFrame([(1, "What is the capital of France?"), (2, "Add 2 and 3."), (3, "one two three four five six seven"), (4, " ?"), (5, "one two three four five six seven eight")], "item_id long, text string")
    texts = ["w1 asked: what is the capital of France? Paris", "He asked What is the Capital of France", "What is the capital of Spain?", "add 2 and 3; add 2 and 3", "add 2 and 4", "one two three four five six", "zero one two three four five six seven"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_windows, r.share, r.first_word, r.last_word, r.reparameterised) for r in decontaminate.contaminated_pairs(docs, bench).collect()}
    assert got == {(0, 1): (1, 1.0, 2, 7, False), (1, 1): (1, 1.0, 2, 7, False), (3, 2): (1, 1.0, 0, 7, False), (6, 3): (1, 1.0, 1, 7, False)}


def plain_leaks(docs, items, size=8, share=0.5):
    """The rule of decontamination by loops over all windows of all pairs."""
    token = re.compile(r"[^\W_]+(?:[.,][0-9]+)*|[%$€£°]|[.!?:\n\"]")

    def template(text):
        out, before = [], "."
        for t in token.findall(text):
            end = t in '.!?:\n"'
            number = t[0].isdigit()
            unit = t.lower() in decontaminate.UNITS and before[0].isdigit()
            name = not end and not number and t.lower() not in decontaminate.UNITS and t[0].isupper() and not t.isupper() and before not in '.!?:\n"'
            if not end:
                out.append(("<num>" if number else "<unit>" if unit else "<name>" if name else t.lower(), t.lower(), name, number or unit or name))
            before = t
        return out

    found = set()
    for d, text in docs:
        for i, item in items:
            a, b = template(text), template(item)
            wins = lambda w: [w[k : k + size] for k in range(len(w) - size + 1)]
            same = lambda x, y: [t[0] for t in x] == [t[0] for t in y] and (not all(t[3] for t in x) or [t[1] for t in x] == [t[1] for t in y])
            shape = lambda w: tuple(t[1 if all(x[3] for x in w) else 0] for t in w)
            good = set()
            runs = {}
            for p, x in enumerate(wins(a)):
                for q, y in enumerate(wins(b)):
                    if same(x, y):
                        first = min(k for k, z in enumerate(wins(b)) if shape(z) == shape(y) and [t[1] for t in z if t[3]] == [t[1] for t in y if t[3]])
                        runs.setdefault(p - first, []).append((x, y))
            for pairs in runs.values():
                other = {}
                for x, y in pairs:
                    for t, u in zip(x, y):
                        if u[2] and t[1] != u[1]:
                            other.setdefault(u[1], set()).add(t[1])
                for x, y in pairs:
                    if not any(u[2] and t[1] != u[1] and len(other[u[1]]) > 1 for t, u in zip(x, y)):
                        good.add(shape(y))
            different = {shape(y) for y in wins(b)}
            if different and len(good) >= share * len(different):
                found.add((d, i))
    return found


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(11)
    words = ["the", "box", "of", "Anna", "Peter", "Ruth", "12", "7", "km", "3.5", "and", "goes", ".", "to", "home", "€"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(9, 22)))) for i in range(12)]

    def changed(text):
        return " ".join(rng.choice(["Anna", "Maria", "Otto"]) if w in ("Anna", "Peter", "Ruth") and rng.random() < 0.4 else rng.choice(["5", "12", "99"]) if w[0].isdigit() and rng.random() < 0.5 else w if rng.random() < 0.97 else "odd" for w in text.split(" "))

    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(5))) + " . " + changed(rng.choice(items)[1])) for k in range(120)]
    got = decontaminate.contaminated_pairs(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = plain_leaks(docs, items)
    assert len(want) > 40 and {(r.doc_id, r.item_id) for r in got.collect()} == want
    shuffled = decontaminate.contaminated_pairs(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), max_broadcast=0)
    assert {(r.doc_id, r.item_id) for r in shuffled.collect()} == want


def test_decontamination_of_tables_and_very_long_texts(spark):
    numbers = " ".join(str(k * 13 % 1000) for k in range(100_000))
    item = "Sort the numbers 901 17 33 4 65 8 12 77 5 and say which of them is the third"
    docs = [(1, numbers), (2, numbers + " . " + item), (3, "901 17 33 4 65 8 12 77 6")]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.contaminated_pairs(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()] == [2]


# near duplicates


def classes(data, size):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = {tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))} if w else set()
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_equal_brute_force(spark, size):
    rng = random.Random(size)
    data = [(0, None), (1, ""), (2, " \n"), (3, "A b"), (4, "a B"), (5, "a b c")]
    for g in range(12):
        words = prose(rng, rng.choice([6, 30, 120])).split(" ")
        for _ in range(rng.choice([1, 2, 25])):
            w = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            data.append((len(data) + g % 2 * 1000, " ".join(w)))
    df = spark.createDataFrame([(*r, 1) for r in data], "doc_id long, text string, dropped int").repartition(3)
    got = near_dedup.near_duplicates(df, size).collect()
    want = classes(data, size)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert sorted(r.doc_id for r in near_dedup.drop_near_copies(df, size).collect()) == sorted(i for i, c in want.items() if i == c)


@pytest.mark.parametrize("rounds", [0, 2])
def test_near_duplicates_large_group_over_blocks(spark, monkeypatch, rounds):
    monkeypatch.setattr(near_dedup, "BLOCK", 20)
    monkeypatch.setattr(near_dedup, "CONFIRM_BLOCK", 8)
    monkeypatch.setattr(near_dedup, "LEADER_ROUNDS", rounds)
    rng = random.Random(9)
    words = prose(rng, 100).split(" ")
    data = []
    for i in range(150):
        w = list(words)
        for _ in range(rng.randrange(7)):
            w[rng.randrange(100)] = rng.choice(WORDS)
        data.append((i, " ".join(w)))
    got = near_dedup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), 4).collect()
    assert {r.doc_id: r.component_id for r in got} == classes(data, 4)


def test_near_duplicates_recall_close_to_the_threshold(spark):
    rng = random.Random(21)
    data, pairs = [], 0
    for g in range(400):
        words = [f"v{rng.randrange(10**6)}" for _ in range(203)]
        data.append((2 * g, " ".join(words)))
        n = rng.randrange(20, 23)  # words put behind: 200 of 200 + n shingles are common, 0.897 to 0.909; and words left out in front
        cut = rng.randrange(18, 23)
        other = words[cut:] + [f"u{rng.randrange(10**6)}" for _ in range(n)]
        data.append((2 * g + 1, " ".join(other)))
        pairs += 100 * (200 - cut) >= 80 * (200 + n)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), 4).collect()}
    want = classes(data, 4)
    linked = [i for i in want if want[i] != i]
    assert len(linked) > 100 and sum(got[i] == want[i] for i in linked) / len(linked) > 0.99 and all(got[i] == i for i in want if want[i] == i)


def test_near_duplicates_edges(docs, none, rows):
    got = near_dedup.near_duplicates(docs, 5).collect()
    assert len(got) == len(rows) and {r.component_id for r in got if r.doc_id in (3, 15)} == {3}
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert near_dedup.near_duplicates(none).count() == 0


def test_signature_guarantee():
    """Signatures within the radius share a key."""
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = rng.integers(0, 2**63, near_dedup.SYMBOLS).astype(np.uint64)
        b = a.copy()
        wrong = rng.choice(near_dedup.INDEXED, near_dedup.RADIUS, replace=False)
        b[wrong] += np.uint64(1)
        with np.errstate(over="ignore"):
            assert (near_dedup.index_keys(a) == near_dedup.index_keys(b)).any()


# exact copies


@pytest.mark.parametrize("block", [4, 1024])
def test_exact_dedup(docs, none, rows, block):
    got = exact_dedup.exact_dedup(docs, block_bytes=block).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(-1 if i is None else i)
    for r in got:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(groups[text]) and (-1 if r.keep_id is None else r.keep_id) == max(groups[text])
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.drop_exact_copies(docs, block_bytes=block)
    assert kept.columns == docs.columns and sorted((r.text or "") for r in kept.collect()) == sorted(groups)
    assert exact_dedup.exact_dedup(none).count() == 0 and exact_dedup.drop_exact_copies(none).count() == 0


# personal data and secrets

PII = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))), ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: luhn(m[0])), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= sum(c.isdigit() for c in m[0]) <= 15)]
SECRET = [("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 32)]


def luhn(text):
    d = [int(c) for c in text if c.isdigit()]
    return 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0


def brute(rules, text):
    sign = {"email": "@", "ip": "."}  # without it these expressions can't match, and would take a time that is the square of a long run's length to say so
    found = [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, p, keep) in enumerate(rules) if sign.get(kind, "") in text for m in re.finditer(p, text) if keep(m)]
    return ",".join(x[2] for x in sorted(found))


def noisy(seed, pieces, n=400):
    rng = random.Random(seed)
    return [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9)))) for i in range(n)] + [(n, None), (n + 1, ""), (None, "a@b.cc AKIAABCDEFGHIJKL"), (3, "x")]


def test_personal_data_of_several_tokens(spark):
    long = "z" * 80
    texts = [f"please phone +1 (0{i}7) 555-77{i:02d}, then wait" for i in range(10, 22)]
    texts += [f"the card 4111 1111 1111 1111 of {long}" if i == 0 else f"{long} 10.0.0.{i} done" for i in range(8)]
    texts += ["please phone (017) 555 7713 then wait", f"see {long} 12 345 678 done", "about 12 345 678 others", "+1 (017) 555-7713 123456 end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.found] for r in pii.personal_data(docs).collect()}
    assert {i: f for i, f in got.items() if f} == {20: [("phone", "(017) 555 7713")], 21: [("ip", "12 345 678")]}


def test_pii_base_equals_brute_force(spark, none):
    data = noisy(1, ["a.b@c.de", "_x@y.z", "@", ".", "-", " ", "1.2.3.4", "300.1.2.3", "4041894974608795", "4041 8949-7460 8795", "+1 (988) 555-2485", "+", "12", "é日", "\n", "word", "+49.123456789", "9" * 30])
    out = pii.personal_data(spark.createDataFrame([(*r, 1) for r in data], "doc_id long, text string, base int"), min_support=10**9)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.base_sha256, r.spans) for r in pii.personal_data_digest(out).collect())
    want = sorted((i is None, i or 0, hashlib.sha256(brute(PII, t or "").encode()).hexdigest(), brute(PII, t or "")) for i, t in data)
    assert got == want
    assert pii.personal_data(none).count() == 0


def test_pii_patterns_find_unseen_identifiers(spark):
    seeds = [(i, f"please write mailto user{i}@mail{i}.example.com today") for i in range(20)]
    unseen = [(100, "please write mailto odd_user77 today"), (101, "the year 1984xx was cold"), (102, "nothing here")]
    found = {r.doc_id: [(s.kind, s.match) for s in r.found] for r in pii.personal_data(spark.createDataFrame(seeds + unseen, "doc_id long, text string")).collect()}
    assert found[100] == [("email", "odd_user77")] and not found[101] and not found[102] and not found[5]


def test_pii_found_instances_induce_patterns(spark):
    """Patterns around found values, which no seed stands in, find more in a later round."""
    texts = [f"please write mailto user{i}@mail{i}.example.com today" for i in range(30)]
    texts += [f"please write mailto account_{i}77 today" for i in range(6)]
    texts += [f"signed by owner account_{i}77 herself" for i in range(6)]
    texts += ["signed by owner hidden_991 herself", "the year 1984xx was cold"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = lambda n: {r.doc_id: [s.match for s in r.found] for r in pii.personal_data(docs, rounds=n).collect() if r.found}
    want = {i + 30: [f"account_{i}77"] for i in range(6)} | {i + 36: [f"account_{i}77"] for i in range(6)} | {42: ["hidden_991"]}
    assert found(4) == want and 42 not in found(1)


def plain_rounds(texts, rounds, support=5, confidence=0.8):
    """Bootstrapping over texts of words between single blanks: what it finds in each, as (kind, start, end)."""

    def context(text, start, end):
        strip = lambda w: re.sub(r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "", w) != ""
        before, after = [w for w in re.split(r"[ \n]+", text[:start]) if w and strip(w)], [w for w in re.split(r"[ \n]+", text[end:]) if w and strip(w)]
        one, two, right = " ".join(before[-1:]).lower(), " ".join(before[-2:]).lower() if len(before) > 1 else "", (after[:1] or [""])[0].lower()
        found = [k + x for k, x in (("L:", one), ("LL:", two), ("R:", right)) if x]
        return found + ([f"B:{one} {right}"] if one and right else [])

    value = lambda m: re.sub(r"^[^A-Za-z0-9+]+|[^A-Za-z0-9]+$", "", m)
    edges, tokens = {}, []
    for i, text in enumerate(texts):
        spans = [(x.split(":")[0], int(x.split(":")[1]), int(x.split(":")[2])) for x in brute(PII, text).split(",") if x]
        masked = text
        for kind, a, b in spans:
            masked = masked[:a] + "@" * (b - a) + masked[b:]
            for p in context(text, a, b):
                edges.setdefault((p, value(text[a:b])), []).append(kind)
        for m in re.finditer(pii.RUN, masked):
            if "@@@@@@" not in m[0] and len(m[0]) >= 6 and len(value(m[0])) >= 6:
                tokens.append((i, m.start(), m.end(), value(m[0]), context(text, m.start(), m.end())))
                for p in tokens[-1][4]:
                    edges.setdefault((p, tokens[-1][3]), [])
    seed = {e: max(k) for e, k in edges.items() if k}
    instances = {}
    for p, v in edges:
        instances.setdefault(p, set()).add(v)
    seeds = {(v, k): 1.0 for (_, v), k in seed.items()}
    known = dict(seeds)
    for _ in range(rounds):
        votes = {}
        for p, v in edges:
            for (w, kind), score in known.items():
                if w == v:
                    total, n = votes.get((p, kind), (0.0, 0))
                    votes[p, kind] = total + score, n + (score >= confidence)
        patterns = {k: min(1.0, total / len(instances[k[0]])) for k, (total, n) in votes.items() if n >= support and len(instances[k[0]]) >= support}
        known = dict(seeds)
        for p, v in edges:
            for (q, kind), c in patterns.items():
                if q == p and (p, v) not in seed and all(w != v for w, _ in seeds):
                    known[v, kind] = max(c, known.get((v, kind), 0))
    best = {}
    for (p, kind), c in patterns.items():
        if c >= confidence:
            best[p] = max(best.get(p, (0, 0, "")), (c, -pii.KINDS.index(kind), kind))
    out = set()
    for i, a, b, _, around in tokens:
        given = [best[p] for p in around if p in best]
        if given:
            out.add((i, max(given)[2], a, b))
    return out


@pytest.mark.parametrize("rounds", [1, 2, 4])
def test_pii_rounds_equal_a_plain_version(spark, rounds):
    rng, texts = random.Random(rounds), []
    cues = ["mail", "write to", "call", "host", "card no", "ref", "from", "see"]
    for i in range(240):
        cue, end = rng.choice(cues), rng.choice(["today", "now", "please", "ok", ""])
        kind = cue if rng.random() < 0.8 else rng.choice(cues)
        made = {"mail": f"u{i}@m{i % 9}.example.com", "write to": f"acct{i % 12}_77", "call": f"+1 (0{i % 90:02d}) 555-77{i % 90:02d}", "host": f"10.0.{i % 200}.{i % 250}", "card no": "4111 1111 1111 1111", "ref": f"zz-{i % 15:04d}x", "from": f"acct{i % 12}_77", "see": f"page {i:06d}"}[kind]
        texts.append(" ".join(x for x in [f"w{rng.randrange(5)}x", cue, made, end] if x))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, s.kind, s.start, s.end) for r in pii.personal_data(docs, rounds=rounds).collect() for s in r.found}
    assert got and got == plain_rounds(texts, rounds)


def test_pii_and_secrets_of_very_long_texts(spark):
    texts = ["7" * 1_000_000, "a@b" + ".c1" * 300_000, "1.2.3.4 " * 20_000, "x " * 1000 + "+1 (017) 555-7713 " * 3000, "4041894974608795 " * 3000, "x " * 500_000, "deadbeef" * 5 + " x " * 300_000 + "password=abcdefgh1", "-----BEGIN " + "A" * 300_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    digest = lambda t, rules: hashlib.sha256(brute(rules, t).encode()).hexdigest()
    got = {r.doc_id: r.base_sha256 for r in pii.personal_data_digest(pii.personal_data(df)).collect()}
    assert got == {i: digest(t, PII) for i, t in enumerate(texts)}
    got = {r.doc_id: r.base_sha256 for r in secrets.secrets_digest(secrets.find_secrets(df)).collect()}
    assert got == {i: digest(t, SECRET) for i, t in enumerate(texts)}


def test_secrets_by_an_index_that_knows_no_rules(spark, tmp_path):
    rng = random.Random(8)
    data = [(i, "".join(rng.choice(["zeta-", "ZETA-", "key_", "9", "77", "alpha", "é", " ", "\n", "ze"]) for _ in range(rng.randrange(1, 12)))) for i in range(300)] + [(None, "zeta-77 key_9"), (5, "zeta-9"), (300, None), (301, "al"), (302, "q" * 9000 + "zeta-777")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    index = secrets.build_index(df, path=str(tmp_path / "index"))
    grams = {(r.trigram, r.doc_id) for r in index.collect()}
    low = [(i, (t or "").lower()) for i, t in data if i is not None]
    assert grams == {(t[k : k + 3], i) for i, t in low for k in range(len(t) - 2)}
    rules = [secrets.Rule("zeta", r"(?i:zeta)-[0-9]+", lambda m: F.lit(True)), secrets.Rule("both", r"(?:key_|alpha)[0-9]+", lambda m: F.length(m) >= 5), secrets.Rule("digits", r"[0-9]+", lambda m: F.length(m) >= 3)]
    plain = [("zeta", r"(?i:zeta)-[0-9]+", lambda m: True), ("both", r"(?:key_|alpha)[0-9]+", lambda m: len(m[0]) >= 5), ("digits", r"[0-9]+", lambda m: len(m[0]) >= 3)]
    got = sorted((r.doc_id is None, r.doc_id or 0, ",".join(sorted(f"{s.kind}:{s.start}:{s.end}" for s in r.spans))) for r in secrets.find_secrets(df, rules, index=index).collect())
    want = sorted((i is None, i or 0, ",".join(sorted(x for x in brute(plain, t or "").split(",") if x))) for i, t in data)
    assert got == want
    queries = {r.kind: secrets.trigram_query(r.pattern) for r in rules[:2]}
    asked = {r.doc_id for r in secrets.candidates(index, queries).collect()}
    held = lambda i, q: any(all((g, i) in grams for g in grams_of) for grams_of in q)
    assert asked == {i for i, _ in low if any(held(i, q) for q in queries.values())}


def scanned(df):
    """Rows that the file scans of a plan without shuffles put out when it runs."""
    plan = df._jdf.queryExecution()
    plan.toRdd().count()
    leaves = plan.executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_secrets_read_the_postings_they_ask_for(spark, tmp_path):
    """Rows read from the index are within five times the rows wanted, with many more trigrams than a filter takes at once."""
    rng = random.Random(12)
    syllables = ["ka", "lo", "mi", "ne", "pu", "ro", "si", "ta", "ve", "zu", "cha", "the"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5)))
    texts = [" ".join(word() for _ in range(150)) + rng.choice(["", "", " password = abcdefgh1", " AKIA" + "Z" * 16, " ghp_" + "a" * 36]) for _ in range(6000)]
    index = secrets.build_index(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2), path=str(tmp_path / "index"))
    queries = {r.kind: q for r in secrets.BASE + secrets.ADDED if (q := secrets.trigram_query(r.pattern)) is not None}
    trigrams = sorted({g for q in queries.values() for grams in q for g in grams})
    rows = secrets.postings(index, trigrams)
    wanted = rows.count()
    assert len(trigrams) > 2 * secrets.AT_ONCE and wanted > 1000
    assert scanned(rows) <= 5 * wanted and scanned(rows) < index.count() / 10
    found = {r.doc_id for r in secrets.candidates(index, queries).collect()}
    assert found >= {i for i, t in enumerate(texts) if "password" in t or "AKIA" in t} and len(found) < 3500


def test_secrets_equal_brute_force(spark, none):
    data = noisy(2, ["password=", "PassWd: ", "api_key", "ApiKey", "=", '"', ":", " ", "abcdefgh", "deadbeef" * 4, "AKIA", "ABCDEFGHIJKL12", "secret", "token='", "short", "é", "\n", "0123456789abcdef" * 3])
    out = secrets.find_secrets(spark.createDataFrame([(*r, 1) for r in data], "doc_id long, text string, rules int"))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.base_sha256) for r in secrets.secrets_digest(out).collect())
    assert got == sorted((i is None, i or 0, hashlib.sha256(brute(SECRET, t or "").encode()).hexdigest()) for i, t in data)
    assert secrets.find_secrets(none).count() == 0


def test_trigram_queries():
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == [["aki", "kia"]]
    assert secrets.trigram_query("[0-9a-f]+") is None
    assert secrets.trigram_query("(?:abcd|xyz)e?[0-9]") == [["abc", "bcd"], ["abc", "bcd", "cde"], ["xyz"], ["xyz", "yze"]]
    assert secrets.trigram_query("ab|[xy]z") is None


# quality


def test_risk_gradient_and_prior_equal_plain_versions():
    rng = np.random.default_rng(3)
    positive, unlabelled, prior = rng.normal(1, 1, (60, 3)), np.vstack([rng.normal(1, 1, (80, 3)), rng.normal(-1, 1, (40, 3))]), 0.6

    def risk(w):
        loss = lambda x, y: float(np.mean([1 / (1 + np.exp(y * (sum(a * b for a, b in zip(row, w)) + w[-1]))) for row in x]))
        negative = loss(unlabelled, -1) - prior * loss(positive, -1)
        return prior * loss(positive, 1) + max(0.0, negative), negative

    for _ in range(5):
        w = rng.normal(0, 0.3, 4)
        xp, xu = (np.column_stack([x, np.ones(len(x))]) for x in (positive, unlabelled))
        parts = [quality._risk_gradient(x, y * np.ones(len(x)), x @ w) for x, y in ((xp, 1), (xp, -1), (xu, -1))]
        value = prior * parts[0][0] + max(0.0, parts[2][0] - prior * parts[1][0])
        assert abs(value - risk(w)[0]) < 1e-9
        gradient = prior * parts[0][1] + (parts[2][1] - prior * parts[1][1] if risk(w)[1] >= 0 else 0)
        for k in range(4):
            step = np.eye(4)[k] * 1e-6
            assert abs((risk(w + step)[0] - risk(w - step)[0]) / 2e-6 - gradient[k]) < 1e-5
    fitted = quality.fit_non_negative(positive, unlabelled, prior)
    assert risk(fitted)[0] < min(risk(np.zeros(4))[0], risk(rng.normal(0, 1, 4))[0])
    p, u = rng.normal(2, 1, 500), np.r_[rng.normal(2, 1, 1400), rng.normal(-2, 1, 600)]
    shares = [(sum(x >= c for x in u) / len(u) + 0.5 / len(u) ** 0.5) / max(sum(x >= c for x in p) / len(p) - 0.5 / len(p) ** 0.5, 1e-9) for c in np.quantile(p, np.linspace(0, 0.8, 81))]
    assert abs(quality.estimate_prior(p, u) - min(max(min(shares), 0.05), 0.98)) < 1e-12 and 0.65 < quality.estimate_prior(p, u) < 0.8


def test_quality(spark):
    rng = random.Random(4)
    good = [(i, ". ".join(prose(rng, 12).capitalize() for _ in range(rng.randrange(1, 8))) + ".", 1) for i in range(400)]
    bad = [(1000 + i, rng.choice([lambda t: t.upper().replace(" ", "!! "), lambda t: " ".join(w + "###" for w in t.split()), lambda t: " ".join(f"{w} {w} {w} {w}" for w in t.split())])(prose(rng, 40)), 0) for i in range(80)]
    data = good + bad
    df = spark.createDataFrame([(i, t, 5) for i, t, _ in data] + [(5000, None, 1), (5001, "", 1), (None, "Some text.", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, q) for i, _, q in data] + [(None, 1)], "doc_id long, quality int")
    model = quality.fit_on_labels(df, labels)
    got = {r.doc_id: r for r in quality.score_quality(df, model).collect()}
    held = [(got[i].predicted, q) for i, _, q in data if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in data)
    assert sum(a == b for a, b in held) / len(held) > 0.95 and 0.6 < model.prior < 0.95
    assert all(0 <= r.score <= 1 for r in got.values()) and got[5000].score == got[5001].score
    empty = quality.fit_on_labels(df, labels.filter("false"))
    assert quality.score_quality(df.filter("false"), empty).count() == 0 and {r.score for r in quality.score_quality(df, empty).collect()} == {0.5}
    assert quality.keep_good(df, model).columns == df.columns
