"""Token ids of whole texts by the tokenizers library, with the ids of repeated words kept.

Both public BPE vocabularies split a text before merging, and a space or line break that stands alone always begins a new
part, as does a sign behind a letter or digit. A text is therefore cut there, each different part is encoded once by the library,
and the ids are joined. Cutting, telling parts apart and joining run over many texts at a time in NumPy and Arrow.
Texts with other white space, runs of it or an added token of the vocabulary, where the cut isn't certain, are encoded whole.
"""

from __future__ import annotations

import os
import string
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import only_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: What is white space to Python, besides space and newline; runs of these two; either at an end; no text at all.
UNCERTAIN = r"[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|\A[ \n]|[ \n]\z|\A\z"

BLANK, WORD, SIGN = 1, 2, 3
KIND = np.zeros(256, np.uint8)
KIND[list(b" \n")] = BLANK
KIND[list((string.ascii_letters + string.digits).encode())] = WORD
KIND[list(string.punctuation.replace("'", "").encode())] = SIGN  # an apostrophe may begin a part that goes on in letters


def cuts(data: np.ndarray) -> np.ndarray:
    """Where parts begin in UTF-8: at blanks, and at ASCII signs (but apostrophes) behind an ASCII letter or digit or one of À to ÿ.

    Behind other characters a sign may not begin a part: some are normalised to several, the last of which joins a sign that follows.
    """
    kind = KIND[data]
    begins = kind == BLANK
    signs = np.flatnonzero(kind == SIGN)
    signs = signs[signs > 0]
    before = data[signs - 1]
    latin = (before >= 0x80) & (before != 0x97) & (before != 0xB7) & (data[signs - 2] == 0xC3)  # × and ÷ are no letters
    begins[signs[(kind[signs - 1] == WORD) | latin]] = True
    return np.flatnonzero(begins)


class FastTokens:
    """Encodes texts. The ids of parts are kept in two generations of about ``keep`` parts: a full one becomes the old one, and parts met again move over."""

    def __init__(self, path: str, keep: int = 350_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = [t.content for t in added.values()]
        self.mark = next(((t.content, n) for n, t in added.items() if not (t.lstrip or t.rstrip or t.single_word or t.normalized)), None)
        if self.mark is None:
            self.added = [*self.added, ""]  # nothing to put between parts: all texts are encoded whole
        self.keep, self.known, self.old = keep, {}, {}
        same = {tuple(self.tokenizer.encode(x, add_special_tokens=False).ids) for x in ("a", "A", " a", "\na")}
        self.folds = len(same) == 1  # case and white space don't count in this vocabulary
        # ids that tell where a part ends or begins in a run of parts: with the suffix of a word's end, else with a blank in front
        self.suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None) or ""
        self.tells = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        for token, n in self.tokenizer.get_vocab().items():
            self.tells[n] = token.endswith(self.suffix) if self.suffix else token.startswith(("Ġ", "Ċ"))

    def clear(self) -> None:
        self.known, self.old = {}, {}

    @staticmethod
    def _folded(text: str) -> str:
        """In lower case where that is one to one: in Latin-1."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        return text.lower()

    def _library(self, parts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _library_parts(self, parts: list[str], at_once: int = 500) -> list[bytes]:
        """The same for parts that hold no added token: many are one text with an added token between them, which the library always takes out first."""
        (mark, number), out = self.mark, []
        joined = [mark.join(parts[i : i + at_once]) for i in range(0, len(parts), at_once)]
        for i, e in enumerate(self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            ids, n = np.array(e.ids, "<u4"), min(at_once, len(parts) - i * at_once)
            at = np.flatnonzero(ids == number)
            if len(at) != n - 1:
                raise ValueError("a part holds an added token")
            data, begin = ids.tobytes(), 0
            for end in [*(4 * at).tolist(), len(data)]:
                out.append(data[begin:end])
                begin = end + 4
        return out

    def _library_run(self, parts: list[str], at_once: int = 200) -> list[bytes]:
        """The same for parts that begin with a blank: many are one text, as they would be if they followed each other, and ids tell them apart.

        Where the vocabulary marks ends of words, each part must be one word. A run whose ids tell of more parts, or of fewer, is encoded part by part.
        """
        out, runs = [], [parts[i : i + at_once] for i in range(0, len(parts), at_once)]
        for run, e in zip(runs, self.tokenizer.encode_batch_fast(["".join(r) for r in runs], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            at = np.flatnonzero(self.tells[ids])
            if len(at) != len(run):
                out += self._library(run)
                continue
            data, bounds = ids.tobytes(), [0, *(4 * (at + 1)).tolist()] if self.suffix else [*(4 * at).tolist(), 4 * len(ids)]
            out += [data[a:b] for a, b in zip(bounds, bounds[1:])]
        return out

    def _learn(self, parts: list[str]) -> None:
        in_run = [p for p in parts if p[0] in " \n" and (not self.suffix or p[1:].isalpha())]
        rest = list(set(parts).difference(in_run))
        self.known.update(zip(in_run, self._library_run(in_run), strict=True))
        # where case is folded a text is normalised as a whole, and long ones cost more than many calls
        self.known.update(zip(rest, self._library(rest) if self.folds else self._library_parts(rest), strict=True))

    def encode_all(self, texts: list[str], chars: int = 4_000_000) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers. New parts are learned for many texts at a time."""
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and size < chars:
                size, to = size + len(texts[to]), to + 1
            yield from self._encode(texts[at:to])
            at = to

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        only_cache(self)
        if len(self.known) > self.keep:
            self.known, self.old = {}, self.known
        low = list(map(self._folded, texts)) if self.folds else texts
        whole = pc.match_substring_regex(pa.array(low, pa.large_string()), UNCERTAIN).to_pylist()
        for a in self.added:  # they are matched before case is folded
            whole = [w or a in x for w, x in zip(whole, low, strict=True)]
        pieces = self._encode_cut([x for w, x in zip(whole, low, strict=True) if not w])
        for w, text in zip(whole, texts, strict=True):
            yield self._library([text])[0] if w else next(pieces)

    def _encode_cut(self, texts: list[str]) -> Iterator[bytes]:
        """Texts that may be cut. Each gets a line break in front, so that all parts begin alike; where that has an id, it is taken off again."""
        if not texts:
            return
        if self.folds:
            data = np.frombuffer((" " + " ".join(texts)).replace("\n", " ").encode(), np.uint8)
        else:
            data = np.frombuffer(("\n" + "\n".join(texts)).encode(), np.uint8)
        begins = cuts(data)
        parts = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, len(data))), pa.py_buffer(data)).dictionary_encode()
        names, known, old, new = parts.dictionary.to_numpy(zero_copy_only=False).tolist(), self.known, self.old, []
        found = list(map(known.get, names))
        unknown = [i for i, ids in enumerate(found) if ids is None]
        for i in unknown:
            ids = old.get(names[i])
            if ids is None:
                new.append(names[i])
            else:
                known[names[i]] = ids
        if new:
            self._learn(new)
        for i in unknown:
            found[i] = known[names[i]]
        ids = pa.array(found, pa.large_binary()).take(parts.indices)
        _, offsets, joined = ids.buffers()
        at = np.cumsum([0, *(1 + len(x.encode()) for x in texts)])
        bounds = np.frombuffer(offsets, np.int64)[np.searchsorted(begins, at)].tolist()
        joined, front = memoryview(joined or b""), 0 if self.folds else 4
        for a, b in zip(bounds, bounds[1:]):
            yield bytes(joined[a + front : b])


_READY: dict[str, FastTokens] = {}


def tokens_of(path: str) -> FastTokens:
    """One encoder for each Python worker and vocabulary."""
    if path not in _READY:
        _READY[path] = FastTokens(path)
    return _READY[path]
