"""Packing token ids into sequences: first-fit decreasing over a tournament tree, run in random groups of documents."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text


class TournamentTree:
    """Bins in order of opening; each node holds the largest free capacity below it, so the first bin that fits is found in log time."""

    def __init__(self, n_bins: int, capacity: int):
        self.leaves = 1 << max(0, (n_bins - 1).bit_length())
        self.free = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        """The first bin with room for ``size``; takes the room."""
        free, node = self.free, 1
        while node < self.leaves:
            node *= 2
            if free[node] < size:
                node += 1
        free[node] -= size
        bin_ = node - self.leaves
        while node > 1:
            node //= 2
            left, right = free[2 * node], free[2 * node + 1]
            free[node] = left if left >= right else right
        return bin_


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece; of equal sizes the earlier goes first."""
    tree, used, out = TournamentTree(max(1, len(sizes)), capacity), {}, [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = tree.first_fit(sizes[i])
        out[i] = (b, used.get(b, 0))
        used[b] = used.get(b, 0) + sizes[i]
    return out


def cut_and_pack(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, bin, offset) of all pieces: full ones first, then what is left of each document, packed.

    Gaps left by first-fit decreasing are then filled from the emptiest bins, whose pieces are cut further, so that one bin
    at most is not full.
    """
    out, rest = [], []
    n_full = 0
    for i, n in enumerate(lengths):
        for k in range(n // capacity):
            out.append((i, k * capacity, capacity, n_full, 0))
            n_full += 1
        if n % capacity:
            rest.append((i, n - n % capacity, n % capacity))
    bins: dict[int, list[list[int]]] = {}
    for (i, start, size), (b, _) in zip(rest, first_fit_decreasing([r[2] for r in rest], capacity), strict=True):
        bins.setdefault(b, []).append([i, start, size])
    room = {b: capacity - sum(p[2] for p in pieces) for b, pieces in bins.items()}
    order = sorted(bins, key=lambda b: (room[b], b))
    low, high = 0, len(order) - 1
    while low < high:
        b, donor = order[low], order[high]
        if not room[b]:
            low += 1
        elif not bins[donor]:
            high -= 1
        else:
            i, start, size = bins[donor].pop()
            taken = min(size, room[b])
            if taken < size:
                bins[donor].append([i, start, size - taken])
            bins[b].append([i, start + size - taken, taken])
            room[b] -= taken
            room[donor] += taken
    at = n_full
    for b in order:
        offset = 0
        for i, start, size in bins[b]:
            out.append((i, start, size, at, offset))
            offset += size
        at += bool(bins[b])
    return out


def padded_length(used: int, capacity: int) -> int:
    """A sequence is padded to ``capacity``, unless its length is a power of two."""
    return used if used & (used - 1) == 0 else capacity


def pack_documents(df: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, group_bytes: int = 4 << 20, seed: int = 17, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenise whole texts and pack them; one row per piece.

    Returns doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, padded_length.
    Documents are dealt at random to groups of about ``group_bytes`` of text, in all of which first-fit decreasing runs by itself. Each document gets
    ``end_id``; a null text is empty, repeated rows and null ids are documents of their own. An empty table gives no rows.
    """
    size = df.agg(F.sum(F.octet_length(df[text]))).first()[0] or 0
    n_groups = max(1, -(-size // group_bytes))
    rows = df.select(df[doc_id].cast("long").alias("doc_id"), whole_text(df[text]).alias("text"))
    # rows that repeat an id are dealt by their place as well, so that no group gets them all
    rows = rows.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "doc_id", F.monotonically_increasing_id()), F.lit(n_groups)))
    end = struct.pack("<I", end_id)

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        from .fast_tokens import tokens_of

        ids = [x + end for x in tokens_of(tokenizer).encode_all(group["text"].tolist())]
        pieces = cut_and_pack([len(x) // 4 for x in ids], capacity)
        used: dict[int, int] = {}
        for _, _, length, b, _ in pieces:
            used[b] = used.get(b, 0) + length
        docs = group["doc_id"].astype("Int64").tolist()
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "padded_length"]
        rows = [(docs[i], start, length, ids[i][4 * start : 4 * (start + length)], len(ids[i]) // 4, (key[0] << 24) + b, offset, padded_length(used[b], capacity)) for i, start, length, b, offset in pieces]
        return pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, padded_length long"
    return rows.groupBy("group").applyInPandas(pack, schema)
