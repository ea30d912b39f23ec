"""Byte-level BPE of whole columns in numpy matrices.

Texts are cut into pieces by the tokenizer's published pattern. The distinct pieces of a batch that were not met before
are laid out as padded matrices of token ids, one matrix per range of lengths. In each round every row merges its
leftmost pair of minimum rank: ranks are kept beside the ids, looked up in a hash table of pairs (open addressing, all
rows at once) only where a merge changed them; finished rows are taken out and the matrix is compacted. A row of more
than ``LONG`` bytes merges all occurrences of its minimum pair in a round. That gives the same ids, as a merged token
takes part only in pairs of higher rank than its own, and it keeps long unbroken runs from taking a round per byte.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the pattern published with the vocabulary.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_PAIR = np.int32(2**31 - 1)
LONG = 64
ROWS = 20_000
KNOWN = 400_000
CHARS = 2_000_000
MOST_VOCABULARY_BYTES = 64 << 20


class PairTable:
    """Hash table from a pair of ids to the id of their merge, which is its rank."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        self.bits = max(4, int(len(left) * 4 - 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NO_PAIR, np.int32)
        key = left.astype(np.int64) << 32 | right
        slot = self._slot(key)
        while len(key):
            free = self.keys[slot] == -1
            _, first = np.unique(slot, return_index=True)  # of the keys that want a slot, one gets it
            mine = np.zeros(len(key), bool)
            mine[first] = free[first]
            self.keys[slot[mine]] = key[mine]
            self.values[slot[mine]] = merged[mine]
            key, merged = key[~mine], merged[~mine]
            slot = (slot[~mine] + 1) & (len(self.keys) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of pairs of any shape; a negative id has no pair."""
        key = left.astype(np.int64) << 32 | right
        key = np.where((left < 0) | (right < 0), np.int64(-2), key)
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], NO_PAIR)
        open_ = np.flatnonzero((found != key) & (found != -1) & (key != -2))
        flat, at = key.ravel(), slot.ravel()
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[at[open_]]
            hit = found == flat[open_]
            out.ravel()[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


class Encoder:
    """Encodes texts; ``vocabulary`` is the content of a .tiktoken file (base64 bytes and rank per line)."""

    def __init__(self, vocabulary: bytes) -> None:
        ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
        self.byte = np.array([ids[bytes([i])] for i in range(256)], np.int32)
        splits = [(ids[t[:i]], ids[t[i:]], n) for t, n in ids.items() for i in range(1, len(t)) if t[:i] in ids and t[i:] in ids]
        left, right, merged = (np.array(c, np.int32) for c in zip(*splits, strict=True))
        self.pairs = PairTable(left, right, merged)
        self.piece = regex.compile(PIECE)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.values = np.empty(0, np.int32)
        self.starts = np.zeros(1, np.int64)

    def _long(self, row: np.ndarray) -> np.ndarray:
        ranks = self.pairs.ranks(row[:-1], row[1:])
        while len(ranks) and (least := ranks.min()) != NO_PAIR:
            at = np.flatnonzero(ranks == least)
            # In a run of overlapping occurrences every second one merges, from the left.
            head = np.r_[True, np.diff(at) > 1]
            place = np.arange(len(at)) - np.flatnonzero(head)[np.cumsum(head) - 1]
            at = at[place % 2 == 0]
            row[at] = least
            keep = np.ones(len(row), bool)
            keep[at + 1] = False
            row = row[keep]
            at -= np.arange(len(at))
            ranks = ranks[keep[1:]] if len(row) > 1 else ranks[:0]
            touched = np.unique(np.r_[at - 1, at])
            touched = touched[(touched >= 0) & (touched < len(row) - 1)]
            if len(touched):
                ranks[touched] = self.pairs.ranks(row[touched], row[touched + 1])
        return row

    def _matrix(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows padded with -1 at their ends; gives the merged rows and their lengths."""
        n, width = ids.shape
        out = np.full((n, width), -1, np.int32)
        rows = np.arange(n)
        ranks = self.pairs.ranks(ids[:, :-1], ids[:, 1:])
        while True:
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(rows)), at]
            done = least == NO_PAIR
            if done.any():
                out[rows[done], : ids.shape[1]] = ids[done]
                go = ~done
                if not go.any():
                    break
                ids, ranks, rows, at, least = ids[go], ranks[go], rows[go], at[go], least[go]
            every = np.arange(len(rows))
            width = ids.shape[1] - 1
            ids[every, at] = least
            column = np.arange(width)[None, :]
            ids = np.take_along_axis(ids, column + (column > at[:, None]), axis=1)
            if width == 1:
                out[rows, :1] = ids
                break
            column = column[:, :-1]
            ranks = np.take_along_axis(ranks, column + (column >= at[:, None]), axis=1)
            has = at < width - 1
            ranks[every[has], at[has]] = self.pairs.ranks(ids[every[has], at[has]], ids[every[has], at[has] + 1])
            has = at > 0
            ranks[every[has], at[has] - 1] = self.pairs.ranks(ids[every[has], at[has] - 1], ids[every[has], at[has]])
        return out, (out >= 0).sum(axis=1)

    def _learn(self, pieces: list[str]) -> None:
        raw = [p.encode() for p in pieces]
        size = np.array([len(r) for r in raw], np.int64)
        order = np.argsort(size, kind="stable")
        made: list[np.ndarray] = []
        counts = np.zeros(len(raw), np.int64)
        data = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
        begin = np.r_[0, np.cumsum(size)]
        low = 0
        for high in (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 32, LONG):
            of = order[np.searchsorted(size[order], low, "right") : np.searchsorted(size[order], high, "right")]
            low = high
            for part in (of[i : i + ROWS] for i in range(0, len(of), ROWS)):
                column = np.arange(high)
                there = column < size[part][:, None]
                ids = np.where(there, data[np.minimum(begin[part][:, None] + column, len(data) - 1)], np.int32(-1))
                merged, n = (ids, there.sum(axis=1)) if high == 1 else self._matrix(ids)
                counts[part] = n
                made.append(merged[np.arange(merged.shape[1]) < n[:, None]])
        for i in order[np.searchsorted(size[order], LONG, "right") :]:
            made.append(self._long(data[begin[i] : begin[i + 1]].copy()))
            counts[i] = len(made[-1])
        base = len(self.known)
        self.known.update((pieces[i], base + k) for k, i in enumerate(order))
        self.values = np.concatenate([self.values, *made])
        self.starts = np.r_[self.starts, self.starts[-1] + np.cumsum(counts[order])]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of ids of each text."""
        cut = [self.piece.findall(t) if t else [] for t in texts]
        flat = [p for pieces in cut for p in pieces]
        if len(self.known) > KNOWN:
            self._forget()
        new = set(flat).difference(self.known)
        if new:
            self._learn(list(new))
        code = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        start, n = self.starts[code], self.starts[code + 1] - self.starts[code]
        total = np.cumsum(n)
        ids = self.values[np.arange(total[-1] if len(total) else 0) + np.repeat(start - (total - n), n)]
        bounds = np.cumsum([0, *map(len, cut)])
        return ids, np.diff(np.r_[0, total][bounds])


@lru_cache(maxsize=2)
def _encoder(vocabulary: bytes) -> Encoder:
    return Encoder(vocabulary)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices whose texts have about ``CHARS`` characters together, or one text that has more."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        begin = held = 0
        for i, t in enumerate(texts):
            held += len(t or "")
            if held >= CHARS:
                yield batch.slice(begin, i + 1 - begin), texts[begin : i + 1]
                begin, held = i + 1, 0
        if begin < len(texts):
            yield batch.slice(begin), texts[begin:]


def _vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        content = f.read(MOST_VOCABULARY_BYTES + 1)
    if len(content) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"{path} is no vocabulary file: it has more than {MOST_VOCABULARY_BYTES} bytes")
    return content


def encoded(df: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """``(key, ids)``: every text as token ids, without special tokens; their strings are ordinary text.

    A null and an empty text give an empty list; texts are encoded whole, however long; a null key and repeated rows stay
    as they are; an empty table gives no rows. ``vocabulary`` is the path of a .tiktoken file on the driver; its content
    (bounded by ``MOST_VOCABULARY_BYTES``) is broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(_vocabulary(vocabulary))
    rows = df.select(df[key].alias("key"), df[text].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch, texts in _batches(batches):
            ids, n = encoder.encode(texts)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(ids))
            yield pa.record_batch([batch.column(0), lists], names=["key", "ids"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, ids array<int>").select(F.col("key").alias(key), "ids")


def token_counts(df: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """``(key, n_tokens)``: the lengths of :func:`encoded`'s lists, without moving the lists."""
    shared = df.sparkSession.sparkContext.broadcast(_vocabulary(vocabulary))
    rows = df.select(df[key].alias("key"), df[text].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch, texts in _batches(batches):
            yield pa.record_batch([batch.column(0), pa.array(encoder.encode(texts)[1])], names=["key", "n_tokens"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, n_tokens bigint").select(F.col("key").alias(key), "n_tokens")
