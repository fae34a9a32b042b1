"""Byte-level BPE: rounds of merges over length-bucketed, padded numpy matrices.

A text is cut by the pre-tokenising pattern; every distinct piece is a row of byte
ids in a matrix of its length bucket, padded at the right. In each round every row
merges its leftmost pair of minimum rank: the pair becomes one cell, the cells
behind it move up (compaction), and the ranks of the two pairs beside it are looked
up anew in an open-addressing hash table over (left id, right id). Rows without a
pair of known rank leave the matrix. A piece that is a token itself is that token,
as in the library that the ranks are made for. The few pieces beyond ``LONG`` bytes
would make rounds quadratic; a heap merges them in the same order.

Pieces that occur again in a task are looked up; at most ``KEPT`` of them are held.

Defined results: null text has null ids (:func:`report` counts it as empty); empty
text has none; texts of any length are read whole, in blocks of documents; no
special token is ever made, their strings are ordinary text; repeated rows repeat
their results; all other columns stay, whatever their names (an added name that is
taken gets an underscore); an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.llm.store import free_name

NONE = np.int32(2**31 - 1)  # the rank of a pair that is no token
#: Upper byte lengths of the buckets; longer pieces are merged by a heap.
BUCKETS = (4, 6, 8, 12, 16, 24, 32, 64, 128, 256)
LONG = BUCKETS[-1]
ROWS = 16_384  # rows of a matrix at once
KEPT = 200_000  # pieces a task remembers
CHUNK = 1_000_000  # characters segmented at once, or one text
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Pairs:
    """Ranks of pairs of ids, by linear probing in a table at most a quarter full."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> None:
        bits = max(4, int(4 * len(rank) + 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, NONE, np.int32)
        key = self._key(left, right)
        slot = self._slot(key)
        while len(key):
            free = np.flatnonzero(self.keys[slot] < 0)
            taken, which = np.unique(slot[free], return_index=True)
            put = free[which]
            self.keys[taken], self.ranks[taken] = key[put], rank[put]
            rest = np.ones(len(key), bool)
            rest[put] = False
            key, rank, slot = key[rest], rank[rest], (slot[rest] + 1) & self.mask

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) << 32) | right.astype(np.int64)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * _SPREAD) >> self.shift).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NONE`` where it is no token; negative ids are no tokens."""
        found = np.full(len(left), NONE, np.int32)
        asked = np.flatnonzero((left >= 0) & (right >= 0))
        key = self._key(left[asked], right[asked])
        slot = self._slot(key)
        while len(asked):
            held = self.keys[slot]
            hit = held == key
            found[asked[hit]] = self.ranks[slot[hit]]
            more = ~hit & (held >= 0)
            asked, key, slot = asked[more], key[more], (slot[more] + 1) & self.mask
        return found


class Ranks:
    """A rank file: tokens by id, the ids of single bytes and the ranks of pairs."""

    def __init__(self, path: str) -> None:
        self.of: dict[bytes, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    self.of[base64.b64decode(token)] = int(rank)
        self.size = max(self.of.values()) + 1
        self.of_byte = np.array([self.of[bytes([b])] for b in range(256)], np.int32)
        cuts = [
            (self.of[token[:i]], self.of[token[i:]], rank)
            for token, rank in self.of.items()
            for i in range(1, len(token))
            if token[:i] in self.of and token[i:] in self.of
        ]
        left, right, rank = np.array(cuts, np.int32).reshape(-1, 3).T
        self.pairs = Pairs(left, right, rank)
        tokens = [b""] * self.size
        for token, rank in self.of.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def text_bytes(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, one after the other."""
        return self.bytes[spread(self.starts[ids], self.lengths[ids])]


@lru_cache(maxsize=2)
def load(path: str) -> Ranks:
    return Ranks(path)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every run, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def merge_rows(ranks: Ranks, ids: np.ndarray) -> np.ndarray:
    """Rows of byte ids, padded with -1, merged until no pair is a token."""
    out = np.full(ids.shape, -1, np.int32)
    row = np.arange(len(ids))
    rank = ranks.pairs.of(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
    while len(row):
        at = rank.argmin(axis=1)  # the first of equal minima
        best = rank[np.arange(len(row)), at]
        going = best < NONE
        if not going.all():
            out[row[~going], : ids.shape[1]] = ids[~going]
            row, ids, rank, at, best = row[going], ids[going], rank[going], at[going], best[going]
            if not len(row):
                break
        every, place = np.arange(len(row)), np.arange(ids.shape[1] - 1)
        ids[every, at] = best
        ids = np.where(place <= at[:, None], ids[:, :-1], ids[:, 1:])
        if ids.shape[1] == 1:
            out[row, :1] = ids
            break
        rank = np.where(place[:-1] < at[:, None], rank[:, :-1], rank[:, 1:])
        before, after = np.flatnonzero(at > 0), np.flatnonzero(at < ids.shape[1] - 1)
        left = np.concatenate((ids[before, at[before] - 1], ids[after, at[after]]))
        right = np.concatenate((ids[before, at[before]], ids[after, at[after] + 1]))
        new = ranks.pairs.of(left, right)
        rank[before, at[before] - 1] = new[: len(before)]
        rank[after, at[after]] = new[len(before) :]
    return out


def merge_long(ranks: Ranks, piece: bytes) -> list[int]:
    """One long piece: pairs leave a heap by rank, then place."""
    ids = ranks.of_byte[np.frombuffer(piece, np.uint8)]
    first = ranks.pairs.of(ids[:-1], ids[1:])
    known = np.flatnonzero(first < NONE)
    heap = list(zip(first[known].tolist(), known.tolist(), ids[known].tolist(), ids[known + 1].tolist()))
    heapq.heapify(heap)
    cells: list[int] = ids.tolist()
    n = len(cells)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    text_of = [bytes([b]) for b in piece]
    while heap:
        rank, i, left, right = heapq.heappop(heap)
        j = after[i]
        if cells[i] != left or j >= n or cells[j] != right:
            continue
        cells[i], cells[j], text_of[i] = rank, -1, text_of[i] + text_of[j]
        after[i] = k = after[j]
        if k < n:
            before[k] = i
        for a, b in ((before[i], i), (i, k)):
            if a >= 0 and b < n:
                found = ranks.of.get(text_of[a] + text_of[b])
                if found is not None:
                    heapq.heappush(heap, (found, a, cells[a], cells[b]))
    return [c for c in cells if c >= 0]


class Encoder:
    """Encodes texts; remembers the pieces it has met."""

    def __init__(self, ranks: Ranks, pattern: str, kept: int = KEPT) -> None:
        self.ranks, self.kept = ranks, kept
        self.cut = regex.compile(pattern).findall
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and how many each has."""
        owner, place, ids = [], [], []

        def put(rows: np.ndarray, where: np.ndarray, found: np.ndarray) -> None:
            owner.append(rows)
            place.append(where)
            ids.append(found)

        whole = np.array([self.ranks.of.get(p, -1) for p in pieces], np.int32)
        direct = np.flatnonzero(whole >= 0)
        put(direct, np.zeros(len(direct), np.int64), whole[direct])
        sizes = np.array([len(p) for p in pieces], np.int64)
        low = 0
        for high in BUCKETS:
            rows = np.flatnonzero((whole < 0) & (sizes > low) & (sizes <= high))
            low = high
            for p in range(0, len(rows), ROWS):
                mine = rows[p : p + ROWS]
                cells = np.full((len(mine), high), -1, np.int32)
                flat = np.frombuffer(b"".join([pieces[k] for k in mine.tolist()]), np.uint8)
                cells[np.arange(high) < sizes[mine][:, None]] = self.ranks.of_byte[flat]
                done = merge_rows(self.ranks, cells)
                at, where = np.nonzero(done >= 0)
                put(mine[at], where, done[at, where])
        for k in np.flatnonzero((whole < 0) & (sizes > LONG)).tolist():
            found = np.array(merge_long(self.ranks, pieces[k]), np.int32)
            put(np.full(len(found), k), np.arange(len(found)), found)
        owners = np.concatenate(owner)
        order = np.lexsort((np.concatenate(place), owners))
        return np.concatenate(ids)[order], np.bincount(owners, minlength=len(pieces))

    def flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's begin, with the end of the last."""
        if len(self.number) > self.kept:
            self._forget()
        number, known, kinds, many = self.number, len(self.number), [], []
        for t in texts:
            found = self.cut(t) if t else []
            many.append(len(found))
            kinds += [number.setdefault(p, len(number)) for p in found]
        if len(number) > known:
            new = [p.encode("utf-8", "surrogatepass") for p in list(number)[known:]]
            ids, sizes = self.pieces(new)
            self.ids, self.sizes = np.concatenate((self.ids, ids)), np.concatenate((self.sizes, sizes))
        kind = np.array(kinds, np.int64)
        starts = np.cumsum(self.sizes) - self.sizes
        ids = self.ids[spread(starts[kind], self.sizes[kind])]
        ends = np.concatenate(([0], np.cumsum(self.sizes[kind])))
        return ids, ends[np.concatenate(([0], np.cumsum(np.array(many, np.int64))))]

    def encode(self, texts: list[str | None]) -> list[list[int] | None]:
        ids, cuts = self.flat(texts)
        return [None if t is None else ids[cuts[i] : cuts[i + 1]].tolist() for i, t in enumerate(texts)]


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Slices of at most ``CHUNK`` characters, or of one text."""
    at = size = 0
    for i, t in enumerate(texts):
        n = len(t or "") + 1
        if i > at and size + n > CHUNK:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


def encode(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, name: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text``; the rank file must exist where the executors run."""
    path, cut = ranks_path or default_ranks(), pattern or default_pattern()
    added = free_name(name, docs.columns)
    fields = docs.schema.fields
    rows = docs.select(F.col("text").alias("t"), F.struct(*[F.col(f"`{f.name}`") for f in fields]).alias("row"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(load(path), cut)
        for batch in batches:
            texts = batch.column("t").to_pylist()
            for p, q in _chunks(texts):
                ids, cuts = encoder.flat(texts[p:q])
                missing = pa.array([t is None for t in texts[p:q]])
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids), mask=missing)
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(p, q - p), lists], names=["row", added])

    schema = T.StructType([T.StructField("row", T.StructType(fields)), T.StructField(added, T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(of, schema).select(*[F.col("row")[f.name].alias(f.name) for f in fields], added)


def decode(tokens: DataFrame, ranks_path: str | None = None, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``tokens`` with the bytes of the ids in column ``ids``; null ids give null."""
    path = ranks_path or default_ranks()
    added = free_name(name, tokens.columns)
    fields = tokens.schema.fields
    rows = tokens.select(F.col(f"`{ids}`").alias("i"), F.struct(*[F.col(f"`{f.name}`") for f in fields]).alias("row"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load(path)
        for batch in batches:
            found = [None if x is None else ranks.text_bytes(np.array(x, np.int64)).tobytes() for x in batch.column("i").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.binary())], names=["row", added])

    schema = T.StructType([T.StructField("row", T.StructType(fields)), T.StructField(added, T.BinaryType())])
    return rows.mapInArrow(of, schema).select(*[F.col("row")[f.name].alias(f.name) for f in fields], added)


def report(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens and digests of the ids (little-endian, 32 bits each) and of the bytes they decode to."""
    path, cut = ranks_path or default_ranks(), pattern or default_pattern()
    fields = [docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load(path)
        encoder = Encoder(ranks, cut)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for p, q in _chunks(texts):
                ids, cuts = encoder.flat(texts[p:q])
                ends = np.concatenate(([0], np.cumsum(ranks.lengths[ids])))[cuts]
                coded, plain = ids.astype("<u4").tobytes(), ranks.text_bytes(ids).tobytes()
                digests = [
                    [hashlib.sha256(memoryview(data)[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                    for data, at in ((coded, cuts * 4), (plain, ends))
                ]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(p, q - p), pa.array(np.diff(cuts)), *map(pa.array, digests)], names=[f.name for f in fields])

    return docs.select("doc_id", "text").mapInArrow(of, T.StructType(fields))
