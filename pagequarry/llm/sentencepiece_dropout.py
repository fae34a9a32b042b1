"""SentencePiece merge segmentation with seeded merge dropout, and lossless decoding.

Segmentation is the model's own: characters are merged pair by pair, the pair
with the best-scored joined piece first, the leftmost on ties. With
``dropout`` > 0 a candidate merge that comes up is skipped if a keyed hash of
(seed, row key, unit, place of the unit in its text, place of both parts in the
unit, piece) falls below it; a skipped pair only comes up again after a
neighbour of it changed. The row key is a hash of the columns ``by`` (doc_id,
and a copy number where there is one). So every occurrence of a unit draws anew.

No merge joins a character to a following space, so a text splits into units
(spaces and the run after them) that are segmented on their own. Only the
characters of the distinct units of a chunk and their first merges are shared;
then every occurrence is segmented, one agenda step of each per round in numpy;
units longer than ``LONG`` use a heap instead, with the same result in O(n log n).

Characters without a piece, and the space symbol itself where a text contains
it, become byte pieces; so :func:`decode` gives back every text exactly.

Defined results: null text has null ids; the empty text has none; rows with
equal text and equal ``by`` (nulls count as the empty string) give equal ids;
of pairs of equal score the leftmost merges first; texts of any length are
encoded whole; extra columns stay, and where one is named ``ids`` or
``lossless`` the added column of that name gets underscores appended; an empty
table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.llm import shingles
from pagequarry.llm.store import free_name

SPACE = "▁"
LONG = 64
NONE = 2**31 - 1
#: Occurrences segmented together, and the step of the widths they are padded to.
BLOCK, STEP = 16_384, 4


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Model:
    """Pieces, merge ranks and byte pieces of a merge-type model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id_of = {self.pieces[i]: i for i in plain}
        byte_ids = [i for i in range(n) if sp.is_byte(i)]
        self.byte_of = {int(self.pieces[i][3:5], 16): i for i in byte_ids}
        self.of_byte = {i: b for b, i in self.byte_of.items()}
        self.piece_bytes = [
            bytes([self.of_byte[i]]) if i in self.of_byte else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)
        ]
        order = sorted(plain, key=lambda i: (-sp.get_score(i), i))
        rank = {i: r for r, i in enumerate(order)}
        self.by_rank = np.array(order, np.int64)
        left, right, joined, ranks = [], [], [], []
        for i in plain:
            piece = self.pieces[i]
            for cut in range(1, len(piece)):
                a, b = self.id_of.get(piece[:cut]), self.id_of.get(piece[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), joined.append(i), ranks.append(rank[i])
        key = np.array(left, np.int64) * (1 << 20) + np.array(right, np.int64)
        by_key = np.argsort(key)
        self.keys = key[by_key]
        self.joined = np.array(joined, np.int64)[by_key]
        # a rank is shared by the splits of one piece: ties are broken by place, as in the agenda
        self.ranks = np.array(ranks, np.int64)[by_key]
        self.pair = {int(k): (int(r), int(j)) for k, r, j in zip(self.keys, self.ranks, self.joined, strict=True)}
        size = 0x110000
        self.of_char = np.full(size, -1, np.int64)
        for piece, i in self.id_of.items():
            if len(piece) == 1 and piece != SPACE:
                self.of_char[ord(piece)] = i
        self.of_char[ord(" ")] = self.id_of[SPACE]
        # a hash table from pair to merge: 2**22 slots, linear probing resolved by search on collision
        self.slot_bits = 22
        self.slots = np.full(1 << self.slot_bits, -1, np.int32)
        self.slots[self._slot(self.keys)] = np.arange(len(self.keys), dtype=np.int32)
        lost = self.slots[self._slot(self.keys)] != np.arange(len(self.keys))
        self.clash = np.zeros(1 << self.slot_bits, bool)
        self.clash[self._slot(self.keys[lost])] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.slot_bits)).astype(np.int64)

    def merges(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index of the merge of each pair, or -1."""
        key = a * (1 << 20) + b
        slot = self._slot(key)
        at = self.slots[slot].astype(np.int64)
        at[(a < 0) | (b < 0)] = -1
        wrong = np.flatnonzero((at >= 0) & (self.keys[at] != key))
        if len(wrong):
            at[wrong] = -1
            again = wrong[self.clash[slot[wrong]]]
            found = np.minimum(np.searchsorted(self.keys, key[again]), len(self.keys) - 1)
            at[again] = np.where(self.keys[found] == key[again], found, -1)
        return at

    def priorities(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, or NONE."""
        at = self.merges(a.astype(np.int64), b.astype(np.int64))
        return np.where(at >= 0, self.ranks[at], NONE)

    def byte_ids(self, char: str) -> list[int]:
        return [self.byte_of[b] for b in char.encode("utf-8", "surrogatepass")]


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    return Model(path)


def skip_hash(unit: np.ndarray, place: np.ndarray, right: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """A number in [0, 1) keyed by occurrence (its key), place of the left and the right part, and joined piece."""
    places = place.astype(np.uint64) + (right.astype(np.uint64) << np.uint64(32))
    x = shingles.mixed(unit + places * np.uint64(0x9E3779B97F4A7C15) + piece.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def contents(chars: np.ndarray, place: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each unit's characters; units begin at ``first``."""
    terms = (chars.astype(np.uint64) + np.uint64(1)) * shingles.keys(int(place.max()) + 1, 91)[place]
    return np.add.reduceat(terms, first)


def occurrence_keys(content: np.ndarray, seed: int, row: np.ndarray | int, at: np.ndarray | int) -> np.ndarray:
    """Key of each unit, the ``at``-th of the text whose row key is ``row``."""
    salt = shingles.keys(1, seed % 2**32)[0]
    rows = shingles.mixed(np.asarray(row, np.int64).reshape(-1).view(np.uint64) + salt)
    ats = np.asarray(at, np.int64).reshape(-1).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return shingles.mixed(content ^ shingles.mixed(rows + ats))


def unit_keys(chars: np.ndarray, place: np.ndarray, first: np.ndarray, seed: int, row: int, at: int = 0) -> np.ndarray:
    """The key of each unit if it is the ``at``-th of its text."""
    return occurrence_keys(contents(chars, place, first), seed, row, at)


def segment_long(model: Model, ids: list[int], key: np.uint64, dropout: float) -> list[tuple[int, int]]:
    """(piece, first character) of one unit, with a heap as the agenda."""
    n = len(ids)
    piece, nxt, prv = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
    alive, agenda = [True] * n, []

    def offer(i: int) -> None:
        j = nxt[i]
        if i >= 0 and j < n and piece[i] >= 0 and piece[j] >= 0:
            m = model.pair.get(piece[i] * (1 << 20) + piece[j])
            if m:
                heapq.heappush(agenda, (m[0], i, piece[i], piece[j], m[1], j))

    for i in range(n - 1):
        offer(i)
    while agenda:
        _, i, a, b, joined, j = heapq.heappop(agenda)
        if not (alive[i] and j < n and alive[j] and nxt[i] == j and piece[i] == a and piece[j] == b):
            continue
        if dropout and skip_hash(np.array([key]), np.array([i]), np.array([j]), np.array([joined]))[0] < dropout:
            continue
        piece[i], alive[j] = joined, False
        nxt[i] = nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
        offer(i)
        if prv[i] >= 0:
            offer(prv[i])
    return [(piece[i], i) for i in range(n) if alive[i]]


def segment_short(model: Model, ids: np.ndarray, priority: np.ndarray, key: np.ndarray, dropout: float) -> np.ndarray:
    """Segments one unit per row: symbols by place, then at least one column of -2; gives the rows with -2 where a piece goes on."""
    n, width = ids.shape
    out, row = np.empty_like(ids), np.arange(n)
    places = np.arange(width)
    nxt = np.broadcast_to(np.minimum(places + 1, width - 1), (n, width)).copy()
    prv = np.broadcast_to((places - 1) % width, (n, width)).copy()
    while len(row):
        at = priority.argmin(1)
        base = np.arange(len(row)) * width
        flat = base + at
        best = priority.ravel()[flat]
        active = np.flatnonzero(best < NONE)
        if 4 * len(active) <= 3 * len(row):  # finished rows leave
            out[row] = ids
            row, key = row[active], key[active]
            ids, priority, nxt, prv = ids[active], priority[active], nxt[active], prv[active]
            at, best = at[active], best[active]
            base = np.arange(len(row)) * width
            flat = base + at
            active = slice(None)
        at, base, flat, joined = at[active], base[active], flat[active], model.by_rank[best[active]]
        flat_ids, flat_priority, flat_nxt, flat_prv = (x.reshape(-1) for x in (ids, priority, nxt, prv))
        right = flat_nxt[flat]
        if dropout:
            skipped = skip_hash(key[active], at, right, joined) < dropout
            flat_priority[flat[skipped]] = NONE
            stay = ~skipped
            at, base, flat, joined, right = at[stay], base[stay], flat[stay], joined[stay], right[stay]
        gone = base + right
        after, before = base + flat_nxt[gone], base + flat_prv[flat]
        flat_ids[flat], flat_ids[gone], flat_priority[gone] = joined, -2, NONE
        flat_nxt[flat], flat_prv[after] = after - base, at
        flat_prv[base + width - 1] = width - 1
        changed = np.concatenate((flat, before))
        flat_priority[changed] = model.priorities(flat_ids[changed], np.concatenate((flat_ids[after], joined)))
    return out


#: Spaces with the run after them; spaces at the end stand alone.
UNIT = r" *[^ ]+| +"


class Segmenter:
    """Segments texts; what their distinct units share is worked out once a call."""

    def __init__(self, model: Model, dropout: float, seed: int) -> None:
        self.model, self.dropout, self.seed = model, dropout, seed

    def segments(self, found: list[str], rows: np.ndarray, ats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of every unit, one after the other, and how many each has; by row keys and places of the units."""
        number: dict[str, int] = {}
        kind = np.array([number.setdefault(u, len(number)) for u in found], np.int64)
        units = list(number)
        sizes = np.array([len(u) for u in units])
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.cumsum(sizes) - sizes
        place = np.arange(len(chars)) - np.repeat(first, sizes)
        key = occurrence_keys(contents(chars, place, first)[kind], self.seed, rows, ats)
        symbols = self.model.of_char[chars]
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # occurrence, place in it, id
        for k in np.flatnonzero(sizes[kind] > LONG).tolist():
            p = first[kind[k]]
            got = segment_long(self.model, symbols[p : p + sizes[kind[k]]].tolist(), key[k], self.dropout)
            parts.append((np.full(len(got), k), np.array([i for _, i in got]), np.array([x for x, _ in got])))
        steps = -(-sizes // STEP)
        for step in range(1, LONG // STEP + 1):
            mine = np.flatnonzero(steps == step)
            if not len(mine):
                continue
            width = step * STEP + 1
            inside = np.arange(width) < sizes[mine][:, None]
            ids = np.full(inside.shape, -2, np.int64)
            ids[inside] = symbols[(first[mine][:, None] + np.arange(width))[inside]]
            priority = np.full(inside.shape, NONE, np.int64)
            priority[:, :-1] = self.model.priorities(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(mine), -1)
            local = np.full(len(units), -1)
            local[mine] = np.arange(len(mine))
            own = np.flatnonzero(steps[kind] == step)
            for p in range(0, len(own), BLOCK):
                block = own[p : p + BLOCK]
                of = local[kind[block]]
                done = segment_short(self.model, ids[of].astype(np.int32), priority[of].astype(np.int32), key[block], self.dropout)
                at, where = np.nonzero(done != -2)
                parts.append((block[at], where, done[at, where].astype(np.int64)))
        occurrence, where, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(occurrence, kind="stable")
        occurrence, where, ids = occurrence[order], where[order], ids[order]
        odd = np.flatnonzero(ids < 0)
        if len(odd):  # characters without a piece, as bytes
            codes = [self.model.byte_ids(found[k][i]) for k, i in zip(occurrence[odd].tolist(), where[odd].tolist(), strict=True)]
            many = np.ones(len(ids), np.int64)
            many[odd] = [len(c) for c in codes]
            ends = np.cumsum(many)
            ids, occurrence = np.repeat(ids, many), np.repeat(occurrence, many)
            spots = np.repeat(ends[odd] - many[odd], many[odd]) + np.concatenate([np.arange(len(c)) for c in codes])
            ids[spots] = np.concatenate(codes)
        return ids, np.bincount(occurrence, minlength=len(found))

    def units(self, found: list[str], row: int) -> dict[str, tuple[int, ...]]:
        """Piece ids of each distinct unit as the first of a text."""
        new = list(dict.fromkeys(found))
        ids, many = self.segments(new, np.full(len(new), row), np.zeros(len(new), np.int64))
        return {u: tuple(x.tolist()) for u, x in zip(new, np.split(ids, np.cumsum(many)[:-1]), strict=True)}

    def flat(self, texts: list[str | None], rows: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts, one after the other, and where each text's begin, with the end of the last."""
        split = [re.findall(UNIT, f" {t}") if t else [] for t in texts]
        many = np.array([len(x) for x in split], np.int64)
        starts = np.zeros(len(texts) + 1, np.int64)
        if not many.sum():
            return np.zeros(0, np.int64), starts
        ats = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        ids, sizes = self.segments([u for x in split for u in x], np.repeat(np.array(rows, np.int64), many), ats)
        starts[1:] = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum(many)]
        return ids, starts

    def encode(self, texts: list[str | None], rows: list[int]) -> list[list[int] | None]:
        """Piece ids of each text by row keys."""
        ids, starts = self.flat(texts, rows)
        plain, cuts = ids.tolist(), starts.tolist()
        return [None if t is None else plain[cuts[i] : cuts[i + 1]] for i, t in enumerate(texts)]


def decode_ids(model: Model, ids: list[int] | None) -> str | None:
    """The text that was encoded."""
    if ids is None:
        return None
    return b"".join(map(model.piece_bytes.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


def _chunks(texts: list[str | None], limit: int = 1_000_000) -> Iterator[tuple[int, int]]:
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size > limit:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def encode(docs: DataFrame, dropout: float = 0.1, seed: int = 0, model_path: str | None = None, check: bool = False, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``docs`` with ``ids``, and with ``lossless`` (decoding gives the text back) if ``check``.

    The dropout is drawn by the columns ``by``: with doc_id alone, copies of a document are cut alike.
    ``model_path`` is read by the executors and must exist there.
    """
    path = model_path or default_model()
    added = [free_name(c, docs.columns) for c in (("ids", "lossless") if check else ("ids",))]
    others = docs.schema.fields
    key = F.xxhash64(F.lit(seed), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in by])
    rows = docs.select(F.col("text").alias("t"), key.alias("v"), F.struct(*[F.col(f"`{f.name}`") for f in others]).alias("row"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        segmenter = Segmenter(model, dropout, seed)
        for batch in batches:
            texts, keys = batch.column("t").to_pylist(), batch.column("v").to_pylist()
            for p, q in _chunks(texts):
                ids, starts = segmenter.flat(texts[p:q], keys[p:q])
                missing = np.array([t is None for t in texts[p:q]])
                lists = pa.ListArray.from_arrays(starts.astype(np.int32), ids.astype(np.int32), mask=pa.array(missing))
                columns = [batch.column("row").slice(p, q - p), lists]
                if check:
                    plain, cuts = ids.tolist(), starts.tolist()
                    back = [t is None or decode_ids(model, plain[cuts[i] : cuts[i + 1]]) == t for i, t in enumerate(texts[p:q])]
                    columns.append(pa.array(back, pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names=["row", *added])

    schema = T.StructType([T.StructField("row", T.StructType(others)), T.StructField(added[0], T.ArrayType(T.IntegerType()))])
    if check:
        schema = schema.add(added[1], T.BooleanType())
    return rows.mapInArrow(of, schema).select(*[F.col("row")[f.name].alias(f.name) for f in others], *added)


def decode(tokens: DataFrame, model_path: str | None = None) -> DataFrame:
    """``tokens`` with the decoded ``text`` of column ``ids``."""
    path = model_path or default_model()

    @F.pandas_udf("string")
    def of(ids: pd.Series) -> pd.Series:
        model = load(path)
        return ids.map(lambda x: None if x is None else decode_ids(model, list(x)))

    return tokens.withColumn("text", of("ids"))
