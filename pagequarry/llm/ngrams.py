"""Hashed byte n-gram features of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pagequarry.llm.shingles import keys, text_chunks

DIMS = 1 << 13
ORDERS = (2, 3, 4)
ROWS = 256


def features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, matrix) of unit-length square roots of n-gram counts; letters A-Z count as lower case."""
    shift, mix = np.uint64(64 - DIMS.bit_length() + 1), keys(max(ORDERS), 3) | np.uint64(1)
    for at, data, ends in text_chunks(texts):
        starts = np.concatenate(([0], ends[:-1]))
        for p in range(0, len(ends), ROWS):
            q = min(p + ROWS, len(ends))
            part = data[starts[p] : ends[q - 1]]
            low = np.where((part >= 65) & (part <= 90), part + np.uint8(32), part).astype(np.uint64) + np.uint64(1)
            cuts = ends[p:q] - starts[p]
            owner = np.repeat(np.arange(q - p), np.diff(np.concatenate(([0], cuts))))
            counts = np.zeros((q - p) * DIMS, np.float32)
            for n in ORDERS:
                if len(low) < n:
                    continue
                h = sum(low[k : len(low) - n + 1 + k] * mix[k] for k in range(n)) * np.uint64(0x9E3779B97F4A7C15 + 2 * n)
                within = owner[: len(h)] == owner[n - 1 :]
                flat = owner[: len(h)][within] * DIMS + (h[within] >> shift).astype(np.int64)
                counts += np.bincount(flat, minlength=len(counts))
            x = np.sqrt(counts.reshape(q - p, DIMS))
            yield at + p, x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


#: Columns of sparse rows beside their target.
SPARSE = "places binary, values binary"


def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (target, text) as (target, places, values) without zeros, both packed."""
    for batch in batches:
        for at, x in features(batch.column("text")):
            places = [np.flatnonzero(row) for row in x]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("target").slice(at, len(x)),
                    pa.array([p.astype(np.uint16).tobytes() for p in places], pa.binary()),
                    pa.array([row[p].tobytes() for row, p in zip(x, places, strict=True)], pa.binary()),
                ],
                names=["target", "places", "values"],
            )


def dense(rows: list) -> np.ndarray:
    """Matrix of collected sparse rows."""
    out = np.zeros((len(rows), DIMS), np.float32)
    for i, r in enumerate(rows):
        out[i, np.frombuffer(r["places"], np.uint16)] = np.frombuffer(r["values"], np.float32)
    return out
