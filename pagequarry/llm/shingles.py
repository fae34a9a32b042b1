"""Word-shingle sets, fingerprints and MinHash signatures of many texts at once (numpy over Arrow buffers)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64's): every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keys(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    return mixed((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15))


def text_chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, text ends) of runs of whole texts of about ``CHUNK_BYTES``; null texts are empty."""
    texts = texts.fill_null("").cast(pa.large_binary())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at + 1 : to + 1] - offsets[at]
        at = to


def shingle_sets(data: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and the number of them per text.

    Words are runs without white space, A-Z lowered. A text with fewer words than
    ``width`` has its whole sequence as one shingle; one without words has none.
    """
    lower = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    inside = ~((lower == 32) | ((lower >= 9) & (lower <= 13)))
    starts_text = np.zeros(len(data) + 1, bool)
    starts_text[0] = True
    starts_text[ends] = True
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    begins = np.flatnonzero(inside & (~before | starts_text[:-1]))
    if not len(begins):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    position = np.arange(begins[0], len(data)) - np.repeat(begins, np.diff(np.append(begins, len(data))))
    byte_keys = keys(int(position.max()) + 1, 11)
    terms = np.where(inside[begins[0] :], (lower[begins[0] :].astype(np.uint64) + np.uint64(1)) * byte_keys[position], np.uint64(0))
    words = mixed(np.add.reduceat(terms, begins - begins[0]))

    text_of_word = np.searchsorted(ends, begins, "right")
    n_words = np.bincount(text_of_word, minlength=len(ends))
    first_word = np.concatenate(([0], np.cumsum(n_words)[:-1]))
    order_keys = keys(width, 23)
    out, of = [], []
    if len(words) >= width:
        rolled = sum(words[k : len(words) - width + 1 + k] * order_keys[k] for k in range(width))
        owner = text_of_word[: len(rolled)]
        whole = owner == text_of_word[width - 1 :]
        out.append(mixed(rolled[whole]))
        of.append(owner[whole])
    for n in range(1, width):
        short = np.flatnonzero(n_words == n)
        if len(short):
            at = first_word[short]
            out.append(mixed(sum(words[at + k] * order_keys[k] for k in range(n)) + np.uint64(n)))
            of.append(short)
    hashes, owner = np.concatenate(out), np.concatenate(of)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.bincount(owner[new], minlength=len(ends)).astype(np.int64)


def per_text(values: np.ndarray, counts: np.ndarray, reduce: np.ufunc, empty: int) -> np.ndarray:
    """``reduce`` over each text's run of values."""
    out = np.full(len(counts), empty, values.dtype)
    some = counts > 0
    if some.any():
        out[some] = reduce.reduceat(values, (np.cumsum(counts) - counts)[some])
    return out


def minima(hashes: np.ndarray, counts: np.ndarray, n: int, seed: int = 37) -> np.ndarray:
    """``n`` minima per text of the universal hashes ``a * x + b`` (odd ``a``), each mixed to 64 bits."""
    a, b = keys(n, seed) | np.uint64(1), keys(n, seed + 1000)
    out = np.empty((len(counts), n), np.uint64)
    for j in range(n):
        out[:, j] = per_text(hashes * a[j] + b[j], counts, np.minimum, 0)
    return mixed(out)
