"""Samples of one image from its decoded bytes."""

from __future__ import annotations

import numpy as np


def unpacked(data: bytes, width: int, height: int, components: int, bits: int) -> np.ndarray:
    """One byte per sample of 1, 2 or 4 bits, every row beginning at a byte; wider samples as they are. Missing bytes are 0."""
    per_row = (width * components * bits + 7) // 8
    raw = np.frombuffer(data[: per_row * height].ljust(per_row * height, b"\0"), np.uint8).reshape(height, per_row)
    if bits >= 8:
        return raw
    shifts = np.arange(8 - bits, -1, -bits, dtype=np.uint8)
    return ((raw[:, :, None] >> shifts) & ((1 << bits) - 1)).reshape(height, -1)[:, : width * components]


def expanded(indexes: np.ndarray, palette: bytes, components: int) -> np.ndarray:
    """Colours of palette indexes; an index beyond the palette is zeros."""
    table = np.zeros((256, components), np.uint8)
    known = np.frombuffer(palette[: len(palette) // components * components], np.uint8).reshape(-1, components)[:256]
    table[: len(known)] = known
    return table[indexes].reshape(len(indexes), -1)
