"""Bits, samples, permissions and text codecs as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def permissions(p: Column) -> Column:
    """Whether the permission bits allow printing, changing and extracting."""

    def has(bit: int) -> Column:
        return p.bitwiseAND(F.lit(bit)) != 0

    return F.struct(has(4).alias("printable"), has(8).alias("modifiable"), has(16).alias("extractable"))


def unpack_byte(byte: Column, bits: int) -> Column:
    """Samples of 1, 2 or 4 bits of a byte, highest first; wider samples stay as they are."""
    if bits >= 8:
        return F.array(byte)
    shifts = range(8 - bits, -1, -bits)
    return F.array(*[F.shiftright(byte, s).bitwiseAND(F.lit((1 << bits) - 1)) for s in shifts])


def decode_sample(sample: Column, low: Column, high: Column, bits: int) -> Column:
    """A raw sample placed between the ends of its decode range."""
    return low + sample.cast("double") / F.lit(float((1 << bits) - 1)) * (high - low)


def ascii_hex_decode(text: Column) -> Column:
    """Bytes of hex digits up to ``>``; white space is skipped and an odd last digit is followed by 0."""
    digits = F.regexp_replace(F.substring_index(text, ">", 1), r"[\x00\t\n\f\r ]+", "")
    return F.unhex(F.concat(digits, F.when(F.length(digits) % 2 == 1, "0").otherwise("")))


def is_dct(content: Column) -> Column:
    """Whether bytes begin like a JPEG stream."""
    return F.hex(F.substring(content, 1, 2)) == "FFD8"
