"""Codes to text and widths for one font resource."""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from codecs import charmap_decode
from dataclasses import dataclass, field

import numpy as np

from pagequarry.kernels import cmaps
from pagequarry.kernels.glyphnames import glyph_text

# Advance widths of the printable ASCII characters of the standard fonts, from space to tilde.
SANS = (
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556,
    556, 556, 556, 278, 278, 584, 584, 584, 556, 1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833,
    722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556, 333, 556, 556, 500, 556,
    556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334,
    260, 334, 584,
)
SANS_BOLD = (
    278, 333, 474, 556, 556, 889, 722, 238, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556,
    556, 556, 556, 333, 333, 584, 584, 584, 611, 975, 722, 722, 722, 722, 667, 611, 778, 722, 278, 556, 722, 611, 833,
    722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 333, 278, 333, 584, 556, 333, 556, 611, 556, 611,
    556, 333, 611, 611, 278, 278, 556, 278, 889, 611, 611, 611, 611, 389, 556, 333, 611, 556, 778, 556, 556, 500, 389,
    280, 389, 584,
)
SERIF = (
    250, 333, 408, 500, 500, 833, 778, 180, 333, 333, 500, 564, 250, 333, 250, 278, 500, 500, 500, 500, 500, 500, 500,
    500, 500, 500, 278, 278, 564, 564, 564, 444, 921, 722, 667, 667, 722, 611, 556, 722, 722, 333, 389, 722, 611, 889,
    722, 722, 556, 722, 667, 556, 611, 722, 722, 944, 722, 722, 611, 333, 278, 333, 469, 500, 333, 444, 500, 444, 500,
    444, 333, 500, 500, 278, 278, 500, 278, 778, 500, 500, 500, 500, 333, 389, 278, 500, 500, 722, 500, 500, 444, 480,
    200, 480, 541,
)
SERIF_BOLD = (
    250, 333, 555, 500, 500, 1000, 833, 278, 333, 333, 500, 570, 250, 333, 250, 278, 500, 500, 500, 500, 500, 500, 500,
    500, 500, 500, 333, 333, 570, 570, 570, 500, 930, 722, 667, 722, 722, 667, 611, 778, 778, 389, 500, 778, 667, 944,
    722, 778, 611, 778, 722, 556, 667, 722, 722, 1000, 722, 722, 667, 333, 278, 333, 581, 500, 333, 500, 556, 444, 556,
    444, 333, 500, 556, 278, 333, 556, 278, 833, 556, 500, 556, 556, 444, 389, 333, 556, 500, 722, 500, 500, 444, 394,
    220, 394, 520,
)
SERIF_ITALIC = (
    250, 333, 420, 500, 500, 833, 778, 214, 333, 333, 500, 675, 250, 333, 250, 278, 500, 500, 500, 500, 500, 500, 500,
    500, 500, 500, 333, 333, 675, 675, 675, 500, 920, 611, 611, 667, 722, 611, 611, 722, 722, 333, 444, 667, 556, 833,
    667, 722, 611, 722, 611, 500, 556, 722, 611, 833, 611, 556, 556, 389, 278, 389, 422, 500, 333, 500, 500, 444, 500,
    444, 278, 500, 500, 278, 278, 444, 278, 722, 500, 500, 500, 500, 389, 389, 278, 500, 444, 667, 444, 444, 389, 400,
    275, 400, 541,
)
# Widths of further characters in the sans, sans bold, serif, serif bold and serif italic fonts.
FURTHER = {
    "–": (556, 556, 500, 500, 500), "—": (1000, 1000, 1000, 1000, 889), "‘": (222, 278, 333, 333, 333), "’": (222, 278, 333, 333, 333),
    "“": (333, 500, 444, 500, 556), "”": (333, 500, 444, 500, 556), "•": (350, 350, 350, 350, 350), "…": (1000, 1000, 1000, 1000, 889),
    "€": (556, 556, 500, 500, 500), "ß": (611, 611, 500, 556, 500), "Æ": (1000, 1000, 889, 1000, 889), "æ": (889, 889, 667, 722, 667),
    "Ø": (778, 778, 722, 778, 722), "ø": (611, 611, 500, 500, 500), "«": (556, 556, 500, 500, 500), "»": (556, 556, 500, 500, 500),
    "¡": (333, 333, 333, 333, 389), "¿": (611, 611, 444, 500, 500), "§": (556, 556, 500, 500, 500), "°": (400, 400, 400, 400, 400),
}
TABLES = (SANS, SANS_BOLD, SERIF, SERIF_BOLD, SERIF_ITALIC)
FIXED_PITCH = 600.0
#: Strings whose glyphs a font keeps.
STRINGS = 20_000
#: Sizes of a simple font whose advances are kept.
SIZES = 8
SIMPLE_ENCODINGS = {"/WinAnsiEncoding": "cp1252", "/MacRomanEncoding": "mac_roman"}


def standard_width(base_font: str, char: str) -> float:
    """Width of a character in a standard font, by the font's name: an accented letter is as wide as its base letter."""
    if "Courier" in base_font:
        return FIXED_PITCH
    serif, bold, italic = "Times" in base_font, "Bold" in base_font, "Italic" in base_font
    column = (2 if not bold and not italic else 3 if bold else 4) if serif else int(bold)
    if char in FURTHER:
        return float(FURTHER[char][column])
    base = ord(unicodedata.normalize("NFD", char)[0]) if char else 0
    return float(TABLES[column][base - 32]) if 32 <= base < 127 else 556.0 if column < 2 else 500.0


class Plain:
    """Texts and advances by the codes of a simple font in one size."""

    def __init__(self, font: Font, size: float, scale: float, spread: float, gap: float) -> None:
        every = [font.glyphs(bytes([code]))[0] for code in range(256)]
        self.texts = [g[0] for g in every]
        self.table = "".join(self.texts) if all(len(t) == 1 and t != "\ufffe" for t in self.texts) else None
        self.advances = np.array([(g[2] * size * scale + spread + gap) if g[3] else g[2] * size * scale + spread for g in every])

    def of(self, raw: bytes) -> tuple[str | list[str], np.ndarray]:
        """Of each byte the text, as one string where every text is one character, and the advance."""
        texts = charmap_decode(raw, "strict", self.table)[0] if self.table else list(map(self.texts.__getitem__, raw))
        return texts, self.advances[np.frombuffer(raw, np.uint8)] if raw else np.zeros(0)


@dataclass
class Font:
    """What text showing needs of a font."""

    name: str = ""
    wide: bool = False
    widths: dict[int, float] = field(default_factory=dict)
    ranges: list[tuple[int, int, float]] = field(default_factory=list)  # of character ids with one width, sorted
    default: float | None = None
    codec: str = "cp1252"
    texts: dict[int, str] = field(default_factory=dict)
    unicode: cmaps.CMap | None = None
    encoding: cmaps.CMap | None = None
    codes: str | None = None  # text encoding of the codes of a predefined map
    vertical: bool = False
    down: dict[int, tuple[float, float | None, float]] = field(default_factory=dict)  # of ids: advance, and place of the horizontal origin
    down_ranges: list[tuple[int, int, tuple[float, float | None, float]]] = field(default_factory=list)
    down_default: tuple[float, float | None, float] = (-1000.0, None, 880.0)
    known: dict[tuple[int, int], tuple[str, int, float, bool]] = field(default_factory=dict)
    simple: list[tuple[str, int, float, bool] | None] = field(default_factory=lambda: [None] * 256)  # of one-byte codes
    strings: dict[tuple, tuple[list[str], list[float]]] = field(default_factory=dict)
    sizes: dict[tuple, Plain] = field(default_factory=dict)

    def plain(self, *given: float) -> Plain:
        """Texts and advances in a size, scale, spread and gap; of a few such sizes, and of simple fonts alone."""
        found = self.sizes.get(given)
        if found is None:
            if len(self.sizes) >= SIZES:
                self.sizes.clear()
            found = self.sizes[given] = Plain(self, *given)
        return found

    def advances(self, part: str, size: float, scale: float, spread: float, gap: float) -> tuple[list[str], list[float]]:
        """Texts and advances of the codes of a string operand; words met before are kept, up to ``STRINGS`` of them."""
        key = part, size, scale, spread, gap
        found = self.strings.get(key)
        if found is None:
            if len(self.strings) >= STRINGS:
                self.strings.clear()
            seen = self.glyphs(bytes.fromhex(part[2:]))
            found = self.strings[key] = [g[0] for g in seen], [(g[2] * size * scale + spread + gap) if g[3] else g[2] * size * scale + spread for g in seen]
        return found

    def glyphs(self, raw: bytes):
        """(text, character id, width / 1000, one-byte space) of each code of a string."""
        if not self.wide:
            return [self.simple[code] or self._glyph(1, code) for code in raw]
        if self.encoding:
            pairs = self.encoding.codes(raw)
        elif self.codes:
            pairs = cmaps.codec_codes(raw, self.codes)
        else:
            pairs = [(2, int.from_bytes(raw[i : i + 2], "big")) if i + 1 < len(raw) else (1, raw[i]) for i in range(0, len(raw), 2)]
        return [self.known.get(p) or self._glyph(*p) for p in pairs]

    def _glyph(self, n: int, code: int) -> tuple[str, int, float, bool]:
        cid = self.encoding.cid(n, code) if self.encoding else code
        text = self.unicode.text(n, code) if self.unicode and self.unicode.spaces else None
        if text is None and self.wide:  # without a map the text of an id is unknown
            text = code.to_bytes(n, "big").decode(self.codes, "replace") if self.codes else ""
        if text is None:
            text = self.texts.get(code)
        if text is None:
            text = bytes([code]).decode(self.codec, "replace")
        width = self.widths.get(cid)
        if width is None and self.ranges:
            i = bisect_right(self.ranges, (cid, 2**31))
            width = self.ranges[i - 1][2] if i and self.ranges[i - 1][1] >= cid else None
        if width is None:
            width = self.default
        if width is None:
            width = standard_width(self.name, self.texts.get(code) or bytes([code]).decode(self.codec, "replace"))
        self.known[n, code] = found = (text, cid, width / 1000, n == 1 and code == 32)
        if n == 1:
            self.simple[code] = found
        return found

    def downward(self, cid: int, width: float) -> tuple[float, float, float]:
        """Of a vertical font: the advance along y, and the place of the horizontal origin, in text units."""
        found = self.down.get(cid) or next((v for low, high, v in self.down_ranges if low <= cid <= high), self.down_default)
        advance, x, y = found
        return advance / 1000, width / 2 if x is None else x / 1000, y / 1000


def font_of(spec: dict, unicode_map: bytes | None, encoding_map: bytes | None = None, parents: tuple[bytes, ...] = (), procs: dict[str, float] | None = None) -> Font:
    """A font from its resolved dictionary and the decoded programs of its character maps.

    ``parents`` are the maps that the encoding map builds on, the furthest first; ``procs`` the widths that the
    procedures of a Type 3 font state, by glyph name.
    """
    f = Font(name=str(spec.get("BaseFont", ""))[1:], wide=spec.get("Subtype") == "/Type0")
    if f.wide and isinstance(spec.get("DescendantFonts"), list) and spec["DescendantFonts"]:
        kid = spec["DescendantFonts"][0]
        spec = spec | {k: kid[k] for k in ("W", "DW", "W2", "DW2") if isinstance(kid, dict) and k in kid}
    encoding = spec.get("Encoding")
    names: dict[int, str] = {}
    if isinstance(encoding, dict):
        at = 0
        for x in encoding.get("Differences", []):
            if isinstance(x, str):
                f.texts[at], names[at] = glyph_text(x[1:]), x[1:]
                at += 1
            else:
                at = int(x)
        encoding = encoding.get("BaseEncoding")
    f.codec = SIMPLE_ENCODINGS.get(encoding, "cp1252") if not isinstance(encoding, (list, dict)) else "cp1252"
    if f.wide:
        f.default = float(spec.get("DW", 1000))
        w, i = spec.get("W", []), 0
        while i + 1 < len(w):
            if isinstance(w[i + 1], list):
                f.widths |= {int(w[i]) + k: float(x) for k, x in enumerate(w[i + 1])}
                i += 2
            else:
                f.ranges.append((int(w[i]), int(w[i + 1]), float(w[i + 2])))
                i += 3
        f.ranges.sort()
        w, i = spec.get("W2", []), 0
        while i + 1 < len(w):
            if isinstance(w[i + 1], list):
                f.down |= {int(w[i]) + k: tuple(map(float, w[i + 1][3 * k : 3 * k + 3])) for k in range(len(w[i + 1]) // 3)}
                i += 2
            else:
                f.down_ranges.append((int(w[i]), int(w[i + 1]), tuple(map(float, w[i + 2 : i + 5]))))
                i += 5
        y, advance = spec.get("DW2", [880, -1000])
        f.down_default = float(advance), None, float(y)
        if encoding_map:
            f.encoding = cmaps.overlaid([cmaps.parse(p) for p in parents], cmaps.parse(encoding_map))
            f.vertical = f.encoding.vertical
        elif isinstance(spec.get("Encoding"), str):
            f.codes, f.vertical = cmaps.predefined_codec(spec["Encoding"][1:]), spec["Encoding"].endswith("-V")
    elif "Widths" in spec:  # its own table holds even outside its range
        f.default = 0.0
        first = int(spec.get("FirstChar", 0))
        f.widths = {first + k: float(x) for k, x in enumerate(spec["Widths"])}
    if spec.get("Subtype") == "/Type3":  # its widths are in the units of its own matrix, and its procedures' hold
        f.widths |= {code: procs[name] for code, name in names.items() if procs and name in procs}
        unit = float((spec.get("FontMatrix") or [0.001])[0]) * 1000
        f.widths = {code: w * unit for code, w in f.widths.items()}
        f.default = 0.0
    if unicode_map:
        f.unicode = cmaps.parse(unicode_map)
    return f
