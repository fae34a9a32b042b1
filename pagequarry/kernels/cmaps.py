"""Character maps: code spaces, code to character id, code to text. Ranges stay ranges, whatever their size.

Ranges may overlap, and a map may build on others: :func:`overlaid` lays them over
one another, the later ones above, as disjoint segments that bisection searches.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_right
from dataclasses import dataclass, field

_HEX = re.compile(rb"<([0-9A-Fa-f\s]*)>")


@dataclass
class CMap:
    """``spaces`` are (bytes, low, high); ranges are (bytes, low, high, target) in the order of the program, of which later ones win."""

    spaces: list[tuple[int, int, int]] = field(default_factory=list)
    cids: list[tuple[int, int, int, int]] = field(default_factory=list)
    texts: list[tuple[int, int, int, bytes | list[bytes]]] = field(default_factory=list)
    base: str = ""
    vertical: bool = False
    _flat: dict[str, list] = field(default_factory=dict)

    def _at(self, which: str, n: int, code: int):
        """The winning range that holds a code."""
        if which not in self._flat:
            self._flat[which] = flattened(getattr(self, which))
        segments = self._flat[which]
        i = bisect_right(segments, (n, code), key=lambda r: r[:2]) - 1
        return segments[i][3] if i >= 0 and segments[i][0] == n and segments[i][2] >= code else None

    def cid(self, n: int, code: int) -> int:
        """Character id of a code; 0 where nothing maps it."""
        r = self._at("cids", n, code)
        return r[3] + code - r[1] if r else 0

    def text(self, n: int, code: int) -> str | None:
        r = self._at("texts", n, code)
        if r is None:
            return None
        plus, raw = code - r[1], r[3]
        if isinstance(raw, list):
            if plus >= len(raw):
                return None
            raw, plus = raw[plus], 0
        if plus:
            raw = (int.from_bytes(raw, "big") + plus).to_bytes(len(raw) + 1, "big")[-len(raw) :]
        return raw.decode("utf-16-be", "replace")

    def codes(self, raw: bytes) -> list[tuple[int, int]]:
        """(bytes, code) of each code of a string by the code spaces, shortest first; a byte that begins none is dropped."""
        out, at = [], 0
        while at < len(raw):
            for n in range(1, 5):
                code = int.from_bytes(raw[at : at + n], "big")
                if at + n <= len(raw) and any(k == n and _inside(code, low, high, n) for k, low, high in self.spaces):
                    out.append((n, code))
                    at += n
                    break
            else:
                at += 1
        return out


def _inside(code: int, low: int, high: int, n: int) -> bool:
    """Each byte of a code within its own bounds."""
    return all((low >> s & 255) <= (code >> s & 255) <= (high >> s & 255) for s in range(0, 8 * n, 8))


def flattened(ranges: list) -> list[tuple[int, int, int, tuple]]:
    """Disjoint (bytes, low, high, range), sorted, of ranges of which later ones win."""
    out: list[tuple[int, int, int, tuple]] = []
    begins = sorted(range(len(ranges)), key=lambda k: ranges[k][:2])
    above: list[tuple[int, tuple]] = []  # ranges that have begun, the latest first
    at: tuple[int, int] = (0, 0)
    for k in [*begins, None]:
        start = ranges[k][:2] if k is not None else (5, 0)
        while above and at < start:
            r = above[0][1]
            if (r[0], r[2]) < at:
                heapq.heappop(above)
                continue
            low = max(at, r[:2])
            high = r[2] if start[0] > r[0] else min(r[2], start[1] - 1)
            if out and out[-1][3] is r and out[-1][2] + 1 == low[1]:
                out[-1] = (*out[-1][:2], high, r)
            elif high >= low[1]:
                out.append((r[0], low[1], high, r))
            at = (r[0], high + 1)
        if k is not None:
            heapq.heappush(above, (-k, ranges[k]))
            at = start
    return out


def overlaid(parents: list[CMap], own: CMap) -> CMap:
    """``own`` over its ``parents``, the furthest first."""
    maps = [*parents, own]
    return CMap(*[[x for m in maps for x in getattr(m, name)] for name in ("spaces", "cids", "texts")], own.base, own.vertical)


_SECTION = re.compile(rb"begin(codespacerange|cidchar|cidrange|bfchar|bfrange)(.*?)end\1", re.S)


def parse(data: bytes) -> CMap:
    """A character map from its program."""
    data = re.sub(rb"%[^\r\n]*", b"", data)
    out = CMap()

    def number(h: bytes) -> tuple[int, int]:
        h = re.sub(rb"\s", b"", h)
        return (len(h) + 1) // 2, int(h or b"0", 16)

    def raw(h: bytes) -> bytes:
        h = re.sub(rb"\s", b"", h)
        return bytes.fromhex((h + b"0" * (len(h) % 2)).decode())

    for kind, body in _SECTION.findall(data):
        h = _HEX.findall(body)
        if kind == b"codespacerange":
            out.spaces += [(*number(a), number(b)[1]) for a, b in zip(h[::2], h[1::2], strict=False)]
        elif kind == b"cidchar":
            out.cids += [(*number(a), number(a)[1], int(c)) for a, c in re.findall(rb"<([^>]*)>\s*(\d+)", body)]
        elif kind == b"cidrange":
            out.cids += [(*number(a), number(b)[1], int(c)) for a, b, c in re.findall(rb"<([^>]*)>\s*<([^>]*)>\s*(\d+)", body)]
        elif kind == b"bfchar":
            out.texts += [(*number(a), number(a)[1], raw(b)) for a, b in zip(h[::2], h[1::2], strict=False)]
        else:
            for a, b, c, many in re.findall(rb"<([^>]*)>\s*<([^>]*)>\s*(?:<([^>]*)>|\[([^\]]*)\])", body):
                out.texts.append((*number(a), number(b)[1], [raw(x) for x in _HEX.findall(many)] if many else raw(c)))
    used, mode = re.search(rb"/([^\s/]+)\s+usecmap", data), re.search(rb"/WMode\s+(\d)", data)
    out.base, out.vertical = used[1].decode("latin-1") if used else "", bool(mode) and mode[1] == b"1"
    return out


# Predefined maps by the beginning of their names, and the public text encodings of their codes.
PREDEFINED = {
    "GB-EUC": "gb2312", "GBK-EUC": "gbk", "GBKp-EUC": "gbk", "GBK2K": "gb18030", "UniGB-UCS2": "utf-16-be", "UniGB-UTF16": "utf-16-be",
    "B5pc": "big5", "ETen-B5": "cp950", "HKscs-B5": "big5hkscs", "UniCNS-UCS2": "utf-16-be", "UniCNS-UTF16": "utf-16-be",
    "90ms-RKSJ": "cp932", "90msp-RKSJ": "cp932", "90pv-RKSJ": "shift_jis", "83pv-RKSJ": "shift_jis", "EUC": "euc_jp", "UniJIS-UCS2": "utf-16-be", "UniJIS-UTF16": "utf-16-be",
    "KSC-EUC": "euc_kr", "KSCms-UHC": "cp949", "UniKS-UCS2": "utf-16-be", "UniKS-UTF16": "utf-16-be",
}


def predefined_codec(name: str) -> str | None:
    """The text encoding of a predefined map's codes; None for Identity and unknown maps."""
    stem = re.sub(r"(-HW)?-[HV]$", "", name)
    return PREDEFINED.get(stem)


def codec_codes(raw: bytes, codec: str) -> list[tuple[int, int]]:
    """(bytes, code) of a string in a text encoding: as few bytes as make a character, else one."""
    out, at = [], 0
    sizes = (2, 4) if codec == "utf-16-be" else (1, 2, 4)
    while at < len(raw):
        n = next((k for k in sizes if at + k <= len(raw) and _is_character(raw[at : at + k], codec)), 1)
        out.append((n, int.from_bytes(raw[at : at + n], "big")))
        at += n
    return out


def _is_character(raw: bytes, codec: str) -> bool:
    try:
        return len(raw.decode(codec)) == 1
    except UnicodeDecodeError:
        return False
