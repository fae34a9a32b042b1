"""One page's content stream: operations, and the stack machine that places text, paths and images.

Order is the meaning here, so a page is folded in one call; everything after
this (lines, words, sections, sums) is relational.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Generator, Iterator, Sequence
from dataclasses import dataclass, field, replace
from itertools import accumulate

import numpy as np

from pagequarry.kernels import syntax
from pagequarry.kernels.fonts import Font, Plain
from pagequarry.kernels.syntax import WHITE, SyntaxIssue, Values

IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def times(m: tuple, n: tuple) -> tuple:
    """``n`` first, then ``m``."""
    return (
        m[0] * n[0] + m[2] * n[1], m[1] * n[0] + m[3] * n[1], m[0] * n[2] + m[2] * n[3], m[1] * n[2] + m[3] * n[3],
        m[0] * n[4] + m[2] * n[5] + m[4], m[1] * n[4] + m[3] * n[5] + m[5],
    )


def place(m: tuple, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


_GAP, _STOP = rb"[" + syntax._W + rb"]", rb"(?=[" + syntax._W + syntax._D + rb"]|\Z)"
_NUMBER = rb"([+-]?(?:\d+\.?\d*|\.\d+))"
#: The two commonest operations in one match each: a plain string shown, and a move.
_COMMON = re.compile(_GAP + rb"*(?:\(([^()\\]*)\)" + _GAP + rb"*Tj|" + _NUMBER + _GAP + rb"+" + _NUMBER + _GAP + rb"+Td)" + _STOP)
#: A plain string shown and the move behind it, and as many of both as follow each other.
_PAIR = re.compile(_GAP + rb"*\(([^()\\]*)\)" + _GAP + rb"*Tj" + _GAP + rb"+" + _NUMBER + _GAP + rb"+" + _NUMBER + _GAP + rb"+Td" + _STOP)
_PAIRS = re.compile(rb"(?:" + _PAIR.pattern.replace(rb"([^()\\]*)", rb"[^()\\]*").replace(_NUMBER, _NUMBER.replace(rb"([", rb"(?:[")) + rb")++")
#: The operation that such pairs are as a whole.
PAIRS = "TjTd"
_CONSTANTS = {b"true": True, b"false": False, b"null": None}


def operations(data: bytes, cuts: Sequence[int] = (), pairs: bool = False) -> Iterator[tuple[str, list, int]]:
    """(operator, operands, offset); an inline image is one operation ``BI`` with its dictionary and bytes.

    ``cuts`` are the offsets where further streams begin. Stray closing marks are
    skipped. Malformed syntax gives an operation ``error`` and ends its stream alone;
    operands may stand in the stream before their operator. With ``pairs`` plain strings that are shown, each with a move
    behind it, come as one operation ``PAIRS``, whose operands are (string, x, y) as they are written.
    """
    operands: list = []
    starts = [0, *cuts]
    for begin, end in zip(starts, [*starts[1:], len(data)], strict=True):
        operands = yield from _operations(data[begin:end] if len(starts) > 1 else data, begin, operands, pairs)


def _operations(data: bytes, base: int, operands: list, pairs: bool) -> Generator[tuple[str, list, int], None, list]:
    """Operations of one stream that begins at ``base``; returns the operands left over."""
    at, outer, match, common, several = 0, [], syntax.TOKEN.match, _COMMON.match, _PAIRS.match if pairs else None
    try:
        while True:
            while not operands and not outer and (m := several and several(data, at) or common(data, at)):
                begin, at = at, m.end()
                if m.lastindex is None:
                    yield PAIRS, _PAIR.findall(data, begin, at), base + begin
                elif m.lastindex == 1:
                    yield "Tj", ["s:" + m[1].hex()], base + at - 2
                else:
                    x, y = m[2], m[3]
                    yield "Td", [float(x) if b"." in x else int(x), float(y) if b"." in y else int(y)], base + at - 2
            m = match(data, at)
            i, at = m.lastindex, m.end()
            if i == syntax.WORD:
                word = m[i]
                if word in _CONSTANTS:
                    operands.append(_CONSTANTS[word])
                    continue
                if outer:  # an operator ends what was left open
                    operands, outer = outer[0], []
                if word == b"BI":
                    values = Values(data, at, references=False)
                    operands, at = _inline_image(values), values.at
                yield word.decode("latin-1"), operands, base + m.start(i)
                operands = []
            elif i == syntax.NUMBER:
                raw = m[i]
                operands.append(float(raw) if b"." in raw else int(raw))
            elif i == syntax.NAME:
                operands.append("/" + syntax.name_of(m[i]))
            elif i == syntax.PLAIN:
                operands.append("s:" + m[i].hex())
            elif i == syntax.STRING:
                raw, at = syntax.string_from(data, m.start(i))
                operands.append("s:" + raw.hex())
            elif i == syntax.HEX:
                operands.append("s:" + syntax.bytes_of_hex(m[i]).hex())
            elif i == syntax.OPEN:
                values = Values(data, m.start(i), references=False)
                operands.append(values.read())
                at = values.at
            elif i == syntax.MARK:
                if m[i] == b"[":
                    outer.append(operands)
                    operands = []
                elif m[i] == b"]" and outer:
                    outer[-1].append(operands)
                    operands = outer.pop()
            elif i is None:
                if at < len(data):
                    raise SyntaxIssue("unterminated hex string", at)
                return outer[0] if outer else operands
    except (SyntaxIssue, RecursionError) as e:
        yield "error", [str(e)], base + at
        return []


def _inline_image(values: Values) -> list:
    """Dictionary and bytes between BI, ID and EI."""
    spec, data = {}, values.data
    while (t := values.next_token()) and not (t[0] == "keyword" and t[1] == "ID"):
        if t[0] != "name":
            raise SyntaxIssue("inline image key", t[2])
        spec[t[1][1:]] = values.read()
    begin = end = values.at + 1
    while (end := data.find(b"EI", end)) >= 0:
        if data[end - 1 : end] in (b"\n", b"\r", b" ", b"\t") and (end + 2 >= len(data) or data[end + 2] in WHITE):
            break
        end += 2
    end = len(data) if end < 0 else end
    values.at = end + 2
    return [spec, "s:" + data[begin:end].rstrip(b"\r\n").hex()]


BLACK = ("DeviceGray", (0.0,), None)
#: Operators that set a colour of a fixed space, and the space's number of components.
DEVICE = {"G": ("DeviceGray", 1), "RG": ("DeviceRGB", 3), "K": ("DeviceCMYK", 4)}


@dataclass
class State:
    """What ``q`` saves. Colours are (space, components, pattern)."""

    ctm: tuple = IDENTITY
    font: str = ""
    size: float = 0.0
    char: float = 0.0
    word: float = 0.0
    scale: float = 1.0
    leading: float = 0.0
    rise: float = 0.0
    render: int = 0
    clips: int = 0
    width: float = 1.0
    cap: int = 0
    join: int = 0
    miter: float = 10.0
    dash: tuple = ()
    phase: float = 0.0
    flatness: float = 1.0
    intent: str = "RelativeColorimetric"
    stroke: tuple = BLACK
    fill: tuple = BLACK
    stroke_alpha: float = 1.0
    fill_alpha: float = 1.0
    blend: str = "Normal"
    soft_mask: str | None = None
    alpha_is_shape: bool = False
    knockout: bool = True
    overprint_stroke: bool = False
    overprint_fill: bool = False
    overprint_mode: int = 0
    halftone: str | None = None


@dataclass
class Form:
    """A form that ``Do`` can name: its own content, matrix and the scope of its resources."""

    scope: int
    content: bytes = b""
    matrix: tuple = IDENTITY
    group: bool = False


@dataclass
class Scope:
    """Resources by name: of the page (scope 0) or of a form."""

    fonts: dict[str, Font] = field(default_factory=dict)
    properties: dict = field(default_factory=dict)
    states: dict = field(default_factory=dict)
    forms: dict[str, Form] = field(default_factory=dict)
    images: set[str] = field(default_factory=set)


#: Parameters of an extended graphics state and the numbers they set.
STATE_KEYS = {"LW": "width", "LC": "cap", "LJ": "join", "ML": "miter", "FL": "flatness", "CA": "stroke_alpha", "ca": "fill_alpha"}
#: Parameters that are switches.
SWITCHES = {"AIS": "alpha_is_shape", "TK": "knockout", "OP": "overprint_stroke", "op": "overprint_fill"}
STATE_OPS = {"w": "width", "J": "cap", "j": "join", "M": "miter", "i": "flatness"}
TEXT_OPS = {"Tc": "char", "Tw": "word", "TL": "leading", "Ts": "rise"}


class Placed:
    """Shown text of whole pages as flat columns: of pages, of runs and, once :meth:`finish` is called, of glyphs; no object a run or glyph.

    Plain strings are kept as they are written until then, and their glyphs placed together.
    """

    #: Codes up to which a string's places are worked out beside those of others.
    SHORT = 64

    def __init__(self) -> None:
        self.pages: list[tuple[int, int]] = []
        self.page_ends: list[int] = []  # of runs
        self.seq, self.names, self.counts = [], [], []
        self.size, self.x, self.y = array("d"), array("d"), array("d")
        self.n_glyphs = 0
        self.parts: list[list] = []  # of glyphs: (texts, x, y, dx, dy), or a simple font in a size, its strings and the number of their first run

    def add(self, seq: int, shown: dict) -> None:
        """A run as the machine shows it."""
        self.seq.append(seq)
        self.names.append(shown["name"])
        for held, new in ((self.size, shown["size"]), (self.x, shown["x"]), (self.y, shown["y"])):
            held.append(new)
        glyphs = shown["glyphs"]
        self.counts.append(len(glyphs[0]))
        self.n_glyphs += len(glyphs[0])
        self.parts.append([None, glyphs])

    def add_plain(self, seq: int, name: str, size: float, font: Plain, raws: Sequence[bytes], xs: list[float], ys: list[float]) -> None:
        """Strings of a simple font, each a run, that are set from left to right."""
        if not self.parts or self.parts[-1][0] is not font:
            self.parts.append([font, [], len(self.seq)])
        self.parts[-1][1].extend(raws)
        self.seq += range(seq, seq + 2 * len(raws), 2)
        self.names += [name] * len(raws)
        self.size.fromlist([size] * len(raws))
        self.x.fromlist(xs)
        self.y.fromlist(ys)
        counts = list(map(len, raws))
        self.counts += counts
        self.n_glyphs += sum(counts)

    def end_page(self, doc_id: int, page_index: int) -> None:
        """What was added since the last page is that page's; one without text is none."""
        if len(self.seq) > (self.page_ends[-1] if self.page_ends else 0):
            self.pages.append((doc_id, page_index))
            self.page_ends.append(len(self.seq))

    def finish(self) -> Placed:
        """With the columns of runs and glyphs: ``size``, ``x``, ``y``, ``ends`` (of a run's glyphs), ``texts`` (of one character each a string), ``xs``, ``ys``, ``dxs`` and ``dys``."""
        self.size, self.x, self.y = (np.asarray(v) for v in (self.size, self.x, self.y))
        self.ends = np.cumsum(self.counts, dtype=np.int64)
        found = [self._placed(*part) if part[0] else part[1] for part in self.parts]
        self.parts = []
        single = all(type(f[0]) is str for f in found)
        self.texts = "".join([f[0] for f in found]) if single else [t for f in found for t in f[0]]
        self.xs, self.ys, self.dxs, self.dys = (np.concatenate([np.zeros(0), *[f[k] for f in found]]) for k in range(1, 5))
        return self

    def _placed(self, font: Plain, raws: list[bytes], first: int) -> tuple:
        """Texts and places of strings whose first one is run ``first``: each place is the last one and its advance, added one by one."""
        n = np.array(self.counts[first : first + len(raws)])
        x, codes = self.x[first : first + len(raws)], b"".join(raws)
        texts, advances = font.of(codes)
        begin = np.cumsum(n) - n
        xs = np.empty(len(codes))
        for low, high in ((1, 4), (5, 8), (9, 16), (17, self.SHORT)):
            own = np.nonzero((n >= low) & (n <= high))[0]
            if len(own):
                steps = np.zeros((len(own), high))
                within = np.arange(high) < n[own, None]
                at = (begin[own, None] + np.arange(high))[within]
                moved = np.zeros((len(own), high))
                moved[within] = advances[at]
                steps[:, 0], steps[:, 1:] = x[own], moved[:, :-1]
                xs[at] = np.add.accumulate(steps, axis=1)[within]
        for k in np.nonzero(n > self.SHORT)[0].tolist():
            xs[begin[k] : begin[k] + n[k]] = np.add.accumulate(np.append(x[k], advances[begin[k] : begin[k] + n[k] - 1]))
        return texts, xs, np.repeat(self.y[first : first + len(raws)], n), advances, np.zeros(len(codes))

    def said(self) -> list[str]:
        """The text of each run."""
        return spelled(self.texts, self.ends - np.diff(self.ends, prepend=0), self.ends)


def spelled(texts: str | list[str], begin: np.ndarray, end: np.ndarray) -> list[str]:
    """The texts from ``begin`` up to ``end``, as one each."""
    whole = texts if type(texts) is str else "".join(texts)
    if len(whole) != len(texts):  # some are of several characters, or of none
        at = np.append(0, np.cumsum([len(t) for t in texts]))
        begin, end = at[begin], at[end]
    return [whole[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]


@dataclass
class Machine:
    """Folds operations into text runs, paths, images, forms and marked points.

    With ``flatten`` forms are expanded in place: no row for themselves, their own
    matrix and resources, a cycle ends where it would close; and no tag rows.
    ``kinds`` and ``operators`` say which rows are wanted: others are not made, and
    without text among the kinds no glyph is placed. Errors always come. With ``placed`` text goes there and gives no rows.
    """

    fonts: dict[str, Font] = field(default_factory=dict)
    matrix: tuple = IDENTITY
    properties: dict = field(default_factory=dict)
    state: State = field(default_factory=State)
    scopes: dict[int, Scope] = field(default_factory=dict)
    flatten: bool = False
    kinds: frozenset[str] | None = None
    operators: frozenset[str] | None = None
    placed: Placed | None = None

    def __post_init__(self) -> None:
        self.scopes.setdefault(0, Scope(self.fonts, self.properties))
        self.seq = self.n_marks = 0

    def wants(self, kind: str, op: str) -> bool:
        return (self.kinds is None or kind in self.kinds) and (self.operators is None or op in self.operators)

    def run(self, data: bytes, cuts: Sequence[int] = (), scope: int = 0) -> Iterator[dict]:
        self.state = replace(self.state, ctm=self.matrix)
        yield from self._run(data, scope, (scope,) if scope else (), [], cuts)

    def _run(self, data: bytes, scope: int, path: tuple, outer: list, cuts: Sequence[int] = ()) -> Iterator[dict]:
        own = self.scopes.get(scope) or Scope()
        self.fonts = own.fonts
        stack, marked = [], []
        tm = line = IDENTITY
        segments: list[tuple[str, list[float]]] = []
        clip = False
        texts, paths = (self.kinds is None or k in self.kinds for k in ("text", "path"))
        seq = offset = 0

        def row(kind: str, **values) -> dict:
            return {"seq": seq, "kind": kind, "marked": [*outer, *marked], "offset": offset, "state": self.state, "scope": scope} | values

        for op, a, offset in operations(data, cuts, self.placed is not None):
            s = self.state
            seq, self.seq = self.seq, self.seq + 1
            try:
                if op == PAIRS:
                    self.seq += 2 * len(a) - 1
                    tm = line = self._show_pairs(a, tm, line, seq)
                elif op == "Td":
                    x, y = float(a[0]), float(a[1])
                    ta, tb, tc, td, e, f = line
                    tm = line = ta, tb, tc, td, ta * x + tc * y + e, tb * x + td * y + f
                elif op in ("'", '"', "Tj", "TJ", "T*"):
                    if op == '"':
                        s.word, s.char = float(a[0]), float(a[1])
                    if op in ("T*", "'", '"'):
                        tm = line = times(line, (1, 0, 0, 1, 0, -s.leading))
                    if op != "T*" and texts:
                        shown, tm = self._show(a[-1] if op == "TJ" else [a[-1]], tm)
                        if self.placed is not None:
                            self.placed.add(seq, shown)
                        elif self.wants("text", op):
                            yield row("text", **shown)
                elif op == "TD":
                    x, y = float(a[0]), float(a[1])
                    s.leading = -y
                    tm = line = times(line, (1, 0, 0, 1, x, y))
                elif op == "q":
                    stack.append(replace(s))
                elif op == "Q":
                    self.state = stack.pop() if stack else s
                elif op == "cm":
                    s.ctm = times(s.ctm, tuple(map(float, a[:6])))
                elif op in ("BT", "ET"):
                    tm = line = IDENTITY
                elif op == "Tf":
                    s.font, s.size = a[0][1:], float(a[1])
                elif op in TEXT_OPS:
                    setattr(s, TEXT_OPS[op], float(a[0]))
                elif op == "Tz":
                    s.scale = float(a[0]) / 100
                elif op == "Tr":
                    s.render = int(a[0])
                elif op == "Tm":
                    tm = line = tuple(map(float, a[:6]))
                elif op == "error":
                    yield row("error", error=a[0])
                elif op in ("m", "l", "c", "v", "y"):
                    segments.append((op, [float(x) for x in a]))
                elif op == "h":
                    if segments:
                        segments.append(("h", []))
                elif op == "re":
                    x, y, w, h = map(float, a[:4])
                    segments += [("m", [x, y]), ("l", [x + w, y]), ("l", [x + w, y + h]), ("l", [x, y + h]), ("h", [])]
                elif op in ("W", "W*"):
                    clip = True
                elif op in ("S", "s", "f", "F", "f*", "B", "B*", "b", "b*", "n"):
                    if op in ("s", "b", "b*") and segments:
                        segments.append(("h", []))
                    if op != "n" and segments and paths and self.wants("path", op):
                        yield row("path", **self._path(op, segments))
                    s.clips += clip
                    segments, clip = [], False
                elif op in ("BI", "Do"):
                    form = own.forms.get(a[0][1:]) if op == "Do" else None
                    if form and self.flatten:
                        if form.scope not in path:
                            self.state = replace(s, ctm=times(s.ctm, form.matrix))
                            if form.group:
                                self.state = replace(self.state, stroke_alpha=1.0, fill_alpha=1.0, blend="Normal", soft_mask=None)
                            yield from self._run(form.content, form.scope, (*path, form.scope), [*outer, *marked])
                            self.state, self.fonts = s, own.fonts
                        continue
                    name = "" if op == "BI" else a[0][1:]
                    kind = "image" if op == "BI" or name in own.images else "xobject"
                    if self.wants(kind, op) and not (self.flatten and kind == "xobject"):
                        yield row(kind, name=name, bbox=_bounds([place(s.ctm, x, y) for x in (0, 1) for y in (0, 1)]))
                elif op in ("BMC", "BDC", "MP", "DP"):
                    p = a[1] if len(a) > 1 else {}
                    p = own.properties.get(p[1:]) if isinstance(p, str) else p
                    if op in ("BDC", "DP") and not isinstance(p, dict):
                        continue  # invalid data: nothing is opened
                    self.n_marks += 1
                    mark = {"id": self.n_marks, "tag": a[0][1:], "mcid": (p or {}).get("MCID"), "actual": (p or {}).get("ActualText")}
                    if op in ("BMC", "BDC"):
                        marked.append(mark)
                    elif not self.flatten and self.wants("tag", op):
                        found = row("tag", name=mark["tag"])
                        found["marked"].append(mark)
                        yield found
                elif op == "EMC":
                    if marked:
                        marked.pop()
                elif op in STATE_OPS:
                    setattr(s, STATE_OPS[op], float(a[0]) if op in "wMi" else int(a[0]))
                elif op == "d":
                    s.dash, s.phase = tuple(map(float, a[0])), float(a[1])
                elif op == "ri":
                    s.intent = a[0][1:]
                elif op == "gs":
                    self._extended(own.states.get(a[0][1:]) or {})
                elif op.upper() in DEVICE:
                    space, n = DEVICE[op.upper()]
                    color = space, tuple(map(float, a[-n:])), None
                    s.stroke, s.fill = (color, s.fill) if op.isupper() else (s.stroke, color)
                elif op in ("CS", "cs"):
                    color = a[0][1:], (), None
                    s.stroke, s.fill = (color, s.fill) if op == "CS" else (s.stroke, color)
                elif op in ("SC", "SCN", "sc", "scn"):
                    space = (s.stroke if op[0] == "S" else s.fill)[0]
                    pattern = a.pop()[1:] if a and isinstance(a[-1], str) else None
                    color = space, tuple(map(float, a)), pattern
                    s.stroke, s.fill = (color, s.fill) if op[0] == "S" else (s.stroke, color)
            except (IndexError, TypeError, ValueError, KeyError, AttributeError):
                continue  # too few or wrong operands: no effect

    def _extended(self, values: dict) -> None:
        s = self.state
        for key, name in STATE_KEYS.items():
            if isinstance(values.get(key), (int, float)):
                setattr(s, name, type(getattr(s, name))(values[key]))
        if isinstance(values.get("D"), list):
            s.dash, s.phase = tuple(map(float, values["D"][0])), float(values["D"][1])
        mode = values.get("BM")
        mode = mode[0] if isinstance(mode, list) and mode else mode  # of several the first
        if isinstance(mode, str):
            s.blend = mode[1:]
        for key, name in SWITCHES.items():
            if isinstance(values.get(key), bool):
                setattr(s, name, values[key])
        if isinstance(values.get("OP"), bool) and "op" not in values:
            s.overprint_fill = values["OP"]
        if isinstance(values.get("OPM"), int):
            s.overprint_mode = values["OPM"]
        if "SMask" in values:
            mask = values["SMask"]
            s.soft_mask = mask.get("S", "/")[1:] if isinstance(mask, dict) else None
        if "HT" in values:
            tone = values["HT"]
            s.halftone = tone[1:] if isinstance(tone, str) else f"Type{tone.get('HalftoneType', '')}" if isinstance(tone, dict) else None

    def _show(self, parts: list, tm: tuple) -> tuple[dict, tuple]:
        s = self.state
        font = self.fonts.get(s.font) or Font()
        ca, cb, cc, cd, ce, cf = s.ctm
        ta, tb, tc, td, e, f = tm
        a, b, c, d = ca * ta + cc * tb, cb * ta + cd * tb, ca * tc + cc * td, cb * tc + cd * td
        lift_x, lift_y = c * s.rise, d * s.rise
        size, scale = s.size, s.scale
        spread, gap = s.char * scale, s.word * scale
        base_x, base_y = lift_x + ce, lift_y + cf
        upright = cb == cc == tb == tc == 0  # nothing turns or leans: a run keeps its height
        if upright and len(parts) == 1 and isinstance(parts[0], str) and not font.vertical:
            own, advances = font.advances(parts[0], size, scale, spread, gap)
            xs, y = [], cd * f + base_y
            for advance in advances:
                xs.append(ca * e + base_x)
                e = ta * advance + e
            n = len(xs)
            glyphs = own, xs, [y] * n, advances if a == 1 else [a * advance for advance in advances], [0.0] * n
            shown = {"name": s.font, "size": size * (c**2 + d**2) ** 0.5, "x": xs[0] if n else ca * e + base_x, "y": y, "glyphs": glyphs}
            return shown, (ta, tb, tc, td, e, f)
        texts, xs, ys, dxs, dys = glyphs = [], [], [], [], []
        add_text, add_x, add_y, add_dx, add_dy = texts.append, xs.append, ys.append, dxs.append, dys.append
        for part in parts:
            if isinstance(part, (int, float)):
                back = -part / 1000 * size * (1 if font.vertical else scale)
                e, f = (tc * back + e, td * back + f) if font.vertical else (ta * back + e, tb * back + f)
                continue
            if font.vertical:
                for text, cid, width, space in font.glyphs(bytes.fromhex(part[2:])):
                    advance, x, y = font.downward(cid, width)
                    advance = advance * size + s.char + (s.word if space else 0)
                    left, low = -x * size * scale, -y * size
                    add_text(text)
                    add_x(ca * e + cc * f + base_x + a * left + c * low)
                    add_y(cb * e + cd * f + base_y + b * left + d * low)
                    add_dx(c * advance)
                    add_dy(d * advance)
                    e, f = tc * advance + e, td * advance + f
                continue
            own, advances = font.advances(part, size, scale, spread, gap)
            texts += own
            for advance in advances:
                add_x(ca * e + cc * f + base_x)
                add_y(cb * e + cd * f + base_y)
                add_dx(a * advance)
                add_dy(b * advance)
                e, f = ta * advance + e, tb * advance + f
        if texts:
            x, y = xs[0], ys[0]
        else:
            x, y = ca * e + cc * f + base_x, cb * e + cd * f + base_y
        return {"name": s.font, "size": size * (c**2 + d**2) ** 0.5, "x": x, "y": y, "glyphs": glyphs}, (ta, tb, tc, td, e, f)

    def _show_pairs(self, pairs: list[tuple[bytes, bytes, bytes]], tm: tuple, line: tuple, seq: int) -> tuple:
        """Strings shown and moves, one after the other, into ``placed``; returns the matrix behind them."""
        s, held = self.state, self.placed
        font = self.fonts.get(s.font) or Font()
        (ca, cb, cc, cd, ce, cf), (ta, tb, tc, td, e, f) = s.ctm, tm
        if font.wide or tm[:4] != line[:4] or not (ca == ta == 1 and cb == cc == tb == tc == ce == 0):
            for raw, x, y in pairs:
                shown, _ = self._show(["s:" + raw.hex()], tm)
                held.add(seq, shown)
                x, y, seq = float(x), float(y), seq + 2
                ta, tb, tc, td, e, f = line
                tm = line = ta, tb, tc, td, ta * x + tc * y + e, tb * x + td * y + f
            return line
        known = font.plain(s.size, s.scale, s.char * s.scale, s.word * s.scale)
        raws, xs, ys = zip(*pairs, strict=True)
        base_y, (left, low) = cd * td * s.rise + cf, line[4:]
        lefts = list(accumulate(map(float, xs), initial=left))
        lows = [low] * len(lefts) if set(ys) == {b"0"} else [*accumulate([td * float(y) for y in ys], lambda low, y: y + low, initial=low)]
        heights = [cd * f + base_y, *[cd * low + base_y for low in lows[1:-1]]]
        held.add_plain(seq, s.font, s.size * ((cd * td) ** 2) ** 0.5, known, raws, [e, *lefts[1:-1]], heights)
        return ta, tb, tc, td, lefts[-1], lows[-1]

    def _path(self, op: str, segments: list) -> dict:
        points = [p[i : i + 2] for _, p in segments for i in range(0, len(p) - 1, 2)]
        box = _bounds(points)
        corners = [place(self.state.ctm, x, y) for x in (box[0], box[2]) for y in (box[1], box[3])]
        return {
            "name": op, "bbox": _bounds(corners), "stroke": op[0] in "SsBb", "fill": op[0] in "fFBb", "even_odd": op.endswith("*"),
            "segments": [{"op": o, "points": p} for o, p in segments],
        }


def _bounds(points: list) -> list[float]:
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return [min(xs), min(ys), max(xs), max(ys)]
