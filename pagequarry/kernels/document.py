"""One document's bytes as rows: objects in source order, cross-reference sections and entries, and its state."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pagequarry.kernels import filters, syntax
from pagequarry.kernels.syntax import SyntaxIssue, Values

#: Keys whose references are followed where the bytes are read: how to decode a stream, and what a font consists of.
DECODE_KEYS = ("Filter", "F", "DecodeParms", "DP")
FONT_KEYS = ("Encoding", "Widths", "FirstChar", "DescendantFonts", "FontDescriptor", "CharProcs", "FontMatrix")
_TABLE = re.compile(rb"[\0\t\n\f\r ]*xref[\0\t\n\f\r ]+")
_RANGE = re.compile(rb"[\0\t\n\f\r ]*(\d+)[ ]+(\d+)[ ]*[\r\n]+")
_ENTRY = re.compile(rb"[\r\n ]*(\d{1,10}) +(\d{1,5}) +([nf])(?=[\r\n ])")
#: Entries as writers should make them, of twenty bytes each.
_LINE = re.compile(rb"(\d{10}) (\d{5}) ([nf])[ \r][\r\n]")
_START = re.compile(rb"startxref[\0\t\n\f\r ]+(\d+)")
_WHITE = re.compile(rb"[\0\t\n\f\r ]*")
_FREE, _PLAIN, _PACKED = range(3)
#: What a value begins with that ends by itself.
_OPENING = b"<", b"["
_json = json.JSONEncoder(check_circular=False).encode


def sections(data: bytes) -> list[dict]:
    """Cross-reference sections from the newest on: at, trailer and entries (obj, gen, kind, offset or container, index).

    A table's companion stream follows it. Anything malformed is a :class:`SyntaxIssue`.
    """
    last = data.rfind(b"startxref")
    start = _START.match(data, last) if last >= 0 else None
    if not start:
        raise SyntaxIssue("no startxref", max(last, 0))
    at, seen, out = int(start[1]), set(), []
    while at is not None:
        if at in seen:
            raise SyntaxIssue("cycle of cross-reference sections", at)
        seen.add(at)
        found = _table(data, at) if _TABLE.match(data, at) else _stream(data, at)
        out.append(found)
        companion = found["trailer"].get("XRefStm")
        if isinstance(companion, int):
            out.append(_stream(data, companion))
        at = found["trailer"].get("Prev")
        if at is not None and (not isinstance(at, int) or at <= 0):
            raise SyntaxIssue("invalid previous section", found["at"])
    return out


def _checked(section: dict) -> dict:
    size, known = section["trailer"].get("Size"), {e[0] for e in section["entries"]}
    if len(known) == len(section["entries"]) and not (isinstance(size, int) and known and max(known) >= size):
        return section
    known = set()
    for obj, *_ in section["entries"]:
        if isinstance(size, int) and obj >= size:
            raise SyntaxIssue(f"object {obj} is beyond the size", section["at"])
        if obj in known:
            raise SyntaxIssue(f"object {obj} is listed twice", section["at"])
        known.add(obj)
    return section


def _table(data: bytes, begin: int) -> dict:
    at, entries = _TABLE.match(data, begin).end(), []
    while part := _RANGE.match(data, at):
        first, n, at = int(part[1]), int(part[2]), part.end()
        lines = _LINE.findall(data, at, at + 20 * n)
        if len(lines) == n:  # they fill the bytes
            entries += [(first + k, int(gen), _PLAIN if kind == b"n" else _FREE, int(where), None) for k, (where, gen, kind) in enumerate(lines)]
            at += 20 * n
            n = 0
        for k in range(n):
            e = _ENTRY.match(data, at)
            if not e:
                raise SyntaxIssue("malformed cross-reference entry", at)
            entries.append((first + k, int(e[2]), _PLAIN if e[3] == b"n" else _FREE, int(e[1]), None))
            at = e.end()
        at = _WHITE.match(data, at).end()
    word = syntax.token(data, at)
    if not word or word[1] != "trailer":
        raise SyntaxIssue("no trailer", at)
    trailer = Values(data, word[3]).read()
    if not isinstance(trailer, dict):
        raise SyntaxIssue("trailer is no dictionary", word[3])
    return _checked({"at": begin, "trailer": trailer, "entries": entries})


def _stream(data: bytes, begin: int) -> dict:
    row = next(syntax.indirect_objects(data[begin:]), None)
    value = row["value"] if row else None
    if row is None or row["offset"] or not isinstance(value, dict) or value.get("Type") != "/XRef" or row["stream"] is None:
        raise SyntaxIssue("neither a cross-reference table nor a stream", begin)
    try:
        raw, (a, b, c) = filters.decode(row["stream"], value), value["W"]
        ranges = value["Index"] if "Index" in value else [0, value["Size"]]
        entries, at, whole = [], 0, int.from_bytes
        p, q, width = a, a + b, a + b + c
        for first, n in zip(ranges[::2], ranges[1::2], strict=True):
            for k in range(n):
                kind, y, z = (whole(raw[at : at + p], "big") if a else _PLAIN), whole(raw[at + p : at + q], "big"), whole(raw[at + q : at + width], "big")
                at += width
                if at > len(raw):
                    raise SyntaxIssue("cross-reference stream too short", begin)
                entries.append((first + k, 0, kind, y, z) if kind == _PACKED else (first + k, z, kind, y, None))
    except (ValueError, KeyError, TypeError) as e:
        raise e if isinstance(e, SyntaxIssue) else SyntaxIssue(f"cross-reference stream: {e}", begin) from e
    return _checked({"at": begin, "trailer": {k: v for k, v in value.items() if k not in (*DECODE_KEYS, "W", "Index", "Length", "Type")}, "entries": entries})


def resolved(value: object, of: dict[str, object], trail: tuple[str, ...] = ()) -> object:
    """``value`` with references followed, also inside lists and dictionaries; one that leads back to itself stays."""
    while isinstance(value, str) and value in of and value not in trail:
        value, trail = of[value], (*trail, value)
    if isinstance(value, list):
        return [resolved(v, of, trail) for v in value]
    if isinstance(value, dict):
        return {k: resolved(v, of, trail) for k, v in value.items()}
    return value


def content_refs(page: dict, of: dict[str, object]) -> list[str]:
    """References of a page's content streams, in order."""
    found, seen = page.get("Contents"), set()
    while isinstance(found, str) and isinstance(of.get(found), (list, str)) and found not in seen:
        seen.add(found)
        found = of[found]
    return [x for x in (found if isinstance(found, list) else [found]) if isinstance(x, str)]


def page_refs(trailer: dict, of: dict[str, object], scanned: list[str]) -> list[str]:
    """Pages in the order of their tree; without a readable root the page dictionaries as ``scanned``."""
    top = of.get(trailer.get("Root") or "")
    todo, seen, out = [top.get("Pages") if isinstance(top, dict) else None], set(), []
    while todo:
        at = todo.pop()
        node = of.get(at) if isinstance(at, str) else None
        if not isinstance(node, dict) or at in seen:
            continue
        kids = node.get("Kids")
        kids = of.get(kids) if isinstance(kids, str) else kids
        if isinstance(kids, list):
            seen.add(at)
            todo += reversed(kids)
        elif node.get("Type") == "/Page":
            out.append(at)
    return out or scanned


def members(container: dict, spec: dict) -> list[dict]:
    """Objects of an object stream; one row with the error if it is damaged."""
    base = {"gen": 0, "offset": container["offset"], "container": container["obj"], "stream": None, "value": None, "error": None}
    try:
        data = filters.decode(container["stream"], spec)
        first, n = int(spec["First"]), int(spec["N"])
        stated = data[: max(first, 0)].split()
        if len(stated) == 2 * n and all(map(bytes.isdigit, stated)):
            pairs = [(int(stated[k]), int(stated[k + 1])) for k in range(0, 2 * n, 2)]
        else:
            head = Values(data, references=False)
            pairs = [(head.read(), head.read()) for _ in range(n)]
        out = []
        ends = [*(at for _, at in pairs[1:]), len(data) - first]
        for i, ((n, at), after) in enumerate(zip(pairs, ends, strict=False)):
            begin, end = first + int(at), first + int(after)
            whole = data[begin : begin + 1] in _OPENING and syntax.simple(data, begin, end)
            found = syntax.shaped(data[begin:end]) if whole else None
            row = base | {"obj": int(n), "idx": i, "value": found[0] if found else Values(data, begin).read()}
            if found:
                row["text"] = found[1]
            out.append(row)
        return out
    except (ValueError, KeyError, TypeError, IndexError, AttributeError) as e:
        return [base | {"obj": container["obj"], "idx": None, "error": f"object stream: {e}"}]


def read(data: bytes, pages: frozenset[int] | None = None, kinds: frozenset[str] | None = None) -> Iterator[dict]:
    """Rows of kind object (source order), section, entry and one of kind document.

    An object is ``live`` if the newest entry of its number leads to it. Where an
    entry leads elsewhere the first declaration stands in (``repaired``). Without
    readable sections the document is recovered from the objects alone: the first
    declaration of a number and generation holds; ``error`` of the document row
    says what was wrong. ``shown`` marks the streams that pages show; with
    ``pages`` (numbers from 0) those of other pages alone are left out. With ``kinds``
    rows of others are not made.
    """
    rows = []
    of: dict[str, object] = {}
    for r in syntax.indirect_objects(data):
        r["container"] = r["idx"] = None
        r["ref"] = f"{r['obj']} {r['gen']} R"
        if not r["error"]:
            of.setdefault(r["ref"], r["value"])
        rows.append(r)
    listed = []
    for r in rows:
        listed.append(r)
        if r["stream"] is None:
            continue
        if isinstance(r["value"].get("Length"), str):  # a stated length may lie in another object
            length = resolved(r["value"]["Length"], of)
            begin = data.find(r["stream"], r["offset"]) if r["stream"] else -1
            if isinstance(length, int) and begin >= 0:
                r["stream"] = syntax.stream_bytes(data, begin, length)[0]
        if r["value"].get("Type") == "/ObjStm":
            for inner in members(r, resolved(r["value"], of)):
                inner["ref"] = f"{inner['obj']} {inner['gen']} R"
                listed.append(inner)
    for r in listed:
        if r["container"] is not None and not r["error"]:
            of.setdefault(r["ref"], r["value"])
    error, found = None, []
    try:
        found = sections(data)
        if not any("Root" in s["trailer"] for s in found):
            raise SyntaxIssue("no root", found[0]["at"])
    except (SyntaxIssue, RecursionError) as e:
        error, found = str(e), []
    live = recovered_rows(listed) if error else live_rows(listed, found)
    held = {}
    for r in listed:
        r["live"] = id(r) in live
        if r["live"]:
            of[r["ref"]] = value = r["value"]
            if isinstance(value, dict) and value.get("Type") == "/Page":
                held[r["ref"]] = value
    trailer: dict = {}
    for section in found:
        trailer = section["trailer"] | trailer
    trailer = trailer or scanned_trailer(data, listed)
    shown = {ref: content_refs(page, of) for ref, page in held.items()}
    contents = {x for refs in shown.values() for x in refs}
    if pages is not None:
        kept = {x for k, ref in enumerate(page_refs(trailer, of, list(held))) if k in pages for x in shown.get(ref, ())}
        for r in listed:
            if r["ref"] in contents and r["ref"] not in kept:
                r["stream"] = None
    for seq, r in enumerate(listed if kinds is None or "object" in kinds else ()):
        value = r["value"]
        keys = DECODE_KEYS if r["stream"] is not None else FONT_KEYS if isinstance(value, dict) and (value.get("Type") == "/Font" or "BaseFont" in value) else ()
        deep = {k: resolved(value[k], of) for k in keys if k in value}
        ref, text = r.pop("ref"), r.pop("text", None) or _json(value)
        r["kind"], r["seq"], r["repaired"], r["shown"] = "object", seq, live.get(id(r), False), r["live"] and ref in contents
        # where nothing is followed the text stays as it is
        r["value"], r["resolved"] = text, (text if all(value[k] == v for k, v in deep.items()) else _json(value | deep)) if deep else None
        yield r
    for rev, s in enumerate(found):
        if kinds is None or "section" in kinds:
            yield {"kind": "section", "seq": rev, "rev": rev, "offset": s["at"], "value": _json(s["trailer"])}
        for obj, gen, kind, where, idx in s["entries"] if kinds is None or "entry" in kinds else ():
            packed = kind == _PACKED
            yield {
                "kind": "entry", "rev": rev, "obj": obj, "gen": gen, "free": kind not in (_PLAIN, _PACKED), "offset": None if packed else where,
                "container": where if packed else None, "idx": idx,
            }
    if kinds is not None and "document" not in kinds:
        return
    version = re.search(rb"%PDF-(\d+\.\d+)", data)
    if not version:
        error = "no header" + (f"; {error}" if error else "")
    state = {"trailer": trailer, "version": version[1].decode() if version else None}
    yield {"kind": "document", "seq": 0, "value": _json(state), "error": error}


def scanned_trailer(data: bytes, rows: list[dict]) -> dict:
    """The last trailer behind the last object, else the dictionary of the last cross-reference stream."""
    at = data.rfind(b"trailer")
    if at >= max((r["offset"] for r in rows), default=0):
        try:
            value = Values(data, at + 7).read()
            if isinstance(value, dict):
                return value
        except SyntaxIssue:
            pass
    streams = [r["value"] for r in rows if isinstance(r["value"], dict) and r["value"].get("Type") == "/XRef"]
    return streams[-1] if streams else {}


def recovered_rows(rows: list[dict]) -> dict[int, bool]:
    """Identity of the live rows: first declaration of each number and generation, highest generation of a number."""
    first: dict[tuple[int, int], dict] = {}
    for packed in (False, True):
        for r in rows:
            if not r["error"] and (r["container"] is not None) == packed:
                first.setdefault((r["obj"], r["gen"]), r)
    best: dict[int, dict] = {}
    for (obj, gen), r in first.items():
        if obj not in best or gen > best[obj]["gen"]:
            best[obj] = r
    return {id(r): False for r in best.values()}


def live_rows(rows: list[dict], found: list[dict]) -> dict[int, bool]:
    """Identity of the rows that the newest entries lead to, and whether they had to be repaired."""
    newest: dict[tuple[int, int], tuple] = {}
    for s in found:
        for obj, gen, *where in s["entries"]:
            newest.setdefault((obj, gen), where)
    plain, packed = {}, {}
    declared: dict[tuple[int, int], dict] = {}
    for r in rows:
        if r["error"]:
            continue
        obj, gen, container = r["obj"], r["gen"], r["container"]
        if container is None:
            plain[obj, gen, r["offset"]] = r
        else:
            packed[obj, container, r["idx"]] = r
        declared.setdefault((obj, gen), r)
    live: dict[int, tuple[int, dict, bool]] = {}
    for (obj, gen), (kind, where, idx) in newest.items():
        if kind not in (_PLAIN, _PACKED):
            continue
        r = plain.get((obj, gen, where)) if kind == _PLAIN else packed.get((obj, where, idx))
        repaired = r is None
        r = r or declared.get((obj, gen))
        if r and (obj not in live or gen > live[obj][0]):
            live[obj] = gen, r, repaired
    return {id(r): repaired for _, r, repaired in live.values()}
