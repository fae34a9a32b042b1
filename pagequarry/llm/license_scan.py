"""Licence scan by conditional compression.

Candidates are a text's lines with a licence word. Each licence word, wherever
lines break, is laid over the places of the same word in every template, which
gives word windows of the template's length. A window is compressed alone and
with the template as a zstandard raw dictionary; the templates of a licence
word are ranked by the share of bytes they save. The best ``RANKED`` are
confirmed by exact wording: both word sequences are aligned, and a licence is
found if at least ``COVERED`` of the template's words occur in order, with the
differing words counted (a version or name that the template leaves open,
written ``<...>``, does not differ). A finding is refused if a word differs that
tells licences apart: a name word (``NAME_WORDS``: Affero, Lesser, NC, ...) that only
one side has, or a version number of the template that the text lacks. Of findings
that overlap the one with most equal and fewest differing words stays; all others
are reported. A template whose words are not near a licence word in sufficient number
cannot be confirmed and is not compressed.

Ranking (``RANKED`` templates a licence word, of a saved share of at least
``MIN_SAVED``) decides before the wording is looked at; against confirming every
template, it keeps all findings of the tests' wrapped, embedded, commented and
renamed notices.

Defined results: null and empty text have no licences; a line that matches no
template is counted in ``n_candidates`` only; of findings alike in every count
the first in the text stays; texts of any length, and lines of any length, are
read whole; repeated rows repeat their results; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LICENSE_WORDS = r"(?i)licen[sc]|copyright|\bspdx\b|warrant|permission is hereby|redistribution and use|public domain|creative commons|\bCC[ -]BY\b"
MIN_SAVED = 0.35
#: The same as they can stand across line breaks and comment signs.
ACROSS_LINES = LICENSE_WORDS.replace("permission is hereby", r"permission\W+is\W+hereby").replace("redistribution and use", r"redistribution\W+and\W+use").replace("public domain", r"public\W+domain").replace("creative commons", r"creative\W+commons").replace("CC[ -]BY", r"CC\W+BY")
RANKED = 3
COVERED = 0.9
#: Words beyond the window on either side that the alignment sees: share of the template, and number for each open place.
SLACK, OPEN_SLACK = 0.2, 8

#: Words that tell licences of like wording apart.
NAME_WORDS = frozenset(("affero", "lesser", "library", "nc", "nd", "sa", "by-nc", "by-nd", "by-sa", "by-nc-sa", "by-nc-nd", "by", "noncommercial", "noderivatives", "sharealike", "noncommercial-sharealike", "mit", "isc", "bsd", "apache", "mozilla", "eclipse", "boost"))
VERSION = re.compile(r"v?\d+(?:\.\d+)*")

# Identifiers of public licences, as they stand behind the tag of a file.
IDENTIFIERS = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0",
    "EUPL-1.2", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later",
    "MIT", "MPL-2.0", "Unlicense", "WTFPL", "Zlib",
)

# Customary licence notices and the texts of short licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0-rest": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT": "Released under the MIT License.",
    "MIT-title": "The MIT License (MIT)",
    "MIT-name": "MIT License Copyright (c) <year>",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "MIT-rest": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0BSD-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE",
    "ISC-rest": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS",
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-rest": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "EUPL-1.2": "Licensed under the EUPL, Version 1.2",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-4.0-name": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-name": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-name": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-ND-4.0-name": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC0-1.0": "Released into the public domain under CC0 1.0.",
    "all-rights-reserved": "Copyright (c) <year> <holder>. All rights reserved.",
} | {f"{name}-tag": f"SPDX-License-Identifier: {name}" for name in IDENTIFIERS}


def word_list(text: str) -> list[str]:
    """Words and numbers in lower case; open places keep their brackets."""
    return re.findall(r"<\w+>|[\w.+-]*\w", text.lower())


def anchors(words: list[str]) -> list[tuple[int, str]]:
    """Word number and kind of every licence word."""
    starts = np.cumsum([0, *(len(w) + 1 for w in words)])
    found = [(m.start(), m.group().lower().replace("licenc", "licens").replace("-", " ")) for m in re.finditer(LICENSE_WORDS, " ".join(words))]
    return [(int(np.searchsorted(starts, at, "right")) - 1, kind) for at, kind in found]


def name_words(words) -> set[str]:
    """Words that name a licence, also those between hyphens."""
    return {w for w in words if w in NAME_WORDS} | {p for w in words for p in w.split("-") if len(p) > 2 and p in NAME_WORDS}


@dataclass(frozen=True)
class Template:
    words: list[str]
    fixed: int
    places: dict[str, list[int]]  # of its licence words, by kind


@lru_cache(maxsize=1)
def templates() -> dict[str, Template]:
    out = {}
    for name, text in TEMPLATES.items():
        words, places = word_list(text), {}
        for at, kind in anchors(words):
            places.setdefault(kind, []).append(at)
        out[name] = Template(words, sum(not w.startswith("<") for w in words), places)
    return out


@lru_cache(maxsize=1)
def compressors() -> tuple:
    """The plain compressor and one per template."""
    import zstandard as z

    plain = z.ZstdCompressor(level=9, write_content_size=False)
    own = {
        name: z.ZstdCompressor(
            level=9,
            write_content_size=False,
            dict_data=z.ZstdCompressionDict(" ".join(t.words).encode(), dict_type=z.DICT_TYPE_RAWCONTENT),
        )
        for name, t in templates().items()
    }
    return plain, own


@lru_cache(maxsize=20_000)
def saved(text: str, name: str) -> float:
    """Share of a window's compressed size that the template saves."""
    plain, own = compressors()
    data = text.encode("utf-8", "surrogatepass")
    return 1 - len(own[name].compress(data)) / len(plain.compress(data))


def window(t: Template, words: list[str], start: int) -> list[str]:
    """As many words as the template has; what may stand at its open places is left out."""
    open_words = len(t.words) - t.fixed
    own = words[max(start, 0) : max(start + len(t.words) + OPEN_SLACK * open_words, 0)]
    return [w for w in own if w in t.words] if open_words else own


def reach(t: Template, words: list[str], start: int) -> tuple[int, int]:
    """Words that the alignment of a template at a place sees."""
    slack = max(2, math.ceil(SLACK * len(t.words))) + OPEN_SLACK * (len(t.words) - t.fixed)
    return max(0, start - slack), max(0, start + len(t.words) + slack)


def possible(t: Template, words: list[str], start: int) -> bool:
    """Whether enough of the template's words lie within reach to confirm it."""
    low, high = reach(t, words, start)
    near = set(words[low:high])
    return sum(w in near for w in t.words) >= COVERED * t.fixed


def ranked(words: list[str], at: int, kind: str, min_saved: float, keep: int) -> list[tuple[float, str, int]]:
    """(saved share, template, first word of its window) of the templates that save most at a licence word, best first."""
    best = []
    for name, t in templates().items():
        shares = [(saved(" ".join(window(t, words, at - p)), name), p - at) for p in t.places.get(kind, ()) if possible(t, words, at - p)]
        if shares:
            share, s = max(shares)
            best.append((share, name, -s))
    best.sort(key=lambda x: (-x[0], x[1]))
    return [x for x in best[:keep] if x[0] >= min_saved]


def aligned(t: Template, words: list[str], start: int) -> tuple[int, int, int, int, bool]:
    """First word, end, equal words and differing words of the template about a window, and whether what differs tells licences apart."""
    open_words = len(t.words) - t.fixed
    low, high = reach(t, words, start)
    found = [m for m in SequenceMatcher(None, t.words, words[low:high], autojunk=False).get_matching_blocks() if m.size]

    def stray(edge, inner) -> bool:
        """Whether an outer match costs more words between than it has."""
        first, second = sorted((edge, inner), key=lambda m: m.a)
        between, left_out = second.b - first.b - first.size, second.a - first.a - first.size
        return between - left_out - OPEN_SLACK * open_words > edge.size

    while len(found) > 1 and stray(found[0], found[1]):
        found.pop(0)
    while len(found) > 1 and stray(found[-1], found[-2]):
        found.pop()
    if not found:
        return start, start, 0, t.fixed, True
    same, first, end = sum(m.size for m in found), found[0].b, found[-1].b + found[-1].size
    matched = {m.a + k for m in found for k in range(m.size)}, {m.b + k for m in found for k in range(m.size)}
    missing = [w for k, w in enumerate(t.words) if k not in matched[0] and not w.startswith("<")]
    extra = [words[low + k] for k in range(first, end) if k not in matched[1]] if not open_words else []
    apart = bool(name_words(missing) or name_words(extra)) or any(VERSION.fullmatch(w) for w in missing)
    return low + first, low + end, same, t.fixed - same + max(0, end - first - same - open_words), apart


def licences(text: str, min_saved: float = MIN_SAVED, keep: int = RANKED) -> list[tuple[str, float, int]]:
    """(licence, saved share, differing words) of everything confirmed in a text, in its order."""
    words, found = word_list(text), {}
    for at, kind in anchors(words):
        for share, name, start in ranked(words, at, kind, min_saved, keep):
            t = templates()[name]
            first, end, same, differing, apart = aligned(t, words, start)
            if same >= COVERED * t.fixed and not apart:
                found[first, end, name] = max(found.get((first, end, name), ()), (same - 2 * differing, -differing, share))
    taken, firsts, out = [], [], []
    for (first, end, name), (_, less, share) in sorted(found.items(), key=lambda x: (*[-v for v in x[1]], x[0])):
        i = bisect.bisect(firsts, first)
        if (i == 0 or taken[i - 1] <= first) and (i == len(firsts) or end <= firsts[i]):
            firsts.insert(i, first), taken.insert(i, end), out.insert(i, (name, share, -less))
    return out


def scan(docs: DataFrame, min_saved: float = MIN_SAVED, keep: int = RANKED) -> DataFrame:
    """doc_id, n_candidates, licences (distinct names in order) and n_exact (findings without a differing word)."""
    lines = F.size(F.filter(F.split("text", "\n", -1), lambda x: x.rlike(LICENSE_WORDS)))
    n = F.when(F.col("text").rlike(LICENSE_WORDS), lines).otherwise(0)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [licences(x, min_saved, keep) if x else [] for x in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("n"),
                    pa.array([",".join(dict.fromkeys(n for n, _, _ in x)) for x in found]),
                    pa.array([sum(d == 0 for _, _, d in x) for x in found], pa.int64()),
                ],
                names=["doc_id", "n_candidates", "licences", "n_exact"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    body = F.when(F.col("text").rlike(ACROSS_LINES), F.col("text"))
    rows = docs.select("doc_id", F.coalesce(n, F.lit(0)).cast("long").alias("n"), body.alias("body"))
    return rows.mapInArrow(of, f"doc_id {kind}, n_candidates long, licences string, n_exact long")
