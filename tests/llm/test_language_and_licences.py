import random
import textwrap

import numpy as np

from pagequarry.llm import language_id, license_scan
from tests.llm import texts


def test_language_on_held_out_documents(spark):
    rng = random.Random(8)
    langs = list(texts.SYLLABLES)
    rows = [(i, texts.prose(rng, langs[i % 4], 60), langs[i % 4]) for i in range(240)]
    rows += [(900, None, "en"), (901, "", "en"), (902, "123 .. !!", "en"), (903, texts.prose(rng, "fr", 30), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    held = [r for r in rows[:240] if got[r[0]].held_out]
    assert 30 < len(held) < 90
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.95 * len(held)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert got[903].lang_pred == "fr" and all(0 <= r.score <= 1 for r in got.values())


def test_language_without_labels_and_empty(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert language_id.identify(df).first().lang_pred == "und"
    assert language_id.identify(df.limit(0)).count() == 0


def test_one_language_needs_no_duel(spark):
    df = spark.createDataFrame([(i, "some english text here", "en") for i in range(9)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id.identify(df).collect()} == {"en"}


def test_no_language_is_cut(spark):
    """More languages than any fixed table would hold, each with an alphabet of its own."""
    rng, rows = random.Random(4), []
    for k in range(70):
        letters = [chr(0x4E00 + 40 * k + j) for j in range(40)]
        rows += [(1000 * k + i, " ".join("".join(rng.choice(letters) for _ in range(4)) for _ in range(12)), f"l{k:02}") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    held = [r for r in rows if got[r[0]].held_out]
    assert len({r.lang_pred for r in got.values()}) == 70
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.95 * len(held)


def test_long_texts_repeats_and_clashing_columns(spark):
    rng = random.Random(9)
    rows = [(i, texts.prose(rng, ("en", "de")[i % 2], 40), ("en", "de")[i % 2]) for i in range(60)]
    rows += [(70, texts.prose(rng, "de", 40_000), None), (71, rows[0][1], None), (71, rows[0][1], None), (None, rows[1][1], "de")]
    df = spark.createDataFrame([(*r, "x", 1.0, 3) for r in rows], "doc_id long, text string, lang string, target string, place double, n int")
    found = language_id.identify(df).collect()
    got = {r.doc_id: r for r in found}
    assert len(found) == 64 and found[0].asDict().keys() == {"doc_id", "held_out", "lang_pred", "score"}
    assert got[70].lang_pred == "de" and got[71].lang_pred == "en" and not got[None].held_out
    assert len({(r.lang_pred, r.score) for r in found if r.doc_id == 71}) == 1


def test_families_match_a_plain_merge():
    rng = np.random.default_rng(3)
    means = np.abs(rng.normal(size=(11, 30)))
    unit = means / np.linalg.norm(means, axis=1, keepdims=True)
    groups = [[i] for i in range(11)]
    while len(groups) > 4:
        close = {(a, b): np.mean([unit[i] @ unit[j] for i in groups[a] for j in groups[b]]) for a in range(len(groups)) for b in range(a + 1, len(groups))}
        a, b = max(close, key=close.get)
        groups[a] += groups.pop(b)
    assert language_id.families(means) == sorted(sorted(g) for g in groups)


def test_licences(spark):
    rows = [
        (1, "words\nReleased under the MIT License.\nmore"),
        (2, "Licensed under CC BY-NC 4.0.\nThis work is licensed under the GNU General Public License, version 3."),
        (3, "Copyright (c) 2020 Jane Roe. All rights reserved."),
        (4, "a licence to thrill was not what they had in mind"),
        (5, None),
        (6, ""),
        (7, "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ]
    got = {r.doc_id: (r.n_candidates, r.licences, r.n_exact) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (1, "MIT", 1)
    assert got[2] == (2, "CC-BY-NC-4.0,GPL-3.0", 2)
    assert got[3][:2] == (1, "all-rights-reserved")
    assert got[4][:2] == (1, "") and got[5] == got[6] == (0, "", 0)
    assert got[7] == (1, "Apache-2.0-header", 1)
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_wrapped_and_embedded_licences(spark):
    def wrapped(name, mark, width=72):
        return "\n".join(mark + x for x in textwrap.wrap(license_scan.TEMPLATES[name], width))

    prose = "some quite ordinary words stand before and after this sentence of the page "
    rows = [(i, f"{prose}\n{wrapped(n, m)}\n{prose}") for i, (n, m) in enumerate([("MIT-text", ""), ("BSD-text", " * "), ("GPL-header", "# "), ("Apache-2.0-header", "// ")])]
    rows += [
        (10, prose * 3 + "Licensed under the Apache License, Version 2.0. " + prose * 3),
        (11, "Copyright (c) 2020 Jane Roe. All rights reserved. Released under the MIT License. " + prose + "Licensed under CC BY 4.0."),
        (12, "Permission is\n * hereby granted, " + license_scan.TEMPLATES["MIT-text"].split("granted, ")[1]),
        (13, prose + "the license of the software is not granted for redistribution and use by the public domain"),
        (15, "Copyright (c) 2020-2024 The Long Named Society of Friends\nof Letters Ltd. All rights\nreserved. " + prose),
        (14, "This work is licensed under the GNU Lesser\nGeneral Public License, version 3."),
    ]
    got = {r.doc_id: (r.licences, r.n_exact) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(4)] == [(n, 1) for n in ("MIT-text", "BSD-text", "GPL-header", "Apache-2.0-header")]
    assert got[10] == ("Apache-2.0", 1) and got[12] == ("MIT-text", 1) and got[13] == ("", 0) and got[14] == ("LGPL-3.0", 1)
    assert got[15][0] == "all-rights-reserved"
    assert got[11][0] == "all-rights-reserved,MIT,CC-BY-4.0"


def test_neighbours_and_identifiers():
    def names(text):
        return [n for n, _, _ in license_scan.licences(text)]

    assert names("MIT License\n\nCopyright (c) 2020 Ann Doe") == ["MIT-name"]
    assert names("// SPDX-License-Identifier: MIT\nint x;") == ["MIT-tag"]
    assert names("# SPDX-License-Identifier: GPL-2.0-or-later") == ["GPL-2.0-or-later-tag"] and names("SPDX-License-Identifier: Nobody-1.0") == []
    assert names("This is under the GNU Affero General Public License, version 3, and so licensed.") in (["AGPL-3.0"], [])
    assert names("This work is licensed under the GNU Affero General Public License, version 3.") == ["AGPL-3.0"]
    assert names("This work is licensed under the GNU Lesser General Public License, version 3.") == ["LGPL-3.0"]
    assert names("This work is licensed under the GNU General Public License, version 4.") == []
    assert names("Licensed under CC BY-NC-SA 4.0.") == [] and names("Licensed under the Apache License, Version 1.1.") == []
    assert names(license_scan.TEMPLATES["ISC-text"] + "\n\n" + license_scan.TEMPLATES["ISC-rest"]) == ["ISC-text", "ISC-rest"]
    long = "plain words of a page " * 20_000
    assert names(long + license_scan.TEMPLATES["Zlib-text"] + long) == ["Zlib-text"]
    assert names("Released under the MIT License. " * 3) == ["MIT"] * 3


def test_ranking_loses_nothing_that_wording_confirms():
    """Recall of the ranking against confirming every template at every licence word."""
    rng = np.random.default_rng(12)
    prose = "some quite ordinary words stand before and after this sentence of the page".split()
    met = kept = 0
    for name, text in license_scan.TEMPLATES.items():
        plain = text.replace("<year>", "2021").replace("<holder>", "Ann Doe")
        words = plain.split()
        changed = [w if rng.random() > 0.03 else "word" for w in words]
        mark = ("", " * ", "# ", "// ")[len(name) % 4]
        for variant in (plain, " ".join(changed), "\n".join(mark + x for x in textwrap.wrap(plain, 60)), " ".join([*rng.permutation(prose), plain, *rng.permutation(prose)])):
            every = license_scan.licences(variant, min_saved=-9.0, keep=10_000)
            own = license_scan.licences(variant)
            met += len(every)
            kept += len({n for n, _, _ in every} & {n for n, _, _ in own})
    assert met > 200 and kept >= 0.99 * met, (kept, met)
