import math
import random
import re

import numpy as np

from pagequarry.llm import pii, secret_scan
from tests.llm import brute, texts


def random_texts(parts, seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


SECRET_PARTS = ["token", "Password", "api_key", "secret", ":", "=", " ", '"', "'", "abc", "deadbeef0123", "AKIA", "ABCDEFGH1234", "é", "\U0001f600", "ſecret", ".", "-", "\n", "7fQ2zLmP0aBcR4tY"]
PII_PARTS = ["a@b.co", "_", "@", "x", ".", "com", "1", "255", "256", "4111111111111111", " ", "-", "+", "(555)", "+1 ", "4567", "é", "\U0001f600", "4444 3333 2222 1111", "\n", "(at)", "1.2.3.4", "0007"]


def with_random(parts):
    more = [(1000 + i, t, None, None, None, "b", "r", 1, 2) for i, t in enumerate(random_texts(parts, 7, 150))]
    return texts.rows() + more


def test_secret_base_matches_brute_force(spark):
    found = with_random(SECRET_PARTS)
    got = {(r.doc_id): r for r in secret_scan.report(texts.frame(spark, found)).collect()}
    for r in found:
        base = brute.secret_base(r[1])
        row = got[r[0]]
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(b[2] == k for b in base) for k in ("assign", "access", "hex")]
        assert row.base_sha256 == brute.digest([f"{k}:{a}:{e}" for a, _, k, e in base])
        for a, _, k, e in base:
            assert f"{k}:{a}:{e}" in row.spans.split(",")


def test_entropy_finds_random_strings_and_leaves_words(spark):
    rows = [
        (1, "key x9Kq7fQ2zLmP0aBcR4tYx9Kq end"),
        (2, "thanandthionableinghereandthere"),
        (3, "4444-3333-2222-1111-4444-3333"),
        (4, "123e4567-e89b-12d3-a456-426614174000"),
        (5, "zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz1"),
        (6, "my-long-article-about-things-2024"),
    ]
    got = {r.doc_id: r.spans for r in secret_scan.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "entropy:4:28", 2: "", 3: "", 4: "", 5: "", 6: ""}


def test_secrets_are_masked_and_other_columns_stay(spark):
    df = secret_scan.mask(texts.frame(spark))
    assert df.columns == texts.frame(spark).columns
    text = df.where("doc_id = 70").first().text
    assert text.count("[SECRET]") == 3 and "f33e" not in text


def test_pii_base_matches_brute_force(spark):
    found = with_random(PII_PARTS)
    got = {r.doc_id: r for r in pii.report(texts.frame(spark, found)).collect()}
    for r in found:
        base = brute.pii_base(r[1])
        row = got[r[0]]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(b[2] == k for b in base) for k in ("email", "ip", "card", "phone")]
        assert row.base_sha256 == brute.digest([f"{k}:{a}:{e}" for _, a, k, e in base])


def test_pii_is_redacted_and_clashing_columns_stay(spark):
    df = texts.frame(spark)
    out = pii.redact(df)
    assert out.columns == df.columns and out.count() == df.count()
    row = out.where("doc_id = 69").first()
    assert re.fullmatch(r"mail \[EMAIL\] or \[PHONE\], card \[CARD\], host \[IP\]\.", row.text)
    assert row.n_chars == len(row.text) and row.base == "b" and row.row == "r"
    assert out.where("doc_id = 63").first().text is None


def test_long_runs_stay_linear(spark):
    rows = [(1, "1" * 100_000), (2, "a" * 100_000), (3, "1 " * 50_000), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert pii.report(df).count() == 4
    assert secret_scan.report(df).count() == 4


def test_long_texts_of_short_pieces_do_not_recurse(spark):
    """A million characters each; recursion once a piece would end the JVM."""
    n = 1_000_000
    parts = ["a1-", "word-", "ab/", "-", "_=", "a1-word_", "abc12+", "w/x-", "token=ab-", "1-", "a.", "AKIA-"]
    rows = [(i, (p * (n // len(p) + 1))[:n]) for i, p in enumerate(parts)]
    rows += [(100 + i, t + "7") for i, t in rows if t[0].isalnum()]
    rows += [(200 + i, t) for i, t in enumerate(random_texts(["a1-", "word-", "ab/", "9", "_", "zz", "abcdefg", "+", "="], 23, 200))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    known = dict(rows)
    got = {r.doc_id: r.spans for r in secret_scan.report(df).collect()}
    for i, spans in got.items():
        assert [s for s in spans.split(",") if s.startswith("entropy")] == entropy_brute(known[i]), known[i][:60]
    assert len(got) > 200


def test_empty_tables(spark):
    empty = texts.frame(spark, [])
    assert pii.report(empty).count() == pii.redact(empty).count() == secret_scan.report(empty).count() == 0


def test_spelled_addresses_and_local_numbers_are_redacted(spark):
    rows = []
    for i in range(160):
        line = (
            f"please write to jo.doe{i} [at] mail [dot] com today",
            f"phone: (555) 010-{1000 + i} in the morning",
            f"on 2021-03-{10 + i % 20} some {i} [at] x. y of it",
            f"rows 12345678901234567890{i} and 2020 10 11{i % 10} of the table",
        )[i % 4]
        rows.append((i, line))
    out = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for i, line in rows:
        want = ("please write to [SPELLED_EMAIL] today", "phone: [NUMBER_LIKE] in the morning", line, line)[i % 4]
        assert out[i] == want


def entropy_brute(text):
    """Spans of the entropy method, window by window and counted anew each time."""
    out = []
    base = brute.secret_base(text)
    for m in re.finditer(secret_scan.CANDIDATE, text or ""):
        if re.fullmatch("|".join(secret_scan.ALLOW_LIST), m[0]):
            continue
        for cls in secret_scan.DEFAULT_CLASSES:
            windows = [m[0][i : i + secret_scan.WINDOW] for i in range(len(m[0]) - secret_scan.WINDOW + 1)]
            own = [w for w in windows if all(c in cls.alphabet for c in w)]
            bits = [-sum(w.count(c) / len(w) * math.log2(w.count(c) / len(w)) for c in set(w)) for w in own]
            if max(bits, default=0) >= cls.bits - 1e-12:
                if not any(a < m.end() and m.start() < e for a, _, _, e in base):
                    out.append(f"entropy:{m.start()}:{m.end()}")
                break
    return out


def test_entropy_spans_match_brute_force(spark):
    parts = ["x9Kq7fQ2", "zLmP0aBc", "R4tY", "0a1B2c3D4e5F", "aaaa1111", "the-", "/", "=", "_", " ", ".", "\n", "é", "deadbeef", "0123456789", "token=", "Zz9"]
    found = [(i, t) for i, t in enumerate(random_texts(parts, 11, 300))] + [(900, None), (901, "x9Kq7fQ2zLmP0aBcR4tY" * 400)]
    for r in secret_scan.report(spark.createDataFrame(found, "doc_id long, text string").repartition(3)).collect():
        text = dict(found)[r.doc_id]
        assert [s for s in r.spans.split(",") if s.startswith("entropy")] == entropy_brute(text), text


def brute_candidates(text):
    """Candidates of every generator with their features, in plain Python."""
    out = []
    starts = re.compile(r"^\(\?:\\G\|\(\?<!\[[^]]*\]\)\)")  # where a match may start; without it the search finds the same
    patterns = [starts.sub("", p) for p in (pii.EMAIL, pii.SPELLED, pii.QUAD, pii.NUMBER)]
    assert not any("\\G" in p for p in patterns)
    base = brute.pii_base(text)
    for gen, pattern in enumerate(patterns):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            before = text[max(0, m.start() - pii.CONTEXT_CHARS) : m.start()].lower()
            around = (text[m.start() - 1] if m.start() else " ") + text[m.end() : m.end() + 1]
            context = next((code for code, words in pii.CONTEXT if re.search(words, before, re.A)), 0)
            parts = len([x for x in re.split(" +", m[0].translate(str.maketrans("().-", "    ")).strip(" "))])
            shape = 0
            if gen == 1:
                shape = bool(re.search(pii.LAST_LABEL, m[0])) + bool(re.search(pii.SPELLED_DOT, m[0]))
            if gen == 3:
                shape = 2 if 13 <= len(d) <= 19 and brute.luhn(d) else 1 if 7 <= len(d) <= 15 and not re.search(pii.DATE, m[0]) else 0
            n = len(d)
            out.append(
                {
                    "start": m.start(), "end": m.end(), "gen": gen, "digits": 0 if n < 8 else 1 if n < 13 else 2 if n < 16 else 3 if n == 16 else 4 if n < 20 else 5,
                    "luhn": int(gen == 3 and brute.luhn(d)), "octets": int(gen == 2 and all(int(p) <= 255 for p in m[0].split("."))), "plus": int(m[0].startswith("+")),
                    "parts": min(parts, 3) - 1, "glued": int(bool(re.search("[A-Za-z0-9]", around))), "context": context, "format": int(shape),
                    "shape": next((k for k, pattern in enumerate(pii.SHAPES, 1) if re.search(pattern, m[0])), 0) if gen == 3 else 0,
                    "confirmed": int(any(a < m.end() and m.start() < e for _, a, _, e in base)),
                }
            )
    return out


def test_candidates_and_accepted_spans_match_brute_force(spark):
    parts = ["mail ", "call ", "card ", "jo.doe", " [at] ", "(at)", " [dot] ", ".", "com", "x", "555", "-", " ", "010", "2000", "(555)", "2021-03-11", "4111111111111111", "+", "1.2.3.4", "a@b.co", ", "]
    rows = [(i, t) for i, t in enumerate(random_texts(parts, 5, 400))]
    rows += [(1000 + i, ("write to jo.doe [at] mail [dot] com", "phone 555-010-2000 today", "on 2021-03-11 at x [at] y. z")[i % 3]) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    redactor = pii.fit(df)
    got = {r.doc_id: r.cand or [] for r in pii.proposals(df).collect()}
    spans = {r.doc_id: r.spans for r in pii.report(df).collect()}
    assert redactor.thresholds
    for i, text in rows:
        want = brute_candidates(text)
        assert sorted(tuple(c[k] for k in want[0]) for c in got[i]) == sorted(tuple(c.values()) for c in want) if want else not got[i], text
        accepted = []
        for c in want:
            if not c["confirmed"] and c["gen"] in redactor.thresholds:
                margin = redactor.models[c["gen"]].margins({k: np.array([c[k]]) for k in pii.FEATURES})[0]
                if 1 / (1 + np.exp(-margin)) >= redactor.thresholds[c["gen"]] - 1e-9:
                    accepted.append((c["start"], -c["end"], c["gen"]))
        at, told = 0, []
        for a, e, gen in sorted(accepted):
            if a >= at:
                told.append(f"{pii.GENERATORS[gen]}:{a}:{-e}")
                at = -e
        assert [s for s in spans[i].split(",") if s.split(":")[0] in pii.GENERATORS] == sorted(told, key=lambda s: (pii.GENERATORS.index(s.split(":")[0]), int(s.split(":")[1]))), text


def planted_corpus(seed=3):
    """Texts with base phones, and some with what is to be found or left alone; (rows, {id: spans to find}, ids of look-alikes)."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(2, 8)))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    rows, find, alike = [], {}, set()

    def add(text, span=None, look=False):
        i = len(rows)
        left = " ".join(word() for _ in range(12))
        rows.append((i, f"{left} {text} " + " ".join(word() for _ in range(6))))
        if span:
            find[i] = (len(left) + 1 + text.index(span), len(left) + 1 + text.index(span) + len(span))
        if look:
            alike.add(i)

    for _ in range(400):
        add(f"+1 555 {digits(3)} {digits(4)}")
    for _ in range(12):
        add(f"Our order number 48{digits(8)} batch 77{digits(8)}", look=True)
    for _ in range(20):
        add(f"delivered on 20{rng.randint(10, 24)}-{rng.randint(10, 12)}-{rng.randint(10, 28)} with version {rng.randint(1, 9)}.{digits(2)}.{digits(3)}.{digits(4)} of it", look=True)
        add(f"part {digits(3)}-{digits(4)}-{digits(3)} and serial {digits(9)}", look=True)
    for _ in range(40):
        n = f"({digits(3)}) {digits(3)}-{digits(4)}"
        add(f"please call {n} in the morning", n)
        a = f"{word()}.{word()} [at] {word()} [dot] com"
        add(f"write to {a} today", a)
    return rows, find, alike


def test_planted_precision_and_recall_with_look_alikes(spark):
    rows, find, alike = planted_corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    added = {}
    for r in pii.report(df).collect():
        for s in filter(None, r.spans.split(",")):
            kind, a, e = s.split(":")
            if kind in pii.GENERATORS:
                added.setdefault(r.doc_id, []).append((int(a), int(e)))
    right = sum(any(a < high and low < e for a, e in added.get(i, ())) for i, (low, high) in find.items())
    n = sum(map(len, added.values()))
    assert right >= 0.9 * len(find) and right >= 0.9 * n, (right, len(find), n)
    assert not alike & set(added)


def test_order_numbers_among_many_phones_stay(spark):
    rows = [r for r in planted_corpus(5)[0] if r[0] < 412]  # base phones and order numbers only
    out = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        assert ("[PHONE]" in out[i]) == (i < 400) and (i < 400 or out[i] == text)


def test_share_and_threshold():
    p = np.array([0.05, 0.5, 0.95])
    assert pii.personal_share(p, np.array([1000.0, 0, 0]), 0.5) < 0.01
    assert pii.personal_share(p, np.array([0, 0, 500.0]), 0.5) > 0.99
    assert 0.25 < pii.personal_share(p, np.array([700.0, 0, 300.0]), 0.5) < 0.35
    neg, pos = np.array([900.0, 90, 1]), np.array([1.0, 90, 900])
    assert pii.threshold(p, neg, pos, 0.5) == 0.95 and pii.threshold(p, neg, pos, 0.001) is None
