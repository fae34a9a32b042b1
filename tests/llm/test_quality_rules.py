import re
from collections import Counter

from pagequarry.llm import quality_rules
from tests.llm import texts
from tests.llm.brute import W


def brute(text):
    text = text or ""
    words = re.findall(W, text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(W, x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


EXTRA = ["a b c d e f a b c d e g a b c d e", "x\nx\n\n x\nx", "# * | x", "a b c d e", "a b c d e f", "a a a a a a a"]


def test_counts_match_brute_force(spark):
    found = texts.rows() + [(500 + i, t, None, None, None, "b", "r", 1, 2) for i, t in enumerate(EXTRA)]
    for r in quality_rules.verdicts(texts.frame(spark, found)).collect():
        text = next(x[1] for x in found if x[0] == r.doc_id)
        n, chars, symbols, dup, repeat = brute(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat), text
        assert r.base_failed == (n < 10 or 100 * repeat > 20 * n)
        assert not (r.base_failed and r.kept)


def test_clean_prose_is_kept_and_junk_leaves(spark):
    clean = "The house stood by the river and the people of the town came to see it in the morning light."
    rows = [(1, clean), (2, clean.upper()), (3, " ".join(w + "###" for w in clean.split())), (4, "buy now " * 30), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in quality_rules.apply_rules(df).collect()] == [1]


def test_other_scripts_are_not_judged_by_latin_rules(spark):
    texts_of = [
        "Дом стоял у реки и жители города приходили посмотреть на него при утреннем свете каждый день",
        "หมู่บ้านเล็กริมแม่น้ำแห่งนี้มีชาวบ้าน อาศัย อยู่ มา นาน หลาย ร้อย ปี แล้ว และ ยัง คง อยู่",
        "xqv zzkt wrpl mnbv qqpl trzk vvbn plkj hgfd zxcv mnnb qwrt",
    ]
    df = spark.createDataFrame(list(enumerate(texts_of)), "doc_id long, text string")
    got = {r.doc_id: r.failed_rules for r in quality_rules.verdicts(df).collect()}
    assert got == {0: [], 1: [], 2: ["stop_word_ratio"]}


def test_long_text(spark):
    rng = __import__("random").Random(3)
    text = texts.prose(rng, "en", 60_000)
    row = quality_rules.verdicts(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    n, chars, symbols, dup, repeat = brute(text)
    assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (n, chars, symbols, dup, repeat)


def test_plan_has_no_python(spark):
    plan = quality_rules.verdicts(texts.frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(spark):
    assert quality_rules.verdicts(texts.frame(spark, [])).count() == 0

