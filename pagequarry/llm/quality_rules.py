"""Quality rules: a threshold table compiled into one projection.

Each :class:`Rule` bounds one metric of a text. Metrics are native expressions
over the text, its words and its lines; :func:`verdicts` turns the whole table
into a single ``select`` with no user function, shuffle or second read.

The stop words are those of English, French, German and Spanish; a text in
another language of Latin script passes by the short words that it shares with
them. Letters include their combining marks.

Defined results: null or empty text has zero of everything and fails the base
rule; texts of any length are read whole; repeated rows are judged alike; extra columns pass through
:func:`apply_rules` untouched (working columns live in one struct, so no name
clashes); an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.exprs import SPACE, let, words

# Common function words of the covered languages.
STOP_WORDS = (
    "the", "and", "of", "to", "in", "is", "it", "that", "with", "for", "was", "on", "as", "are", "by", "this", "be",
    "at", "or", "from", "an", "a", "have", "not",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht",
    "ein", "eine", "als", "auch", "es", "er",
    "de", "la", "le", "et", "les", "du", "en", "un", "une", "que", "est", "pour", "qui", "dans", "par", "pas", "sur",
    "avec", "au",
    "el", "y", "los", "se", "del", "las", "por", "con", "no", "su", "para", "al", "lo", "como", "más",
)


@dataclass(frozen=True)
class Rule:
    """Keep a text if ``low <= metric <= high`` (an absent bound does not bind).

    A rule for Latin script leaves texts alone whose letters are mostly of others.
    """

    metric: str
    low: float | None = None
    high: float | None = None
    latin: bool = False


#: The production table. Ratios are of words or of lines, see :func:`metrics`.
DEFAULT_RULES = (
    Rule("n_words", low=10),
    Rule("repeat_word_ratio", high=0.20),
    Rule("mean_word_length", low=2.0, high=20.0, latin=True),
    Rule("symbol_word_ratio", high=0.30),
    Rule("letter_ratio", low=0.60),
    Rule("stop_word_ratio", low=0.01, latin=True),
    Rule("dup_line_ratio", high=0.50),
    Rule("bullet_line_ratio", high=0.90),
    Rule("upper_letter_ratio", high=0.60),
)


def repeated_words(ws: Column, width: int = 5) -> Column:
    """Words lying in ``width``-word windows that occur at least twice in the text.

    Windows are compared by 64-bit hash; only texts that have a repeated hash
    pay for sorting (hash, second hash, position) and adding up covered words.
    """

    def window(i: Column) -> list[Column]:  # element access: slice() would copy the whole array each time
        return [F.get(ws, i + k) for k in range(width)]

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(
            F.transform(hashes, lambda h, i: F.struct(h.alias("h"), F.hash(*window(i)).alias("g"), i.alias("i")))
        )

        def positions(xs: Column) -> Column:
            def same(x: Column, y: Column) -> Column:
                return F.coalesce((x["h"] == y["h"]) & (x["g"] == y["g"]), F.lit(False))

            return F.sort_array(
                F.transform(
                    F.filter(xs, lambda x, j: same(x, F.get(xs, j - 1)) | same(x, F.get(xs, j + 1))), lambda x: x["i"]
                )
            )

        return F.aggregate(
            let(ordered, positions),
            F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last")),
            lambda acc, p: F.struct((acc["n"] + F.least(F.lit(width), p - acc["last"])).alias("n"), p.alias("last")),
            lambda acc: acc["n"],
        )

    hashed = F.transform(F.sequence(F.lit(0), F.size(ws) - width), lambda i: F.xxhash64(*window(i)))
    return F.when(
        F.size(ws) > width,
        let(hashed, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(covered(hs))),
    ).otherwise(F.lit(0))


def metrics(text: Column) -> Column:
    """All counts and ratios of a text as one struct."""
    body = F.coalesce(text, F.lit(""))

    def count(ws: Column, keep) -> Column:
        return F.size(F.filter(ws, keep))

    def of_lines(ls: Column) -> Column:
        return F.struct(
            F.size(ls).alias("n_lines"),
            (F.size(ls) - F.size(F.array_distinct(ls))).alias("n_dup_lines"),
            count(ls, lambda x: x.rlike(rf"^[{SPACE}]*[-*•‣|]")).alias("n_bullet_lines"),
        )

    def of_words(ws: Column) -> Column:
        return let(F.array_join(ws, ""), lambda joined: of_chars(ws, joined))

    def of_chars(ws: Column, joined: Column) -> Column:
        return let(
            F.regexp_replace(joined, r"[\p{L}\p{M}]++", ""),
            lambda others: F.struct(
                F.size(ws).alias("n_words"),
                F.length(joined).alias("word_chars"),
                F.length(others).alias("n_other_chars"),
                F.length(F.regexp_replace(joined, r"[\p{IsLatin}\p{M}\P{L}]++", "")).alias("n_foreign_letters"),
                F.length(F.regexp_replace(others, r"[^#*$%&|<>]++", "")).alias("n_symbols"),
                F.length(F.regexp_replace(joined, r"\P{Lu}++", "")).alias("n_upper_chars"),
                repeated_words(ws).alias("n_repeat_words"),
                count(ws, lambda w: F.lower(w).isin(*STOP_WORDS)).alias("n_stop_words"),
            ),
        )

    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(rf"[^{SPACE}]"))
    return F.struct(let(words(body), of_words).alias("w"), let(lines, of_lines).alias("l"))


def ratios(m: Column) -> dict[str, Column]:
    """The metrics that rules can name, from the struct of :func:`metrics`."""
    chars = F.greatest(m["w"]["word_chars"], F.lit(1))
    n, lines = F.greatest(m["w"]["n_words"], F.lit(1)), F.greatest(m["l"]["n_lines"], F.lit(1))
    return {
        "n_words": m["w"]["n_words"].cast("double"),
        "mean_word_length": m["w"]["word_chars"] / n,
        "symbol_word_ratio": m["w"]["n_symbols"] / n,
        "repeat_word_ratio": m["w"]["n_repeat_words"] / n,
        "stop_word_ratio": m["w"]["n_stop_words"] / n,
        "letter_ratio": (m["w"]["word_chars"] - m["w"]["n_other_chars"]) / chars,
        "upper_letter_ratio": m["w"]["n_upper_chars"] / chars,
        "dup_line_ratio": m["l"]["n_dup_lines"] / lines,
        "bullet_line_ratio": m["l"]["n_bullet_lines"] / lines,
    }


def failed_rules(m: Column, rules: tuple[Rule, ...] = DEFAULT_RULES) -> Column:
    """Names of the rules a text breaks, in table order."""
    by_name, out = ratios(m), []
    letters = m["w"]["word_chars"] - m["w"]["n_other_chars"]
    foreign = 2 * m["w"]["n_foreign_letters"] > letters
    for r in rules:
        x = by_name[r.metric]
        broken = F.lit(False)
        if r.low is not None:
            broken = broken | (x < F.lit(float(r.low)))
        if r.high is not None:
            broken = broken | (x > F.lit(float(r.high)))
        broken = broken & ~foreign if r.latin else broken
        out.append(F.when(broken, F.lit(r.metric)))
    return F.array_compact(F.array(*out))


def verdicts(docs: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """doc_id, the base counts, ``base_failed``, ``failed_rules`` and ``kept`` for every row."""
    measured = docs.select("doc_id", metrics(F.col("text")).alias("m"))
    w, base = F.col("m.w"), F.col("base_failed")
    return measured.select(
        "doc_id",
        w["n_words"].cast("long").alias("n_words"),
        w["word_chars"].cast("long").alias("word_chars"),
        w["n_symbols"].cast("long").alias("n_symbols"),
        F.col("m.l.n_dup_lines").cast("long").alias("n_dup_lines"),
        w["n_repeat_words"].cast("long").alias("n_repeat_words"),
        ((w["n_words"] < 10) | (100 * w["n_repeat_words"] > 20 * w["n_words"])).alias("base_failed"),
        failed_rules(F.col("m"), rules).alias("failed_rules"),
    ).withColumn("kept", ~base & (F.size("failed_rules") == 0))


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """The rows whose text breaks no rule, with all their columns."""

    def good(x: Column) -> Column:
        failed = (x["w"]["n_words"] < 10) | (100 * x["w"]["n_repeat_words"] > 20 * x["w"]["n_words"])
        return ~failed & (F.size(failed_rules(x, rules)) == 0)

    return docs.where(let(metrics(F.col("text")), good))
