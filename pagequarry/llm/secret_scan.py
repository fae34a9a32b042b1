"""Secret scan: fixed patterns plus sliding-window entropy, all in native expressions.

Kinds ``assign``, ``access`` and ``hex`` are pattern matches. The entropy method
adds kind ``entropy``: candidate strings (20 or more token characters) are read
once per character class with a window of 20 characters; a fold keeps the
sum of ``c * log2(c)`` over the window, changed only for the character that enters
and the one that leaves, and the counts of all symbols (an array as long as the
class's alphabet, which each step makes anew). A candidate whose
highest window entropy reaches its class's threshold is a span unless the allow
list suppresses it or a base span already covers it.

Defined results: null and empty text have no spans; texts of any length are read
whole; of matches that begin together the kinds' order decides, then the end;
repeated rows repeat their results; extra columns are ignored, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.exprs import let, match_spans, span_digest

ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # the maximal runs of 24 characters or more
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20

#: Candidates that are never secrets although they may look random. Loops over groups are possessive: the matcher then
#: counts them in place of recursing once a piece. No piece can end where another could, so this changes no match.
ALLOW_LIST = (
    r"[A-Za-z_=/+-]*",  # no digit: words and paths
    r"[0-9_=/+-]*",  # no letter: numbers
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUID
    r"[A-Za-z]++(?:[-_/][A-Za-z]++)*+[-_/]?[0-9]{1,4}",  # words with a number, as in slugs
    r"(?:[A-Za-z0-9]{1,6}+[-_/=+])*+[A-Za-z0-9]{1,6}",  # short pieces
)


@dataclass(frozen=True)
class CharClass:
    """Symbols counted together and the bits per symbol a window needs."""

    name: str
    alphabet: str
    bits: float


DEFAULT_CLASSES = (
    CharClass("hex", "0123456789abcdefABCDEF", 3.0),
    CharClass("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_=", 3.7),
)


def max_window_entropy(candidate: Column, cls: CharClass, window: int = WINDOW) -> Column:
    """Highest Shannon entropy of any full window that holds only symbols of the class, else 0."""
    zeros = F.array_repeat(F.lit(0), len(cls.alphabet) + 1)

    def clog(c: Column) -> Column:
        return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))

    def fold(codes: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            enter, leave = F.get(codes, i), F.coalesce(F.get(codes, i - window), F.lit(-1))
            full = i >= window - 1

            def with_counts(e: Column) -> Column:
                """e: counts of the entering and of the leaving symbol before the step."""
                change = F.when(enter == leave, F.lit(0.0)).otherwise(
                    clog(e[0] + 1) - clog(e[0]) + F.when(leave >= 0, clog(e[1] - 1) - clog(e[1])).otherwise(F.lit(0.0))
                )
                total = acc["sum"] + change
                counts = F.transform(
                    acc["counts"],
                    lambda c, j: c + F.when(j == enter, 1).otherwise(0) - F.when(j == leave, 1).otherwise(0),
                )
                return let(
                    counts,
                    lambda cs: F.struct(
                        cs.alias("counts"),
                        total.alias("sum"),
                        F.when(
                            full & (F.get(cs, F.lit(0)) == 0),
                            F.greatest(acc["best"], F.log2(F.lit(float(window))) - total / F.lit(float(window))),
                        )
                        .otherwise(acc["best"])
                        .alias("best"),
                    ),
                )

            before = F.array(F.get(acc["counts"], enter), F.coalesce(F.get(acc["counts"], leave), F.lit(0)))
            return let(before, with_counts)

        return F.aggregate(
            F.sequence(F.lit(0), F.size(codes) - 1),
            F.struct(zeros.alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best")),
            step,
            lambda acc: acc["best"],
        )

    codes = F.transform(F.split(candidate, ""), lambda ch: F.instr(F.lit(cls.alphabet), ch))
    return let(codes, fold)


def allowed(candidate: Column, allow_list: tuple[str, ...] = ALLOW_LIST) -> Column:
    return candidate.rlike("^(?:" + "|".join(allow_list) + ")$")


def entropy_spans(text: Column, classes=DEFAULT_CLASSES, allow_list=ALLOW_LIST) -> Column:
    """Spans of high-entropy candidates outside the allow list."""
    likely = F.filter(match_spans(text, CANDIDATE), lambda s: ~allowed(s["m"], allow_list))

    def random(s: Column) -> Column:
        out = F.lit(False)
        for cls in classes:
            out = out | (max_window_entropy(s["m"], cls) >= F.lit(cls.bits))
        return out

    return F.filter(likely, random)


def spans(text: Column) -> tuple[Column, Column]:
    """(base spans, spans that the entropy method adds), of struct<rank,kind,start,end>."""
    body = F.coalesce(text, F.lit(""))

    def tagged(xs: Column, rank: int, kind: str) -> Column:
        return F.transform(
            xs, lambda s: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
        )

    assign = F.filter(match_spans(body, ASSIGN), lambda s: F.length(F.regexp_extract(s["m"], ASSIGN, 1)) >= 6)
    access = F.filter(match_spans(body, ACCESS), lambda s: F.length(s["m"]) >= 20)
    base = F.concat(tagged(assign, 0, "assign"), tagged(access, 1, "access"), tagged(match_spans(body, HEX), 2, "hex"))
    return base, tagged(entropy_spans(body), 3, "entropy")


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, base and added span arrays."""
    base, added = spans(F.col("text"))
    found = docs.select("doc_id", base.alias("base"), added.alias("added"))

    def uncovered(a: Column) -> Column:
        return ~F.exists("base", lambda b: (b["start"] < a["end"]) & (a["start"] < b["end"]))

    return found.withColumn("added", F.when(F.size("added") > 0, F.filter("added", uncovered)).otherwise(F.col("added")))


def report(docs: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scan(docs).select(
        "doc_id",
        *[count(k) for k in ("assign", "access", "hex")],
        F.sha2(span_digest(F.col("base"), kind_first=False).cast("binary"), 256).alias("base_sha256"),
        span_digest(F.concat("base", "added"), kind_first=False).alias("spans"),
    )


def mask(docs: DataFrame, token: str = "[SECRET]") -> DataFrame:
    """Documents with every span replaced; all other columns stay."""
    base, added = spans(F.col("text"))
    return docs.withColumn("text", replace_spans(F.col("text"), F.concat(base, added), lambda s: F.lit(token)))


def replace_spans(text: Column, found: Column, token) -> Column:
    """``text`` with the union of the spans replaced; overlapping spans give one token, of the first."""
    ordered = F.sort_array(
        F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank"), s["kind"].alias("kind")))
    )

    def rebuilt(ss: Column) -> Column:
        pieces = F.aggregate(
            ss,
            F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at")),
            lambda acc, s: F.when(
                s["start"] >= acc["at"],
                F.struct(
                    F.concat(acc["out"], F.array(text.substr(acc["at"] + 1, s["start"] - acc["at"]), token(s))).alias("out"),
                    s["end"].alias("at"),
                ),
            ).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))),
        )
        return let(pieces, lambda p: F.concat(F.array_join(p["out"], ""), text.substr(p["at"] + 1, F.length(text))))

    return let(ordered, lambda ss: F.when(F.size(ss) > 0, rebuilt(ss)).otherwise(text))
