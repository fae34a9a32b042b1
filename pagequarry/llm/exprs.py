"""Small native column helpers shared by the operators of this subpackage.

Everything here is a composition of built-in functions, so plans that use it
stay inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the word contracts: space and U+0009 to U+000D.
SPACE = r"\x20\x09-\x0D"
WORD_GAP = rf"[{SPACE}]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Maximal runs of non-space characters, in order; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP, -1), lambda w: w != "")


def prefix_sum(values: Column) -> Column:
    """Running totals of an integer array in O(n log n), by doubling strides."""

    def doubled(xs: Column) -> Column:
        rounds = F.when(F.size(xs) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(xs))).cast("int"))).otherwise(
            F.array().cast("array<int>")
        )
        return F.aggregate(
            rounds,
            xs,
            lambda acc, k: F.transform(
                acc, lambda v, i: v + F.coalesce(F.get(acc, i - F.expr("1").cast("int") * F.pow(F.lit(2), k).cast("int")), F.lit(0))
            ),
        )

    return let(values, doubled)


def match_spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start,end,m>>, in code points.

    Splitting gives the text between matches and ``regexp_extract_all`` the
    matches; adding up both lengths gives every position without scanning again.
    """
    empty = F.array().cast("array<struct<start:int,end:int,m:string>>")

    def located(ms: Column, gaps: Column) -> Column:
        ends = prefix_sum(F.transform(ms, lambda m, i: F.length(F.get(gaps, i)) + F.length(m)))
        return let(
            ends,
            lambda es: F.transform(
                ms,
                lambda m, i: F.struct(
                    (F.get(es, i) - F.length(m)).alias("start"), F.get(es, i).alias("end"), m.alias("m")
                ),
            ),
        )

    found = let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda ms: F.when(
            F.size(ms) > 0, let(F.split(text, pattern, -1), lambda gaps: located(ms, gaps))
        ).otherwise(empty),
    )
    return F.coalesce(found, empty)


def span_digest(spans: Column, kind_first: bool) -> Column:
    """``kind:start:end`` of array<struct<rank,kind,start,end>> joined by commas, in the contract's order."""
    key = ("rank", "start", "end", "kind") if kind_first else ("start", "rank", "end", "kind")
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(*[s[k].alias(k) for k in key])))
    return F.array_join(
        F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )
