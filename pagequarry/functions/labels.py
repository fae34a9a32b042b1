"""Page label formatting as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Roman numerals with their worth, largest first.
ROMAN = (
    (1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"),
    (9, "ix"), (5, "v"), (4, "iv"), (1, "i"),
)


def roman(n: Column) -> Column:
    """Lower-case Roman numeral: each symbol as often as it fits in what larger ones left."""
    parts, rest = [], n
    for worth, symbol in ROMAN:
        parts.append(F.repeat(F.lit(symbol), F.floor(rest / worth).cast("int")))
        rest = F.pmod(rest, F.lit(worth))
    return F.concat(*parts)


def alpha(n: Column) -> Column:
    """Lower-case bijective base 26: a to z, aa, ab."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(7)),
        F.struct(n.cast("long").alias("n"), F.lit("").alias("s")),
        lambda acc, _: F.when(
            acc["n"] > 0,
            F.struct(
                F.floor((acc["n"] - 1) / 26).cast("long").alias("n"),
                F.concat(F.chr(F.lit(97) + F.pmod(acc["n"] - 1, F.lit(26))), acc["s"]).alias("s"),
            ),
        ).otherwise(acc),
        lambda acc: acc["s"],
    )


def page_label(style: Column, prefix: Column, start: Column, offset: Column) -> Column:
    """Label ``offset`` pages into a range; a start of 0 counts as 1, an unknown style gives the prefix alone."""
    n = F.when(start == 0, 1).otherwise(start) + offset
    number = (
        F.when(style == "D", n.cast("string"))
        .when(style == "R", F.upper(roman(n)))
        .when(style == "r", roman(n))
        .when(style == "A", F.upper(alpha(n)))
        .when(style == "a", alpha(n))
        .otherwise(F.lit(""))
    )
    return F.concat(F.coalesce(prefix, F.lit("")), number)
