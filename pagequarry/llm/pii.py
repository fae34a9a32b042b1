"""Personal data: candidate generators, boosted trees and calibrated thresholds, all native.

Base kinds (``email ip card phone``) are patterns with exact checks and always
stay. High-recall generators propose overlapping candidates (addresses,
spelled-out addresses, dotted quads, digit groups); each gets format and
context features. Boosted trees, one model a generator, learn from evidence whose
labels they cannot see (:func:`evidence`): in the contexts of at most ``SAMPLE``
documents, base spans of those documents rewritten so that no base pattern finds
them, and planted phrases, are positive; planted dates, versions, order, part and
other numbers are negative. What share of a generator's *unconfirmed* candidates of
the whole table is personal is estimated by expectation-maximisation over their
scores, and its threshold is the lowest score at which held-out evidence, weighted
to that share and with its false positives counted half a case too many, reaches
``PRECISION``. A generator with too little evidence, or whose candidates cannot
reach it, adds none.
Candidates above them that touch no base span are added, leftmost first.

The driver sees one row per distinct feature vector (for the evidence, by fold and
label): at most ``MAX_FEATURE_ROWS``, the product of the feature cardinalities.

Defined results: null and empty text have no spans; a table without candidates
fits no model and adds none; texts of any length are read whole; of accepted
candidates that overlap the leftmost stays, then the longest, then the first
generator's; repeated rows repeat their results; extra columns are kept by
:func:`redact` and ignored by :func:`report`, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm import boosting
from pagequarry.llm.exprs import let, match_spans, span_digest
from pagequarry.llm.secret_scan import replace_spans
from pagequarry.llm.store import written

# The contract's patterns. A match can only start at the start of a run or where the last match ended, and runs are
# taken whole (possessively); this changes no match and keeps long runs linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
QUAD = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Further generators.
SPELLED = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?[\[(](?i:at)[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(](?i:dot)[\])])\x20?[A-Za-z0-9-]++)++"
NUMBER = r"\+?\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+"

# Formats that speak for a candidate: a domain's last label, a spelled-out dot, a number that is no date.
LAST_LABEL = r"(?:\.|[\])]\x20?)[A-Za-z]{2,}$"
SPELLED_DOT = r"(?i)[\[(]dot[\])]"
DATE = r"^\(?(?:19|20)[0-9]{2}[-.\x20][0-9]{1,2}[-.\x20][0-9]{1,2}\b|\b[0-9]{1,2}[-.\x20][0-9]{1,2}[-.\x20](?:19|20)[0-9]{2}$|^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"

KINDS = ("email", "ip", "card", "phone")
GENERATORS = ("email_like", "spelled_email", "ip_like", "number_like")
#: Context words looked for in the 40 characters before a candidate.
CONTEXT = (
    (1, r"e-?mail|contact|write to|correo|courriel"),
    (2, r"phone|\btel\b|\bcall\b|\bmobile\b|\bfax\b|\btél|\btelefon|\bteléfono"),
    (3, r"card|visa|credit|iban|account|karte|carte|tarjeta"),
    (4, r"\bip\b|host|server|address"),
    (5, r"order|batch|invoice|version|release|\bparts?\b|\bref|isbn|serial|\brows?\b|\bpages?\b|\bno\.|\bdated?\b"),
)
#: Cardinality of each feature; their product bounds what the driver collects.
FEATURES = {"gen": 4, "digits": 6, "luhn": 2, "octets": 2, "plus": 2, "parts": 3, "glued": 2, "context": 6, "format": 3, "shape": 6}
MAX_FEATURE_ROWS = int(np.prod(list(FEATURES.values())))
PRECISION = 0.95
CONTEXT_CHARS = 40
#: Documents whose contexts and base spans make the evidence, and the least cases of either label on either fold.
SAMPLE, LEAST_EVIDENCE = 300, 20

# How the digits of a number are grouped, from 1.
SHAPES = (DATE, r"^\+?[0-9]+$", r"^\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}$", r"^0[0-9](?:[\x20.-][0-9]{2}){4}$", r"^[0-9]{4}(?:[\x20-][0-9]{3,4}){2,3}$")

#: Evidence: (label, words before, form); every ``#`` becomes a digit.
PLANTED = tuple(
    (label, before, form)
    for label, befores, forms in (
        (1, ("phone ", "please call ", "tel. ", "mobile: ", "fax ", "teléfono ", ""), ("(###) ###-####", "###-###-####", "###.###.####", "0# ## ## ## ##", "(###) ###-#### ")),
        (1, ("phone: ", "call me on "), ("##########", "### ####", "#### ######", "###-####")),
        (1, ("mail ", "contact ", "write to ", "correo: ", ""), ("jo.doe# [at] mail [dot] com", "a.b(at)post#.org", "team# [at] firm.de", "x_y (at) site (dot) net")),
        (0, ("our order number ", "batch ", "invoice no. ", "part ", "ref. ", "serial ", "rows ", "page ", ""), ("##########", "########", "############", "### #### ###", "##-####-##", "#### ## ###", "######-####", "####################")),
        (0, ("order number ", "part no. ", "serial "), ("###-###-####", "#### #### ####", "(###) ###-####")),
        (0, ("on ", "dated ", ""), ("2021-03-1#", "1#.04.2019", "2020 10 11", "1999-1#-0# 12", "19##.0#.1#")),
        (0, ("version ", "release ", "ISBN ", ""), ("#.##.###.####", "300.#.##.#", "978-#-##-######-#", "10.#.#.999")),
        (0, ("some ", "we met ", ""), ("# [at] x. y", "a (at) b. c", "n# [at] n. m")),
    )
    for before in befores
    for form in forms
)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check of its last digit."""
    doubled = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: let(
            d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v)
        ),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + v) % 10 == 0


def only_digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def octets_ok(m: Column) -> Column:
    """Every part of a dotted quad is at most 255, however many zeros lead it."""
    return F.forall(F.split(m, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) < 4) & F.forall(
        F.split(m, r"\."), lambda p: F.coalesce(F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int"), F.lit(0)) <= 255
    )


def base_spans(text: Column) -> Column:
    """Base spans as array<struct<rank,kind,start,end>>."""

    def tagged(xs: Column, rank: int) -> Column:
        return F.transform(
            xs,
            lambda s: F.struct(
                F.lit(rank).alias("rank"), F.lit(KINDS[rank]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")
            ),
        )

    def is_card(s: Column) -> Column:
        return let(only_digits(s["m"]), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False)))

    none = F.array().cast("array<struct<rank:int,kind:string,start:int,end:int>>")
    emails = F.when(F.contains(text, F.lit("@")), tagged(match_spans(text, EMAIL), 0)).otherwise(none)
    digits = F.when(
        text.rlike("[0-9][\\x20.-]?[0-9]"),
        F.concat(
            tagged(F.filter(match_spans(text, QUAD), lambda s: octets_ok(s["m"])), 1),
            tagged(F.filter(match_spans(text, CARD), is_card), 2),
        ),
    ).otherwise(none)
    phones = F.when(
        F.contains(text, F.lit("+")),
        tagged(F.filter(match_spans(text, PHONE), lambda s: F.length(only_digits(s["m"])).between(8, 15)), 3),
    ).otherwise(none)
    return F.concat(emails, digits, phones)


def candidates(text: Column) -> Column:
    """Proposed spans with their features, as array<struct<start,end,gen,...>>."""

    def featured(xs: Column, gen: int) -> Column:
        def one(s: Column) -> Column:
            m = s["m"]
            n = F.length(only_digits(m))
            before = F.lower(text.substr(F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT_CHARS))))
            around = F.concat(
                F.when(s["start"] > 0, text.substr(s["start"], F.lit(1))).otherwise(F.lit(" ")),
                F.coalesce(text.substr(s["end"] + 1, F.lit(1)), F.lit("")),
            )
            context = F.lit(0)
            for code, words in reversed(CONTEXT):
                context = F.when(before.rlike(words), code).otherwise(context)
            parts = F.size(F.split(F.trim(F.translate(m, "().-", "    ")), r"\x20+"))
            shape = F.lit(0)
            if gen == 1:
                shape = m.rlike(LAST_LABEL).cast("int") + m.rlike(SPELLED_DOT).cast("int")
            grouping = F.lit(0)
            if gen == 3:
                for code, pattern in reversed(list(enumerate(SHAPES, 1))):
                    grouping = F.when(m.rlike(pattern), code).otherwise(grouping)
                shape = F.when(n.between(13, 19) & luhn(only_digits(m)), 2).when(n.between(7, 15) & ~m.rlike(DATE), 1).otherwise(0)
            return F.struct(
                s["start"].alias("start"),
                s["end"].alias("end"),
                F.lit(gen).alias("gen"),
                F.when(n < 8, 0).when(n < 13, 1).when(n < 16, 2).when(n == 16, 3).when(n < 20, 4).otherwise(5).alias("digits"),
                (luhn(only_digits(m)).cast("int") if gen == 3 else F.lit(0)).alias("luhn"),
                (octets_ok(m).cast("int") if gen == 2 else F.lit(0)).alias("octets"),
                m.startswith("+").cast("int").alias("plus"),
                F.when(parts == 1, 0).when(parts == 2, 1).otherwise(2).alias("parts"),
                around.rlike(r"[A-Za-z0-9]").cast("int").alias("glued"),
                context.alias("context"),
                shape.alias("format"),
                grouping.alias("shape"),
            )

        return F.transform(xs, one)

    none = F.array().cast(
        "array<struct<start:int,end:int,gen:int,digits:int,luhn:int,octets:int,plus:int,parts:int,glued:int,context:int,format:int,shape:int>>"
    )

    def if_any(test: Column, *found: Column) -> Column:
        return F.when(test, F.concat(*found)).otherwise(none)

    return F.concat(
        if_any(F.contains(text, F.lit("@")), featured(match_spans(text, EMAIL), 0)),
        if_any(text.rlike(r"(?i)[\[(]at[\])]"), featured(match_spans(text, SPELLED), 1)),
        if_any(
            text.rlike("[0-9][\\x20().-]{0,2}[0-9]"),
            featured(match_spans(text, QUAD), 2),
            featured(match_spans(text, NUMBER), 3),
        ),
    )


def proposals(docs: DataFrame, *keep: Column) -> DataFrame:
    """doc_id, what to keep, ``base`` spans and ``cand`` candidates with ``confirmed``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", *keep, base_spans(text).alias("base"), candidates(text).alias("cand"))

    def overlaps(c: Column) -> Column:
        return F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))

    return found.withColumn(
        "cand",
        F.when(
            F.size("cand") > 0, F.transform("cand", lambda c: c.withField("confirmed", overlaps(c).cast("int")))
        ),
    )


@dataclass
class Redactor:
    """Trees and threshold of each generator whose candidates may be added."""

    models: dict[int, boosting.Boosted]
    thresholds: dict[int, float]


def evidence(docs: DataFrame) -> DataFrame:
    """Candidates in labelled snippets: their features, ``label`` and ``held``.

    Snippets are the contexts of the ``SAMPLE`` documents of the smallest hashes, with a planted phrase at a place drawn
    by hash, or with a base address or phone rewritten where it stands.
    """
    hashed = docs.where("text <> ''").select(F.xxhash64("doc_id").alias("h"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    last = hashed.select("h").orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]  # of one column, at most SAMPLE rows
    sample = hashed.where(F.col("h") <= F.lit(last)).orderBy("h", "text").limit(SAMPLE)
    items = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(before).alias("before"), F.lit(form).alias("form"), F.lit(k).alias("k")) for k, (label, before, form) in enumerate(PLANTED)])
    drawn = sample.select("doc_id", "text", F.explode(items).alias("i")).withColumn("seed", F.concat_ws(":", "doc_id", "i.k"))
    digits = F.translate(F.md5("seed"), "abcdef", "012345")
    place = F.pmod(F.xxhash64("seed"), F.greatest(F.length("text"), F.lit(1))).cast("int")
    planted = drawn.select(
        "seed",
        F.col("i.label").alias("label"),
        F.concat(F.col("text").substr(F.greatest(place - 30, F.lit(0)) + 1, F.least(place, F.lit(30))), F.lit(" "), "i.before").alias("before"),
        F.array_join(F.transform(F.split("i.form", ""), lambda c, j: F.when(c == "#", F.substring(digits, j + 1, F.lit(1))).otherwise(c)), "").alias("item"),
        F.concat(F.lit(" "), F.col("text").substr(place + 1, F.lit(10))).alias("after"),
    )
    based = sample.withColumn("base", base_spans(F.col("text"))).select("doc_id", "text", F.explode("base").alias("b")).where("b.kind IN ('email', 'phone')")
    found = F.col("text").substr(F.col("b.start") + 1, F.col("b.end") - F.col("b.start"))
    spelled = F.replace(F.replace(found, F.lit("@"), F.lit(" [at] ")), F.lit("."), F.lit(" [dot] "))
    rewritten = based.select(
        F.concat_ws(":", "doc_id", F.lit("base"), "b.start").alias("seed"),
        F.lit(1).alias("label"),
        F.col("text").substr(F.greatest(F.col("b.start") - CONTEXT_CHARS, F.lit(0)) + 1, F.least(F.col("b.start"), F.lit(CONTEXT_CHARS))).alias("before"),
        F.when(F.col("b.kind") == "email", spelled).otherwise(F.regexp_replace(found, r"^\+[0-9]{1,3}[\x20.-]*", "")).alias("item"),
        F.col("text").substr(F.col("b.end") + 1, F.lit(10)).alias("after"),
    )
    snippets = planted.unionByName(rewritten)
    snippets = written(snippets.select("seed", "label", F.coalesce(F.concat("before", "item", "after"), F.lit("")).alias("text"), F.length("before").alias("low"), F.length(F.concat("before", "item")).alias("high")), "pii-snippets")
    held = (F.crc32(F.col("seed").cast("binary")) % 4 == 2).alias("held")
    body = F.coalesce("text", F.lit(""))
    found = snippets.select("label", held, "low", "high", base_spans(body).alias("base"), candidates(body).alias("cand"))
    proposed = found.select("label", "held", "low", "high", "base", F.explode_outer("cand").alias("c")).where("c IS NOT NULL")
    own = (F.col("c.start") < F.col("high")) & (F.col("c.end") > F.col("low"))
    unseen = ~F.exists("base", lambda b: (b["start"] < F.col("c.end")) & (F.col("c.start") < b["end"]))
    return proposed.where(own & unseen).select("label", "held", *[F.col(f"c.{k}").alias(k) for k in FEATURES])


def personal_share(p: np.ndarray, n: np.ndarray, trained: float) -> float:
    """Share of positives among ``n`` cases of scores ``p`` of a model trained at another share, by expectation-maximisation."""
    share = trained
    for _ in range(200):
        up, down = p * share / trained, (1 - p) * (1 - share) / (1 - trained)
        share = min(max(float((n * up / (up + down)).sum() / n.sum()), 1e-9), 1 - 1e-9)
    return share


def threshold(p: np.ndarray, neg: np.ndarray, pos: np.ndarray, share: float) -> float | None:
    """Lowest score whose precision at a share of positives reaches ``PRECISION``, by held-out counts."""
    for t in np.unique(p):
        hit = share * pos[p >= t].sum() / pos.sum()
        miss = (1 - share) * (neg[p >= t].sum() + 0.5) / (neg.sum() + 1)
        if hit >= PRECISION * (hit + miss):
            return float(t)
    return None


def fit(docs: DataFrame) -> Redactor:
    """Learn from the evidence; set thresholds by the counts of every unconfirmed candidate of the table."""
    c = F.explode("cand").alias("c")
    natural = (
        proposals(docs)
        .where(F.size("cand") > 0)
        .select(c)
        .where("c.confirmed = 0")
        .groupBy(*[F.col(f"c.{k}").alias(k) for k in FEATURES])
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()  # at most MAX_FEATURE_ROWS rows
    )
    found = Redactor({}, {})
    if not natural:
        return found
    told = evidence(docs).groupBy("held", *FEATURES).agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n")).collect()  # at most twice as many

    def arrays(rows):
        xs = {k: np.array([r[k] for r in rows], dtype=np.int64) for k in FEATURES}
        return xs, np.array([r["n"] for r in rows], dtype=np.float64)

    def labelled(rows):
        xs, n = arrays(rows)
        pos = np.array([r["pos"] for r in rows], dtype=np.float64)
        return xs, n - pos, pos

    told.sort(key=lambda r: tuple(r[k] for k in FEATURES))
    for gen in range(len(GENERATORS)):
        met = [r for r in natural if r["gen"] == gen]
        folds = [labelled([r for r in told if r["gen"] == gen and r["held"] == held]) for held in (False, True)]
        if not met or min(x.sum() for fold in folds for x in fold[1:]) < LEAST_EVIDENCE:
            continue
        model = boosting.fit(*folds[0])

        def scores(xs, model=model):
            return 1 / (1 + np.exp(-model.margins(xs)))

        xs, n = arrays(met)
        share = personal_share(scores(xs), n, folds[0][2].sum() / (folds[0][1].sum() + folds[0][2].sum()))
        t = threshold(scores(folds[1][0]), *folds[1][1:], share)
        if t is not None:
            found.models[gen], found.thresholds[gen] = model, t
    return found


def added_spans(redactor: Redactor) -> Column:
    """Accepted candidates of ``cand`` that touch no base span and no earlier accepted one."""
    none = F.array().cast("array<struct<rank:int,kind:string,start:int,end:int>>")
    if not redactor.thresholds:
        return none
    names = F.array(*[F.lit(g) for g in GENERATORS])

    def accepted(c: Column) -> Column:
        enough = F.lit(False)
        for gen, t in redactor.thresholds.items():
            enough = F.when(c["gen"] == gen, redactor.models[gen].column(lambda k: c[k]) >= F.lit(t - 1e-12)).otherwise(enough)
        return (c["confirmed"] == 0) & enough

    chosen = F.sort_array(
        F.transform(F.filter("cand", accepted), lambda c: F.struct(c["start"].alias("start"), (-c["end"]).alias("neg_end"), c["gen"].alias("gen")))
    )
    leftmost = F.aggregate(
        chosen,
        F.struct(none.alias("out"), F.lit(0).alias("at")),
        lambda acc, c: F.when(
            c["start"] >= acc["at"],
            F.struct(
                F.concat(
                    acc["out"],
                    F.array(
                        F.struct(
                            (c["gen"] + len(KINDS)).alias("rank"),
                            F.get(names, c["gen"]).alias("kind"),
                            c["start"].alias("start"),
                            (-c["neg_end"]).alias("end"),
                        )
                    ),
                ).alias("out"),
                (-c["neg_end"]).alias("at"),
            ),
        ).otherwise(acc),
        lambda acc: acc["out"],
    )
    return F.when(F.size("cand") > 0, leftmost).otherwise(none)


def report(docs: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans of every document."""
    redactor = fit(docs)

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return proposals(docs).select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.sha2(span_digest(F.col("base"), kind_first=True).cast("binary"), 256).alias("base_sha256"),
        span_digest(F.concat("base", added_spans(redactor)), kind_first=True).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """Documents with every span replaced by its kind in brackets; ``n_chars`` follows where present."""
    redactor = fit(docs)
    found = proposals(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    spans = F.concat("base", added_spans(redactor))
    text = replace_spans(F.col("row.text"), spans, lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    out = found.select(F.col("row"), text.alias("redacted"))
    kind = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    changed = {"text": F.col("redacted"), "n_chars": F.coalesce(F.length("redacted").cast(kind or "long"), F.col("row.n_chars") if kind else F.lit(0))}
    return out.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
