"""Conversation structure repair: the cheapest edits to ``(s?(ua)+)?`` by a checkpointed dynamic programme.

Turns of a conversation are taken by turn (nulls first), role, then text, and each
gets its first fault: blank, duplicate (role and text seen earlier) or truncated.
Edits are Keep (0), Rerole to user or assistant (3), Delete (4; the only edit for
blank and duplicate turns) and Insert of an empty user or assistant turn (3);
truncated turns that stay add 3. The audit string holds the initials of the cheapest
edits, of equal costs the ASCII-least.

The costs to the end, a vector over the four grammar states, run backward over the
turns and are stored only at every square-root-th of them; walking forward, the
vectors between two checkpoints are worked out again, and the ASCII-least edit whose
cost fits exactly is taken. So a conversation of n turns needs vectors for 2 * sqrt(n).

Spark deals the turns by ranges of their order, however many one conversation has.
Faults, counts and one character a turn are aggregated by conversation and range,
then by conversation; the programme reads that string and writes the audit, the only
data of a whole conversation that one task holds (a byte a turn, as in the result).
For the digest and the repaired turns, texts stream through a task in order behind
their conversation's audit, and none is held; SHA-256 has no other order.

Defined results: null roles and texts count as one space; a null conv_id is a
conversation of its own; equal turns are ordered by role, then text; rows alike in
everything are duplicates of each other; conversations without a turn left have
zeros, an empty audit and the digest of nothing; very long texts are read whole;
other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.llm.store import written

WORD = r"[^\x20\x09-\x0D]"
LAST = r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*+\z"
RANGE = 64  # leading characters of a text that ranges tell apart

START, SYSTEM, USER, ASSISTANT = range(4)  # what the turns so far end with
ENDS = (0, None, None, 0)
#: State after a turn that may follow, by its role's initial; inserted turns and new roles are user's or assistant's.
AFTER = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None), "x": (None,) * 4}
OTHER = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
FAR = 1 << 60


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``gone``, damaged by the hash of ``conv_id:turn``."""

    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    code = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(code == 1, F.lit("")).when(code == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    role = F.when(code == 4, F.lit("user")).otherwise(shown("role"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (code == 0).alias("gone"), F.when(code == 3, 2).otherwise(1).alias("copies"))
    return rows.withColumn("copies", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("copies")


def ordered(turns: DataFrame) -> DataFrame:
    """Turns dealt by ranges and written: ``at`` ascends in the order of each conversation, ``part`` is its range."""
    gone = F.col("gone") if "gone" in turns.columns else F.lit(False)
    key = F.when(F.col("conv_id").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("conv_id").cast("string")))
    rows = turns.select(
        key.alias("key"), "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), gone.alias("gone"), F.monotonically_increasing_id().alias("salt")
    )
    dealt = rows.repartitionByRange("key", "turn", "role", F.left("text", F.lit(RANGE)), "salt").sortWithinPartitions("key", "turn", "role", "text")
    dealt = written(dealt.drop("salt").withColumn("at", F.monotonically_increasing_id()), "conversation-turns")
    return dealt.withColumn("part", F.shiftrightunsigned("at", 33))


def faults(rows: DataFrame) -> DataFrame:
    """Of the turns that :func:`ordered` gives and that are there: key, part, at, turn, initial and ``fault`` (or null)."""
    there = rows.where("NOT gone").select(
        "key", "part", "at", "turn", F.left("role", F.lit(1)).alias("initial"),
        F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256).alias("told"),
        F.regexp_extract("text", LAST, 1).alias("last"),
    )
    firsts = there.groupBy("key", "told").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    fault = F.when(F.col("last") == "", "blank").when(F.col("first").isNull(), "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated")
    return there.drop("told").join(firsts, "at", "left").select("key", "part", "at", "turn", "initial", fault.alias("fault"))


def _relaxed(costs: list[int]) -> list[int]:
    """With turns inserted where that is cheaper; three steps reach every state."""
    for _ in range(3):
        costs = [min(c, INSERT + costs[OTHER[q]]) for q, c in enumerate(costs)]
    return costs


_END = _relaxed([FAR if c is None else c for c in ENDS])
#: A turn as a character: its role's initial (s, u, a, else x), in upper case if truncated, 1234 for suax if it must go;
#: the states it is kept into with the extra cost, or None.
_MOVES = {c: (AFTER[c], 0) for c in "suax"} | {c.upper(): (AFTER[c], TRUNCATED) for c in "suax"} | dict.fromkeys("1234")


def _before(char: str, costs: list[int]) -> list[int]:
    """Costs to the end before a turn, from those after it."""
    found = [DELETE + c for c in costs]
    if _MOVES[char]:
        kept, extra = _MOVES[char]
        for q in range(4):
            found[q] = min(found[q], REROLE + extra + costs[OTHER[q]], FAR if kept[q] is None else extra + costs[kept[q]])
    return _relaxed(found)


def cheapest(turns: str) -> tuple[int, str]:
    """Cost and audit of a conversation given as a character a turn."""
    n = len(turns)
    block = max(1, isqrt(n))
    marks = {n: _END}
    costs = _END
    for i in range(n - 1, -1, -1):
        costs = _before(turns[i], costs)
        if i % block == 0:
            marks[i] = costs
    total, state, audit = marks[0][START], START, []
    for low in range(0, max(n, 1), block):
        high = min(low + block, n)
        inside = [marks[high]]
        for i in range(high - 1, low - 1, -1):
            inside.append(_before(turns[i], inside[-1]))
        inside.reverse()
        for i in range(low, high):
            here, after, moves = inside[i - low], inside[i - low + 1], _MOVES[turns[i]]
            while True:
                if here[state] == DELETE + after[state]:
                    audit.append("D")
                    break
                if here[state] == INSERT + here[OTHER[state]]:
                    audit.append("I")
                    state = OTHER[state]
                    continue
                kept = moves[0][state]
                if kept is not None and here[state] == moves[1] + after[kept]:
                    audit.append("K")
                    state = kept
                else:
                    audit.append("R")
                    state = OTHER[state]
                break
    while ENDS[state] is None:
        audit.append("I")
        state = OTHER[state]
    return total, "".join(audit)


def illegal_pairs(turns: str) -> int:
    """Adjacent role initials other than su, ua and au."""
    plain = turns.translate(str.maketrans("SUAX1234", "suaxsuax"))
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(plain, plain[1:]))


_PLAN = "cost long, audit string, illegal long"


def _planned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    known: dict[str, tuple[int, str, int]] = {}
    for turns in batches:
        out = []
        for t in turns.to_pylist():
            plan = known.get(t)
            if plan is None:
                plan = (*cheapest(t), illegal_pairs(t))
                if len(t) <= 32 and len(known) < 50_000:
                    known[t] = plan
            out.append(plan)
        names = ("cost", "audit", "illegal")
        yield pa.StructArray.from_arrays([pa.array([p[k] for p in out], pa.string() if k == 1 else pa.int64()) for k in range(3)], names=names)


def plans(rows: DataFrame) -> DataFrame:
    """One row a conversation of :func:`ordered`: gaps, faults, illegal pairs, cost and audit."""
    found = faults(rows)
    plain = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise(F.lit("x"))
    char = F.when(F.col("fault").isin("blank", "duplicate"), F.translate(plain, "suax", "1234")).when(F.col("fault") == "truncated", F.upper(plain)).otherwise(plain)

    def count(fault: str) -> Column:
        return F.sum(F.when(F.col("fault") == fault, 1).otherwise(0)).alias(fault)

    names = ("blank", "duplicate", "truncated")
    ranges = found.groupBy("key", "part").agg(F.array_sort(F.collect_list(F.struct("at", char.alias("c")))).alias("turns"), *map(count, names))
    ranges = ranges.select("key", "part", F.array_join(F.transform("turns", lambda t: t["c"]), "").alias("turns"), *names)
    whole = ranges.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("part", "turns"))).alias("turns"), *[F.sum(c).alias(c) for c in names])
    whole = whole.withColumn("turns", F.array_join(F.transform("turns", lambda t: t["turns"]), ""))
    places = found.where("turn IS NOT NULL").groupBy("key", "turn").agg(F.count(F.lit(1))).groupBy("key")
    gaps = places.agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    every = rows.groupBy("key").agg(F.first("conv_id").alias("conv_id"))
    joined = every.join(whole, "key", "left").join(gaps, "key", "left").withColumn("turns", F.coalesce("turns", F.lit("")))
    plan = F.arrow_udf(_planned, _PLAN)(F.col("turns"))
    return joined.select(
        "key", "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *names)], plan.alias("plan")
    ).select("key", "conv_id", "gaps", *names, "plan.illegal", "plan.cost", "plan.audit")


class _Walk:
    """The audit of a conversation, applied to its turns as they come; ``put`` gets each repaired turn."""

    def __init__(self, audit: str, put) -> None:
        self.audit, self.at, self.state, self.put = audit, 0, START, put

    def inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.state = OTHER[self.state]
            self.put(NAMES[self.state], "")
            self.at += 1

    def turn(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = AFTER[role[0]][self.state]
            self.put(role, text)
        elif edit == "R":
            self.state = OTHER[self.state]
            self.put(NAMES[self.state], text)


class _Digest:
    """SHA-256 of ``role:text`` of all turns, joined by line feeds."""

    def __init__(self) -> None:
        self.state, self.any = hashlib.sha256(), False

    def put(self, role: str, text: str) -> None:
        self.state.update((b"\n" if self.any else b"") + role.encode())
        self.state.update(b":")
        self.state.update(text.encode())
        self.any = True


def _streams(rows: DataFrame, told: DataFrame) -> DataFrame:
    """Turns in order behind the row of their conversation (``at`` is -1 and ``plan`` not null)."""
    head = told.select("key", F.lit(-1).cast("long").alias("at"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.struct(*[c for c in told.columns if c != "key"]).alias("plan"))
    body = rows.where("NOT gone").select("key", "at", "role", "text", F.lit(None).cast(head.schema["plan"].dataType).alias("plan"))
    return head.unionByName(body).repartition("key").sortWithinPartitions("key", "at")


def _events(batch: pa.RecordBatch) -> Iterator[tuple[dict | None, str, str]]:
    for p in range(0, batch.num_rows, 256):
        rows = batch.slice(p, 256)
        yield from zip(*[rows.column(c).to_pylist() for c in ("plan", "role", "text")], strict=True)


class _Rows:
    """Result rows on their way into Arrow batches; the type of conv_id is the input's."""

    def __init__(self, schema: T.StructType) -> None:
        self.names = [f.name for f in schema.fields]
        self.kinds = [pa.string() if isinstance(f.dataType, T.StringType) else pa.int64() for f in schema.fields]
        self.rows: list[tuple] = []

    def takes(self, batch: pa.RecordBatch) -> None:
        self.kinds[self.names.index("conv_id")] = batch.schema.field("plan").type.field("conv_id").type

    def batch(self) -> pa.RecordBatch:
        found = [pa.array(c, k) for c, k in zip(zip(*self.rows), self.kinds, strict=True)]
        self.rows.clear()
        return pa.RecordBatch.from_arrays(found, names=self.names)


def report(turns: DataFrame) -> DataFrame:
    """One row a conversation: what was wrong, the cheapest edits and the digest of the repaired turns."""
    rows = ordered(turns)
    told = plans(rows)
    schema = T.StructType([f for f in told.schema.fields if f.name != "key"] + [T.StructField("repaired_sha256", T.StringType())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(schema)
        plan = walk = digest = None
        for batch in batches:
            out.takes(batch)
            for head, role, text in _events(batch):
                if head is None:
                    walk.turn(role, text)
                    continue
                if walk:
                    walk.inserts()
                    out.rows.append((*plan.values(), digest.state.hexdigest()))
                plan, digest = head, _Digest()
                walk = _Walk(head["audit"], digest.put)
                if len(out.rows) >= 1000:
                    yield out.batch()
        if walk:
            walk.inserts()
            out.rows.append((*plan.values(), digest.state.hexdigest()))
            yield out.batch()

    return _streams(rows, told).mapInArrow(of, schema)


def repair(turns: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, place (from 0), role and text."""
    rows = ordered(turns)
    told = plans(rows).select("key", "conv_id", "audit")
    added = [T.StructField("place", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]
    schema = T.StructType([turns.schema["conv_id"], *added])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(schema)
        walk, conv, place = None, None, 0

        def put(role: str, text: str) -> None:
            nonlocal place
            out.rows.append((conv, place, role, text))
            place += 1

        for batch in batches:
            out.takes(batch)
            for head, role, text in _events(batch):
                if head is None:
                    walk.turn(role, text)
                else:
                    if walk:
                        walk.inserts()
                    conv, place = head["conv_id"], 0
                    walk = _Walk(head["audit"], put)
                if len(out.rows) >= 1000:
                    yield out.batch()
        if walk:
            walk.inserts()
        if out.rows:
            yield out.batch()

    return _streams(rows, told).mapInArrow(of, schema)
