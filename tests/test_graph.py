"""References as a graph and bounded trees, against plain Python."""

import random

from pyspark.sql import functions as F

from pagequarry.operators import bounded, graph


def live_of(spark, docs):
    """docs: {doc_id: {obj: JSON text}}"""
    rows = [(d, o, v) for d, objs in docs.items() for o, v in objs.items()]
    return spark.createDataFrame(rows, "doc_id long, obj int, value string").withColumn("resolved", F.lit(None).cast("string"))


def test_edges_and_reachability(spark):
    rng = random.Random(2)
    docs, arcs = {}, {}
    for d in range(12):
        n = rng.randint(1, 60)
        out = {o: [rng.randint(1, n + 3) for _ in range(rng.randint(0, 2))] for o in range(1, n + 1)}
        if d == 0:
            out = {o: [o + 1] for o in range(1, 3000)} | {3000: [1]}  # one long cycle
        docs[d] = {o: '{"K": [%s], "S": "s:3120302052"}' % ", ".join(f'"{t} 0 R"' for t in ts) for o, ts in out.items()}
        arcs[d] = out
    live = live_of(spark, docs)
    links = graph.edges(live)
    got = sorted((r.doc_id, r.src, r.place, r.dst) for r in links.where("key = 'K'").collect())
    assert got == sorted((d, o, i, t) for d, out in arcs.items() for o, ts in out.items() for i, t in enumerate(ts))
    starts = spark.createDataFrame([(d, 1) for d in docs], "doc_id long, obj int")
    found = {(r.doc_id, r.obj): r.steps for r in graph.reachable(links, starts).collect()}
    want = {}
    for d, out in arcs.items():
        level, k = {1}, 0
        while level:
            want |= {(d, o): k for o in level}
            level, k = {t for o in level for t in out.get(o, ()) if (d, t) not in want}, k + 1
    assert found == want
    assert graph.reachable(links.limit(0), starts).count() == len(docs)


def test_plain_values_and_strings_make_no_edges(spark):
    live = live_of(spark, {1: {1: '["2 0 R", 3, "/N"]', 2: '"1 0 R"', 3: '"s:31302030205220"', 4: "42", 5: '{"A": "1 0 R", "B": {"C": ["2 0 R", "3 0 R"]}}'}})
    got = {(r.src, r.key, r.place, r.dst) for r in graph.edges(live).collect()}
    assert got == {(1, None, 0, 2), (2, None, 0, 1), (5, "A", 0, 1), (5, "B", 0, 2), (5, "B", 1, 3)}


def number_node(limits, nums=None, kids=None):
    parts = (["\"Limits\": %s" % list(limits)] if limits else []) + (["\"Nums\": %s" % nums] if nums is not None else []) + (['"Kids": [%s]' % ", ".join(f'"{k} 0 R"' for k in kids)] if kids else [])
    return "{%s}" % ", ".join(parts)


def test_tree_problems_and_lookups(spark):
    objs = {
        1: number_node(None, kids=[2, 3, 4]),
        2: number_node((0, 9), nums=[0, 10, 5, 15, 9, 19]),
        3: number_node((8, 20), kids=[5, 6, 3]),  # overlaps the one before and holds itself
        4: number_node(None, nums=[30, 40, 29, 39]),  # no limits, unsorted
        5: number_node((10, 25), nums=[10, 20, 26, 36]),  # beyond its parent, a key beyond its limits
        6: number_node((30, 20), nums=[]),  # reversed
    }
    live, starts = live_of(spark, {7: objs}), spark.createDataFrame([(7, 1)], "doc_id long, node int")
    got = {(r.node, r.problem) for r in bounded.problems(live, starts, bounded.NUMBERS).collect()}
    assert got == {
        (3, "overlaps the one before"), (4, "no limits"), (4, "keys unsorted"), (5, "outside its parent"), (5, "keys outside the limits"),
        (6, "limits reversed"), (6, "outside its parent"),
    }
    wanted = spark.createDataFrame([(7, k) for k in (0, 5, 9, 10, 26, 29, 30, 99)], "doc_id long, key long")
    rows = {r.key: (r.value, r.n_read) for r in bounded.looked_up(live, starts, wanted, bounded.NUMBERS).collect()}
    assert {k: v for k, (v, _) in rows.items()} == {0: "10", 5: "15", 9: "19", 10: "20", 26: None, 29: "39", 30: "40", 99: None}
    assert rows[0][1] == 3 and rows[10][1] == 4  # the root, the node without limits, and the path


def test_lookups_read_only_the_paths(spark):
    """A tree of 4,096 keys: a key's way down has one node a level."""
    objs, level, at = {}, [], 1000
    for p in range(0, 4096, 8):
        objs[at] = number_node((p, p + 7), nums=[x for k in range(p, p + 8) for x in (k, k * 3)])
        level.append((at, p, p + 7))
        at += 1
    while len(level) > 1:
        above = []
        for p in range(0, len(level), 8):
            own = level[p : p + 8]
            objs[at] = number_node((own[0][1], own[-1][2]), kids=[k for k, _, _ in own])
            above.append((at, own[0][1], own[-1][2]))
            at += 1
        level = above
    live, starts = live_of(spark, {1: objs}), spark.createDataFrame([(1, level[0][0])], "doc_id long, node int")
    wanted = spark.createDataFrame([(1, k) for k in range(-5, 4100, 7)], "doc_id long, key long")
    for r in bounded.looked_up(live, starts, wanted, bounded.NUMBERS).collect():
        assert (r.value, r.n_read) == ((str(r.key * 3), 4) if 0 <= r.key < 4096 else (None, 1))
    assert bounded.problems(live, starts, bounded.NUMBERS).count() == 0


def test_names_compare_by_bytes(spark):
    def text(x):
        return '"s:%s"' % x.encode().hex()

    node = '{"Limits": [%s, %s], "Names": [%s]}' % (text("B"), text("a"), ", ".join((text("B"), "1", text("Z"), "2", text("a"), "3")))
    live = live_of(spark, {1: {1: '{"Kids": ["2 0 R"]}', 2: node}})
    starts = spark.createDataFrame([(1, 1)], "doc_id long, node int")
    assert bounded.problems(live, starts, bounded.NAMES).count() == 0
    wanted = spark.createDataFrame([(1, bytearray(b"Z")), (1, bytearray(b"A"))], "doc_id long, key binary")
    assert {bytes(r.key): r.value for r in bounded.looked_up(live, starts, wanted, bounded.NAMES).collect()} == {b"Z": "2", b"A": None}
