import hashlib
import random
import zlib

import pytest

from pagequarry.llm import merkle, queries
from tests.llm import texts


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    values = [row[0], row[3], row[2], row[4], text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes, i):
    """Root of the nodes and the (left, right) siblings of node i, built from nothing each time."""
    path = []
    while len(nodes) > 1:
        p = i - i % 8
        path.append((nodes[p:i], nodes[i + 1 : p + 8]))
        nodes = [h(*nodes[q : q + 8]) for q in range(0, len(nodes), 8)]
        i //= 8
    return nodes[0], path


def brute(rows):
    """Sorted result tuples of ``report`` over (doc_id, text, lang, source, n_chars) rows."""
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((-1 if r[0] is None else r[0], leaf_of(r, r[1]), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for x in langs:
        by[x].sort(key=lambda y: y[:2])
    leaves = {x: [y[1] for y in by[x]] for x in langs}
    subroots = [climb(leaves[x], 0)[0] for x in langs]
    out = []
    for k, x in enumerate(langs):
        root, upper = climb(subroots, k)
        for i, (_, leaf, r) in enumerate(by[x]):
            path = climb(leaves[x], i)[1] + upper
            text = r[1]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = leaf_of(r, text)
            for left, right in path:
                folded = h(*left, folded, *right)
            proof = h(*[d for left, right in path for d in (*left, *right)])
            out.append((str(r[0]), leaf, subroots[k], root, proof, folded, folded == root))
    return sorted(out)


def told(df):
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect())


def many(n, langs=("en", None, "", "é", "zz"), seed=1):
    rng = random.Random(seed)
    return [(i if i % 50 else None, rng.choice(["Some Text", "no upper", None, "", "ÄÖ x"]) and f"T{i} x", langs[min(rng.randrange(len(langs) * 4), len(langs) - 1)] if i % 3 else "en", "s", i) for i in range(n)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("n", [1, 2, 8, 9, 65, 1200])
def test_report_against_brute_force(spark, n):
    rows = many(n)
    assert told(merkle.report(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rows)


def test_awkward_rows(spark):
    rows = texts.rows()
    got = told(merkle.report(texts.frame(spark)))
    assert got == brute(rows)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)
    assert merkle.report(texts.frame(spark, [])).count() == 0


def test_many_values_and_one_chunk_border(spark):
    rows = [(i, f"Text {i}", f"l{i % 700:03d}", None, None) for i in range(1500)] + [(i, "X", "hot", "s", i) for i in range(5000, 5000 + 8 * merkle.SPAN + 1)]
    got = told(merkle.report(spark.createDataFrame(rows, SCHEMA).repartition(7)))
    assert got == brute(rows)


def test_proofs_fold_back(spark):
    rows = many(700, langs=("en",))
    df = merkle.manifest(spark.createDataFrame(rows, SCHEMA), siblings=True)
    for r in df.collect():
        assert r.verified and h(*r.siblings) == r.proof_sha256


def test_states_resume_where_they_were_copied():
    digests = [h(str(i)).encode() for i in range(100)]
    tree = merkle.Tree(digests, True)
    for i in (0, 7, 8, 63, 64, 99):
        new = h("new").encode()
        changed = digests[:i] + [new] + digests[i + 1 :]
        assert tree.fold(i, new, tree.siblings(i)) == merkle.Tree(changed, True).root
        assert merkle.fold(new, [([a[p : p + 64].decode() for p in range(0, len(a), 64)], [b[p : p + 64].decode() for p in range(0, len(b), 64)]) for a, b in tree.siblings(i)]) == merkle.Tree(changed, True).root.decode()


def test_sql(spark, tmp_path):
    import duckdb

    rows = many(900)
    rows = [r for r in rows if r[0] is not None]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = con.sql(queries.ORACLE_SQL["op13_merkle"]).fetchall()
    assert sorted((str(r[0]), *r[1:]) for r in got) == brute(rows)
