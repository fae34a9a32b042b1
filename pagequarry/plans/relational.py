"""Queries over the given tables for the operators that are pure column, window and join work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequarry.functions import geometry as g
from pagequarry.functions import labels, samples
from pagequarry.operators import ranges, sequences, trees

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    """Register a query under its function's name with its DuckDB equivalent."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doubles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id and its components as doubles, scaled to page units."""
    e = F.transform("embedding", lambda v: v.cast("double") * 100)
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", e.alias("e"))


def rect_of(e: Column, at: int) -> Column:
    return g.rect(*[e[at + k] for k in range(4)])


RECTS = """
    WITH d AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE * 100) AS e FROM embeddings),
    r AS (SELECT vec_id, label, e,
        [least(e[1], e[3]), least(e[2], e[4]), greatest(e[1], e[3]), greatest(e[2], e[4])] AS a,
        [least(e[5], e[7]), least(e[6], e[8]), greatest(e[5], e[7]), greatest(e[6], e[8])] AS b FROM d)
"""


@query(RECTS + """SELECT vec_id, a[1] <= b[3] AND b[1] <= a[3] AS h_over, a[2] <= b[4] AND b[2] <= a[4] AS v_over,
    CASE WHEN b[1] <= a[3] AND a[1] <= b[3] THEN least(abs(a[1] - b[3]), abs(a[3] - b[1])) ELSE 0 END AS h_measure,
    CASE WHEN b[2] <= a[4] AND a[2] <= b[4] THEN least(abs(a[2] - b[4]), abs(a[4] - b[2])) ELSE 0 END AS v_measure,
    (a[3] - a[1] <= 0) OR (a[4] - a[2] <= 0) AS empty FROM r""")
def bbox_overlap(spark, sf_dir):
    r = doubles(spark, sf_dir).select("vec_id", rect_of(F.col("e"), 0).alias("a"), rect_of(F.col("e"), 4).alias("b"))
    a, b = F.col("a"), F.col("b")
    return r.select(
        "vec_id", g.h_overlaps(a, b).alias("h_over"), g.v_overlaps(a, b).alias("v_over"), g.h_overlap(a, b).alias("h_measure"),
        g.v_overlap(a, b).alias("v_measure"), g.is_empty(a).alias("empty"),
    )


@query(RECTS + """SELECT vec_id, a[3] - a[1] AS width, a[4] - a[2] AS height,
    CASE WHEN b[1] <= a[3] AND a[1] <= b[3] THEN 0 ELSE least(abs(a[1] - b[3]), abs(a[3] - b[1])) END AS h_gap,
    CASE WHEN b[2] <= a[4] AND a[2] <= b[4] THEN 0 ELSE least(abs(a[2] - b[4]), abs(a[4] - b[2])) END AS v_gap FROM r""")
def bbox_distance(spark, sf_dir):
    r = doubles(spark, sf_dir).select("vec_id", rect_of(F.col("e"), 0).alias("a"), rect_of(F.col("e"), 4).alias("b"))
    a, b = F.col("a"), F.col("b")
    return r.select("vec_id", g.width(a).alias("width"), g.height(a).alias("height"), g.h_distance(a, b).alias("h_gap"), g.v_distance(a, b).alias("v_gap"))


@query(RECTS + "SELECT label, min(a[1]) AS x0, min(a[2]) AS y0, max(a[3]) AS x1, max(a[4]) AS y1, count(*) AS n FROM r GROUP BY label")
def bbox_union(spark, sf_dir):
    r = doubles(spark, sf_dir).select("label", rect_of(F.col("e"), 0).alias("a"))
    u = r.groupBy("label").agg(g.union_rect(F.col("a")).alias("u"), F.count(F.lit(1)).alias("n"))
    return u.select("label", *[F.col("u")[i].alias(k) for i, k in enumerate(("x0", "y0", "x1", "y1"))], "n")


@query(RECTS + """, m AS (SELECT vec_id, e[9] AS a, e[10] AS b, e[11] AS c, e[12] AS d, e[13] AS e, e[14] AS f, r.a AS q FROM r),
    p AS (SELECT vec_id, [a*q[1] + c*q[2] + e, a*q[1] + c*q[4] + e, a*q[3] + c*q[2] + e, a*q[3] + c*q[4] + e] AS xs,
        [b*q[1] + d*q[2] + f, b*q[1] + d*q[4] + f, b*q[3] + d*q[2] + f, b*q[3] + d*q[4] + f] AS ys FROM m)
    SELECT vec_id, list_min(xs) AS x0, list_min(ys) AS y0, list_max(xs) AS x1, list_max(ys) AS y1 FROM p""")
def bbox_transform(spark, sf_dir):
    m = F.array(*[F.col("e")[8 + k] for k in range(6)])
    r = doubles(spark, sf_dir).select("vec_id", g.transform_rect(m, rect_of(F.col("e"), 0)).alias("t"))
    return r.select("vec_id", *[F.col("t")[i].alias(k) for i, k in enumerate(("x0", "y0", "x1", "y1"))])


@query("""WITH d AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE * 100) AS e FROM embeddings)
    SELECT vec_id, e[1]*e[7] + e[3]*e[8] AS a, e[2]*e[7] + e[4]*e[8] AS b, e[1]*e[9] + e[3]*e[10] AS c, e[2]*e[9] + e[4]*e[10] AS d,
    e[1]*e[11] + e[3]*e[12] + e[5] AS e, e[2]*e[11] + e[4]*e[12] + e[6] AS f, e[1]*e[13] + e[3]*e[14] + e[5] AS px, e[2]*e[13] + e[4]*e[14] + e[6] AS py FROM d""")
def matrix_product(spark, sf_dir):
    m, n = (F.array(*[F.col("e")[at + k] for k in range(6)]) for at in (0, 6))
    p = g.point(m, F.col("e")[12], F.col("e")[13])
    r = doubles(spark, sf_dir).select("vec_id", g.matrix_mul_finite(m, n).alias("p"), p.alias("pt"))
    return r.select("vec_id", *[F.col("p")[i].alias(k) for i, k in enumerate("abcdef")], F.col("pt.x").alias("px"), F.col("pt.y").alias("py"))


@query(RECTS + """, t AS (SELECT vec_id, a, (label % 4) * 90 AS turn FROM r)
    SELECT vec_id, turn,
    CASE turn WHEN 0 THEN 1 WHEN 180 THEN -1 ELSE 0 END::DOUBLE AS ma, CASE turn WHEN 90 THEN 1 WHEN 270 THEN -1 ELSE 0 END::DOUBLE AS mb,
    CASE turn WHEN 90 THEN 1 WHEN 270 THEN -1 ELSE 0 END::DOUBLE AS mc, CASE turn WHEN 0 THEN -1 WHEN 180 THEN 1 ELSE 0 END::DOUBLE AS md,
    CASE turn WHEN 0 THEN -a[1] WHEN 90 THEN -a[2] WHEN 180 THEN a[3] ELSE a[4] END AS me,
    CASE turn WHEN 0 THEN a[4] - a[2] - -a[2] WHEN 90 THEN a[3] - a[1] - a[3] WHEN 180 THEN a[4] - a[2] - a[4] ELSE a[3] - a[1] - -a[1] END AS mf FROM t""")
def page_screen_matrix(spark, sf_dir):
    r = doubles(spark, sf_dir).select("vec_id", ((F.col("label") % 4) * 90).alias("turn"), rect_of(F.col("e"), 0).alias("a"))
    r = r.select("vec_id", "turn", g.page_matrix(F.col("a"), F.col("turn")).alias("m"))
    return r.select("vec_id", "turn", *[(F.col("m")[i] + F.lit(0.0)).alias(f"m{k}") for i, k in enumerate("abcdef")])


@query(r"""WITH RECURSIVE o AS (SELECT o_orderkey, (o_orderkey % 5000)::BIGINT AS n FROM orders),
    d AS (SELECT DISTINCT n + 1 AS n FROM o),
    a AS (SELECT n, n AS rest, '' AS s FROM d UNION ALL SELECT n, (rest - 1) // 26, chr((97 + (rest - 1) % 26)::INTEGER) || s FROM a WHERE rest > 0),
    al AS (SELECT n, s FROM a WHERE rest = 0),
    r AS (SELECT n, concat(repeat('m', n // 1000),
        ['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm'][n // 100 % 10 + 1], ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][n // 10 % 10 + 1],
        ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][n % 10 + 1]) AS s FROM d)
    SELECT o_orderkey, 'p-' || (o.n + 1) AS decimal_label, r.s AS roman_label, upper(r.s) AS upper_roman, al.s AS alpha_label, upper(al.s) AS upper_alpha, 'p-' AS other_label
    FROM o JOIN r ON r.n = o.n + 1 JOIN al ON al.n = o.n + 1""")
def page_label_styles(spark, sf_dir):
    n = F.col("o_orderkey") % 5000
    none, one = F.lit(""), F.lit(0)

    def of(style: str, prefix: Column) -> Column:
        return labels.page_label(F.lit(style), prefix, one, n)

    return table(spark, sf_dir, "orders").select(
        "o_orderkey", of("D", F.lit("p-")).alias("decimal_label"), of("r", none).alias("roman_label"), of("R", none).alias("upper_roman"),
        of("a", none).alias("alpha_label"), of("A", none).alias("upper_alpha"), of("?", F.lit("p-")).alias("other_label"),
    )


@query("""WITH rules AS (SELECT c_custkey AS cust, (o_orderkey % 97)::BIGINT AS first, min(o_orderkey) AS rule FROM orders JOIN customer ON c_custkey = o_custkey
        WHERE o_orderpriority = '1-URGENT' GROUP BY ALL)
    SELECT o.o_orderkey, r.rule FROM (SELECT o_orderkey, o_custkey, (o_orderkey % 101)::BIGINT AS page FROM orders) o
    ASOF LEFT JOIN rules r ON o.o_custkey = r.cust AND o.page >= r.first""")
def page_label_asof(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "cust")
    custs = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("cust"))
    urgent = orders.where("o_orderpriority = '1-URGENT'").join(custs, "cust", "left_semi")
    rules = urgent.groupBy("cust", (F.col("o_orderkey") % 97).alias("first")).agg(F.min("o_orderkey").alias("rule"))
    pages = orders.select("o_orderkey", "cust", (F.col("o_orderkey") % 101).alias("page"))
    return sequences.asof(pages, rules, ["cust"], "page", "first", "rule").select("o_orderkey", "rule")


@query("SELECT l_orderkey, l_linenumber, l_partkey, (l_partkey & 4) <> 0 AS printable, (l_partkey & 8) <> 0 AS modifiable, (l_partkey & 16) <> 0 AS extractable FROM lineitem")
def permission_bits(spark, sf_dir):
    p = samples.permissions(F.col("l_partkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *[p[k].alias(k) for k in ("printable", "modifiable", "extractable")])


@query("SELECT doc_id, sha256(text) AS digest, text AS round_trip, strlen(text)::BIGINT AS n_bytes FROM documents")
def hex_round_trip(spark, sf_dir):
    content = F.col("text").cast("binary")
    spaced = F.concat(F.regexp_replace(F.hex(content), "(.{40})", "$1\n"), F.lit(">ignored"))
    back = samples.ascii_hex_decode(spaced)
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.sha2(content, 256).alias("digest"), back.cast("string").alias("round_trip"), F.octet_length(content).cast("long").alias("n_bytes")
    )


@query("SELECT event_id, (sum(floor(value)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) % 256)::BIGINT AS byte FROM events")
def tiff_predictor(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", (F.sum(F.floor("value").cast("long")).over(w) % 256).alias("byte"))


@query("""WITH l AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
    b AS (SELECT *, sum(CASE WHEN before IS NULL OR value - before > 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM l)
    SELECT user_id, run::BIGINT AS run, string_agg(event_type, ' ' ORDER BY ts, event_id) AS line, count(*) AS n FROM b GROUP BY user_id, run""")
def untagged_lines(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    marked = events.withColumn("before", before)
    numbered = sequences.runs(marked, ["user_id"], ["ts", "event_id"], F.col("before").isNull() | (F.col("value") - F.col("before") > 0.5))
    ordered = F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type")))
    return numbered.groupBy("user_id", "run").agg(F.array_join(F.transform(ordered, lambda x: x["event_type"]), " ").alias("line"), F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT user_id, event_type, row_number() OVER w AS pos, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    b AS (SELECT *, sum(CASE WHEN pos = 1 OR event_type IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM p),
    r AS (SELECT user_id, event_type, run, min(pos) AS b, max(pos) AS e, count(*) AS n FROM b GROUP BY ALL)
    SELECT user_id, event_type, min(run)::BIGINT AS place, arg_max(b, run) AS "begin", arg_max(e, run) AS "end", arg_max(n, run) AS n FROM r GROUP BY user_id, event_type""")
def mcid_sections(spark, sf_dir):
    s = sequences.content_sections(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")
    return s.select("user_id", "event_type", "place", F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"), "n")


@query("""SELECT conv_id, turn, sum(CASE WHEN role = 'user' THEN 1 WHEN role = 'assistant' THEN -1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS depth FROM conversations""")
def marked_depth(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return sequences.running_depth(c, ["conv_id"], ["turn"], F.col("role") == "user", F.col("role") == "assistant").select("conv_id", "turn", "depth")


@query("SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS first_order, arg_min(o_totalprice, o_orderkey) AS first_price, arg_max(o_totalprice, o_orderkey) AS last_price FROM orders GROUP BY o_custkey")
def first_and_last_wins(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    first = sequences.one_per(orders, ["o_custkey"], ["o_orderkey"]).select("o_custkey", F.col("o_orderkey").alias("first_order"), F.col("o_totalprice").alias("first_price"))
    last = sequences.one_per(orders, ["o_custkey"], [F.desc("o_orderkey")]).select("o_custkey", F.col("o_totalprice").alias("last_price"))
    return first.join(last, "o_custkey")


XREF = "SELECT o_custkey AS doc_id, (o_orderkey % 7)::BIGINT AS obj, 0 AS gen, o_orderkey AS rev, o_orderstatus = 'F' AS free FROM orders"


@query(f"WITH x AS ({XREF}), m AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY doc_id, obj, gen ORDER BY rev) = 1) SELECT doc_id, obj, rev, free FROM m")
def xref_merge_newest(spark, sf_dir):
    return sequences.merge_revisions(_xref(spark, sf_dir)).select("doc_id", "obj", "rev", "free")


@query(f"""WITH x AS ({XREF}), m AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY doc_id, obj, gen ORDER BY rev) = 1)
    SELECT doc_id, obj, rev FROM x WHERE (doc_id, obj) IN (SELECT doc_id, obj FROM m WHERE NOT free)""")
def mapping_keys(spark, sf_dir):
    """Keys of every revision that the merged table still has; they may repeat."""
    x = _xref(spark, sf_dir)
    live = sequences.merge_revisions(x).where(~F.col("free")).select("doc_id", "obj")
    return x.join(live, ["doc_id", "obj"], "left_semi").select("doc_id", "obj", "rev")


def _xref(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 7).alias("obj"), F.lit(0).alias("gen"), F.col("o_orderkey").alias("rev"), (F.col("o_orderstatus") == "F").alias("free")
    )


@query("""WITH r AS (SELECT s_suppkey AS cid, (s_suppkey * 37)::BIGINT AS low, (s_suppkey * 37 + s_suppkey % 60)::BIGINT AS high FROM supplier)
    SELECT p_partkey, cid FROM part JOIN r ON p_partkey * 3 BETWEEN low AND high""")
def cmap_range_lookup(spark, sf_dir):
    s = F.col("s_suppkey")
    r = table(spark, sf_dir, "supplier").select(s.alias("cid"), (s * 37).alias("low"), (s * 37 + s % 60).alias("high"))
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 3).alias("code"))
    return ranges.range_lookup(p, r, "code", "low", "high", 64).select("p_partkey", "cid")


@query(RECTS + "SELECT x.label, x.vec_id AS a, y.vec_id AS b FROM r x JOIN r y ON x.label = y.label AND x.vec_id < y.vec_id AND x.a[1] <= y.a[3] AND y.a[1] <= x.a[3] AND x.a[2] <= y.a[4] AND y.a[2] <= x.a[4]")
def spatial_neighbors(spark, sf_dir):
    r = doubles(spark, sf_dir).select("label", "vec_id", rect_of(F.col("e"), 0).alias("rect"))
    return ranges.spatial_pairs(r, ["label"], "vec_id", "rect", size=5.0)


@query("""SELECT 'r' || r_regionkey AS node, 0 AS depth, r_name AS path FROM region
    UNION ALL SELECT 'n' || n_nationkey, 1, r_name || '.' || n_name FROM nation JOIN region ON r_regionkey = n_regionkey
    UNION ALL SELECT 'c' || c_custkey, 2, r_name || '.' || n_name || '.' || c_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def form_full_names(spark, sf_dir):
    return trees.walk(_geography(spark, sf_dir), ["doc_id"]).select("node", "depth", "path")


@query("""WITH t AS (
    SELECT 'r' || r_regionkey AS node, NULL AS kind, r_regionkey AS r, -1 AS n, -1 AS c FROM region
    UNION ALL SELECT 'n' || n_nationkey, 'nation', n_regionkey, n_nationkey, -1 FROM nation
    UNION ALL SELECT 'c' || c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'nation' END, n_regionkey, c_nationkey, c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey)
    SELECT node, kind, row_number() OVER (ORDER BY r, n, c) AS place FROM t""")
def outline_depth_first(spark, sf_dir):
    """Depth-first place and inherited kind of every node of a tree."""
    nodes = trees.walk(_geography(spark, sf_dir), ["doc_id"], inherit=("kind",))
    return sequences.numbered(nodes, ["order"], "place").select("node", "kind", "place")


def _geography(spark, sf_dir):
    def rows(df, node, parent, order, name, kind):
        return df.select(F.lit(1).alias("doc_id"), node.alias("node"), parent.alias("parent"), order.cast("long").alias("ord"), name.alias("name"), kind.cast("string").alias("kind"))

    def tag(letter, key):
        return F.concat(F.lit(letter), F.col(key).cast("string"))

    null = F.lit(None).cast("string")
    kind = F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment"))
    return (
        rows(table(spark, sf_dir, "region"), tag("r", "r_regionkey"), null, F.col("r_regionkey"), F.col("r_name"), null)
        .union(rows(table(spark, sf_dir, "nation"), tag("n", "n_nationkey"), tag("r", "n_regionkey"), F.col("n_nationkey"), F.col("n_name"), F.lit("nation")))
        .union(rows(table(spark, sf_dir, "customer"), tag("c", "c_custkey"), tag("n", "c_nationkey"), F.col("c_custkey"), F.col("c_name"), kind))
    )


@query("""WITH b AS (SELECT p_partkey, (p_partkey % 256)::INTEGER AS byte FROM part)
    SELECT p_partkey, array_to_string([(byte >> s) & 1 for s in [7, 6, 5, 4, 3, 2, 1, 0]], ' ') AS one, array_to_string([(byte >> s) & 3 for s in [6, 4, 2, 0]], ' ') AS two, array_to_string([(byte >> s) & 15 for s in [4, 0]], ' ') AS four,
    -1.0 + byte::DOUBLE / 255.0 * (3.0 - -1.0) AS sample FROM b""")
def unpack_samples(spark, sf_dir):
    byte = (F.col("p_partkey") % 256).cast("int")
    return table(spark, sf_dir, "part").select(
        "p_partkey", *[F.array_join(samples.unpack_byte(byte, n).cast("array<string>"), " ").alias(k) for n, k in ((1, "one"), (2, "two"), (4, "four"))],
        samples.decode_sample(byte, F.lit(-1.0), F.lit(3.0), 8).alias("sample"),
    )


@query(RECTS + "SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY 0.5 * a[1] - 1.5 * (a[2] + a[4]), vec_id) AS place FROM r")
def reading_order(spark, sf_dir):
    """Boxes of a page by the flow score (1-f)*x0 - (1+f)*(y0+y1) with f = 0.5."""
    r = doubles(spark, sf_dir).select("vec_id", "label", rect_of(F.col("e"), 0).alias("a"))
    score = F.lit(0.5) * F.col("a")[0] - F.lit(1.5) * (F.col("a")[1] + F.col("a")[3])
    scored = r.select("vec_id", "label", score.alias("score"))
    return sequences.numbered(scored, ["score", "vec_id"], "place", by="label").select("vec_id", "label", "place")


@query("SELECT page_id, strlen(html)::BIGINT AS n_bytes, sha256(html) AS digest FROM pages")
def page_digests(spark, sf_dir):
    content = F.col("html").cast("binary")
    return table(spark, sf_dir, "pages").select("page_id", F.octet_length(content).cast("long").alias("n_bytes"), F.sha2(content, 256).alias("digest"))


@query("""SELECT sha256(string_agg(sha256(text), '' ORDER BY turn)) AS digest, conv_id, count(*) AS n FROM conversations GROUP BY conv_id""")
def ordered_digest(spark, sf_dir):
    """One digest per document over its pages' digests in page order."""
    pages = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(F.col("text").cast("binary"), 256).alias("d"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("turn", "d"))), lambda x: x["d"])
    return pages.groupBy("conv_id").agg(F.sha2(F.array_join(ordered, "").cast("binary"), 256).alias("digest"), F.count(F.lit(1)).alias("n"))
