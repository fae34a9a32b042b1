"""The numbered queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm import byte_bpe, conversation_repair, language_id, license_scan, merkle, mixing, near_dedup, pii, quality_model, quality_rules, secret_scan, topk
from pagequarry.llm import sentencepiece_dropout as pieces


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(table(spark, sf_dir, "documents")).withColumn(
        "failed_rules", F.array_join("failed_rules", ",")
    )


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), check=True)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "lossless")


def equal_targets(docs: DataFrame) -> DataFrame:
    """Equal weight for every source that occurs."""
    return docs.select("source").distinct().withColumn("weight", F.lit(1.0))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, equal_targets(docs))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.report(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.report(conversation_repair.damage(table(spark, sf_dir, "conversations")))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(table(spark, sf_dir, "documents"))


QUERIES = {
    "op2_license_scan": op2_license_scan,
    "op1_language_id": op1_language_id,
    "op5_quality_model": op5_quality_model,
    "op3_secret_scan": op3_secret_scan,
    "op4_near_dedup": op4_near_dedup,
    "op6_mixing": op6_mixing,
    "op8_sentencepiece": op8_sentencepiece,
    "op7_pii": op7_pii,
    "op9_topk": op9_topk,
    "op10_quality_rules": op10_quality_rules,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_merkle": op13_merkle,
}

#: The metrics that rules name, in SQL over the columns of the query below.
METRIC_SQL = {
    "n_words": "n::DOUBLE",
    "mean_word_length": "chars / greatest(n, 1)",
    "symbol_word_ratio": "symbols / greatest(n, 1)",
    "repeat_word_ratio": "repeated / greatest(n, 1)",
    "stop_word_ratio": "stops / greatest(n, 1)",
    "letter_ratio": "(chars - others) / greatest(chars, 1)",
    "upper_letter_ratio": "uppers / greatest(chars, 1)",
    "dup_line_ratio": "dups / greatest(lines, 1)",
    "bullet_line_ratio": "bullets / greatest(lines, 1)",
}


def quality_rules_sql() -> str:
    """The rule table as SQL."""
    broken = []
    for r in quality_rules.DEFAULT_RULES:
        tests = [f"{METRIC_SQL[r.metric]} < {r.low}"] if r.low is not None else []
        tests += [f"{METRIC_SQL[r.metric]} > {r.high}"] if r.high is not None else []
        latin = " AND 2 * strange <= chars - others" if r.latin else ""
        broken.append(f"CASE WHEN ({' OR '.join(tests)}){latin} THEN '{r.metric}' END")
    stops = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
    return rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT doc_id, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
            list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
        i AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w),
        g AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM i),
        r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
        c AS (SELECT doc_id, count(DISTINCT p) AS repeated FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r) GROUP BY ALL),
        j AS (SELECT *, array_to_string(ws, '') AS joined FROM w),
        m AS (SELECT doc_id, len(ws) AS n, length(joined) AS chars, length(regexp_replace(joined, '[\p{{L}}\p{{M}}]+', '', 'g')) AS others,
            length(regexp_replace(joined, '[\p{{Latin}}\p{{M}}\P{{L}}]+', '', 'g')) AS strange,
            length(regexp_replace(joined, '[^#*$%&|<>]+', '', 'g')) AS symbols, length(regexp_replace(joined, '\P{{Lu}}+', '', 'g')) AS uppers,
            len(list_filter(ws, lambda x: lower(x) IN ({stops}))) AS stops, len(ls) AS lines, len(ls) - len(list_distinct(ls)) AS dups,
            len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•‣|]'))) AS bullets, coalesce(repeated, 0) AS repeated
            FROM j LEFT JOIN c USING (doc_id)),
        f AS (SELECT *, n < 10 OR 100 * repeated > 20 * n AS base_failed,
            array_to_string(list_filter([{", ".join(broken)}], lambda x: x IS NOT NULL), ',') AS failed_rules FROM m)
        SELECT doc_id, n::BIGINT AS n_words, chars::BIGINT AS word_chars, symbols::BIGINT AS n_symbols, dups::BIGINT AS n_dup_lines,
            repeated::BIGINT AS n_repeat_words, base_failed, failed_rules, NOT base_failed AND failed_rules = '' AS kept FROM f
    """


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of a string of ASCII characters; ``t`` of the table ``crc`` must be in scope."""
    return (
        f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT)),"
        " lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT)"
    )


#: The table of the reflected polynomial, one entry per byte.
CRC_TABLE = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS t)"""


def conversation_repair_sql() -> str:
    """The dynamic programme forward: the least cost and audit that end in each state, after every turn."""

    def then(state: str, cost: str, edit: str) -> str:
        return f"lpad((left({state}, 9)::INT + {cost})::VARCHAR, 9, '0') || substr({state}, 10) || '{edit}'"

    stay, other = "(3 * (f = 'truncated')::INT)", "CASE WHEN q = 2 THEN 3 ELSE 2 END"
    kept = {1: ("s", ["z0"]), 2: ("u", ["z0", "z1", "z3"]), 3: ("a", ["z2"])}
    sources = {2: ["z0", "z1", "z3"], 3: ["z2"]}
    steps = []
    for q in range(4):
        ways = [then(f"z{q}", "4", "D")]
        initial, before = kept.get(q, ("", []))
        ways += [f"CASE WHEN NOT coalesce(f IN ('blank', 'duplicate'), FALSE) AND c = '{initial}' THEN {then(x, f'coalesce({stay}, 0)', 'K')} END" for x in before]
        ways += [f"CASE WHEN NOT coalesce(f IN ('blank', 'duplicate'), FALSE) THEN {then(x, f'3 + coalesce({stay}, 0)', 'R')} END" for x in sources.get(q, [])]
        steps.append(f"least({', '.join(ways)}, NULL) AS z{q}")

    def inserted(table: str) -> str:
        """``table`` with turns inserted behind what it has."""
        user = f"least(z2, {', '.join(then(x, '3', 'I') for x in ('z0', 'z1', 'z3'))})"
        return f"SELECT k, i, z0, z1, z2, least(z3, {then('z2', '3', 'I')}) AS z3 FROM (SELECT k, i, z0, z1, {user} AS z2, z3 FROM {table})"

    return rf"""
        WITH RECURSIVE {CRC_TABLE},
        o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') AS k,
            {crc32_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS code FROM conversations, crc),
        d AS (SELECT k, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN ''
            WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM o),
        n AS (SELECT *, left(role, 1) AS c, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
        e AS (SELECT *, row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 AS seen, lag(c) OVER (PARTITION BY k ORDER BY i) AS l,
            regexp_extract(text, '([^ 	-])[ 	-]*$', 1) AS last FROM n),
        t AS (SELECT k, i, turn, role, text, c, l, CASE WHEN last = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' END AS f FROM e),
        a AS (SELECT k, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'blank') AS blank,
            count(*) FILTER (f = 'duplicate') AS duplicate, count(*) FILTER (f = 'truncated') AS truncated,
            count(*) FILTER (i > 1 AND l || c NOT IN ('su', 'ua', 'au')) AS illegal FROM t GROUP BY k),
        z AS (
            SELECT * FROM (WITH s AS (SELECT DISTINCT k, 0::BIGINT AS i, '000000000' AS z0, NULL::VARCHAR AS z1, NULL::VARCHAR AS z2, NULL::VARCHAR AS z3 FROM o) {inserted("s")})
            UNION ALL
            SELECT * FROM (WITH s AS (SELECT z.k, t.i, {", ".join(steps)} FROM z JOIN t ON t.k = z.k AND t.i = z.i + 1) {inserted("s")})
        ),
        b AS (SELECT z.k, left(least(z0, z3), 9)::BIGINT AS cost, substr(least(z0, z3), 10) AS audit FROM z LEFT JOIN a USING (k) WHERE z.i = coalesce(n, 0)),
        w AS (
            SELECT k, audit, 1 AS p, 0::BIGINT AS i, 0 AS q, []::VARCHAR[] AS parts FROM b
            UNION ALL
            SELECT w.k, audit, p + 1, w.i + (audit[p] <> 'I')::INT, CASE audit[p] WHEN 'D' THEN q WHEN 'K' THEN CASE c WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE {other} END,
                CASE audit[p] WHEN 'D' THEN parts WHEN 'K' THEN list_append(parts, role || ':' || text)
                ELSE list_append(parts, CASE WHEN q = 2 THEN 'assistant:' ELSE 'user:' END || CASE audit[p] WHEN 'I' THEN '' ELSE text END) END
            FROM w LEFT JOIN t ON t.k = w.k AND t.i = w.i + 1 WHERE p <= length(audit)
        )
        SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
            coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, cost, b.audit,
            sha256(array_to_string(parts, chr(10))) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id, k FROM o) o JOIN b USING (k) LEFT JOIN a USING (k) JOIN w ON w.k = o.k AND w.p = length(b.audit) + 1
    """


def merkle_sql(low: int = 7, high: int = 4) -> str:
    """Trees of up to ``low`` levels a value and ``high`` levels above them, level by level."""

    def part(column: str) -> str:
        return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"

    def leaf_sql(text: str) -> str:
        return "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def levels(first: str, name: str, n: int) -> list[str]:
        """``first`` has k, i, h; gives tables name0.. with siblings and name{n} with what remains."""
        out, below = [], first
        for j in range(n):
            run = "PARTITION BY k, i // 8 ORDER BY i ROWS BETWEEN"
            out.append(
                f"""{name}{j} AS (SELECT k, i, h, count(*) OVER (PARTITION BY k) AS m,
                coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
                coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM {below}),
                {name}_up{j} AS (SELECT k, i // 8 AS i, CASE WHEN m = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h
                FROM {name}{j} GROUP BY k, i // 8, m)"""
            )
            below = f"{name}_up{j}"
        return out

    joins = [f"x{j} t ON t.k = f.k AND t.i = f.i // {8**j}" for j in range(low)]
    joins += [f"y{j} t ON t.i = f.v // {8**j}" for j in range(high)]
    steps = ["f0 AS (SELECT k, i, v, doc_id, leaf, subroot, new AS h, '' AS p FROM g)"]
    steps += [
        f"""f{j + 1} AS (SELECT f.k, f.i, v, doc_id, leaf, subroot, CASE WHEN m = 1 THEN f.h ELSE sha256(a || f.h || b) END AS h,
            CASE WHEN m = 1 THEN p ELSE p || a || b END AS p FROM f{j} f JOIN {join})"""
        for j, join in enumerate(joins)
    ]
    return f"""
        WITH {CRC_TABLE},
        d AS (SELECT *, CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 3 = 0
            THEN translate(text, '{merkle.UPPER}', '{merkle.LOWER}') ELSE text END AS changed FROM documents, crc),
        l AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS k, {leaf_sql("text")} AS h, {leaf_sql("changed")} AS new FROM d),
        o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, h) - 1 AS i FROM l),
        {", ".join(levels("o", "x", low))},
        r AS (SELECT k AS value, h FROM x_up{low - 1}),
        s AS (SELECT 0 AS k, value, h, row_number() OVER (ORDER BY value) - 1 AS i FROM r),
        {", ".join(levels("s", "y", high))},
        g AS (SELECT o.k, o.i, s.i AS v, o.doc_id, o.h AS leaf, s.h AS subroot, o.new FROM o JOIN s ON s.value = o.k),
        {", ".join(steps)}
        SELECT doc_id, leaf, subroot, root.h AS root, sha256(p) AS proof_sha256, f.h AS folded_root, f.h = root.h AS verified
        FROM f{low + high} f, (SELECT h FROM y_up{high - 1}) root
    """


ORACLE_SQL: dict[str, str] = {
    "op12_conversation_repair": conversation_repair_sql(),
    "op13_merkle": merkle_sql(),
    "op10_quality_rules": quality_rules_sql(),
    "op6_mixing": """
        WITH RECURSIVE c AS (SELECT source, count(*) AS n FROM documents GROUP BY ALL),
        r AS (SELECT source, (SELECT sum(n) FROM c) * 1.0::DOUBLE / (SELECT count(*) FROM c)::DOUBLE / n AS rate FROM c),
        u AS (
            SELECT d.*, rate, ('0x' || substr(md5('mix:' || doc_id || ':1'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
            FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source
        ), k AS (
            SELECT doc_id, u, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS cdf FROM u
            UNION ALL
            SELECT doc_id, u, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM k WHERE u >= cdf AND k < 64
        ), n AS (SELECT doc_id, max(k) AS k FROM k GROUP BY ALL),
        e AS (SELECT doc_id, unnest(range(1, k + 1))::INTEGER AS copy FROM n)
        SELECT d.*, copy, md5('mix:order:' || doc_id || ':' || copy) AS shuffle_key FROM documents d JOIN e USING (doc_id)
    """,
    "op4_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
        ), s AS (
            SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
                ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END) AS g FROM w
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
        p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
        l AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
        r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT r.doc_id, l.v FROM r JOIN l ON l.u = r.c),
        m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY ALL)
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
        FROM m LEFT JOIN n USING (doc_id)
    """,
    "op9_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
        )
        SELECT query_id, rank, vec_id, score FROM (
            SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s
        ) WHERE rank <= 20
    """,
}
