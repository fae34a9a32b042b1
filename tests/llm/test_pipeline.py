
import corpus_pipeline
from pagequarry.llm import sentencepiece_dropout as pieces
from tests.llm import brute, texts
from tests.llm.test_mixing import brute_count
from tests.llm.test_near_dedup import brute as near_brute
from tests.llm.test_quality_rules import brute as quality_brute


def test_stages_against_brute_force(spark, tmp_path):
    rows = [r[:5] for r in {r[0]: r for r in texts.rows()}.values()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = df, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        seen[name] = docs = spark.read.parquet(str(tmp_path / name))
    assert len(corpus_pipeline.STAGES) == 5
    for name in list(seen)[:4]:
        assert sorted(seen[name].columns) == sorted(df.columns)

    text_of = {r[0]: r[1] for r in rows}
    kept = {r.doc_id for r in seen["quality_rules"].collect()}
    for i in kept:
        n, _, _, _, repeat = quality_brute(text_of[i])
        assert n >= 10 and 100 * repeat <= 20 * n
    near = near_brute([(i, text_of[i]) for i in kept], 5, 80)
    single = {r.doc_id for r in seen["near_duplicates"].collect()}
    assert single == {i for i, (_, c) in near.items() if c == i}

    redacted = {r.doc_id: r.text for r in seen["private_data"].collect()}
    assert set(redacted) == single
    for i, text in redacted.items():
        want, at = [], 0
        for a, e, k in sorted((a, e, k) for _, a, k, e in brute.pii_base(text_of[i])):
            if a >= at:
                want += [text_of[i][at:a], f"[{k.upper()}]"]
            at = max(at, e)
        assert text == "".join(want) + text_of[i][at:]

    source = {r[0]: r[3] for r in rows}
    sizes = {s: sum(source[i] == s for i in single) for s in {source[i] for i in single}}
    mixed = [r.doc_id for r in seen["source_mixture"].collect()]
    for i in single:
        assert mixed.count(i) == brute_count(i, len(single) / len(sizes) / sizes[source[i]])

    model = pieces.load(pieces.default_model())
    encoded = seen["piece_encoding"].collect()
    assert sorted(r.doc_id for r in encoded) == sorted(mixed)
    assert all(pieces.decode_ids(model, r.ids) == redacted[r.doc_id] for r in encoded)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(mixed)


def test_empty_documents(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
