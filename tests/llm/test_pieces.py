import random

import numpy as np
import pytest
import sentencepiece

from pagequarry.llm import sentencepiece_dropout as pieces
from tests.llm import texts

PATH = pieces.default_model()
SAMPLES = [
    *(r[1] for r in texts.rows() if r[1] is not None and len(r[1]) < 5000),
    "a" * 3000,
    "thes" * 300 + " b",
    "   lead and trail  ",
    "café ñandú\tTab\r\n日本語\U0001f600",
]


@pytest.fixture(scope="module")
def model():
    return pieces.load(PATH)


def test_without_dropout_equals_the_library(model):
    own = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = pieces.Segmenter(model, 0.0, 0).encode(SAMPLES, [0] * len(SAMPLES))
    for text, ids in zip(SAMPLES, got):
        assert pieces.decode_ids(model, ids) == text
        if pieces.SPACE not in text:
            assert ids == own.encode(text)


@pytest.mark.parametrize("dropout", [0.1, 0.5, 1.0])
def test_dropout_varies_and_decodes_losslessly(model, dropout):
    got = pieces.Segmenter(model, dropout, 7).encode(SAMPLES, [i % 2 for i in range(len(SAMPLES))])
    assert [pieces.decode_ids(model, x) for x in got] == SAMPLES
    again = pieces.Segmenter(model, dropout, 7).encode(SAMPLES[::-1], [i % 2 for i in range(len(SAMPLES))][::-1])
    assert again[::-1] == got  # neither order nor company of texts matters
    assert pieces.Segmenter(model, dropout, 8).encode(SAMPLES, [0] * len(SAMPLES)) != got or dropout == 1.0


def test_rounds_equal_the_heap(model):
    rng = random.Random(3)
    segmenter = pieces.Segmenter(model, 0.3, 5)
    for _ in range(200):
        unit = " " + "".join(rng.choice("theationsingr") for _ in range(rng.randint(1, 40)))
        chars = np.frombuffer(unit.encode("utf-32-le"), np.uint32)
        key = pieces.unit_keys(chars, np.arange(len(chars)), np.zeros(1, np.int64), 5, 0)[0]
        want = pieces.segment_long(model, model.of_char[chars].tolist(), key, 0.3)
        assert segmenter.units([unit], 0)[unit] == tuple(p for p, _ in want)


def test_frames(spark):
    df = texts.frame(spark).withColumnRenamed("base", "t")
    out = pieces.encode(df, check=True)
    assert [c for c in out.columns if c not in ("ids", "lossless")] == df.columns
    rows = out.collect()
    assert all(r.lossless for r in rows) and next(r for r in rows if r.text is None).ids is None
    back = {(r.doc_id): r.text for r in pieces.decode(out.drop("text")).collect()}
    assert back == {r[0]: r[1] for r in texts.rows()}
    assert pieces.encode(df.limit(0)).count() == 0


def test_clashing_columns_stay(spark):
    df = spark.createDataFrame([(1, "some text", "own", 3, "r"), (None, None, "own", 4, "r")], "doc_id long, text string, ids string, lossless int, row string")
    out = pieces.encode(df, check=True)
    assert out.columns == [*df.columns, "ids_", "lossless_"]
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].ids == "own" and got[1].lossless == 3 and got[1].lossless_ and len(got[1].ids_) > 0 and got[None].ids_ is None


def test_every_occurrence_draws_anew(model):
    word, n = " segmentation", 400
    segmenter = pieces.Segmenter(model, 0.3, 1)
    cuts = segmenter.encode([word[1:] + word * (n - 1)] * 3, [5, 6, 6])
    assert cuts[0] != cuts[1] and cuts[1] == cuts[2]
    starts = [i for i, p in enumerate(cuts[0]) if model.pieces[p].startswith(pieces.SPACE)]
    forms = {tuple(cuts[0][a:b]) for a, b in zip(starts, [*starts[1:], len(cuts[0])])}
    assert len(starts) == n and len(forms) > 20


def test_copies_in_the_pipeline_differ(spark):
    import corpus_pipeline

    text = " ".join(["segmentation of ordinary words"] * 50)
    docs = spark.createDataFrame([(1, "s", text)] * 4 + [(2, "s", text)], "doc_id long, source string, text string")
    ids = [tuple(r.ids) for r in corpus_pipeline.encode_pieces(spark, docs.repartition(3), "").collect()]
    assert len(set(ids)) == 5
    again = [tuple(r.ids) for r in corpus_pipeline.encode_pieces(spark, docs.coalesce(1), "").collect()]
    assert sorted(ids) == sorted(again)
