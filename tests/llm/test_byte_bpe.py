import hashlib
import random

import numpy as np
import pytest
import tiktoken

from pagequarry.llm import byte_bpe
from tests.llm import texts

SAMPLES = [
    *(r[1] for r in texts.rows() if r[1] is not None),
    "",
    "a" * 5000,
    "segmentation" * 400 + " b",
    "   lead and  trail  \r\n\t\n\n x",
    "café ñandú's we'll I'D 123456 ٣٤ ½",
    "日本語のテキスト。\U0001f600\U0001f468‍\U0001f469‍\U0001f467 <|endoftext|>",
    "-" * 300 + "=" * 257 + " " * 700 + "x",
    "".join(map(chr, range(1, 0x500))),
]


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.load(byte_bpe.default_ranks())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=byte_bpe.default_pattern(), mergeable_ranks=ranks.of, special_tokens={})


def test_equals_the_library(ranks, library):
    encoder = byte_bpe.Encoder(ranks, byte_bpe.default_pattern())
    want = [library.encode_ordinary(t) for t in SAMPLES]
    assert encoder.encode(SAMPLES) == want
    assert encoder.encode(SAMPLES[::-1]) == want[::-1]  # from the pieces remembered
    for t, ids in zip(SAMPLES, want):
        assert ranks.text_bytes(np.array(ids, np.int64)).tobytes().decode() == t


def test_rows_and_heap_equal_plain_merging(ranks):
    rng = random.Random(5)
    parts = [t for t in ranks.of if len(t) > 1][:4000:7]
    pieces = [b"".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))[:250] for _ in range(300)] + [bytes([b, 255 - b, b]) for b in range(0, 256, 5)]

    def plain(piece):
        cells = [bytes([b]) for b in piece]
        while True:
            found = [(ranks.of[a + b], i) for i, (a, b) in enumerate(zip(cells, cells[1:])) if a + b in ranks.of]
            if not found:
                return [ranks.of[c] for c in cells]
            i = min(found)[1]
            cells[i : i + 2] = [cells[i] + cells[i + 1]]

    encoder = byte_bpe.Encoder(ranks, byte_bpe.default_pattern(), kept=10)
    ids, sizes = encoder.pieces(pieces)
    got = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    for piece, own in zip(pieces, got):
        assert own == plain(piece) == byte_bpe.merge_long(ranks, piece)


def test_pairs_probe_past_each_other():
    n = 5000
    left, right = np.arange(n, dtype=np.int32), np.arange(n, dtype=np.int32)[::-1].copy()
    pairs = byte_bpe.Pairs(left, right, np.arange(n, dtype=np.int32))
    assert pairs.of(left, right).tolist() == list(range(n))
    assert set(pairs.of(right[: n // 2] + 1, right[: n // 2]).tolist()) <= {int(byte_bpe.NONE)}
    assert pairs.of(np.array([-1, 0]), np.array([0, -1])).tolist() == [byte_bpe.NONE] * 2


def test_report_against_the_library(spark, library):
    got = sorted(byte_bpe.report(texts.frame(spark)).collect(), key=lambda r: r.doc_id)
    rows = sorted(texts.rows(), key=lambda r: r[0])
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    for r, row in zip(got, rows):
        ids = library.encode_ordinary(row[1] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((row[1] or "").encode()).hexdigest()
    assert byte_bpe.report(texts.frame(spark, [])).count() == 0


def test_frames_round_trip_and_keep_clashing_columns(spark, library):
    df = spark.createDataFrame([(1, "some text  here", "own", "r"), (2, None, "own", "r"), (2, "", "own", None), (None, "é" * 90_000, "own", "r")], "doc_id long, text string, ids string, row string")
    out = byte_bpe.encode(df)
    assert out.columns == [*df.columns, "ids_"]
    back = byte_bpe.decode(out, ids="ids_").collect()
    assert len(back) == 4
    for r in back:
        assert r.ids == "own" and (r.ids_ is None) == (r.text is None)
        if r.text is not None:
            assert list(r.ids_) == library.encode_ordinary(r.text) and bytes(r.decoded).decode() == r.text
    assert byte_bpe.encode(df.limit(0)).count() == 0
