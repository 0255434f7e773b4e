import random

import pytest
import sentencepiece

from voxelgrain.llm import sentencepiece_codec as codec
from voxelgrain.llm.entry import piece_model_path

PATH = piece_model_path()
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
CASES = [
    "", " ", "  lead", "a  b   c", "line\n\nnext\ttab\r\n", "\x00a", "▁x ▁", "日本語 ñ 🙂", "<s>hi</s><0x41>", "　 aﬁ",
    " " * 45 + "x" + " " * 33, "aaaa" * 700, "membres membres", "=" * 300, "1234567890" * 40, "\n" * 50, "ab" * 2000 + "ba" * 99, "é" * 40,
]


def compare(texts):
    model = codec.PieceModel(PATH)
    for text, ids in zip(texts, model.encode_all(texts), strict=True):
        want = LIBRARY.encode(text)
        assert ids.tolist() == want, repr(text[:80])
        assert model.decode(ids) == LIBRARY.decode(want), repr(text[:80])


def test_hard_cases():
    compare(CASES)


def test_random_texts():
    rng = random.Random(5)
    pieces = [LIBRARY.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    texts += ["".join(rng.choice("aeiounstr l-\n é=*") for _ in range(rng.randint(1, 200))) for _ in range(2000)]
    texts += ["".join(chr(rng.randint(32, 0x2FFF)) for _ in range(40)) for _ in range(200)]
    compare(texts)


def test_decode_of_any_ids():
    rng, model = random.Random(6), codec.PieceModel(PATH)
    import numpy as np

    for _ in range(2000):
        ids = [rng.choice((rng.randint(1, 258), rng.randint(259, 31999))) for _ in range(rng.randint(0, 12))]
        assert model.decode(np.array(ids, int)) == LIBRARY.decode(ids), ids


def test_operator(spark):
    rows = [(1, None), (2, ""), (3, "x  y"), (3, "x  y"), (None, "z"), (5, "w" * 30000)]
    df = spark.createDataFrame([(a, b, "extra") for a, b in rows], "doc_id long, text string, ids string")
    encoded = codec.encode(df, PATH)
    got = [(r.doc_id, r.ids) for r in encoded.collect()]
    assert sorted(got, key=repr) == sorted([(a, LIBRARY.encode(b or "")) for a, b in rows], key=repr)
    assert sorted((r.doc_id or 0, r.text) for r in codec.decode(encoded, PATH).collect()) == sorted((a or 0, b or "") for a, b in rows)
    digests = codec.digests(df, PATH)
    assert digests.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and digests.count() == 6
    assert codec.digests(df.limit(0), PATH).count() == 0


def test_unsupported_model(tmp_path):
    with pytest.raises(Exception):  # noqa: B017
        codec.PieceModel(str(tmp_path / "none.model"))
