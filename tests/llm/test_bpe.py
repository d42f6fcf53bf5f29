import os

import pytest

from framewright.llm import bpe, packing

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary here")
TEXTS = ["The wide camera.", "", None, "  two  blanks\n\n\tand tabs ", "<|endoftext|> is text", "日本語のテキスト" * 50, "a" * 3000, "é é 👨‍👩‍👧 ½ ﬁ", "it's we'll I'D 12345678901234567890", "​\x00\x7f"]
SCHEMA = "doc_id long, text string, ids string"


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.parse_ranks(bpe.read_ranks()))


def test_equals_two_public_libraries(encoder):
    import tiktoken
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(os.path.dirname(bpe.VOCABULARY), "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    k = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    for text in TEXTS:
        ids = encoder.encode(text)
        assert ids == (t.encode(text, add_special_tokens=False).ids if text else [])
        assert ids == (k.encode_ordinary(text) if text else [])
        assert encoder.decode(ids) == (text or "")


def test_one_row_per_row(spark):
    rows = [(i, x, "c") for i, x in enumerate(TEXTS)] + [(0, TEXTS[0], "c"), (None, "null id", "c")]
    found = bpe.encode_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows) and {r["doc_id"]: len(r["ids"]) for r in found}[1] == 0
    assert bpe.round_trips(spark.createDataFrame(rows, SCHEMA)).where("not same").count() == 0
    assert bpe.encode_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_packing_keeps_every_token(spark, encoder):
    rows = [(i, "word " * (1 + i * 7 % 90), "x") for i in range(200)] + [(500, "long " * 2500, "x"), (501, None, "x"), (502, "", "x"), (500, "long " * 2500, "x")]
    boxes = spark.createDataFrame([(1, "small", 64), (2, "large", 1024), (3, "none", None)], "container_id int, container_name string, capacity_tokens int")
    packed = packing.pack_documents(spark.createDataFrame(rows, SCHEMA), boxes).toPandas()
    want = {i: len(encoder.encode(x)) for i, x, _ in rows if x}
    for c, capacity in ((1, 64), (2, 1024)):
        own = packed[packed.container_id == c]
        assert own.groupby("doc_id").n_tokens.sum().to_dict() == want
        assert own.groupby("sequence_id").n_tokens.sum().max() <= capacity
        for doc, pieces in own.sort_values("piece_no").groupby("doc_id"):
            assert (len(pieces) == 1) == (want[doc] <= capacity)
            assert pieces.first_token.tolist() == (pieces.n_tokens.cumsum() - pieces.n_tokens).tolist()
    assert set(packed.container_id) == {1, 2}
    report = packing.fill_report(spark.createDataFrame(packed), boxes).collect()
    fill = {r["container_id"]: r["fill"] for r in report}
    assert fill[1] > 0.9 and fill[2] > 0.8
    assert all(r["packed_fill"] <= r["fill"] and r["packed_sequences"] <= r["sequences"] for r in report)


def test_packing_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    boxes = spark.createDataFrame([(1, 64)], "container_id int, capacity_tokens int")
    assert packing.pack_documents(none, boxes).count() == 0
    assert packing.pack_documents(spark.createDataFrame([(1, "a", "")], SCHEMA), boxes.where("container_id > 5")).count() == 0
