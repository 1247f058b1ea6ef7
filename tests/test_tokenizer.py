import pytest
from pyspark.sql import functions as F

from loomtext.operators.tokenizer import Tokenizer, load
from loomtext.plans.options import AddedToken, EncodeOptions, Family, Padding, TokenizerConfig
from loomtext.plans.vocabulary import public_file
from tests.test_bpe import GOLDEN, RANKS, VOCAB

CONFIG = TokenizerConfig(bos_token=AddedToken("<|startoftext|>", special=True), eos_token=AddedToken("<|endoftext|>", special=True), unk_token=AddedToken("<unk>", special=True), pad_token=AddedToken("<|endoftext|>", special=True))


@pytest.fixture(scope="module")
def golden():
    return Tokenizer(Family.WORD_END, VOCAB, RANKS, config=CONFIG)


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "id int, text string")


def test_golden(spark, golden):
    out = golden.encode(texts(spark, *GOLDEN), ["id"]).orderBy("id").collect()
    assert [r.input_ids for r in out] == [ids for _, ids in GOLDEN.values()]
    back = golden.decode(spark.createDataFrame([(1, out[0].input_ids)], "id int, input_ids array<int>"), ["id"], skip_special=True)
    assert back.first().text == "lower newer"


def test_added_tokens_pairs_targets(spark, golden):
    more = golden.add_tokens(["[NEW]", "low</w>"])
    assert more.whole_vocab()["[NEW]"] == 23
    df = texts(spark, "low [NEW] newer", "").withColumn("other", F.lit("lower"))
    rows = {r.id: r for r in more.encode(df, ["id"], pair="other", target="other").collect()}
    assert rows[0].input_ids == [21, 15, 23, 9, 3, 2, 16, 22, 22, 10, 2, 16, 22] and rows[0].labels == [10, 2, 16]
    assert rows[1].input_ids == [21, 22, 22, 10, 2, 16, 22]
    longest = more.encode(df.withColumn("b", F.lit(1)), ["id"], options=EncodeOptions(padding=Padding.LONGEST), batch="b").collect()
    assert len({len(r.input_ids) for r in longest}) == 1


def test_byte_level_equals_the_library(spark):
    from tokenizers import Tokenizer as Library

    t = Tokenizer.from_json(public_file(), Family.BYTE_LEVEL, TokenizerConfig(eos_token=AddedToken("<|endoftext|>", special=True)))
    lib = Library.from_file(public_file())
    rows = ["Hello there, it's 12!", "a <|endoftext|> b", "é 😀\n\nx", ""]
    got = {r.id: r.ids for r in t.ids(texts(spark, *rows), ["id"]).collect()}
    assert got == {i: lib.encode(x, add_special_tokens=False).ids for i, x in enumerate(rows)}
    ids = spark.createDataFrame([(i, got[i]) for i in got], "id int, input_ids array<int>")
    assert {r.id: r.text for r in t.decode(ids, ["id"], clean_up=False).collect()} == dict(enumerate(rows))


def test_load(spark):
    t = load(public_file("piece_bpe_32k.model"), TokenizerConfig(tokenizer_class="LlamaTokenizer", add_bos_token=True, bos_token=AddedToken("<s>", special=True), unk_token=AddedToken("<unk>", special=True)))
    row = t.encode(texts(spark, "The quick fox"), ["id"]).first()
    assert row.input_ids[0] == 1 and len(row.attention_mask) == len(row.input_ids)
    with pytest.raises(ValueError):
        load(public_file(), TokenizerConfig(tokenizer_class="Other"))


SCRIPTS = ["hi \u0c85\U0001f9a9 x", "plain words, twice  spaced", " leading", "", "\u0416\u0438\u0432 \u4e2d\u6587 \u0e44\u0e17\u0e22", "<0x41> <0xZZ>", "tab\tand\nline", "\ue000 private \U00010ffd", "e\u0301 \u00e9"]


def test_pieces_decode_their_bytes(spark):
    """Piece ids back to text, through bytes where no piece has a character: the library's text, and broken bytes replaced as Python does."""
    import sentencepiece

    path = public_file("piece_bpe_32k.model")
    own, lib = Tokenizer.from_pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(i, lib.encode(t)) for i, t in enumerate(SCRIPTS)]
    ids = spark.createDataFrame([*rows, (100, [3 + 0xE4, 3 + 0xB8, 3 + 0x41, 3 + 0xFF]), (101, None)], "id int, input_ids array<int>")
    got = {r.id: r.text for r in own.decode(ids, ["id"]).collect()}
    for i, x in rows:
        assert got[i] == lib.decode(x), SCRIPTS[i]
    assert got[100] == bytes([0xE4, 0xB8, 0x41, 0xFF]).decode("utf-8", "replace") and got[101] == ""
    more = own.add_tokens(["[NEW]"])  # runs between added tokens go another way
    again = {r.id: r.text for r in more.decode(ids, ["id"]).collect()}
    assert all(again[i] == got[i] for i in got)


def test_units_that_begin_with_the_marker(spark):
    for added in ([], ["cd"], ["\ue000"]):
        own = Tokenizer.from_json(public_file(), Family.BYTE_LEVEL).add_tokens(added)
        for text in ("ab\ue000cd", "\ue000ab", "\ue000", "\ue000+x"):
            ids = own.ids(texts(spark, text), ["id"])
            assert own.decode(ids.withColumnRenamed("ids", "input_ids"), ["id"], spaces_between=False).first().text == text, (added, text)
