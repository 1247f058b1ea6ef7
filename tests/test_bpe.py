import random

import pytest
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators import bpe, decode, encode, vocab
from loomtext.plans.options import EncodeOptions, Family, Padding
from loomtext.plans.vocabulary import public_file, public_vocabulary, small_merges

# The golden vocabulary.
VOCAB = {t: i for i, t in enumerate("l o w e r s t i d n lo l</w> w</w> r</w> t</w> low</w> er</w> lowest</w> newer</w> wider <unk> <|startoftext|> <|endoftext|>".split())}
MERGES = [("l", "o"), ("lo", "w</w>"), ("e", "r</w>")]
RANKS = {m: i for i, m in enumerate(MERGES)}
GOLDEN = {
    "lower newer": ("lo w er</w> n e w er</w>", [21, 10, 2, 16, 9, 3, 2, 16, 22]),
    "lone loner": ("lo n e</w> lo n er</w>", [21, 10, 9, 20, 10, 9, 16, 22]),
    "new low never hover": ("n e w</w> low</w> n e v er</w> h o v er</w>", [21, 9, 3, 12, 15, 9, 3, 20, 16, 20, 1, 20, 16, 22]),
}


def golden_rows(spark):
    df = spark.createDataFrame([(k,) for k in GOLDEN], "case string")
    pre = df.select("case", F.transform(T.word_end_pretokens(F.array_join(T.basic_tokens(F.col("case")), " ")), T.byte_encode).alias("words"))
    return pre.select("case", bpe.merged_words(F.col("words"), RANKS, bpe.WORD_END).alias("tokens"), bpe.merged_words(F.col("words"), RANKS, bpe.WORD_END, VOCAB, VOCAB["<unk>"]).alias("ids"))


def test_golden_tokens_and_ids(spark):
    rows = encode.prepare(golden_rows(spark), "ids", EncodeOptions(), Family.WORD_END, bos_id=21, eos_id=22).collect()
    assert {r["case"]: (" ".join(r.tokens), r.input_ids) for r in rows} == GOLDEN
    assert all(len(r.attention_mask) == len(r.input_ids) and set(r.token_type_ids) == {0} for r in rows)


def test_golden_padding(spark):
    rows = golden_rows(spark).withColumn("batch", F.lit(0))
    longest = encode.prepare(rows, "ids", EncodeOptions(padding=Padding.LONGEST), Family.WORD_END, bos_id=21, eos_id=22, pad_id=22, batch="batch").collect()
    assert {len(r.input_ids) for r in longest} == {14}
    assert all(r.input_ids == GOLDEN[r["case"]][1] + [22] * (14 - len(GOLDEN[r["case"]][1])) and sum(r.attention_mask) == len(GOLDEN[r["case"]][1]) for r in longest)
    fixed = encode.prepare(rows, "ids", EncodeOptions(padding=Padding.MAX_LENGTH, max_length=77), Family.WORD_END, bos_id=21, eos_id=22, pad_id=22).collect()
    assert {len(r.input_ids) for r in fixed} == {77}


def test_golden_round_trip(spark):
    rows = encode.prepare(golden_rows(spark).drop("tokens"), "ids", EncodeOptions(), Family.WORD_END, bos_id=21, eos_id=22).select("case", "input_ids")
    out = decode.decode(rows, ["case"], "input_ids", vocab.vocab_frame(spark, VOCAB), Family.WORD_END, skip_ids=[21, 22])
    assert {r["case"]: r.text for r in out.collect()}["lower newer"] == "lower newer"


def slow_merge(word, ranks, end=""):
    w = [*word[:-1], word[-1] + end]
    while len(w) > 1:
        best = min(zip(w, w[1:], strict=False), key=lambda p: ranks.get(p, 10**9))
        if best not in ranks:
            break
        out, i = [], 0
        while i < len(w):
            if i + 1 < len(w) and (w[i], w[i + 1]) == best:
                out.append(w[i] + w[i + 1])
                i += 2
            else:
                out.append(w[i])
                i += 1
        w = out
    return w


def test_merge_word_is_lowest_rank_first():
    rng = random.Random(3)
    for _ in range(300):
        syms, merges = list("abc"), []
        for _ in range(8):
            p = (rng.choice(syms), rng.choice(syms))
            if p not in merges:
                merges.append(p)
                syms.append(p[0] + p[1])
        ranks = {m: i for i, m in enumerate(merges)}
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
        assert bpe.merge_word(word, ranks) == slow_merge(word, ranks)


def test_fold_equals_merging(spark):
    merges = small_merges()
    words = ["Ġthe", "hello", "Ġthinning", "Ã©tÃ©", "a", "Ġ", "aaaa"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", bpe.fold_tokens(F.col("w"), merges).alias("t")).collect()
    ranks = {m: i for i, m in enumerate(merges)}
    assert {r.w: r.t for r in got} == {w: slow_merge(w, ranks) for w in words}


def test_public_vocabulary_equals_the_library(spark):
    from tokenizers import Tokenizer

    texts = ["Hello world, it's 2024!", "  two  spaces\n\nnew", "naïve café 😀", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    v, ranks = public_vocabulary()
    words = df.select("id", F.transform(T.byte_level_pretokens(F.col("text")), T.byte_encode).alias("words"))
    ids = words.select("id", bpe.merged_words(F.col("words"), ranks, vocab=v).alias("ids"))
    got = {r.id: r.ids for r in ids.collect()}
    lib = Tokenizer.from_file(public_file())
    assert got == {i: lib.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    tokens = words.select("id", bpe.merged_words(F.col("words"), ranks).alias("tokens"))
    for table in (v, vocab.vocab_frame(spark, v)):
        assert {r.id: r.ids for r in vocab.token_ids(tokens, ["id"], "tokens", table, None).collect()} == got


@pytest.mark.parametrize("as_table", [False, True])
def test_each_row_keeps_its_own_result_whatever_its_key(spark, as_table):
    rows = [(7, ["lo", "w"]), (7, ["e"]), (7, ["lo", "w"]), (None, ["r", "never"]), (None, None), (None, []), (7, ["e"])]
    df = spark.createDataFrame(rows, "id int, tokens array<string>")
    table = vocab.vocab_frame(spark, VOCAB) if as_table else VOCAB
    ids = vocab.token_ids(df, ["id"], "tokens", table, VOCAB["<unk>"])
    want = sorted(str((k, [VOCAB.get(t, VOCAB["<unk>"]) for t in ts or []])) for k, ts in rows)
    assert sorted(str((r.id, r.ids)) for r in ids.collect()) == want
    back = vocab.id_tokens(ids, ["id"], "ids", table, skip=[VOCAB["e"]])
    assert sorted(str((r.id, r.tokens)) for r in back.collect()) == sorted(str((k, [t if t in VOCAB else "<unk>" for t in ts or [] if t != "e"])) for k, ts in rows)
    text = decode.decode(ids, ["id"], "ids", table, Family.PLAIN, added=["<unk>"])
    assert sorted(str((r.id, r.text)) for r in text.collect()) == sorted(str((k, " ".join(t if t in VOCAB else "<unk>" for t in ts or []))) for k, ts in rows)


def test_missing_tokens_and_ids_are_errors(spark):
    df = spark.createDataFrame([(1, ["never"], [99])], "id int, tokens array<string>, ids array<int>")
    for table in (VOCAB, vocab.vocab_frame(spark, VOCAB)):
        with pytest.raises(Exception, match="unknown token"):
            vocab.token_ids(df, ["id"], "tokens", table, None).collect()
        with pytest.raises(Exception, match="no token has id"):
            vocab.id_tokens(df, ["id"], "ids", table).collect()


def test_pieces_equal_the_library():
    import sentencepiece

    from loomtext.sources.files import read_pieces

    path = public_file("piece_bpe_32k.model")
    lib, scores = sentencepiece.SentencePieceProcessor(model_file=path), read_pieces(path)
    for s in ("The quick brown fox", "lower newer", "éé x"):
        assert bpe.piece_tokens("▁" + s.replace(" ", "▁"), scores) == lib.encode(s, out_type=str)


def test_pieces_by_units_equal_pieces_of_whole_texts(spark, sf):
    from loomtext.sources.files import read_pieces

    scores = read_pieces(public_file("piece_bpe_32k.model"))
    texts = [r.text[:400] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(40).collect()] + ["a  b   c", " ", "▁ ▁x▁", "中文 😀\n\ttab"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.t for r in df.select("id", bpe.piece_column(T.piece_text(F.col("text")), scores).alias("t")).collect()}
    for i, x in enumerate(texts):
        assert got[i] == bpe.piece_tokens("▁" + x.replace("▁", " ").replace(" ", "▁"), scores)


def test_pairs(spark):
    got = spark.createDataFrame([(list("abab"),), (["a"],), ([],)], "s array<string>").select(bpe.pairs(F.col("s")).alias("p")).collect()
    assert [[tuple(x) for x in r.p] for r in got] == [[("a", "b"), ("b", "a")], [], []]


def test_add_tokens():
    added, n = vocab.add_tokens(VOCAB, [], ["new1", "low</w>", "", "new1", "NEW2"], lower=True)
    assert n == 2 and {t.content: t.id for t in added} == {"new1": 23, "low</w>": 15, "new2": 24}


def test_stretches_of_a_batch_give_what_the_whole_batch_gives(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, None if i % 11 == 0 else ["".join(rng.choices("then ", k=rng.randint(1, 5))) for _ in range(rng.randint(0, 12))]) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, w array<string>").coalesce(1)
    ranks = {m: r for r, m in enumerate(small_merges())}
    made = lambda: [(r.t, r.n) for r in df.select("i", bpe.merged_words(F.col("w"), ranks, raw=True).alias("t"), bpe.merged_words(F.col("w"), ranks, vocab=public_vocabulary()[0], raw=True).alias("n")).orderBy("i").collect()]
    whole = made()
    monkeypatch.setattr(bpe, "STRETCH", 5)
    assert made() == whole and whole[0] == (None, None) and sum(len(t) for t, _ in whole if t) > 200


def test_runs_between_added_tokens_are_decoded_from_ids(spark):
    v = {"a": 0, "b</w>": 1, "<s>": 2, "</s>": 3, "x": 5}
    df = spark.createDataFrame([(0, [2, 0, 1, 0, 3, 5]), (1, []), (2, None), (3, [2, 3]), (4, [5, 5, 2])], "i int, ids array<int>")
    got = lambda **o: [r.text for r in decode.decode(df, ["i"], "ids", v, added=("<s>", "</s>"), **o).orderBy("i").collect()]
    assert got(family=Family.PLAIN) == ["<s> a b</w> a </s> x", "", "", "<s> </s>", "x x <s>"]
    assert got(family=Family.WORD_END, skip_ids=[3]) == ["<s> ab ax", "", "", "<s>", "xx <s>"]
    assert "EvalPython" in (plan := decode.decode(df, ["i"], "ids", v, Family.PLAIN, added=("<s>",))._jdf.queryExecution().executedPlan().toString()) and "array<string>" not in plan
    with pytest.raises(Exception, match="no token has id 7"):
        decode.decode(spark.createDataFrame([(0, [2, 7])], "i int, ids array<int>"), ["i"], "ids", v, Family.PLAIN, added=("<s>",)).collect()
