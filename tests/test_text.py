import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from loomtext.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()[0]


def test_byte_alphabet():
    a = T.byte_alphabet()
    assert len(set(a)) == 256
    assert a[33] == "!" and a[32] == "Ġ" and a[127] == "ġ" and a[173] == "Ń" and a[0] == "Ā"
    assert all(a[b] == chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256)))


@pytest.mark.parametrize("s", ["plain", "", "naïve café\n", "emoji 😀 ok", "\u0000 x", "Ελλάς"])
def test_byte_round_trip(spark, s):
    assert one(spark, s, lambda c: T.byte_decode(T.byte_encode(c))) == s
    assert one(spark, s, lambda c: T.byte_decode_lossy(T.byte_encode(c))) == s


def test_byte_decode_of_cut_character(spark):
    cut = "".join(T.byte_alphabet()[b] for b in "é!".encode()[:1])
    assert one(spark, cut, T.byte_decode_lossy) == "�"


def test_clean_text(spark):
    assert one(spark, "a\u0000b�c\td​e f\n", T.clean_text) == "abc de f "


def test_normal_forms(spark):
    assert one(spark, "é", T.normalize) == "é"
    assert one(spark, "é한", T.strip_accents) == "e" + unicodedata.normalize("NFD", "한")
    assert one(spark, None, T.normalize) is None


@pytest.mark.parametrize(("s", "want"), [("a cat", ["a", "cat"]), ("  ", []), ("a  b", ["a", "", "b"]), (" x y ", ["x", "y"])])
def test_whitespace_tokens(spark, s, want):
    assert one(spark, s, T.whitespace_tokens) == want


def test_basic_tokens(spark):
    assert one(spark, "A cat, café!", T.basic_tokens) == ["a", "cat", ",", "cafe", "!"]
    assert one(spark, "A cat, café!", lambda c: T.basic_tokens(c, lower=False)) == ["A", "cat", ",", "café", "!"]
    assert one(spark, "Keep [X] x.y", lambda c: T.basic_tokens(c, never_split=("[X]",))) == ["keep", "[X]", "x", ".", "y"]
    assert one(spark, "中文 a", lambda c: T.basic_tokens(c, chinese=True)) == ["中", "文", "a"]
    assert one(spark, "", T.basic_tokens) == []


@pytest.mark.parametrize("s", ["Hello  world's\n\n end ", "x😀y  z", "don't 12ab!?", "  a"])
def test_byte_level_pretokens_are_lossless(spark, s):
    assert "".join(one(spark, s, T.byte_level_pretokens)) == s


def test_pretokens(spark):
    assert one(spark, "I'M 42 ok!!", T.word_end_pretokens) == ["I", "'M", "4", "2", "ok", "!!"]
    assert one(spark, "a  b", T.byte_level_pretokens) == ["a", " ", " b"]


def test_split_added(spark):
    words = ["[CLS]", "extra_id_1", "extra_id_100"]
    assert one(spark, "[CLS] This is a extra_id_100", lambda c: T.split_added(c, words)) == ["[CLS]", " This is a ", "extra_id_100"]
    assert one(spark, "text", lambda c: T.split_added(c, [])) == ["text"]
    assert one(spark, "abcd", lambda c: T.split_added(c, ["ab", "bcd"])) == ["ab", "cd"]
    assert one(spark, "", lambda c: T.split_added(c, words)) == []


def test_strip_neighbours(spark):
    f = lambda c: T.strip_neighbours(T.split_added(c, ["<a>", "<b>"]), rstrip=["<a>"], lstrip=["<b>"])
    assert one(spark, "x <a>  y  <b> z", f) == ["x ", "<a>", "y", "<b>", " z"]
    assert one(spark, "<a>", f) == ["<a>"]


def test_single_words(spark):
    f = lambda c: T.rejoin_single_words(T.split_added(c, ["the"]), ["the"])
    assert one(spark, "see the end", f) == ["see the", " end"]
    assert one(spark, "other", f) == ["o", "the", "r"]


def test_single_words_at_the_start_and_by_the_thousand(spark):
    def plain(parts: list[str]) -> list[str]:
        out, glue = [], False
        for x in parts:
            onto_left = x == "the" and bool(out) and out[-1].endswith(" ")
            if onto_left or (glue and x.startswith(" ")):
                out[-1] += x
            else:
                out.append(x)
            glue = x == "the" and not onto_left
        return out

    rng = random.Random(3)
    texts = ["the", "the end", "thethe the the", "  the", "", None, "the x " * 5000, *("".join(rng.choices(["the", " ", "x", "the ", " y "], k=40)) for _ in range(300))]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").select("i", "t", T.split_added(F.col("t"), ["the"]).alias("p"))
    rows = df.select("t", T.rejoin_single_words(F.col("p"), ["the"]).alias("got")).collect()
    for t, got in rows:
        assert got == (None if t is None else plain([x for x in re.split("(the)", t) if x]))


def test_protected_lower(spark):
    assert one(spark, "AB <S> Cd", lambda c: T.protected_lower(c, ["<S>"])) == "ab <S> cd"


def test_cleanup(spark):
    assert one(spark, "Hi , it 's fine . do n't ' x", T.cleanup_spaces) == "Hi, it's fine. don't'x"


def test_piece_text(spark):
    assert one(spark, "a b", T.piece_text) == "▁a▁b"


def test_split_keeps_every_character(spark):
    """The marker of the split may stand in texts and in words."""
    words = ["<a>", "x", "ab"]
    for text in ("abcd", "", "xab", "ab<a>a", "babb", "ab" * 3):
        got = one(spark, text, lambda c: T.split_parts(c, words))
        assert "".join(p.text for p in got) == text and all(p.added == (p.text in words) for p in got), text
    assert one(spark, "xab", lambda c: T.split_added(c, words)) == ["", "x", "ab"]
    assert one(spark, "xy", lambda c: T.split_added(c, [])) == ["xy"]


def test_ten_thousand_added_tokens_split_as_one_pattern_does(spark):
    """Leftmost, longest: the automaton against a pattern in Python, over words that begin and end alike."""
    rng = random.Random(17)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(14_000)} | {"", "a", "<|end|>"}
    words -= {"a", "b", "c"}
    pattern = re.compile("|".join(map(re.escape, sorted(words, key=lambda w: (-len(w), w)))))
    texts = ["".join(rng.choice("abcd é😀") for _ in range(rng.randint(0, 60))) + rng.choice(["", "<|end|>", "<|en"]) for _ in range(150)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for r in df.select("i", T.split_parts(F.col("text"), words).alias("p")).collect():
        text = texts[r.i]
        if text is None:
            assert r.p is None
            continue
        want, at = [], 0
        for m in pattern.finditer(text):
            want += [(text[at : m.start()], False), (m[0], True)]
            at = m.end()
        assert [(p.text, p.added) for p in r.p] == [x for x in [*want, (text[at:], False)] if x[0]], text
