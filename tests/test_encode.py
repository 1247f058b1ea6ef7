import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtext.operators import encode as E
from loomtext.plans.options import EncodeOptions, Family, Padding, Side, Truncation


def slow_truncate(a, b, n, how, stride, side):
    a, b = list(a), None if b is None else list(b)

    def cut(x):
        if n <= 0 or len(x) <= n:
            return x, []
        w = min(len(x), stride + n)
        return (x[:-n], x[-w:]) if side == Side.RIGHT else (x[n:], x[:w])

    if how == Truncation.ONLY_FIRST or (how == Truncation.LONGEST_FIRST and b is None):
        a, over = cut(a)
        return a, b, over
    if how == Truncation.ONLY_SECOND:
        if b is None:
            return a, b, []
        b, over = cut(b)
        return a, b, over
    for _ in range(max(n, 0)):
        x = a if len(a) > len(b) else b
        if x:
            x.pop(-1 if side == Side.RIGHT else 0)
    return a, b, []


@pytest.mark.parametrize("side", list(Side))
@pytest.mark.parametrize("how", [Truncation.ONLY_FIRST, Truncation.ONLY_SECOND, Truncation.LONGEST_FIRST])
def test_truncation_is_like_a_loop(spark, how, side):
    cases = [(la, lb, n) for la in range(0, 7) for lb in range(0, 7) for n in range(-1, la + lb + 1)]
    df = spark.createDataFrame([(list(range(la)), list(range(100, 100 + lb)), n) for la, lb, n in cases], "a array<int>, b array<int>, n int")
    a, b, over = E.truncate(F.col("a"), F.col("b"), F.col("n"), how, 2, side)
    for r in df.select("a", "b", "n", a.alias("x"), b.alias("y"), over.alias("o")).collect():
        assert (r.x, r.y, r.o) == slow_truncate(r.a, r.b, r.n, how, 2, side)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40), st.integers(0, 80)), min_size=1, max_size=20))
def test_split_removal(spark, cases):
    cases = [(a, b, min(n, a + b)) for a, b, n in cases]
    df = spark.createDataFrame(cases, "a int, b int, n int")
    ra, rb = E.split_removal(F.col("a"), F.col("b"), F.col("n"))
    for r in df.select("a", "b", "n", ra.alias("x"), rb.alias("y")).collect():
        a, b = r.a, r.b
        for _ in range(r.n):
            a, b = (a - 1, b) if a > b else (a, b - 1)
        assert (r.a - r.x, r.b - r.y) == (a, b)


def rows(spark):
    return spark.createDataFrame([(1, [5, 6, 7], [8, 9]), (2, [], [])], "id int, a array<int>, b array<int>")


@pytest.mark.parametrize(("family", "ids", "mask", "types"), [
    (Family.WORD_END, [1, 5, 6, 7, 2, 2, 8, 9, 2], [1, 0, 0, 0, 1, 1, 0, 0, 1], [0] * 9),
    (Family.BYTE_LEVEL, [1, 5, 6, 7, 1, 8, 9], [1, 0, 0, 0, 1, 0, 0], [0, 0, 0, 1, 1]),
    (Family.PIECES, [1, 5, 6, 7, 2, 1, 8, 9, 2], [1, 0, 0, 0, 1, 1, 0, 0, 1], [0, 0, 0, 0, 0, 1, 1, 1, 1]),
])
def test_templates(spark, family, ids, mask, types):
    a, b = F.col("a"), F.col("b")
    r = rows(spark).where("id = 1").select(E.with_special(family, a, b, 1, 2).alias("i"), E.special_mask(family, a, b).alias("m"), E.type_ids(family, a, b).alias("t")).first()
    assert (r.i, r.m, r.t) == (ids, mask, types)
    assert E.special_count(family, True) == sum(mask)


def test_prepare_and_errors(spark):
    out = E.prepare(rows(spark), "a", EncodeOptions(truncation=Truncation.ONLY_FIRST, max_length=4, stride=1, return_overflowing_tokens=True, return_special_tokens_mask=True, return_length=True), Family.WORD_END, bos_id=1, eos_id=2)
    got = {r.id: r for r in out.collect()}
    assert got[1].input_ids == [1, 5, 6, 2] and got[1].overflowing_tokens == [6, 7] and got[1].num_truncated_tokens == 1 and got[1].length == 4
    assert got[2].input_ids == [1, 2] and got[2].num_truncated_tokens == -2
    with pytest.raises(ValueError):
        E.prepare(rows(spark), "a", EncodeOptions(add_special_tokens=False, return_token_type_ids=True))
    with pytest.raises(ValueError):
        E.prepare(rows(spark), "a", EncodeOptions(truncation=Truncation.LONGEST_FIRST, return_overflowing_tokens=True), pair="b")


def test_padding(spark):
    options = EncodeOptions(padding=Padding.MAX_LENGTH, max_length=5, padding_side=Side.LEFT, pad_to_multiple_of=4, return_special_tokens_mask=True)
    got = {r.id: r for r in E.prepare(rows(spark), "a", options, Family.WORD_END, bos_id=1, eos_id=2, pad_id=9).collect()}
    assert got[2].input_ids == [9] * 6 + [1, 2] and got[2].attention_mask == [0] * 6 + [1, 1] and got[2].special_tokens_mask == [1] * 8
    assert len(got[1].input_ids) == 8
    longer = EncodeOptions(padding=Padding.MAX_LENGTH, max_length=2)
    assert {len(r.input_ids) for r in E.prepare(rows(spark), "a", longer, Family.WORD_END).collect()} == {5, 2}


def test_mask_of_finished_ids(spark):
    r = rows(spark).where("id = 1").select(E.mask_of_ids(F.col("a"), [6]).alias("m")).first()
    assert r.m == [0, 1, 0]


@pytest.mark.parametrize(("size", "stride"), [(5, 1), (4, 0), (6, 3)])
def test_windows_cover_every_id_and_overlap(spark, size, stride):
    rows = [(n, list(range(n))) for n in range(0, 25)] + [(99, None)]
    df = spark.createDataFrame(rows, "k int, ids array<int>")
    found = {}
    for r in E.windows(df, ["k"], "ids", size, stride, [-1], [-2]).orderBy("k", "window").collect():
        assert r.ids[0] == -1 and r.ids[-1] == -2 and len(r.ids) <= size
        found.setdefault(r.k, []).append((r.start, r.ids[1:-1]))
    for k, ids in rows:
        own, step = ids or [], size - 2 - stride
        want = [(0, own[: size - 2])]
        while want[-1][0] + size - 2 < len(own):
            want.append((want[-1][0] + step, own[want[-1][0] + step :][: size - 2]))
        assert found[k] == want, k
    with pytest.raises(ValueError):
        E.windows(df, ["k"], "ids", 4, 2, [-1], [-2])
