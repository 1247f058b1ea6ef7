"""Sequence preparation over id arrays: special tokens, type ids, masks, truncation and padding, all as array expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.options import EncodeOptions, Family, Padding, Side, Truncation

INTS = "array<int>"


def _one(x: int) -> Column:
    return F.array(F.lit(x).cast("int"))


def _none() -> Column:
    return F.array().cast(INTS)


def fill(value: int, n: Column | int) -> Column:
    return F.array_repeat(F.lit(value).cast("int"), F.greatest(F.lit(n) if isinstance(n, int) else n, F.lit(0)).cast("int"))


def template(family: Family, pair: bool, bos: bool = True, eos: bool = True) -> list[str]:
    """Order of parts: a, b, bos, eos. bos and eos switch the optional ones of the last two families."""
    if family == Family.WORD_END:
        return ["bos", "a", "eos", *(["eos", "b", "eos"] if pair else [])]
    if family == Family.BYTE_LEVEL:
        return [*(["bos"] if bos else []), "a", *([*(["bos"] if bos else []), "b"] if pair else [])]
    if family == Family.PIECES:
        wrap = lambda x: [*(["bos"] if bos else []), x, *(["eos"] if eos else [])]
        return wrap("a") + (wrap("b") if pair else [])
    return ["a", *(["b"] if pair else [])]


def special_count(family: Family, pair: bool, bos: bool = True, eos: bool = True) -> int:
    return sum(x in ("bos", "eos") for x in template(family, pair, bos, eos))


def with_special(family: Family, a: Column, b: Column | None, bos_id: int, eos_id: int, bos: bool = True, eos: bool = True) -> Column:
    part = {"a": a, "b": b, "bos": _one(bos_id), "eos": _one(eos_id)}
    return F.concat(*[part[x] for x in template(family, b is not None, bos, eos)])


def special_mask(family: Family, a: Column, b: Column | None, bos: bool = True, eos: bool = True) -> Column:
    """1 where the template puts a special token."""
    part = {"a": fill(0, F.size(a)), "b": fill(0, F.size(b)) if b is not None else None, "bos": _one(1), "eos": _one(1)}
    return F.concat(*[part[x] for x in template(family, b is not None, bos, eos)])


def mask_of_ids(ids: Column, special_ids: list[int]) -> Column:
    """1 where an id of a finished sequence is special."""
    return F.transform(ids, lambda x: x.isin(*special_ids).cast("int")) if special_ids else fill(0, F.size(ids))


def type_ids(family: Family, a: Column, b: Column | None, bos: bool = True, eos: bool = True) -> Column:
    """Zeros for the first sequence and ones for the second; the word-end family has zeros alone, its special tokens included."""
    n, m = F.size(a), F.size(b) if b is not None else None
    if family == Family.WORD_END:
        return fill(0, n + 2 if m is None else n + m + 4)
    extra = (int(bos) + int(eos)) if family == Family.PIECES else 0
    first = fill(0, n + extra)
    return first if m is None else F.concat(first, fill(1, m + extra))


def keep(ids: Column, n: Column, side: Side = Side.RIGHT) -> Column:
    """The n ids that stay when truncation drops from the given side."""
    size = F.size(ids)
    n = F.greatest(F.least(n, size), F.lit(0)).cast("int")
    return F.slice(ids, 1, n) if side == Side.RIGHT else F.slice(ids, (size - n + 1).cast("int"), n)


def split_removal(la: Column, lb: Column, n: Column) -> tuple[Column, Column]:
    """How many ids each of a pair loses when n go one by one from the longer, ties from the second."""
    d = la - lb
    half = lambda x: F.floor(F.greatest(x, F.lit(0)) / 2).cast("int")
    ra = F.when(d > 0, F.least(n, d) + half(n - d)).otherwise(half(n + d))
    return ra.cast("int"), (n - ra).cast("int")


def truncate(a: Column, b: Column | None, n: Column, how: Truncation, stride: int = 0, side: Side = Side.RIGHT) -> tuple[Column, Column | None, Column]:
    """Both sequences after n ids are removed, and the overflow: the removed ids with stride ones before them.

    A sequence that has not more than n ids is left as it is. Nothing happens for n <= 0.
    """
    n = F.greatest(n, F.lit(0)).cast("int")
    la = F.size(a)

    def cut(ids: Column) -> tuple[Column, Column]:
        size = F.size(ids)
        active = (n > 0) & (size > n)
        window = F.least(size, n + stride).cast("int")
        over = F.slice(ids, (size - window + 1).cast("int"), window) if side == Side.RIGHT else F.slice(ids, 1, window)
        return F.when(active, keep(ids, size - n, side)).otherwise(ids), F.when(active, over).otherwise(_none())

    if how == Truncation.NONE:
        return a, b, _none()
    if how == Truncation.ONLY_FIRST or (how == Truncation.LONGEST_FIRST and b is None):
        kept, over = cut(a)
        return kept, b, over
    if how == Truncation.ONLY_SECOND:
        if b is None:
            return a, b, _none()
        kept, over = cut(b)
        return a, kept, over
    ra, rb = split_removal(la, F.size(b), n)
    return keep(a, la - ra, side), keep(b, F.size(b) - rb, side), _none()


def padded(ids: Column, length: Column, value: int, side: Side = Side.RIGHT) -> Column:
    more = fill(value, length - F.size(ids))
    return F.concat(ids, more) if side == Side.RIGHT else F.concat(more, ids)


def round_up(n: Column, multiple: int | None) -> Column:
    return n if not multiple else (F.ceil(n / multiple) * multiple).cast("int")


def pad(df: DataFrame, options: EncodeOptions, pad_id: int, batch: str | None = None, type_id: int = 0) -> DataFrame:
    """Pad the columns of an encoding. Longest means the longest of the row's batch, or the row itself without a batch."""
    size = F.size("input_ids")
    if options.padding == Padding.NONE:
        return df
    if options.padding == Padding.MAX_LENGTH:
        target = F.lit(options.max_length if options.max_length is not None else options.model_max_length)
    elif batch is None:
        target = size
    else:
        # rows meet their batch, a bounded unit, once: taking the maxima apart from the rows would tokenize every text twice
        target = F.max(size).over(Window.partitionBy(batch))
    df = df.withColumn("pad_to", F.greatest(round_up(target, options.pad_to_multiple_of), size).cast("int"))
    fills = {"input_ids": pad_id, "attention_mask": 0, "token_type_ids": type_id, "special_tokens_mask": 1}
    return df.withColumns({c: padded(F.col(c), F.col("pad_to"), v, options.padding_side) for c, v in fills.items() if c in df.columns}).drop("pad_to")


def prepare(
    df: DataFrame, ids: str, options: EncodeOptions, family: Family = Family.WORD_END, pair: str | None = None, bos_id: int = 0, eos_id: int = 0, pad_id: int = 0,
    batch: str | None = None, bos: bool = True, eos: bool = True,
) -> DataFrame:
    """Model-ready columns from one or two id arrays; the schema depends on the options alone.

    num_truncated_tokens is the total before truncation minus max_length, also where nothing was cut, and may be negative.
    """
    options.validate(pair is not None)
    kind = family if options.add_special_tokens else Family.PLAIN
    extra = special_count(kind, pair is not None, bos, eos)
    a, b = F.col(ids), F.col(pair) if pair else None
    total = F.size(a) + (F.size(b) if b is not None else F.lit(0)) + extra
    over, truncated = _none(), F.lit(0)
    kept = [c for c in df.columns if c not in (ids, pair)]
    if options.max_length is not None:
        truncated = total - options.max_length
        if options.truncation != Truncation.NONE and options.max_length > 0:
            a, b, over = truncate(a, b, truncated, options.truncation, options.stride, options.truncation_side)
    own = {"first_ids": a, "overflow": over, "total": total.cast("int"), "excess": truncated.cast("int")} | ({"second_ids": b} if b is not None else {})
    out = df.select(*kept, *[v.alias(k) for k, v in own.items()])
    a, b = F.col("first_ids"), F.col("second_ids") if b is not None else None
    names = options.model_input_names
    cols = {"input_ids": with_special(kind, a, b, bos_id, eos_id, bos, eos)}
    if options.return_token_type_ids or (options.return_token_type_ids is None and "token_type_ids" in names and options.add_special_tokens):
        cols["token_type_ids"] = type_ids(family, a, b, bos, eos)
    if options.return_special_tokens_mask:
        cols["special_tokens_mask"] = special_mask(kind, a, b, bos, eos)
    if options.return_overflowing_tokens:
        cols["overflowing_tokens"], cols["num_truncated_tokens"] = F.col("overflow"), F.col("excess")
    cols["too_long"] = F.lit(options.max_length is None) & (F.size(cols["input_ids"]) > options.model_max_length)
    out = out.select(*kept, *[v.alias(k) for k, v in cols.items()])
    if options.return_attention_mask or (options.return_attention_mask is None and "attention_mask" in names):
        out = out.withColumn("attention_mask", fill(1, F.size("input_ids")))
    out = pad(out, options, pad_id, batch)
    return out.withColumn("length", F.size("input_ids")) if options.return_length else out


def windows(df: DataFrame, key: Sequence[str], ids: str, size: int, stride: int, before: Sequence[int] = (), after: Sequence[int] = ()) -> DataFrame:
    """key, window, start and ids: every id of a row is in a window of at most ``size`` ids, the special ones before and after included;
    neighbours share ``stride`` ids. window counts from 0 and start is the window's first id in the row, so results map back; a row without ids has one window.
    """
    room = size - len(before) - len(after)
    if not 0 <= stride < room:
        raise ValueError("the stride must be smaller than what a window has room for")
    step, n = room - stride, F.coalesce(F.size(ids), F.lit(0))
    last = F.greatest(F.ceil((n - stride) / step) - 1, F.lit(0)).cast("int")
    rows = df.select(*key, F.coalesce(ids, F.array().cast("array<int>")).alias("ids"), F.explode(F.sequence(F.lit(0), last)).alias("window"))
    fixed = lambda x: F.array(*map(F.lit, x)).cast("array<int>")
    return rows.select(*key, "window", (F.col("window") * step).alias("start"), F.concat(fixed(before), F.slice("ids", F.col("window") * step + 1, room), fixed(after)).alias("ids"))
