"""Vocabularies as relations (token, id), added tokens, and lookups in both directions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.options import AddedToken
from .bpe import subwords


def vocab_frame(spark: SparkSession, vocab: dict[str, int]) -> DataFrame:
    return spark.createDataFrame(sorted(vocab.items(), key=lambda x: x[1]), "token string, id int")


def merged_vocab(vocab: DataFrame, added: Sequence[AddedToken]) -> DataFrame:
    """The vocabulary overlaid with added tokens; of two ids for one token the added one holds."""
    if not added:
        return vocab
    extra = vocab.sparkSession.createDataFrame([(t.content, t.id) for t in added], "token string, id int")
    return vocab.join(F.broadcast(extra.select("token")), "token", "left_anti").unionByName(extra)


def add_tokens(vocab: dict[str, int], added: Sequence[AddedToken], new: Sequence[str | AddedToken], special: bool = False, lower: bool = False) -> tuple[list[AddedToken], int]:
    """All added tokens after adding, and how many are new: empty and known strings are skipped, ids go on from the vocabulary's end."""
    have = {t.content: t for t in added}
    after = max([len(vocab) - 1, *[t.id for t in added if t.id is not None]]) + 1
    count = 0
    for t in new:
        token = t if isinstance(t, AddedToken) else AddedToken(t, special=special)
        content = token.content.lower() if lower and not token.special and token.normalized else token.content
        if not content or content in have:
            continue
        known = vocab.get(content)
        have[content] = replace(token, content=content, id=after if known is None else known)
        if known is None:
            after += 1
            count += 1
    return list(have.values()), count


def require(vocab: dict[str, int], token: str) -> int:
    """The id of a token that must exist, such as the unknown token: checked when a plan is made, not for each row."""
    if token not in vocab:
        raise ValueError(f"{token!r} is not in the vocabulary")
    return vocab[token]


def token_ids(df: DataFrame, key: Sequence[str], tokens: str, vocab: DataFrame | dict[str, int], unk_id: int | None) -> DataFrame:
    """key and ids of an array of tokens, one row for each row, whatever its key. An unknown token takes unk_id; without one it is an error.

    A vocabulary file's dictionary is looked up in place. A vocabulary table of any size is joined, and rows are put together by a number of their own.
    """
    if isinstance(vocab, dict):
        return df.select(*key, subwords(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: [t], vocab, unk_id).alias("ids"))
    flat = df.select(*key, F.monotonically_increasing_id().alias("row_"), tokens).select(*key, "row_", F.posexplode_outer(tokens).alias("pos_", "token_"))
    fallback = F.lit(unk_id) if unk_id is not None else F.raise_error(F.concat(F.lit("unknown token: "), F.col("token_"))).cast("int")
    found = flat.join(vocab.select(F.col("token").alias("token_"), F.col("id").alias("id_")), "token_", "left")
    known = F.when(F.col("pos_").isNotNull(), F.struct("pos_", F.coalesce("id_", fallback).alias("id_")))
    return found.groupBy("row_", *key).agg(F.array_sort(F.collect_list(known)).alias("t_")).select(*key, F.col("t_.id_").alias("ids"))


def tokens_of(ids: Column, vocab: dict[str, int], skip: Sequence[int] = ()) -> Column:
    """Tokens of arrays of ids, in place; ids in skip are left out, a missing id is an error."""
    known = np.array(sorted(vocab.values()), dtype=np.int64)
    names = [t for t, _ in sorted(vocab.items(), key=lambda x: x[1])]
    left_out = np.array(sorted(skip), dtype=np.int64)

    @F.arrow_udf("array<string>")
    def run(rows: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        kept = ~np.isin(flat, left_out)
        at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
        if (bad := kept & (known[at] != flat)).any():
            raise ValueError(f"no token has id {flat[bad][0]}")
        ends = np.concatenate(([0], np.cumsum(kept)))[np.concatenate(([0], np.cumsum(sizes)))]
        used, back = np.unique(at[kept], return_inverse=True)
        strings = pa.DictionaryArray.from_arrays(pa.array(back.astype(np.int32)), pa.array([names[k] for k in used.tolist()], pa.string())).cast(pa.string())
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), strings)

    return run(ids)


def id_tokens(df: DataFrame, key: Sequence[str], ids: str, vocab: DataFrame | dict[str, int], skip: Sequence[int] = ()) -> DataFrame:
    """key and tokens of an array of ids, one row for each row; ids in skip are left out, a missing id is an error."""
    if isinstance(vocab, dict):
        return df.select(*key, tokens_of(F.coalesce(ids, F.array()).cast("array<int>"), vocab, skip).alias("tokens"))
    flat = df.select(*key, F.monotonically_increasing_id().alias("row_"), ids).select(*key, "row_", F.posexplode_outer(ids).alias("pos_", "id_"))
    if skip:
        flat = flat.withColumn("pos_", F.when(~F.col("id_").isin(*skip), F.col("pos_")))
    found = flat.join(vocab.select(F.col("token").alias("token_"), F.col("id").alias("id_")), "id_", "left")
    missing = F.raise_error(F.concat(F.lit("no token has id "), F.col("id_").cast("string")))
    known = F.when(F.col("pos_").isNotNull(), F.struct("pos_", F.coalesce("token_", missing).alias("token_")))
    return found.groupBy("row_", *key).agg(F.array_sort(F.collect_list(known)).alias("t_")).select(*key, F.col("t_.token_").alias("tokens"))


def ids_of(tokens: Column, vocab: dict[str, int], unk_id: int) -> Column:
    """Small vocabularies: a literal map, no join."""
    table = F.create_map(*[x for k, v in vocab.items() for x in (F.lit(k), F.lit(v))])
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), F.lit(unk_id)))
