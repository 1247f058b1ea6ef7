"""Vocabulary, merge and configuration files, and inputs as tagged JSON."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.options import GenerationConfig, TokenizerConfig


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """token, id from a JSON object of tokens."""
    return read_whole(spark, path).select(F.explode(F.from_json("value", "map<string,int>")).alias("token", "id"))


def write_vocab(vocab: DataFrame, path: str) -> None:
    """A vocabulary is one JSON object by its format, so it is gathered in one row; vocabularies are bounded files."""
    vocab.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("token", "id"))))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_merges(spark: SparkSession, path: str, most: int | None = None, drop_last: bool = False) -> DataFrame:
    """rank, left, right: the header is skipped; most keeps the first ones; drop_last repeats a known loss of the last merge."""
    lines = F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\r?\n")
    body = F.slice(lines, 2, F.greatest(F.size(lines) - (2 if drop_last else 1), F.lit(0)))
    body = F.slice(body, 1, most) if most is not None else body
    pair = F.split("line", r"\s+")
    return read_whole(spark, path).select(F.posexplode(body).alias("rank", "line")).select("rank", pair[0].alias("left"), F.try_element_at(pair, F.lit(2)).alias("right"))


def read_tokenizer_json(path: str) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """Vocabulary and merges of a public tokenizer file, on the driver: a file of fixed size."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    return model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]


def read_tokenizer_config(spark: SparkSession, path: str) -> TokenizerConfig:
    return TokenizerConfig.from_json(read_whole(spark, path).first()[0])


def read_generation_config(spark: SparkSession, path: str) -> GenerationConfig:
    return GenerationConfig.from_json(read_whole(spark, path).first()[0])


def read_pieces(path: str) -> dict[str, float]:
    """Pieces and scores of a SentencePiece model file."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return {p.id_to_piece(i): p.get_score(i) for i in range(p.get_piece_size())}


#: The four shapes of an input and their value types.
INPUT_TYPES = {"SingleInput": "string", "BatchInput": "array<string>", "PretokenizedSingleInput": "array<string>", "PretokenizedBatchInput": "array<array<string>>"}


def input_json(value: Column, kind: str) -> Column:
    """{"Type": kind, "Value": value}"""
    if kind not in INPUT_TYPES:
        raise ValueError(f"no input type {kind}")
    return F.to_json(F.struct(F.lit(kind).alias("Type"), value.alias("Value")))


def parse_input_json(c: Column) -> Column:
    """struct of type and one typed field for each shape; the others are null."""
    kind = F.get_json_object(c, "$.Type")
    fields = [F.when(kind == k, F.from_json(c, f"struct<Value:{t}>")["Value"]).alias(k) for k, t in INPUT_TYPES.items()]
    return F.struct(kind.alias("type"), *fields)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_encodings(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
